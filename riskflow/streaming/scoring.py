"""Stateful scoring stream.

Per user: the last 100 model probabilities (``burst``, ``historical_risk_score``).
Per merchant: the last 100 verdicts (``merchant_risk``, fed back).  Per record:
whether it was stored before (S7, first write wins).  All three are
``transformWithStateInPandas`` operators on RocksDB, chained in one append
query; state survives restarts and executor loss, and a time to live drops what
was idle that long.

The operators are keyed by a bucket of keys.  A bucket keeps its keys in leaves:
one stored value holds all keys whose hash begins with the leaf's bits, as an
Arrow batch.  A micro-batch reads and writes the leaves of the keys it has, not
every key by a call of its own, and folds the keys of a leaf together; leaves
are split as a bucket grows, so a stored value stays small however many keys
there are.  Rows of a key are taken in ``order_cols`` order within a micro-batch
and in arrival order across micro-batches, as the online service does; a row
that arrives late is judged when it arrives.  The intake cap (T6) bounds a
micro-batch and so what a call holds.

Records, alerts and behavioural logs are appended by one ``foreachBatch``
(S7-S9), which reads no earlier record.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskflow.functions import scoring as S
from riskflow.operators.feedback import HISTORY, judge
from riskflow.operators.scoring import _total

#: groups that keys are dealt to; fixed for the life of a checkpoint
BUCKETS = 256
#: bytes of a leaf beyond which, on average, a bucket's leaves are split
LEAF_BYTES = 1 << 15
#: leaves that are held in memory and folded at once
LEAVES_AT_ONCE = 64
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class KeyedState(StatefulProcessor):
    """Runs ``fold(rows, starts, ends, held) -> (columns, state)`` for the keys of a bucket, over rows in order.

    rows are those of some keys of the micro-batch, key by key and in order; key
    i has starts[i]:ends[i].  held is what fold returned last for these keys,
    one array for each column of state, null for a new key.  once: a key's state
    never changes after its first row.
    """

    def __init__(self, columns: list[str], order_cols: tuple[str, ...], state: dict[str, pa.DataType], fold: Callable, ttl_ms: int | None, once: bool):
        self.columns, self.order, self.fold, self.ttl, self.once = columns, list(order_cols), fold, ttl_ms, once
        self.state = list(state)
        seen = {"_seen": pa.int64()} if ttl_ms else {}
        self.shape = pa.schema({"_key": pa.string(), "_hash": pa.int64()} | seen | state)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.leaves = handle.getMapState("leaves", T.StructType([T.StructField("leaf", T.StringType())]), T.StructType([T.StructField("rows", T.BinaryType())]), self.ttl)
        self.size = handle.getValueState("size", T.StructType([T.StructField("depth", T.IntegerType()), T.StructField("bytes", T.LongType())]), self.ttl)

    def _read(self, depth: int, leaf: int, now: int) -> tuple[pa.RecordBatch | None, int]:
        got = self.leaves.getValue((f"{depth}/{leaf}",))
        if got is None:
            return None, 0
        b = pa.ipc.read_record_batch(pa.py_buffer(got[0]), self.shape)
        return (b.filter(pc.greater(b["_seen"], now - self.ttl)) if self.ttl else b), len(got[0])   # a leaf lives on by any of its keys

    def _write(self, rows: pa.Table, depth: int, only: np.ndarray | None = None) -> int:
        """Stores the rows as whole leaves, but only those asked for; their bytes."""
        leaf, n = _leaf(rows["_hash"].to_numpy(), depth), 0
        if only is not None:
            asked = np.isin(leaf, only)
            rows, leaf = rows.filter(pa.array(asked)), leaf[asked]
        by_leaf = np.argsort(leaf, kind="stable")
        leaf = leaf[by_leaf]
        rows = rows.take(pa.array(by_leaf)).combine_chunks()
        begin = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]]) if len(leaf) else np.empty(0, dtype=int)
        for a, z in zip(begin.tolist(), [*begin[1:].tolist(), len(leaf)]):
            blob = rows.slice(a, z - a).to_batches()[0].serialize().to_pybytes()
            self.leaves.updateValue((f"{depth}/{leaf[a]}",), (blob,))
            n += len(blob)
        return n

    def _fold(self, pdf: pd.DataFrame, leaf: np.ndarray, depth: int, now: int) -> tuple[pd.DataFrame, int]:
        """(rows with the added columns, bytes that their leaves grew by)."""
        names = np.unique(leaf)
        stored = {x: self._read(depth, x, now) for x in names.tolist()}
        known = pa.Table.from_batches([b for b, _ in stored.values() if b is not None], self.shape).combine_chunks()
        n = len(known)
        keys = np.r_[known["_key"].to_numpy(), pdf["_key"].to_numpy(dtype=object)]
        codes = pd.factorize(keys, use_na_sentinel=False)[0][n:]   # stored keys differ, so theirs are 0 to n - 1
        touched, number = np.unique(codes, return_inverse=True)
        pdf = pdf.iloc[np.argsort(number, kind="stable")]
        ends = np.cumsum(np.bincount(number, minlength=len(touched)))
        starts = np.r_[0, ends[:-1]]
        at = pa.array(touched, mask=touched >= n)
        made, state = self.fold(pdf, starts, ends, [known[c].combine_chunks().take(at) for c in self.state])
        first = {c: pdf[c].to_numpy()[starts] for c in ("_key", "_hash")}
        fresh = [pa.array(first["_key"], pa.string(), from_pandas=True), pa.array(first["_hash"], pa.int64())]
        fresh += [pa.array(np.full(len(touched), now))] if self.ttl else []
        changed = np.unique(_leaf(first["_hash"][touched >= n], depth)) if self.once and not self.ttl else None
        untouched = np.ones(n, dtype=bool)
        untouched[touched[touched < n]] = False
        rows = pa.concat_tables([known.filter(pa.array(untouched)), pa.Table.from_arrays([*fresh, *state], schema=self.shape)])
        grown = self._write(rows, depth, changed) - sum(stored[x][1] for x in (names if changed is None else changed).tolist())
        return pdf.drop(columns=["_key", "_hash"]).assign(**made), grown

    def _split(self, depth: int, deeper: int, now: int) -> int:
        """The leaves of a bucket dealt anew to more of them, one after the other; their bytes."""
        n = 0
        for leaf in range(1 << depth):
            b, _ = self._read(depth, leaf, now)
            if b is not None:
                self.leaves.removeKey((f"{depth}/{leaf}",))
                n += self._write(pa.Table.from_batches([b]), deeper)
        return n

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        pdf = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
        pdf = pdf.set_axis(self.columns, axis=1).drop(columns="_bucket")   # computed columns arrive in order, but without their names
        pdf = pdf.sort_values(self.order, kind="stable", ignore_index=True)
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl else 0
        depth, size = self.size.get() or (0, 0)
        leaf = _leaf(pdf["_hash"].to_numpy(), depth)
        part = np.unique(leaf, return_inverse=True)[1] // LEAVES_AT_ONCE
        for i in range(int(part.max()) + 1):
            mine = part == i
            out, grown = self._fold(pdf[mine], leaf[mine], depth, now)
            size += grown
            yield out
        if size > LEAF_BYTES << depth:
            deeper = int(size // LEAF_BYTES).bit_length()
            depth, size = deeper, self._split(depth, deeper, now)
        self.size.update((depth, size))

    def close(self) -> None:
        pass


def _leaf(hashes: np.ndarray, depth: int) -> np.ndarray:
    """The first ``depth`` bits of the hashes; buckets are told apart by the last ones."""
    return (hashes.astype(np.int64).view(np.uint64) >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(hashes), dtype=np.int64)


def keyed(stream: DataFrame, key: str, order_cols: tuple[str, ...], state: dict[str, pa.DataType], fold: Callable, added: dict[str, T.DataType],
          ttl_ms: int | None = None, buckets: int = BUCKETS, once: bool = False) -> DataFrame:
    """stream plus the added columns, by one stateful operator."""
    shape = T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema.fields] + [T.StructField(c, t) for c, t in added.items()])
    worker = KeyedState([*stream.columns, "_key", "_hash", "_bucket"], order_cols, state, fold, ttl_ms, once)
    hashed = F.xxhash64(F.col(key))
    dealt = stream.withColumns({"_key": F.col(key).cast("string"), "_hash": hashed, "_bucket": F.pmod(hashed, F.lit(buckets)).cast("int")})
    return dealt.groupBy("_bucket").transformWithStateInPandas(worker, shape, "append", "ProcessingTime" if ttl_ms else "None")


def user_state(stream: DataFrame, prob: str | None = None, order_cols: tuple[str, ...] = ("step", "row_id"),
               history: int = HISTORY, ttl_ms: int | None = None) -> DataFrame:
    """W10/W11 with keyed state: adds ``burst`` and ``historical_risk_score``.

    ``ttl_ms`` drops the history of users idle that long (default: kept
    forever); it counts processing time, so it is for running queries, not for bounded replays.
    """
    def fold(rows, starts, ends, held):
        new = np.nan_to_num(rows[prob].to_numpy(dtype=float, na_value=0.0)) if prob else np.zeros(len(rows))
        many, before = ends - starts, pc.fill_null(pc.list_value_length(held[0]), 0).to_numpy().astype(np.int64)
        size = before + many
        begin = np.cumsum(size) - size
        i = _counted(many) + np.repeat(before, many)    # rows of the user before this one that are known
        at = np.repeat(begin, many) + i
        every = np.empty(int(size.sum()))
        every[at] = new
        every[np.repeat(begin, before) + _counted(before)] = pc.list_flatten(held[0]).to_numpy()
        total = np.r_[0.0, pd.Series(every).groupby(np.repeat(np.arange(len(size)), size)).cumsum().to_numpy()]
        n = np.minimum(i, history)
        recent = np.where(i > 0, total[at], 0.0) - np.where(i > n, total[at - n], 0.0)
        keep = np.minimum(size, history)
        last = every[np.repeat(begin + size - keep, keep) + _counted(keep)]
        state = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(keep)].astype("i4")), pa.array(last))
        return {"burst": n.astype("int32"), "historical_risk_score": recent / np.maximum(n, 1)}, [state]

    return keyed(stream, "nameOrig", order_cols, {"probs": pa.list_(pa.float64())}, fold,
                 {"burst": T.IntegerType(), "historical_risk_score": T.DoubleType()}, ttl_ms)


def _counted(many: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the groups that have so many."""
    return np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)


def merchant_state(stream: DataFrame, hi_risky: str = "_hi_r", hi_safe: str = "_hi_s",
                   order_cols: tuple[str, ...] = ("step", "row_id"), history: int = HISTORY,
                   cutoff: float = S.MERCHANT_RISK_CUTOFF, ttl_ms: int | None = None) -> DataFrame:
    """W12 with keyed state: adds ``merchant_risk`` from the merchant's last verdicts, then records this one."""
    def fold(rows, starts, ends, held):
        risky, safe = (rows[c].to_numpy(dtype=bool, na_value=False) for c in (hi_risky, hi_safe))
        risk, flag, state = np.empty(len(rows)), np.empty(len(rows), dtype="int32"), []
        for a, z, before in zip(starts.tolist(), ends.tolist(), held[0].to_pylist()):
            risk[a:z], flag[a:z], end = judge(risky[a:z], safe[a:z], list(map(int, before or "")), history, cutoff)
            state.append("".join(map(str, end)))
        return {"merchant_risk": risk, "judged_high": flag}, [pa.array(state, pa.string())]

    return keyed(stream, "nameDest", order_cols, {"verdicts": pa.string()}, fold,
                 {"merchant_risk": T.DoubleType(), "judged_high": T.IntegerType()}, ttl_ms)


def first_writes(stream: DataFrame, key: str, order_cols: tuple[str, ...], ttl_ms: int | None = None) -> DataFrame:
    """S7 with keyed state: only the first row of every key passes, however often it is delivered.

    ``ttl_ms`` bounds the state: a key may pass again once it was not seen for that long.
    """
    def fold(rows, starts, ends, held):
        first = np.zeros(len(rows), dtype=bool)
        first[starts] = held[0].is_null().to_numpy(zero_copy_only=False)
        return {"_first": first}, [pa.array(np.ones(len(starts), dtype=bool))]

    return keyed(stream, key, order_cols, {"stored": pa.bool_()}, fold, {"_first": T.BooleanType()}, ttl_ms, once=True).filter("_first").drop("_first")


def verdict_inputs(df: DataFrame, prob: str | None = None, intents: str | None = None,
                   night: str | None = None) -> DataFrame:
    """The two possible verdicts of a row (with / without the merchant term)."""
    p = F.col(prob) if prob else None
    ints = F.col(intents) if intents else None
    nite = F.col(night) if night else None

    def terms(m):
        return S.heuristic_terms(F.col("amount"), F.col("type"), F.col("oldbalanceOrg"), F.col("burst"), m, ints, nite)
    return df.withColumns({
        "_hi_s": S.final_score(_total(terms(F.lit(0.0))), p) >= S.RISK_THRESHOLD_HIGH,
        "_hi_r": S.final_score(_total(terms(F.lit(1.0))), p) >= S.RISK_THRESHOLD_HIGH,
    })


def finish_scores(df: DataFrame, prob: str | None = None, intents: str | None = None,
                  night: str | None = None) -> DataFrame:
    """F14-F19 once ``burst`` and ``merchant_risk`` are known (row-local)."""
    p = F.col(prob) if prob else None
    ints = F.col(intents) if intents else None
    nite = F.col(night) if night else None
    h = _total(S.heuristic_terms(F.col("amount"), F.col("type"), F.col("oldbalanceOrg"), F.col("burst"),
                                 F.col("merchant_risk"), ints, nite))
    final = S.final_score(h, p)
    return df.drop("_hi_s", "_hi_r", "judged_high").withColumns({
        "behavioral_score": h, "final_risk_score": final, "scoring_mode": S.scoring_mode(p),
        "risk_level": S.risk_level(final), "action": S.action(final),
        "indicators": S.indicators(F.col("amount"), F.col("type"), F.col("oldbalanceOrg"), F.col("burst"),
                                   F.col("merchant_risk"), ints),
        "reasons": S.reasons(final, F.col("amount"), F.col("oldbalanceOrg")),
        "pattern_summary": S.pattern_summary(final),
        "confidence_score": S.confidence_score(final),
    })


def scoring_stream(stream: DataFrame, prob: str | None = None, intents: str | None = None, night: str | None = None,
                   order_cols: tuple[str, ...] = ("step", "row_id"), ttl_ms: int | None = None) -> DataFrame:
    """User state, candidate verdicts, merchant state (feedback) and final scores of a stream of transactions."""
    d = verdict_inputs(user_state(stream, prob, order_cols, ttl_ms=ttl_ms), prob, intents, night)
    return finish_scores(merchant_state(d, order_cols=order_cols, ttl_ms=ttl_ms), prob, intents, night)


def start(stream: DataFrame, checkpoint: str, sink=None, out_path: str | None = None, available_now: bool = False,
          trigger: str = "30 seconds"):
    """Start one append query into ``sink`` (a foreachBatch function, e.g. :func:`audit_writer`) or ``out_path``, on RocksDB."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)   # a query keeps the settings it started with
    try:
        w = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)
        q = w.foreachBatch(sink).start() if sink is not None else w.format("parquet").start(out_path)
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)
    if available_now:
        q.awaitTermination()
    return q


def audit_writer(records_path: str, alerts_path: str, logs_path: str):
    """foreachBatch body for S7-S9 over records that :func:`first_writes` let pass.

    Each epoch writes its own ``epoch=<id>`` folder with overwrite, so a retried
    batch (e.g. after a failure between the three writes) rewrites exactly the
    same rows.  No earlier epoch is read, so a batch costs the same however
    large the store is.
    """
    from riskflow.operators import audit as AU

    def write(batch: DataFrame, epoch_id: int) -> None:
        part = f"epoch={epoch_id}"
        batch.write.mode("overwrite").parquet(f"{records_path}/{part}")
        new = batch.sparkSession.read.schema(batch.schema).parquet(f"{records_path}/{part}")   # the rows just written feed the other two
        AU.alerts_of(new).write.mode("overwrite").parquet(f"{alerts_path}/{part}")
        AU.behavioral_logs(new).write.mode("overwrite").parquet(f"{logs_path}/{part}")

    return write
