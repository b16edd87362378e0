"""Merchant risk fed back from earlier verdicts (a serial fold per merchant).

Meaning: rows of a merchant are judged one after another; ``merchant_risk`` of a
row is the share of High verdicts among the merchant's last ``history`` earlier
rows (0.0 when none), and the row's own verdict uses that value.  No window
function can express this recursion.

Parallel, exact evaluation (no key is ever held by one task), two-ended:

1. Rows are range-partitioned by (merchant, order) and sorted, as in a prefix
   scan; a hot merchant fills several partitions.  Only the first merchant of a
   partition can have begun before.
2. Each partition folds its rows from the range of all start states at once:
   with the fewest and the most High verdicts that are possible.  A verdict is
   known where both ends agree; after ``history`` known verdicts in a row the
   start no longer matters.  The rows before that stay *open*.  Nearly every
   partition closes, so its end state needs no start and all are independent.
3. A partition that never closes is a function on states.  Its ends from the
   all-0 and all-1 start are known from the first pass; partitions are composed
   in order from these, one small row each, and only a start met nowhere yet
   is folded in a further round, for all such partitions at once.
4. The open rows, some hundreds in most partitions, are folded from their true
   start.

Per-row inputs are two precomputed verdicts: ``hi_risky`` (High if the merchant
term fires) and ``hi_safe`` (High if it does not).
"""
from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.functions.scoring import MERCHANT_RISK_CUTOFF
from riskflow.operators.ordered import Runs, carry_batch, spread, store, text

HISTORY = 100
#: start states tried ahead of their turn, per unclosed partition and round
AHEAD = 4


def judge(risky: np.ndarray, safe: np.ndarray, state: list[int], history: int, cutoff: float) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(risk, flag, end state) of rows judged in order from a state, the last verdicts, oldest first."""
    before = len(state)
    if (risky == safe).all():
        flag = risky.astype(np.int64)
    else:
        every, ones = list(state), sum(state)
        for hr, hs in zip(risky.tolist(), safe.tolist()):
            n = min(len(every), history)
            f = int(hr if n and ones / n > cutoff else hs)
            every.append(f)
            ones += f
            if len(every) > history:
                ones -= every[-1 - history]
        flag = np.array(every[before:], dtype=np.int64)
    total = np.r_[0, np.cumsum(np.r_[np.array(state, dtype=np.int64), flag])]
    at = np.arange(len(flag)) + before
    n = np.minimum(at, history)
    risk = (total[at] - total[at - n]) / np.maximum(n, 1)
    return risk, flag, [*state, *flag[-history:].tolist()][-history:]


class Ends:
    """The verdicts that are possible after an unknown start: a fewest and a most of them."""

    def __init__(self, history: int, cutoff: float):
        self.history, self.cutoff = history, cutoff
        self.low, self.high, self.known = [0] * history, [1] * history, 0
        self.ones = [0, history]
        self.starts = {"0" * history: [0] * history, "1" * history: [1] * history}

    def closes(self, risky: np.ndarray, safe: np.ndarray) -> int | None:
        """Rows until the start no longer matters, or None; the rows are taken in."""
        for i, (hr, hs) in enumerate(zip(risky.tolist(), safe.tolist())):
            up = [n / self.history > self.cutoff for n in self.ones]
            low, high = (int(hr if up[0] else hs),) * 2 if up[0] == up[1] or hr == hs else (0, 1)
            self.low.append(low)
            self.high.append(high)
            self.ones = [self.ones[0] + low - self.low[-1 - self.history], self.ones[1] + high - self.high[-1 - self.history]]
            self.known = self.known + 1 if low == high else 0
            if self.known == self.history:
                return i + 1
        self.low, self.high = self.low[-self.history:], self.high[-self.history:]
        self.starts = {s: judge(risky, safe, end, self.history, self.cutoff)[2] for s, end in self.starts.items()}
        return None


def _fold(key: str, kept: list[str], history: int, cutoff: float):
    def fold(batches):
        runs, pid, schema = Runs([key]), TaskContext.get().partitionId(), None
        ends, state, tail, at = Ends(history, cutoff), [], 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            column = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
            new, head = runs.of(b)
            risky, safe = (column(c).to_numpy(zero_copy_only=False) for c in ("_hi_risky", "_hi_safe"))
            risk, flag, open_ = np.zeros(b.num_rows), np.zeros(b.num_rows, "i4"), np.zeros(b.num_rows, dtype=bool)
            starts = np.unique(np.r_[0, np.flatnonzero(new)])
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows]):
                tail = z - a if new[a] else tail + z - a
                if head[a]:
                    if ends is not None:
                        closed = ends.closes(risky[a:z], safe[a:z])
                        open_[a:z if closed is None else a + closed] = True
                        if closed is None:
                            continue
                        state, a, ends = ends.low[-history:], a + closed, None
                elif new[a]:
                    state = []
                risk[a:z], flag[a:z], state = judge(risky[a:z], safe[a:z], state, history, cutoff)
            out = {c: column(c) for c in kept} | {"_pid": pa.array(np.full(b.num_rows, pid, "i4")), "_head": pa.array(head)}
            out |= {"_at": pa.array(np.arange(at, at + b.num_rows)), "_open": pa.array(open_), "_risk": pa.array(risk), "_flag": pa.array(flag), "_carry": pa.nulls(b.num_rows, pa.string())}
            at += b.num_rows
            made = pa.RecordBatch.from_pydict(out)
            schema = made.schema
            yield made
        if schema is not None:
            bits = lambda s: "".join(map(str, s))
            yield carry_batch(schema, _pid=pid, _carry=text({
                "first": runs.first, "last": runs.last, "one": runs.begun == 1, "tail": tail, "closed": ends is None,
                "end": bits(state) if runs.begun > 1 or ends is None else None,
                "ends": {s: bits(e) for s, e in ends.starts.items()} if ends is not None else {}}))
    return fold


def _bits(state: str) -> list[int]:
    return [int(x) for x in state]


def _starts(parts: list[tuple[int, dict]], ends: dict[int, dict[str, str]], history: int) -> tuple[dict[int, str], set[tuple[int, str]]]:
    """(start of each partition's first key where it is known, (partition, start) pairs still to be folded)."""
    known, ask = {}, set()
    key, count, end, guesses = None, 0, None, []   # of the partition before: its last key, rows of it so far, its end state or what it may be
    for pid, c in parts:
        if key is None or key != c["first"]:
            count, end, guesses = 0, "", []
        if end is not None:
            known[pid] = end
        start, maybe, full = end, [g for g in guesses if len(g) == min(count, history)], count >= history
        count = count + c["tail"] if c["one"] else c["tail"]
        end, guesses = c["end"], []
        if c["one"] and not (c["closed"] and full):
            end = ends[pid].get(start) if start is not None else None
            if end is None:
                ask |= {(pid, s) for s in ([start] if start is not None else [g for g in maybe if g not in ends[pid]][:AHEAD])}
                guesses = list(dict.fromkeys(ends[pid].values()))
        key = c["last"]
    return known, ask


def feedback_fold(df: DataFrame, key: str, hi_risky: str, hi_safe: str,
                  order: tuple[str, str] = ("step", "row_id"), history: int = HISTORY,
                  cutoff: float = MERCHANT_RISK_CUTOFF) -> DataFrame:
    """Return ``df`` plus ``merchant_risk_online`` (double) and ``judged_high`` (int).

    One path for every key and size; rows of a null key are one key of their
    own, a null verdict counts as not High.
    """
    work = df.withColumns({"_hi_risky": F.coalesce(F.col(hi_risky).cast("boolean"), F.lit(False)),
                           "_hi_safe": F.coalesce(F.col(hi_safe).cast("boolean"), F.lit(False))})
    kept = work.columns
    fields = [T.StructField(f.name, f.dataType) for f in work.schema.fields]
    fields += [T.StructField("_pid", T.IntegerType()), T.StructField("_head", T.BooleanType()),
               T.StructField("_at", T.LongType()), T.StructField("_open", T.BooleanType()),
               T.StructField("_risk", T.DoubleType()), T.StructField("_flag", T.IntegerType()), T.StructField("_carry", T.StringType())]
    by = [F.col(c) for c in order]
    rows = store(spread(work, [key], by).mapInArrow(_fold(key, kept, history, cutoff), T.StructType(fields)), "feedback")
    carries = sorted((r["_pid"], json.loads(r["_carry"])) for r in rows.filter("_carry IS NOT NULL").select("_pid", "_carry").collect())
    rows = rows.filter("_carry IS NULL").drop("_carry")
    ends = {pid: dict(c["ends"]) for pid, c in carries}   # one row for each partition

    spark = df.sparkSession

    def folded(asked: DataFrame, wanted: DataFrame, groups: list[str], fn, schema) -> DataFrame:
        return asked.join(F.broadcast(wanted), "_pid").groupBy(*groups).applyInPandas(fn, schema)

    def end_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        state = judge(pdf["_hi_risky"].to_numpy(), pdf["_hi_safe"].to_numpy(), _bits(pdf["_start"].iloc[0]), history, cutoff)[2]
        return pd.DataFrame({"_pid": [pdf["_pid"].iloc[0]], "_start": [pdf["_start"].iloc[0]], "_end": ["".join(map(str, state))]})

    while True:
        known, ask = _starts(carries, ends, history)
        if not ask:
            break
        wanted = spark.createDataFrame(sorted(ask), "_pid int, _start string")
        head = rows.filter("_head").select("_pid", "_at", "_hi_risky", "_hi_safe")
        for r in folded(head, wanted, ["_pid", "_start"], end_of, "_pid int, _start string, _end string").collect():
            ends[r["_pid"]][r["_start"]] = r["_end"]

    # a start of full length settles the open rows; a shorter one, of a merchant's beginning, the whole first key
    wanted = spark.createDataFrame([(pid, s, len(s) < history) for pid, s in known.items()], "_pid int, _start string, _short boolean")
    out = [f for f in fields if f.name in df.columns or f.name in ("_risk", "_flag")]
    names = [f.name for f in out]

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        risk, flag, _ = judge(pdf["_hi_risky"].to_numpy(), pdf["_hi_safe"].to_numpy(), _bits(pdf["_start"].iloc[0]), history, cutoff)
        return pdf.assign(_risk=risk, _flag=flag)[names]

    rows = rows.join(F.broadcast(wanted), "_pid", "left")
    redo = F.col("_head") & (F.col("_open") | F.col("_short"))
    fixed = rows.filter(redo).groupBy("_pid").applyInPandas(again, T.StructType(out))
    return rows.filter(~redo).select(*names).unionByName(fixed) \
        .withColumnsRenamed({"_risk": "merchant_risk_online", "_flag": "judged_high"})
