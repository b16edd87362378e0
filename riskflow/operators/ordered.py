"""Distributed prefix scan: ordered aggregates per key in one pass over the rows.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task; if one
key holds a third of the data, that task holds a third of the data.  Here the
rows are range-partitioned once by (key, order) and sorted in their partitions,
so a hot key simply lies across several partitions, in order.  Each partition
scans its rows batch by batch (Arrow, vectorised) and adds one *carry* row: the
totals of its last key.  The carries, one row for each partition, are combined
in order and broadcast back; they are added to the rows of the first key of a
partition only, the one that may have begun before.

The scanned rows are written once to the shared checkpoint folder, because the
carries must fit them: a later look at the input could be partitioned anew.
"""
from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.session import scratch_path

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def spread(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """df range-partitioned by (keys, order) and sorted in its partitions."""
    by = [*map(F.col, keys), *order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *by).sortWithinPartitions(*by)


def store(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared checkpoint folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Runs:
    """Where runs of equal keys begin in the sorted batches of a partition."""

    def __init__(self, keys: list[str]):
        self.keys, self.begun = keys, 0
        self.first: list | None = None
        self.last: list | None = None

    def of(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(new, head) of the rows: whether one begins a run, whether it belongs to the partition's first run."""
        columns = [b.column(b.schema.get_field_index(k)) for k in self.keys]
        new = np.zeros(b.num_rows, dtype=bool)
        for c in columns:
            one, other = c.slice(1), c.slice(0, len(c) - 1)
            differ = pc.coalesce(pc.not_equal(one, other), pc.xor(pc.is_null(one), pc.is_null(other)))
            new[1:] |= differ.to_numpy(zero_copy_only=False)
        first = [c[0].as_py() for c in columns]
        new[0] = self.last is None or first != self.last
        if self.first is None:
            self.first = first
        self.last = [c[-1].as_py() for c in columns]
        run = np.cumsum(new) + self.begun
        self.begun = int(run[-1])
        return new, run == 1


def text(value) -> str:
    return json.dumps(value, default=str)


def carry_batch(schema: pa.Schema, **values) -> pa.RecordBatch:
    """One row of nulls but for the given columns."""
    return pa.RecordBatch.from_arrays([pa.array([values[f.name]], f.type) if f.name in values else pa.nulls(1, f.type) for f in schema], schema=schema)


def _earlier(values: np.ndarray, pos: np.ndarray, h: int) -> pa.Array:
    """For every row the values (rows of numbers) of the min(pos - 1, h) rows before it; values begins with h rows from before."""
    many = np.minimum(pos - 1, h)
    ends = np.cumsum(many)
    at = np.repeat(np.arange(len(pos)) + h - many - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)
    flat = values[at]
    inner = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype="i4") * values.shape[1]), pa.array(flat.ravel()))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype("i4")), inner)


def _scan(keys: list[str], kept: list[str], sums: list[str], lag: bool, recent: dict[str, int], rows_before: tuple[str, int] | None):
    def scan(batches):
        runs, pid, schema = Runs(keys), TaskContext.get().partitionId(), None
        n, totals, lags, tails, seen = 0, {}, None, {k: np.empty(0) for k in recent}, None
        for b in batches:
            if not b.num_rows:
                continue
            column = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
            new, head = runs.of(b)
            at = np.arange(b.num_rows)
            start = np.maximum.accumulate(np.where(new, at, -1))
            pos = np.where(start < 0, at + 1 + n, at - start + 1)
            out = {c: column(c) for c in kept}
            out |= {"_pid": pa.array(np.full(b.num_rows, pid, "i4")), "_head": pa.array(head), "_lpos": pa.array(pos)}
            segment = np.cumsum(new)
            for s in sums:
                v = column(f"_s_{s}").to_numpy(zero_copy_only=False).copy()
                if not new[0]:
                    v[0] += totals[s]
                run = pd.Series(v).groupby(segment, sort=False).cumsum().to_numpy()
                totals[s] = run[-1].item()
                out[f"_t_{s}"] = pa.array(run)
            if lag:
                v = column("_lagsrc")
                lags = pa.nulls(2, v.type) if lags is None else lags
                every = pa.concat_arrays([lags, v])
                none = pa.scalar(None, v.type)
                out["_l1"] = pc.if_else(pa.array(pos >= 2), every.slice(1, b.num_rows), none)
                out["_l2"] = pc.if_else(pa.array(pos >= 3), every.slice(0, b.num_rows), none)
                lags = every.slice(b.num_rows, 2)
            for r, h in recent.items():
                every = np.r_[np.zeros(h - len(tails[r])), tails[r], column(f"_r_{r}").to_numpy(zero_copy_only=False)]
                total = np.r_[0.0, np.cumsum(every)]
                many = np.minimum(pos - 1, h)
                out[f"_w_{r}"] = pa.array(total[at + h] - total[at + h - many])
                keep = min(int(pos[-1]), h)
                tails[r] = every[len(every) - keep:]
            if rows_before:
                name, h = rows_before
                v = column("_row")
                wide = v.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                seen = np.zeros((h, wide.shape[1])) if seen is None else seen
                every = np.r_[seen, wide]
                out[f"_b_{name}"] = _earlier(every, pos, h)
                seen = every[-h:]
            n = int(pos[-1])
            made = pa.RecordBatch.from_pydict(out | {"_carry": pa.nulls(b.num_rows, pa.string())})
            schema = made.schema
            yield made
        if schema is not None:
            yield carry_batch(schema, _pid=pid, _carry=text({
                "one": runs.begun == 1, "first": runs.first, "last": runs.last, "n": n, "sums": [totals[s] for s in sums],
                "lags": lags.to_pylist()[::-1][:min(n, 2)] if lag else [], "recent": {r: t.tolist() for r, t in tails.items()},
                "rows": seen[-min(n, rows_before[1]):].tolist() if rows_before else []}))
    return scan


def _incoming(carries: list[tuple[int, dict]], recent: dict[str, int], width: int = 0) -> list[tuple[int, dict]]:
    """What each partition's first key brings along from earlier partitions."""
    out, state = [], None
    for pid, c in carries:
        before = state if state is not None and state["last"] == c["first"] else None
        if before:
            out.append((pid, before))
        state = c
        if before and c["one"]:
            state = c | {"n": before["n"] + c["n"], "sums": [a + b for a, b in zip(before["sums"], c["sums"])],
                         "lags": (c["lags"] + before["lags"])[:2],
                         "recent": {r: (before["recent"][r] + c["recent"][r])[-h:] for r, h in recent.items()},
                         "rows": (before["rows"] + c["rows"])[-width:] if width else []}
    return out


def prefix_scan(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column] | None = None,
                position: str | None = "_pos", lag_of: Column | None = None, lag_names: tuple[str, str] = ("_lag1", "_lag2"),
                recent: dict[str, tuple[Column, int]] | None = None,
                rows_before: tuple[str, list[Column], int] | None = None) -> DataFrame:
    """df with, per key in the given order, the position, inclusive running sums, lags 1 and 2, and recent sums.

    sums: nulls add nothing; integers add up as long, all else as double.
    recent: name -> (column, h), the sum over the h rows before (fewer at the
    beginning, 0 without any).
    rows_before: (name, columns, h), the columns as doubles (null is 0.0) of the h
    rows before, oldest first, as an array of arrays; only the last h rows of a
    key go on to the next partition.  Rows of a null key are one key; no keys: all
    rows are one.  Rows that tie in order keep an order of their own, the same in all results.
    """
    sums, recent = sums or {}, recent or {}
    back = None if rows_before is None else (rows_before[0], rows_before[2])
    width = {r: h for r, (_, h) in recent.items()}
    work = df.withColumns({f"_s_{s}": c for s, c in sums.items()} | {f"_r_{r}": F.coalesce(c.cast("double"), F.lit(0.0)) for r, (c, _) in recent.items()}
                          | ({} if lag_of is None else {"_lagsrc": lag_of})
                          | ({} if back is None else {"_row": F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in rows_before[1]])}))
    kind = {s: "long" if isinstance(work.schema[f"_s_{s}"].dataType, _INTEGERS) else "double" for s in sums}
    work = work.withColumns({f"_s_{s}": F.coalesce(F.col(f"_s_{s}").cast(k), F.lit(0).cast(k)) for s, k in kind.items()}) if sums else work
    fields = [T.StructField(f.name, f.dataType) for f in df.schema.fields]
    fields += [T.StructField("_pid", T.IntegerType()), T.StructField("_head", T.BooleanType()), T.StructField("_lpos", T.LongType())]
    fields += [T.StructField(f"_t_{s}", T.LongType() if k == "long" else T.DoubleType()) for s, k in kind.items()]
    fields += [] if lag_of is None else [T.StructField(c, work.schema["_lagsrc"].dataType) for c in ("_l1", "_l2")]
    matrix = T.ArrayType(T.ArrayType(T.DoubleType()))
    fields += [T.StructField(f"_w_{r}", T.DoubleType()) for r in recent] + ([] if back is None else [T.StructField(f"_b_{back[0]}", matrix)])
    fields += [T.StructField("_carry", T.StringType())]
    scan = _scan(keys, df.columns, list(sums), lag_of is not None, width, back)
    rows = store(spread(work, keys, order).mapInArrow(scan, T.StructType(fields)), "scan")

    carries = sorted((r["_pid"], json.loads(r["_carry"])) for r in rows.filter("_carry IS NOT NULL").select("_pid", "_carry").collect())
    came = _incoming(carries, width, 0 if back is None else back[1])   # at most one row for each partition
    rows = rows.filter("_carry IS NULL").drop("_carry")
    made = {} if position is None else {position: F.col("_lpos")}
    made |= {s: F.col(f"_t_{s}") for s in sums} | ({} if lag_of is None else {lag_names[0]: F.col("_l1"), lag_names[1]: F.col("_l2")})
    made |= {r: F.col(f"_w_{r}") for r in recent} | ({} if back is None else {back[0]: F.col(f"_b_{back[0]}")})
    if came:
        shape = [T.StructField("_pid", T.IntegerType()), T.StructField("_cn", T.LongType())]
        shape += [T.StructField(f"_c_{s}", T.LongType() if k == "long" else T.DoubleType()) for s, k in kind.items()]
        shape += [] if lag_of is None else [T.StructField(c, work.schema["_lagsrc"].dataType) for c in ("_c1", "_c2")]
        shape += [T.StructField(f"_cr_{r}", T.ArrayType(T.DoubleType())) for r in recent] + ([] if back is None else [T.StructField("_cb", matrix)])
        table = []
        for pid, c in came:
            row = [pid, c["n"], *(float(v) if kind[s] == "double" else v for s, v in zip(sums, c["sums"]))]
            row += [] if lag_of is None else (c["lags"] + [None, None])[:2]
            row += [np.r_[0.0, np.cumsum(c["recent"][r][::-1])].tolist() for r in recent]  # sums of the last 0, 1, ... rows
            row += [] if back is None else [c["rows"]]
            table.append(tuple(row))
        rows = rows.join(F.broadcast(df.sparkSession.createDataFrame(table, T.StructType(shape))), "_pid", "left")
        here = F.col("_head") & F.col("_cn").isNotNull()
        if position is not None:
            made[position] = F.col("_lpos") + F.when(here, F.col("_cn")).otherwise(F.lit(0))
        for s in sums:
            made[s] = F.col(f"_t_{s}") + F.when(here, F.col(f"_c_{s}")).otherwise(F.lit(0).cast(kind[s]))
        if lag_of is not None:
            made[lag_names[0]] = F.when(here & (F.col("_lpos") == 1), F.col("_c1")).otherwise(F.col("_l1"))
            made[lag_names[1]] = F.when(here & (F.col("_lpos") == 1), F.col("_c2")).when(here & (F.col("_lpos") == 2), F.col("_c1")).otherwise(F.col("_l2"))
        for r, h in width.items():
            room = F.least(F.lit(h) + 1 - F.col("_lpos"), F.size(f"_cr_{r}") - 1).cast("int")
            made[r] = F.col(f"_w_{r}") + F.when(here & (F.col("_lpos") <= h), F.get(f"_cr_{r}", room)).otherwise(F.lit(0.0))
        if back is not None:
            name, h = back
            room = F.least(F.lit(h) + 1 - F.col("_lpos"), F.size("_cb")).cast("int")
            made[name] = F.when(here & (F.col("_lpos") <= h), F.concat(F.slice("_cb", F.size("_cb") - room + 1, room), F.col(f"_b_{name}"))).otherwise(F.col(f"_b_{name}"))
    return rows.withColumns(made).select(*df.columns, *made)
