"""Blocked (skew-safe) operators against plain single-partition formulations."""
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskflow.operators.feedback import feedback_fold
from riskflow.operators.ordered import prefix_scan


def _frame(spark, n=3000, keys=3, seed=7):
    rnd = random.Random(seed)
    rows = [(i, f"K{rnd.randrange(keys) if rnd.random() > 0.5 else 0}", rnd.randrange(0, 500), rnd.random() * 100)
            for i in range(n)]  # key K0 is hot
    return spark.createDataFrame(rows, "row_id long, k string, step int, v double")


def test_scan_matches_plain_window(spark):
    df = _frame(spark)
    got = prefix_scan(df, ["k"], [F.col("step"), F.col("row_id")], sums={"s": F.col("v")}, position="pos", lag_of=F.col("step"))
    w = Window.partitionBy("k").orderBy("step", "row_id")
    exp = df.select("row_id", F.row_number().over(w).alias("pos_e"),
                    F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s_e"),
                    F.lag("step", 1).over(w).alias("l1"), F.lag("step", 2).over(w).alias("l2"))
    j = got.join(exp, "row_id").collect()
    assert len(j) == 3000
    for r in j:
        assert r.pos == r.pos_e
        assert abs(r.s - r.s_e) < 1e-6
        assert r._lag1 == r.l1 and r._lag2 == r.l2


def partitioned(spark, n, run):
    """run() with n shuffle partitions and small batches."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        return run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_scan_carries_over_partitions(spark):
    """Null and hot keys over many partitions, null lags and sums, recent sums longer than a partition, no key at all."""
    rnd = random.Random(11)
    rows = [(i, None if i % 9 == 0 else "hot" if i % 3 else f"k{i % 40}", rnd.choice([None, *range(200)]), None if i % 17 == 0 else rnd.random() * 1e6)
            for i in range(900)]
    df = spark.createDataFrame(rows, "row_id long, k string, step int, v double")
    for keys in (["k"], []):
        def run(keys=keys):
            got = prefix_scan(df, keys, [F.col("step"), F.col("row_id")], sums={"s": F.col("v"), "n": F.lit(1)}, lag_of=F.col("step"),
                              recent={"r": (F.col("v"), 100), "q": (F.col("v"), 3)}, rows_before=("b", [F.col("v"), F.col("row_id")], 5))
            return got.collect(), got.columns
        for n in (1, 7, 40):
            got, names = partitioned(spark, n, run)
            assert names == ["row_id", "k", "step", "v", "_pos", "s", "n", "_lag1", "_lag2", "r", "q", "b"]
            by = {}
            for r in sorted(rows, key=lambda r: ("" if not keys else str(r[1]), r[2] is not None, r[2] or 0, r[0])):
                by.setdefault(r[1] if keys else 0, []).append(r)
            seen = {r["row_id"]: r for r in got}
            assert len(got) == len(seen) == len(rows)
            for of in by.values():
                v = [r[3] or 0.0 for r in of]
                for i, r in enumerate(of):
                    g = seen[r[0]]
                    assert (g._pos, g.n, g._lag1, g._lag2) == (i + 1, i + 1, of[i - 1][2] if i else None, of[i - 2][2] if i > 1 else None)
                    assert g.b == [[v[j], float(of[j][0])] for j in range(max(0, i - 5), i)]
                    for a, b in ((g.s, sum(v[:i + 1])), (g.r, sum(v[max(0, i - 100):i])), (g.q, sum(v[max(0, i - 3):i]))):
                        assert abs(a - b) < 1e-6 * max(1, abs(b))


def test_scan_shuffles_once(spark):
    """One range exchange and one scan of the input; user features take two."""
    from riskflow.operators import ordered
    from riskflow.operators.features import user_features
    plans = []
    keep = ordered.store
    ordered.store = lambda d, name: (plans.append(d._jdf.queryExecution().executedPlan().toString()), keep(d, name))[1]
    try:
        df = spark.createDataFrame([(i, i % 5, f"u{i % 3}", f"m{i % 4}", 1.0, 2.0) for i in range(50)],
                                   "row_id long, step int, nameOrig string, nameDest string, amount double, oldbalanceOrg double")
        user_features(df).collect()
    finally:
        ordered.store = keep
    assert len(plans) == 2
    for p in plans:
        assert p.count("Exchange rangepartitioning") == 1 and p.count("Exchange") == 1 + p.count("BroadcastExchange") and "Window" not in p


def _brute_fold(rows, history=100, cutoff=0.2):
    out, by = {}, {}
    for rid, k, step, hr, hs in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        h = by.setdefault(k, [])
        risk = sum(h) / len(h) if h else 0.0
        f = int(hr) if risk > cutoff else int(hs)
        out[rid] = (risk, f)
        h.append(f)
        if len(h) > history:
            h.pop(0)
    return out


def test_feedback_fold_over_partitions(spark):
    rnd = random.Random(3)
    rows = [(i, "M0" if i % 3 else f"M{i % 5}", rnd.randrange(0, 2000), rnd.random() < 0.7, rnd.random() < 0.15)
            for i in range(2500)]
    df = spark.createDataFrame(rows, "row_id long, m string, step int, hr boolean, hs boolean")
    exp = _brute_fold(rows)
    got = feedback_fold(df, "m", "hr", "hs").collect()   # M0 fills several partitions
    assert len(got) == 2500
    for r in got:
        risk, f = exp[r.row_id]
        assert r.judged_high == f
        assert abs(r.merchant_risk_online - risk) < 1e-12


def test_feedback_null_merchant_and_small_blocks(spark):
    """A null merchant is folded and repaired like any other, whatever the block size."""
    rows = [(m, i, i, i < 60 or i % 3 > 0, i < 60) for m in ("A", None) for i in range(700)]
    df = spark.createDataFrame(rows, "m string, step long, row_id long, risky boolean, safe boolean")
    got = []
    for n in (1, 5, 23):
        out = partitioned(spark, n, lambda: feedback_fold(df, "m", "risky", "safe").collect())
        got.append({(r["m"], r["row_id"]): (r["merchant_risk_online"], r["judged_high"]) for r in out})
    assert len(got[0]) == 1400 and got[0] == got[1] == got[2]
    assert all(got[0]["A", i] == got[0][None, i] for i in range(700))


def test_scan_sum_over_nulls(spark):
    df = spark.createDataFrame([("k", 0, None), ("k", 1, 5.0), ("k", 2, None), ("k", 3, 7.0)], "k string, step long, v double")
    out = prefix_scan(df, ["k"], [F.col("step")], sums={"s": F.col("v")}, position=None)
    assert [r["s"] for r in out.orderBy("step").collect()] == [0.0, 5.0, 5.0, 12.0]


def test_feedback_of_rows_that_never_close(spark):
    """Every row follows its history, so a partition is the identity on some states: starts travel from end to end."""
    rnd = random.Random(8)
    rows = [(i, "hot" if i < 1500 else f"M{i % 7}", i, True, i < 40 or 700 < i < 720) for i in range(1900)]
    rows += [(5000 + i, "odd", i, rnd.random() < 0.5, rnd.random() < 0.5) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, m string, step int, hr boolean, hs boolean")
    exp = _brute_fold(rows)
    for n in (1, 9, 50):
        got = partitioned(spark, n, lambda: feedback_fold(df, "m", "hr", "hs").collect())
        assert len(got) == len(rows)
        assert all(r.judged_high == exp[r.row_id][1] and abs(r.merchant_risk_online - exp[r.row_id][0]) < 1e-12 for r in got)
