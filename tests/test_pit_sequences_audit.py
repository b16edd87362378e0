"""As-of join TTL edges, sequence padding, audit append semantics, registry promotion."""
import datetime as dt

from pyspark.sql import functions as F

from riskflow.operators import audit as AU
from riskflow.operators import registry as RG
from riskflow.operators.pit import asof_join
from riskflow.operators.sequences import build_sequences


def test_asof_ttl_edges(spark):
    t0 = dt.datetime(2024, 1, 31, 12, 0, 0)
    feats = spark.createDataFrame([("c1", t0 - dt.timedelta(days=30), 1.0),
                                   ("c2", t0 - dt.timedelta(days=30, microseconds=1), 2.0),
                                   ("c3", t0, 3.0), ("c3", t0 + dt.timedelta(seconds=1), 4.0)],
                                  "k string, fts timestamp, f double")
    ev = spark.createDataFrame([("e1", "c1", t0), ("e2", "c2", t0), ("e3", "c3", t0), ("e4", "c4", t0)],
                               "id string, k string, ts timestamp")
    got = {r.id: r.f for r in asof_join(ev, feats, "k", "ts", "fts", ["f"]).collect()}
    assert got == {"e1": 1.0, "e2": None, "e3": 3.0, "e4": None}


def test_asof_ties_null_keys_and_created(spark):
    t0 = dt.datetime(2024, 1, 31, 12, 0, 0)
    day = dt.timedelta(days=1)
    rows = [("a", t0, t0 + 2 * day, 1.0), ("a", t0, t0 + day, 9.0), ("b", t0, None, 5.0), ("b", t0, None, 6.0), (None, t0, t0, 7.0),
            ("a", t0 - day, t0 + 5 * day, 8.0), ("c", None, t0, 3.0)]
    feats = spark.createDataFrame(rows, "k string, fts timestamp, made timestamp, f double")
    ev = spark.createDataFrame([("e1", "a", t0), ("e2", "b", t0 + day), ("e3", None, t0), ("e4", "c", t0), ("e5", "a", None), ("e6", "a", t0 - day)],
                               "id string, k string, ts timestamp")
    got = {r.id: r.f for r in asof_join(ev, feats, "k", "ts", "fts", ["f"], created="made").collect()}
    assert got == {"e1": 1.0, "e2": 6.0, "e3": None, "e4": None, "e5": None, "e6": 8.0}
    got = {r.id: r.f for r in asof_join(ev, feats, "k", "ts", "fts", ["f"]).collect()}
    assert got["e1"] == 9.0


def test_sequences_padding(spark):
    rows = [(i, "A" if i < 12 else ("B" if i < 14 else "C"), i, float(i), 0) for i in range(17)]
    df = spark.createDataFrame(rows, "row_id long, nameDest string, step int, amount double, isFraud int")
    s = {r.row_id: r for r in build_sequences(df, ["amount"]).collect()}
    assert 12 not in s and 13 not in s              # key B has only 2 rows
    assert s[0].seq_len == 0 and s[0].mask == [0.0] * 10
    assert s[11].seq_len == 10 and [v[0] for v in s[11].seq] == [float(i) for i in range(1, 11)]
    assert s[3].mask == [0.0] * 7 + [1.0] * 3 and [v[0] for v in s[3].seq][-3:] == [0.0, 1.0, 2.0]
    assert s[16].seq_len == 2


def test_append_first_write_wins_and_alert_lookup(spark):
    t = dt.datetime(2024, 1, 1)
    rec = spark.createDataFrame([
        ("A", t, 1.0, "High", 0.9, '{"nameOrig": "C1", "nameDest": "M1"}'),
        ("A", t + dt.timedelta(seconds=5), 2.0, "Low", 0.1, "{}"),
        ("B", t, 3.0, "High", 0.7, "{}"),
    ], "transaction_id string, timestamp timestamp, amount double, risk_level string, final_risk_score double, "
       "metadata string").withColumns({"reasons": F.array(F.lit("r")), "action": F.lit("x"),
                                       "indicators": F.array(F.lit("i"))})
    existing = spark.createDataFrame([("B",)], "transaction_id string")
    new = AU.append_records(rec, existing).collect()
    assert [(r.transaction_id, r.amount) for r in new] == [("A", 1.0)]
    alerts = AU.alerts_of(rec.filter("amount <> 2.0"))
    orphan = alerts.unionByName(spark.createDataFrame([("Z", t, 9.0, "High")],
                                                      "transaction_id string, timestamp timestamp, amount double, "
                                                      "risk_level string").withColumn("reasons", F.array()))
    j1 = {r.transaction_id for r in AU.fetch_alerts(orphan, rec.filter("amount <> 2.0")).collect()}
    j2 = {r.transaction_id: r for r in AU.fetch_alerts_lookup(orphan, rec.filter("amount <> 2.0")).collect()}
    assert j1 == {"A", "B"}
    assert j2["Z"].action == "UNKNOWN" and j2["Z"].fraud_probability == 0.0 and j2["Z"].nameOrig == "UNKNOWN"
    assert j2["A"].nameOrig == "C1" and j2["B"].nameDest == "UNKNOWN"


def test_registry_promotion(spark):
    runs = spark.createDataFrame([("r1", "pr_auc", 0.5), ("r2", "pr_auc", 0.7), ("r3", "pr_auc", 0.7)],
                                 "run_id string, metric string, value double")
    empty = spark.createDataFrame([], "name string, version int, run_id string, stage string")
    v1 = RG.promote(empty, runs, "m").collect()
    assert [(r.version, r.run_id, r.stage) for r in v1] == [(1, "r2", "Production")]
    prod = spark.createDataFrame([("m", 1, "r1", "Production")], "name string, version int, run_id string, stage string")
    v2 = sorted((r.version, r.stage) for r in RG.promote(prod, runs, "m").collect())
    assert v2 == [(1, "Archived"), (2, "Production")]
    better = spark.createDataFrame([("m", 1, "r2", "Production")], "name string, version int, run_id string, stage string")
    v3 = sorted((r.version, r.stage) for r in RG.promote(better, runs, "m").collect())
    assert v3 == [(1, "Production"), (2, "Staging")]           # equal metric does not win


def test_records_with_one_short_id_are_told_apart_by_their_key(spark):
    cols = "record_key string, transaction_id string, timestamp timestamp, amount double, risk_level string, final_risk_score double, " \
           "action string, reasons array<string>, indicators array<string>, metadata string"
    t = dt.datetime(2024, 1, 1)
    rows = [(k, "A", t, x, "High", x / 10, "BLOCK", [], [], "{}") for k, x in (("A1", 1.0), ("A2", 2.0), ("A2", 2.0))]
    new = AU.append_records(spark.createDataFrame(rows, cols), spark.createDataFrame([("A3",)], "record_key string"))
    assert sorted(r.record_key for r in new.collect()) == ["A1", "A2"]
    shown = AU.fetch_alerts(AU.alerts_of(new), new, 100).collect()
    assert sorted((r.amount, r.fraud_probability) for r in shown) == [(1.0, 0.1), (2.0, 0.2)]
    looked_up = AU.fetch_alerts_lookup(AU.alerts_of(new), new, 100).collect()
    assert sorted((r.amount, r.fraud_probability) for r in looked_up) == [(1.0, 0.1), (2.0, 0.2)]
