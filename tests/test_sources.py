"""File sources, model persistence fallback, validation and canonical projection."""
from pyspark.sql import functions as F

from riskflow.operators import validate as V
from riskflow.sources import files as FS


def test_ledger_csv_and_snapshot(spark, scratch):
    p = f"{scratch}/ledger.csv"
    with open(p, "w") as fh:
        fh.write("step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,newbalanceDest,isFraud\n")
        fh.write("1,PAYMENT,181.0,C1305486145,181.0,0.0,M1979787155,0.0,0.0,0\n")
        fh.write("2,TRANSFER,,C2,10.0,0.0,M2,0.0,0.0,1\n")
        fh.write("3,TRANSFER,-4,C3,10.0,0.0,,0.0,0.0,1\n")
    df = FS.read_ledger_csv(spark, p)
    assert df.columns == ["card_id", "amount", "merchant_id", "is_fraud", "step"]
    valid, dead = V.split_valid(df)
    assert valid.count() == 1
    errs = sorted(r.error for r in dead.collect())
    assert errs == ["Missing fields: amount", "Missing fields: merchant_id"]
    snap = FS.read_snapshot(spark, p)
    assert snap.count() == 3
    df.write.parquet(f"{scratch}/s.parquet")
    assert FS.read_snapshot(spark, f"{scratch}/s.parquet").count() == 3


def test_canonical_and_request_defaults(spark):
    df = spark.createDataFrame([("C1", 5.0, "M1", None), ("C2", 0.0, "M2", 1)],
                               "card_id string, amount double, merchant_id string, is_fraud int")
    c = V.canonical_event(df, arrival_ms=F.lit(7), txn_id=F.lit("t")).collect()
    assert [r.is_fraud for r in c] == [False, True] and c[0].currency == "USD" and c[0].channel == "WEB"
    req = spark.createDataFrame([(10.0, None), (0.0, "C9")], "amount double, nameOrig string")
    out = V.request_constraints(req).collect()
    assert len(out) == 1 and out[0].nameOrig == "C_UNKNOWN"
    assert V.shared_columns(df, req, ["amount", "card_id", "zzz"]) == ["amount"]


def test_model_missing_is_heuristic_mode(spark, scratch):
    assert FS.load_model(f"{scratch}/nothing") is None
