"""Parser edge cases and the scenario messages scored in order (golden test)."""
from pyspark.sql import functions as F

from riskflow.functions import parse as P
from riskflow.operators.scoring import score_transactions

SCENARIOS = [
    "URGENT: Emptying my account balance. Transferring 950,000 from C1234 to merchant M999 immediately. "
    "Remaining balance 0.",
    "Sending 50,000 to C888 from C456. This is my 5th similar transfer today.",
    "Transferring 10,000 to M999999 from C456.",
    "Paid 50 to merchant M123 for coffee.",
    "Transfer 1000 from C_BURST_TEST to M1",
    "Transfer 1000 from C_BURST_TEST to M2",
    "Transfer 1000 from C_BURST_TEST to M3",
    "Transfer 1000 from C_BURST_TEST to M4",
]


def parsed(spark, msgs):
    df = spark.createDataFrame([(i, m) for i, m in enumerate(msgs)], "row_id long, message string")
    return df.select("row_id", *P.parse_message(F.col("message"))).orderBy("row_id")


def test_parser_fields(spark):
    rows = parsed(spark, SCENARIOS).collect()
    r0 = rows[0]
    assert r0.amount == 950000.0 and r0.nameOrig == "C1234" and r0.nameDest == "MERCHANT"
    assert r0.type == "TRANSFER" and r0.oldbalanceOrg == 0.0
    assert r0.behavioral_intents == ["urgency", "depletion"]
    assert (rows[1].nameOrig, rows[1].nameDest, rows[1].amount) == ("C456", "C888", 50000.0)
    assert (rows[3].nameOrig, rows[3].nameDest, rows[3].type) == ("C_UNKNOWN", "MERCHANT", "PAYMENT")
    assert rows[4].nameOrig == "C_UNKNOWN" and rows[4].nameDest == "M1"


def test_parser_quirks(spark):
    rows = parsed(spark, [
        "sent , 500 to m12345",            # lone comma first: amount unparsable -> 0
        "pay 2.5k to c1234567 from c7654321",
        "withdraw 3 lakh",
        "a small deposit of 1,200.75 balance of 5,000",
        "transfer 1 million from x to y",
        "no numbers here",
    ]).collect()
    assert rows[0].amount == 0.0
    assert rows[1].amount == 2500.0 and rows[1].nameOrig == "C7654321" and rows[1].nameDest == "C1234567"
    assert rows[2].amount == 300000.0 and rows[2].type == "CASH_OUT"
    assert rows[3].amount == 1200.75 and rows[3].oldbalanceOrg == 5000.0 and rows[3].type == "CASH_IN"
    assert "depletion" in rows[3].behavioral_intents          # "small" contains "all"
    assert rows[3].newbalanceOrig == 5000.0 - 1200.75
    assert rows[4].amount == 1e6 and rows[4].nameOrig == "C_UNKNOWN"
    assert rows[5].amount == 0.0 and rows[5].nameDest == "M_UNKNOWN"


def test_scenarios_in_order(spark):
    d = parsed(spark, SCENARIOS)
    s = score_transactions(d, intents="behavioral_intents").orderBy("row_id").collect()
    levels = [r.risk_level for r in s]
    assert levels == ["High", "Low", "Low", "Medium", "Low", "Medium", "Medium", "High"]
    assert [r.burst for r in s][4:] == [1, 2, 3, 4]
    assert s[3].merchant_risk == 1.0
    assert s[0].final_risk_score == 1.0
    assert "Burst transaction pattern" in s[7].indicators
    assert s[0].reasons == ["Suspicious intent markers", "Multiple risk triggers"]
