"""Free-text payment message -> ledger transaction.

Everything is a ``regexp_extract`` / ``contains`` expression on the lower-cased
text, so the parser runs inside whole-stage codegen, batch or stream.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and keyword lists that define the parser's behaviour.
AMOUNT_RE = r"(?:₹|rs\.?|usd|\$)?\s*([\d,]+(?:\.\d+)?)\s*(k|lakh|million)?"
SENDER_RE = r"(?:from|sender|orig(?:in)?)\s+([cm][a-z0-9]+)"
RECEIVER_RE = r"(?:to|receiver|dest(?:ination)?|merchant)\s+([cm][a-z0-9]+)"
ACCOUNT_ID_RE = r"([cm][0-9]{5,})"
BALANCE_RE = r"(?:bal(?:ance)?|amt)\s+(?:of|is)?\s*([\d,]+(?:\.\d+)?)"
SUFFIX_MULTIPLIER = {"k": 1e3, "lakh": 1e5, "million": 1e6}
TYPE_KEYWORDS = [
    ("PAYMENT", ["payment", "paid"]),
    ("CASH_OUT", ["cash out", "withdraw"]),
    ("CASH_IN", ["cash in", "deposit"]),
    ("DEBIT", ["debit"]),
]
DEFAULT_TYPE = "TRANSFER"
INTENT_KEYWORDS = [
    ("urgency", ["urgent", "quickly", "asap", "emergency"]),
    ("depletion", ["all", "entire", "empty", "depletion"]),
    ("frequency", ["multiple", "repeated", "several"]),
]
UNKNOWN_SENDER = "C_UNKNOWN"
UNKNOWN_RECEIVER = "M_UNKNOWN"


def _number(text: Column) -> Column:
    """Digits with commas -> double; unparsable (e.g. a lone comma) -> null."""
    return F.regexp_replace(text, ",", "").try_cast("double")


def _any_contains(text: Column, words: list[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | text.contains(w)
    return cond


def parse_amount(text: Column) -> Column:
    """F1/F2: first number (commas removed) times its suffix; 0.0 if none or unparsable.

    The unanchored search runs once (``regexp_substr``); the number and the
    suffix are then read from that short match.  The optional currency prefix
    holds no digits or commas, so the number in the match is the pattern's
    first group, and a suffix can only sit at the end of the match.
    """
    whole = F.regexp_substr(text, F.lit(AMOUNT_RE))
    value = _number(F.regexp_extract(whole, r"[\d,]+(?:\.\d+)?", 0))
    suffix = F.regexp_extract(whole, r"(k|lakh|million)$", 1)
    mults = F.create_map(*[x for k, v in SUFFIX_MULTIPLIER.items() for x in (F.lit(k), F.lit(v))])
    mult = F.coalesce(F.try_element_at(mults, suffix), F.lit(1.0))
    return F.coalesce(value * mult, F.lit(0.0))


def _first_group(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def parse_sender(text: Column) -> Column:
    """explicit 'from …' id, else the first account-like id, else C_UNKNOWN."""
    ids = F.regexp_extract_all(text, F.lit(ACCOUNT_ID_RE), 1)
    return F.upper(F.coalesce(_first_group(text, SENDER_RE), F.try_element_at(ids, F.lit(1)),
                              F.lit(UNKNOWN_SENDER)))


def parse_receiver(text: Column) -> Column:
    """explicit 'to …' id, else the second account-like id, else M_UNKNOWN."""
    ids = F.regexp_extract_all(text, F.lit(ACCOUNT_ID_RE), 1)
    return F.upper(F.coalesce(_first_group(text, RECEIVER_RE), F.try_element_at(ids, F.lit(2)),
                              F.lit(UNKNOWN_RECEIVER)))


def parse_type(text: Column) -> Column:
    """first keyword group that occurs wins."""
    out = F.lit(DEFAULT_TYPE)
    for ttype, words in reversed(TYPE_KEYWORDS):
        out = F.when(_any_contains(text, words), F.lit(ttype)).otherwise(out)
    return out


def parse_balance(text: Column) -> Column:
    """number after bal/balance/amt (optional of/is); 0.0 otherwise."""
    return F.coalesce(_number(F.regexp_extract(text, BALANCE_RE, 1)), F.lit(0.0))


def parse_intents(text: Column) -> Column:
    """behavioural intents by substring, fixed order."""
    return F.array_compact(F.array(*[
        F.when(_any_contains(text, words), F.lit(name)) for name, words in INTENT_KEYWORDS]))


def parse_message(message: Column) -> list[Column]:
    """The whole parser as a list of named columns."""
    text = F.lower(message)
    amount = parse_amount(text)
    balance = parse_balance(text)
    return [
        F.lit(1).alias("step"),
        amount.alias("amount"),
        parse_type(text).alias("type"),
        balance.alias("oldbalanceOrg"),
        F.greatest(F.lit(0.0), balance - amount).alias("newbalanceOrig"),
        F.lit(0.0).alias("oldbalanceDest"),
        amount.alias("newbalanceDest"),
        parse_sender(text).alias("nameOrig"),
        parse_receiver(text).alias("nameDest"),
        parse_intents(text).alias("behavioral_intents"),
    ]
