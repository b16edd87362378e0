"""Quality rules with host-level verdicts (operator 7, DataFrame functions only).

Every document gets text measures and a set of rule failures.  Failures are
aggregated by host, each host's failure rate is shrunk towards an empirical
beta prior fitted on all hosts by moments, and the host verdict is joined back:
on a bad host a document must also pass the soft rules.

Defined cases: a null or blank text has no words and fails the base rule; a
null host is a host of its own; repeated rows are judged each on their own and
all count for their host; an empty table gives an empty result; columns of the
input that clash with the output are replaced.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import settle, words

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SPAN = 8
SYMBOLS = "#*$%&|<>"
#: a host is bad when its shrunk failure rate is above this
HOST_RATE = 0.5
#: hosts whose verdicts are broadcast; above it the verdicts are joined by salted shuffle
BROADCAST_HOSTS = 100_000
SALTS = 32
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus the five measures, in one pass without a shuffle.

    Windows are hashed by zipping shifted arrays and repeats are found by
    sorting the hashes inside the row, so the cost is n log n in a text.
    """
    d = docs.drop(*MEASURES).withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumn("_w", words(F.col("_t")))
    d = d.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    n = F.size("_h")
    shifted = [F.slice("_h", j + 1, F.greatest(n - (SPAN - 1), F.lit(0))) for j in range(SPAN)]
    d = d.withColumn("_g", F.transform(F.arrays_zip(*shifted), lambda z: F.xxhash64(z)))
    # only texts with an equal pair of windows are sorted
    pairs = F.when(F.size(F.array_distinct("_g")) < F.size("_g"),
                   F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("_s", pairs)
    twin = F.zip_with("_s", F.slice("_s", 2, F.size("_s")),
                      lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    d = d.withColumn("_p", F.sort_array(F.array_distinct(F.flatten(F.filter(twin, lambda x: x.isNotNull())))))
    steps = F.zip_with("_p", F.slice("_p", 2, F.size("_p")),
                       lambda a, b: F.when(b.isNull(), F.lit(SPAN)).otherwise(F.least(b - a, F.lit(SPAN))))
    covered = F.aggregate(steps, F.lit(0), lambda s, x: s + x)
    d = d.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(_without(F.col("_t"), " \t\n\x0b\x0c\r")).cast("long"),
        "n_symbols": (F.length("_t") - F.length(_without(F.col("_t"), SYMBOLS))).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": F.when(F.col("_s").isNull(), F.lit(0)).otherwise(covered).cast("long"),
    })
    return d.drop("_t", "_w", "_h", "_g", "_s", "_p", "_l")


def rules() -> dict[str, Column]:
    """Rule name -> failed.  ``base`` alone rejects; the others weigh on bad hosts."""
    n = F.col("n_words")
    return {
        "base": (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n),
        "symbols": 10 * F.col("n_symbols") > n,
        "dup_lines": F.col("n_dup_lines") >= 3,
        "word_length": (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 10 * n),
    }


def host_verdicts(judged: DataFrame, host: str) -> DataFrame:
    """One row per host: _host, n, rate (shrunk), host_bad.

    A beta prior is fitted per rule by the moments of the hosts' rates; the
    rate of a host is the largest of its shrunk rule rates.
    """
    names = list(rules())
    per = judged.groupBy(F.col(host).alias("_host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"_{r}").cast("long")).alias(f"f_{r}") for r in names])
    prior = per.agg(*[x for r in names for x in (
        F.avg(F.col(f"f_{r}") / F.col("n")).alias(f"m_{r}"),
        F.var_pop(F.col(f"f_{r}") / F.col("n")).alias(f"v_{r}"))]).first()
    rates = []
    for r in names:
        m, v = prior[f"m_{r}"] or 0.0, prior[f"v_{r}"] or 0.0
        # strength a + b of the prior, between 2 and 1000 pseudo documents
        k = min(1000.0, max(2.0, m * (1 - m) / v - 1)) if v > 0 else 1000.0
        rates.append((F.col(f"f_{r}") + F.lit(m * k)) / (F.col("n") + F.lit(k)))
    return per.select("_host", "n", F.greatest(*rates).alias("rate")) \
        .withColumn("host_bad", F.col("rate") > HOST_RATE)


def judge(docs: DataFrame, keep: list[str], host: str = "source", text: str = "text") -> DataFrame:
    """keep columns, measures, base_failed, host_rate and kept of every document.

    The measured rows are written once; hosts are then few rows per task
    (map-side sums), and a host with a third of the rows is split again at the
    join by salt.
    """
    extra = [c for c in dict.fromkeys([*keep, host]) if c in docs.columns and c not in MEASURES]
    d = measures(docs.select(*dict.fromkeys([*extra, text])), text)
    d = d.withColumns({f"_{r}": cond for r, cond in rules().items()})
    d = settle(d.select(*extra, *MEASURES, *[f"_{r}" for r in rules()]), "quality")
    hosts = settle(host_verdicts(d, host), "hosts")
    bad = hosts.filter("host_bad").select("_host", F.col("rate").alias("host_rate"))
    if bad.count() <= BROADCAST_HOSTS:
        joined = d.join(F.broadcast(bad), F.col(host).eqNullSafe(F.col("_host")), "left")
    else:
        salted = bad.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        d = d.withColumn("_key", F.pmod(F.xxhash64(*MEASURES, *[c for c in extra if c != host]), F.lit(SALTS)).cast("int"))
        joined = d.join(salted, (F.col("_key") == F.col("_salt")) & F.col(host).eqNullSafe(F.col("_host")), "left")
    soft = [F.col(f"_{r}") for r in rules() if r != "base"]
    soft_failed = soft[0]
    for c in soft[1:]:
        soft_failed = soft_failed | c
    return joined.select(
        *extra, *MEASURES, F.col("_base").alias("base_failed"), "host_rate",
        (~F.col("_base") & ~(F.col("host_rate").isNotNull() & soft_failed)).alias("kept"))
