"""Ranked search against a plain brute force over all documents."""
import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from llm_tables import DOC, documents
from riskflow.llm import queries, ranked_search

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ITEM = "item_id long, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, best=10):
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n, length = sum(c > 0 for _, _, c in held), sum(c for _, _, c in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, size in held:
            s = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    s += w * ((10**9 * c[t]) // (1000 * c[t] + 8 * (25 + 75 * size * n // length)))
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:best], 1)]
    return sorted(out, key=str)


def texts(n, seed):
    rng = random.Random(seed)
    words = ["the", "Of", "é", "12", "a-b", "漢字", "😀"] + [f"w{i}" for i in range(500)]
    return [" ".join(rng.choice(words[:rng.choice([6, 60, 500])]) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def check(spark, path, docs, items):
    out = queries.op12_ranked_search(spark, path)
    assert dict(out.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(docs, items)


def test_odd_documents_and_items(spark, folder):
    rows, schema = documents(texts(300, 1))
    rows += [(5, rows[7][1], "en", "a", 0), (None, "w1 the", None, None, None), (None, None, None, None, None), (9999, "the " * 30_000, "en", "a", 0), (9998, "", "en", "a", 0)]
    items = [(i, t) for i, t in enumerate(texts(70, 2))] + [(3, "the THE w1"), (None, "w1"), (80, None), (81, "never seen"), (82, "")]
    check(spark, folder(documents=(rows, schema), benchmark=(items, ITEM)), [r[:2] for r in rows], items)


def test_ties_and_copies_over_blocks(spark, folder):
    rows, schema = documents(["the same text w1"] * 4500 + ["another w1 w2"] * 600)
    random.Random(0).shuffle(rows)
    items = [(0, "same w1"), (1, "w2"), (2, "text text same")]
    check(spark, folder(documents=(rows, schema), benchmark=(items, ITEM)), [r[:2] for r in rows], items)


def test_owners_share_the_terms_and_clashing_columns(spark):
    docs = [(i, t) for i, t in enumerate(texts(200, 3))]
    items = [(i, t) for i, t in enumerate(texts(40, 4))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("block", "term", "item_id", "score")})
    b = spark.createDataFrame(items, ITEM).withColumns({c: F.lit("x") for c in ("doc_id", "rank", "q", "owner")})
    got = defaultdict(list)
    for r in ranked_search.search(d, b, best=3).collect():
        got[r.item_id].append(r)
    assert sorted((tuple(r) for x in got.values() for r in x), key=str) == brute(docs, items, 3)


def test_empty_tables(spark, folder, tmp_path):
    items, docs = [(1, "w1")], documents(["w1 w2"])
    assert queries.op12_ranked_search(spark, folder(documents=([], DOC), benchmark=(items, ITEM))).collect() == []
    spark.createDataFrame(*docs).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], ITEM).write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    assert queries.op12_ranked_search(spark, str(tmp_path)).collect() == []
