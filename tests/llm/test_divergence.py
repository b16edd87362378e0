"""Source divergence against a plain brute force over all terms and pairs."""
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from llm_tables import DOC
from riskflow.llm import divergence, queries
from riskflow.llm.terms import WORDS, _stretches

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows):
    count, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        count[lang, source].update(terms)
        df[lang].update(set(terms))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= 3]
        n = {s: sum(count[lang, s][t] for t in kept) for s in sources}

        def p(c, total):
            return 1 + (10**9 * (c + 1)) // (total + len(kept))

        for s in sources:
            pair, term = [], []
            for h in sources - {s}:
                v = 0
                for t in kept:
                    a, b = p(count[lang, s][t], n[s]), p(count[lang, h][t], n[h])
                    v += (a - b) ** 2 // b
                pair.append((v, h))
            for t in kept:
                a, q = p(count[lang, s][t], n[s]), p(sum(count[lang, x][t] for x in sources), sum(n.values()))
                if count[lang, s][t] and a > q:
                    term.append(((a - q) ** 2 // q, t))
            for part, items in (("pair", pair), ("term", term)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, r) for r, (v, item) in enumerate(items, 1) if part == "pair" or r <= 200}
    return out


def some_rows(n, seed=0):
    rng = random.Random(seed)
    words = ["a", "B", "ab", "é", "Été", "x1y", "漢字", "😀", "z_z", "dé-jà"] + [f"w{chr(97 + i)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words[:rng.choice([5, 40, 310])]) for _ in range(rng.randint(0, 60))),
             rng.choice(["en", "en", "en", "de", "fr"]), rng.choice(["hot", "hot", "s1", "s2", "ß", "S3"]), 0) for i in range(n)]
    return rows + [(n, None, "en", "s1", None), (None, "ab ab a", None, None, None), (n, "", "xx", "only", 0), (n, "12 34 !", "xx", None, 0),
                   (1, "rare words here", "yy", "y", 0), (1, "rare words here", "yy", "y", 0), (1, "rare words here", "yy", "z", 0)]


@pytest.mark.parametrize("entries, cells", [(1_000_000, 4_000_000), (60, 9)])
def test_against_brute_force(spark, folder, monkeypatch, entries, cells):
    monkeypatch.setattr(divergence, "ENTRIES", entries)  # many buckets, blocks of one or two groups
    monkeypatch.setattr(divergence, "CELLS", cells)
    rows = some_rows(400)
    out = queries.op11_source_divergence(spark, folder(documents=(rows, DOC)))
    assert dict(out.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    out = out.collect()
    assert len(out) == len({tuple(r) for r in out})
    assert {tuple(r) for r in out} == brute(rows)


def test_dense_terms_are_scattered_in_steps(spark, folder, monkeypatch):
    rows = some_rows(300, seed=9)
    monkeypatch.setattr(divergence, "STEP", 5)
    assert {tuple(r) for r in divergence.audit(spark.createDataFrame(rows, DOC)).collect()} == brute(rows)


def test_memory_of_a_bucket():
    """A group whose terms all sources have holds no row for each of its (term, source) entries."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    terms, sources = 10_000, 100
    ends = pa.array(np.arange(terms + 1, dtype="i4") * sources)
    index = pa.table({"term": pa.array([f"t{i}" for i in range(terms)]), "gs": pa.ListArray.from_arrays(ends, pa.array(np.tile(np.arange(sources, dtype="i4"), terms))),
                      "ns": pa.ListArray.from_arrays(ends, pa.array(np.arange(terms * sources) % 7 + 1))})
    peers = pa.table({"lang": ["en"] * sources, "bucket": pa.array([1] * sources, pa.int32()), "gid": pa.array(range(sources), pa.int32()),
                      "mine": [i < 2 for i in range(sources)], "n": [4 * terms] * sources, "v": [terms] * sources, "lang_n": [4 * terms * sources] * sources,
                      "cs": pa.nulls(sources, pa.list_(pa.int64())), "ts": pa.nulls(sources, pa.list_(pa.int64()))})
    tracemalloc.start()
    out = divergence._scatter(index, peers)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows >= 2 * (sources - 1) and peak < 70e6


def test_hot_terms_merge_across_batches(spark, folder):
    rows = some_rows(120, seed=4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        d = spark.createDataFrame(rows, DOC).repartition(13).withColumn("gid", F.lit("clash")).withColumn("term", F.lit("clash"))
        assert {tuple(r) for r in divergence.audit(d).collect()} == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_text_in_stretches():
    raw = ("word Été12x " * 400_000).encode().translate(WORDS)
    parts = list(_stretches(raw))
    assert len(parts) > 1 and sum(parts, []) == raw.split()
    assert list(_stretches(b"x" * 3_000_000)) == [[b"x" * 3_000_000]] and list(_stretches(b"")) == [[]]


def test_empty_table(spark, folder):
    assert queries.op11_source_divergence(spark, folder(documents=([], DOC))).collect() == []
