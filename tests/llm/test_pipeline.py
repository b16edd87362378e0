"""The pipeline, stage by stage, against brute force."""
import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece
from llm_tables import DOC
from test_simhash import _fingerprint, _least
from test_singles import _measures
from test_substrings import _windows

import corpus_pipeline


def _corpus():
    rng = random.Random(11)
    word = lambda: rng.choice(["al", "be", "cé", "dog", "fin"]) + str(rng.randint(0, 90))
    passages = [" ".join(word() for _ in range(rng.randint(25, 60))) for _ in range(6)]
    texts = []
    for _ in range(120):
        texts.append("\n".join(rng.choice(passages) if rng.random() < 0.3 else " ".join(word() for _ in range(rng.randint(5, 40)))
                               for _ in range(rng.randint(1, 6))))
    texts += texts[:30] + [None, "", "too short", "x " * 500]
    for t in texts[40:60]:
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    return [(i, t, "en", rng.choice(["a", "a", "b", None]), 0) for i, t in enumerate(texts)]


def test_pipeline(spark, folder):
    rows = _corpus()
    d = folder(documents=(rows, DOC))
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == [c.split()[0] for c in DOC.split(", ")]
        kept.append(sorted(tuple(r) for r in docs.collect()))
        docs = spark.createDataFrame(kept[-1], DOC)
    # quality: base rules (no source is bad here)
    good = [r for r in rows if (m := _measures(r[1]))[0] >= 20 and 100 * m[4] <= 30 * m[0]]
    assert kept[0] == sorted(good)
    # SimHash
    ids = [r[0] for r in good]
    assert kept[1] == [r for r, c in zip(good, _least([_fingerprint(r[1]) for r in good], ids), strict=True) if c == r[0]]
    assert len(kept[1]) < len(good)
    # substrings
    want = _windows([r[1] for r in kept[1]], [r[0] for r in kept[1]])
    for r, before, (_, removed, sha) in zip(kept[2], kept[1], want, strict=True):
        assert hashlib.sha256(" ".join(r[1].split()).encode()).hexdigest() == sha and r[4] == len(r[1])
        assert removed or r[1] == before[1]
    # mixing: whole copies, within three times, near the target
    sizes = {}
    for r in kept[2]:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    taken = {}
    for r in kept[3]:
        taken[r[3]] = taken.get(r[3], 0) + len(r[1].split())
    share = {"a": 5 / 8, "b": 2 / 8, None: 1 / 8}
    total = sum(sizes.values())
    for s, n in sizes.items():
        assert abs(taken.get(s, 0) - share[s] * total) <= 130 or share[s] * total > 3 * n
    assert all(kept[3].count(r) <= 3 for r in kept[2]) and set(kept[3]) <= set(kept[2])
    # encoding
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["exact"]) for r in corpus_pipeline.run(spark, d).collect())
    enc = [(r[0], library.encode(r[1])) for r in kept[3]]
    assert out == sorted((i, len(x), hashlib.sha256(np.asarray(x, dtype="<u4").tobytes()).hexdigest(), True) for i, x in enc)


def test_every_stage_takes_odd_tables(spark, folder):
    long = " ".join(f"w{i}" for i in range(60))
    odd = [(1, long, None, None, None), (1, long, None, None, None), (1, long + " other words", "en", "a", 1), (None, long, "en", "a", 1),
           (None, None, None, "b", None), (2, "", "en", "b", 0), (3, "x" * 70000, "en", "b", 70000)]
    for rows in (odd, []):
        for name, stage in corpus_pipeline.STAGES:
            df = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as kept", "2 as size", "3 as fp", "4 as _h")
            path = folder(**{f"t{len(rows)}{name.split()[0]}": ([tuple(r) for r in df.collect()], df.schema)})
            got = stage(spark, spark.read.parquet(f"{path}/t{len(rows)}{name.split()[0]}.parquet"), path).collect()
            assert got or not rows or name == "quality rules", name
