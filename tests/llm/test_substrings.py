"""Substring operators against brute force."""
import hashlib
import random

import numpy as np
import pytest
from llm_tables import DOC

from riskflow.llm import queries, substring_dedup, suffix_dedup


def _windows(texts, ids):
    """Brute force of the word windows: {row: (n_words, removed set, kept hash)}."""
    words = [(t or "").encode().split() for t in texts]
    first = {}
    for i in sorted(range(len(texts)), key=lambda i: ids[i]):
        for s in range(len(words[i]) - 19):
            first.setdefault(tuple(words[i][s:s + 20]), (ids[i], s))
    out = []
    for i, w in enumerate(words):
        gone = set()
        for s in range(len(w) - 19):
            if first[tuple(w[s:s + 20])] != (ids[i], s):
                gone |= set(range(s, s + 20))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "be", "cé", "dog", "e f", "g"]) + str(rng.randint(0, 30))
    passages = [" ".join(word() for _ in range(rng.randint(15, 70))) for _ in range(12)]
    texts = [None, "", " \n\t ", "one", "x " * 19, "x " * 20, "x " * 21, "x " * 5000, "ab " * 30 + "\x0b" + "ab\r\n" * 30]
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 6)):
            if rng.random() < 0.5:
                p = rng.choice(passages).split()
                a = rng.randint(0, len(p) - 1)
                parts.append(" ".join(p[a:a + rng.randint(1, 60)]))
            else:
                parts.append(" ".join(word() for _ in range(rng.randint(0, 30))))
        texts.append("\n".join(parts))
    return texts + texts[20:40] + [passages[0]] * 30


@pytest.mark.parametrize("local", [400_000, 50])
def test_word_windows(spark, folder, local, monkeypatch):
    monkeypatch.setattr(substring_dedup, "LOCAL", local)
    texts = corpus(1)
    ids = list(range(len(texts)))
    random.Random(7).shuffle(ids)
    rows = [(i, t, "en", "s", 0) for i, t in zip(ids, texts, strict=True)]
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_substring_dedup"](spark, folder(documents=(rows, DOC))).collect()}
    assert len(got) == len(texts)
    for i, want in zip(ids, _windows(texts, ids), strict=True):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == want, i


def test_small_batches_and_repeated_rows(spark):
    texts = corpus(2)[:60]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] * 2 + [(None, texts[30], "en", "s", 0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, DOC), ["doc_id", "source"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = _windows(texts, list(range(60)))
    assert len(got) == 121
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == (r["n_words"] if r["n_words"] >= 20 else 0)
        else:
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]]
            assert r["n_removed"] > 0 or r["kept_text"] == (texts[r["doc_id"]] or "")


def test_word_hashes_tell_words_and_places():
    h, at = substring_dedup.word_hashes([b"", b" ab  cd\nab", b"cd", b"  "])
    assert at.tolist() == [0, 0, 3, 4, 4] and h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
    assert len(np.unique(substring_dedup.word_hashes([b"a b ab ba aa aaa \x00 \x00\x00"])[0])) == 8




def _bytes(texts, ids):
    raw = [(t or "").encode() for t in texts]
    least = {}
    for i, r in zip(ids, raw, strict=True):
        for s in range(len(r) - 49):
            least[r[s:s + 50]] = min(least.get(r[s:s + 50], 1 << 62), i)
    out = []
    for i, r in zip(ids, raw, strict=True):
        keep = [True] * len(r)
        for s in range(len(r) - 49):
            if least[r[s:s + 50]] < i:
                keep[s:s + 50] = [False] * 50
        spans = sum(1 for j, k in enumerate(keep) if not k and (j == 0 or keep[j - 1]))
        out.append((len(r), keep.count(False), spans, hashlib.sha256(bytes(b for b, k in zip(r, keep, strict=True) if k)).hexdigest()))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_byte_windows(spark, folder, small, monkeypatch):
    if small:
        for name, n in (("CHUNK", 1000), ("SHARD", 300), ("MERGE", 2000)):
            monkeypatch.setattr(suffix_dedup, name, n)
    texts = corpus(3) + ["\x00" * 120, "a\x00" * 70, "é" * 60, "zé" * 45, "y" * 49, "y" * 50, "y" * 51, "aab" * 40 + "c" * 60]
    ids = list(range(len(texts)))
    random.Random(8).shuffle(ids)
    rows = [(i, t, "en", "s", 0) for i, t in zip(ids, texts, strict=True)]
    d = folder(documents=(rows, DOC))
    if small:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        got = {r["doc_id"]: r for r in queries.QUERIES["op3_suffix_dedup"](spark, d).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(texts)
    for i, want in zip(ids, _bytes(texts, ids), strict=True):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == want, i


def test_merged_transforms_are_in_order():
    rng = random.Random(9)
    strings = ["".join(rng.choices("ab\x00", k=rng.randint(1, 30))).encode() for _ in range(60)] * 2
    shards = [strings[:50], strings[50:51], strings[51:]]
    made = [suffix_dedup.Shard(s) for s in shards]
    for s, m in zip(shards, made, strict=True):
        suffixes = [(bytes(b + 1 for b in s[i][o:]), i) for i, o in zip(m.string, m.offset, strict=True)]
        assert suffixes == sorted(suffixes)
    every = [(s, i, o) for s, m in zip(shards, made, strict=True) for i, o in zip(m.string, m.offset, strict=True)]
    for depth in (2, 4, 8):
        place, interval = suffix_dedup.merge(made, depth)
        assert sorted(place) == [p for p, (s, i, o) in enumerate(every) if len(s[i]) - o >= depth]
        seen = [s[i][o:o + depth] for s, i, o in (every[p] for p in place)]
        assert seen == sorted(seen)
        assert [a == b for a, b in zip(interval, interval[1:], strict=False)] == [a == b for a, b in zip(seen, seen[1:], strict=False)]


def _crowded_texts(n):
    """A phrase of under a window with other text on both sides, and one of over a window, in n documents each."""
    rng = random.Random(11)
    noise = lambda: "".join(rng.choices("abcdefghijklmnop", k=40))
    short, long = "shared by the newsroom of the city", "".join(rng.choices("qrstuvwxyz", k=70))
    return [noise() + short + noise() for _ in range(n)] + [noise() + long + noise() for _ in range(n)]


def test_crowded_anchor_is_not_held_in_one_task(monkeypatch):
    texts = _crowded_texts(400)
    monkeypatch.setattr(suffix_dedup, "CROWD", 20)
    together = []
    repeated = suffix_dedup.repeated
    monkeypatch.setattr(suffix_dedup, "repeated", lambda strings, docs, window: together.append(len(strings)) or repeated(strings, docs, window))
    raw = [t.encode() for t in texts]
    text, low, high, k1, k2 = suffix_dedup.stretches(raw)
    anchors, n = np.unique(k1, return_counts=True)
    keep = np.isin(k1, anchors[n > 1])
    text, low, high, k1, k2 = (c[keep] for c in (text, low, high, k1, k2))
    d = suffix_dedup._found([[text.astype(np.int64), np.zeros(len(text), np.int32), low, high, k1, k2]])
    d = d.sort_values(["k1", "k2", "doc", "th", "low"])
    judged = suffix_dedup.pd.concat(suffix_dedup._judge(50)(d[i:i + 7] for i in range(0, len(d), 7)))
    spans = [judged[judged["state"] == suffix_dedup.REPEAT]]
    asked = judged[judged["state"] != suffix_dedup.REPEAT].groupby("doc").agg(k1s=("k1", list), lows=("low", list), highs=("high", list), states=("state", list)).reset_index()
    asked = asked.assign(th=0, _text=[texts[i] for i in asked["doc"]])
    parts = suffix_dedup.pd.concat(suffix_dedup._slices(50)(asked[i:i + 9] for i in range(0, len(asked), 9)))
    parts = parts.astype({"crowded": bool, "repeat": bool}).sort_values(["crowded", "k1", "k2", "doc", "th", "low"])
    assert parts["crowded"].any()
    spans += list(suffix_dedup._compare(50)(parts[i:i + 7] for i in range(0, len(parts), 7)))
    assert not (parts[~parts["crowded"]].groupby("k1").size() > 20).any()
    assert sum(together) <= (~parts["crowded"]).sum()
    gone = [set() for _ in texts]
    for i, a, b in zip(*(suffix_dedup.pd.concat(spans)[c] for c in ("doc", "low", "high")), strict=True):
        gone[i] |= set(range(a, b))
    assert [len(g) for g in gone] == [w[1] for w in _bytes(texts, range(len(texts)))]


def test_crowded_byte_windows(spark, folder, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", 3)
    monkeypatch.setattr(suffix_dedup, "LOCAL", 500)
    texts = corpus(5) + _crowded_texts(60) + ["aab" * 40 + "c" * 60, "\x00" * 120]
    ids = list(range(len(texts)))
    random.Random(12).shuffle(ids)
    d = folder(documents=([(i, t, "en", "s", 0) for i, t in zip(ids, texts, strict=True)], DOC))
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_suffix_dedup"](spark, d).collect()}
    for i, want in zip(ids, _bytes(texts, ids), strict=True):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == want, i


def test_rows_of_one_id_with_colliding_short_hashes(spark, folder):
    """Two texts whose 32-bit hashes agree, under one id, keep their own spans."""
    long = " ".join(f"w{i}" for i in range(40)) + " v13919"
    rows = [(None, long, "en", "a", 0), (None, "s250177", "en", "a", 0), (1, " ".join(f"w{i}" for i in range(40)), "en", "a", 0)]
    out = {(r["n_words"], r["n_removed"]) for r in queries.op2_substring_dedup(spark, folder(documents=(rows, DOC))).collect()}
    assert out == {(41, 40), (1, 0), (40, 0)}


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", 64)
    for text in (b" ".join(b"w%d" % (i * i) for i in range(200)), b"  a\n" * 100, b"x" * 400 + b" y" * 90, b"y " * 90 + b"x" * 400, b""):
        whole = substring_dedup.word_hashes([text])[0]
        assert substring_dedup._all_hashes(text, 5).tolist() == whole.tolist()
        windows = [w for before, piece in substring_dedup._pieces(text, 5)
                   for w in range(before, before + max(0, len(piece.split()) - 4))]
        assert windows == list(range(max(0, len(whole) - 4)))
