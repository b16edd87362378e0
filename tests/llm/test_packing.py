"""Sum-of-squares packing against the library's ids and a plain brute force."""
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_tables import DOC, documents
from riskflow.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = ["a", "the", " ", "  ", "\n", "\t", "\r\n", "12", "'s", "!", "é", "汉字", " ", " ", "\x1c", "\x85", "<|endoftext|>", "<|endoftext", "|>", "😀", "̀", "​", "\x00"]


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PARTS), max_size=20).map("".join)))
def test_ids_are_the_librarys(text):
    assert np.frombuffer(packing.encoder(PATH).encode(text), "<u4").tolist() == ids(text)


def squares(lengths, size):
    """The rule as stated: every place is tried, the sum is counted anew."""
    gaps, bins = [], []
    for s in lengths:
        def total(b):
            after = gaps + [size] if b == len(gaps) else list(gaps)
            after[b] -= s
            n = defaultdict(int)
            for g in after:
                n[g] += g > 0
            return sum(v * v for v in n.values())
        tried = [(total(b), gaps[b] if b < len(gaps) else size + 1, b) for b in range(len(gaps) + 1) if b == len(gaps) or gaps[b] >= s]
        b = min(tried)[2]
        if b == len(gaps):
            gaps.append(size)
        gaps[b] -= s
        bins.append(b)
    return sorted(gaps)


def test_place_is_the_rule():
    rng = random.Random(3)
    for size in (7, 12, 30):
        for _ in range(60):
            lengths = [rng.randint(1, size - 1) for _ in range(rng.randint(0, 25))]
            bins, offsets, gaps = packing.place(lengths, size)
            assert sorted(gaps) == squares(lengths, size)
            used = [0] * len(gaps)
            for s, b, o in zip(lengths, bins, offsets):
                assert o == used[b]
                used[b] += s
            assert [size - u for u in used] == gaps


def check(rows, texts, size=2048):
    """Every document whole, cut as asked, sequences gapless and within size; gives the number of sequences."""
    got, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    assert sorted(got, key=str) == sorted({d for d, _ in texts}, key=str)
    for d, t in texts:
        want = np.array([*ids(t or ""), 0], "<u4")
        k = -(-len(want) // size)
        cuts = [0] + [len(want) - size * (k - 1 - i) for i in range(k)]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got[d]) == \
            [(i, a, b - a, zlib.crc32(want[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    for parts in seqs.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    return len(seqs)


def test_query_on_odd_documents(spark, folder):
    texts = ["", None, "one two", " ", "x" * 5000, "word " * 9000, "<|endoftext|> in a text", "汉字" * 3000, "a  b\n\nc \n d"] + ["some words %d" % i for i in range(300)]
    rows, schema = documents(texts)
    rows.append((None, "no id", None, None, None))
    out = queries.op13_packing(spark, folder(documents=(rows, schema)))
    assert dict(out.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    out = out.collect()
    n = check(out, [(r[0], r[1]) for r in rows])
    assert n - 1 <= sum(r.length for r in out) / 2048 + 1


def test_copies_of_one_id_and_clashing_columns(spark):
    docs = spark.createDataFrame([(7, "same text")] * 900, "doc_id long, text string") \
        .withColumns({"piece": F.lit("mine"), "no": F.lit(1), "offset": F.lit("x"), "extra": F.lit("kept")})
    out = packing.pack_documents(docs, PATH, ["doc_id", "piece", "no", "offset", "extra"], size=64).collect()
    assert len(out) == 900 and {r.extra for r in out} == {"kept"} and {r.piece for r in out} == {0}
    seqs = defaultdict(set)
    for r in out:
        seqs[r.sequence_id].add(r.offset)
    each = len(ids("same text")) + 1
    assert len(seqs) == -(-900 // (64 // each)) and all(len(s) <= 64 // each for s in seqs.values())


def test_rounds_of_small_groups_stay_near_the_bound(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, "a" + " b" * rng.choice([3, 9, 20, 33, 47])) for i in range(3000)], "doc_id long, text string")
    parts = packing.settle(packing.pieces(docs, PATH, ["doc_id"], size=64), "pieces")
    total = parts.agg(F.sum("length")).first()[0]
    gaps = []
    for n in sorted((r.length for r in parts.collect()), reverse=True):  # best fit in decreasing order
        fit = [g for g in gaps if g >= n]
        gaps.append(min(fit) - n if fit else 64 - n)
        if fit:
            gaps.remove(min(fit))
    assert total / 64 <= len(gaps)
    for group, most in ((100, 1.15), (1_000_000, 1.005)):
        placed = packing.pack(parts, 64, group).join(parts, "no").collect()
        assert len(placed) == 3000
        ends = defaultdict(list)
        for r in placed:
            ends[r.sequence_id].append((r.offset, r.length))
        for p in ends.values():
            p.sort()
            assert all(a[0] + a[1] == b[0] for a, b in zip(p, p[1:])) and p[0][0] == 0 and sum(x[1] for x in p) <= 64
        assert len(ends) <= most * len(gaps)


def test_sequences_carry_their_ids(spark):
    docs = spark.createDataFrame([(i, "w%d " % i * (i % 40)) for i in range(60)], "doc_id long, text string")
    packed = packing.settle(packing.pack_documents(docs, PATH, ["doc_id"], size=128, ids=True), "packed")
    out = packing.sequences(packed).collect()
    assert all(len(r.ids) == r.length <= 128 for r in out)
    assert sorted(x for r in out for x in r.ids) == sorted(x for i in range(60) for x in [*ids("w%d " % i * (i % 40)), 0])


def test_empty_table(spark, folder):
    assert queries.op13_packing(spark, folder(documents=([], DOC))).collect() == []
