"""SimHash near-dedup against brute force."""
import random

import numpy as np
import xxhash
from llm_tables import documents

from riskflow.llm import queries, simhash
from riskflow.llm.components import components


def _fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _least(fps, ids):
    up = list(range(len(fps)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(fps)):
        least[top(i)] = min(least.get(top(i), 1 << 62), ids[i])
    return [least[top(i)] for i in range(len(fps))]


def test_near_duplicates(spark, folder):
    rng = random.Random(1)
    base = [" ".join(f"W{rng.randint(0, 400)}" for _ in range(120)) for _ in range(40)]
    texts = [None, "", " \n", "one", "ONE two", "É z", *base]
    for b in base:
        for _ in range(4):
            w = b.split()
            w[rng.randint(0, 119)] = "x"
            texts.append(" ".join(w))
    texts += base[:5] + ["junk " * 40000]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows, schema = documents(texts)
    d = folder(documents=([rows[i] for i in order], schema))
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_simhash"](spark, d).collect()}
    fps = [_fingerprint(t) for t in texts]
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i]["component_id"] for i in range(len(texts))] == _least(fps, list(range(len(texts))))


def test_dense_shards_lose_no_link(spark):
    """Shards above the size of a tree are cut again, and again into several trees."""
    rng = random.Random(2)
    centre = [rng.getrandbits(64) for _ in range(3)]
    fps = set()
    while len(fps) < 900:
        f = rng.choice(centre)
        for _ in range(rng.randint(0, 7)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    fps = sorted(fps)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    for tree in (4096, 40, 7):
        edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 3, tree)
        roots = {r["node"]: r["root"] for r in components(edges).collect()}
        group = {}
        for i, f in enumerate(signed):
            group.setdefault(roots.get(f, f), []).append(i)
        want = _least(fps, list(range(len(fps))))
        for members in group.values():
            assert {want[i] for i in members} == {members[0]}
        assert len(group) == len(set(want))


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(500)] + [(1000 + i, 1000) for i in range(1, 300)] + [(5000, 5000)]
    got = {}
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(len, got.values())) == [300, 501]
