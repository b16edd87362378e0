"""SimHash near-dedup with BK-trees (operator 5).

Fingerprints are deduplicated first.  Two fingerprints within distance d agree
wholly in one of d + 1 bands, so each band value is a shard of its own; a shard
larger than a tree may be is cut again by the bands of its remaining bits, and
what is still larger becomes several trees that every row of the shard is sent
to.  Each shard is a BK-tree: a child hangs under its parent by their Hamming
distance, and a search follows only edges within the radius.  A task reports
a spanning forest of the links it finds, not all pairs.

Defined cases: a null or blank text has fingerprint zero and links like any
other; equal fingerprints link; repeated rows belong to one component; an empty
table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import partitions, settle
from riskflow.llm.components import components

SEED = 42
#: rows of one tree
TREE = 4096
#: rows whose trees are built together in numpy
TOGETHER = 100_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def text_fingerprint(text: str, shingle: int) -> int:
    found = text.encode().translate(_LOWER).split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(found))
    digest = xxhash.xxh64_intdigest
    n = len(found) - k + 1
    h = np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[k - 1:].tolist(), strict=True)),
                    dtype=np.uint64, count=n)
    bits = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        part = h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = 3) -> DataFrame:
    """keep columns and fp, the fingerprint as a signed long, without a shuffle."""
    src = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = ", ".join([f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep] + ["fp long"])

    def run(batches):
        for b in batches:
            texts = b.pop("_text")
            b["fp"] = np.array([text_fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield b

    return src.mapInPandas(run, schema)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Trees:
    """BK-trees of many shards at once, built level by level in numpy."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        n = len(fp)
        self.fp = fp
        self.parent = np.full(n, -1)
        self.edge = np.zeros(n, dtype=np.int64)
        self.order = np.argsort(shard, kind="stable")
        left = self.order
        group = shard[left]
        first = np.ones(len(left), dtype=bool)
        first[1:] = group[1:] != group[:-1]
        self.roots = dict(zip(group[first].tolist(), left[first].tolist(), strict=True))
        while len(left):
            # the first row of every group becomes a node, the others hang below it by distance
            node = left[first][np.cumsum(first) - 1]
            rest = ~first
            left, node = left[rest], node[rest]
            d = _distance(fp[left], fp[node]).astype(np.int64)
            self.parent[left], self.edge[left] = node, d
            by = np.lexsort((d, node))
            left, node, d = left[by], node[by], d[by]
            first = np.ones(len(left), dtype=bool)
            first[1:] = (node[1:] != node[:-1]) | (d[1:] != d[:-1])
        # while building, all rows of a group had the node as parent; the deepest assignment stands
        child = np.flatnonzero(self.parent >= 0)
        by = np.lexsort((self.edge[child], self.parent[child]))
        self.child = child[by]
        self.start = np.searchsorted(self.parent[self.child], np.arange(n + 1))

    def search(self, shard: np.ndarray, fp: np.ndarray, radius: int):
        """Yields (query, node) arrays within the radius; queries are rows of (shard, fp)."""
        at = np.array([self.roots.get(s, -1) for s in shard.tolist()], dtype=np.int64)
        for i in range(0, len(fp), 4096):
            q = np.arange(i, min(i + 4096, len(fp)))
            q = q[at[q] >= 0]
            node = at[q]
            while len(q):
                d = _distance(fp[q], self.fp[node]).astype(np.int64)
                hit = d <= radius
                if hit.any():
                    yield q[hit], node[hit]
                low, n = self.start[node], self.start[node + 1] - self.start[node]
                q, d = np.repeat(q, n), np.repeat(d, n)
                child = self.child[np.arange(len(q)) + np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n)]
                near = np.abs(self.edge[child] - d) <= radius
                q, node = q[near], child[near]


def _forest(n: int, pairs) -> list[tuple[int, int]]:
    """(row, least row it is joined to) of every row that is not its own least; few pairs are kept."""
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if x != y and (x := top(x)) != (y := top(y)):
                up[max(x, y)] = min(x, y)
    return [(x, t) for x in range(n) if (t := top(x)) != x]


def _bits(fp: Column, low: int, high: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def links(fps: DataFrame, radius: int, tree: int = TREE) -> DataFrame:
    """fps: distinct fp -> edges (a, b) within the radius that join what belongs together."""
    n = radius + 1
    bands = F.array(*[F.struct(F.lit(i).alias("i"), _bits(F.col("fp"), 64 * i // n, 64 * (i + 1) // n).alias("v"))
                      for i in range(n)])
    one = settle(fps.withColumn("_x", F.explode(bands))
                 .select(F.xxhash64("_x.i", "_x.v").alias("shard"), F.col("_x.i").alias("band"), "fp"), "bands")
    # copies of a hot shard are counted before the shuffle; a shard of one row has no link
    size = one.groupBy("shard").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    one = one.join(size, "shard")
    small = one.filter(F.col("rows") <= tree).select("shard", F.lit(0).alias("part"), "fp", F.lit(True).alias("own"))
    # rows of a large shard agree in one band, so of the other bits, cut in n pieces, one piece agrees too;
    # piece j takes the j-th part of each other band
    pieces = []
    for j in range(n):
        value = F.lit(0).cast("long")
        for i in range(n):
            low, high = 64 * i // n, 64 * (i + 1) // n
            lo, hi = low + (high - low) * j // n, low + (high - low) * (j + 1) // n
            value = F.when(F.col("band") == i, value).otherwise(
                F.shiftleft(value, hi - lo).bitwiseOR(_bits(F.col("fp"), lo, hi)))
        pieces.append(F.struct(F.lit(j).alias("j"), value.alias("v")))
    fine = one.filter(F.col("rows") > tree).withColumn("_x", F.explode(F.array(*pieces))) \
        .select(F.xxhash64("shard", "_x.j", "_x.v").alias("shard"), "fp")
    fine = fine.join(fine.groupBy("shard").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "shard")
    # what is still larger than a tree becomes several trees; every row goes to its own and all later ones
    trees = F.ceil(F.col("rows") / tree).cast("int")
    fine = fine.withColumn("_mine", F.pmod(F.xxhash64("fp", F.lit(7)), trees).cast("int")) \
        .withColumn("part", F.explode(F.sequence(F.col("_mine"), trees - 1))) \
        .select("shard", "part", "fp", (F.col("part") == F.col("_mine")).alias("own"))

    def solve(d: pd.DataFrame) -> pd.DataFrame:
        fp = d["fp"].to_numpy().view(np.uint64)
        shard = d.groupby(["shard", "part"], sort=False).ngroup().to_numpy()
        own = np.flatnonzero(d["own"].to_numpy())
        found = Trees(shard[own], fp[own]).search(shard, fp, radius)
        made = np.array(_forest(len(fp), ((q, own[node]) for q, node in found)), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": fp.view(np.int64)[made[:, 0]], "b": fp.view(np.int64)[made[:, 1]]})

    def run(batches):
        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= TOGETHER:
                d = pd.concat(held, ignore_index=True)
                last = (d["shard"] == d["shard"].iloc[-1]) & (d["part"] == d["part"].iloc[-1])
                if last.all():  # one tree with many queries: its own rows come first and stay
                    yield solve(d)
                    held = [d[d["own"]]]
                else:
                    yield solve(d[~last])
                    held = [d[last]]
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    return small.unionByName(fine).repartition(partitions(fps.sparkSession), "shard", "part") \
        .sortWithinPartitions("shard", "part", F.desc("own")).mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                    radius: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep columns, fp, root (a fingerprint that names the component) and component_id, the least doc_id that links reach."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_body"), *keep)
    d = settle(fingerprints(d, ["doc_id", *keep], "_body", shingle), "simhash")
    per = settle(d.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(per.select("fp"), radius))
    joined = per.join(roots, per["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    joined = settle(joined, "simhash-roots")
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of = joined.join(ids, "root").select("fp", "root", "component_id")
    return d.join(of, "fp").select("doc_id", *keep, "fp", "root", "component_id")
