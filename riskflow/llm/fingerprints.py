"""Document fingerprints by invertible Bloom lookup sketches (operator 9).

A text is cut into paragraphs (lines, then sentences, then runs of bounded
length); each gets a 64-bit digest that also counts its earlier occurrences.
The sketch keeps the digests in cells (count, xor of digests, xor of checks),
three cells a digest.  Two sketches of one size subtract cell by cell, and
peeling the pure cells of the difference recovers the digests in which the
texts differ.  If peeling stalls, both are sketched four times larger.

Defined cases: a null text is the empty text, with no paragraphs; two texts
without paragraphs have likeness 1; rows that share a doc_id follow each other
in the order of their text hash; the row after the last is the first; an empty
table gives an empty result.
"""
from __future__ import annotations

import hashlib
import re
import struct

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import partitions

#: cells of each third of the smallest sketch, and its growth when peeling fails
SMALLEST = 8
GROWTH = 4
#: longest paragraph in code points
LONGEST = 200
_MIX = 0x9E3779B97F4A7C15
_PIECE = re.compile(r"[^\n.?!]*[.?!]+|[^\n.?!]+")


def digests(text: str) -> list[int]:
    """64-bit digests of the paragraphs; a repeated paragraph has another digest each time."""
    seen: dict[str, int] = {}
    out = []
    for piece in _PIECE.findall(text):
        for part in (piece,) if len(piece) <= LONGEST else (piece[i:i + LONGEST] for i in range(0, len(piece), LONGEST)):
            k = seen.get(part, 0)
            seen[part] = k + 1
            out.append(xxhash.xxh64_intdigest(part.encode(), k))
    return out


def _check(key: int) -> int:
    return (key * _MIX & 0xFFFFFFFFFFFFFFFF) >> 32


class Sketch:
    """The sketches of one text in the sizes that were asked for."""

    def __init__(self, text: str):
        self.keys = digests(text)
        self.sizes: dict[int, tuple[list[int], list[int], list[int]]] = {}

    def cells(self, third: int) -> tuple[list[int], list[int], list[int]]:
        if third not in self.sizes:
            count, keys, checks = [0] * (3 * third), [0] * (3 * third), [0] * (3 * third)
            for k in self.keys:
                c = _check(k)
                for i in (k % third, third + (k >> 21) % third, 2 * third + (k >> 42) % third):
                    count[i] += 1
                    keys[i] ^= k
                    checks[i] ^= c
            self.sizes[third] = (count, keys, checks)
        return self.sizes[third]

    def hex(self) -> str:
        """The smallest sketch with the number of paragraphs in front."""
        count, keys, checks = self.cells(SMALLEST)
        return struct.pack(">Q", len(self.keys)).hex() + b"".join(map(struct.Struct(">IQI").pack, count, keys, checks)).hex()


def _peel(count: list[int], keys: list[int], checks: list[int], third: int) -> tuple[list[int], list[int]] | None:
    """Digests on the left only and on the right only, or None if peeling stalls."""
    left, right = [], []
    todo = [i for i, n in enumerate(count) if n in (1, -1)]
    while todo:
        i = todo.pop()
        n, k = count[i], keys[i]
        if n not in (1, -1) or checks[i] != (c := _check(k)):
            continue
        (left if n == 1 else right).append(k)
        for j in (k % third, third + (k >> 21) % third, 2 * third + (k >> 42) % third):
            count[j] -= n
            keys[j] ^= k
            checks[j] ^= c
            if count[j] in (1, -1):
                todo.append(j)
    return None if any(count) or any(keys) else (left, right)


def difference(a: Sketch, b: Sketch) -> tuple[list[int], list[int]]:
    """Digests of a alone and of b alone: subtract, peel, retry larger on failure."""
    if a.keys == b.keys:
        return [], []
    third = SMALLEST
    while True:
        (ca, ka, ha), (cb, kb, hb) = a.cells(third), b.cells(third)
        found = _peel([x - y for x, y in zip(ca, cb, strict=True)], [x ^ y for x, y in zip(ka, kb, strict=True)],
                      [x ^ y for x, y in zip(ha, hb, strict=True)], third)
        if found is not None:
            return found
        third = third * GROWTH + 1


def likeness(a: Sketch, b: Sketch) -> float:
    both = len(a.keys) + len(b.keys)
    left, right = difference(a, b)
    return 1.0 - (len(left) + len(right)) / both if both else 1.0


def in_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_b, _borrowed, _id, _hash, _text: every partition holds whole doc_id ranges in order.

    The first row of every range is also lent to the range before it (and the
    first of all to the last), so each row meets its follower in its own task.
    The text is shuffled once; the driver gets two numbers per range.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    d = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    bounds = sorted(set(d.approxQuantile("_id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    at = F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]), lambda b: b <= F.col("_id"))) if bounds else F.lit(0)
    d = d.withColumn("_b", F.when(F.col("_id").isNull(), F.lit(0)).otherwise(at))
    firsts = d.groupBy("_b").agg(F.min(F.struct(F.col("_id").isNotNull().alias("n"), "_id"))["_id"].alias("_id")).orderBy("_b").collect()
    # one row per range: its first id is lent to the range before it, the first of all to the last
    rows = [(r["_id"], firsts[i - 1]["_b"]) for i, r in enumerate(firsts)]
    lent = F.broadcast(spark.createDataFrame(rows, "_first long, _lent int"))
    d = d.join(lent, F.col("_id").eqNullSafe(F.col("_first")), "left")
    own = F.struct(F.col("_b").alias("_b"), F.lit(False).alias("_borrowed"))
    d = d.withColumn("_to", F.explode(F.when(F.col("_lent").isNull(), F.array(own)).otherwise(
        F.array(own, F.struct(F.col("_lent").alias("_b"), F.lit(True).alias("_borrowed"))))))
    d = d.select("_to.*", "_id", F.xxhash64("_text").alias("_hash"), "_text")
    return d.repartitionByRange(n, "_b").sortWithinPartitions("_b", "_borrowed", "_id", "_hash")


def edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[:len(text) - k] + following[:k] if k else text


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, the two fingerprints, and both likenesses."""
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double, n_paragraphs long")

    def row(i, text, sketch, next_text, next_sketch):
        changed = edited(text, next_text)
        other = Sketch(changed)
        return (i, len(text), hashlib.sha256(changed.encode()).hexdigest(), sketch.hex(), other.hex(),
                likeness(sketch, other), likeness(sketch, next_sketch), len(sketch.keys))

    def run(batches):
        held = None  # the row that waits for its follower
        for b in batches:
            out = []
            ids = [None if pd.isna(i) else int(i) for i in b["_id"]]
            for where, borrowed, i, t in zip(b["_b"], b["_borrowed"], ids, b["_text"], strict=True):
                sketch = Sketch(t) if held and held[0] == where or not borrowed else None
                if held and held[0] == where:
                    out.append(row(held[1], held[2], held[3], t, sketch))
                held = None if borrowed else (where, i, t, sketch)
            yield pd.DataFrame({c: pd.Series([r[k] for r in out], dtype="Int64" if c == "doc_id" else None)
                                for k, c in enumerate(c.split()[0] for c in schema.split(", "))})

    return in_order(docs, doc_id, text).mapInPandas(run, schema)
