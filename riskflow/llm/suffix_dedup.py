"""Suffix dedup by merged Burrows-Wheeler transforms (operator 3).

A string of WINDOW bytes is a repeat in a document if it also starts in a
document with a smaller id.  Equal strings hold the same GRAM-byte anchor of
least hash, so anchors route the suffixes:

1. Every input split sends the sorted set of its anchor hashes, delta coded;
   each hash range answers with those seen again.  Text without a repeated
   anchor has no repeat and goes no further.
2. Stretches of text around repeated anchors are keyed by their content; a
   stretch that a smaller document has too is removed as a whole.
3. What shares an anchor but differs is compared by suffixes: a task cuts its
   stretches into shards, builds the Burrows-Wheeler transform of each, and
   merges them by refining the interleave one byte a round.  The round in which
   two neighbours part is their common prefix; those still together after
   WINDOW rounds are the repeated intervals.  Suffixes are never sorted anew.
   An anchor with more than CROWD stretches is not compared in one place: its
   windows are keyed by their content, settled within their task first, and
   judged as a stream like the stretches of step 2.

Defined cases: null texts are empty; rows that share a doc_id do not remove
from each other; null ids come last; documents shorter than a window keep all;
an empty table gives an empty result.  The table must be read from files, as
its splits are read twice; a task reads the anchors of its split from the
shared folder.
"""
from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import partitions, read_split, settle, settle_splits
from riskflow.llm.substring_dedup import _INVERSE, _LAST, _P, _Q, _powers, _signed, mix

WINDOW = 50
GRAM = 28
#: bytes of text hashed at once, of a shard, and of shards merged at once
CHUNK = 1 << 17
SHARD = 1 << 16
MERGE = 1 << 18
#: stretches of one anchor that are compared together; the windows of more go by their content
CROWD = 2000
#: records of a task compared before the shuffle
LOCAL = 400_000
#: bits of an anchor hash that the first pass compares
BITS = 40


def _roll(x: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive entries: powers of two are doubled and put together from the left."""
    parts, size, have, power = [], 1, x, int(_P)
    while size <= n:
        parts.append((size, have, power))
        if size * 2 <= n:
            have = have[:len(have) - size] * np.uint64(power) + have[size:]
            power = power * power % (1 << 64)
        size *= 2
    out, at = None, 0
    count = len(x) - n + 1
    for size, have, power in reversed(parts):
        if n - at >= size:
            out = have[at:at + count] if out is None else out * np.uint64(power) + have[at:at + count]
            at += size
    return out


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Place of a least of every n (up to 64) consecutive entries.

    The low bits of the hashes give way to the place, so one sliding minimum
    by doubling finds both; which of equal entries it is does not matter here.
    """
    place = np.arange(len(x), dtype=np.uint64)
    best, done, size = (x & ~np.uint64(63)) | (place & np.uint64(63)), 1, len(x) - n + 1
    while done * 2 <= n:
        best = np.minimum(best[:len(best) - done], best[done:])
        done *= 2
    best = np.minimum(best[:size], best[n - done:n - done + size])
    return (place[:size] + ((best - place[:size]) & np.uint64(63))).astype(np.int64)


_KEPT: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse; those for a usual chunk are kept."""
    if not _KEPT:
        _KEPT[:] = _powers(_P, 2 * CHUNK), _powers(_INVERSE, 2 * CHUNK)
    return (_KEPT[0][:n], _KEPT[1][:n]) if n <= len(_KEPT[0]) else (_powers(_P, n), _powers(_INVERSE, n))


def stretches(texts: list[bytes], window: int = WINDOW, gram: int = GRAM):
    """(text, first window, last window, anchor hash, content hash); starts count within the text."""
    joined = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    n = len(joined) - window + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if n <= 0:
        return none
    node = mix(_roll(joined, gram))
    least = _least(node, window - gram + 1)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))[:n]
    at = np.flatnonzero(np.arange(n) + window <= bounds[text + 1])
    if not len(at):
        return none
    new = np.ones(len(at), dtype=bool)
    new[1:] = (least[at[1:]] != least[at[:-1]]) | (text[at[1:]] != text[at[:-1]])
    low = at[new]
    high = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
    mixed = joined * _Q
    power, inverse = _tables(len(joined))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * power, dtype=np.uint64)])
    content = (sums[high + window] - sums[low]) * inverse[low]
    shape = (high - low).astype(np.uint64) * _Q + (least[low] - low).astype(np.uint64) * _P
    return text[low], low - bounds[text[low]], high - bounds[text[low]], node[least[low]], mix(content + mix(shape + np.uint64(1)))


def _chunks(texts):
    """(first, last, bytes of each) of runs of texts of about CHUNK bytes."""
    at, size, held = 0, 0, []
    for i, t in enumerate(texts):
        held.append(t.encode())
        size += len(held[-1])
        if size >= CHUNK:
            yield at, i + 1, held
            at, size, held = i + 1, 0, []
    if held:
        yield at, at + len(held), held


# ---- 1. anchors that occur again -------------------------------------------------

def _pack(sorted_hashes: np.ndarray) -> bytes:
    """Sorted 40-bit hashes as deltas in byte planes, which compress well in the shuffle."""
    return np.diff(sorted_hashes, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    n = len(blob) // 5
    planes = np.zeros((n, 8), dtype=np.uint8)
    planes[:, :5] = np.frombuffer(blob, dtype=np.uint8).reshape(5, n).T
    return np.cumsum(planes.reshape(-1).view("<u8"), dtype=np.uint64)


def _anchor_sets(ranges: int):
    def run(batches):
        found, docs, split = [], [], None
        for b in batches:
            split = b["_split"].iloc[0] if len(b) else split
            doc = b["doc"].to_numpy()
            for i, j, raw in _chunks(b["_text"]):
                text, _, _, k1, _ = stretches(raw)
                found.append(k1 >> np.uint64(64 - BITS))
                docs.append(doc[i:j][text])
        if found:
            h, doc = np.concatenate(found), np.concatenate(docs)
            del found, docs
            order = np.argsort(h)
            h, doc = h[order], doc[order]
            new = np.flatnonzero(np.diff(h, prepend=~h[:1]))
            # seen in another document of the split already
            n = (np.minimum.reduceat(doc, new) != np.maximum.reduceat(doc, new)) + 1 if len(h) else new
            h = h[new]
            at = np.searchsorted(h, np.arange(1, ranges, dtype=np.uint64) * np.uint64((1 << BITS) // ranges + 1))
            rows = [(r, split, _pack(x), np.packbits(c > 1).tobytes()) for r, (x, c) in enumerate(zip(np.split(h, at), np.split(n, at), strict=True)) if len(x)]
            yield pd.DataFrame(rows, columns=["range", "split", "hashes", "again"])

    return run


def _seen_again(batches):
    """All sets of one hash range (a bounded share of all anchors) -> per split the hashes that occur again."""
    splits, sets, again = [], [], []
    for b in batches:
        for split, blob, bits in zip(b["split"], b["hashes"], b["again"], strict=True):
            h = _unpack(blob)
            splits.append(split)
            sets.append(h)
            again.append(np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=len(h)).astype(bool))
    if sets:
        every, n = np.unique(np.concatenate(sets), return_counts=True)
        common = every[n > 1]
        out = [(s, _pack(keep)) for s, h, a in zip(splits, sets, again, strict=True) if len(keep := h[a | np.isin(h, common, assume_unique=True)])]
        yield pd.DataFrame(out, columns=["split", "hashes"])


# ---- 2. stretches around them ----------------------------------------------------

def _settle_local(cols):
    """Records of one task: stretches that a smaller document of the task has too are repeats (k2 null)."""
    doc, th, low, high, k1, k2 = cols
    order = np.lexsort((low, th, doc, k2, k1))
    doc, th, low, high, k1, k2 = (c[order] for c in (doc, th, low, high, k1, k2))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    row = same.copy()  # an identical row of the input needs one record
    row[1:] &= (doc[1:] == doc[:-1]) & (th[1:] == th[:-1]) & (low[1:] == low[:-1])
    repeat = doc > doc[first]
    k1 = np.where(repeat, doc, _signed(k1))
    keep = ~row
    return [c[keep] for c in (k1, _signed(k2), repeat, doc, th, low.astype(np.int32), high.astype(np.int32))]


_FOUND = "k1 long, k2 long, repeat boolean, doc long, th int, low int, high int"


def _found(held) -> pd.DataFrame:
    cols = _settle_local([np.concatenate(c) for c in zip(*held, strict=True)])
    return pd.DataFrame(dict(zip((f.split()[0] for f in _FOUND.split(", ")), cols, strict=True)))


def _records(path: str):
    """The stretches around the repeated anchors of a split, which its task reads from the shared folder."""
    def run(batches):
        split, again, held, size = None, np.zeros(0, np.uint64), [], 0
        for b in batches:
            if len(b) and b["_split"].iloc[0] != split:
                split = b["_split"].iloc[0]
                rows = read_split(path, split)
                again = np.sort(np.concatenate([_unpack(x.as_py()) for x in rows["hashes"]])) if rows is not None else again[:0]
            if not len(again):
                continue
            doc, th = b["doc"].to_numpy(), b["th"].to_numpy()
            for i, j, raw in _chunks(b["_text"]):
                text, low, high, k1, k2 = stretches(raw)
                h = k1 >> np.uint64(64 - BITS)
                keep = again[np.minimum(np.searchsorted(again, h), len(again) - 1)] == h
                held.append([c[keep] for c in (doc[i:j][text], th[i:j][text], low, high, k1, k2)])
                size += int(keep.sum())
                if size >= LOCAL:
                    yield _found(held)
                    held, size = [], 0
        if held:
            yield _found(held)

    return run


REPEAT, OPEN, CROWDED = 0, 1, 2


def _judge(window: int):
    """Sorted records -> repeats and, at anchors with several kinds of stretch, those of the least document (open, or crowded if more than CROWD)."""
    def run(batches):
        last = None  # (k1, k2, least doc) of the last record
        waiting: list[pd.DataFrame] = []  # its anchor's records until it ends or is crowded
        seen = (0, 0, 0, 0)  # its kinds, least and largest document, records that are no repeats

        def made(parts):
            out = pd.concat(parts)
            return pd.DataFrame({"k1": out["k1"], "doc": out["doc"], "th": out["th"], "low": out["low"],
                                 "high": out["high"] + np.int32(window), "state": out["state"]})

        for b in batches:
            parts = [b[b["repeat"]].assign(state=REPEAT)]
            b = b[~b["repeat"]]
            if len(b):
                k1, k2, doc = b["k1"].to_numpy(), b["k2"].to_numpy(), b["doc"].to_numpy()
                new1, new2 = np.ones(len(b), dtype=bool), np.ones(len(b), dtype=bool)
                new1[1:] = k1[1:] != k1[:-1]
                new2[1:] = new1[1:] | (k2[1:] != k2[:-1])
                if last is not None:
                    new1[0] = k1[0] != last[0]
                    new2[0] = new1[0] or k2[0] != last[1]
                first = np.maximum.accumulate(np.where(new2, np.arange(len(b)), -1))
                least = np.where(first >= 0, doc[np.maximum(first, 0)], last[2] if last is not None else 0)
                repeat = doc > least
                parts.append(b[repeat].assign(state=REPEAT))
                node = np.cumsum(new1)
                node -= node[0] == 1  # 0: the anchor that the batch before ended in, or the first
                kinds = np.bincount(node[new2], minlength=node[-1] + 1)
                count = np.bincount(node[~repeat], minlength=node[-1] + 1)
                starts = np.flatnonzero(np.diff(node, prepend=-1))
                low, high = np.minimum.reduceat(doc, starts), np.maximum.reduceat(doc, starts)
                if not new1[0]:  # goes on from the batch before
                    kinds[0] += seen[0]
                    low[0], high[0] = min(low[0], seen[1]), max(high[0], seen[2])
                    count[0] += seen[3]
                several = (kinds >= 2) & (low != high)  # strings of one document do not remove each other
                state = np.where(several & (count > CROWD), CROWDED, OPEN)
                if new1[0]:
                    if seen[0] >= 2 and seen[1] != seen[2]:
                        parts += [w.assign(state=OPEN) for w in waiting]
                    waiting = []
                elif node[-1] > 0 or state[0] == CROWDED:
                    if several[0]:
                        parts += [w.assign(state=state[0]) for w in waiting]
                    waiting = []
                wait = (node == node[-1]) & (state[-1] != CROWDED)
                put = ~repeat & several[node] & ~wait
                parts.append(b[put].assign(state=state[node[put]]))
                if (wait & ~repeat).any():
                    waiting.append(b[wait & ~repeat])
                seen = int(kinds[-1]), int(low[-1]), int(high[-1]), int(count[-1])
                last = (int(k1[-1]), int(k2[-1]), int(least[-1]))
            yield made(parts)
        if waiting and seen[0] >= 2 and seen[1] != seen[2]:
            yield made([w.assign(state=OPEN) for w in waiting])

    return run


# ---- 3. shards, their transforms, and the merge ------------------------------------

class Shard:
    """The suffixes of some strings in order, ends first and by string, with their transform by byte pairs.

    Bytes are raised by one, so 0 is the end of a string.  pair holds the two
    bytes before a suffix, longer the place of the suffix that these lengthen
    it to.
    """

    def __init__(self, strings: list[bytes]):
        text = np.frombuffer(b"".join(s + b"\xff" for s in strings), dtype=np.uint8) + np.uint8(1)  # 0xff wraps to 0
        size = np.array([len(s) + 1 for s in strings])
        string = np.repeat(np.arange(len(strings)), size)
        offset = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
        left = np.repeat(size, size) - offset  # bytes to the end, the end included
        wide = np.concatenate([text, np.zeros(3, np.uint8)]).astype(np.int64)
        live = [np.where(left > k, wide[k:len(text) + k], 0) for k in range(4)]
        # ranks by four bytes, ends apart, then by twice as many bytes in each round
        key = (live[0] << 24 | live[1] << 16 | live[2] << 8 | live[3]) * (len(strings) + 1) + np.where(left <= 4, string + 1, 0)
        rank, longest, have = np.empty(len(key), np.int64), int(size.max()), 4
        while True:
            order = np.argsort(key)
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[order[1:]] != key[order[:-1]]
            rank[order] = np.cumsum(new) - 1
            if have >= longest or new.all():
                break
            follow = np.zeros(len(rank), np.int64)
            follow[:-have] = rank[have:] + 1
            key = rank * (int(rank.max()) + 2) + np.where(left > have, follow, 0)
            have *= 2
        self.string, self.offset = string[order], offset[order]
        self.leads = self.offset >= 2
        at = np.maximum(order - 2, 0)
        self.pair, self.longer = (live[0] << 8 | live[1])[at].astype(np.uint16), rank[at]


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in the shards laid end to end, interval number) of every suffix of depth (even) bytes or more, in their order.

    The interleave starts as one shard after the other.  In a round every
    suffix moves to where the one two bytes longer stands: a stable count over
    the byte pairs, which keeps each shard's own order.  After round r the
    suffixes of 2r bytes or more are in the order of their first 2r bytes;
    neighbours stay in one interval while their bytes agree, and the round that
    parts them is their common prefix.
    """
    base = np.cumsum([0, *(len(s.string) for s in shards)])
    pair = np.concatenate([s.pair for s in shards])
    leads = np.concatenate([s.leads for s in shards])
    longer = np.concatenate([s.longer + b for s, b in zip(shards, base, strict=False)]).astype(np.int32)
    place = np.arange(base[-1], dtype=np.int32)
    interval = np.zeros(len(place), dtype=np.int32)
    for _ in range(0, depth, 2):
        go = leads[place]
        moving = place[go]
        key = pair[moving]
        order = np.argsort(key, kind="stable")
        was, key, place = interval[go][order], key[order], longer[moving[order]]
        new = np.ones(len(place), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (was[1:] != was[:-1])
        interval = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return place, interval


def repeated(strings: list[bytes], docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of every window that a string of a smaller document holds too."""
    parts, at, size = [], 0, 0
    for i, s in enumerate(strings):
        size += len(s)
        if size >= SHARD or i == len(strings) - 1:
            parts.append((at, i + 1))
            at, size = i + 1, 0
    made = [Shard(strings[i:j]) for i, j in parts]
    place, interval = merge(made, window)
    if not len(place):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    string = np.concatenate([m.string + i for m, (i, _) in zip(made, parts, strict=True)])[place]
    offset = np.concatenate([m.offset for m in made])[place]
    starts = np.flatnonzero(np.diff(interval, prepend=-1))
    least = np.minimum.reduceat(docs[string], starts)[interval]
    hit = docs[string] > least
    return string[hit], offset[hit]


def _compare(window: int):
    def solve(d: pd.DataFrame):
        strings = d["part"].tolist()
        doc = d["doc"].to_numpy()
        s, o = repeated(strings, doc, window)
        return pd.DataFrame({"doc": doc[s], "th": d["th"].to_numpy()[s], "low": d["low"].to_numpy()[s] + o.astype(np.int32),
                             "high": d["low"].to_numpy()[s] + (o + window).astype(np.int32)})

    def run(batches):
        held, size, windows = [], 0, None
        batches = iter(batches)
        for b in batches:
            crowded = b["crowded"].to_numpy()
            if crowded.any():  # these come last
                b, windows = b[~crowded], b[crowded]
            if len(b):
                held.append(b)
                size += int(b["part"].str.len().sum())
            if size >= MERGE:
                d = pd.concat(held, ignore_index=True)
                rest = (d["k1"] == d["k1"].iloc[-1]).to_numpy()
                if not rest.all():  # an anchor's stretches, at most CROWD, stay together
                    yield solve(d[~rest])
                    held = [d[rest]]
                    size = int(d["part"][rest].str.len().sum())
            if windows is not None:
                break
        if held:
            yield solve(pd.concat(held, ignore_index=True))
        if windows is not None:
            for out in _judge(window)(chain([windows], batches)):
                yield out.loc[out["state"] == REPEAT, ["doc", "th", "low", "high"]]

    return run


_PARTS = f"{_FOUND}, crowded boolean, part binary"


def _slices(window: int):
    """The bytes of the asked stretches; of crowded anchors instead the windows, keyed by their content."""
    def windows(raws, where):
        text, low, _, k1, k2 = stretches(raws, window, window)
        doc, th, at = (np.array(c)[text] for c in zip(*where, strict=True))
        return [doc, th, at + low, at + low, k1, k2]

    def run(batches):
        held, size = [], 0
        for b in batches:
            rows, raws, where, n = [], [], [], 0
            for doc, th, text, k1s, lows, highs, states in zip(*(b[c] for c in ("doc", "th", "_text", "k1s", "lows", "highs", "states")), strict=True):
                raw = text.encode()
                for k, i, j, s in zip(k1s, lows, highs, states, strict=True):
                    if s == OPEN:
                        rows.append((k, 0, False, doc, th, i, j - window, False, raw[i:j]))
                        continue
                    raws.append(raw[i:j])
                    where.append((doc, th, i))
                    n += j - i
                    if n >= CHUNK:
                        held.append(windows(raws, where))
                        size += len(held[-1][0])
                        raws, where, n = [], [], 0
                    if size >= LOCAL:
                        yield _found(held).assign(crowded=True, part=None)
                        held, size = [], 0
            if raws:
                held.append(windows(raws, where))
                size += len(held[-1][0])
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in _PARTS.split(", ")])
        if held:
            yield _found(held).assign(crowded=True, part=None)

    return run


def _cut(batches):
    for b in batches:
        out = []
        for text, lows, highs in zip(b["_text"], b["lows"], b["highs"], strict=True):
            raw = np.frombuffer(text.encode(), dtype=np.uint8)
            keep = np.ones(len(raw), dtype=bool)
            n = 0
            if lows is not None:
                step = np.zeros(len(raw) + 1, dtype=np.int64)
                np.add.at(step, lows, 1)
                np.add.at(step, highs, -1)
                keep = np.cumsum(step)[:-1] == 0
                n = int((np.diff(keep.astype(np.int8), prepend=1) == -1).sum())
            kept = raw[keep].tobytes()
            out.append((len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept))
        b = b.drop(columns=["_text", "lows", "highs"])
        for k, c in enumerate(("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")):
            b[c] = pd.Series([r[k] for r in out], index=b.index, dtype=object if k > 2 else "int64")
        yield b


def dedup_bytes(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """keep columns, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes)."""
    spark = docs.sparkSession
    p = partitions(spark)
    keep = [c for c in dict.fromkeys(keep) if c in docs.columns]
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST))
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(doc.alias("doc"), F.hash(F.xxhash64(body)).alias("th"), body.alias("_text"), F.struct(*keep).alias("_keep"))
    slim = base.select("doc", "th", "_text", F.spark_partition_id().alias("_split"))
    sets = slim.mapInPandas(_anchor_sets(p), "range int, split int, hashes binary, again binary")
    again = sets.repartitionById(p, F.col("range")).mapInPandas(_seen_again, "split int, hashes binary")
    path = settle_splits(again, slim.rdd.getNumPartitions(), "anchors")
    records = slim.mapInPandas(_records(path), _FOUND)
    judged = settle(records.repartition(p, "k1").sortWithinPartitions("k1", "k2", "doc", "th", "low")
                    .mapInPandas(_judge(window), "k1 long, doc long, th int, low int, high int, state int"), "byte-stretches")
    texts = base.repartition(p, "doc", "th")  # shared by both joins below
    asked = judged.filter(F.col("state") != REPEAT).groupBy("doc", "th") \
        .agg(*(F.collect_list(c).alias(f"{c}s") for c in ("k1", "low", "high", "state")))
    parts = texts.join(asked, ["doc", "th"]).select("doc", "th", "_text", "k1s", "lows", "highs", "states") \
        .mapInPandas(_slices(window), _PARTS)
    found = parts.repartition(p, "k1").sortWithinPartitions("crowded", "k1", "k2", "doc", "th", "low").mapInPandas(_compare(window), "doc long, th int, low int, high int")
    spans = judged.filter(F.col("state") == REPEAT).select("doc", "th", "low", "high").unionByName(found) \
        .groupBy("doc", "th").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))
    fields = docs.select(*keep).schema
    schema = ", ".join([f"`{c}` {fields[c].dataType.simpleString()}" for c in keep]
                       + ["n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string", "kept binary"])
    return texts.join(spans, ["doc", "th"], "left").select("_keep.*", "_text", "lows", "highs").mapInPandas(_cut, schema)
