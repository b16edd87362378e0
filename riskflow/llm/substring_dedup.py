"""Substring dedup by a compacted de Bruijn graph of token k-mers (operator 2).

A window is WINDOW consecutive words.  Equal windows hold the same k-mer of
least hash, so these k-mers are the nodes that a window can pass through, and
the stretch of text whose windows share one node occurrence is an edge of the
graph.  A node with one kind of edge does not branch: its whole stretch is
compacted into one record, judged by one key however many words it has.  At
branching nodes the stretches are opened and their single windows compared.
Records carry source coordinates (document, first word); whatever is not the
first of its kind in coordinate order is a repeat, and repeats of one document
are joined back to its text, where adjacent ones make long spans.

Copies inside one task are settled before the shuffle, so a passage that a
third of all documents share is one record per task.

Defined cases: null texts have no words; documents with fewer words than a
window keep all; rows that share a doc_id are one document each, ordered by a
hash of their text, and identical rows are judged alike; null ids come last; very
long texts are hashed in overlapping pieces; columns of docs named like a
result column are left out of keep; an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import partitions, read_split, settle, settle_splits

WINDOW = 20
KMER = 6
#: bytes of text hashed at once (about 30 bytes of arrays each), and records compared before the shuffle
CHUNK = 128 << 10
LOCAL = 200_000
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_LAST = np.iinfo(np.int64).max


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, first word of every text and the end)."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = _SPACE[joined]
    edge = np.flatnonzero(np.diff(space, prepend=True))  # word starts and ends in turn
    start, end = edge[::2], edge[1::2]
    length = end - start
    at = np.arange(len(joined)) - np.repeat(np.concatenate([[0], end]) if len(end) else np.array([0]),
                                            np.diff(np.concatenate([[0], end, [len(joined)]])))
    # position inside the word: counted from the end of the word before, spaces included, then shifted back
    gap = start - np.concatenate([[0], end[:-1]]) if len(start) else start
    at = at[~space] - np.repeat(gap, length)
    power = _powers(_Q, int(length.max()) if len(length) else 0)
    value = (joined[~space].astype(np.uint64) + np.uint64(1)) * power[at]
    first = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64) if len(length) else np.zeros(0, np.int64)
    h = np.add.reduceat(value, first) if len(first) else np.zeros(0, np.uint64)
    h = mix(h + length.astype(np.uint64) * _P)
    texts_at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return h, np.searchsorted(start, texts_at)


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive entries."""
    out = h[:len(h) - n + 1].copy()
    for j in range(1, n):
        out = out * _P + h[j:len(h) - n + 1 + j]
    return out


def stretches(h: np.ndarray, bounds: np.ndarray, window: int = WINDOW, k: int = KMER):
    """(text, first window, last window, node hash, content hash) of every edge of the graph.

    Starts are counted within the text.
    """
    n = len(h) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    node = mix(_rolled(h, k))
    per = window - k + 1
    least = np.arange(n) + np.lib.stride_tricks.sliding_window_view(node, per)[:n].argmin(axis=1)
    text = np.searchsorted(bounds, np.arange(n), side="right") - 1
    fits = np.arange(n) + window <= bounds[text + 1]
    at = np.flatnonzero(fits)
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    new = np.ones(len(at), dtype=bool)
    new[1:] = (least[at[1:]] != least[at[:-1]]) | (text[at[1:]] != text[at[:-1]])
    low = at[new]
    high = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
    power = _powers(_P, len(h))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power, dtype=np.uint64)])
    content = (sums[high + window] - sums[low]) * _powers(_INVERSE, len(h))[low]
    shape = (high - low).astype(np.uint64) * _Q + (least[low] - low).astype(np.uint64) * _P
    return text[low], low - bounds[text[low]], high - bounds[text[low]], node[least[low]], mix(content + mix(shape + np.uint64(1)))


def first_of_kind(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, repeat): rows sorted by the columns; repeat marks rows whose first two columns
    are those of the row before but whose others differ from the first of that kind."""
    order = np.lexsort(columns[::-1])
    a, b, *rest = (c[order] for c in columns)
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    differs = np.zeros(len(order), dtype=bool)
    for c in rest:
        differs |= c != c[first]
    return order, same & differs


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


_FOUND = "k1 long, k2 long, doc long, th long, low int, high int"
_MADE = ("n_words", "n_removed", "kept_sha256", "kept_text", "_doc", "_th", "_text", "_split")
_JUDGED = "doc long, th long, low int, high int, open boolean"


def _pieces(text: bytes, window: int):
    """(words before, bytes) of overlapping pieces of a text: every window lies in one, and only window - 1 words in two."""
    start, before = 0, 0
    while True:
        if len(text) - start <= 2 * CHUNK:
            yield before, text[start:]
            return
        end = start + CHUNK
        while end < len(text) and not _SPACE[text[end]]:  # a word stays whole
            end += 1
        words = len(text[start:end].split())
        if words < window:  # words too long for a window in a piece stay with what follows
            yield before, text[start:]
            return
        yield before, text[start:end]
        start, before = end, before + words - (window - 1)
        for _ in range(window - 1):  # the next piece begins with the last window - 1 words
            while _SPACE[text[start - 1]]:
                start -= 1
            while not _SPACE[text[start - 1]]:
                start -= 1


def _chunks(texts, window: int):
    """(row, words before, bytes) lists of about CHUNK bytes, long texts in pieces."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for before, piece in _pieces(t, window):
            held.append((i, before, piece))
            size += len(piece)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _records(window: int):
    """Stretches of all texts; of equal ones in a task all but the first come out as repeats (k2 null)."""
    def settle_local(held):
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        doc, th, low, high, k1, k2 = cols
        order, repeat = first_of_kind(k1, k2, doc, th, low)
        same_row = np.zeros(len(order), dtype=bool)  # identical rows need one record
        same_row[1:] = True
        for c in (k1, k2, doc, th, low):
            same_row[1:] &= c[order][1:] == c[order][:-1]
        keep = ~same_row
        order, repeat = order[keep], repeat[keep]
        out = pd.DataFrame({"k1": _signed(k1[order]), "k2": pd.array(_signed(k2[order]), dtype="Int64"), "doc": doc[order], "th": th[order],
                            "low": low[order].astype(np.int32), "high": high[order].astype(np.int32)})
        # repeats carry coordinates only and are spread by them
        out.loc[repeat, "k2"] = pd.NA
        out.loc[repeat, "k1"] = out.loc[repeat, "doc"]
        return out

    def run(batches):
        held, size = [], 0
        for b in batches:
            doc, th = b["doc"].to_numpy(), b["th"].to_numpy()
            for part in _chunks((t.encode() for t in b["_text"]), window):
                text, low, high, k1, k2 = stretches(*word_hashes([t for _, _, t in part]), window)
                row, before = np.array([i for i, _, _ in part]), np.array([n for _, n, _ in part])
                held.append((doc[row[text]], th[row[text]], low + before[text], high + before[text], k1, k2))
                size += len(text)
                if size >= LOCAL:
                    yield settle_local(held)
                    held, size = [], 0
        if held:
            yield settle_local(held)

    return run


def _judge(window: int):
    """Sorted records -> repeats (open false) and stretches at branching nodes (open true).

    A node's records may be many, so they stream: what crosses a batch is the
    last record's keys and, while a node has one kind of stretch, its first.
    """
    def run(batches):
        last = waiting = None  # (k1, k2, doc, th, low) of the first of the kind; row of the node's first stretch
        for b in batches:
            parts = []
            ready = b["k2"].isna()
            if ready.any():
                parts.append(b[ready].assign(open=False))
                b = b[~ready]
            if len(b):
                k1, k2 = b["k1"].to_numpy(), b["k2"].to_numpy().astype(np.int64)
                new1, new2 = np.ones(len(b), dtype=bool), np.ones(len(b), dtype=bool)
                new1[1:] = k1[1:] != k1[:-1]
                new2[1:] = new1[1:] | (k2[1:] != k2[:-1])
                if last is not None:
                    new1[0] = k1[0] != last[0]
                    new2[0] = new1[0] or k2[0] != last[1]
                parts.append(b[~new2 & ~_same_as_first(b, new2, last)].assign(open=False))
                node = np.cumsum(new1)  # 0: the node that the batch before ended in
                firsts = np.flatnonzero(new2)
                kinds = np.bincount(node[firsts], minlength=node[-1] + 1)
                branching = kinds >= 2
                if node[0] == 0:
                    branching[0] = kinds[0] >= 1
                    if kinds[0] and waiting is not None:
                        parts.append(waiting.assign(open=True))
                        waiting = None
                parts.append(b.iloc[firsts[branching[node[firsts]]]].assign(open=True))
                if node[-1] > 0:
                    waiting = None if branching[node[-1]] else b.iloc[firsts[-1:]]
                if len(firsts):
                    r = b.iloc[firsts[-1]]
                    last = (int(k1[firsts[-1]]), int(k2[firsts[-1]]), int(r["doc"]), int(r["th"]), int(r["low"]))
            if parts:
                out = pd.concat(parts)
                yield pd.DataFrame({"doc": out["doc"], "th": out["th"], "low": out["low"],
                                    "high": out["high"] + np.where(out["open"], 0, window).astype(np.int32), "open": out["open"]})

    return run


def _same_as_first(b: pd.DataFrame, new2: np.ndarray, last) -> np.ndarray:
    """Rows whose coordinates are those of the first of their kind (identical rows of the input)."""
    first = np.maximum.accumulate(np.where(new2, np.arange(len(b)), -1))
    same = np.ones(len(b), dtype=bool)
    for k, c in enumerate(("doc", "th", "low")):
        v = b[c].to_numpy()
        same &= v == np.where(first >= 0, v[np.maximum(first, 0)], last[2 + k] if last is not None else 0)
    return same


def _all_hashes(text: bytes, window: int) -> np.ndarray:
    """Hashes of all words of a text, piece by piece."""
    out = []
    for before, piece in _pieces(text, window):
        h = word_hashes([piece])[0]
        out.append(h[window - 1:] if before else h)
    return np.concatenate(out)


class _Spans:
    """What the shared folder holds for the rows of a split, by (doc, th)."""

    def __init__(self, path: str):
        self.path, self.split, self.rows = path, None, {}

    def of(self, split: int) -> dict:
        if split != self.split:
            t = read_split(self.path, split)
            self.split, self.rows = split, {}
            if t is not None:
                for doc, th, lows, highs in zip(*(t[c].to_pylist() for c in ("doc", "th")), t["lows"], t["highs"], strict=True):
                    self.rows[doc, th] = lows.values.to_numpy(), highs.values.to_numpy()
        return self.rows


def _asked(b: pd.DataFrame, path: str, found: _Spans):
    """(doc, th, text, lows, highs) of the rows whose stretches are asked for, one of identical rows."""
    rows = found.of(int(b["_split"].iloc[0])) if len(b) else {}
    for doc, th, text in zip(b["doc"], b["th"], b["_text"], strict=True):
        if (doc, th) in rows:
            yield doc, th, text, *rows.pop((doc, th))


def _open(window: int, path: str):
    """The windows of the asked stretches; of equal ones in a batch all but the first are repeats at once."""
    def run(batches):
        found = _Spans(path)
        for b in batches:
            rows = []
            for doc, th, text, lows, highs in _asked(b, path, found):
                h = _all_hashes(text.encode(), window)
                at = np.unique(np.concatenate([np.arange(i, j + 1) for i, j in zip(lows, highs, strict=True)]))
                # two hashes of the window, the second over the words' hashes mixed once more
                pick = at[:, None] + np.arange(window)
                words = h[pick]
                p = _powers(_P, window)
                w1 = mix((words * p).sum(axis=1, dtype=np.uint64))
                w2 = mix((mix(words + _Q) * p).sum(axis=1, dtype=np.uint64))
                rows.append((w1, w2, np.full(len(at), doc), np.full(len(at), th), at))
            if rows:
                w1, w2, doc, th, low = (np.concatenate(c) for c in zip(*rows, strict=True))
                order, repeat = first_of_kind(w1, w2, doc, th, low)
                out = pd.DataFrame({"k1": _signed(w1[order]), "k2": pd.array(_signed(w2[order]), dtype="Int64"), "doc": doc[order],
                                    "th": th[order], "low": low[order].astype(np.int32), "high": low[order].astype(np.int32)})
                out.loc[repeat, "k2"] = pd.NA
                out.loc[repeat, "k1"] = out.loc[repeat, "doc"]
                yield out

    return run


def _cut(path: str):
    def run(batches):
        spans = _Spans(path)
        for b in batches:
            out = []
            rows = spans.of(int(b["_split"].iloc[0])) if len(b) else {}
            for doc, th, text in zip(b["_doc"], b["_th"], b["_text"], strict=True):
                lows, highs = rows.get((doc, th), (None, None))
                found = text.encode().split()
                keep = np.ones(len(found) + 1, dtype=np.int64)
                if lows is not None:
                    step = np.zeros(len(found) + 1, dtype=np.int64)
                    np.add.at(step, lows, 1)
                    np.add.at(step, highs, -1)
                    keep = np.cumsum(step) == 0
                kept = b" ".join([w for w, k in zip(found, keep.tolist(), strict=False) if k])
                removed = len(found) - int(keep[:len(found)].sum())
                out.append((len(found), removed, hashlib.sha256(kept).hexdigest(), kept.decode() if removed else text))
            b = b.drop(columns=["_text", "_doc", "_th", "_split"])
            for k, c in enumerate(("n_words", "n_removed", "kept_sha256", "kept_text")):
                b[c] = pd.Series([r[k] for r in out], index=b.index, dtype=object if k > 1 else "int64")
            yield b

    return run


def dedup_substrings(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """keep columns, n_words, n_removed, kept_sha256 and kept_text.

    kept_text is the text unchanged where nothing is removed (empty for null),
    else the kept words joined by one space; kept_sha256 is always of the words
    joined by one space.

    No text is shuffled: the records of the graph are, once by node, and the
    opened windows; what is found goes back to the splits of the input through
    the shared folder, one table for each split.
    """
    spark = docs.sparkSession
    p = partitions(spark)
    keep = [c for c in dict.fromkeys(keep) if c in docs.columns and c not in _MADE]
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST))
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(doc.alias("doc"), F.xxhash64(body).alias("th"), body.alias("_text"), F.struct(*keep).alias("_keep"), F.spark_partition_id().alias("_split"))
    slim = base.select("doc", "th", "_text", "_split")
    n = slim.rdd.getNumPartitions()
    rows = settle(base.groupBy("doc", "th", "_split").agg(F.lit(1).alias("_")).drop("_"), "rows")
    records = slim.mapInPandas(_records(window), _FOUND)
    judged = settle(records.repartition(p, "k1").sortWithinPartitions("k1", "k2", "doc", "th", "low")
                    .mapInPandas(_judge(window), _JUDGED), "stretches")
    asked = judged.filter("open").groupBy("doc", "th").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))
    one = rows.groupBy("doc", "th").agg(F.min("_split").alias("split"))
    path = settle_splits(asked.join(one, ["doc", "th"]), n, "asked")
    opened = slim.mapInPandas(_open(window, path), _FOUND)
    single = opened.repartition(p, "k1").sortWithinPartitions("k1", "k2", "doc", "th", "low") \
        .mapInPandas(_judge(window), _JUDGED).filter("not open").drop("open")
    spans = judged.filter("not open").drop("open").unionByName(single) \
        .groupBy("doc", "th").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))
    path = settle_splits(spans.join(rows, ["doc", "th"]).withColumnRenamed("_split", "split"), n, "spans")
    fields = docs.select(*keep).schema
    schema = ", ".join([f"`{c}` {fields[c].dataType.simpleString()}" for c in keep]
                       + ["n_words long", "n_removed long", "kept_sha256 string", "kept_text string"])
    return base.select("_keep.*", F.col("doc").alias("_doc"), F.col("th").alias("_th"), "_text", "_split").mapInPandas(_cut(path), schema)
