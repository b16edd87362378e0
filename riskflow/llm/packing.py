"""Sum-of-squares packing of documents into training sequences (operator 13).

A document is its token ids and an end id.  Only documents over the sequence
size are cut, from their end, so that the first piece takes the rest.  Every
piece goes where the sum over residual gaps g of (open bins with gap g)^2
becomes smallest: into a bin of some gap, or into a new bin.

Pieces are numbered once and dealt into groups of at most about GROUP by a hash
of that number; a group packs in decreasing length, with one count per residual
gap as its whole state.  Full bins are sequences.  The pieces of bins that stay
open are dealt anew, round after round, until one group holds them or a round
leaves over half of its pieces in open bins.  In that last round the pieces of
open bins are placed once more, opening a new bin only where none has room.  So the sequences that stay short are
few at any size, and no task holds more than a group.

Defined cases: a null text is the empty text, one piece holding the end id;
special strings are their special ids, as in the library; repeated rows are
packed each, whatever their doc_id; an empty table gives an empty result;
texts are encoded whole, a very long one in the memory of its ids; columns of
docs named like a result column are left out of keep.
"""
from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import settle
from riskflow.llm.token_counts import PATTERN, _byte_of

#: pieces that one task packs at a time, on average
GROUP = 32_768
#: characters of the texts whose pieces are handed on together; one text at least
AT_ONCE = 2_000_000
MADE = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
#: white space of one byte, and what the white space beyond ASCII begins with or is, in UTF-8 (fixed values)
ONE_SPACE = bytes(32 if b in b"\t\n\x0b\x0c\r " else b for b in range(256))
WIDE_SPACE = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80\x80"]


class Encoder:
    """Ids of a byte-level BPE vocabulary file, equal to its library's.

    A text without two white-space characters in a row needs no look-ahead, so
    the split pattern without it, which is searched in linear time, gives the
    same pretokens; other texts take the pattern as it is.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) \
                or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout") \
                or any(not t.get("special") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])):
            raise ValueError("a plain byte-level BPE vocabulary is needed")
        byte = _byte_of()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        if any(b <= a for a, b in zip(made, made[1:])):
            raise ValueError("ids must follow the merges")
        self.special = list(special)
        self.whole = tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.plain = tiktoken.Encoding("plain", pat_str=PATTERN.replace(r"|\s+(?!\S)", ""), mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit bytes."""
        if any(s in text for s in self.special):
            ids = self.whole.encode(text, allowed_special="all")
        else:
            raw = text.encode()
            alone = b"  " not in raw.translate(ONE_SPACE) and not any(w in raw for w in WIDE_SPACE)
            ids = (self.plain if alone else self.whole).encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, keep: list[str], size: int = 2048, end: int = 0, text: str = "text",
           ids: bool = False) -> DataFrame:
    """keep columns, no (unique), piece, start, length, ids_crc32 and, if asked for, ids of every piece; no shuffle."""
    keep = [c for c in dict.fromkeys(keep) if c in docs.columns and c not in [*MADE, "no"]]
    src = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    fields = [f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep]
    fields += ["no long", "piece int", "start long", "length long", "ids_crc32 long"] + ["ids array<int>"] * ids
    last = np.array([end], dtype="<u4").tobytes()

    def cut(batches):
        enc, no = encoder(path), TaskContext.get().partitionId() << 33
        for b in batches:
            rows, column = b.num_rows, b.column(b.schema.get_field_index("_text"))
            at = 0
            while at < rows:
                texts, n = [], 0
                while at + len(texts) < rows and (not texts or n < AT_ONCE):
                    texts.append(column[at + len(texts)].as_py())
                    n += len(texts[-1])
                row, made = [], {k: [] for k in ("piece", "start", "length", "ids_crc32", "ids")}
                for i, t in enumerate(texts):
                    raw = enc.encode(t) + last
                    total = len(raw) // 4
                    count = -(-total // size)
                    cuts = [0, *(total - size * (count - 1 - k) for k in range(count))]
                    for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                        row.append(at + i)
                        made["piece"].append(k)
                        made["start"].append(s)
                        made["length"].append(e - s)
                        made["ids_crc32"].append(zlib.crc32(memoryview(raw)[4 * s:4 * e]))
                        if ids:
                            made["ids"].append(np.frombuffer(raw, "<u4", e - s, 4 * s).astype("i4"))
                at += len(texts)
                columns = [b.column(b.schema.get_field_index(c)).take(pa.array(row, pa.int64())) for c in keep]
                columns += [pa.array(range(no, no + len(row)), pa.int64()), pa.array(made["piece"], pa.int32())]
                columns += [pa.array(made[k], pa.int64()) for k in ("start", "length", "ids_crc32")]
                columns += [pa.array(made["ids"], pa.list_(pa.int32()))] * ids
                no += len(row)
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "no", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids)

    return src.mapInArrow(cut, ", ".join(fields))


def place(lengths: list[int], size: int, spare: bool = False) -> tuple[list[int], list[int], list[int]]:
    """(bin of each length, its offset there, gap left in each bin) by the sum-of-squares rule, in the given order.

    Putting s into a bin with gap g changes the sum by 2 (n[g - s] - n[g] + 1),
    filling a bin exactly by 1 - 2 n[s], a new bin by 2 n[size - s] + 1; ties go
    to the smaller gap, and to an open bin before a new one.  spare: no new bin
    while an open one has room.  Every length is below size.
    """
    n = np.zeros(size + 1, dtype=np.int64)
    having: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets, gaps = [], [], []
    none = 1 << 60
    for s in lengths:
        open_ = n[s:size]
        change = np.where(open_ > 0, 2 * (n[:size - s] - open_ + 1), none)
        if open_[0]:
            change[0] = 1 - 2 * open_[0]
        i = int(change.argmin())
        if change[i] < none and (spare or change[i] <= 2 * n[size - s] + 1):
            gap = s + i
            b = having[gap].pop()
            n[gap] -= 1
        else:
            gap, b = size, len(gaps)
            gaps.append(size)
        bins.append(b)
        offsets.append(size - gap)
        gaps[b] = gap - s
        if gap > s:
            having[gap - s].append(b)
            n[gap - s] += 1
    return bins, offsets, gaps


def pack(parts: DataFrame, size: int = 2048, group: int = GROUP) -> DataFrame:
    """no, sequence_id, offset of every piece of parts (a written table with no and length).

    A sequence is known by the number of its first piece.
    """
    done = parts.filter(F.col("length") >= size).select("no", F.col("no").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = parts.filter(F.col("length") < size).select("no", "length")
    n, turn, stuck = left.count(), 0, False
    while n:
        groups = -(-n // group)
        last = groups == 1 or stuck

        def fill(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["length", "no"], ascending=[False, True], ignore_index=True)
            bins, offsets, gaps = place(rows["length"].tolist(), size)
            if last:  # full bins stay; the rest, or else all, goes where there is room
                rest = np.flatnonzero(np.array(gaps)[bins] > 0)
                every = np.arange(len(rows))
                for again in (rest, every):
                    b2, o2, g2 = place(rows["length"].to_numpy()[again].tolist(), size, spare=True)
                    if len(g2) + sum(g == 0 for g in gaps) * (again is rest) < len(set(bins)):
                        for at, b, o in zip(again.tolist(), b2, o2):
                            bins[at], offsets[at] = len(gaps) + b, o
                        gaps += g2
            out = pd.DataFrame({"no": rows["no"], "length": rows["length"], "offset": offsets, "bin": bins})
            first = out.loc[out["offset"] == 0].set_index("bin")["no"]
            out["sequence_id"] = out["bin"].map(first)
            out["open"] = np.array(gaps)[bins] > 0
            return out[["no", "length", "sequence_id", "offset", "open"]]

        dealt = left.withColumn("_g", F.pmod(F.xxhash64("no", F.lit(turn)), F.lit(groups)))
        placed = settle(dealt.groupBy("_g").applyInPandas(fill, "no long, length long, sequence_id long, offset long, open boolean"), "packed")
        done = done.unionByName((placed if last else placed.filter(~F.col("open"))).select("no", "sequence_id", "offset"))
        if last:
            break
        left = placed.filter("open").select("no", "length")
        before, n = n, left.count()
        stuck, turn = 2 * n > before, turn + 1
    return done


def pack_documents(docs: DataFrame, path: str, keep: list[str], size: int = 2048, end: int = 0, text: str = "text",
                   ids: bool = False) -> DataFrame:
    """keep columns, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece of every document."""
    parts = settle(pieces(docs, path, keep, size, end, text, ids), "pieces")
    return parts.join(pack(parts, size), "no").drop("no")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids of every sequence; packed is pack_documents(..., ids=True)."""
    at = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.flatten(F.transform(at, lambda x: x["ids"])).alias("ids"))
