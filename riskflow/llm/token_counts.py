"""Token counts by prefix dynamic programming (operator 10).

The byte-level BPE encoding of a pretoken is computed prefix by prefix: the
encoding of w[:i] ends in the one token t that is a suffix of w[:i] and stays
apart from the last token of w[:i - len(t)].  So one pass over a pretoken gives
the exact count at every prefix; the counts of a text are sums over its
pretokens.  The table of a text (pretoken ends and counts) answers how many
tokens a prefix has, and where a budget cuts, by looking at one pretoken only.

Defined cases: a null text is the empty text with 0 tokens; special strings
count as one token each, as the library does by default; repeated rows are
counted each; an empty table gives an empty result; other columns pass through.
"""
from __future__ import annotations

import bisect
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: the public split pattern of byte-level BPE vocabularies (fixed value)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: pretokens of which every prefix is one pretoken
RUN = regex.compile(r" ?(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)")
SPACE = regex.compile(r"\s+")
#: bound on the words remembered by one worker; it is emptied when full
REMEMBERED = 500_000


def _byte_of() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PrefixCounter:
    """Exact counts of one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE vocabulary is needed")
        byte = _byte_of()
        to_bytes = lambda s: bytes(byte[c] for c in s)
        self.tokens = {to_bytes(t) for t in spec["model"]["vocab"] if all(c in byte for c in t)}
        self.longest = max(map(len, self.tokens))
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(to_bytes(a), to_bytes(b)): r for r, (a, b) in enumerate(merges)}
        special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = regex.compile(PATTERN)
        self.made = {a + b: (r, (a, b)) for (a, b), r in self.rank.items()}
        self.known: dict[str, int] = {}
        self.state: dict[bytes, tuple[int, bytes]] = {}
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.spines: dict[bytes, tuple[list, list]] = {}

    def _spine(self, token: bytes, right: bool) -> list[tuple[bytes, int, int]]:
        """(part, rank that makes it, rank that uses it up) along the right or left edge of a token's merges."""
        out, used = [], 1 << 60
        while True:
            made, parts = self.made.get(token, (-1, None))
            out.append((token, made, used))
            if parts is None:
                return out
            token, used = parts[1 if right else 0], made

    def stay_apart(self, a: bytes, b: bytes) -> bool:
        """Whether the tokens a, b are the encoding of a + b: no merge reaches over the border.

        Merges run by rank, from the left; parts x, y at the border merge if
        their merge's turn comes while both are there.
        """
        known = self.apart.get((a, b))
        if known is None:
            if len(self.apart) >= REMEMBERED:
                self.apart.clear()
            for t in (a, b):
                if t not in self.spines:
                    self.spines[t] = self._spine(t, True), self._spine(t, False)
            known = True
            for x, made_x, used_x in self.spines[a][0]:
                for y, made_y, used_y in self.spines[b][1]:
                    k = self.rank.get((x, y))
                    if k is not None and max(k, made_x, made_y) < used_x and (max(k, made_x, made_y) < used_y or k == used_y):
                        known = False
            self.apart[a, b] = known
        return known

    def prefixes(self, word: bytes) -> list[int]:
        """Counts at every prefix of a pretoken, from 0 to its length."""
        last, counts = [b""], [0]
        tokens, apart = self.tokens, self.stay_apart
        for i in range(1, len(word) + 1):
            for n in range(min(i, self.longest), 0, -1):
                t = word[i - n:i]
                if t in tokens and (n == i or apart(last[i - n], t)):
                    last.append(t)
                    counts.append(counts[i - n] + 1)
                    break
            else:
                raise ValueError("the vocabulary lacks single bytes")
        return counts

    def _last(self, word: bytes) -> tuple[int, bytes]:
        """(count, last token) of a short pretoken; words share the table of their prefixes."""
        state, tokens, apart = self.state, self.tokens, self.stay_apart
        i = len(word) - 1
        while i and word[:i] not in state:
            i -= 1
        for i in range(i + 1, len(word) + 1):
            p = word[:i]
            for n in range(min(i, self.longest), 0, -1):
                t = p[i - n:]
                if t in tokens:
                    if n == i:
                        state[p] = 1, t
                        break
                    count, last = state.get(p[:i - n]) or self._last(p[:i - n])
                    if apart(last, t):
                        state[p] = count + 1, t
                        break
        return state[word]

    def count(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            raw = word.encode()
            if len(raw) > 64:
                return self.prefixes(raw)[-1]
            if len(self.state) >= 2 * REMEMBERED:
                self.state.clear()
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[word] = self._last(raw)[0]
        return n

    def _plain(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            if m.start() > at:
                yield text[at:m.start()], False
            yield m.group(), True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def table(self, text: str) -> tuple[list[int], list[int]]:
        """(ends, counts): code point end of every pretoken, tokens up to it."""
        sizes, counts, known = [], [], self.known.get
        for part, special in self._plain(text):
            found = [part] if special else self.split.findall(part)
            sizes += map(len, found)
            counts += [1] if special else [known(w) or self.count(w) for w in found]
        return list(accumulate(sizes)), list(accumulate(counts))

    def total(self, text: str) -> int:
        return self.table(text)[1][-1] if text else 0

    def at(self, text: str, table: tuple[list[int], list[int]], cut: int) -> int:
        """Exact count of text[:cut]: the table up to the last safe end, and the prefix of what follows."""
        ends, counts = table
        i = bisect.bisect_right(ends, cut)
        # a run of white space splits by what follows it, and a special string may be cut
        while i > 0 and text[ends[i - 1] - 1].isspace():
            i -= 1
        start, n = (ends[i - 1], counts[i - 1]) if i else (0, 0)
        return n + sum(self.prefixes(w.encode())[-1] for w in self.split.findall(text[start:cut])) \
            if not (i < len(ends) and ends[i] <= cut) else n + self.total(text[start:cut])

    def cut(self, text: str, table: tuple[list[int], list[int]], budget: int) -> int:
        """Code points of the longest prefix with at most budget tokens."""
        ends, counts = table
        if not ends or counts[-1] <= budget:
            return len(text)
        # the pretoken over the budget and the one after it can still have prefixes within
        for i in range(min(bisect.bisect_right(counts, budget) + 1, len(ends) - 1), -1, -1):
            low = ends[i - 1] if i else 0
            first, n, end = self._inside(text, table, i)
            for c in range(ends[i], low, -1):
                if (n[end - c] if c >= first else self.at(text, table, c)) <= budget:
                    return c
        return 0

    def _inside(self, text: str, table: tuple[list[int], list[int]], i: int) -> tuple[int, list[int], int]:
        """(first, n, end): n[end - c] is the count of text[:c] for every c from first to the end of pretoken i, by one pass.

        A prefix of a run of one class is itself one pretoken, and so is one of
        a run of white space; first is past the end where no such run is.
        """
        ends, counts = table
        j, end = i, ends[i]
        w = text[ends[i - 1] if i else 0:end]
        first = 2 if w[0] == " " else 1  # a space alone belongs to the white space before it
        if SPACE.fullmatch(w):
            while j > 0 and text[ends[j - 1] - 1].isspace():
                j -= 1
            w, first = text[ends[j - 1] if j else 0:end], 1
            one = SPACE.fullmatch(w)
        else:
            one = RUN.fullmatch(w) and not (self.special and self.special.fullmatch(w))
        if not one:
            return end + 1, [], end
        n, before = self.prefixes(w.encode()), counts[j - 1] if j else 0
        at = accumulate(len(x.encode()) for x in w)
        return end - len(w) + first, [before + n[k] for k in at][::-1], end


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, path: str, keep: list[str], text: str = "text", budget: int | None = None,
                 tables: bool = False) -> DataFrame:
    """keep columns, n_bytes, n_tokens of every whole text, without a shuffle.

    budget: also cut, the code points of the longest prefix within that many
    tokens.  tables: also ends and counts, the prefix table.  path is the
    vocabulary file, which every worker reads once.
    """
    made = ["n_bytes", "n_tokens"] + ["cut"] * (budget is not None) + ["ends", "counts"] * tables
    keep = [c for c in dict.fromkeys(keep) if c in docs.columns and c not in made]
    src = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    fields = [f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep] + ["n_bytes long", "n_tokens long"]
    fields += ["cut long"] * (budget is not None) + ["ends array<int>", "counts array<int>"] * tables

    def run(batches):
        c = counter(path)
        for b in batches:
            texts = b.pop("_text")
            b["n_bytes"] = [len(t.encode()) for t in texts]
            out = {k: [] for k in ("n_tokens", "cut", "ends", "counts")}
            for t in texts:  # one text at a time: a table is larger than its text
                ends, counts = c.table(t)
                out["n_tokens"].append(counts[-1] if counts else 0)
                if budget is not None:
                    out["cut"].append(c.cut(t, (ends, counts), budget))
                if tables:
                    out["ends"].append(ends)
                    out["counts"].append(counts)
            for k, column in out.items():
                if len(column) == len(texts):
                    b[k] = column
            yield b[[*keep, *made]]

    return src.mapInPandas(run, ", ".join(fields))
