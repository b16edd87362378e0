"""Terms of whole texts as bytes, for operators that count them."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa


def letters(kept: Callable[[int], bool]) -> bytes:
    """A table for bytes.translate: A-Z lower-cased, ASCII characters that are not kept become spaces."""
    return bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or kept(c) else 32 for c in range(256))


#: terms of letters and characters beyond ASCII; terms of these and digits
WORDS = letters(lambda c: chr(c).isalpha())
WORDS_DIGITS = letters(lambda c: chr(c).isalnum())


#: bytes of a long text whose terms are split at once
LONG = 1 << 20


def split_texts(column: pa.Array, table: bytes) -> Iterator[Iterator[list[bytes]]]:
    """Of every text of a string column its terms in order, in lists from bounded stretches; null has none."""
    for t in column.cast(pa.binary()):
        yield _stretches((t.as_py() or b"").translate(table))


def _stretches(raw: bytes) -> Iterator[list[bytes]]:
    start = 0
    while len(raw) - start > LONG:
        end = raw.rfind(b" ", start, start + LONG)
        end = raw.find(b" ", start + LONG) if end <= start else end  # a term over the length stays whole
        if end < 0:
            break
        yield raw[start:end].split()
        start = end
    yield raw[start:].split()
