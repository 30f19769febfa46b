"""Terms of texts as UTF-8 bytes: runs of the bytes that a pattern leaves in, A-Z lower-cased."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

#: Bytes of one text that are split at once.
PIECE = 4 << 20


def splitter(digits: bool) -> bytes:
    """A table that blanks every ASCII character but letters (and digits, if wanted) and lower-cases A-Z; bytes of other characters stay."""
    keep = set(range(ord("a"), ord("z") + 1)) | set(range(0x80, 0x100)) | (set(range(ord("0"), ord("9") + 1)) if digits else set())
    return bytes(c + 32 if ord("A") <= c <= ord("Z") else c if c in keep else 0x20 for c in range(256))


def pieces(text: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in lists of bounded size."""
    line, at = text.translate(table), 0
    while at < len(line):
        end = line.find(b" ", at + PIECE) if len(line) - at > PIECE else -1
        end = len(line) if end < 0 else end
        yield line[at:end].split()
        at = end


def counts(text: bytes, table: bytes) -> Counter:
    """How often each term occurs."""
    found: Counter = Counter()
    for part in pieces(text, table):
        found.update(part)
    return found
