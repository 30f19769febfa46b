"""BPE encoding and decoding by per-prefix dynamic programming.

A merge-ranked BPE code has one valid last token for every prefix of a word:
the token ``t`` ending there for which ``last[prefix before t]`` and ``t`` are
*compatible*, that is, no merge of their parts would ever cross the boundary
between them.  An automaton over the vocabulary (Aho-Corasick, which follows
suffix links) lists the tokens that end at each position; the pair test picks
the one that is valid; back-pointers from the word's end give the exact ids.
Words are what the tokenizer file's normaliser and splitter make of a text; plain
letters, which both leave as they are, do not go through them.

Edge cases: a null text is encoded as the empty text (no ids, decoded ``""``);
texts of any length are encoded whole; repeated rows stay repeated; extra
columns named in ``keep`` are passed through, others are left behind.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .shared import alone

#: Bytes of words and ids that a worker remembers; an older generation is dropped beyond that (speed only).
CACHE_BYTES = 96 << 20
#: Pair tests that a worker remembers (speed only).
FITS = 200_000
#: Below this code point text in lower case is normal as it is, and a run of letters is one piece.
_SIMPLE = "\u0250"
_OTHERS = re.compile("[\u0250-\U0010ffff]")

# Fixed values of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_alphabet() -> list[str]:
    """The character that stands for each byte."""
    shown = set(_PRINTABLE)
    others = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}
    return [chr(others.get(b, b)) for b in range(256)]


def _simple(text: str) -> bool:
    """Whether all of a text lies below ``_SIMPLE``; the quick answers come first."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _OTHERS.search(text)
    return True


class Words(dict):
    """word -> its ids as little-endian uint32 bytes; two generations bound its size."""

    def __init__(self, make, most: int = CACHE_BYTES):
        super().__init__()
        self.make, self.most, self.old, self.size = make, most, {}, 0

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        if len(word) < 40 and word[-1:] not in ".,":  # a word with a stop is made of the word without it
            if self.size > self.most // 2:
                self.old, self.size = dict(self), 0
                self.clear()
            self[word] = found
            self.size += 200 + len(word) + len(found)  # with what Python needs for both and their entry
        return found


class Bpe:
    """Encoder and decoder of one tokenizer file (``tokenizers`` JSON, BPE with an end-of-word suffix)."""

    END = "￿"  # stands for the end-of-word suffix in the automaton's strings

    def __init__(self, spec: str, remember: int | None = None):
        spec = json.loads(spec)
        model = spec["model"]
        library = Tokenizer.from_str(json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}))
        if model["type"] != "BPE" or not model.get("end_of_word_suffix"):
            raise ValueError("only BPE vocabularies with an end-of-word suffix are supported")
        self.suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for text, k in [*vocab.items(), *self.special.items()]:
            self.tokens[k] = text
        n = len(self.tokens)
        self.left, self.right, self.rank = list(range(n)), list(range(n)), [-1] * n
        self.merged: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.left[z], self.right[z], self.rank[z] = x, y, r
            self.merged[x, y] = r
        self.automaton = ahocorasick.Automaton()
        for text, k in vocab.items():
            ends = text.endswith(self.suffix)
            plain = text.removesuffix(self.suffix) + self.END if ends else text
            self.automaton.add_word(plain, (k, len(plain), self.rank[k] < 0, {}))
        self.automaton.make_automaton()
        self.alphabet = byte_alphabet()
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known = 0
        self.stops = {c: self._word(c) for c in ".,"}
        most = CACHE_BYTES if remember is None else remember
        self.chunks = Words(self._chunk, most // 4)
        self.simple = Words(self._simple_chunk, most)

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``a`` then ``b`` stay two tokens: no merge across their boundary comes before those that made them."""
        left, right, rank, merged = self.left, self.right, self.rank, self.merged
        # The right spine of a and the left spine of b are undone from the last merge backwards. A merge across the
        # boundary wins if its rank is below that of the merges of either part that are still to come: a tie in rank goes
        # to the pair further left, which is the one in a, then the crossing one, then the one in b.
        in_a = in_b = 1 << 60
        x, y = a, b
        while True:
            r = merged.get((x, y))
            if r is not None and r < in_a and r <= in_b:
                return False
            if rank[x] > rank[y] or (rank[x] == rank[y] >= 0):
                in_a, x = rank[x], right[x]
            elif rank[y] >= 0:
                in_b, y = rank[y], left[y]
            else:
                return True

    def _fits(self, a: int, b: int, known: dict[int, bool]) -> bool:
        """``compatible``, remembered with the second token for a bounded number of pairs."""
        if self.known >= FITS:
            self.known = 0
            for *_, held in self.automaton.values():
                held.clear()
        self.known += 1
        found = known[a] = self.compatible(a, b)
        return found

    def _word(self, word: str) -> bytes:
        """A piece as the splitter gives it, before its bytes are replaced."""
        return self._coded(word if word.isascii() and word.isprintable() else "".join([self.alphabet[b] for b in word.encode()]))

    def _coded(self, text: str) -> bytes:
        """A piece in the alphabet of bytes."""
        n = len(text) + 1
        last = [-1] * (n + 1)  # the last token of each prefix, -1 where none is known
        start = [0] * (n + 1)
        for end, (token, length, base, fits) in self.automaton.iter(text + self.END):  # longest first at each end
            end += 1
            if last[end] >= 0:
                continue
            before = end - length
            if before:
                prior = last[before]
                if not base:  # the shortest token is what is left when none of the longer ones is valid
                    if prior < 0:
                        continue
                    ok = fits.get(prior)
                    if ok is None:
                        ok = self._fits(prior, token, fits)
                    if not ok:
                        continue
                start[end] = before
            last[end] = token
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = start[at]
        ids.reverse()
        return array("I", ids).tobytes()

    def _simple_chunk(self, chunk: str) -> bytes:
        """A run without white space of a simple text in lower case."""
        if chunk.isalpha():
            return self._word(chunk)
        tail = chunk[-1]
        if tail in ".," and (head := chunk[:-1]).isalpha():
            return self.simple[head] + self.stops[tail]
        return self._chunk(chunk)

    def _chunk(self, chunk: str) -> bytes:
        """A run without white space, cut into the splitter's pieces."""
        low = chunk.lower()
        if not _OTHERS.search(low):
            if low.isalpha():
                return self._word(low)
            head, tail = low[:-1], low[-1]
            if tail in ".," and head.isalpha():
                return self.chunks[head] + self.stops[tail]
        if low.isascii():
            return b"".join([self.chunks[w] if w.isalpha() else self._word(w) for w in self.pieces.findall(low)])
        return self._any(chunk)

    def _any(self, text: str) -> bytes:
        """Any text: normalised and split as the tokenizer's file says."""
        return b"".join([self._coded(piece) for piece, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))])

    def _plain(self, text: str) -> bytes:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for str.split() only
            return self._any(text)
        if _simple(text):
            return b"".join(map(self.simple.__getitem__, text.lower().split()))
        return b"".join(map(self.chunks.__getitem__, text.split()))

    def encode(self, text: str | None) -> bytes:
        """All ids of a text, as little-endian uint32 bytes."""
        if not text:
            return b""
        if self.cut is None or "<|" not in text:
            return self._plain(text)
        return b"".join(np.array([self.special[x]], "<u4").tobytes() if k % 2 else self._plain(x) for k, x in enumerate(self.cut.split(text)))

    def decode(self, ids) -> str:
        """The tokens of ``ids`` joined by spaces, which is what a file without a decoder asks for."""
        return " ".join(map(self.tokens.__getitem__, ids))


def loaded(spec: str, remember: int | None = None) -> Bpe:
    """The worker's encoder of ``spec``, made once; ``remember``: bytes of words that it keeps (speed only)."""
    return alone(("bpe", hash(spec)), lambda: Bpe(spec, remember))


def joined(lists: pa.ListArray, tokens: pa.StringArray) -> pa.Array:
    """The tokens of each list of ids, joined by spaces; null for a null list."""
    sizes = pa.compute.fill_null(lists.value_lengths(), 0)
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum(sizes.to_numpy(), out=offsets[1:])
    out = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(offsets), tokens.take(lists.flatten())), " ")
    return pa.compute.if_else(lists.is_valid(), out, pa.scalar(None, pa.string())) if lists.null_count else out


def _kept(df: DataFrame, keep: list[str], new: list[T.StructField]) -> T.StructType:
    return T.StructType([df.schema[c] for c in keep] + new)


def encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None, remember: int | None = None) -> DataFrame:
    """Adds ``ids_col`` (array<int>) to the columns in ``keep`` (default: all but the text). The tokenizer's file is read on the driver and travels with the tasks."""
    spec = Path(tokenizer_path).read_text(encoding="utf-8")
    keep = [c for c in df.columns if c not in (text_col, ids_col)] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec, remember)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for at in range(0, batch.num_rows, 512):
                raw = [bpe.encode(x) for x in texts.slice(at, 512).to_pylist()]
                offsets = np.zeros(len(raw) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in raw], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=[*keep, ids_col])

    out = _kept(df, keep, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    return df.select(*keep, text_col).mapInArrow(run, out)


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "decoded", remember: int | None = None) -> DataFrame:
    """Adds ``text_col``: the text of the ids. Null ids give a null text, no ids the empty text."""
    spec = Path(tokenizer_path).read_text(encoding="utf-8")
    keep = [c for c in df.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(loaded(spec, remember).tokens, pa.string())
        at = keep.index(ids_col)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, joined(part.column(at), tokens)], names=[*keep, text_col])

    return df.select(*keep).mapInArrow(run, _kept(df, keep, [T.StructField(text_col, T.StringType())]))
