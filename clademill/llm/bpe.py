"""Byte-level byte-pair encoding and decoding, exact for rank files.

A piece of text (one match of the splitting pattern) is seen as a string of bytes, each byte the Latin-1 character of
the same number, so that an Aho-Corasick automaton over the vocabulary finds every token at every place in one pass. A
sequence of tokens is what the merges give exactly when every adjacent pair is: the encoder goes from left to right with the
longest token at each place, takes the next shorter one when the pair with the token before is impossible, and goes back
when nothing is left. A place found to lead nowhere is never tried again, so the work is linear in the length.
Whether a pair is possible depends on the two tokens alone and is remembered.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import batched

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from clademill.llm.common import id_text, map_batches

#: Texts longer than this are split into pieces bit by bit, to bound memory.
LONG_TEXT = 1 << 21
#: Pieces whose encoding a worker remembers.
CACHE_PIECES = 300_000

# Unicode White_Space; the letters, numbers and spaces below U+0100.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LATIN = {"letter": "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff", "number": "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe", "space": "\\t-\\r \\x85\\xa0"}


@lru_cache(2)
def _patterns(pattern: str) -> tuple[re.Pattern, re.Pattern]:
    """The splitting pattern for any text, and a faster equal one for texts of characters below U+0100."""
    if pattern != STANDARD:
        return regex.compile(pattern), regex.compile(pattern)

    def alternatives(letter: str, number: str, space: str) -> str:
        return f" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"

    return regex.compile(alternatives(r"\p{L}", r"\p{N}", SPACE)), re.compile(alternatives(**LATIN))


#: Fixed value: the pattern the fast path is written for. Any other pattern is used as it is.
STANDARD = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def splitter(text: str, pattern: str) -> re.Pattern:
    full, fast = _patterns(pattern)
    if text.isascii():
        return fast
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return full
    return fast


def piece_lists(text: str, pattern: str) -> Iterator[list[str]]:
    """The pieces of a text in order, in lists of bounded length."""
    found = splitter(text, pattern)
    if len(text) <= LONG_TEXT:
        yield found.findall(text)
    else:
        for some in batched(found.finditer(text), 100_000):
            yield [m[0] for m in some]


class Encoder:
    """Encodes pieces with the ranks of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.finder = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.finder.add_word(token.decode("latin-1"), (rank, len(token)))
        self.finder.make_automaton()
        self.shorter: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.possible: dict[tuple[int, int], bool] = {}
        for rank in sorted(self.bytes_of):
            self._learn(rank)
        self.possible.clear()

    def _prefix(self, rank: int) -> int:
        """The longest token that is a proper beginning of this one, or -1."""
        if (known := self.shorter.get(rank)) is None:
            token = self.bytes_of[rank]
            known = next((self.ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in self.ranks), -1)
            self.shorter[rank] = known
        return known

    def _learn(self, rank: int) -> None:
        """Finds the merge that makes a token: the two tokens, both of lower rank, into which its bytes are encoded without it."""
        token, left = self.bytes_of[rank], self._prefix(rank)
        while left >= 0:
            right = self.ranks.get(token[len(self.bytes_of[left]) :])
            if right is not None and left < rank and right < rank and self._pair(left, right):
                self.halves[rank] = (left, right)
                self.joined[left, right] = rank
                return
            left = self._prefix(left)

    def _pair(self, left: int, right: int) -> bool:
        """Whether the merges can leave these two tokens side by side.

        The last merges of both are undone in turn, the later one first. Should the two tokens that then touch have a merge of
        a rank below the one undone, it would have come before, and the pair can't be."""
        limit = 1 << 40
        while True:
            if self.joined.get((left, right), limit) < limit:
                return False
            left_parts, right_parts = self.halves.get(left), self.halves.get(right)
            if left_parts and (left > right or not right_parts):
                limit, left = left, left_parts[1]
                if not right_parts and right >= limit:
                    continue
            elif right_parts:
                limit, right = right + 1, right_parts[0]
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        if (known := self.possible.get((left, right))) is None:
            if len(self.possible) > 1_000_000:
                self.possible.clear()
            known = self.possible[left, right] = self._pair(left, right)
        return known

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        longest, size = [-1] * n, [0] * n
        for end, (rank, length) in self.finder.iter(piece.decode("latin-1")):
            start = end - length + 1
            if length > size[start]:
                longest[start], size[start] = rank, length
        taken: list[int] = []
        dead = bytearray(n + 1)
        at, rank = 0, longest[0] if n else -1
        while at < n:
            end = at + len(self.bytes_of[rank])
            if not dead[end] and (not taken or self.compatible(taken[-1], rank)):
                taken.append(rank)
                at = end
                rank = longest[at] if at < n else -1
                continue
            rank = self._prefix(rank)
            while rank < 0:
                dead[at] = 1
                back = taken.pop()
                at -= len(self.bytes_of[back])
                rank = self._prefix(back)
        return taken


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    return Encoder(read_ranks(path))


class Packed(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers, bounded in size."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.coder = encoder(path)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        ids = np.array(self.coder.encode(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


@lru_cache(2)
def packed(path: str) -> Packed:
    return Packed(path)


def encode_text(text: str, path: str, pattern: str) -> bytes:
    """A text's ids as little-endian unsigned 32-bit integers."""
    get = packed(path).__getitem__
    return b"".join(b"".join(map(get, pieces)) for pieces in piece_lists(text, pattern))


def decode_ids(ids: bytes, path: str) -> Iterator[bytes]:
    """The bytes behind packed ids, in parts of bounded length."""
    bytes_of = encoder(path).bytes_of
    whole = np.frombuffer(ids, "<u4")
    for k in range(0, len(whole), 1 << 20):
        yield b"".join(map(bytes_of.__getitem__, whole[k : k + (1 << 20)].tolist()))


def encode_decode(docs: DataFrame, path: str, pattern: str = STANDARD, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encodes every whole text, decodes the ids again, and gives counts and digests.

    One row for each row of `docs`, repeated ones too. Null and empty texts have no token and the digests of the empty string. Columns other than the two named are
    not read, so they may have any name. keep_ids adds `ids`, an array of the ids. Narrow: no shuffle; a worker holds one batch of texts and CACHE_PIECES encodings.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, back, kept = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = encode_text(text, path, pattern)
                n.append(len(ids) // 4)
                sha.append(hashlib.sha256(ids).hexdigest())
                digest = hashlib.sha256()
                for part in decode_ids(ids, path):
                    digest.update(part)
                back.append(digest.hexdigest())
                if keep_ids:
                    kept.append(np.frombuffer(ids, "<u4").astype("<i4"))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_batches(id_text(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
