"""Token counts of sections from one encoding of the whole document.

A document is encoded once, as a whole, and each token keeps the span of characters it came from. Sections are spans of the same text,
and the join of both gives each section its tokens. The rule for a token that crosses a border: it goes to the section that holds most of its
characters, among equals to the one that begins first; a token with no character in any section goes to none. A token that is part of a
character's bytes has that character as its span.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clademill.llm.bpe import STANDARD, encoder, packed, piece_lists
from clademill.llm.common import map_batches

SPANS = "array<struct<section:string,start:int,end:int>>"


def first_body_last(text: Column) -> Column:
    """Sections of a text by its lines: the first line with its line feed, the last line, and what is between; only those that have a character."""
    n = F.length(text)
    first = F.when(F.locate("\n", text) > 0, F.locate("\n", text)).otherwise(n)
    last = F.greatest(first, n - F.locate("\n", F.reverse(text)) + 1)
    last = F.when(F.locate("\n", text) > 0, last).otherwise(n)
    spans = F.array(*(F.struct(F.lit(name).alias("section"), a.cast("int").alias("start"), b.cast("int").alias("end")) for name, a, b in (("first", F.lit(0), first), ("body", first, last), ("last", last, n))))
    return F.filter(spans, lambda s: s["end"] > s["start"])


def token_spans(piece: str, path: str) -> list[tuple[int, int]]:
    """Characters of each token of one piece, from its beginning."""
    coder = encoder(path)
    char_of = np.repeat(np.arange(len(piece)), [len(c.encode()) for c in piece])
    at, out = 0, []
    for rank in np.frombuffer(packed(path)[piece], "<u4").tolist():
        size = len(coder.bytes_of[rank])
        out.append((int(char_of[at]), int(char_of[at + size - 1]) + 1))
        at += size
    return out


def owner(start: int, end: int, begins: list[int], ends: list[int]) -> int:
    """Number of the section that a token belongs to, or -1; sections are in the order of their beginnings."""
    best, most = -1, 0
    for k, (a, b) in enumerate(zip(begins, ends, strict=True)):
        if (common := min(end, b) - max(start, a)) > most:
            best, most = k, common
    return best


def section_counts(text: str, begins: list[int], ends: list[int], path: str, pattern: str = STANDARD) -> tuple[int, list[int]]:
    """Tokens of the text, and of each section. Pieces within one section, and in no other, are counted as a whole; the rest token by token."""
    known = packed(path).__getitem__
    total, counts, at = 0, [0] * len(begins), 0
    edges = np.unique(np.array([*begins, *ends], np.int64))
    cover = [[k for k, (a, b) in enumerate(zip(begins, ends, strict=True)) if a <= e < b] for e in edges.tolist()]
    for pieces in piece_lists(text, pattern):
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        tokens = np.fromiter((len(known(p)) for p in pieces), np.int64, len(pieces)) // 4
        stop = at + np.cumsum(size)
        begin = stop - size
        left, right = np.searchsorted(edges, begin, "right"), np.searchsorted(edges, stop, "left")
        part = np.bincount(np.where(left == right, left, 0), np.where(left == right, tokens, 0), len(edges) + 1).astype(np.int64)
        for e, n in enumerate(part[1:].tolist()):
            if n and cover[e]:  # of sections that overlap, the one that begins first holds as much of each token as any
                counts[cover[e][0]] += n
        for k in np.flatnonzero(left != right).tolist():
            for a, b in token_spans(pieces[k], path):
                if (to := owner(int(begin[k]) + a, int(begin[k]) + b, begins, ends)) >= 0:
                    counts[to] += 1
        total += int(tokens.sum())
        at = int(stop[-1]) if len(stop) else at
    return total, counts


def token_counts(docs: DataFrame, path: str, pattern: str = STANDARD, *, sections: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, doc_tokens): one row for each section of each row of `docs`.

    sections: a column of SPANS in characters of the text, by default first_body_last. A null or empty text, and a text without sections, has no row; spans are cut to the text, and empty or
    null ones left out. Repeated rows and null identifiers are kept as they are. Other columns are not read. Narrow: no shuffle."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), (first_body_last(text) if sections is None else sections).cast(SPANS).alias("spans"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                n = len(text)
                some = [(s["start"], min(s["end"], n), s["section"]) for s in spans or () if s and s["start"] is not None and s["end"] is not None]
                some = sorted((max(0, a), b, name or "") for a, b, name in some if max(0, a) < b)
                if some:
                    total, counts = section_counts(text, [x[0] for x in some], [x[1] for x in some], path, pattern)
                    out.extend((doc, name, a, b, c, total) for (a, b, name), c in zip(some, counts, strict=True))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "section", "start", "end", "n_tokens", "doc_tokens"])

    return map_batches(rows, run, "doc_id long, section string, start int, end int, n_tokens long, doc_tokens long")
