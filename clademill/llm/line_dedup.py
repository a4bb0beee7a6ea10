"""Line deduplication by winnowing.

A document is the sequence of its lines that aren't blank. Every GRAM lines in a row have a hash, and in every WINDOW hashes in a row
the smallest (the last of equals) is a fingerprint; so any run of GRAM + WINDOW - 1 lines that two places share has a
fingerprint in both. The first place of a fingerprint, by identifier and position, is its original. Each later place is lined up with
the original and the match is extended both ways, line by line; all lines of such a run are deleted from the later place.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademill.llm.common import carried_schema, carried_struct, map_batches, materialise

#: A line is a gram and every gram is selected, so a repeated run of one line is found as well.
GRAM, WINDOW = 1, 1
#: The number that stands for a null identifier; it sorts first.
NO_ID = -(1 << 63)
_SPACE = " \t\n\x0b\x0c\r"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def line_hashes(text: str) -> tuple[np.ndarray, list[int]]:
    """Hashes of a text's lines that aren't blank, without the white space around them, and their numbers among all lines (split at line feeds)."""
    lines = text.split("\n")
    at = [k for k, line in enumerate(lines) if line.strip(_SPACE)]
    return np.array([xxhash.xxh3_64_intdigest(lines[k].strip(_SPACE).encode()) for k in at], np.uint64), at


def fingerprints(hashes: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the selected grams; a document with fewer grams than a window has one."""
    n = len(hashes) - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.zeros(n, np.uint64)
    for j in range(gram):
        grams = (grams ^ (grams >> np.uint64(29))) * _MIX + hashes[j : j + n]
    grams = (grams ^ (grams >> np.uint64(32))) * _MIX
    width = min(window, n)
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    at = np.unique(np.arange(len(view)) + width - 1 - np.argmin(view[:, ::-1], axis=1))
    return at, grams[at]


def _prints(docs: DataFrame, gram: int, window: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [line_hashes(t)[0] for t in batch.column(2).to_pylist()]
            found = [fingerprints(h, gram, window) for h in hashes]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([h.astype("<u8").tobytes() for h in hashes], pa.binary()), pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([v.view(np.int64) for _, v in found], pa.list_(pa.int64()))],
                ["id", "hash", "lines", "at", "prints"],
            )

    return map_batches(docs, run, "id long, hash long, lines binary, at array<int>, prints array<long>")


def extend(lines: np.ndarray, at: int, first_lines: np.ndarray, first: int, gram: int) -> tuple[int, int] | None:
    """Lines [a, b) of the later place that equal the original's around the shared gram; None if the gram itself differs."""
    if len(first_lines) < first + gram or not np.array_equal(lines[at : at + gram], first_lines[first : first + gram]):
        return None
    left = min(at, first)
    same = lines[at - left : at][::-1] == first_lines[first - left : first][::-1]
    a = at - (left if same.all() else int(np.argmin(same)))
    right = min(len(lines) - at, len(first_lines) - first)
    same = lines[at : at + right] == first_lines[first : first + right]
    return a, at + (right if same.all() else int(np.argmin(same)))


def repeated_runs(docs: DataFrame, *, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(id, hash, runs): for each document of (id, hash, text) with repeated runs, their spans in numbers of lines that aren't blank. A document is an identifier and the hash of a text."""
    prints = materialise(_prints(docs, gram, window), "ld-prints")
    places = prints.select("id", "hash", F.explode(F.arrays_zip("at", "prints")).alias("x")).select("id", "hash", F.col("x.at").alias("at"), F.col("x.prints").alias("print"))
    place = F.struct("id", "hash", "at")
    originals = places.groupBy("print").agg(F.min(place).alias("o"), F.max(place).alias("z")).where("o <> z").select("print", F.col("o.id").alias("o_id"), F.col("o.hash").alias("o_hash"), F.col("o.at").alias("o_at"))
    later = places.join(originals, "print").where("id <> o_id or hash <> o_hash or at <> o_at").groupBy("id", "hash", "o_id", "o_hash").agg(F.collect_set(F.struct("at", "o_at")).alias("pairs"))
    lines = prints.groupBy("id", "hash").agg(F.first("lines").alias("lines"))
    both = later.join(lines, ["id", "hash"]).join(lines.select(F.col("id").alias("o_id"), F.col("hash").alias("o_hash"), F.col("lines").alias("o_lines")), ["o_id", "o_hash"]).select("id", "hash", "lines", "o_lines", "pairs")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lines, first_lines, pairs in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                one, two = np.frombuffer(lines, "<u8"), np.frombuffer(first_lines, "<u8")
                spans: list[tuple[int, int]] = []
                done: dict[int, int] = {}  # by diagonal, up to where it is extended
                for at, first in sorted((p["at"], p["o_at"]) for p in pairs):
                    if at + gram <= done.get(at - first, 0):
                        continue
                    if span := extend(one, at, two, first, gram):
                        spans.append(span)
                        done[at - first] = span[1]
                out.append([{"a": a, "b": b} for a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], ["id", "hash", "runs"])

    found = map_batches(both, run, "id long, hash long, runs array<struct<a:int,b:int>>")
    return found.groupBy("id", "hash").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """Deletes later repeated runs of lines.

    One row for each row of `docs`: doc_id, text (what is left; null stays null), n_lines (not blank), n_removed, and `carried`, a struct of the columns named in carry, if any. Deleted lines go with their line feeds; blank lines stay. Rows of the same
    identifier and text are one place and keep or lose the same lines; rows that share an identifier with different texts are documents of their own, in the order of their texts' hashes.
    A null identifier sorts first. Empty input gives no rows. A text of any length is one row; its lines' hashes, 8 bytes each, are in one task. Other columns are not read. Shuffled: fingerprints, line hashes of documents with repeats, and the texts once."""
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("hash"), docs[text_col].alias("text"), *carried_struct(docs, carry))
    runs = repeated_runs(rows.select("id", "hash", F.coalesce("text", F.lit("")).alias("text")), gram=gram, window=window)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, removed = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                full = [k for k, line in enumerate(lines) if line.strip(_SPACE)]
                gone = {full[j] for s in spans or () for j in range(s["a"], min(s["b"], len(full)))}
                kept.append(text if not gone else "\n".join(line for k, line in enumerate(lines) if k not in gone))
                n_lines.append(len(full))
                removed.append(len(gone))
            ids = pa.array([None if x == NO_ID else x for x in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(removed, pa.int64()), *batch.columns[3:]], ["doc_id", "text", "n_lines", "n_removed", *["carried"] * bool(carry)])

    joined = rows.join(runs, ["id", "hash"], "left").select("id", "text", "runs", *["carried"] * bool(carry))
    return map_batches(joined, cut, "doc_id long, text string, n_lines long, n_removed long" + carried_schema(joined))

