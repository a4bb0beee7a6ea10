"""Reading frames of whole sequences as arrays of codon numbers, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clademill.model.codes import CODONS, code

#: A, C, G, T as 0..3 in the order of CODONS' numbers; U is T.
_BASE = np.full(256, 255, np.uint8)
for _k, _b in enumerate("ACGT"):
    _BASE[ord(_b)] = _k
_BASE[ord("U")] = 3
_NUMBER = np.zeros(64, np.int64)
for _k, _c in enumerate(CODONS):
    _NUMBER["ACGT".index(_c[0]) * 16 + "ACGT".index(_c[1]) * 4 + "ACGT".index(_c[2])] = _k


def codons(bases: np.ndarray, frame: int = 0) -> np.ndarray:
    """Numbers (in CODONS) of the whole triplets from an offset."""
    n = max(0, (len(bases) - frame) // 3)
    b = bases[frame : frame + 3 * n].astype(np.int64).reshape(n, 3)
    return _NUMBER[b[:, 0] * 16 + b[:, 1] * 4 + b[:, 2]]


def _bases(dna: pa.Array) -> Iterator[np.ndarray]:
    for seq in dna.to_pylist():
        yield _BASE[np.frombuffer((seq or "").encode("latin-1"), np.uint8)]


def open_frames(df: DataFrame, id_col: str, dna: str, name: str | int = "Universal") -> DataFrame:
    """(id_col, frame, stops, starts, longest): all six frames of each sequence of A, C, G, T; 0..2 as it is, 3..5 reversed and complemented. Frames without a triplet have no row."""
    stop = np.array([a == "*" for a in code(name).amino])
    start = CODONS.index("ATG")
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for k, bases in enumerate(_bases(batch.column(1))):
                for strand, some in enumerate((bases, 3 - bases[::-1])):
                    for frame in range(3):
                        found = codons(some, frame)
                        if len(found):
                            at = np.flatnonzero(stop[found])
                            longest = int(np.diff(np.concatenate(([-1], at, [len(found)]))).max()) - 1
                            row.append(k)
                            out.append((strand * 3 + frame, len(at), int((found == start).sum()), longest))
            columns = np.array(out, np.int64).reshape(len(out), 4).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), *map(pa.array, columns)], [id_col, "frame", "stops", "starts", "longest"])

    return df.select(id_col, dna).mapInArrow(run, f"{id_col} {kind}, frame long, stops long, starts long, longest long")


def codon_counts(df: DataFrame, key: str, dna: str) -> DataFrame:
    """(key, codon, n): codons of the first frame, counted by each task before they are summed."""
    from pyspark.sql import functions as F

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str | None, np.ndarray] = {}
        for batch in batches:
            for k, bases in zip(batch.column(0).to_pylist(), _bases(batch.column(1)), strict=True):
                total[k] = total.get(k, 0) + np.bincount(codons(bases), minlength=64)
        rows = [(k, CODONS[c], int(n)) for k, counts in total.items() for c, n in enumerate(counts) if n]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], [key, "codon", "n"])

    return df.select(F.col(key).cast("string").alias(key), dna).mapInArrow(run, f"{key} string, codon string, n long").groupBy(key, "codon").agg(F.sum("n").alias("n"))
