"""Exact deduplication by sorting contents.

Rows are range-partitioned and sorted by their normalised bytes, so equal texts are neighbours, and each row is compared in
full with the one before it. The splitters that Spark samples are taken over a bounded key (the first characters and the digest of the
normalised text, then rank and identifier), so what the driver holds doesn't grow with the texts, and a group of
copies of any size is spread over as many ranges as it needs. A group that crosses a border is put together from one row for
each end of each partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademill.llm.common import ASCII_SPACE, id_text, map_batches, materialise

#: Characters of the normalised text in the sort key; the rest of the order comes from the digest.
KEY_CHARS = 16
GROUP_SCHEMA = "doc_id long, text_sha256 string, n_points long, first_id long, first_points long, run_size long, edge boolean"


def normalised(column: str = "text") -> F.Column:
    """The text without the characters of [\\x20\\x09-\\x0D]."""
    return F.translate(F.col(column), ASCII_SPACE, "")


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> rows with the first row and the size of their run of equal texts; runs at either end of the partition are marked.

    A run's rows wait, without their texts, until the run ends or RUN_ROWS are there; the parts of such a long run are marked as edges too and are put together later."""
    names = [f.split()[0] for f in GROUP_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    run: list[tuple] = []
    last, digest, first = None, "", True
    out: list[tuple] = []

    def close(edge: bool) -> None:
        if run:
            out.extend((i, digest, n, run[0][0], run[0][1], len(run), edge) for i, n in run)
            run.clear()

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * len(names)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    split = False
    for batch in batches:
        for doc, sha, text, points in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if run and sha == digest and text == last:
                if len(run) >= RUN_ROWS:
                    close(True)
                    split = True
            else:
                if run:
                    close(first or split)
                    first = split = False
                last, digest = text, sha
            run.append((doc, points))
        if len(out) >= 10_000:
            yield flush()
    close(True)
    yield flush()


#: Rows of one run that wait in memory.
RUN_ROWS = 100_000


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Of the rows whose normalised texts are equal, the one with the most code points, then the smallest identifier, stays.

    One row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised UTF-8). Null texts count as empty; empty texts are one group. Of
    repeated rows (same identifier and text) all count in group_size and all carry the same keep_id; `kept` is true for each row whose identifier is keep_id. A null identifier sorts
    first. Other columns are not read. Empty input gives no rows. One range shuffle of the texts; the borders join is over at most a few rows for each partition.
    """
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col).withColumn("norm", normalised()).select(
        "doc_id", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "norm", F.length("text").cast("long").alias("n_points"), F.substring("norm", 1, KEY_CHARS).alias("head")
    )
    key = [F.col("head"), F.col("sha"), F.col("n_points").desc(), F.col("doc_id")]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, *key).sortWithinPartitions("head", "sha", "norm", F.col("n_points").desc(), "doc_id").select("doc_id", "sha", "norm", "n_points")
    runs = materialise(map_batches(ordered, _runs, GROUP_SCHEMA), "content-runs")
    # At most two runs of each partition and the parts of very long runs: bounded by partitions and rows / RUN_ROWS.
    ends = runs.where("edge").groupBy("text_sha256", "first_id", "first_points", "run_size").agg(F.count(F.lit(1)).alias("rows"))
    whole = ends.groupBy("text_sha256").agg(
        F.min_by("first_id", F.struct(-F.col("first_points"), F.col("first_id"))).alias("whole_first"),
        F.sum("rows").alias("whole_size"),
    )
    joined = runs.where("edge").join(whole, "text_sha256").withColumns({"first_id": F.col("whole_first"), "run_size": F.col("whole_size")}).drop("whole_first", "whole_size")
    return runs.where("not edge").unionByName(joined).select(
        "doc_id", F.col("first_id").alias("keep_id"), F.col("run_size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("first_id")).alias("kept"), "text_sha256"
    )
