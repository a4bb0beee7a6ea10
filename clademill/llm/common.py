"""What the operators of this subpackage share: input columns, shared storage, batch sizes."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that an operator works on at once; a single longer row is a batch by itself.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
#: The white space of the word and line operators: space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns an operator reads, under fixed names, so that no other column can clash; null text is empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of BATCH_ROWS and BATCH_BYTES at most, so that what is made of a batch is bounded however long its texts are."""
    for batch in batches:
        at = 0
        while at < batch.num_rows or not batch.num_rows:
            part = batch.slice(at, BATCH_ROWS)
            while part.num_rows > 1 and part.nbytes > BATCH_BYTES:
                part = part.slice(0, part.num_rows // 2)
            yield part
            at += part.num_rows
            if not batch.num_rows:
                break


def _give_back() -> None:
    """Free memory of this worker goes back to the system, as the worker lives on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(sliced(batches))
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While a job of ours runs, Spark hands rows to Python in batches no larger than an operator uses; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if 0 < int(before) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Of DataFrames made meanwhile, the shuffle files go as soon as a job over them has ended; for those whose rows are written at once. The session's own setting comes back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application that the driver and all executors see, removed when it ends: in spark.checkpoint.dir of the session; where that is unset, in the
    checkpoint folder of its context or in the warehouse. A temporary folder is for local mode alone."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base and context.master.startswith("local") and not context.master.startswith("local-cluster"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="clademill-"))
        base = context.getCheckpointDir()
    path = f"{(base or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/clademill-{context.applicationId}"
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(context._jsc.hadoopConfiguration())
    if not store.exists(folder):
        store.mkdirs(folder)
        store.deleteOnExit(folder)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows as Parquet into the shared folder and reads them again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_fold(id_col: Column | str, mod: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo `mod`; a null id falls in the fold of the empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod



def carried_struct(docs: DataFrame, carry: tuple[str, ...]) -> list[Column]:
    """The columns to carry along as one struct, so that none of their names can clash; nothing without any."""
    return [F.struct(*(docs[c] for c in carry)).alias("carried")] if carry else []


def carried_schema(df: DataFrame) -> str:
    return f", carried {df.schema['carried'].dataType.simpleString()}" if "carried" in df.columns else ""
