"""Media columns: payloads kept as lossless grey-scale images in archives, read by a data source of Spark.

An archive is a ZIP file of stored members, each a PNG of 64 samples a line, 8 bits each. The data source plans
partitions as byte ranges of archives; the task that owns a range reads the archive's directory and takes the members that begin in
its range, one by one by their offsets, trying a member again by itself when a read or its checksum fails.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from clademill.llm.common import id_text, map_batches, shared_dir

#: Samples in a line of an image; a payload is padded to a multiple.
WIDTH = 64
#: Fixed value: what a PNG begins with.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of archive in one partition.
RANGE_BYTES = 8 << 20
#: Bytes of an archive before a task begins another.
ARCHIVE_BYTES = 64 << 20
MEMBERS_BATCH = 256


def padded(raw: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of WIDTH."""
    return raw + bytes(-len(raw) % WIDTH or (WIDTH if not raw else 0))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """An image of 8-bit grey samples, WIDTH a line, without filters."""
    lines = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image that to_png made; ValueError if it is damaged."""
    if image[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, data, shape = 8, b"", (0, 0)
    while at + 12 <= len(image):
        (size,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack_from(">I", image, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("a filter that to_png doesn't use")
    return lines[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Lines, mean and standard deviation of the samples, mean step between neighbours, and the sixteen-bin histogram."""
    x = np.frombuffer(payload, np.uint8)
    total = int(x.sum(dtype=np.int64))
    square = int((x.astype(np.int32) ** 2).sum(dtype=np.int64))
    mean = total / len(x)
    step = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64)) / max(1, len(x) - 1)
    bins = np.bincount(x >> 4, minlength=16)
    return f"lines={len(x) // WIDTH};mean={mean:.4f};sd={max(0.0, square / len(x) - mean * mean) ** 0.5:.4f};step={step:.4f};hist={','.join(map(str, bins.tolist()))}"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The store a path is in, and the path in it; a path without a scheme is local."""
    where = urlparse(path)
    if where.scheme in ("", "file"):
        return pafs.LocalFileSystem(), where.path
    return pafs.FileSystem.from_uri(path)


class _Writer:
    """One archive after another in a folder; a file gets its name from the task's own random number, so attempts never share one."""

    def __init__(self, folder: str) -> None:
        self.store, self.folder = file_system(folder)
        self.root = folder
        self.done: list[tuple[str, int, int]] = []
        self.name = ""

    def add(self, name: str, body: bytes) -> None:
        if not self.name:
            self.name = f"{uuid.uuid4().hex}.zip"
            self.store.create_dir(self.folder, recursive=True)
            self.out = self.store.open_output_stream(f"{self.folder}/{self.name}")
            self.zip = zipfile.ZipFile(_Counted(self.out), "w", zipfile.ZIP_STORED, allowZip64=True)
            self.members = self.bytes = 0
        self.zip.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body)
        self.members += 1
        self.bytes += len(body) + 200
        if self.bytes >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.name:
            self.zip.close()
            self.out.close()
            self.done.append((f"{self.root}/{self.name}", self.members, self.store.get_file_info(f"{self.folder}/{self.name}").size))
            self.name = ""


class _Counted(io.RawIOBase):
    """A stream that only goes forward, as zipfile wants it."""

    def __init__(self, out: pa.NativeFile) -> None:
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data: bytes) -> int:
        self.out.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        pass


def write_archives(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """Stores every text as a member of an archive in `folder`; gives the archives of the tasks that ended well, with their sizes.

    A member's name is `<row>-<identifier>-<bytes of the text>`, the identifier empty where it is null. Only the list of archives, one for each task and 64 MB, comes to the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, row = _Writer(folder), 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                writer.add(f"{row}_{'' if doc is None else doc}_{len(raw)}", to_png(padded(raw)))
                row += 1
        writer.close()
        paths, members, sizes = zip(*writer.done, strict=True) if writer.done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(members, pa.int64()), pa.array(sizes, pa.int64())], ["path", "members", "size"])

    made = map_batches(id_text(docs, id_col, text_col), run, "path string, members long, size long")
    return sorted((r.path, r.size) for r in made.collect())


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.listing = options["listing"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.attempts = int(options.get("attempts", 4))

    def partitions(self) -> list[InputPartition]:
        """Byte ranges over the archives in the listing. No archive is opened here."""
        found = [line.rsplit(" ", 1) for line in self.listing.split("\n") if line]
        return [_Range(path, k, min(k + self.range_bytes, int(size))) for path, size in found for k in range(0, int(size), self.range_bytes)] or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        members = self._again(lambda: self._directory(part), "directory")
        for k in range(0, len(members), MEMBERS_BATCH):
            some = members[k : k + MEMBERS_BATCH]
            bodies = [self._again(lambda m=m: self._member(part.path, m), m.filename) for m in some]
            names = [m.filename.split("_") for m in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(x[1]) if x[1] else None for x in names], pa.int64()), pa.array([int(x[2]) for x in names], pa.int64()), pa.array([m.header_offset for m in some], pa.int64()), pa.array(bodies, pa.binary())],
                ["doc_id", "n_bytes", "member_offset", "media"],
            )

    @staticmethod
    def _directory(part: _Range) -> list[zipfile.ZipInfo]:
        store, path = file_system(part.path)
        with store.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
            return [m for m in archive.infolist() if part.start <= m.header_offset < part.end]

    @staticmethod
    def _member(path: str, member: zipfile.ZipInfo) -> bytes:
        """A member's bytes, read at its own offset and held against the directory's checksum."""
        store, inner = file_system(path)
        with store.open_input_file(inner) as file:
            head = file.read_at(30, member.header_offset)
            name, extra = struct.unpack_from("<HH", head, 26)
            body = file.read_at(member.compress_size, member.header_offset + 30 + name + extra)
        if len(body) != member.file_size or zlib.crc32(body) != member.CRC:
            raise ValueError(f"{path}: member at {member.header_offset} is damaged")
        return body

    def _again(self, step, what: str):
        """Runs one step up to `attempts` times; other members are not read again."""
        for k in range(self.attempts):
            try:
                return step()
            except (OSError, ValueError, struct.error, zipfile.BadZipFile) as error:
                if k + 1 == self.attempts:
                    raise RuntimeError(f"{what}: {error}") from error
                time.sleep(0.1 * 2**k)


class ArchiveSource(DataSource):
    """format("media_archive"); option listing: lines of `path size`; rangeBytes; attempts."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, member_offset long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, archives: list[tuple[str, int]], *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").options(listing="\n".join(f"{p} {n}" for p, n in archives), rangeBytes=range_bytes).load()


def describe(media: DataFrame) -> DataFrame:
    """Digests and features of media rows (doc_id, n_bytes, media): the payload is taken from the stored form."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, image in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                payload = from_png(image)
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), features(payload)))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], DESCRIBED)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(media.select("doc_id", "n_bytes", "media"), run, schema)


DESCRIBED = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Stores every whole text losslessly as an image in archives, reads the archives back and describes what was read.

    One row for each row of `docs`, repeated rows and null identifiers too; null texts are empty and become one line of zeros. Other columns are not read. Empty input
    gives no rows. No shuffle: each task writes archives of its own into the shared folder, and the readers take byte ranges of them."""
    spark = docs.sparkSession
    archives = write_archives(docs, folder or f"{shared_dir(spark)}/media-{uuid.uuid4().hex}", id_col=id_col, text_col=text_col)
    return describe(read_archives(spark, archives))
