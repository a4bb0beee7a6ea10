"""Repeated strings across a corpus by induced sorting of suffixes.

Not every suffix is sorted from scratch. As in induced sorting, a sparse set of seed suffixes is sorted first, and the order of
the others follows from theirs. The seeds are chosen so that each string of LENGTH bytes has exactly one, at a place that its own bytes decide: the
smallest hash of eight bytes among its first REACH places. Two equal strings therefore have their seeds at the same offset, and
only suffixes whose seeds begin alike need to be compared.

1. Seeds whose first bytes occur once in the corpus are dropped, with the help of a bitmap.
2. The other seed suffixes are sorted externally by Spark: each task keeps sorted runs on disk and merges them through a priority queue, so a shard
   may be far larger than memory. Equal contexts of one batch travel as one.
3. Neighbours in that order give the common prefix values. From there suffixes are induced to the left, a byte at a time: the tuple of a
   suffix (class of the bytes to the left of its seed, rank of its seed) gives the tuple of the one that begins a byte earlier, and its
   common prefix with its neighbour is the bytes gone left plus the smallest prefix value between the two seeds. Where that reaches LENGTH, a string is repeated.
   Seeds of a key are induced in arrays while they are few. Those of a key with many go through queues on disk, one for each byte to the left: a pass over the tuples in
   their order deals them out with the least prefix value since the last one of the same byte, and each queue is induced in turn, by the same pass or, once it is
   small, in arrays. So a task holds CHUNK seeds, however many a key has.

The same goes for strings of words: WORDS words, each as a code of WORD bytes, are a string of LENGTH bytes.
"""

from __future__ import annotations

import itertools
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademill.llm import bitmap
from clademill.llm.context_mix import hash_words, word_edges
from clademill.llm.common import carried_schema, carried_struct, map_batches, materialise

LENGTH, REACH = 400, 250
#: Bytes of a seed suffix that all strings of the seed share; they make its key.
SHARED = LENGTH - REACH
#: Seed suffixes that are induced together in arrays.
CHUNK = 20_000
#: Bytes of a word's code, and words of a repeated string where strings are of words.
WORD = 8
WORDS = LENGTH // WORD
#: Bytes whose seeds are sought together; longer texts are cut into overlapping parts.
PART = 1 << 20
NO_ID = -(1 << 63)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def parts(raws: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Texts in parts of about PART bytes: their bytes, the text each is of, and where it begins there. Each string of LENGTH bytes begins in one part and is whole in it."""
    held, owner, base, size = [], [], [], 0
    for k, raw in enumerate(raws):
        for at in range(0, max(1, len(raw) - LENGTH + 1), PART):
            held.append(raw[at : at + PART + LENGTH - 1])
            owner.append(k)
            base.append(at)
            size += len(held[-1])
            if size >= PART:
                yield held, np.array(owner), np.array(base)
                held, owner, base, size = [], [], [], 0
    if held:
        yield held, np.array(owner), np.array(base)


def seeds(raws: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts of a batch, joined, and their seeds: document, its beginning, seed, first and last start of the strings it serves (places in the joined bytes)."""
    none = np.zeros(0, np.int64)
    size = np.fromiter(map(len, raws), np.int64, len(raws))
    joined = b"".join(raws) + bytes(8)
    n = len(joined) - 8
    if not (size >= LENGTH).any():
        return joined, none, none, none, none, none
    places = np.arange(n, dtype=np.uint64)
    eight = np.ndarray((n,), "<u8", joined, 0, (1,))
    least = ((eight * _MIX) & _HIGH) | places
    width = 1
    while width * 2 <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < REACH:
        rest = REACH - width
        least = np.minimum(least[:-rest], least[rest:])
    begin = np.cumsum(size) - size
    count = np.maximum(size - LENGTH + 1, 0)
    doc = np.repeat(np.arange(len(raws)), count)
    start = np.arange(len(doc)) + np.repeat(begin - (np.cumsum(count) - count), count)
    seed = (least[start] & _LOW).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1]))))
    last = np.concatenate((new[1:], [len(doc)])) - 1
    return joined, doc[new], begin[doc[new]], seed[new], start[new], start[last]


def _keys(joined: bytes, seed: np.ndarray) -> np.ndarray:
    view = memoryview(joined)
    return np.fromiter((xxhash.xxh3_64_intdigest(view[a : a + SHARED]) for a in seed.tolist()), np.uint64, len(seed)).view(np.int64)


def in_bytes(texts: list[str]) -> list[bytes]:
    return [t.encode() for t in texts]


def in_words(texts: list[str]) -> list[bytes]:
    """Each text as the codes of its words."""
    raws = in_bytes(texts)
    joined = b"\n".join(raws)
    start, end = word_edges(joined)
    codes = hash_words(joined, start, end).astype("<u8").tobytes()
    bounds = WORD * np.searchsorted(start, np.cumsum([0, *(len(r) + 1 for r in raws)]))
    return [codes[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def word_runs(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of codes as runs of the text's bytes. A code of which a run has a part is a word that differs: codes may begin or end alike."""
    if not runs:
        return []
    start, end = word_edges(raw)
    return [(int(start[-(-a // WORD)]), int(end[b // WORD - 1])) for a, b in runs]


def _repeated_keys(rows: DataFrame, coded=in_bytes) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, _, _ in parts(coded(batch.column(0).to_pylist())):
                joined, _, _, seed, _, _ = seeds(some)
                keys, n = np.unique(_keys(joined, seed), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.minimum(n, 2).astype(np.int32), pa.int32())], ["key", "n"])

    return map_batches(rows.select("text"), run, "key long, n int").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")


CONTEXTS = "key long, right binary, left binary, ids array<long>, hashes array<long>, starts array<long>"


def contexts(raws: list[bytes], ids: np.ndarray, hashes: np.ndarray, wanted=None) -> Iterator[pa.RecordBatch]:
    """Seed suffixes with what the strings they serve have to the left and right; equal ones are one row with all their owners. wanted: a bitmap of keys."""
    for some, owner, base in parts(raws):
        joined, doc, begin, seed, low, high = seeds(some)
        keys = _keys(joined, seed)
        here = np.flatnonzero(wanted.holds(keys)) if wanted else np.arange(len(keys))
        owners: dict[tuple, list[int]] = {}
        for k in here.tolist():
            owners.setdefault((keys[k], joined[seed[k] : high[k] + LENGTH], joined[low[k] : seed[k]]), []).append(k)
        lists = list(owners.values())
        of = owner[doc] if len(doc) else doc
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in owners], pa.int64()),
                pa.array([x[1] for x in owners], pa.binary()),
                pa.array([x[2] for x in owners], pa.binary()),
                *(pa.array([x[ks] for ks in lists], pa.list_(pa.int64())) for x in (ids[of], hashes[of], low - begin + (base[doc] if len(doc) else 0))),
            ],
            [f.split()[0] for f in CONTEXTS.split(", ")],
        )


def _contexts(rows: DataFrame, wanted, coded=in_bytes) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from contexts(coded(batch.column(2).to_pylist()), batch.column(0).to_numpy(), batch.column(1).to_numpy(), wanted.value)

    return map_batches(rows.select("id", "hash", "text"), run, CONTEXTS)


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    out = np.zeros((len(parts), width), np.uint8)
    out[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(parts), np.uint8)
    return out


def prefixes(keys: np.ndarray, rights: list[bytes]) -> np.ndarray:
    """Common prefix values of rows in order with the row before, 0 across keys."""
    n = len(keys)
    if not n:
        return np.zeros(0, np.int16)
    size = np.fromiter(map(len, rights), np.int64, n)
    body = _matrix(rights, LENGTH)
    differ = np.concatenate((body[1:] != body[:-1], np.ones((n - 1, 1), bool)), axis=1)
    common = np.minimum(np.argmax(differ, axis=1), np.minimum(size[1:], size[:-1]))
    return np.concatenate(([0], np.where(keys[1:] == keys[:-1], common, 0))).astype(np.int16)


def induce(of: np.ndarray, common: np.ndarray, size: np.ndarray, lefts: list[bytes], many: np.ndarray, first: int = 0) -> np.ndarray:
    """Which strings of which rows are repeated: [row, offset of the seed in the string], from offset `first` on.

    of: groups of rows, in order, whose last `first` bytes before the seed are equal; common: prefix values with the row before; size: bytes from the seed on; lefts: bytes before
    the seed without those `first`; many: rows all of whose strings are repeated."""
    n = len(of)
    reach = np.fromiter(map(len, lefts), np.int64, n)
    found = np.zeros((n, REACH), bool)
    lows = [common]  # lows[0][k]: rows k - 1 and k; minima over powers of two
    while 2 << (len(lows) - 1) <= n:
        step = 1 << (len(lows) - 1)
        lows.append(np.minimum(lows[-1][:-step], lows[-1][step:]))
    log = np.zeros(n + 2, np.int8)
    log[2:] = np.log2(np.arange(2, n + 2)).astype(np.int8)
    back = _matrix([x[::-1] for x in lefts], REACH)
    at = np.arange(n)
    of = np.cumsum(np.concatenate(([0], of[1:] != of[:-1])))
    for offset in range(first, REACH):
        if offset > first:
            live = reach[at] >= offset - first
            at, of = at[live], of[live]
            of = of * 256 + back[at, offset - first - 1]
            if len(of) > 1 and (of[1:] < of[:-1]).any():
                order = np.argsort(of, kind="stable")
                at, of = at[order], of[order]
        if not len(at):
            break
        same = of[1:] == of[:-1]
        alone = np.concatenate(([True], ~same)) & np.concatenate((~same, [True]))
        at, of = at[~alone], of[~alone]
        if not len(at):
            break
        of = np.cumsum(np.concatenate(([0], of[1:] != of[:-1])))
        pair = np.flatnonzero(of[1:] == of[:-1])
        low, high = at[pair] + 1, at[pair + 1]  # ranks are row numbers
        level = log[high - low + 1]
        value = np.empty(len(pair), np.int16)
        for k in np.unique(level).tolist():
            some = level == k
            value[some] = np.minimum(lows[k][low[some]], lows[k][high[some] - (1 << k) + 1])
        hit = pair[value >= LENGTH - offset]
        found[at[hit], offset] = True
        found[at[hit + 1], offset] = True
    offsets = np.arange(REACH)
    serves = (offsets >= np.maximum(first, LENGTH - size)[:, None]) & (offsets <= (reach + first)[:, None])
    return (found | many[:, None]) & serves


SPANS = "id long, hash long, start long, end long"


class Spans:
    """Spans that wait to be sent on."""

    def __init__(self) -> None:
        self.columns: tuple[list, ...] = ([], [], [], [])

    def add(self, reach: int, owners: tuple, low: int, high: int) -> None:
        """The strings of all owners of a row with offsets low .. high: they begin at start + reach - offset."""
        ids, hashes, starts = owners
        self.columns[0].extend(ids)
        self.columns[1].extend(hashes)
        self.columns[2].extend(s + reach - high for s in starts)
        self.columns[3].extend(s + reach - low + LENGTH for s in starts)

    def ready(self, least: int = 10_000) -> Iterator[pa.RecordBatch]:
        if len(self.columns[0]) >= max(1, least):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in self.columns], ["id", "hash", "start", "end"])
            self.columns = ([], [], [], [])


#: A seed suffix on its way: common prefix with the one before, lowest offset of the strings found without a break up to now (-1: none), bytes to the left, bytes to the right, owners, whether all strings are repeated.
Item = tuple[int, int, bytes, int, tuple, bool]


def _in_arrays(of: np.ndarray, items: list[Item], first: int, out: Spans) -> None:
    """Induces rows in arrays, from offset `first` on."""
    common = np.array([x[0] for x in items], np.int16)
    size = np.array([x[3] for x in items])
    lefts = [x[2][: len(x[2]) - first] for x in items]
    found = induce(of, common, size, lefts, np.array([x[5] for x in items], bool), first)
    padded = np.zeros((len(items), REACH + 2), np.int8)
    padded[:, 1:-1] = found
    edge = np.diff(padded, axis=1)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    for r, a, b in zip(row.tolist(), low.tolist(), high.tolist(), strict=True):
        out.add(len(items[r][2]), items[r][4], a, b - 1)
    for lcp, run, left, size, owners, many in items:
        if run >= 0:
            out.add(len(left), owners, run, first - 1)


def _read(path: str) -> Iterator[Item]:
    with open(path, "rb") as file:
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


def _through_queues(items: Iterable[Item], offset: int, folder: str, out: Spans, chunk: int) -> Iterator[pa.RecordBatch]:
    """Induces rows whose last `offset` bytes before the seed are equal, in their order, by queues on disk; `folder` is the task's own scratch, as that of a sorter."""
    queues, counts, names = {}, {}, {}
    least = np.zeros(256, np.int16)
    held: Item | None = None
    hit = False
    need = LENGTH - offset
    for item in itertools.chain(items, (None,)):
        if held is not None:
            lcp, run, left, size, owners, many = held
            near = item is not None and item[0] >= need
            if near and item[2] == left:  # from here on all strings of both are repeated, and one of them stands for both
                out.add(len(left), item[4], item[1] if item[1] >= 0 else offset, len(left))
                held = (lcp, run, left, max(size, item[3]), owners, True)
                yield from out.ready()
                continue
            if hit or near or many and size >= need:
                run = offset if run < 0 else run
            elif run >= 0:
                out.add(len(left), owners, run, offset - 1)
                run = -1
            hit = near
            np.minimum(least, lcp, out=least)
            if len(left) > offset:
                byte = left[-1 - offset]
                if byte not in queues:
                    names[byte] = os.path.join(folder, f"{offset}-{byte}")
                    queues[byte], counts[byte] = open(names[byte], "wb"), 0
                pickle.dump((int(least[byte]), run, left, size, owners, many), queues[byte], pickle.HIGHEST_PROTOCOL)
                counts[byte] += 1
                least[byte] = LENGTH
            elif run >= 0:
                out.add(len(left), owners, run, offset)
            yield from out.ready()
        held = item
    for file in queues.values():
        file.close()
    for byte, path in names.items():
        if counts[byte] <= chunk:
            waiting = list(_read(path))
            _in_arrays(np.zeros(len(waiting), np.int64), waiting, offset + 1, out)
            yield from out.ready()
        else:
            yield from _through_queues(_read(path), offset + 1, folder, out, chunk)
        os.remove(path)


def _with_prefixes(rows: Iterable[tuple]) -> Iterator[Item]:
    before = None
    for row in rows:
        common = 0 if before is None else len(os.path.commonprefix((before, row[1])))
        before = row[1]
        yield common, -1, row[2], len(row[1]), row[3:6], len(row[3]) > 1


def _distinct(rows: Iterable[tuple], out: Spans) -> Iterator[tuple]:
    """Rows of one key without repeated contexts. All strings of those are repeated: they go out at once, and one row with several owners stands for them."""
    held = None
    for row in rows:
        if held is not None and row[1] == held[1] and row[2] == held[2]:
            if len(held[3]) == 1:
                held = (*held[:3], *(x * 2 for x in held[3:6]))
            out.add(len(row[2]), row[3:6], max(0, LENGTH - len(row[1])), len(row[2]))
            continue
        if held is not None:
            yield held
        held = row
    if held is not None:
        yield held


def induced(batches: Iterable[pa.RecordBatch], chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Sorted seed suffixes -> spans of repeated strings. Keys of one row with one owner are passed over; the others wait until `chunk` rows are there and a key ends."""
    out = Spans()
    waiting: list[tuple] = []

    def settle() -> None:
        keys = np.fromiter((r[0] for r in waiting), np.int64, len(waiting))
        common = prefixes(keys, [r[1] for r in waiting]).tolist()
        _in_arrays(keys, [(c, -1, r[2], len(r[1]), r[3:6], len(r[3]) > 1) for c, r in zip(common, waiting, strict=True)], 0, out)
        waiting.clear()

    stream = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True))
    for _, rows in itertools.groupby(stream, lambda row: row[0]):
        rows = _distinct(rows, out)
        group = list(itertools.islice(rows, chunk + 1))
        if len(group) > chunk:
            with tempfile.TemporaryDirectory(dir=(os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0] or None) as folder:
                yield from _through_queues(_with_prefixes(itertools.chain(group, rows)), 0, folder, out, chunk)
        elif len(group) > 1 or len(group[0][3]) > 1:
            waiting.extend(group)
            if len(waiting) >= chunk:
                settle()
        yield from out.ready()
    settle()
    yield from out.ready(1)


def repeated_spans(rows: DataFrame, *, partitions: int | None = None, coded=in_bytes) -> DataFrame:
    """(id, hash, spans) from (id, hash, text): spans of the coded texts covered by repeated strings, as they were found (they may overlap)."""
    spark = rows.sparkSession
    wanted = spark.sparkContext.broadcast(bitmap.bitmap(materialise(_repeated_keys(rows, coded), "sd-keys"), hashed=True))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = _contexts(rows, wanted, coded).repartition(n, "key").sortWithinPartitions("key", "right", "left")
    found = map_batches(ordered, induced, SPANS)
    return found.groupBy("id", "hash").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), words: str = "") -> DataFrame:
    """Removes each byte of a string of LENGTH bytes that begins anywhere else too; where words is "cut", of a string of WORDS words too, whatever the white space between them, from its first word to its last. Where it is "count", words of such strings are only counted.

    One row for each row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that are left), text (the whole characters among them), with `words` also emptied (whether strings of bytes alone leave nothing) and n_words (words of repeated strings of words), and `carried`, a struct of the columns named in carry, if any. Texts are UTF-8, null ones empty; a cut may part a character. Every row is a document, so
    of repeated rows of LENGTH bytes or more nothing is left. A null identifier is an identifier like others. Empty input gives no rows; long texts are taken in parts. Other columns are not read. Shuffled: a key for each
    seed, the seed suffixes that may repeat (with `words`, those of the codes as well), and the texts once. A task holds CHUNK contexts at a time."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    spans = materialise(repeated_spans(rows), "sd-spans")
    if words:
        spans = spans.join(materialise(repeated_spans(rows, coded=in_words), "sd-words").withColumnRenamed("spans", "coded"), ["id", "hash"], "full")
    else:
        spans = spans.withColumn("coded", F.lit(None).cast(spans.schema["spans"].dataType))
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"), *carried_struct(docs, carry))

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), *([pa.bool_(), pa.int64()] if words else [])]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, found, codes in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                raw = text.encode()
                runs = merged(found or [])
                emptied = bool(raw) and runs == [(0, len(raw))]
                codes = merged(codes or [])
                if words == "cut":
                    runs = merged([*(found or []), *({"start": a, "end": b} for a, b in word_runs(raw, codes))])
                ends = [0, *(b for _, b in runs)]
                kept = b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in runs), len(raw)], strict=True))
                out.append((None if doc == NO_ID else doc, len(raw), len(raw) - len(kept), len(runs), kept, kept.decode(errors="ignore"), emptied, sum(b // WORD - -(-a // WORD) for a, b in codes))[: len(kinds)])
            cols = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)] + batch.columns[4:], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "text", *(["emptied", "n_words"] if words else []), *["carried"] * bool(carry)])

    joined = rows.join(spans, ["id", "hash"], "left").select("id", "text", "spans", "coded", *["carried"] * bool(carry))
    return map_batches(joined, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, text string" + ", emptied boolean, n_words long" * bool(words) + carried_schema(joined))
