"""Near-duplicate detection with HyperMinHash sketches.

A document is the set of its word shingles. For each of REGISTERS hash functions the smallest hash over the set is kept as a
16-bit register: the number of leading zeros and the ten bits behind the first one. ROWS registers in a row make the key of a band. Documents with
equal sets are one class from the start. Classes that share a key are candidates: each is held against
the smallest class of the key, by the estimate from the registers (corrected for registers that agree by chance) and then by the full sets.
Where a key's classes have not all come together, all pairs between different components are held against each other in blocks, by their sketches first. So no group is expanded into all its pairs, and no
candidate pair is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clademill.llm import bitmap
from clademill.llm.common import id_text, map_batches, materialise
from clademill.llm.components import components

REGISTERS, ROWS = 192, 6
BANDS = REGISTERS // ROWS
MANTISSA = 10
CACHE_WORDS = 300_000
#: An estimate so many of its standard deviations below the threshold settles a pair.
DEVIATIONS = 5.0
#: Classes of a key in one block, and pairs held against each other at once.
BLOCK, PAIRS = 2048, 40_000
_SEEDS = np.random.default_rng(715517).integers(0, 1 << 63, (2, REGISTERS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_HASHES = _WordHash()


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of k words; a text of fewer words has one, a text without words none."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ (out >> np.uint64(29))) * _MIX + h[j : j + n]
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return np.unique(out ^ (out >> np.uint64(31)))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of sets that aren't empty: the exponent and the first MANTISSA bits of the smallest hash, for each function."""
    if not sets:
        return np.zeros((0, REGISTERS), np.uint16)
    joined = np.concatenate(sets)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(size) - size
    out = np.empty((len(sets), REGISTERS), np.uint16)
    for k in range(REGISTERS):
        least = np.minimum.reduceat((joined ^ _SEEDS[0, k]) * _SEEDS[1, k], starts)
        # A double holds the place of the first one-bit in its exponent, and the bits behind it in its mantissa.
        out[:, k] = (least.astype(np.float64).view(np.int64) >> (52 - MANTISSA)).astype(np.uint16)
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band: its registers, mixed with the band's number."""
    parts = registers.astype(np.uint64).reshape(len(registers), BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64) * _SEEDS[0, 0]
    for j in range(ROWS):
        keys = (keys ^ (keys >> np.uint64(29))) * _MIX + parts[:, :, j]
    return (keys ^ (keys >> np.uint64(31))) * _MIX


def least_estimate(share: tuple[int, int]) -> float:
    t = share[0] / share[1]
    return t - DEVIATIONS * (t * (1 - t) / REGISTERS) ** 0.5


def estimate(agree, n_one, n_two, bits=MANTISSA):
    """Jaccard similarity from the share of registers that agree, corrected for registers that agree by chance.

    Two different smallest hashes have the same exponent with probability about 1/3 for sets of one size (the sum over exponents of the squared
    shares), less for sets of different size, and then the same mantissa bits with probability 2**-bits."""
    chance = np.minimum(n_one, n_two) / np.maximum(n_one, n_two) / 3 / (1 << bits)
    return np.maximum(0.0, (agree - chance) / (1 - chance))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, registers, keys) for each row of (doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, k) for t in batch.column(1).to_pylist()]
            full = [j for j, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            registers: list = [None] * len(sets)
            made = sketches([sets[j] for j in full])
            for j, row, part in zip(full, band_keys(made).view(np.int64), made, strict=True):
                keys[j], registers[j] = row, part.astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array(registers, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_key", "registers", "keys"],
            )

    return map_batches(docs, run, "doc_id long, n_shingles long, set_key binary, registers binary, keys array<long>")


def _sets_of(docs: DataFrame, ids: DataFrame, k: int, name: str, *, short: bool = False) -> DataFrame:
    """(name, name_set): the full sets of the documents in `ids`; a bitmap lets tasks skip most others. short: of each hash the first 16 bits."""
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap.bitmap(ids))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here = batch.filter(pa.array(wanted.value.holds(batch.column(2).to_numpy())))
            sets = [shingle_set(t, k) for t in here.column(1).to_pylist()]
            sets = [(np.unique(x >> np.uint64(48)).astype("<u2") if short else x).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([here.column(0), pa.array(sets, pa.binary())], [name, f"{name}_set"])

    rows = docs.where("doc_id is not null").withColumn("slot", bitmap.hash_of("doc_id"))
    return map_batches(rows, run, f"{name} long, {name}_set binary")


def _matrix(registers: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(registers), "<u2").reshape(len(registers), REGISTERS)


def estimated(pairs: DataFrame, sketch: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Of pairs (a, b) of classes, those that their stored registers and sizes don't rule out."""
    least, (p, q) = least_estimate(share), share

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(j).to_numpy() for j in (2, 3))
            agree = (_matrix(batch.column(4).to_pylist()) == _matrix(batch.column(5).to_pylist())).mean(axis=1)
            open_ = (q * np.minimum(n, m) >= p * np.maximum(n, m)) & (estimate(agree, n, m) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(open_))

    one, two = (sketch.select(F.col("class").alias(x), F.col("n").cast("long").alias(f"{x}_n"), F.col("registers").alias(f"{x}_registers")) for x in ("a", "b"))
    return map_batches(pairs.join(one, "a").join(two, "b").select("a", "b", "a_n", "b_n", "a_registers", "b_registers"), run, "a long, b long")


def verify(docs: DataFrame, pairs: DataFrame, k: int, share: tuple[int, int]) -> DataFrame:
    """Of written pairs (a, b), those whose full sets are alike enough. share: (p, q) for p / q of the union."""
    p, q = share

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for j, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(one, two, assume_unique=True))
                linked[j] = q * common >= p * (len(one) + len(two) - common)
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    sets = _sets_of(docs, materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "nd-wanted"), k, "id")
    left, right = (sets.select(F.col("id").alias(x), F.col("id_set").alias(f"{x}_set")) for x in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "a_set", "b_set")
    return map_batches(both, run, "a long, b long")


def _split(shared: DataFrame, star: DataFrame) -> DataFrame:
    """Rows of the keys whose classes are in different components, with their components and the size of the key."""
    placed = materialise(shared.join(star, shared["class"] == star["node"], "left").select("key", "class", F.coalesce("component", "class").alias("comp")), "nd-placed")
    keys = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("key", "n")
    return materialise(placed.join(keys, "key"), "nd-split")


def _pair_lists(groups: Iterable[list[tuple]]) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """Rows of several groups, and the numbers of rows to pair, PAIRS at most at a time. A group of one block is paired within, one of two across."""
    rows: list[tuple] = []
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    size = 0
    for group in groups:
        blocks = np.array([r[3] for r in group])
        first, second = np.flatnonzero(blocks == blocks.min()), np.flatnonzero(blocks == blocks.max())
        within = blocks.min() == blocks.max()
        if within and group[0][1] != group[0][2]:
            continue  # the other block of this pair has no row here
        at = len(rows)
        rows.extend(group)
        for k in range(0, len(first), max(1, PAIRS // max(1, len(second)))):
            x, y = (z.ravel() for z in np.meshgrid(first[k : k + max(1, PAIRS // max(1, len(second)))], second, indexing="ij"))
            if within:
                x, y = x[x < y], y[x < y]
            left.append(x + at)
            right.append(y + at)
            size += len(x)
            if size >= PAIRS:
                yield rows, np.concatenate(left), np.concatenate(right)
                left, right, size = [], [], 0
        if not size:
            rows = []
    if size:
        yield rows, np.concatenate(left), np.concatenate(right)


def _across(docs: DataFrame, split: DataFrame, sketch: DataFrame, k: int, share: tuple[int, int]) -> DataFrame:
    """Pairs of classes of one key in different components that their sketches, and then their sets of short hashes, show as alike, each pair from the first band that both share.
    A short hash can only add to what two sets have in common, so no pair is lost. Which bands two classes share is seen from their keys, as the groups are.

    A key of many classes is dealt in blocks, and each pair of blocks is a group of its own: no task holds more than two blocks of a key."""
    least = least_estimate(share)
    p, q = share
    columns = "key long, p int, q int, block int, band int, class long, comp long, n int, registers binary, class_set binary, before array<long>"
    names = [c.split()[0] for c in columns.split(", ")]
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = split.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("class"), blocks).cast("int")}).drop("n").join(sketch, "class")
    dealt = dealt.join(_sets_of(docs, materialise(split.select("class").distinct(), "nd-open"), k, "class", short=True), "class")
    dealt = dealt.withColumn("band", F.array_position("keys", F.col("key")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other"), "before": F.slice("keys", F.lit(1), F.col("band") - 1)}).select(*names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[list[tuple]]:
            group: list[tuple] = []
            for batch in batches:
                for row in zip(*(batch.column(j).to_pylist() for j in range(len(names))), strict=True):
                    if group and row[:3] != group[0][:3]:
                        yield group
                        group = []
                    group.append(row)
            if group:
                yield group

        for rows, x, y in _pair_lists(groups()):
            comp, n, ids, band = (np.array([r[j] for r in rows]) for j in (6, 7, 5, 4))
            registers = _matrix([r[8] for r in rows])
            open_ = (comp[x] != comp[y]) & (q * np.minimum(n[x], n[y]) >= p * np.maximum(n[x], n[y]))
            x, y = x[open_], y[open_]
            open_ = estimate((registers[x] == registers[y]).mean(axis=1), n[x], n[y]) >= least
            x, y = x[open_], y[open_]
            before = np.zeros((len(rows), BANDS), np.int64)
            for j in np.unique(np.concatenate((x, y))).tolist():
                before[j, : band[j] - 1] = rows[j][10]
            open_ = ~((before[x] == before[y]) & (np.arange(BANDS) < band[x][:, None] - 1)).any(axis=1)
            x, y = x[open_], y[open_]
            used = {j: np.frombuffer(rows[j][9], "<u2") for j in np.unique(np.concatenate((x, y))).tolist()}
            common = np.fromiter((len(np.intersect1d(used[i], used[j], assume_unique=True)) for i, j in zip(x.tolist(), y.tolist(), strict=True)), np.int64, len(x))
            twice = np.array([n[j] - len(used[j]) if j in used else 0 for j in range(len(rows))])
            common += np.minimum(twice[x], twice[y])  # shingles whose short hash another one of the set has as well may be common
            size = n[x] + n[y]
            open_ = q * common >= p * (size - common)
            x, y = x[open_], y[open_]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(ids[x], ids[y]), pa.int64()), pa.array(np.minimum(ids[x], ids[y]), pa.int64())], ["a", "b"])

    parts = int(split.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(parts, "key", "p", "q").sortWithinPartitions("key", "p", "q")
    return map_batches(ordered, run, "a long, b long").distinct()


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """Links documents whose sets of k-word shingles are alike by share[0] / share[1] at least, and gives each document the smallest identifier it reaches.

    One row for each row of `docs`: doc_id, n_shingles, component_id, kept. Null and empty texts have no shingle, are linked with nothing and kept. Rows with a null identifier
    are linked with nothing, have a null component and are kept. Repeated rows are equal sets and so one class; rows that share an identifier with different texts count as linked.
    Other columns are not read. Shuffled: BANDS keys for each class, and the sets of candidates."""
    rows = id_text(docs, id_col, text_col)
    signed = materialise(signatures(rows, k), "nd-signatures")
    named = signed.where("doc_id is not null and set_key is not null")
    classes = materialise(
        named.groupBy("set_key").agg(F.min("doc_id").alias("class"), F.first("n_shingles").cast("int").alias("n"), F.first("registers").alias("registers"), F.first("keys").alias("keys")), "nd-classes"
    )
    sketch = classes.select("class", "n", "registers", "keys")
    keyed = classes.select("class", F.explode("keys").alias("key"))
    least = keyed.groupBy("key").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least <> most").select("key", "least")
    shared = materialise(keyed.join(least, "key"), "nd-keys")
    first = shared.where("class <> least").select(F.col("class").alias("a"), F.col("least").alias("b")).distinct()
    links = materialise(verify(rows, materialise(estimated(first, sketch, share), "nd-first"), k, share), "nd-links")
    star = components(links)
    split = _split(shared, star)
    if not split.isEmpty():
        found = materialise(verify(rows, materialise(_across(rows, split, sketch, k, share), "nd-rest"), k, share), "nd-more")
        if not found.isEmpty():
            star = components(links.unionAll(found))
    final = classes.join(star, classes["class"] == star["node"], "left").select("set_key", F.coalesce("component", "class").alias("component"))
    linked = named.select("doc_id", "n_shingles", "set_key").join(final, "set_key").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = signed.where("doc_id is null or set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
