"""Packing token pieces into sequences with a grouping genetic algorithm on islands.

A solution is a partition of pieces into bins. Crossover puts whole bins of one parent, the best filled ones, into the other, removes the bins
there that share a piece with them, and packs the pieces that lost their bin by best fit. Pieces are dealt by a hash over
shards of bounded size; each shard is solved by several islands, each a task with a population of its own, and between
epochs the elite of each island moves to the next island of its shard. The best solution of a shard's islands counts.

What is sought is few bins, and the room that is left in as few of them as can be: the other bins are full for good, while the pieces of the bins with much room go on to
the next level, where they meet those of the other shards, until one shard has them all. So not each shard, but the whole corpus has a last bin that isn't full.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademill.llm.bpe import STANDARD
from clademill.llm.common import id_text, map_batches, materialise

ISLANDS, EPOCHS = 2, 2
POPULATION, CHILDREN = 4, 4
#: Pieces of a shard on average.
SHARD = 4096
#: A bin goes on to the next level if more than this share of it is free.
LOOSE = 1 / 256
END_ID = 0


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 ones for themselves, the others from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Ids:
    """Texts -> packed ids of a tokenizers JSON file.

    A byte-level file whose merges are numbered in the order of its ids has the ids of its ranks, and those come from a coder for ranks, at a fifth of the time;
    any other file is left to the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.path, self.added, self.ranks, self.library = path, told["added_tokens"] or [], None, {}
        model, before, letters = told["model"], told["pre_tokenizer"] or {}, byte_letters()
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) and told["normalizer"] is None
        plain &= before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        plain &= not any(t[k] for t in self.added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if plain:
            vocab = model["vocab"]
            made = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", ""), -1) for m in model["merges"]]
            ranks = {bytes(map(letters.__getitem__, w)): n for w, n in vocab.items() if set(w) <= letters.keys() and w not in {t["content"] for t in self.added}}
            if made == sorted(made) and len({*made}) == len(made) == len(ranks) - 256 and min(made, default=256) > max(vocab.get(c, 1 << 40) for c in letters):
                import tiktoken

                self.ranks = tiktoken.Encoding(path, pat_str=STANDARD, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in self.added})

    def encode(self, texts: list[str], added: bool) -> Iterator[bytes]:
        if self.ranks:
            special = {"allowed_special": "all"} if added else {"disallowed_special": ()}
            for text in texts:
                yield self.ranks.encode_to_numpy(text, **special).astype("<u4", copy=False).tobytes()
            return
        if added not in self.library:
            from tokenizers import Tokenizer

            self.library[added] = Tokenizer.from_file(self.path)
            self.library[added].encode_special_tokens = not added
        for found in self.library[added].encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(found.ids, "<u4").tobytes()


@lru_cache(2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def token_ids(texts: list[str], path: str, added: bool = False) -> Iterator[bytes]:
    """Each text's ids, as the tokenizers library gives them without special tokens.
    added: the JSON's added tokens that a text spells out have their own ids, as the library's defaults have it; otherwise they are ordinary text."""
    return ids_of(path).encode(texts, added)


PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits, else pieces of `size`, the first of them shorter where it doesn't come out even."""
    first = n if n <= size else n % size or size
    return [(0, first), *((k, size) for k in range(first, n, size))]


def pieces(docs: DataFrame, path: str, size: int, added: bool = False) -> DataFrame:
    """All pieces of all rows; `row` numbers the rows of the written result."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            out = []
            for doc, text_ids in zip(batch.column(0).to_pylist(), token_ids(batch.column(1).to_pylist(), path, added), strict=True):
                ids = text_ids + END_ID.to_bytes(4, "little")
                for k, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    out.append((row, doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                row += 1
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in PIECES.split(", ")])

    return map_batches(docs, run, PIECES)


def best_fit(items: Iterable[int], lengths: list[int], bins: list[list[int]], room: list[int], size: int) -> None:
    """Puts items, in their order, each into the fullest bin that has room for it, or a new one. Changes bins and room."""
    free = sorted((r, k) for k, r in enumerate(room) if r)
    for item in items:
        need = lengths[item]
        at = bisect_left(free, (need, -1))
        if at == len(free):
            k = len(bins)
            bins.append([])
            room.append(size)
        else:
            k = free.pop(at)[1]
        bins[k].append(item)
        room[k] -= need
        if room[k]:
            insort(free, (room[k], k))


def fitness(room: list[int], size: int) -> float:
    """Mean square of the room; of as many bins, those with all their room in one are best."""
    return sum((r / size) ** 2 for r in room) / len(room) if room else 0.0


class Solution:
    __slots__ = ("bins", "room", "value")

    def __init__(self, bins: list[list[int]], room: list[int], size: int) -> None:
        self.bins, self.room, self.value = bins, room, (-len(bins), fitness(room, size))  # values are maximised


def start(rng: np.random.Generator, lengths: list[int], size: int, noise: float) -> Solution:
    """Best fit of the pieces from long to short, the order blurred by noise."""
    blurred = np.array(lengths) * (1 + noise * rng.standard_normal(len(lengths)))
    bins: list[list[int]] = []
    room: list[int] = []
    best_fit(np.argsort(-blurred, kind="stable").tolist(), lengths, bins, room, size)
    return Solution(bins, room, size)


def crossover(rng: np.random.Generator, giver: Solution, taker: Solution, lengths: list[int], size: int) -> Solution:
    """Injects a share of the giver's best filled bins into the taker, drops the taker's bins that share pieces with them, and best-fits the pieces set free."""
    blur = rng.random(len(giver.bins)) * (0.02 * size)  # bins about as full come in any order
    full = np.argsort(np.array(giver.room) + blur, kind="stable").tolist()
    some = full[: max(1, int(len(full) * rng.uniform(0.2, 0.6)))]
    taken = {i for k in some for i in giver.bins[k]}
    bins, room = [list(giver.bins[k]) for k in some], [giver.room[k] for k in some]
    loose = []
    worst = set(sorted(range(len(taker.bins)), key=lambda k: -taker.room[k])[: max(1, len(taker.bins) // 20)])
    for k, items in enumerate(taker.bins):
        if k in worst or not taken.isdisjoint(items):
            loose.extend(i for i in items if i not in taken)
        else:
            bins.append(list(items))
            room.append(taker.room[k])
    loose.sort(key=lambda i: -lengths[i])
    best_fit(loose, lengths, bins, room, size)
    return Solution(bins, room, size)


def settled(best: Solution, lengths: list[int], size: int) -> bool:
    """Whether no solution is better: as few bins as can be, and one of them at most with room."""
    return len(best.bins) <= -(-sum(lengths) // size) and sum(r > 0 for r in best.room) <= 1


def evolve(population: list[Solution], lengths: list[int], size: int, rng: np.random.Generator, children: int = CHILDREN) -> list[Solution]:
    """Children replace the worst, until no solution can be better."""
    for _ in range(children):
        population.sort(key=lambda s: s.value, reverse=True)
        if len(population) < 2 or settled(population[0], lengths, size):
            break
        one, two = rng.choice(len(population), 2, replace=False)
        child = crossover(rng, population[one], population[two], lengths, size)
        if child.value > population[-1].value and all(child.value != s.value for s in population):  # twins would end all change
            population[-1] = child
    return sorted(population, key=lambda s: s.value, reverse=True)


def _of(column: np.ndarray, lengths: list[int], size: int) -> Solution:
    """A solution from the bin of each item."""
    order = np.argsort(column, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(column[order])) + 1) if len(column) else []
    bins = [p.tolist() for p in parts]
    return Solution(bins, [size - sum(lengths[i] for i in b) for b in bins], size)


def _bins(solution: Solution, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for k, items in enumerate(solution.bins):
        out[items] = k
    return out


def pack(made: DataFrame, size: int) -> DataFrame:
    """(row, piece, sequence_id, offset) for pieces shorter than `size`."""
    loose = made.where(F.col("length") < size).select("row", "piece", "length")
    out, level, before = None, 0, None
    while True:
        n = loose.count()
        shards = max(1, round(n / SHARD))
        last = shards == 1 or n == before
        placed = materialise(_solve(loose, size, shards, level), "packing-places")
        kept = placed if last else placed.where(F.col("room") <= int(LOOSE * size))
        kept = kept.select("row", "piece", "sequence_id", "offset")
        out = kept if out is None else out.unionByName(kept)
        if last:
            return out
        loose, level, before = placed.where(F.col("room") > int(LOOSE * size)).select("row", "piece", "length"), level + 1, n


def _solve(small: DataFrame, size: int, shards: int, level: int) -> DataFrame:
    """One level: (row, piece, length, sequence_id, offset, room of the bin)."""

    def island(epoch: int):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            shard, number = (int(x) for x in key)
            rng = np.random.default_rng([level, shard, number, epoch])
            elites = {k: g.sort_values(["row", "piece"], kind="stable") for k, g in rows.groupby("origin")}
            items = next(iter(elites.values()))
            lengths = items["length"].tolist()
            population = [_of(g["bin"].to_numpy(), lengths, size) for g in elites.values()] if epoch else [start(rng, lengths, size, 0.0)]
            if not settled(population[0], lengths, size):
                population += [start(rng, lengths, size, 0.05 * (k + number + 1)) for k in range(POPULATION - len(population))]
            best = evolve(population, lengths, size, rng)[0]
            return items.assign(origin=number, bin=_bins(best, len(items)), bins=len(best.bins), spread=-float(best.value[1]))[STATE_NAMES]

        return run

    def settle(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """The best island's bins."""
        ranked = rows[["bins", "spread", "origin"]].drop_duplicates().sort_values(["bins", "spread", "origin"])
        rows = rows[rows["origin"] == ranked["origin"].iloc[0]].sort_values(["bin", "row", "piece"], kind="stable")
        bins = rows.groupby("bin")["length"]
        return pd.DataFrame({"row": rows["row"], "piece": rows["piece"], "length": rows["length"], "sequence_id": (level << 58) + (int(key[0]) << 24) + rows["bin"], "offset": bins.cumsum() - rows["length"], "room": size - bins.transform("sum")})

    state = small.withColumns(
        {
            "shard": F.pmod(F.xxhash64("row", "piece", F.lit(level)), F.lit(shards)),
            "island": F.explode(F.array(*(F.lit(k) for k in range(ISLANDS)))),
            "origin": F.lit(0),
            "bin": F.lit(0).cast("long"),
            "bins": F.lit(0),
            "spread": F.lit(0.0),
        }
    )
    for epoch in range(EPOCHS):
        if epoch:  # each elite stays, and goes to the next island as well
            state = state.withColumn("island", F.explode(F.array(F.col("origin"), F.pmod(F.col("origin") + 1, F.lit(ISLANDS)))))
        state = state.groupBy("shard", "island").applyInPandas(island(epoch), STATE)
    return state.groupBy("shard").applyInPandas(settle, "row long, piece int, length long, sequence_id long, offset long, room long")


STATE = "row long, piece int, length long, shard long, island int, origin int, bin long, bins int, spread double"
STATE_NAMES = [f.split()[0] for f in STATE.split(", ")]


def pack_documents(docs: DataFrame, path: str, *, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """Packs the ids of all whole texts, each followed by id 0, into sequences of at most `size` ids. added: added tokens that a text spells out have their own ids.

    One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are a piece of one id. Each row of `docs` is packed, repeated ones
    and null identifiers too. Other columns are not read. A piece of full size is a sequence by itself. Empty input gives no rows. Shuffled: numbers of pieces, not ids."""
    made = materialise(pieces(id_text(docs, id_col, text_col), path, size, added), "packing-pieces")
    places = pack(made, size)
    short = made.where(F.col("length") < size).join(places, ["row", "piece"])
    full = made.where(F.col("length") == size).withColumn("number", F.monotonically_increasing_id()).withColumns({"sequence_id": -1 - F.col("number"), "offset": F.lit(0).cast("long")})
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return short.select(columns).unionByName(full.select(columns))
