"""Language identification with hyperdimensional profiles.

Every letter of every script has a random vector of +1 and -1, made from its code point. A letter's place in an n-gram turns its vector by so many
positions, and the n-gram's vector is the product of the turned ones; a text's vector is the sum over its n-grams,
and a language's prototype the sum over the n-grams of its training texts. The language whose prototype has the largest cosine
with the text is predicted.

N-grams are counted first, those of a batch together: the sum over distinct n-grams of count times vector is the same bundle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademill.llm.common import carried_schema, carried_struct, crc_fold, map_batches

N_GRAM = 3
DIMENSION = 512
TEMPERATURE = 0.02
UNKNOWN = "und"
#: Distinct n-grams whose vectors are in memory together.
VECTORS = 16_384
_GOLD, _SILVER, _BRONZE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


@lru_cache(1)
def _lower_letters() -> np.ndarray:
    """Code point -> the code point of its lower case, or 0 where it is no letter."""
    out = np.zeros(0x110000, np.int32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            low = c.lower()
            out[k] = ord(low) if len(low) == 1 else k
    return out


def _letters(text: str) -> np.ndarray:
    """Lower-case letters of a text with 0, the border of words, for everything else."""
    return _lower_letters()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]


@dataclass
class Profiles:
    """What is learnt: a prototype for each language."""

    langs: list[str]
    prototypes: np.ndarray


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """The vector of each code point (0 is the border): bits of a mixed counter, 64 at a time."""
    x = (letters.astype(np.uint64)[:, None] + np.uint64(1)) * np.uint64(DIMENSION) + np.arange(DIMENSION // 64, dtype=np.uint64)
    x = (x + np.uint64(20240229)) * _GOLD
    x = (x ^ (x >> np.uint64(30))) * _SILVER
    x = (x ^ (x >> np.uint64(27))) * _BRONZE
    x ^= x >> np.uint64(31)
    bits = x[:, :, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)
    return bits.reshape(len(letters), DIMENSION).astype(np.float32) * 2 - 1


def grams(text: str) -> np.ndarray:
    """A text's n-grams, one a row, in order; runs of other characters are one border, and n-grams around a border are left out."""
    seen = _letters(text)
    if not len(seen):
        return np.zeros((0, N_GRAM), np.int32)
    keep = np.ones(len(seen), bool)
    keep[1:] = (seen[1:] != 0) | (seen[:-1] != 0)
    seen = np.concatenate(([0], seen[keep], [0])).astype(np.int32)
    rows = np.lib.stride_tricks.sliding_window_view(seen, N_GRAM) if len(seen) >= N_GRAM else np.zeros((0, N_GRAM), np.int32)
    return rows[rows[:, 1] != 0]


def gram_vectors(rows: np.ndarray) -> np.ndarray:
    """The vectors of n-grams: the product of the letters' vectors, each turned by its distance from the end."""
    letters, at = np.unique(rows, return_inverse=True)
    table, at = letter_vectors(letters), at.reshape(rows.shape)
    out = table[at[:, -1]]
    for k in range(1, N_GRAM):
        out = out * np.roll(table, k, axis=1)[at[:, N_GRAM - 1 - k]]
    return out


def bundles(texts: list[str], owner: list[int], n: int) -> np.ndarray:
    """The sums of the n-grams' vectors of all texts of each owner, of n."""
    out = np.zeros((n, DIMENSION), np.float64)
    found = [grams(t) for t in texts]
    rows = np.concatenate(found) if found else np.zeros((0, N_GRAM), np.int32)
    if not len(rows):
        return out
    # Letters by number, so that an n-gram and its owner are one number.
    there = np.zeros(0x110000, bool)
    there[rows.ravel()] = True
    letters = np.flatnonzero(there)
    number = np.zeros(0x110000, np.int64)
    number[letters] = np.arange(len(letters))
    code = np.zeros(len(rows), np.int64)
    for k in range(N_GRAM):
        code = code * len(letters) + number[rows[:, k]]
    whose = np.repeat(np.array(owner, np.int64), [len(f) for f in found])
    distinct, code = np.unique(code, return_inverse=True)
    pair, count = np.unique(code * n + whose, return_counts=True)
    code, whose = pair // n, pair % n
    for low in range(0, len(distinct), VECTORS):
        some = distinct[low : low + VECTORS]
        parts = [letters[some // len(letters) ** (N_GRAM - 1 - k) % len(letters)] for k in range(N_GRAM)]
        vectors = gram_vectors(np.stack(parts, axis=1))
        here = np.flatnonzero((code >= low) & (code < low + VECTORS))
        here = here[np.argsort(whose[here], kind="stable")]
        ends = np.flatnonzero(np.diff(whose[here])) + 1
        for mine in np.split(here, ends):
            out[whose[mine[0]]] += count[mine].astype(np.float32) @ vectors[code[mine] - low]
    return out


def _training(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text")).where("lang is not null and text is not null")


def sums(rows: DataFrame) -> DataFrame:
    """(lang, part, values): the bundle of each language over all rows of (lang, text), DIMENSION whole numbers; each task sums its own first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            langs = sorted(set(names))
            found = bundles(batch.column(1).to_pylist(), [langs.index(x) for x in names], len(langs))
            for lang, values in zip(langs, found, strict=True):
                total[lang] = total.get(lang, 0) + values
        for lang, values in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSION, pa.string()), pa.array(np.arange(DIMENSION, dtype=np.int32)), pa.array(np.rint(values).astype(np.int64))], ["lang", "at", "value"])

    return map_batches(rows, run, "lang string, at int, value long").groupBy("lang", "at").agg(F.sum("value").alias("value"))


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from all rows with a text and a language. To the driver come DIMENSION numbers a language."""
    found: dict[str, np.ndarray] = {}
    for r in sums(_training(docs, text_col, lang_col)).collect():
        found.setdefault(r.lang, np.zeros(DIMENSION))[r.at] = r.value
    langs = sorted(found)
    return Profiles(langs, unit(np.array([found[k] for k in langs]).reshape(len(langs), DIMENSION)))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; those without n-grams stay 0."""
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(size > 0, size, 1)).astype(np.float32)


def predict(docs: DataFrame, profiles: Profiles, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, has_letter, lang_pred, score, cosine): the nearest prototype of every whole text; score is its share of the softmax over the cosines. With carry,
    the text comes along, and `carried`, a struct of the columns named.

    `und` with score 0 where the text is null or has no letter, or where nothing was learnt. Equal cosines: the first language in order. Narrow: no shuffle.
    What is broadcast is bounded by the number of languages times DIMENSION."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(profiles)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            vectors = bundles(texts, list(range(len(texts))), len(texts))
            letters = [bool(_letters(t).any()) for t in texts]
            if model.langs:
                near = unit(vectors) @ model.prototypes.T
                best = np.argmax(near, axis=1)
                cosine = near[np.arange(len(texts)), best].astype(np.float64)
                score = 1 / np.exp((near - cosine[:, None]) / TEMPERATURE).sum(axis=1)
            else:
                best, cosine, score = np.zeros((3, len(texts)))
            known = np.array(letters, bool) & bool(model.langs)
            pred = [model.langs[int(b)] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            cosine, score = np.where(known, cosine, 0.0), np.where(known, np.clip(score, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(letters, pa.bool_()), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(cosine, pa.float64()), *batch.columns[1:] * bool(carry)],
                ["doc_id", "has_letter", "lang_pred", "score", "cosine", *["text", "carried"] * bool(carry)],
            )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), *carried_struct(docs, carry))
    return map_batches(rows, run, "doc_id long, has_letter boolean, lang_pred string, score double, cosine double" + ", text string" * bool(carry) + carried_schema(rows))


def language_id(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """Learns from the rows outside fold 0 and predicts every row: doc_id, held_out, lang_pred, score, cosine.

    One row for each row of `docs`, repeated ones too. A null identifier has the fold of the empty text. Null texts and texts without a letter give `und`, score 0; null
    languages are not learnt from. With nothing to learn from, every row is `und`. Empty input gives no rows. Other columns are not read. Two passes over the texts, no wide shuffle; a text of any length is one row of a batch."""
    profiles = learn(docs.where(crc_fold(docs[id_col], folds) != 0), text_col=text_col, lang_col=lang_col)
    return predict(docs, profiles, id_col=id_col, text_col=text_col).select("doc_id", (crc_fold("doc_id", folds) == 0).alias("held_out"), "lang_pred", "score", "cosine")

