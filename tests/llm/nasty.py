"""Rows that operators must take: nulls, empty and long texts, ties, repeated rows, columns whose names clash."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, hash long, key string, start int, lines string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


def rows() -> list[tuple]:
    rng = random.Random(5)
    base = words(rng, 120)
    edited = base.split()
    edited[50] = "zzz"
    block = "\n".join(words(rng, 12) for _ in range(6))
    texts = [
        None, "", " \n\t ", "a", "!!! 123", base, base, base.replace(" ", "  "), " ".join(edited), words(rng, 60) + "\n" + block, block + "\n" + words(rng, 60),
        words(rng, 30) + "\n" + block + "\n" + words(rng, 20), "x" * 5000, "né à l'été — où? 你好 🙂 " * 30, "ab" * 700, words(rng, 9000), "\n\n\n", "don't we'll I'm <|endoftext|>", base.upper(), "one two",
        base[:300] + base[:300] + base[:300],
    ]
    out = [(k, t, "en" if k % 2 else "fr", f"s{k % 3}", None if t is None else len(t), 1, 2, "k", 3, "l") for k, t in enumerate(texts)]
    out.append(out[5])  # a repeated row
    out.append((None, base, None, None, None, None, None, None, None, None))
    out.append((None, None, None, None, None, None, None, None, None, None))
    return out


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
