"""Each stage is held against a plain version over its own input."""

import random
import re
from collections import Counter

import corpus_pipeline
from tests.llm import nasty
from tests.llm.test_operators import brute_components, brute_repeats

from clademill.llm.common import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = materialise(stage(spark, before, DATA), f"test-{name}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == COLUMNS
            old, new = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in after.collect()}
            assert new and set(new) <= set(old) and all(r.n_chars == len(r.text) for r in new.values())
        if name == "language":
            assert all(re.search(r"[^\W\d_]", r.text) for r in new.values()) and len(new) > 0.95 * len(old)
        if name == "lines":
            lines = Counter(tuple(x) for r in new.values() for x in [r.text.split("\n")[j : j + 3] for j in range(r.text.count("\n") - 1)] if all(y.strip() for y in x))
            assert all(n == 1 for n in lines.values())
        if name == "near":
            want = brute_components([(i, r.text) for i, r in old.items()], 5, (80, 100))
            assert set(new) == {i for i, _, c in want if i == c}
        if name == "suffixes":
            want = brute_repeats([(i, r.text.encode()) for i, r in old.items()])
            left = {i: n - m for i, n, m, _, _ in want}
            assert set(new) == {i for i, n in left.items() if n or not old[i].text}
            assert sum(len(r.text.encode()) for r in new.values()) <= sum(left.values())
        before = after
    assert {"sequence_id", "offset", "length"} <= set(before.columns) and before.count() > 0


def test_nasty_rows(spark):
    docs = nasty.frame(spark).select(COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, ""), f"nasty-{name}")
    assert docs.count() > 0
    docs = nasty.empty(spark).select(COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, ""), f"empty-{name}")
    assert docs.count() == 0


def test_language_rejects_what_was_never_learnt(spark):
    rng = random.Random(3)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(COLUMNS)
    junk = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz    ", k=n)) for n in (400, 800, 1600, 3000)] * 3
    junk += [t * 4 for t in ("Tämä on suomenkielinen lause, jota malli ei ole koskaan oppinut. ", "Это русский текст, которого модель никогда не видела. ", "Ez egy magyar mondat, amelyet a modell soha nem tanult meg. ", "asdf jkl; qwer zxcv uiop hjkl ")]
    planted = spark.createDataFrame([(10**9 + k, t, "en", "web", len(t)) for k, t in enumerate(junk)], docs.schema)
    old = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(planted), DATA).collect()}
    assert not [i for i in kept if i >= 10**9]
    long = {i for i, t in old.items() if len(t) >= 400 and len(set(t.split())) > 0.3 * len(t.split())}
    assert len(long & kept) >= 0.98 * len(long) and len(kept) > 0.95 * len(old)


def test_suffixes_removes_repeated_passages_of_over_fifty_words(spark):
    """Whatever they have in bytes: passages of 51 short words lie below 400 bytes, passages of 400 bytes may have fewer words."""
    rng = random.Random(5)

    def own(n, size=5):
        return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=size)) for _ in range(n))

    short, wide, below = own(51, 3), own(20, 30), own(49, 3)
    texts = [f"{own(30)} {short} {own(30)}", f"{own(20)}\n{short.replace(' ', '  ')}\n{own(9)}", f"{own(9)} {wide} {own(9)}", f"{own(9)} {wide} {own(5)}", f"{own(9)} {below} {own(9)}", f"{own(9)} {below} {own(9)}", short, f"é {own(200)}"]
    docs = spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.suffixes(spark, docs, "").collect()}
    assert set(got) == set(range(8)) and not got[6]
    assert len(short.encode()) < 400 < len(wide.encode())
    assert [got[k].split() for k in (0, 1)] == [t.split()[:n] + t.split()[n + 51 :] for n, t in ((30, texts[0]), (20, texts[1]))]
    assert all(wide not in got[k] for k in (2, 3)) and all(got[k] == texts[k] for k in (4, 5, 7))
