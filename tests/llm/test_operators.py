import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from tests.compare import same, views
from tests.llm import nasty

from clademill.llm import bpe, components, context_mix, exact_dedup, lang_id, line_dedup, media, near_dedup, packing, queries, suffix_dedup, token_counts

DATA = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def docs(spark):
    return nasty.frame(spark).cache()


@pytest.fixture(scope="session")
def real(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_equals_library(spark, docs, real):
    lib = library()
    for rows in (bpe.encode_decode(docs, RANKS).collect(), queries.op1_bpe(spark, DATA).collect()):
        want = Counter()
        for text in [r[1] for r in nasty.rows()] if len(rows) == len(nasty.rows()) else real.values():
            ids = lib.encode_ordinary(text or "")
            want[len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
        assert Counter((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in queries.op1_bpe(spark, DATA).collect()}
    assert got == {i: (len(ids := lib.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()) for i, t in real.items()}
    assert bpe.encode_decode(nasty.empty(spark), RANKS).count() == 0


def test_bpe_long_runs_and_other_patterns():
    lib = library()
    for text in ("a" * 30000, " " * 9000, "ab" * 9000, "\x1c\x1d \x85x", "é" * 3000):
        assert np.frombuffer(bpe.encode_text(text, RANKS, bpe.STANDARD), "<u4").tolist() == lib.encode_ordinary(text)
    assert b"".join(bpe.decode_ids(bpe.encode_text("split on it", RANKS, r"\w+|\W+"), RANKS)) == b"split on it"


def test_exact_dedup(spark, docs):
    def brute(rows):
        groups = defaultdict(list)
        for i, t in rows:
            groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is not None, i))
        out = Counter()
        for norm, members in groups.items():
            keep = min(members)[2]
            for _, _, i in members:
                out[i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()] += 1
        return out

    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect())
    assert got == brute([r[:2] for r in nasty.rows()])
    assert not same(queries.op4_exact_dedup(spark, DATA), views(DATA), queries.ORACLE_SQL["op4_exact_dedup"])
    assert exact_dedup.exact_dedup(nasty.empty(spark)).count() == 0
    # One group over many partitions.
    one = spark.createDataFrame([(k, "same text") for k in range(500)] + [(1000 + k, f"t{k}") for k in range(50)], "doc_id long, text string")
    got = exact_dedup.exact_dedup(one.repartition(7), partitions=9).collect()
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id < 500} == {(0, 500)} and sum(r.kept for r in got) == 51


def test_media_round_trip(spark, docs, tmp_path, monkeypatch):
    got = media.media_columns(docs).collect()
    want = Counter()
    for r in nasty.rows():
        raw = (r[1] or "").encode()
        payload = raw + bytes((-len(raw)) % 64 if raw else 64)
        want[r[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), media.features(payload)] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) for r in got) == want
    assert all(len({r[k] for r in got if r.payload_sha256 == x}) == 1 for x in {r.payload_sha256 for r in got} for k in ("media_bytes", "media_sha256", "feature"))
    assert media.media_columns(nasty.empty(spark)).count() == 0
    # Byte ranges that cut members: each member once.
    archives = media.write_archives(docs, str(tmp_path / "a"))
    assert media.read_archives(spark, archives, range_bytes=100).count() == len(nasty.rows())
    # A member that fails is tried again by itself.
    reader, real, calls = media._Reader({"listing": "", "attempts": "3"}), media._Reader._member, []

    def flaky(path, member):
        calls.append(member.header_offset)
        if len(calls) < 3:
            raise OSError("gone")
        return real(path, member)

    path, size = archives[0]
    member = media._Reader._directory(media._Range(path, 0, size))[0]
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    assert media.from_png(reader._again(lambda: flaky(path, member), "m")) and len(calls) == 3
    with pytest.raises(RuntimeError):
        reader._again(lambda: media.from_png(b"bad"), "m")


def test_language_id(spark, docs):
    got = queries.op3_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    rows = lang_id.language_id(docs).collect()
    assert len(rows) == len(nasty.rows()) and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert all(by[k].lang_pred == "und" for k in (0, 1, 2, 4, 16)) and by[5].lang_pred in ("en", "fr")
    assert lang_id.language_id(nasty.empty(spark)).count() == 0


def test_language_bundle_is_the_sum_of_bound_letters(monkeypatch):
    """Every letter of any script has a vector of its own; n-grams are bound by turning and multiplying, whatever the size of the parts."""
    texts = ["Ab, cÄ ab", "漢字かな交じり文", "", "42", "x"]
    table = {ord(c): v for c, v in zip(sorted(set("".join(texts).lower())), lang_id.letter_vectors(np.array([ord(c) for c in sorted(set("".join(texts).lower()))])), strict=True)}
    table[0] = lang_id.letter_vectors(np.array([0]))[0]
    assert len({v.tobytes() for v in table.values()}) == len(table) and set(np.unique(np.stack(list(table.values())))) == {-1.0, 1.0}
    want = []
    for t in texts:
        seen = [0, *(ord(c) if c.isalpha() else 0 for c in re.sub(r"[\W\d_]+", " ", t.lower())), 0]
        seen = [c for k, c in enumerate(seen) if c or not k or seen[k - 1]]
        want.append(sum((np.roll(table[a], 2) * np.roll(table[b], 1) * table[c] for a, b, c in zip(seen, seen[1:], seen[2:], strict=False) if b), np.zeros(lang_id.DIMENSION)))
    for size in (16384, 3):
        monkeypatch.setattr(lang_id, "VECTORS", size)
        assert np.allclose(lang_id.bundles(texts, [0, 1, 2, 3, 4], 5), np.array(want))


def test_language_query_equals_brute_force(spark, real):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()
    total = defaultdict(lambda: np.zeros(lang_id.DIMENSION))
    vector = {r.doc_id: sum(map(lambda g: lang_id.gram_vectors(g[None])[0], lang_id.grams(r.text or "")[:400]), np.zeros(lang_id.DIMENSION)) if len(r.text or "") < 400 else lang_id.bundles([r.text], [0], 1)[0] for r in rows}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None and r.text is not None:
            total[r.lang] += vector[r.doc_id]
    langs = sorted(total)
    got = {r.doc_id: r for r in queries.op3_language_id(spark, DATA).collect()}
    assert len(got) == len(rows)
    for r in rows:
        v = vector[r.doc_id]
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if not v.any():
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        near = np.array([v @ total[k] / np.linalg.norm(v) / np.linalg.norm(total[k]) for k in langs])
        if np.diff(np.sort(near))[-1] > 1e-4:
            assert got[r.doc_id].lang_pred == langs[int(np.argmax(near))]
        assert abs(got[r.doc_id].cosine - near.max()) < 1e-4
        assert abs(got[r.doc_id].score - 1 / np.exp((near - near.max()) / lang_id.TEMPERATURE).sum()) < 1e-3


def test_lm_scores(spark, docs, real):
    train = Counter()
    for i, t in real.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update([*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), b""])
    n, v = sum(train.values()), len(train)
    got = {r.doc_id: r for r in queries.op2_lm_score(spark, DATA).collect()}
    assert len(got) == len(real)
    for i, t in real.items():
        tokens = [*t.encode().lower().split(), b""]
        base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 5 == 1, len(tokens), sum(train[w] > 0 for w in tokens), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    # Both folds are scored as unseen, and a document that occurs twice stands out.
    copies = Counter(real.values())
    bits = {h: sum(got[i].score for i, t in real.items() if got[i].held_out == h and copies[t] == 1) / sum(len(t.encode()) for i, t in real.items() if got[i].held_out == h and copies[t] == 1) for h in (False, True)}
    assert abs(bits[True] / bits[False] - 1) < 0.15
    long = [i for i, t in real.items() if len(t.split()) > 60]
    twice, once = ([got[i].bits_per_byte for i in long if (copies[real[i]] > 1) == x] for x in (True, False))
    assert twice and np.median(twice) < 0.5 * np.quantile(once, 0.25)
    known = [r for r in got.values() if r.held_out and r.n_known == r.n_tokens]
    assert sum(r.score for r in known) > sum(r.base_score for r in known)
    rows = context_mix.lm_scores(docs).collect()
    assert len(rows) == len(nasty.rows()) and all(r.score < 0 and r.n_tokens >= 1 for r in rows)
    assert context_mix.lm_scores(nasty.empty(spark)).count() == 0


def test_lm_score_without_guesses_is_the_plain_formula(spark):
    """Documents in which no guess is possible: words are drawn by the counts of the other documents, and those without a count are spelt."""
    rng = random.Random(4)
    pool = [f"w{k}" for k in range(40)]
    texts = [" ".join([*rng.sample(pool, 5), f"own{k}x"]) for k in range(60)]
    got = {r.doc_id: r for r in context_mix.lm_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in range(60)}
    train = Counter(w for k, t in enumerate(texts) if not held[k] for w in [*t.encode().split(), b""])
    total, once = sum(train.values()), [w for w, n in train.items() if n == 1]
    escape = (len(once) + 0.5) / (total + 1)
    speller = context_mix.Speller(context_mix.spelling_counts(spark.createDataFrame([(w,) for w in once], "word binary")))
    for k, t in enumerate(texts):
        own = Counter() if held[k] else Counter([*t.encode().split(), b""])
        want, fresh = 0.0, []
        for w in [*t.encode().split(), b""]:
            n = train[w] - own[w]
            if n > 0:
                want += math.log10((1 - escape) * n / (total - sum(own.values())))
            else:
                fresh.append(w)
        for j, w in enumerate(fresh):
            want += math.log10(escape * context_mix.NEW_WORDS / (context_mix.NEW_WORDS + j)) + float(speller([w], np.array([train[w] == 1]))[0])
        assert abs(got[k].score - want) < 1e-5 * abs(want)


def test_lm_bits_are_probabilities():
    """Whatever came before, a bit and its opposite have probability 1 together, in guesses and in spelling."""
    rng = np.random.default_rng(3)
    tables = context_mix.logits([rng.integers(0, 50, (n, 2)) for n in context_mix.table_sizes()])
    n = 300
    kind = rng.integers(0, 3, n)
    slots = [kind * context_mix.STATES + rng.integers(0, 32, n), *((kind << context_mix.SLOT_BITS) + rng.integers(0, 1 << context_mix.SLOT_BITS, n) for _ in range(2))]
    bit = rng.integers(0, 2, n).astype(np.int8)
    for m in (1, 40, 170, 300):
        scores = []
        for last in (0, 1):
            one = bit[:m].copy()
            one[-1] = last
            scores.append(context_mix.score_bits(context_mix.Bits(np.zeros(m, np.int64), kind[:m], one, [s[:m] for s in slots], np.zeros(0, bool)), tables, 1)[0])
        before = context_mix.score_bits(context_mix.Bits(np.zeros(m - 1, np.int64), kind[: m - 1], bit[: m - 1], [s[: m - 1] for s in slots], np.zeros(0, bool)), tables, 1)[0]
        assert abs(sum(10 ** (x - before) for x in scores) - 1) < 1e-6
    spell = context_mix.Speller([rng.integers(0, 65536, 1 << context_mix.SPELL_BITS).astype(np.uint16) for _ in context_mix.SPELL_ORDERS])
    total = sum(10 ** spell([bytes([b])], np.array([False]))[0] for b in range(256))
    assert total <= 1 + 1e-6  # words of one byte, each with the space behind it


def test_lm_matches_equal_brute_force(spark):
    rng = random.Random(9)
    base = [f"t{rng.randint(0, 500)}" for _ in range(400)]
    docs = []
    for k in range(30):
        own = [f"d{k}_{j}" for j in range(rng.randint(0, 20))]
        a = rng.randint(0, 300)
        piece = base[a : a + rng.randint(20, 100)]
        piece[rng.randrange(len(piece))] = f"e{k}"
        docs.append((k, k % 3 == 0, own + piece))
    vocab = context_mix.Vocabulary([b""], np.array([1]), 1, 1, 1)
    rows = spark.createDataFrame([(k, k * 7, " ".join(t), h) for k, h, t in docs], "id long, hash long, text string, held boolean").repartition(4)
    ordered = context_mix.places(rows, spark.sparkContext.broadcast(vocab)).repartition(3, "kind", "key").sortWithinPartitions("kind", "key", "held", "deal", "id", "hash", "pos")
    got = {(r.id, r.pos): (r.right, r.failed, r.agree) for r in context_mix.matches(ordered).where("kind = 0").collect()}
    vocab.build()
    groups, runs = defaultdict(list), {}
    for k in range(len(docs)):
        tokens = context_mix.Tokens.of(vocab, [" ".join(docs[k][2])])
        at, keys, length = context_mix.anchors(tokens)
        whole = [*docs[k][2], ""]
        for a, key, n in zip(at.tolist(), keys.tolist(), length.tolist(), strict=True):
            assert a >= context_mix.CONTEXT
            groups[key].append((k, a))
            runs[k, a] = whole[a : a + n]
    for key, members in groups.items():
        for k, a in members:
            others = [runs[j, b] for j, b in members if j != k and not docs[j][1]]
            if not others:
                assert (k, a) not in got
                continue
            lengths = set()
            for run in others:
                n = next((x for x in range(min(len(run), len(runs[k, a]))) if run[x] != runs[k, a][x]), min(len(run), len(runs[k, a])))
                lengths.add((n, n < min(len(run), len(runs[k, a]))))
            assert got[k, a][:2] in lengths  # the guess is the run of another training document
    assert len(got) > 20


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(JSON)
    lib.encode_special_tokens = True
    for frame, size in ((docs, 64), (spark.read.parquet(f"{DATA}/documents.parquet"), 2048)):
        rows = packing.pack_documents(frame, JSON, size=size).collect()
        ids = defaultdict(list)
        for r in frame.select("doc_id", "text").collect():
            ids[r.doc_id].append(np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4"))
        assert sum(r.length for r in rows) == sum(len(x) for many in ids.values() for x in many)
        assert all(any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id]) for r in rows)
        assert all(r.length <= size and (r.piece == 0 or r.length == size) for r in rows)
        bins = defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for members in bins.values():
            at = 0
            for offset, length in sorted(members):
                assert offset == at
                at += length
            assert at <= size
        assert len(bins) <= math.ceil(sum(r.length for r in rows) / size * 1.02) + 1
    assert packing.pack_documents(nasty.empty(spark), JSON).count() == 0


def test_every_context_that_another_training_document_has_is_matched(spark):
    """Short shared passages, documents that come together and part, copies: wherever the last words occur in another training document there is a guess, with no place left out between anchors."""
    rng = random.Random(8)
    base = [f"t{rng.randint(0, 500)}" for _ in range(300)]
    docs = []
    for k in range(40):
        text = [f"d{k}_{j}" for j in range(rng.randint(0, 9))]
        for j in range(rng.randint(1, 5)):
            a = rng.randint(0, 280)
            text += [*base[a : a + rng.randint(7, 25)], f"e{k}_{j}"]
        docs.append((k, k % 3 == 0, text))
    docs += [(40, False, docs[1][2]), (41, True, docs[2][2])]
    vocab = context_mix.Vocabulary([b""], np.array([1]), 1, 1, 1)
    shared = spark.sparkContext.broadcast(vocab)
    rows = spark.createDataFrame([(k, k * 7, " ".join(t), h) for k, h, t in docs], "id long, hash long, text string, held boolean").repartition(4)
    sets = spark.sparkContext.broadcast(context_mix.branches(rows, shared, 2000))
    ordered = context_mix.places(rows, shared, sets).repartition(3, "kind", "key").sortWithinPartitions("kind", "key", "held", "deal", "id", "hash", "pos")
    guessed = defaultdict(set)
    for r in context_mix.matches(ordered).where("kind = 0").collect():
        guessed[r.id] |= set(range(r.pos, r.pos + r.right + r.failed))
    having = defaultdict(set)
    for k, held, t in docs:
        for a in range(6, len(t) + 1):
            having[tuple(t[a - 6 : a])] |= set() if held else {k}
    n = 0
    for k, _, t in docs:
        for a in range(6, len(t) + 1):
            if having[tuple(t[a - 6 : a])] - {k}:
                n += 1
                assert a in guessed[k]
    assert n > 500


def test_packing_query_gives_added_tokens_their_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(JSON)
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|><|endoftext|> y\n", "<|endoftext|", "plain text"]
    assert lib.encode(texts[1], add_special_tokens=False).ids == [50256]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.length, r.ids_crc32) for r in queries.op5_packing(spark, str(tmp_path)).collect()}
    ids = [np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4") for t in texts]
    assert got == {k: (len(x), zlib.crc32(x.tobytes())) for k, x in enumerate(ids)}


def test_packing_evolves_beyond_its_start():
    """Triplets that fill a bin exactly: best fit of the sorted pieces wastes bins, and crossover wins some back."""
    rng = np.random.default_rng(5)
    a = rng.integers(380, 499, 40)
    b = rng.integers(250, (1000 - a) // 2 + 1)
    lengths = np.concatenate([a, b, 1000 - a - b]).tolist()
    first = packing.start(rng, lengths, 1000, 0.0)
    population = [first, *(packing.start(rng, lengths, 1000, 0.05 * k) for k in (1, 2, 3))]
    best = max(s.value for s in population)
    evolved = packing.evolve(population, lengths, 1000, rng, children=300)[0]
    assert evolved.value > best and len(evolved.bins) < len(first.bins)
    assert sorted(i for b in evolved.bins for i in b) == list(range(120))


def test_packing_gathers_the_room_of_all_shards(spark, monkeypatch):
    """With many shards, the sequences are those of the global bound and few more: the last bins of the shards are packed again together."""
    monkeypatch.setattr(packing, "SHARD", 150)
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 900, 6000).tolist()
    made = spark.createDataFrame([(k, 0, n) for k, n in enumerate(lengths)], "row long, piece int, length long").repartition(4)
    rows = packing.pack(made, 2048).collect()
    assert sorted(r.row for r in rows) == list(range(6000))
    bound = math.ceil(sum(lengths) / 2048)
    assert len({r.sequence_id for r in rows}) <= bound + 3


def test_packing_ids_of_other_vocabularies_come_from_the_library():
    from tokenizers import Tokenizer

    other = public_tokenizers.path("word_bpe_49k.json")
    lib, texts = Tokenizer.from_file(other), ["Some words, and more.", "", "naïve café"]
    assert packing.ids_of(other).ranks is None and packing.ids_of(JSON).ranks is not None
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.token_ids(texts, other, True)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 300).tolist()
    one, two = packing.start(rng, lengths, 100, 0.3), packing.start(rng, lengths, 100, 0.3)
    child = packing.crossover(rng, one, two, lengths, 100)
    assert sorted(i for b in child.bins for i in b) == list(range(300)) and min(child.room) >= 0
    assert all(100 - sum(lengths[i] for i in b) == r for b, r in zip(child.bins, child.room, strict=True))


def test_token_counts(spark, docs, real):
    lib = library()

    def brute(text, spans):
        counts, at = [0] * len(spans), 0
        starts = np.cumsum([0, *(len(c.encode()) for c in text)])
        ids = lib.encode_ordinary(text)
        for i in ids:
            size = len(lib.decode_single_token_bytes(i))
            a = int(np.searchsorted(starts, at, "right")) - 1
            b = int(np.searchsorted(starts, at + size - 1, "right"))
            best = max(range(len(spans)), key=lambda k: (max(0, min(b, spans[k][1]) - max(a, spans[k][0])), -spans[k][0], -k), default=None)
            if best is not None and min(b, spans[best][1]) > max(a, spans[best][0]):
                counts[best] += 1
            at += size
        return len(ids), counts

    for frame in (docs, spark.read.parquet(f"{DATA}/documents.parquet")):
        texts = defaultdict(list)
        for r in frame.select("doc_id", "text").collect():
            texts[r.doc_id].append(r.text or "")
        found = defaultdict(list)
        for r in token_counts.token_counts(frame, RANKS).collect():
            found[r.doc_id].append(r)
        assert set(found) == {i for i, some in texts.items() if any(some)}  # only documents without text have no row
        for i, rows in found.items():
            if len(texts[i]) == 1:
                rows.sort(key=lambda r: r.start)
                assert rows[0].start == 0 and rows[-1].end == len(texts[i][0])
                assert brute(texts[i][0], [(r.start, r.end) for r in rows]) == (rows[0].doc_tokens, [r.n_tokens for r in rows])
    assert token_counts.token_counts(nasty.empty(spark), RANKS).count() == 0
    text = "héllo wörld  \n\n  the end of it"
    for spans in ([(0, 3), (2, 9)], [(1, 2), (4, 30)], [(5, 40)]):
        assert token_counts.section_counts(text, [a for a, _ in spans], [b for _, b in spans], RANKS) == brute(text, spans)


def plain_lines(rows):
    """(id, text) -> what is left: of each line's content only the first place stays, by identifier (null first) and position. Equal rows are one place."""
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        lines, own = (t or "").split("\n"), []
        for line in lines:
            content = line.strip(" \t\n\x0b\x0c\r")
            if not content or content not in seen:
                own.append(line)
            seen |= {content} if content else set()
        out[i, t] = t if len(own) == len(lines) else "\n".join(own), sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in lines), len(lines) - len(own)
    return out


def test_line_dedup(spark, docs, real):
    for frame in (docs, spark.read.parquet(f"{DATA}/documents.parquet")):
        rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
        want = plain_lines(rows)
        got = line_dedup.line_dedup(frame, carry=("source",)).collect()
        assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got) == Counter((i, *want[i, t]) for i, t in rows)
    got = queries.op7_line_dedup(spark, DATA).collect()
    want = plain_lines(list(real.items()))
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in got} == {i: (want[i, t][1], want[i, t][2], hashlib.sha256((want[i, t][0] or "").encode()).hexdigest()) for i, t in real.items()}
    assert line_dedup.line_dedup(nasty.empty(spark)).count() == 0


def test_line_dedup_of_one_identifier_with_two_texts(spark):
    rows = [(1, "alpha\nbeta\ngamma\ndelta"), (2, "u1\nu2\nu3\nu4\nu5\nu6"), (2, "alpha\nbeta\ngamma\ndelta")]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, rows[0][1]), (2, ""), (2, rows[1][1])]


def test_line_dedup_removes_every_repeated_line(spark):
    """All repeated runs, of one line as well: by brute force each line but the first place of its content goes."""
    rng = np.random.default_rng(5)
    one = "a paragraph of one line " * 12
    rows = [(k, "\n".join((f"own {k} a", one, f"own {k} b"))) for k in range(20)] + [(20, one), (21, one), (30, "X\nY"), (31, "X\nY\nZ"), (32, "X\nY\nZ")]
    rows += [(100 + k, "\n".join(f"line {x}" for x in rng.integers(0, 60, rng.integers(1, 9)))) for k in range(60)]
    seen, want = set(), {}
    for i, t in rows:
        left = []
        for line in t.split("\n"):
            if line.strip() not in seen:
                left.append(line)
            seen.add(line.strip())
        want[i] = "\n".join(left)
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()} == want


def test_winnowing_guarantee():
    rng = np.random.default_rng(0)
    for _ in range(50):
        run = rng.integers(0, 1 << 60, line_dedup.GRAM + line_dedup.WINDOW - 1).astype(np.uint64)
        one, two = (np.concatenate((rng.integers(0, 1 << 60, 5).astype(np.uint64), run, rng.integers(0, 1 << 60, 5).astype(np.uint64))) for _ in range(2))
        assert set(line_dedup.fingerprints(one)[1].tolist()) & set(line_dedup.fingerprints(two)[1].tolist())


def brute_repeats(rows, length=400):
    count = Counter(t[k : k + length] for _, t in rows for k in range(len(t) - length + 1))
    out = Counter()
    for i, t in rows:
        cover = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                cover[k : k + length] = b"\1" * length
        kept = bytes(x for x, c in zip(t, cover, strict=True) if not c)
        out[i, len(t), sum(cover), sum(c and not (k and cover[k - 1]) for k, c in enumerate(cover)), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_suffix_dedup(spark, docs, real):
    for frame in (docs, spark.read.parquet(f"{DATA}/documents.parquet")):
        rows = [(r.doc_id, (r.text or "").encode()) for r in frame.select("doc_id", "text").collect()]
        got = suffix_dedup.suffix_dedup(frame).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got) == brute_repeats(rows)
    assert suffix_dedup.suffix_dedup(nasty.empty(spark)).count() == 0


def test_suffix_query(spark, real):
    want = brute_repeats([(i, (t or "").encode()) for i, t in real.items()])
    got = queries.op8_suffix_dedup(spark, DATA).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(r.repeats == (r.n_removed > 0) and r.n_kept == r.n_bytes - r.n_removed for r in got)


def test_suffix_query_counts_words_of_repeated_passages(spark, real):
    """Passages of over 50 words that are shorter than 400 bytes are no repeated strings of the digest, but they are counted."""
    texts = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in real.items()}
    count = Counter(tuple(w[k : k + 50]) for w in texts.values() for k in range(len(w) - 49))
    got = {r.doc_id: r for r in queries.op8_suffix_dedup(spark, DATA).collect()}
    for i, w in texts.items():
        covered = {j for k in range(len(w) - 49) if count[tuple(w[k : k + 50])] > 1 for j in range(k, k + 50)}
        assert (got[i].n_passage_words, got[i].passages) == (len(covered), bool(covered))
    assert any(r.passages and not r.repeats for r in got.values())


def test_suffix_queues_on_disk_equal_arrays_and_brute_force():
    """Seeds of a key beyond the number for arrays go through queues on disk; long texts are cut into parts. A licence between random bytes gives keys with many contexts."""
    rng = random.Random(1)
    shared = bytes(rng.choices(b"abcdefgh ", k=900))

    def cover(raws, chunk, part, monkey):
        monkey.setattr(suffix_dedup, "PART", part)
        rows = []
        for b in suffix_dedup.contexts(raws, np.arange(len(raws)), np.arange(len(raws))):
            rows += zip(*(b.column(k).to_pylist() for k in range(6)), strict=True)
        rows.sort(key=lambda r: r[:3])
        kinds = [pa.int64(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 3]
        batches = [pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[k : k + 50], strict=True), kinds, strict=True)], list("abcdef")) for k in range(0, len(rows), 50)]
        out = [bytearray(len(r)) for r in raws]
        for b in suffix_dedup.induced(batches, chunk):
            for i, _, x, y in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                out[i][x:y] = b"\1" * (y - x)
        return out

    for _ in range(2):
        raws = [b"x" * 700, b"ab" * 600, b"short", b""]
        for _ in range(60):
            a, z = rng.choice([(0, 900), (rng.randint(0, 300), rng.randint(600, 900))])
            raws.append(bytes(rng.choices(b"ab", k=rng.randint(0, 500))) + shared[a:z] + bytes(rng.choices(b"ab", k=rng.randint(0, 500))))
        raws += [raws[9], raws[9]]
        count = Counter(r[k : k + 400] for r in raws for k in range(len(r) - 399))
        want = [bytearray(len(r)) for r in raws]
        for r, w in zip(raws, want, strict=True):
            for k in range(len(r) - 399):
                if count[r[k : k + 400]] > 1:
                    w[k : k + 400] = b"\1" * 400
        for chunk, part in ((1 << 20, 1 << 20), (3, 1 << 20), (1, 1 << 20), (7, 500)):
            with pytest.MonkeyPatch.context() as monkey:
                assert cover(raws, chunk, part, monkey) == want


def brute_components(rows, k, share):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted((j for j in range(len(rows)) if rows[j][0] is not None), key=lambda j: rows[j][0])
    for a, x in enumerate(order):
        for y in order[a + 1 :]:
            common = len(sets[x] & sets[y])
            if common and share[1] * common >= share[0] * len(sets[x] | sets[y]):
                one, two = sorted((find(x), find(y)), key=order.index)
                parent[two] = one
    return Counter((rows[j][0], len(sets[j]), rows[find(j)][0] if rows[j][0] is not None else None) for j in range(len(rows)))


def test_near_dedup(spark, docs, real):
    rows = [r[:2] for r in nasty.rows()]
    for k, share in ((3, (85, 100)), (5, (80, 100))):
        got = near_dedup.near_dedup(docs, k=k, share=share).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, k, share)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dedup.near_dedup(nasty.empty(spark)).count() == 0


def test_near_dedup_finds_pairs_that_the_smallest_class_misses(spark):
    """A chain in one key: neighbours are alike, the ends are not."""
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(400)]
    rows = [(0, " ".join(words))]
    for k in range(1, 12):
        for j in rng.choice(400, 6, replace=False):
            words[j] = f"n{k}_{j}"
        rows.append((k, " ".join(words)))
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), k=3, share=(85, 100)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 3, (85, 100))


def test_near_dedup_blocks_find_every_pair_that_shares_a_key(spark):
    """Pairs at the threshold, neither of which is the least class of a key, each judged in the blocks of all keys that it shares."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(800):
        words = [f"w{k}_{j}" for j in range(400)]
        rows.append((2 * k, " ".join(words)))
        for j in rng.choice(400, 10, replace=False):
            words[j] = f"n{k}_{j}"
        rows.append((2 * k + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = near_dedup.signatures(docs, 3).cache()
    keys = {r.doc_id: r["keys"] for r in signed.select("doc_id", "keys").collect()}
    sets = {i: near_dedup.shingle_set(t, 3) for i, t in rows}
    groups, want = [], set()
    for a in range(0, len(rows), 2):
        b, common = a + 1, len(np.intersect1d(sets[a], sets[a + 1]))
        shared = set(keys[a]) & set(keys[b])
        if shared and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
            want.add((b, a))
        groups += [(key, c, c, 2) for key in shared for c in (a, b)]
    split = spark.createDataFrame(groups, "key long, class long, comp long, n long")
    sketch = signed.select(signed.doc_id.alias("class"), signed.n_shingles.cast("int").alias("n"), "registers", "keys")
    got = {(r.a, r.b) for r in near_dedup._across(docs, split, sketch, 3, (85, 100)).collect()}
    assert len(want) > 300 and want <= got


def test_estimate_is_close():
    rng = np.random.default_rng(4)
    for share in (0.5, 0.8, 0.95):
        pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
        n = int(2000 * (1 + share) / 2)
        one, two = np.sort(pool[:n]), np.sort(np.concatenate((pool[: int(2000 * share)], pool[2000 : 2000 + n - int(2000 * share)])))
        true = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
        agree = (near_dedup.sketches([one]) == near_dedup.sketches([two])).mean()
        assert abs(near_dedup.estimate(agree, len(one), len(two)) - true) < 0.15


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 101: 100, 102: 100}


def test_pattern_classes():
    for text in ("it's ²½ x y_z ÀÉ\x85 ok", "Ωmega  　x ٣ⅷ"):
        assert bpe.splitter(text, bpe.STANDARD).findall(text) == regex.findall(public_tokenizers.PATTERN, text)


def test_lm_anchors_are_sorted_by_key_first(spark, monkeypatch):
    """Spark compares rows by the first sort column's prefix alone where these differ; by kind first, nearly all are equal and whole rows are compared."""
    plans = []
    real = context_mix.matches

    def spy(found, **options):
        plans.append(found._jdf.queryExecution().sparkPlan().toString())
        return real(found, **options)

    monkeypatch.setattr(context_mix, "matches", spy)
    assert context_mix.lm_scores(spark.createDataFrame([(k, "a b c d e f g h") for k in range(4)], "doc_id long, text string")).count() == 4
    assert len(plans) == 1 and re.search(r"Sort \[key#", plans[0])


def test_lm_stretches_cost_only_the_documents_that_go_on(monkeypatch):
    """Of one long document among many short ones, each has the score that it has alone, and no step works on all of them."""
    rng = np.random.default_rng(6)
    tables = context_mix.logits([rng.integers(0, 50, (n, 2)) for n in context_mix.table_sizes()])
    sizes = [3, 40, 0, 32 * 20, *rng.integers(0, 90, 60).tolist()]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    n = len(doc)
    kind = rng.integers(0, 3, n)
    slots = [kind * context_mix.STATES + rng.integers(0, 32, n), *((kind << context_mix.SLOT_BITS) + rng.integers(0, 1 << context_mix.SLOT_BITS, n) for _ in range(2))]
    bit = rng.integers(0, 2, n).astype(np.int8)

    def score(some, which):
        return context_mix.score_bits(context_mix.Bits(which, kind[some], bit[some], [s[some] for s in slots], np.zeros(0, bool)), tables, int(which.max(initial=0)) + 1 if len(some) < n else len(sizes))

    sums = []
    real = np.bincount

    def spy(x, weights=None, minlength=0):
        out = real(x, weights, minlength)
        sums.append(len(out))
        return out

    monkeypatch.setattr(np, "bincount", spy)
    together = score(np.arange(n), doc)
    monkeypatch.undo()
    assert sum(sums) < 20 * len(sizes) * context_mix.KINDS * context_mix.LEVELS
    for d in range(len(sizes)):
        some = np.flatnonzero(doc == d)
        assert together[d] == score(some, np.zeros(len(some), np.int64))[0]


def test_lm_matches_packed_are_the_same(spark):
    """Packed, a document has one row for many anchors, with the same numbers."""
    rng = random.Random(2)
    base = [f"t{rng.randint(0, 90)}" for _ in range(200)]
    texts = [" ".join([f"d{k}", *base[a : a + 60]]) for k, a in enumerate(rng.randint(0, 140) for _ in range(20))]
    vocab = context_mix.Vocabulary([b""], np.array([1]), 1, 1, 1)
    rows = spark.createDataFrame([(k, k * 7 - 50, t, k % 4 == 0) for k, t in enumerate([*texts, texts[3]])], "id long, hash long, text string, held boolean").repartition(4)
    ordered = context_mix.places(rows, spark.sparkContext.broadcast(vocab)).repartition(3, "kind", "key").sortWithinPartitions("key", "kind", "held", "deal", "id", "hash", "pos")
    flat = {(r.id, r.hash, r.pos, r.right, int(r.failed), r.wrong, r.agree) for r in context_mix.matches(ordered).where("kind = 0").collect()}
    packed = context_mix.matches(ordered, packed=True).where("kind = 0").collect()
    assert {(r.id, r.hash, *x) for r in packed for x in np.frombuffer(r.tables, "<u4").reshape(-1, 5).tolist()} == flat
    assert len(packed) < len(flat) / 2
