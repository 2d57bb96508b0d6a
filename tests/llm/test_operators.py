"""The corpus operators against brute force, exact round trips and held-out labels, and on awkward rows.

The awkward table has nulls in any column, empty and very long texts, ties, repeated rows, and extra columns whose names
clash with results; and each operator is run on the table without rows.
"""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from laminar.llm import (
    html_text,
    language_id,
    near_dedup,
    neighbours,
    packing,
    quality_classifier,
    quality_rules,
    sentencepieces,
    sharding,
    warc,
)
from laminar.llm._shared import LOWER, shingles_of, text_buffers, words_of
from laminar.llm.queries import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, kept boolean, rules string"
LONG = "word another third fourth fifth. " * 4000


@pytest.fixture(scope="module")
def awkward(spark):
    base = [
        (1, "the cat sat on the mat and the dog ran off", "en"), (2, "", "en"), (3, None, None), (None, "le chat et le chien sont dans la maison", "fr"),
        (5, LONG, None), (6, " \n\t ", "fr"), (7, "the cat sat on the mat and the dog ran off", "en"), (7, "the cat sat on the mat and the dog ran off", "en"),
        (8, "日本語 テスト é́ ▁ a  b", None), (9, "one two", "en"), (10, "...", "en"), (-4, "le chat et le chien sont dans la maison", "fr"),
    ]
    rows = [(i, t, lang, None if k % 2 else "s", None, 1.0, 3, None, "x") for k, (i, t, lang) in enumerate(base)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents():
    import pyarrow.parquet as pq

    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


# Shared helpers.


def test_words_and_shingles():
    texts = ["A b\tc", "", "x", " a B  c ", "é f g", "a b c a b c a"]
    data = list(text_buffers(pa.array(texts)))[0]
    hashes, bounds = words_of(data[1], data[2], LOWER)
    assert np.diff(bounds).tolist() == [len(WORD.findall(t)) for t in texts]
    sets = shingles_of(hashes, bounds, 3)
    assert np.array_equal(sets[0], sets[3]) and len(sets[1]) == 0 and len(sets[2]) == 1 and len(sets[5]) == 3
    small = [x for first, d, o in text_buffers(pa.array(texts), 4) for x in shingles_of(*words_of(d, o, LOWER), 3)]
    assert [x.tolist() for x in small] == [x.tolist() for x in sets]


# 1. Language identification.


def brute_path(scores, switch):
    """The best score of any labelling, by trying all."""
    import itertools

    n, k = scores.shape
    return max(sum(scores[t, p[t]] for t in range(n)) - switch * sum(a != b for a, b in zip(p, p[1:], strict=False)) for p in itertools.product(range(k), repeat=n))


def test_viterbi():
    draw = np.random.default_rng(3)
    for _ in range(60):
        texts = [-draw.random((n, 3)) * 6 for n in (6, 1, 3, 6, 5)]
        for switch in (0.5, 3.0, 20.0):
            for scores, path in zip(texts, language_id.viterbi(texts, switch), strict=True):
                own = scores[np.arange(len(scores)), path].sum() - switch * np.count_nonzero(np.diff(path))
                assert own == pytest.approx(brute_path(scores, switch))
            scores, path = texts[0], language_id.viterbi(texts, switch)[0]
            own = scores[np.arange(6), path].sum() - switch * np.count_nonzero(np.diff(path))
            lead = language_id.settled(scores, switch)
            assert lead < 0 or scores[:, lead].sum() == pytest.approx(own)


def test_spans_and_scripts():
    model = language_id.fit({"en": language_id.counted(["the cat house the cat the"] * 3), "fr": language_id.counted(["le chat maison le chat le"] * 3), "ru": language_id.counted(["кот дом"] * 5)})
    labeller = language_id.Labeller(model, 2.0)
    text = "the cat the house the cat кот дом le chat le maison le chat"
    labels, scores, letters = next(labeller.label([text]))
    assert [x for x, _ in labeller.spans(text, labels, letters)] == ["en", "ru", "fr"]
    assert labeller.predict(labels, scores, letters)[0] in ("en", "fr")
    got = [labeller.predict(*x) for x in labeller.label(["", "123 ...", "漢字", "\u0301 \u0300", "123\u0301", "\u0301le chat"])]
    assert got[0] == got[1] == got[3] == got[4] == (language_id.UNKNOWN, 0.0, 0) and got[5][0] == "fr"


def test_language_scores():
    """The arrays against a plain version: distinct words, their letters, n-grams and smoothed log-probabilities."""
    import unicodedata

    texts = ["The cat, the CAT! 12 e\u0301t\u00e9 x", "", "le  chat-noir\n\u03bb\u03cc\u03b3\u03bf\u03c2 \u0130stanbul", "the"]
    words = language_id.words_of(texts)
    split = [unicodedata.normalize("NFC", t).split() for t in texts]
    assert np.diff(words.bounds).tolist() == [len(x) for x in split]
    ends = np.cumsum(words.sizes)
    known = ["".join(map(chr, words.points[e - n : e])) for e, n in zip(ends, words.sizes, strict=True)]
    for own, i, n in zip(sum(split, []), words.which, words.letters, strict=True):
        want = "".join(c.lower()[0] for c in own if c.isalpha() or unicodedata.category(c)[0] == "M")
        assert n == sum(c.isalpha() for c in own) and (known[i] == want if n else i == -1)
    whole, grams, counts = language_id.columns_of(words)
    assert counts.tolist() == [len(w) for w in known] and len(set(whole.tolist())) == len(known)
    own = {w: grams[e - n : e].tolist() for w, e, n in zip(known, np.cumsum(counts), counts, strict=True)}
    seen = {}
    for w, columns in own.items():
        for g, c in zip([f"^{w}$"[i : i + 3] for i in range(len(w))], columns, strict=True):
            assert seen.setdefault(g, c) == c
    assert len(set(seen.values())) == len(seen)
    model = language_id.fit({"a": language_id.counted(texts[:1]), "b": language_id.counted(texts[1:])})
    at, n = language_id.counted(texts[:1])
    total = n[at < language_id.AT_GRAMS].sum()
    distinct = len({w.lower() for w in known})
    column = whole[known.index("the")]
    assert model.words[column, 0] == pytest.approx(np.log(2.5 / (total + 0.5 * distinct)))


def test_language_sample_bound():
    """Shares of any table, of 10**11 rows as of ten."""
    for n in (10, 4001, 10**6, 10**9, 4 * 10**9, 10**11, 10**15):
        share = language_id.bound(4000, n) / language_id.WHOLE
        assert 0 < share <= 1 and (share == 1 if n <= 4000 else abs(share * n - 4000) < 1)


def test_language_held_out(spark, documents):
    got = {r["doc_id"]: r for r in queries()["op1_language_id"](spark, SF).collect()}
    assert got.keys() == {d["doc_id"] for d in documents}
    held = [d for d in documents if zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0]
    assert all(got[d["doc_id"]]["held_out"] for d in held) and sum(r["held_out"] for r in got.values()) == len(held)
    assert np.mean([got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held]) > 0.95


def test_language_awkward(awkward, nothing):
    model = language_id.train(awkward)
    got = language_id.label(awkward, model, spans=True).collect()
    assert len(got) == 12 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (2, 3, 6, 10)} == {"und"}
    assert language_id.label(nothing, model).count() == 0
    none = language_id.train(nothing)
    assert {r["lang_pred"] for r in language_id.label(awkward, none).collect()} == {"und"}
    assert language_id.keep(awkward, model, 0.1).columns == awkward.columns


def test_language_rare(spark):
    """A language of few texts is learned beside one of many."""
    rows = [(i, f"the cat sat on the mat and dog number w{i % 50} ran off", "en") for i in range(3000)]
    rows += [(5000 + i, "ο σκύλος και η γάτα είναι στο σπίτι", "el") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, 40)
    assert model.langs == ["el", "en"]
    assert {r["lang_pred"] for r in language_id.label(df.where("lang = 'el'"), model).collect()} == {"el"}
    assert language_id.keep(df.where("lang = 'el'"), model, 0.4).count() == 12
    fit_rows = df.where(language_id.fold() > 0)
    taken = {r["lang"]: r["count"] for r in language_id.sample_each(fit_rows, 40).groupBy("lang").count().collect()}
    assert taken["el"] == fit_rows.where("lang = 'el'").count() and 10 < taken["en"] < 100
    assert {r["lang"] for r in language_id.sample_each(fit_rows, 0).select("lang").distinct().collect()} == {"en", "el"}


# 2. Sharding.


def jump(key, n):
    b, j, key = -1, 0, key % 2**64
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 12345, *range(100, 400)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 8, 9, 100):
        got = {r["k"]: r["s"] for r in df.select("k", sharding.jump_hash("k", n).alias("s")).collect()}
        assert got == {k: jump(k, n) for k in keys}


def test_jump_hash_many(spark, monkeypatch):
    """Keys that have not passed the last shard after the first fold go through the second."""
    monkeypatch.setattr(sharding, "STEPS", 3)
    df = spark.range(300)
    assert {r["id"]: r["s"] for r in df.select("id", sharding.jump_hash("id", 1000).alias("s")).collect()} == {k: jump(k, 1000) for k in range(300)}


def test_sharding_text_keys(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None), (None, "y"), ("12", ""), ("a", "x")], "key string, text string")
    got = [(r["key"], r["shard"], r["grown_shard"], r["slot"]) for r in sharding.shard(df, 3, key="key").collect()]
    assert len(got) == 5 and len({s for k, s, _, _ in got if k == "a"}) == 1 and all(g in (s, 3) for _, s, g, _ in got)
    for s in {x[1] for x in got}:
        assert sorted(x[3] for x in got if x[1] == s) == list(range(sum(x[1] == s for x in got)))


def test_sharding_awkward(awkward, nothing):
    got = sharding.shard(awkward).collect()
    assert len(got) == 12
    for r in got:
        assert r["shard"] == jump(r["doc_id"] or 0, 8) and r["grown_shard"] in (r["shard"], 8)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] in (2, 3)} == {(1, 0)}
    assert sharding.shard(nothing).count() == 0


# 3. Packing.


def test_pieces_are_the_tokenizers(spark, documents, awkward):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    tokenizer.encode_special_tokens = True
    rows = [(d["doc_id"], d["text"]) for d in documents[:80]] + [(-k, r["text"]) for k, r in enumerate(awkward.collect(), 1)]
    rows += [(-100, "a  b"), (-101, " lead"), (-102, "x\ny\t z\n"), (-103, "<|endoftext|> a"), (-104, "it's 's.\nIt's, x.,"), (-105, "　 a\u0085b")]
    got = {}
    for r in packing.pieces(spark.createDataFrame(rows, "doc_id long, text string"), with_ids=True).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(got[i], key=lambda r: r["piece"])
        assert [x for r in own for x in r["ids"]] == ids
        assert all(r["length"] == 1024 for r in own[1:]) and all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in own)
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1].tolist()]


def sound(rows, limit):
    """Sequences without gaps or overlaps, none longer than the limit; their number."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= limit
    return len(by)


def test_packing(spark, documents, awkward, nothing):
    rows = packing.op3_best_fit_packing(spark, SF).collect()
    total = sum(r["length"] for r in rows)
    assert sound(rows, 1024) <= total / 1024 * 1.05 + 1
    assert {r["doc_id"] for r in rows} == {d["doc_id"] for d in documents}
    rows = packing.pack_documents(awkward, 64).collect()
    sound(rows, 64)
    assert sum(r["length"] for r in rows if r["doc_id"] in (2, 3)) == 2
    assert packing.pack_documents(nothing).count() == 0


def test_plan():
    draw = np.random.default_rng(1)
    for _ in range(20):
        counts = {int(k): int(draw.integers(1, 40)) for k in draw.integers(1, 100, 30)}
        patterns = packing.plan(counts, 100)
        used = Counter()
        for own, times in patterns:
            assert sum(own) <= 100
            for x in own:
                used[x] += times
        assert used == Counter(counts)
    # 60 + 30 leaves a gap of ten, which 20 + 20 in place of 30 fill.
    assert sorted(packing.plan({60: 1, 30: 1, 20: 2}, 100)[0][0]) == [20, 20, 60]


def brute_plan(counts, limit):
    """Best-two-fit piece by piece: the largest that fits, then the smallest replaced by the two that fill its gap best."""
    left, out = Counter(counts), []
    while left:
        used, room = [], limit
        while fits := [x for x in left if x <= room]:
            used.append(max(fits))
            left = left - Counter([used[-1]])
            room -= used[-1]
        while room:
            pairs = [(x + y, -y) for x in left for y in left if x >= y and x + y <= room + used[-1] and (x != y or left[x] > 1)]
            if not pairs or max(pairs)[0] <= used[-1]:
                break
            total, small = max(pairs)
            left = left + Counter([used[-1]]) - Counter([total + small, -small])
            room += used.pop() - total
            used = sorted([*used, total + small, -small], reverse=True)
        out.append(sorted(used))
    return out


def test_plan_brute():
    draw = np.random.default_rng(5)
    for _ in range(30):
        counts = {int(k): int(draw.integers(1, 9)) for k in draw.integers(5, 90, 12)}
        got = [sorted(own) for own, times in packing.plan(counts, 100) for _ in range(times)]
        want = brute_plan(counts, 100)
        assert sum(map(sum, got)) == sum(map(sum, want)) and abs(len(got) - len(want)) <= 1
        assert got[0] == want[0]


def test_encoder_exact():
    """Ids are those of the tokenizer on whole texts, whatever stands between words."""
    import random

    own = packing.encoder(packing.default_tokenizer())
    draw = random.Random(1)
    signs = ["a", "B", "é", "ß", ".", ",", "'s", " ", "\n", "1", "23", "日", "!", "\r", "\t", "word", "\u0120", " the", "²", "ª", "_", '"']
    texts = ["".join(draw.choices(signs, k=draw.randint(0, 12))) for _ in range(800)]
    ids, bounds = own.encode(pa.array(texts))
    for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kept", [0, 3, 40, 1 << 19])
def test_encoder_keeps_stretches(kept, monkeypatch):
    """Stretches that an earlier block had are not encoded again, as far as they are kept; ids are the same."""
    own = packing.Encoder(packing.default_tokenizer(), kept=kept)
    blocks = [["the cat, sat.\nOn it", "x" * 100 + " b"], [" ".join(f"w{i}q" for i in range(60))], ["the cat, sat.\nOn it", "b the"], ["b the cat,"]]
    asked = []
    whole = own._whole
    monkeypatch.setattr(own, "_whole", lambda texts: asked.extend(texts) or whole(texts))
    for block in blocks:
        asked.clear()
        ids, bounds = own.encode(pa.array(block))
        for text, a, b in zip(block, bounds[:-1], bounds[1:], strict=True):
            assert ids[a:b].tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(own.words) <= kept and "x" * 100 not in own.words.to_pylist()
    if kept > 100:
        assert not any(asked)


# 4. Quality classifier.


def test_quality_brute(spark):
    """Columns, ratios and scores against plain versions."""
    import pyarrow.parquet as pq

    texts = ["The cat SAT, the cat sat 12 34 34!", "", "a  b\nc", "x"]
    _, data, offsets = next(iter(text_buffers(pa.array(texts))))
    found = quality_classifier.features(data, offsets)

    def shape(word):
        return re.sub(r"(.)\1+", r"\1", re.sub(r"[0-9]", "0", re.sub(r"[A-Z]", "A", re.sub(r"[a-z\u0080-\U0010ffff]", "a", word))))

    for text, own in zip(texts, found, strict=True):
        words = WORD.findall(text.lower())
        shapes = ["again" if i and words[i] == words[i - 1] else shape(w) for i, w in enumerate(WORD.findall(text))]
        grams = {("w", w) for w in words} | {(n, *shapes[i : i + n]) for n in (1, 2, 3) for i in range(len(shapes) - n + 1)}
        assert len(own) == len(grams)
    rows, labels = [c for c in found if len(c)] * 2, np.array([1.0, 0.0, 1.0, 0.0, 0.0, 1.0])
    got = quality_classifier.ratios(rows, labels, 1 << quality_classifier.BITS)
    counts = [Counter(c for r, y in zip(rows, labels, strict=True) if y == v for c in r.tolist()) for v in (1, 0)]
    n = [sum(c.values()) + 1.0 * (1 << quality_classifier.BITS) for c in counts]
    for column in rows[0].tolist()[:20]:
        assert got[column] == pytest.approx(np.log((counts[0][column] + 1) / n[0]) - np.log((counts[1][column] + 1) / n[1]))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = quality_classifier.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scored = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, model).collect()}
    for d in pq.read_table(f"{SF}/documents.parquet").to_pylist():
        _, data, offsets = next(iter(text_buffers(pa.array([d["text"] or ""]))))
        own = quality_classifier.features(data, offsets)[0].tolist()
        margin = sum(float(model.weight[c]) for c in own) / max(sum(float(model.square[c]) for c in own), 1e-12) ** 0.5 + model.bias
        assert scored[d["doc_id"]] == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.offset))), abs=1e-4)


def test_quality_held_out(spark):
    import pyarrow.parquet as pq

    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    got = {r["doc_id"]: r for r in queries()["op4_quality_classifier"](spark, SF).collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i in held)
    assert np.mean([got[i]["predicted"] == labels[i] for i in held]) > 0.85


def test_dual_descent():
    """The fitted weights' primal objective is that of the dual, up to a small gap."""
    draw = np.random.default_rng(5)
    rows = [np.unique(draw.integers(0, 30, 6)) for _ in range(80)]
    signs = np.array([1.0 if 3 in r or 7 in r else -1.0 for r in rows])
    values = [np.ones(len(r)) / np.sqrt(len(r)) for r in rows]
    w, b = quality_classifier.dual_descent(rows, values, signs, 30, epochs=400)

    def objective(w, b):
        return 0.5 * (w @ w + b * b) + sum(max(0, 1 - s * (w[r] @ v + b)) for r, v, s in zip(rows, values, signs, strict=True))

    best = objective(w, b)
    for _ in range(200):
        assert objective(w + draw.normal(0, 0.05, 30), b + draw.normal(0, 0.05)) >= best - 1e-3


def test_quality_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, None), (7, 1, 0), (9, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    for rows in (labels, labels.limit(0)):
        model = quality_classifier.train(awkward, rows)
        got = quality_classifier.score(awkward, model).collect()
        assert len(got) == 12 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert quality_classifier.score(nothing, model).count() == 0


# 5. Neighbours.


def brute_nearest(rows, asks, k):
    fine = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and None not in v]
    fine = [(i, v) for i, v in fine if len(v) and np.isfinite(v).all() and np.linalg.norm(v) > 0]
    out = {}
    for q, x in fine:
        if asks(q):
            near = sorted({(-round(float(x @ v / (np.linalg.norm(x) * np.linalg.norm(v))), 9), i) for i, v in fine if i != q})
            out[q] = near[:k]
    return out


def test_neighbours_recall(spark):
    draw = np.random.default_rng(9)
    centres = draw.standard_normal((12, 16))
    vectors = [(i, (centres[i % 12] + 0.6 * draw.standard_normal(16)).tolist()) for i in range(1500)]
    vectors += [(2000 + i, vectors[3][1]) for i in range(400)]  # one vector, very often
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute_nearest(vectors, lambda q: q % 50 == 0, 5)
    assert got.keys() == want.keys()
    hit = sum(len({i for _, i, _ in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hit >= 0.9 * 5 * len(want)
    for own in got.values():
        assert [r for r, _, _ in sorted(own)] == list(range(1, 6))
        assert [(-round(s, 9), i) for _, i, s in sorted(own)] == sorted((-round(s, 9), i) for _, i, s in own)


def test_neighbours_awkward(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (51, [1.0, 1.0]), (52, None), (53, [0.0, 0.0]), (54, [float("nan"), 1.0]), (55, [None, 1.0]), (56, []), (100, [2.0, 2.0]), (51, [1.0, 1.0]), (None, [1.0, 2.0]), (57, [1.0, float("inf")])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["vec_id"]))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in brute_nearest(rows, lambda q: q % 50 == 0, 5).items()}
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert neighbours.nearest(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("noise", [1e-5, 0.001, 0.01])
def test_neighbours_near_copies(spark, noise):
    """Groups larger than the beam, of vectors that differ by less than a byte's step."""
    draw = np.random.default_rng(4)
    base = draw.standard_normal((2, 64))
    vectors = [(i, (base[i % 2] + noise * draw.standard_normal(64)).tolist()) for i in range(800)]
    vectors += [(1000 + i, draw.standard_normal(64).tolist()) for i in range(400)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 25 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    x = np.array([v for _, v in vectors])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([i for i, _ in vectors])
    hit = 0
    asked = [i for i in range(0, 800, 25)]
    for q in asked:
        far = ((x - x[q]) ** 2).sum(axis=1)  # of unit vectors: the order of cosines, without their cancellation
        far[q] = np.inf
        hit += len(got[q] & set(ids[np.argsort(far)[:5]].tolist()))
    assert hit >= 0.98 * 5 * len(asked)


def test_neighbours_scaled_copies(spark):
    """Scaled copies tie, and the smaller ids win, however many there are."""
    draw = np.random.default_rng(6)
    base = draw.standard_normal(16)
    order = draw.permutation(400).tolist()
    vectors = [(i, (base * (1.0 + 0.37 * order[i])).tolist()) for i in range(400)]
    vectors += [(1000 + i, draw.standard_normal(16).tolist()) for i in range(100)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id").isin(3, 200, 399)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == {3: [0, 1, 2, 4, 5], 200: [0, 1, 2, 3, 4], 399: [0, 1, 2, 3, 4]}


def test_neighbours_cells(spark, monkeypatch):
    """A cell holds several blocks where its codes take little room, so fewer codes travel, and a round finds the same."""
    draw = np.random.default_rng(8)
    codes = neighbours._code(draw.standard_normal((5000, 8)))
    points = spark.createDataFrame([(i, c.tobytes()) for i, c in enumerate(codes)], "node long, code binary").repartition(4)
    pivots = [neighbours._unit(codes[:16])]
    found = {}
    for width in (neighbours.CELL, 1):
        monkeypatch.setattr(neighbours, "CELL", width)
        laid = neighbours.materialize(neighbours._laid_out(points, pivots, 1), "cells")
        cells = laid.select("node", "cell", "code")
        graph = neighbours.materialize(neighbours._merge(laid.select("node", "near", "sims", F.lit(False).alias("old")), 4), "graph")
        sent = neighbours._around(graph).join(cells.select(F.col("node").alias("centre"), "cell"), "centre").select("cell", "member").distinct().count()
        after = {r["node"]: r["sims"] for r in neighbours._round(graph, cells, 4).collect()}
        found[width] = cells.select("cell").distinct().count(), sent, np.array([after[i] for i in range(5000)])
    (few, little, wide), (many, much, narrow) = found.values()
    assert (few, many) == (1, 4) and little <= 5000 <= much
    assert np.allclose(wide, narrow, atol=1e-5)


# 6. Near-duplicates.


def shingle_set(text, k):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent):
    sets = [(i, shingle_set(t, k)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (len(x), find(i)) for i, x in sets}


def copies(draw, n_families, size, words):
    out = []
    for _ in range(n_families):
        base = [f"w{draw.integers(0, 400)}" for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(int(draw.integers(0, 7))):
                own[int(draw.integers(0, words))] = f"x{draw.integers(0, 9999)}"
            out.append(" ".join(own))
    return out


def test_near_duplicates(spark, monkeypatch):
    draw = np.random.default_rng(4)
    texts = copies(draw, 12, 9, 60) + copies(draw, 1, 80, 90) + ["the very same text of a copy"] * 30 + [f"single {i} " * 6 for i in range(60)]
    order = draw.permutation(len(texts))
    rows = [(int(i) * 3, texts[int(p)]) for i, p in enumerate(order)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 3, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()} == want
    # The same with nodes and families so small that they are split into levels and blocks.
    monkeypatch.setattr(near_dedup, "NODE", 10)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "LEAF", 4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()} == want


def test_near_duplicates_repeated_ids(spark):
    """All texts of an id count: 1 and 2 meet in text a, 1 and 3 in text b."""
    a, b, z = (" ".join(f"{x}{i}" for i in range(60)) for x in "abz")
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, z), (4, ""), (5, z), (6, ""), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"] > 0, r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(1, True, 1, True)] * 2 + [(2, True, 1, False), (3, True, 1, False)] + [(4, False, 4, True)] * 2 + [(4, True, 4, True), (5, True, 4, False), (6, False, 6, True)]
    # Many texts of one id, linked by it alone.
    rows = [(7, f"{i} " + " ".join(f"{i}x{j}" for j in range(30))) for i in range(40)] + [(9, rows[0][1]), (8, "39 " + " ".join(f"39x{j}" for j in range(30)))]
    got = {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(7, 7), (9, 9), (8, 7)}


def test_near_duplicates_apart(spark, monkeypatch):
    """A family that its likeliest links leave in parts: members near the threshold, joined by a few of many pairs."""
    draw = np.random.default_rng(8)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(160):
        own = list(base)
        for at in draw.choice(100, int(draw.integers(2, 6)), replace=False).tolist():
            own[at] = f"x{i}-{at}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_components(rows, 3, 85) and 1 < len({c for _, c in got.values()}) < 160


def test_trees():
    """Pairs at the threshold meet as often as the recall target says, at any depth of branching."""
    draw = np.random.default_rng(6)
    assert near_dedup.tree_count(0.85, 0.9999) <= near_dedup.tree_count(0.8, 0.9999) <= near_dedup.POSITIONS
    positions = near_dedup.roots(near_dedup.tree_count(0.8, 0.9))
    assert len(set(positions)) == len(positions)

    def meets(alike, path, level):
        return not level or any(meets(alike, int(draw.integers(1 << 62)), level - 1) for p in near_dedup.chosen(path, 0.8, near_dedup.POSITIONS) if alike[p])

    met = 0
    for _ in range(400):
        alike = draw.random(near_dedup.POSITIONS) < 0.8
        met += any(alike[p] and meets(alike, int(draw.integers(1 << 62)), 6) for p in positions)
    assert met >= 0.87 * 400


def test_words_do_not_collide():
    """Words built so that polynomials of their bytes agree (Thue-Morse) have hashes of their own."""
    signs = "01"
    for _ in range(9):
        signs += "".join("10"[int(x)] for x in signs)
    pair = signs.translate({48: "a", 49: "b"}), signs.translate({48: "b", 49: "a"})
    assert len(pair[0]) == 1024
    for _, data, offsets in text_buffers(pa.array(list(pair))):
        hashes, _ = words_of(data, offsets, LOWER)
        assert hashes[0] != hashes[1]


def test_near_duplicates_awkward(awkward, nothing):
    got = near_dedup.near_duplicates(awkward).collect()
    assert len(got) == 12
    want = brute_components([(r["doc_id"], r["text"]) for r in awkward.collect()], 3, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_components(spark, monkeypatch):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (10, 11), (12, 11), (13, 12), (20, 20), (9, 1)]
    draw = np.random.default_rng(1)
    many = [(int(x), int(y)) for x, y in draw.integers(100, 160, (50, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    want, least = {}, {}
    for x, y in links + many:
        if x != y:
            for v in (x, y):
                least.setdefault(v, {v})
            one = least[x] | least[y]
            for v in one:
                least[v] = one
    want = {v: min(group) for v, group in least.items()}
    for together in (1 << 20, 12, 0):
        monkeypatch.setattr(near_dedup, "TOGETHER", together)
        got = near_dedup.components(spark.createDataFrame(links + many, "a long, b long")).collect()
        assert {r["id"]: r["root"] for r in got} == want and len(got) == len(want)
        assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 7. Main text.

PAGE = (
    '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>'
    '<div id="cookie-notice">We use cookies on all of these pages.</div><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>'
    "<article><h1>A  title &amp;\n more</h1><p>First <b>para</b>graph&nbsp;here.<p>Second one.<ul><li>item</ul><!-- no --><form><label>Name</label></form>"
    '<div class="comments"><p>A comment that is long enough to look like the text of an article, with many words.</p></div></article>'
    "<aside>Related things</aside><footer>&copy; all of us</footer></body></html>"
)


def test_main_text():
    assert html_text.main_text(PAGE) == "A title & more\n\nFirst paragraph here.\n\nSecond one.\n\nitem"
    plain = "<body><div><a href=x>Home</a></div><div>" + "Many words of plain text in a page. " * 8 + "</div><div>" + "More words of it, and no article. " * 8 + "</div></body>"
    assert html_text.main_text(plain).count("\n\n") == 1 and "Home" not in html_text.main_text(plain)
    for odd in (None, "", "   ", "<", "<p", "<!--", "<script>", "</div></div>", "<a href='", "&#x41;&bogus;" * 3):
        assert isinstance(html_text.main_text(odd), str)


def test_tree_learns_its_table():
    rows, labels = html_text._labelled()
    assert len(rows) > 100 and [html_text.tree().predict(x) for x in rows] == labels.tolist()


def test_html_pages(spark):
    """The test pages mark their article, so its blocks are the main text."""
    import html

    import pyarrow.parquet as pq

    pages = {p["page_id"]: p["html"] for p in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    for r in queries()["op7_html_text"](spark, SF).collect():
        article = re.search("<article>(.*)</article>", pages[r["page_id"]], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])
    odd = spark.createDataFrame([(1, None, None, "t"), (1, None, None, "t"), (None, "u", "", "t")], "page_id long, url string, html string, text string")
    assert [r["text"] for r in html_text.extract(odd).collect()] == ["", "", ""]
    assert html_text.extract(odd.limit(0)).count() == 0


def test_html_odd_markup():
    """Markup that must not lose text: letters that grow in lower case, elements that never end, names of layout."""
    text = "This is a paragraph of plain text that is long enough to count as the main text of the page."
    more = "And this is the other one, which is just as long and says as little as the first of the two."
    both = text + "\n\n" + more
    assert html_text.main_text("<p>" + "\u0130" * 12 + f"</p><article><script>x</script><p>{text}</p><style>y</STYLE ><p>{more}</p></article>") == both
    for tag in ("object", "select", "video", "svg", "noscript", "iframe", "canvas"):
        assert html_text.main_text(f"<article><p>{text}</p><{tag}><p>{more}</p></article>") == both, tag
        assert html_text.main_text(f"<article><p>{text}</p><{tag}><b>hidden</b><{tag}>h</{tag}></{tag}><p>{more}</p></article>") == both, tag
    assert html_text.main_text(f"<article><p>{text}</p><script>var x = '<p>'; <p>{more}</p></article>") == text
    assert "x + 1" in html_text.main_text(f"<article><p>{text} <math><mi>x</mi> + 1</math></p></article>")
    for name in ("layout with-sidebar", "no-comments", "has-header", "widget-area", "sidebar"):
        assert html_text.main_text(f"<div class='{name}'><article><p>{text}</p><p>{more}</p></article></div>") == both, name
    for name in ("comments", "related", "ad"):
        assert html_text.main_text(f"<article><p>{text}</p></article><div class='{name}'><article><p>{more}</p></article></div>") == text, name
    assert html_text.main_text(f"<form><main><p>{text}</p><p>{more}</p></main></form>") == both


# 8. WARC.


def test_warc(spark):
    rows = [(1, "http://a/", "<p>x"), (2, "http://b/", "<p>x"), (3, None, None), (4, "http://c/\r\nd", ""), (5, "http://é/", "é" * 70000), (9, "z", "<p>x"), (9, "z", "<p>x"), (None, "n", "<p>x")]
    pages = spark.createDataFrame([(*r, "digest") for r in rows], "page_id long, url string, html string, digest string")
    path = f"{warc.scratch(spark, 'test')}"
    index = warc.write(warc.plan_records(pages), path)
    got = warc.read(index).collect()
    assert len(got) == len(rows)
    for r in got:
        want = [(h or "").encode() for i, u, h in rows if i == r["page_id"]][0]
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(want).digest()).decode() and r["payload_bytes"] == len(want)
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == want
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in got} == {
        (1, "revisit", 9), (2, "revisit", 9), (9, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (None, "response", None),
    }
    some = warc.read(index.where("page_id = 5")).collect()
    assert [r["page_id"] for r in some] == [5]
    none = warc.write(warc.plan_records(pages.limit(0)), f"{path}-none")
    assert warc.read(none).count() == 0


def test_warc_ranges():
    assert [(a, b, len(m)) for a, b, m in warc._ranges([(0, 10), (10, 5), (100_000, 7), (9 << 20, 1)])] == [(0, 15, 2), (100_000, 100_007, 1), (9 << 20, (9 << 20) + 1, 1)]
    with pytest.raises(ValueError):
        warc.parse(b"HTTP/1.1 200\r\n\r\n")


# 9. Sentence pieces.


def test_best_path():
    """The path's score is the best of all segmentations, found without the automaton."""
    p = sentencepieces.load(sentencepieces.default_model())
    scores = {piece: s for piece, (_, _, s) in zip(p.automaton.keys(), p.automaton.values(), strict=True)}

    def best(text):
        out = [0.0]
        for end in range(1, len(text) + 1):
            out.append(max([out[end - 1] + p.lost, *(out[s] + scores[text[s:end]] for s in range(end) if text[s:end] in scores)]))
        return out[-1]

    for text in ["▁the", "▁hello▁world", "▁unbelievably", "▁▁▁a", "▁日本語x", "▁naïve\ncafé"]:
        ids, own, at = p.path(text), 0.0, 0
        for i in ids:
            if i not in p.bytes_of:
                own += scores[p.pieces[i]]
        lost = [c for c in text if c not in p.letters]
        own += p.lost * len(lost) if any(i in p.bytes_of for i in ids) else 0
        assert own == pytest.approx(best(text)) and at == 0


def test_sentencepiece_round_trip(spark, documents, awkward, nothing):
    rows = spark.createDataFrame([(d["doc_id"], d["text"]) for d in documents[:60]], "doc_id long, text string").unionByName(awkward.select("doc_id", "text"))
    coded = sentencepieces.encode(rows, with_ids=True)
    assert coded.where("NOT decoded").count() == 0
    want = Counter((r["doc_id"], r["text"] or "") for r in rows.collect())
    assert Counter((r["doc_id"], r["text"]) for r in sentencepieces.decode(coded).collect()) == want
    assert sentencepieces.encode(nothing).count() == 0
    p = sentencepieces.load(sentencepieces.default_model())
    for text in ["", " ", "a  b", " lead", "tail ", "x\n\ny", "▁", "a▁b", "\n"]:
        assert p.decode(p.whole(text)) == text
    ids, bounds = p.encode(pa.array(["a b\nc", "a  b", ""]))
    assert ids[bounds[0] : bounds[1]].tolist() == p.whole("a b\nc") and bounds[3] == bounds[2]


# 10. Quality rules.


def brute_rules(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, documents, awkward, nothing):
    texts = [d["text"] for d in documents] + [r["text"] for r in awkward.collect()] + ["a b c d e f g h " * 3, "x " * 9, "\n\na\na\n", "𝒳 𝒴 <>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.rules(df).select("doc_id", "rules.*").collect():
        want = brute_rules(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["base_failed"] and r["kept"])
    assert quality_rules.rules(awkward).count() == 12 and quality_rules.rules(nothing).count() == 0


def test_lines(spark):
    good = "This is a line of plain prose, with enough words to be kept by all rules here.\n"
    cases = {
        good * 1 + "and one more line of it that is plain as well, with words.": True,
        good + "Home | News | Sport | Shop | Help | More | About | Press | Jobs | Legal | Terms | Privacy | Contact | Login | Cart | Site |": False,
        good + "BUY!! NOW!! CHEAP!! BEST!! PRICE!! EVER!! GO!! TODAY!! ONLY!! HERE!! YES!! ALL!! NEW!! MODELS!! IN!! STOCK!! CALL!! US!!": False,
        good + "This work is licensed under a licence.": True,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: r["rules"] for r in quality_rules.rules(df).collect()}
    assert [got[i]["kept"] for i in range(len(cases))] == list(cases.values())
    assert got[3]["cleaned"] == good.rstrip("\n")
    fails = [
        "Home", "home | About us | CONTACT", "» Next · Previous «", "All rights reserved, 2020.", "© 2020 Someone", "Copyright 2020 by us", "We use cookies to make this better.",
        "The news of today continues on the next page and then it ends there...", "and so it went on…", "a b c d e f g h i j k l", "one two | three four |", "BUY THIS THING RIGHT NOW",
    ]
    fine = ["", "A heading", "At home, he said, there was nothing about it.", "- an item of a list", "Contact was lost.", "x | y is a pipe that a sentence may hold, once.", "One, two"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(fails + fine)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_failed_lines"] for r in quality_rules.rules(df).select("doc_id", "rules.n_failed_lines").collect()}
    assert [x for i, x in enumerate(fails + fine) if got[i]] == fails


def test_queries_cover_all_ten():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
