"""The pipeline against a brute-force version of each stage, and on awkward rows."""

import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from laminar.llm import packing

from .test_operators import awkward, brute_components, nothing, sound  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(draw, n, words):
    return " ".join(words[int(i)] for i in draw.integers(0, len(words), n)) + "."


def fixture():
    draw = np.random.default_rng(2)
    english = "the of and to in is that was for it with as his on be at by had not are but from or have an they which one you were".split()
    french = "le la les des et du une que est dans pour qui sur pas plus avec son ses au par mais nous vous elle sont été cette".split()
    texts = [(prose(draw, 60, english), "en") for _ in range(40)] + [(prose(draw, 60, french), "fr") for _ in range(25)]
    base = prose(draw, 120, english).split()
    for k in range(6):
        own = list(base)
        own[10 * k] = "changed"
        texts.append((" ".join(own), "en"))
    texts += [texts[3], texts[3], (prose(draw, 8, english), "en"), ("| " * 30 + "menu", "en"), ("Word " * 80, "en"), ("###word " * 40, "en"), (None, None), ("", "en"), ("1 2 3 4 5 6 7 8 9 10 " * 3, None)]
    return [(i * 2, t, lang, None, None) for i, (t, lang) in enumerate(texts)]


def kept_by_rules(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    if len(words) < 20 or 100 * len(covered) > 30 * len(words):
        return False
    lost = 0
    for line in (text or "").split("\n"):
        w = WORD.findall(line)
        bars = sum(x == "|" for x in w)
        fails = w and (
            sum(c in "#*$%&|<>" for c in line) * 12 >= len(line) or sum(x.endswith("!!") for x in w) * 2 >= len(w) or (bars >= 2 and bars * 4 >= len(w))
            or (len(w) >= 5 and line.upper() == line and line.lower() != line) or (len(w) >= 10 and len(set(w)) * 3 <= len(w))
            or (len(w) >= 12 and not any(c in ".!?:;," for c in line))
        )
        lost += len(w) if fails else 0
    return 100 * lost <= 50 * len(words)


def test_pipeline(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    ruled = [r for r in rows if kept_by_rules(r[1])]
    spoken = [r for r in ruled if any(c.isalpha() for c in r[1])]
    found = brute_components([(r[0], r[1]) for r in spoken], 5, 80)
    want = {r[0]: r[1] for r in spoken if found[r[0]][1] == r[0]}
    assert len(rows) > len(ruled) > len(spoken) - 1 and len(spoken) > len(want)
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {r["doc_id"] for r in got} == want.keys()
    encoder = packing.encoder(packing.default_tokenizer())
    for r in got:
        if r["piece"] == 0 and r["length"] < 1024:
            ids = encoder.tokenizer.encode(want[r["doc_id"]], add_special_tokens=False).ids
            assert r["ids_crc32"] == zlib.crc32(np.array([*ids, 2], "<u4").tobytes())
    sound(got, 1024)


def test_stages_awkward(spark, awkward, nothing):  # noqa: F811
    for docs in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
        assert corpus_pipeline.packed(spark, docs, "").count() >= docs.count()
    kept = Counter(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, awkward, "").collect())
    assert kept[7] == 0 and kept[1] == 1 and kept[None] == 1  # 7 repeats the text of 1
