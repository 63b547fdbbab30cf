"""Quality rules and language identification."""
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from evlens.llm import langid, quality

SF = "/root/testdata/sf0.01"


def brute_facts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often, cover = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            cover |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t\x0b\x1c #|é", max_size=60))
def test_base_facts(text):
    assert quality.base_facts(text) == brute_facts(text)


def test_hashed_features_do_not_depend_on_the_batch():
    texts = ["one two", "", "three  é four", "x"]
    together = quality.hashed_features(texts)
    for k, t in enumerate(texts):
        alone = quality.hashed_features([t])
        for i in (0, 2):
            assert together[i][together[i + 1] == k].tolist() == alone[i].tolist()


def test_calibration_follows_the_data():
    rng = np.random.default_rng(0)
    m = rng.normal(size=4000)
    good = rng.random(4000) < 1 / (1 + np.exp(-(2 * m - 1)))
    a, b = quality.calibrate(m, good)
    assert abs(a - 2) < 0.3
    few = quality.calibrate(np.array([4.0] * 15 + [4.4, -4.0]), np.array([True] * 15 + [False, False]))
    assert few[0] > 0 and few[0] * 4 + few[1] > 0 > few[0] * -4 + few[1]
    assert quality.calibrate(m, np.ones(4000, bool)) == (1.0, 0.0)


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fitted = labels.where("doc_id % 3 != 0")
    model = quality.train(docs, fitted)
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    rows = [(got[r["doc_id"]], r["quality"]) for r in labels.where("doc_id % 3 = 0").collect()]
    rows = [(g, q) for g, q in rows if not g["base_failed"]]
    assert len(rows) > 50 and sum(g["kept"] == bool(q) for g, q in rows) >= 0.97 * len(rows)


def test_odd_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (2, "", "a"), (None, "w " * 60_000, "a"),
                                  (3, " ".join(f"w{k}" for k in range(80)), "a")], "doc_id long, text string, kept string")
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(docs, empty) is None
    got = {(r["doc_id"], r["n_words"]): (r["base_failed"], r["kept"]) for r in quality.score(docs, None).collect()}
    assert got == {(1, 0): (True, False), (2, 0): (True, False), (None, 60_000): (True, False), (3, 80): (False, True)}
    assert quality.keep(docs, None).collect()[0].asDict() == {"doc_id": 3, "text": " ".join(f"w{k}" for k in range(80)), "kept": "a"}
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert quality.score(nothing, None).collect() == []


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.learn(docs)).collect()}
    rows = [(got[r["doc_id"]], r["lang"]) for r in docs.select("doc_id", "lang").collect()
            if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(g["lang_pred"] == lang for g, lang in rows) >= 0.97 * len(rows)
    assert all(0 <= g["score"] <= 1 for g, _ in rows)


def test_predictions_use_the_text_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    content = langid.learn(docs)
    blind = docs.selectExpr("-doc_id as doc_id", "text", "'xx' as lang", "'yy' as source")
    a = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, content).collect()}
    b = {-r["doc_id"]: r["lang_pred"] for r in langid.predict(blind, content).collect()}
    assert a == b


def test_languages_of_odd_rows(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices(["the", "and", "house", "of"] if k % 2 else ["der", "und", "haus", "von"], k=40)),
             "en" if k % 2 else "de") for k in range(40)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 !? 34", None), (103, "the house and the house", None), (103, "the house and the house", None)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.learn(docs)).collect()}
    assert [got[k]["lang_pred"] for k in (100, 101, 102, 103)] == ["und", "und", "und", "en"]
    assert got[102]["score"] == 0.0 and got[102]["rejected"]
    none = docs.where("false")
    assert langid.learn(none) == {} and langid.predict(none, {}).collect() == []
    assert {r["lang_pred"] for r in langid.predict(docs, {}).collect()} == {"und"}


def test_held_out_rule(spark):
    rows = spark.createDataFrame([(k,) for k in [*range(200), None]], "doc_id long").select("doc_id", langid.held_out().alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert pytest.approx(0.25, abs=0.1) == sum(r["h"] for r in rows) / len(rows)


def test_predictions_against_plain_compression(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(150).collect()]
    rows += [(900_001, "größe " * 20_000, "xx"), (900_002, "z", "yy"), (900_006, "z z", "yy"), (900_010, "zz", "yy"), (900_001, "größe " * 20_000, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = {}
    for doc, text, lang in set(rows):
        if lang is not None and text and zlib.crc32(str(doc).encode()) % 4 != 2:
            h = xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(struct.pack("<q", doc), 42))
            h -= (h >> 63) << 64
            at = h % (max(len(text) - langid.SLICE, 0) + 1)
            deal = texts.setdefault(lang, {})
            deal[h % langid.SAMPLE_DOCS] = min(deal.get(h % langid.SAMPLE_DOCS, (h, text[at:at + langid.SLICE])), (h, text[at:at + langid.SLICE]))
    plain = {}
    for lang, deal in texts.items():
        raw = b"\n".join(langid.letters_only(part).encode() for _, part in sorted(deal.values()))[:langid.DICTIONARY_BYTES]
        while len(raw) < 8:
            raw += raw
        plain[lang] = raw
    learned = langid.learn(docs)
    assert {k: v for k, v in learned.items() if k != "yy"} == {k: v for k, v in plain.items() if k != "yy"}
    assert set(learned) == set(plain) and {"xx", "yy"} <= set(learned)

    def size(lang, text):
        whole = langid.letters_only(text)
        params = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, min_match=3, write_content_size=0, write_dict_id=0, write_checksum=0)
        words = zstandard.ZstdCompressionDict(learned[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return sum(len(zstandard.ZstdCompressor(dict_data=words, compression_params=params).compress(whole[i:i + langid.BLOCK].encode()))
                   for i in range(0, len(whole), langid.BLOCK))

    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(docs, learned).collect()}
    want = set()
    for doc, text, _ in rows[::5] + rows[-5:]:
        if text and any(c.isalpha() for c in text):
            sizes = sorted((size(lang, text), lang) for lang in learned)
            want.add((doc, sizes[0][1], 1 - sizes[0][0] / sizes[1][0]))
    assert len(want) > 20 and want <= got


def test_languages_of_long_texts_only_are_learned(spark):
    rows = [(k, "the house and the road " * (9000 if k % 2 else 2), "en" if k % 2 else "eng") for k in range(24)]
    rows += [(100 + k, "das haus und die strasse " * 9000, "de") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(langid.learn(docs)) == {"en", "eng", "de"}
