"""Byte-level BPE against the tiktoken library, packing against its definition."""
import hashlib
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from evlens.llm import bpe, packing

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.worker_codec("ranks", RANKS, public_tokenizers.PATTERN)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab zé😀\n\t\r\x0b\x1c\x85  'sll1²½.,!漢́", max_size=40))
def test_ids_and_round_trip(text):
    enc, dec = bpe.worker_codec("ranks", RANKS, public_tokenizers.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(), special_tokens={})
    raw = enc.encode([text])[0]
    assert ids(raw) == ref.encode_ordinary(text)
    assert dec.bytes_of(raw) == text.encode()
    assert "".join(dec.pieces(ids(raw))) == text
    spans = dec.offsets(raw)
    assert all(0 <= s < e <= len(text) for s, e in spans)


_known = {}


def _ranks():
    if not _known:
        _known.update(bpe.read_ranks(RANKS))
    return _known


def assigned():
    """All code points with a meaning here, in texts between letters, digits and marks."""
    points = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    return [" ".join(f"a{c}'s 1{c}2 a {c}b{c}{c}. ?{c}" for c in points[i:i + 40]) for i in range(0, len(points), 40)]


def test_ids_of_all_assigned_characters(codec, reference):
    texts = assigned()
    assert [ids(r) for r in codec[0].encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_ids_of_all_assigned_characters_by_the_json_file():
    enc, _ = bpe.worker_codec("json", JSON, public_tokenizers.PATTERN)
    tok, texts = tokenizers.Tokenizer.from_file(JSON), assigned()
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    bad = [t for t, r, w in zip(texts, enc.encode(texts), want) if ids(r) != w]
    assert bad == []


@pytest.mark.parametrize("text", ["a\u0558's 1\u088f2", "a \u0c5cb \ua7ce", "\U00018d09 x\U00018d09", "\u0378", "a\U0003347fb"])
def test_ids_of_unassigned_characters(codec, reference, text):
    assert ids(codec[0].encode([text])[0]) == reference.encode_ordinary(text)
    enc, _ = bpe.worker_codec("json", JSON, public_tokenizers.PATTERN)
    assert ids(enc.encode([text])[0]) == tokenizers.Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y ", " <|endoftext", "a  <|endoftext|>  b\n"])
def test_added_tokens_are_matched_first(text):
    enc, _ = bpe.worker_codec("json", JSON, public_tokenizers.PATTERN)
    assert ids(enc.encode([text])[0]) == tokenizers.Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids


def test_added_tokens_are_text_for_the_rank_table(codec, reference):
    assert ids(codec[0].encode(["a <|endoftext|> b"])[0]) == reference.encode_ordinary("a <|endoftext|> b")


def test_memory_of_parts_is_bounded(codec):
    enc = bpe.PartEncoder(bpe.tokenizer_from_json(JSON), public_tokenizers.PATTERN, whole=None, parts=5, pieces=5)
    texts = [" ".join(random.Random(k).choices(["ab", "cd,", "x y", "zz\n", "q"], k=20)) for k in range(30)]
    assert enc.encode(texts) == codec[0].encode(texts)
    assert len(enc.parts) <= 5 and len(enc.pieces) <= 5


def test_a_word_is_remembered_once_whatever_mark_follows():
    tok = tokenizers.Tokenizer.from_file(JSON)
    enc = bpe.PartEncoder(tok, public_tokenizers.PATTERN, whole=None)
    text = "x alpha alpha, alpha. été été! été? Ǆa Ǆa; a\u0301b a\u0301b."
    assert ids(enc.encode([text])[0]) == tok.encode(text, add_special_tokens=False).ids
    assert [p for p in enc.pieces if p[1:].isalpha()] == [" a"]      # of the part that is not letters alone
    assert {"alpha", "été", "Ǆa"} <= set(enc.parts)


def test_encode_decode_frames(spark):
    rows = [(1, "né 😀 ok"), (2, None), (3, ""), (3, ""), (None, "x" * 50_000)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, ids string")
    enc = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, offsets=True)
    got = {(r["doc_id"], r["text"]) for r in bpe.decode(enc, RANKS, public_tokenizers.PATTERN).collect()}
    assert got == {(i, t or "") for i, t in rows}
    by = {r["doc_id"]: r for r in enc.collect()}
    assert [tuple(o) for o in by[1]["offsets"]][0][0] == 0 and by[2]["ids"] == []


def test_digests(spark, reference):
    rows = [(1, "a  b\n\n c"), (2, None)]
    got = {r["doc_id"]: r for r in bpe.digests(spark.createDataFrame(rows, "doc_id long, text string"), RANKS,
                                               public_tokenizers.PATTERN).collect()}
    for i, t in rows:
        want = np.asarray(reference.encode_ordinary(t or ""), "<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(want), hashlib.sha256(want.tobytes()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=200))
def test_plan_covers_the_histogram(lengths):
    hist = np.bincount(lengths, minlength=33) if lengths else np.zeros(33, np.int64)
    packed = packing.plan(hist, 32)
    back = np.zeros(33, np.int64)
    for lens, k in packed:
        assert sum(lens) <= 32 and k > 0
        for n in lens:
            back[n] += k
    assert (back == hist).all()


def test_plan_is_tight():
    rng = np.random.default_rng(3)
    hist = np.bincount(np.minimum(rng.geometric(0.004, 5000), 1024), minlength=1025)
    used = sum(k for _, k in packing.plan(hist))
    assert used <= 1.01 * (hist * np.arange(1025)).sum() / 1024 + 1


def test_pack(spark, reference):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices(["alpha", "b,", "été", "\n", "zz"], k=rng.choice([0, 3, 50, 400, 3000])))) for k in range(60)]
    rows += [(100, None), (100, None), (None, "one")]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, length int").repartition(5)
    got = packing.pack(docs, JSON, public_tokenizers.PATTERN).collect()
    whole = {}
    for i, t in rows:
        whole.setdefault(i, np.asarray(reference.encode_ordinary(t or "") + [2], "<u4"))
    for r in got:
        own = whole[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(own.tobytes()) == r["ids_crc32"]
        if len(whole[r["doc_id"]]) <= 1024:
            assert r["piece"] == 0 and r["length"] == len(whole[r["doc_id"]])
        elif r["piece"]:
            assert r["length"] == 1024
    assert sum(r["length"] for r in got) == sum(len(reference.encode_ordinary(t or "")) + 1 for _, t in rows)
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    assert len(seqs) <= sum(len(reference.encode_ordinary(t or "")) + 1 for _, t in rows) / 1024 + 2


def test_pack_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, JSON, public_tokenizers.PATTERN).collect() == []
