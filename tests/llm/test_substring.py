"""Window removal against brute force."""
import hashlib
import random
import re

import pytest

from evlens.llm import substring


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, window):
    docs, first = [(d, words_of(t)) for d, t in sorted(rows, key=lambda r: r[0])], {}
    for d, w in docs:
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i:i + window]), (d, i))
    out = {}
    for d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] != (d, i):
                gone[i:i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    letters = ["a", "b", "c", "ab", "x", "yy", "z"]
    passages = [rng.choices(letters, k=rng.randint(15, 120)) for _ in range(10)]
    rows = []
    for d in range(120):
        w = []
        for _ in range(rng.randint(0, 4)):
            k = rng.random()
            if k < 0.4:
                p = rng.choice(passages)
                i = rng.randrange(len(p))
                w += p[i:i + rng.randint(1, 100)]
            elif k < 0.5:
                w += [rng.choice(letters)] * rng.randint(1, 70)
            elif k < 0.6:
                w += rng.choices(letters, k=3) * rng.randint(1, 30)
            else:
                w += [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(0, 60))]
        rows.append((d * 3, rng.choice([" ", "\n", " \t "]).join(w)))
    return rows + [(900 + i, rows[i * 7][1]) for i in range(12)] + [(990, None), (991, " \n ")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n_words string").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digests(docs).collect()}
    assert got == brute(rows, substring.WINDOW)


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in substring.digests(docs).collect())
    assert got == [("1", 0), ("1", 0), ("2", 30), ("None", 30)]


def test_texts_keep_their_spaces(spark):
    shared = " ".join(f"s{k}" for k in range(60))
    rows = [(1, f"head one\n{shared}\ntail"), (2, f"other  head\n{shared}\nother\ttail"), (3, "short text")]
    left = {r["doc_id"]: (r["n_removed"], r["text"]) for r in
            substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {2: (60, "other  head\nother\ttail")}


def test_empty_table(spark):
    assert substring.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_equal_windows_share_their_symbol():
    p = substring.Parsed([t or "" for _, t in corpus(3)])
    win, top, _, _ = p.recompress(None)
    text = [w for ws in p.words for w in ws]
    by = {}
    for i, s in zip(win.tolist(), top.tolist()):
        assert by.setdefault(tuple(text[i:i + substring.WINDOW]), s) == s
