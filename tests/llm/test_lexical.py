"""Ranked search against a plain computation of every score."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from evlens.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    bags = [(d, Counter(brute_terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n, total = len(bags), sum(x[2] for x in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, bag, size in bags:
            m = 100 - 25 + 25 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m))
                    for t in brute_terms(text) if bag[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()], key=repr)


@pytest.mark.parametrize("text", [None, "", " - ", "A b", "don't-stop", "ÀÉ1a\x1cB_c\x7fd", "x y z", "é\x00é"])
def test_terms(text):
    assert lexical.terms(text) == brute_terms(text)


def sample(n, seed, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    weight = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(rng.choices(vocabulary, weight, k=rng.randint(0, 40)))) for i in range(n)]


@pytest.mark.parametrize("block", [2, 1000])
def test_whole_search(spark, block):
    docs = sample(900, 1) + [(900, None), (901, ""), (None, "w1 w2 w3"), (5, "w1 w50"), (5, "w1 w50"), (2**63 - 1, "w50 w9"), (-2**63 + 1, "w50 w9"), (7, "W1. w50, w1 " * 4000)]
    docs += [(2000 + i, "w3 w9 w11") for i in range(40)]          # ties beyond the last rank
    items = [(1, "w1 w2"), (2, "w50 w50 W3!"), (3, None), (4, "nothing"), (5, "w3 w9 w11"), (5, "w0")]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
                         spark.createDataFrame(items, "item_id long, text string"), block=block)
    assert rows(got) == brute(docs, items)


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 2, "x", 3.0)], "doc_id long, text string, score long, item string, n double")
    items = spark.createDataFrame([(9, "b", 1)], "item_id long, text string, rank int")
    assert rows(lexical.search(docs, items)) == brute([(1, "a b")], [(9, "b")])
    assert rows(lexical.search(docs.limit(0), items)) == []
    assert rows(lexical.search(docs, items.limit(0))) == []
    assert rows(lexical.search(docs.select("doc_id", "text").selectExpr("doc_id", "cast(null as string) text"), items)) == []


@pytest.mark.parametrize("seed", range(6))
def test_intervals_stop_early_and_stay_exact(seed):
    rng = np.random.default_rng(seed)
    n, k = 4000, 10
    lists, whole = [], np.zeros(n, np.int64)
    for j in range(4):
        doc = rng.permutation(n)[:rng.integers(50, n)]
        impact = np.sort((rng.pareto(1.2, len(doc)) * 50).astype(np.int64) + 1)[::-1]
        lists.append((doc, impact))
        whole[doc] += impact
    kept = [int(np.sort(whole)[-3])] if seed % 2 else []
    found, score, read = lexical.nra(lists, n, k, kept, first=16)
    assert (whole[found] == score).all()
    least = np.sort(np.concatenate([whole[whole > 0], kept]))[-k]
    assert set(np.flatnonzero(whole >= least)) <= set(found.tolist())
    assert read <= sum(len(d) for d, _ in lists)


def test_reads_less_than_everything():
    n = 20_000
    strong = (np.arange(n), np.concatenate([np.arange(1000, 900, -1), np.ones(n - 100)]).astype(np.int64))
    found, score, read = lexical.nra([strong], n, 20, [])
    assert sorted(score.tolist())[-20:] == list(range(981, 1001)) and read < n / 10
