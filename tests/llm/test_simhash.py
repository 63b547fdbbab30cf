"""SimHash against bit-by-bit brute force."""
import random
import re

import numpy as np
import pytest
import xxhash

from evlens.llm import simhash
from evlens.llm.components import components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(grams))


def brute_roots(fps, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", "one", "Two words", "ÀB aB a b c", "a\tb\x0bc\x1cd e", "x " * 500, "a b c a b c a b"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def clustered(n, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(12)]
    out = set()
    while len(out) < n:
        f = rng.choice(base)
        for _ in range(rng.randint(0, 5)):
            f ^= 1 << rng.randrange(64)
        out.add(f)
    return sorted(out)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_cells_connect_what_is_near(radius):
    fps = clustered(700, radius)
    moved, to = simhash.linked_in_cells(np.array(fps, np.uint64), np.zeros(len(fps), np.int64), radius)
    got = np.arange(len(fps))
    got[moved] = to
    assert got.tolist() == brute_roots(fps, radius)


def test_cells_do_not_mix():
    fps = np.array([5, 5, 5, 4, 4], np.uint64)
    moved, to = simhash.linked_in_cells(fps, np.array([0, 0, 1, 1, 2]), 3)
    assert list(zip(moved, to)) == [(1, 0), (3, 2)]


@pytest.mark.parametrize("chunk", [16, 1024])
def test_links_over_key_tables(spark, chunk):
    fps = clustered(600, 7)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    stars = {r["node"]: r["root"] for r in
             components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 3, chunk)).collect()}
    roots = brute_roots(fps, 3)
    pairs = {(stars.get(f, f), r) for f, r in zip(signed, roots)}
    assert len(pairs) == len(set(roots)) == len({a for a, _ in pairs})


def test_components_of_a_path(spark):
    rng = random.Random(1)
    nodes = list(range(100, 160))
    rng.shuffle(nodes)
    edges = list(zip(nodes, nodes[1:])) + [(1, 1), (3, 2)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {3: 2} | {n: 100 for n in range(101, 160)}


def test_near_duplicates(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choices(words, k=300) for _ in range(8)]
    rows = []
    for k in range(60):
        w = list(rng.choice(base))
        if rng.random() < 0.6:
            w[rng.randrange(300)] = "changed"
        rows.append((1000 - k, " ".join(w)))
    rows += [(7, None), (8, ""), (8, ""), (None, " \n"), (5, "w1 " * 20_000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_roots(fps, 3)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted((str(i), f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, roots))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == want


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
