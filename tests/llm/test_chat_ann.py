"""Chat formatting round trips; nearest neighbours against exact search."""
import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evlens.llm import ann, chat

ODD = ["a\\", "### x", "\\### y </turn>", "", " </turn>\n", "##", "\n", "😀 \\\\###", "\\### Assistant: </turn> ok"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab:\\#\n</turn> é", max_size=12), st.text(alphabet="ab:\\#\n</turn> é", max_size=30)), max_size=5))
def test_template_round_trip(turns):
    whole = "".join(chat.format_turn(r, t)[0] for r, t in turns)
    assert chat.parse_turns(whole) == turns


def conversations(spark, seed=2):
    rng = random.Random(seed)
    rows = []
    for c in range(120):
        for t in range(rng.randint(1, 6)):
            rows.append((c if c != 5 else None, t if rng.random() < 0.95 else None,
                         rng.choice(["user", "assistant", "sy:s\ntem", None]), rng.choice(ODD + [None])))
    rows += [(500, 0, "user", "same"), (501, 0, "user", "same"), (501, 0, "user", "same"), (502, 0, "user", "x" * 100_000)]
    return rows, spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, depth string")


def in_order(rows):
    by = {}
    for c, t, r, x in sorted(rows, key=lambda v: (str(v[0]), -1 if v[1] is None else v[1], v[2] or "", v[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    return by


def test_read_back(spark):
    rows, table = conversations(spark)
    got = {r["conv_id"]: r for r in chat.read_back(*chat.build(table)).collect()}
    want = in_order(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["formatted_chars"] == sum(len(chat.format_turn(r, x)[0]) for r, x in turns)


def test_tree_is_emitted_once_depth_first_with_its_ancestors(spark):
    rows, table = conversations(spark, 3)
    nodes = sorted(chat.build(table)[0].collect(), key=lambda n: n["emit_start"])
    stream, at = "".join(n["formatted"] for n in nodes), 0
    turns, seen, open_ = in_order(rows), set(), []
    for n in nodes:
        assert n["emit_start"] == at
        at = n["emit_stop"]
        own = [chat.format_turn(r, x)[0] for r, x in turns[None if n["owner"] == (1 << 63) - 1 else n["owner"]]]
        before = "".join(own[:n["depth"]])
        assert "".join(stream[a["start"]:a["stop"]] for a in n["ancestors"]) == before
        assert n["position"] == len(before)
        path = tuple(own[:n["depth"] + 1])
        assert path not in seen
        seen.add(path)
        open_ = open_[:n["depth"]] + [path]
        assert n["depth"] == 0 or open_[n["depth"] - 1] == path[:-1]      # the parent is the last node of its depth
    assert seen == {tuple(chat.format_turn(r, x)[0] for r, x in t[:k + 1]) for t in turns.values() for k in range(len(t))}


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(*chat.build(empty)).collect() == []


def exact(rows, k):
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = np.round(u @ u[i], 12)
        others = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[ids[i]] = ids[others].tolist()
    return out


def run(spark, rows, **kw):
    table = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<float>, score double")
    got = {}
    for r in sorted(ann.nearest(table, lambda c: F.col(c) % 50 == 0, **kw).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    return got


def test_recall_with_deep_leaves(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_ROWS", 40)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    m = np.float32(centres[rng.integers(0, 12, 3000)] + 0.5 * rng.normal(size=(3000, 16)))
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    want, got = exact(rows, 5), run(spark, rows, sample=600)
    assert set(got) == set(want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


def test_recall_holds_where_the_least_number_of_leaves_is_a_small_share(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_ROWS", 4)
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(np.float32(rng.normal(size=(4000, 64))))]
    want, got = exact(rows, 5), run(spark, rows, sample=600)
    assert set(got) == set(want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


def test_recall_where_some_rows_have_near_neighbours_and_others_none(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_ROWS", 20)
    rng = np.random.default_rng(8)
    for tight, offset, alone in ((0.9, 0, False), (0.0, 5, False), (1.0, 0, True)):
        m = np.where((rng.random(4000) < tight)[:, None], 3 * rng.normal(size=64) + 0.02 * rng.normal(size=(4000, 64)),
                     offset * rng.normal(size=64) + rng.normal(size=(4000, 64)))
        if alone:        # every query is far from all other rows
            m[::50] = rng.normal(size=(80, 64))
        rows = [(i, v.tolist()) for i, v in enumerate(np.float32(m))]
        want, got = exact(rows, 5), run(spark, rows, sample=1000)
        assert set(got) == set(want)
        assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want), (tight, offset, alone)


def test_many_parallel_vectors_are_ranked_by_id(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), [float(2 ** n), float(2 ** (n + 1))]) for n, i in enumerate(rng.permutation(100))]
    assert run(spark, rows) == exact(rows, 5)


def test_equal_vectors_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 16)
    rows = [(i, [1.0, 2.0, 2.0]) for i in range(200)] + [(300 + i, [0.5 * i, 1.0, 0.0]) for i in range(20)]
    bad = [(1000, None), (1001, [0.0, 0.0, 0.0]), (1002, [None, 1.0, 1.0]), (1003, [float("nan"), 1.0, 1.0]),
           (1004, [float("inf"), 1.0, 1.0]), (1005, [1.0]), (1006, []), (None, [1.0, 1.0, 1.0])]
    assert run(spark, rows + rows[:3] + bad) == exact(rows, 5)


def test_fewer_candidates_than_asked(spark):
    assert run(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]) == {0: [2, 1]}
    assert run(spark, [(0, [1.0, 0.0])]) == {}
    assert run(spark, []) == {}


def test_very_large_and_small_vectors_and_ids(spark):
    top = (1 << 63) - 1
    rows = [(0, [1e200, 1e200]), (1, [1.0, 1.0]), (2, [1e200, 0.0]), (1 << 60, [-1e-320, 0.0]), (top, [3.0, 2.9]), (top, [0.0, 5e-324]),
            (50, [2.0, 2.0]), (50, [-1.0, -1.0]), (-(1 << 63), [-1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(table, lambda c: F.col(c) == 0).collect()}
    assert [got[0, k][0] for k in (1, 2, 3, 4, 5)] == [1, 50, top, 2, top]
    assert [round(got[0, k][1], 3) for k in (1, 2, 4, 5)] == [1.0, 1.0, 0.707, 0.707]


def test_share_read_falls_as_the_table_grows(spark):
    rng = np.random.default_rng(7)
    every = ann._unit(rng.normal(size=(20_000, 48)) + 2 * rng.normal(size=(40, 48))[rng.integers(0, 40, 20_000)])
    share = {}
    for n in (2_500, 20_000):
        unit = every[:n]
        forest = [ann.grow(unit, seed) for seed in range(ann.TREES)]
        near = ann.nearness(unit, forest, 5)
        where = [ann.leaves(tree, unit) for tree in forest]
        hits, share[n] = 0.0, 0.0
        for q in range(500, 520):
            seen = np.zeros(n, bool)
            for t, leaf in ann.search(forest, near, unit[q]):
                seen |= where[t] == leaf
            share[n] += seen.mean() / 20
            hits += seen[np.argsort(-(unit @ unit[q]))[1:6]].mean() / 20
        assert hits >= 0.9
    assert share[20_000] < 0.6 * share[2_500]
