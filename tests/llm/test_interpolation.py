"""Deleted interpolation against counts and expectation-maximisation in plain Python."""
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from evlens.llm import interpolation

SCHEMA = "doc_id long, text string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def grams(text, order):
    """(n-grams by order, contexts by order) for every token."""
    seq = ["<s>"] * (order - 1) + [("w", w) for w in words(text)] + ["</s>"]
    for i in range(order - 1, len(seq)):
        yield [tuple(seq[i - k + 1:i + 1]) for k in range(1, order + 1)], [tuple(seq[i - k + 1:i]) for k in range(1, order + 1)]


def counted(texts, order):
    gram, context = Counter(), Counter()
    for t in texts:
        for g, c in grams(t, order):
            gram.update(g)
            context.update(c)
    uni = {g: n for g, n in gram.items() if len(g) == 1}
    return gram, context, sum(uni.values()), len(uni)


def brute(docs, order):
    part = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10
    fit = [t for d, t in docs if part(d) > 1]
    held = [t for d, t in docs if part(d) == 1]

    def view(model, g, c):
        gram, context, n, v = model
        seen = [context[x] for x in c[1:]]
        return (tuple(math.frexp(x)[1] for x in seen),
                [1 / (v + 1), gram[g[0]] / max(n, 1), *(gram[x] / max(s, 1) for x, s in zip(g[1:], seen))])

    kept = counted(fit, order)
    events = [view(kept, g, c) for t in held for g, c in grams(t, order)] if kept[2] else []
    can = lambda b: [1, 1, *(int(x > 0) for x in b)]
    weight = {b: [x / sum(can(b)) for x in can(b)] for b, _ in events}
    for _ in range(interpolation.ROUNDS):
        share = defaultdict(lambda: [0.0] * (order + 1))
        for b, p in events:
            whole = sum(l * x for l, x in zip(weight[b], p))
            for k in range(order + 1):
                share[b][k] += weight[b][k] * p[k] / whole
        moved = 0.0
        for b, s in share.items():
            new = [x + c for x, c in zip(s, can(b))]
            new = [x / sum(new) for x in new]
            moved = max(moved, *(abs(x - y) for x, y in zip(new, weight[b])))
            weight[b] = new
        if moved <= interpolation.STILL:
            break

    def weights(b):
        if b in weight:
            return weight[b]
        code = lambda b: sum(x << 6 * k for k, x in enumerate(b))
        near = [(sum(abs(x - y) for x, y in zip(a, b)), code(a), a) for a in weight if can(a) == can(b)]
        return weight[min(near)[2]] if near else [x / sum(can(b)) for x in can(b)]

    model = counted([t for d, t in docs if part(d) > 0], order)
    gram, _, n, v = model
    out = []
    for d, t in docs:
        tokens, known, base, score = 0, 0, 0.0, 0.0
        for g, c in grams(t, order):
            b, p = view(model, g, c)
            tokens += 1
            known += gram[g[0]] > 0
            base += math.log10((gram[g[0]] + 0.1) / (n + 0.1 * (v + 1)))
            score += math.log10(sum(l * x for l, x in zip(weights(b), p)) if n else 1 / (v + 1))
        out.append((d, part(d) == 0, tokens, known, n, base, score))
    return out


def ordered(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


def same(spark, docs, order, **more):
    got = interpolation.score(spark.createDataFrame(docs, SCHEMA).repartition(3), order, **more)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got, want = ordered(tuple(r) for r in got.collect()), ordered(brute(docs, order))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], abs=1e-5)


def sample(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" if i % 7 else f"é{i}" for i in range(80)]
    follow = {w: rng.sample(vocabulary, 6) for w in vocabulary}
    out = []
    for i in range(n):
        w, seq = rng.choice(vocabulary), []
        for _ in range(rng.randint(0, 60)):
            seq.append(w)
            w = rng.choice(follow[w]) if rng.random() < 0.8 else rng.choice(vocabulary)
        out.append((i, " \t".join(seq)))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_whole_table(spark, order):
    docs = sample(160, order) + [(500, None), (501, ""), (None, "w1 w2"), (502, "unseen-anywhere"), (3, "w1 w2"), (3, "w1 w2"),
                                 (2**63 - 1, "W1\x0bw2\x1cx"), (503, "w1 w2 w3 " * 3000)]
    same(spark, docs, order)


def test_blocks_and_buckets_do_not_matter(spark, monkeypatch):
    docs = sample(120, 9) + [(900, "w1 w2 w5 w6 " * 300)]
    monkeypatch.setattr(interpolation, "POSITIONS", 97)
    monkeypatch.setattr(interpolation, "BUCKET_KEYS", 500)
    same(spark, docs, 3)
    same(spark, docs, 3, passes=1)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert interpolation.score(empty).collect() == []
    outside = [d for d in range(400) if zlib.crc32(str(d).encode()) % 10 == 0][:5]
    same(spark, [(d, "a b a") for d in outside], 2)              # nothing to learn from
    deleted = [d for d in range(400) if zlib.crc32(str(d).encode()) % 10 == 1][:5]
    same(spark, [(d, "a b a") for d in deleted + outside], 3)    # nothing to estimate from while learning
    clash = spark.createDataFrame([(1, "a b", 3, "x", 1.0)], "doc_id long, text string, part int, words string, score double")
    assert len(interpolation.score(clash).collect()) == 1


def test_mixture_sums_to_one():
    mixture = interpolation.Mixture({(3 << 6) + 5: [0.1, 0.2, 0.3, 0.4]}, 3)
    for bucket in [0, 5, 3 << 6, (3 << 6) + 5, (9 << 6) + 20]:
        w = mixture.of(bucket)
        assert abs(w.sum() - 1) < 1e-12 and not w[~interpolation.allowed(bucket, 3)].any()
    assert mixture.of((9 << 6) + 20).tolist() == [0.1, 0.2, 0.3, 0.4]
