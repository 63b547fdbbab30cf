"""Quality rules: base rules per text, then a calibrated n-gram classifier.

Features are hashed words and hashed character n-grams of the whole text, each family
as relative frequencies. A logistic regression is fitted on a bounded sample of labelled
rows (``SAMPLE`` per class, chosen by a hash of the id, so it does not depend on order or
partitioning); a fold of the sample that is not fitted gives a two-parameter probability
calibration. Every document is then scored in Arrow batches against a fixed threshold.

Results: one row per input row. Null and empty texts have no words and fail the base
rules. Labels that are null are ignored; of several labels of a document the lowest
counts. Without labels of both classes the classifier keeps everything. Repeated rows
give repeated results.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evlens.llm.common import SPACES, arrow_map, id_text, texts_of

BUCKETS = 1 << 16        # hashed features
CHAR_N = 4               # characters of a character n-gram
SAMPLE = 1000            # labelled rows of each class that are fitted and calibrated on
THRESHOLD = 0.5          # lowest calibrated probability of good quality that is kept
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
RIDGE = 1e-4
_SCALE = 8.0             # relative frequencies are small; this sets their weight against the ridge

_SPACE = np.zeros(33, bool)
_SPACE[[ord(c) for c in SPACES]] = True
_MUL = np.random.default_rng(17).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def base_facts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x and x.strip(SPACES)]
    grams = list(zip(words, words[1:], words[2:]))
    repeats = 0
    if len(set(grams)) < len(grams):
        seen: dict = {}
        for g in grams:
            seen[g] = seen.get(g, 0) + 1
        until = 0
        for i, g in enumerate(grams):
            if seen[g] > 1:
                repeats += i + 3 - max(i, until)
                until = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeats


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def hashed_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(char buckets, text of each, word buckets, text of each) over all texts at once."""
    code = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(t) for t in texts])
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    owner = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([start, [len(code)]])))
    h = np.zeros(max(len(code) - CHAR_N + 1, 0), np.uint64)
    for k in range(CHAR_N):
        h = (h + code[k:k + len(h)]) * _MUL[k]
    whole = np.arange(len(h)) + CHAR_N <= (start + size)[owner[:len(h)]]
    chars = ((h >> np.uint64(40)) % np.uint64(BUCKETS // 2)).astype(np.int64)[whole]
    gap = _SPACE[np.minimum(code, 32).astype(np.int64)]
    begins = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]])) if len(code) else np.zeros(0, np.int64)
    if len(begins):
        word = np.cumsum(np.bincount(begins, minlength=len(code))) - 1
        place = np.arange(len(code)) - begins[np.maximum(word, 0)]
        w = np.add.reduceat(np.where(gap, np.uint64(0), (code + np.uint64(7)) * _MUL[place % 64]), begins)
        words = ((w >> np.uint64(40)) % np.uint64(BUCKETS // 2)).astype(np.int64) + BUCKETS // 2
    else:
        words = np.zeros(0, np.int64)
    return chars, owner[:len(h)][whole], words, owner[begins]


@dataclass
class Classifier:
    """Weights by bucket, and the calibration of margins to probabilities."""
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, texts: list[str]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        chars, char_of, words, word_of = hashed_features(texts)
        for bucket, of in ((chars, char_of), (words, word_of)):
            n = np.maximum(np.bincount(of, minlength=len(texts)), 1)
            total += _SCALE * np.bincount(of, weights=self.weights[bucket], minlength=len(texts)) / n
        return total

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -30, 30)))


def _sparse(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of (bucket, value) with their ends."""
    index, value, ends = [], [], [0]
    for t in texts:
        chars, _, words, _ = hashed_features([t])
        for b in (chars, words):
            u, n = np.unique(b, return_counts=True)
            index.append(u)
            value.append((_SCALE * n / max(len(b), 1)).astype(np.float32))
        ends.append(ends[-1] + len(index[-1]) + len(index[-2]))
    return np.concatenate(index), np.concatenate(value), np.asarray(ends)


def fit_logistic(texts: list[str], good: np.ndarray, ridge: float = RIDGE, steps: int = 12, inner: int = 20):
    """Ridge logistic regression, balanced classes, by Newton steps with conjugate gradients."""
    index, value, ends = _sparse(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(ends))
    n = len(texts)
    share = np.where(good, 0.5 / max(good.sum(), 1), 0.5 / max((~good).sum(), 1))

    def forward(v):
        return np.bincount(row, weights=value * v[index], minlength=n) + v[-1]

    def back(u):
        g = np.bincount(index, weights=value * u[row], minlength=BUCKETS + 1)
        g[-1] = u.sum()
        return g

    w = np.zeros(BUCKETS + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -30, 30)))
        grad = back(share * (p - good)) + ridge * w
        curve = share * np.maximum(p * (1 - p), 1e-6)
        x, r = np.zeros_like(w), -grad
        d, rr = r.copy(), r @ r
        if rr < 1e-14:
            break
        stop = 1e-4 * rr
        for _ in range(inner):
            hd = back(curve * forward(d)) + ridge * d
            a = rr / (d @ hd)
            x += a * d
            r -= a * hd
            new = r @ r
            if new < stop:
                break
            d, rr = r + new / rr * d, new
        w += x
    return w[:-1], float(w[-1])


def calibrate(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through held-out margins.

    Targets are smoothed, and the curve is drawn towards slope 1 and shift 0 as by two
    further rows of the rarer class, so that a handful of rows cannot turn it round.
    """
    pos, neg = good.sum(), (~good).sum()
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(good, (pos + 1) / (pos + 2), 1 / (neg + 2))
    share = np.where(good, 0.5 / pos, 0.5 / neg)
    pull = 2.0 / (min(pos, neg) + 2)
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([(share * (p - target) * margins).sum() + pull * (a - 1), (share * (p - target)).sum() + pull * b])
        c = share * p * (1 - p)
        h = np.array([[(c * margins ** 2).sum() + pull, (c * margins).sum()], [(c * margins).sum(), c.sum() + pull]])
        da, db = np.clip(np.linalg.solve(h, g), -1, 1)      # short steps: a Newton step can overshoot
        a, b = max(a - da, 0.05), b - db
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
          label_id: str = "doc_id", label_col: str = "quality") -> Classifier | None:
    """Fit and calibrate on at most ``sample`` labelled rows of each class; None without both classes."""
    marks = (labels.select(F.col(f"`{label_id}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").alias("good"))
             .where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.min("good").alias("good")))
    order = F.xxhash64("doc_id")
    chosen = marks.where("good > 0").orderBy(order).limit(sample).union(
        marks.where("good <= 0").orderBy(order).limit(sample))
    # At most 2 * sample ids: a proven bound for the broadcast.
    texts = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    one = Window.partitionBy("doc_id").orderBy("text")
    rows = (texts.withColumn("k", F.row_number().over(one)).where("k = 1")
            .select("text", (F.col("good") > 0).alias("good"), (F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(4)) == 0).alias("held"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").toPandas())
    good, held = rows["good"].to_numpy(bool), rows["held"].to_numpy(bool)
    texts = [t or "" for t in rows["text"]]
    if not (good.any() and (~good).any()):
        return None
    if not (good[~held].any() and (~good[~held]).any()):
        held = np.zeros(len(good), bool)
    fitted = [t for t, h in zip(texts, held) if not h]
    model = Classifier(*fit_logistic(fitted, good[~held]))
    aside = [t for t, h in zip(texts, held) if h]
    if aside:
        model.slope, model.shift = calibrate(model.margins(aside), good[held])
    model.weights = model.weights.astype(np.float32)
    return model


def score(docs: DataFrame, model: Classifier | None, threshold: float = THRESHOLD,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base facts and verdict of every row."""

    def run(batches):
        for b in batches:
            texts = texts_of(b, "text")
            facts = [base_facts(t) for t in texts]
            failed = [base_failed(f[0], f[4]) for f in facts]
            p = model.probabilities(texts) if model else np.ones(len(texts))
            kept = [not f and bool(x >= threshold) for f, x in zip(failed, p)]
            cols = [pa.array(c, pa.int64()) for c in zip(*facts)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(failed), pa.array(p), pa.array(kept)],
                                             names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                    "n_repeat_words", "base_failed", "probability", "kept"])

    return arrow_map(id_text(docs, id_col, text_col), run,
                     "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                     "n_repeat_words long, base_failed boolean, probability double, kept boolean")


def keep(docs: DataFrame, model: Classifier | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that pass base rules and classifier."""

    def run(batches):
        for b in batches:
            texts = texts_of(b, text_col)
            facts = [base_facts(t) for t in texts]
            p = model.probabilities(texts) if model else np.ones(len(texts))
            yield b.filter(pa.array([not base_failed(f[0], f[4]) and bool(x >= threshold) for f, x in zip(facts, p)], pa.bool_()))

    return arrow_map(docs, run, docs.schema)
