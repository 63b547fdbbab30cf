"""Best-fit packing of token pieces into fixed-length sequences by fitted length patterns.

1. Every document becomes token ids plus an end id, and is cut into pieces of at most
   ``size`` tokens (only longer documents are cut; the short piece comes first).
2. The histogram of piece lengths (at most ``size`` rows) goes to the driver, where
   patterns of up to three lengths that fill a sequence exactly get repeat counts by
   non-negative least squares. Counts are rounded down, and what is left of the
   histogram is packed best fit, longest first, on counts - never piece by piece.
3. Each piece has a rank among the pieces of its length (rank in its partition plus
   the partition's start). The plan maps (length, rank) to sequence and offset.

Null text is an empty text: one piece holding the end id. Repeated rows are packed as
often as they occur. An empty table gives an empty result.
"""
from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evlens.llm.bpe import worker_codec
from evlens.llm.common import arrow_map, id_text, stored, texts_of

SIZE, END_ID = 1024, 2
FIT_STEPS, FIT_ROUNDS = 250, 3
_PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, vocab_path: str, pattern: str, size: int = SIZE, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, with ``part`` and ``nth``: its rank among equal lengths of its input partition."""
    tail = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        enc, _ = worker_codec("json", vocab_path, pattern)
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            rows = []
            for doc, raw in zip(b.column(0).to_pylist(), enc.encode(texts_of(b, "text"))):
                raw += tail
                n = len(raw) // 4
                cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
                    rows.append((doc, k, i, j - i, zlib.crc32(raw[4 * i:4 * j]), part, seen[j - i]))
                    seen[j - i] += 1
            cols = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return arrow_map(id_text(docs, id_col, text_col), run, _PIECE + ", part int, nth long")


def enumerate_patterns(size: int, lengths: np.ndarray) -> np.ndarray:
    """All pairs and triples of the given lengths that sum to ``size``, one row each (0 pads a pair)."""
    present = np.zeros(size + 1, bool)
    present[lengths] = True
    rows = []
    for a in lengths[lengths <= size // 2]:
        if present[size - a]:
            rows.append(np.array([[a, size - a, 0]]))
        b = lengths[(lengths >= a) & (2 * lengths <= size - a)]
        c = size - a - b
        b, c = b[present[c]], c[present[c]]
        rows.append(np.stack([np.full_like(b, a), b, c], 1))
    return np.concatenate(rows).astype(np.int64) if rows else np.zeros((0, 3), np.int64)


def fit_counts(patterns: np.ndarray, hist: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Non-negative least squares: repeat counts whose lengths come closest to the histogram.

    Accelerated projected gradient; a pattern touches at most three lengths, so products
    with the pattern matrix are gathers and bin counts.
    """
    if not len(patterns):
        return np.zeros(0)
    used = patterns > 0
    flat = patterns.ravel()

    def lengths_of(x):
        got = np.bincount(flat, weights=np.repeat(x, 3), minlength=len(hist))
        got[0] = 0
        return got

    # Scaling by each length's share of patterns keeps the steps even over rare and common lengths.
    degree = np.maximum(lengths_of(np.ones(len(patterns))), 1)
    step = 1.0 / (3 * np.maximum.reduce(np.where(used, degree[patterns], 1), axis=1))
    x = np.min(np.where(used, (hist / degree)[patterns], np.inf), axis=1)
    y, t = x, 1.0
    for _ in range(steps):
        gap = lengths_of(y) - hist
        gap[0] = 0
        nxt = np.maximum(y - step * gap[patterns].sum(axis=1), 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = nxt + (t - 1) / t2 * (nxt - x), nxt, t2
    return x


def best_fit(hist: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) for a whole histogram, longest first into the fullest bin with room."""
    open_bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))   # room -> pattern -> bins
    for n in range(size, 0, -1):
        left = int(hist[n])
        # Rooms below n cannot take it; the smallest room that can comes first.
        for room in sorted(r for r in open_bins if r >= n and open_bins[r]):
            for pattern in list(open_bins[room]):
                if not left:
                    break
                have = open_bins[room][pattern]
                fit = room // n
                full = min(have, left // fit)
                for bins, k in ((full, fit), (1 if full < have and left - full * fit else 0, left - full * fit)):
                    if bins:
                        open_bins[room][pattern] -= bins
                        open_bins[room - k * n][pattern + (n,) * k] += bins
                        left -= bins * k
                if not open_bins[room][pattern]:
                    del open_bins[room][pattern]
        fit = size // n
        if left // fit:
            open_bins[size - fit * n][(n,) * fit] += left // fit
        if left % fit:
            open_bins[size - left % fit * n][(n,) * (left % fit)] += 1
    return [(p, k) for group in open_bins.values() for p, k in group.items() if k]


def plan(hist: np.ndarray, size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences) covering the histogram exactly."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    out = [((size,), int(left[size]))] if left[size] else []
    left[size] = 0
    for _ in range(FIT_ROUNDS):
        patterns = enumerate_patterns(size, np.flatnonzero(left))
        counts = np.floor(fit_counts(patterns, left.astype(float)) + 1e-9).astype(np.int64)
        taken = 0
        for i in np.argsort(-counts, kind="stable"):
            if counts[i] <= 0:
                break
            lens = tuple(int(v) for v in patterns[i] if v)
            k = min(int(counts[i]), *(int(left[v]) // lens.count(v) for v in lens))
            if k > 0:
                left[list(set(lens))] -= [k * lens.count(v) for v in set(lens)]
                out.append((lens, k))
                taken += k
        if not taken:
            break
    return out + best_fit(left, size)


def slots(packed: list[tuple[tuple[int, ...], int]], size: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank, first sequence, offset) of each run of ranks, sorted by rank."""
    ranks, runs, seq = defaultdict(int), defaultdict(list), 0
    for lens, k in packed:
        at = 0
        for n in lens:
            runs[n].append((ranks[n], seq, at))
            ranks[n] += k
            at += n
        seq += k
    return {n: tuple(np.asarray(c, np.int64) for c in zip(*r)) for n, r in runs.items()}


def pack(docs: DataFrame, vocab_path: str, pattern: str, size: int = SIZE, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; see the module text."""
    table = stored(pieces(docs, vocab_path, pattern, size, end_id, id_col, text_col), "pieces")
    counts = table.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    hist = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():     # at most ``size`` rows
        hist[r["length"]] = r["n"]
    where = slots(plan(hist, size), size)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                rows = length == n
                first, number, at = where[int(n)]
                run = np.searchsorted(first, rank[rows], "right") - 1
                seq[rows], off[rows] = number[run] + rank[rows] - first[run], at[run]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("piece"), b.column("start"), b.column("length").cast(pa.int64()),
                 b.column("ids_crc32"), pa.array(seq), pa.array(off)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = (table.join(starts, ["part", "length"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")))
    return arrow_map(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                    "sequence_id long, offset long")
