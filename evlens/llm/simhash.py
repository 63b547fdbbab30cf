"""SimHash near-duplicate detection with bit-sliced comparison.

Fingerprints: 64 bits over the hashes of word shingles. Two fingerprints within the
radius agree on one of four 16-bit blocks, and on one of four 12-bit parts of the other
48 bits, so every pair to be found meets in one of 16 key tables (28-bit keys). Only
distinct fingerprints are compared. A key with many fingerprints is dealt into chunks and
every pair of chunks is a cell of its own, so no task holds more than two chunks of a key.

Inside a partition the cells lie one after another as 64 vertical bit planes. For each
shift s, all pairs (p, p + s) of a cell are compared at once: the difference bits of one
plane after another go into carry-save counters, 64 pairs to a machine word, and words
whose pairs all exceed the radius are abandoned. A cell gives only the edges that connect
it, never its pairs; cells that have become one component stop early.

Results: one row per input row. Null and empty texts have fingerprint zero and link like
any other. Rows with a null ``doc_id`` take part in links; ``component_id`` is the smallest
non-null id reachable (null if there is none). Repeated rows give repeated results.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlens.llm.common import arrow_map, id_text, stored, texts_of
from evlens.llm.components import components

SHINGLE_WORDS, RADIUS, SEED = 3, 3, 42
CHUNK = 1024             # distinct fingerprints of one key that are held together
BLOCK_ROWS = 65_536      # rows compared as one set of bit planes

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_COLUMN = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: str, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of one text; 0 if it has no word."""
    words = text.encode().lower().split()       # bytes.lower() changes A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        grams = [joined]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        grams = [joined[a:b - 1] for a, b in zip([0, *ends], ends[shingle - 1:])]
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams, repeat(seed))), np.uint8).reshape(-1, 8)
    set_bits = np.bincount((hashes + _COLUMN).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * set_bits.ravel() > len(grams)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS, seed: int = SEED,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, fp)``: the fingerprint of every row as a signed long, and a hash of its whole text."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in texts_of(b, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    rows = id_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return arrow_map(rows, run, "doc_id long, text_hash long, fp long")


def _keys(fp: str) -> str:
    """SQL array of the 16 table keys of a fingerprint."""
    out = []
    for i in range(4):
        block = f"(shiftrightunsigned({fp}, {16 * i}) & 65535L)"
        low = f"({fp} & {(1 << 16 * i) - 1}L)" if i else "0L"
        high = f"shiftleft(shiftrightunsigned({fp}, {16 * i + 16}), {16 * i})" if i < 3 else "0L"
        rest = f"({low} | {high})"
        for j in range(4):
            part = f"(shiftrightunsigned({rest}, {12 * j}) & 4095L)"
            out.append(f"({(4 * i + j) << 28}L | shiftleft({block}, 12) | {part})")
    return f"array({', '.join(out)})"


def cells(fps: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Distinct fingerprints dealt to comparison cells ``(key, a, b)``; keys of one fingerprint drop out."""
    rows = fps.select("fp", F.explode(F.expr(_keys("fp"))).alias("key"))
    sizes = (rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
             .select("key", F.ceil(F.col("n") / chunk).cast("int").alias("c")))
    dealt = rows.join(sizes, "key").withColumn("x", F.expr("cast(pmod(xxhash64(fp, key), c) as int)"))
    return (dealt.select("fp", "key", "x", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("y"))
            .select("key", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "fp"))


def _roots(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if (up == label).all():
            return label
        label = up


def linked_in_cells(fp: np.ndarray, cell: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, root row) that connect fingerprints within ``radius`` in the same cell.

    ``cell`` is sorted. At most one edge per row.
    """
    n = len(fp)
    words = -(-n // 64)
    bits = np.unpackbits(fp.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)
    vertical = np.zeros((64, (words + 2) * 64), np.uint8)
    vertical[:, :n] = bits.T
    planes = np.packbits(vertical, axis=1, bitorder="little").view(np.uint64)
    begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.concatenate([begin, [n]]))
    after = np.repeat(begin + size, size) - np.arange(n) - 1       # rows of the cell that follow
    reach = np.zeros(words * 64, np.int64)
    reach[:n] = after
    label = np.arange(n)
    shift = 1
    while True:
        at = np.flatnonzero(reach.reshape(words, 64).max(axis=1) >= shift)
        if not len(at):
            break
        alive = np.packbits(reach.reshape(words, 64)[at] >= shift, axis=1, bitorder="little").view(np.uint64).ravel()
        q, r = divmod(shift, 64)
        count = [np.zeros_like(alive) for _ in range(radius.bit_length())]
        over = np.zeros_like(alive)
        for p in range(64):
            far = planes[p, at + q]
            if r:
                far = (far >> np.uint64(r)) | (planes[p, at + q + 1] << np.uint64(64 - r))
            carry = planes[p, at] ^ far
            for c in count:                     # carry-save: add one bit to 64 counters
                out = c & carry
                c ^= carry
                carry = out
            over |= carry
            if p % 8 == 7:
                alive &= ~(over | _exceeds(count, radius, over))
                keep = alive != 0
                if not keep.any():
                    at = at[:0]
                    break
                if 2 * keep.sum() < len(keep):
                    at, alive, over = at[keep], alive[keep], over[keep]
                    count = [c[keep] for c in count]
        if len(at):
            hit = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
            rows = (at[:, None] * 64 + np.arange(64))[hit]
            rows = rows[label[rows] != label[rows + shift]]
            if len(rows):
                for x, y in zip(rows.tolist(), (rows + shift).tolist()):
                    while label[x] != x:
                        x = label[x]
                    while label[y] != y:
                        y = label[y]
                    if x != y:
                        label[max(x, y)] = min(x, y)
                label = _roots(label)
                whole = np.minimum.reduceat(label, begin) == np.maximum.reduceat(label, begin)
                reach[:n][np.repeat(whole, size)] = 0
        shift += 1
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _exceeds(count: list[np.ndarray], radius: int, like: np.ndarray) -> np.ndarray:
    """Bitwise ``counter > radius`` over vertical counters (lowest digit first)."""
    above, equal = np.zeros_like(like), ~np.zeros_like(like)
    for k in range(len(count) - 1, -1, -1):
        if radius >> k & 1:
            equal &= count[k]
        else:
            above |= equal & count[k]
            equal &= ~count[k]
    return above


def links(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Edges ``(u, v)`` whose components are those of all fingerprint pairs within ``radius`` (at most 3)."""
    if not 0 <= radius <= 3:
        raise ValueError("the key tables find every pair up to 3 differing bits")
    dealt = cells(fps, chunk).repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")

    def edges_of(fp, ids):
        i, j = linked_in_cells(fp.view(np.uint64), ids, radius)
        return pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]):
        held = []                       # rows of cells not yet compared; the last cell may go on in the next batch
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append([b.column(k).to_numpy(zero_copy_only=False) for k in range(4)])
            rows += b.num_rows
            if rows >= BLOCK_ROWS:
                key, a, c, fp = (np.concatenate(x) for x in zip(*held))
                ids = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (c[1:] != c[:-1])]))
                cut = int(np.searchsorted(ids, ids[-1]))
                if cut:
                    yield edges_of(fp[:cut], ids[:cut])
                held, rows = [[x[cut:] for x in (key, a, c, fp)]], len(fp) - cut
        if rows:
            key, a, c, fp = (np.concatenate(x) for x in zip(*held))
            ids = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (c[1:] != c[:-1])]))
            yield edges_of(fp, ids)

    return arrow_map(dealt, run, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, radius: int = RADIUS, chunk: int = CHUNK,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row."""
    return grouped(docs, shingle, radius, chunk, id_col, text_col).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def grouped(docs: DataFrame, shingle: int = SHINGLE_WORDS, radius: int = RADIUS, chunk: int = CHUNK,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, fp, root, component_id)``, one row per input row; ``root`` names components without an id too."""
    rows = stored(fingerprints(docs, shingle, SEED, id_col, text_col), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    stars = components(links(classes.select("fp"), radius, chunk))
    rooted = (classes.join(stars, classes["fp"] == stars["node"], "left")
              .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")
