"""Language-model scores by deleted interpolation.

The probability of a word after its context mixes maximum-likelihood estimates of orders
1 to K and the uniform distribution over the vocabulary and one unknown word. The mixture
weights depend on how often the contexts occur (powers of two, for each order) and are
learned by expectation-maximisation on deleted documents: a tenth of the corpus whose
counts are left out of the estimates while the weights are learned. Scores then use the
counts of all training documents.

How Spark does it:

1. Texts become blocks of positions where they are read: word numbers, and a 64-bit name
   for each distinct word of the block. Every text begins with a start mark and ends with
   an end, which is a token. Blocks are a stored table; long texts span several.
2. Every block names its n-grams and sends each distinct one once, with its count, to the
   bucket its name falls into. A frequent n-gram is therefore one entry per block, and
   buckets are even however skewed the words are; their number grows with the corpus. A
   bucket sums the counts and answers every block that asked, in the order it asked.
   Buckets are taken in ``PASSES`` jobs, so that less is shuffled at a time.
3. Blocks of deleted documents meet their answers. Their tokens' estimates, equal ones
   counted together, are a table, and each round of expectation-maximisation is one
   aggregate over it.
4. All blocks meet their answers, again in ``PASSES`` jobs; every document's logarithms
   are summed.

Every n-gram of every training document is counted. Names are 63 bits, derived from the
words, so two n-grams share one about once in 10^19 pairs.

Results: one row per input row, repeated rows too. Null and empty texts hold no word, only
the end. A null id counts as the empty id text (remainder 0: held out). With no training
document every probability is uniform over one word, so scores are 0. Other columns are
not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evlens.llm.common import SPACES, discard, sliced, stored, workers_find_package
from evlens.llm.wordlists import translated, words_of

ORDER = 3                     # longest n-grams
PASSES = 3                    # jobs that the n-gram names, and then the blocks, are dealt to
TEXT_BYTES = 1 << 20          # text read into blocks at a time
POSITIONS = 1 << 18           # most positions of a block
BUCKET_KEYS = 1 << 20         # entries of a bucket, about
ROUNDS, STILL = 40, 1e-3      # rounds of expectation-maximisation, fewer once no weight moves by more
HELD_OUT, FIT, DELETED = 0, 1, 2

_LOWER = bytes(0x20 if chr(b) in SPACES else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_START, _END = (xxhash.xxh3_64_intdigest(mark) for mark in (b" start", b" end"))    # no word holds a space
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BLOCK = ("block long, deleted boolean, skip int, positions long, words binary, tokens binary, rows array<long>, ids array<long>, "
          "parts array<int>, sizes array<int>")


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest needs; long lists travel as one value."""
    width = next(w for w in (1, 2, 4, 8) if int(numbers.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


def part_of(id_col: str = "doc_id") -> Column:
    """Held out, deleted or fit, by crc32 of the id as text modulo 10."""
    rest = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(10))
    return F.when(rest == 0, HELD_OUT).when(rest == 1, DELETED).otherwise(FIT).cast("int")


# Blocks

def blocks(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Positions of all texts. Token 0 is the start mark, 1 the end; ``words`` names them.

    The first ``skip`` positions only give context; ``sizes`` are the others of each document.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def cut(tokens, size, row, ids, part, deleted, names, number):
        upto = np.concatenate([[0], np.cumsum(size)])
        for a in range(0, len(tokens), POSITIONS):
            z = min(a + POSITIONS, len(tokens))
            skip = min(a, order - 1)
            first, last = np.searchsorted(upto, a, "right") - 1, np.searchsorted(upto, z, "left")
            used = np.zeros(len(names), bool)
            used[tokens[a - skip:z]] = used[:2] = True
            inside = np.minimum(upto[first + 1:last + 1], z) - np.maximum(upto[first:last], a)
            yield pa.RecordBatch.from_arrays([
                pa.array([number[0]]), pa.array([deleted]), pa.array([skip], pa.int32()), pa.array([z - a]),
                pa.array([packed(names[used])]), pa.array([packed((np.cumsum(used) - 1)[tokens[a - skip:z]])]), pa.array([row[first:last]]), pa.array([ids[first:last]], pa.list_(pa.int64())),
                pa.array([part[first:last]]), pa.array([inside.astype(np.int32)])],
                names=["block", "deleted", "skip", "positions", "words", "tokens", "rows", "ids", "parts", "sizes"])
            number[0] += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = [TaskContext.get().partitionId() << 32]
        seen = TaskContext.get().partitionId() << 32
        for b in sliced(batches, TEXT_BYTES):
            if not b.num_rows:
                continue
            flat, size = words_of(translated(b.column(1), _LOWER))
            coded = flat.dictionary_encode()
            names = np.array([_START, _END, *map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.large_binary()).to_pylist())], np.uint64)
            tokens = np.ones(len(flat) + 2 * b.num_rows, np.int32)
            start = np.concatenate([[0], np.cumsum(size + 2)[:-1]])
            mark = np.ones(len(tokens), bool)
            mark[start] = mark[start + size + 1] = False
            tokens[start] = 0
            tokens[mark] = coded.indices.to_numpy() + 2
            ids, part = b.column(0).to_pylist(), b.column(2).to_numpy(zero_copy_only=False).astype(np.int32)
            row = seen + np.arange(b.num_rows)
            seen += b.num_rows
            for deleted in (False, True):
                mine = (part == DELETED) == deleted
                if mine.any():
                    yield from cut(tokens[np.repeat(mine, size + 2)], (size + 2)[mine], row[mine],
                                   [d for d, m in zip(ids, mine) if m], part[mine], deleted, names, number)

    workers_find_package(docs.sparkSession)
    return rows.withColumn("part", part_of()).mapInArrow(run, _BLOCK)


class Block:
    """One block in a task: the key of every word, and of the n-gram of each longer order that ends at each position."""

    def __init__(self, row: dict, order: int):
        self.skip, self.deleted = row["skip"], row["deleted"]
        name, self.tokens = unpacked(row["words"]), unpacked(row["tokens"])
        self.pad = self.tokens == 0
        self.words = name | np.uint64(1)                                                  # odd: words and ends
        self.words[0] &= ~np.uint64(1)
        self.longer = []
        name = longer = name[self.tokens]
        for k in range(2, order + 1):
            before = np.concatenate([longer[:1], longer[:-1]])
            longer = (before ^ (before >> np.uint64(31))) * _M1 + name * _M2
            longer ^= longer >> np.uint64(29)
            longer[self.pad] = np.uint64((_START * k * 2 + k) & 0xFFFFFFFFFFFFFFFF)
            self.longer.append(longer & ~np.uint64(1))
        # Contexts of the first token end at the position before it.
        self.since = [max(self.skip - 1, 0)] * (order - 2) + [self.skip] * (order > 1)
        self.rows, self.ids, self.parts = row["rows"], row["ids"], np.asarray(row["parts"])
        self.doc = np.repeat(np.arange(len(self.rows)), row["sizes"])                     # of positions after skip

    def keys(self) -> np.ndarray:
        """What the block asks for: its words, then the longer orders by position."""
        return np.concatenate([self.words, *(k[a:] for a, k in zip(self.since, self.longer))])

    def counts(self) -> np.ndarray:
        """How often each of ``keys`` stands for itself in training documents."""
        trained = (self.parts != HELD_OUT)[self.doc].astype(np.int64)
        return np.concatenate([np.bincount(self.tokens[self.skip:], trained, len(self.words)).astype(np.int64),
                               *(np.concatenate([np.zeros(self.skip - a, np.int64), trained]) for a in self.since)])

    def looked_up(self, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, token) counts of the n-grams and of their contexts; tokens are the positions that are no marks.

        ``total``: the sums for ``keys``.
        """
        at = np.flatnonzero(~self.pad[self.skip:]) + self.skip
        upto = np.cumsum([len(self.words), *(len(self.tokens) - a for a in self.since)])
        word = total[:len(self.words)]
        grams, contexts = [word[self.tokens[at]]], [word[self.tokens[at - 1]]]
        for i, a in enumerate(self.since):
            sums = total[upto[i]:upto[i + 1]]
            grams.append(sums[at - a])
            if i + 1 < len(self.since):
                contexts.append(sums[at - 1 - a])
        return np.array(grams), np.array(contexts[:len(self.since)])


# Counting

def _spread(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of every key; larger keys have no smaller bucket."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def asked(index: DataFrame, order: int, buckets: int, low: int, high: int) -> DataFrame:
    """Every block's distinct n-grams of the buckets from ``low`` to ``high`` with their training counts."""

    def run(batches):
        for b in batches:
            for row in _rows(b):
                block = Block(row, order)
                keys = block.keys()
                bucket = _spread(keys, buckets)
                mine = (bucket >= low) & (bucket < high)
                unique, where = np.unique(keys[mine], return_inverse=True)
                n = np.bincount(where, block.counts()[mine], len(unique)).astype(np.int64)
                bucket = _spread(unique, buckets)
                cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
                if len(unique):
                    spans = list(zip(cut[:-1], cut[1:]))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(bucket[cut[:-1]].astype(np.int64)), pa.array(np.full(len(spans), row["block"])),
                        pa.array(np.full(len(spans), block.deleted)), pa.array([packed(unique[a:z]) for a, z in spans]),
                        pa.array([packed(n[a:z]) for a, z in spans])], names=["bucket", "block", "deleted", "keys", "n"])

    return index.mapInArrow(run, "bucket long, block long, deleted boolean, keys binary, n binary")


def answered(requests: DataFrame) -> DataFrame:
    """Every bucket's sums, for every block that asked: ``total``, and ``fit`` without deleted documents.

    A row without a block holds how many distinct tokens and tokens the bucket has, with and without deleted ones.
    """

    def run(table: pa.Table) -> pa.Table:
        keys, n = ([unpacked(x) for x in table.column(c).to_pylist()] for c in ("keys", "n"))
        deleted = table.column("deleted").to_pylist()
        upto = np.cumsum([0, *map(len, keys)])
        unique, where = np.unique(np.concatenate(keys).astype(np.uint64), return_inverse=True)    # sorts, which is faster than hashing
        sums = [np.bincount(where, np.concatenate(x), len(unique)).astype(np.int64)
                for x in (n, [np.zeros(len(x)) if d else x for x, d in zip(n, deleted)])]
        word = (unique & np.uint64(1)).astype(bool)
        spans = list(zip(upto[:-1], upto[1:], deleted))
        facts = [[None] * len(spans) + [int(x)] for c in sums for x in ((c[word] > 0).sum(), c[word].sum())]
        return pa.table([
            pa.array(table.column("bucket").to_pylist() + [None], pa.int64()), pa.array(table.column("block").to_pylist() + [None], pa.int64()),
            pa.array([packed(sums[0][where[a:z]]) for a, z, _ in spans] + [None], pa.binary()),
            pa.array([packed(sums[1][where[a:z]]) if d else None for a, z, d in spans] + [None], pa.binary()),
            *(pa.array(x, pa.int64()) for x in facts)],
            names=["bucket", "block", "total", "fit", "words", "tokens", "fit_words", "fit_tokens"])

    return requests.groupBy("bucket").applyInArrow(
        run, "bucket long, block long, total binary, fit binary, words long, tokens long, fit_words long, fit_tokens long")


def _rows(b: pa.RecordBatch) -> Iterator[dict]:
    for i in range(b.num_rows):
        yield {name: b.column(j)[i].as_py() for j, name in enumerate(b.schema.names)}


def _met(index: DataFrame, replies: DataFrame, field: str, order: int, fn, schema: str) -> DataFrame:
    """``fn(block, counts, contexts)`` for every block with its answers."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(next(_rows(left.combine_chunks().to_batches()[0])), order)
        answers = np.concatenate([unpacked(x) for x in right.sort_by("bucket").column(field).to_pylist()]).astype(np.int64)
        _, where = np.unique(block.keys(), return_inverse=True)
        return fn(block, *block.looked_up(answers[where]))

    mine = replies.select("block", "bucket", field).where(f"block IS NOT NULL AND {field} IS NOT NULL")
    return index.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(run, schema)


# Mixture

def frequency(contexts: np.ndarray, tokens: int) -> np.ndarray:
    """Bucket of every token: the binary order of magnitude of its contexts' counts, six bits each; 0: never seen."""
    out = np.zeros(tokens, np.int64)
    for k, c in enumerate(contexts):
        out |= np.frexp(c.astype(np.float64))[1].astype(np.int64) << 6 * k
    return out


def estimates(grams: np.ndarray, contexts: np.ndarray, tokens: int, words: int) -> np.ndarray:
    """(component, token): uniform, then the maximum-likelihood estimate of each order, 0 where it has no context."""
    return np.array([np.full(grams.shape[1], 1 / (words + 1)), grams[0] / max(tokens, 1),
                     *(g / np.maximum(c, 1) for g, c in zip(grams[1:], contexts))])


def allowed(bucket: int, order: int) -> np.ndarray:
    """Components a bucket can use: an order whose context was never seen has no estimate."""
    return np.array([True, True, *(bool(bucket >> 6 * k & 63) for k in range(order - 1))])


class Mixture:
    """Weights of every bucket; a bucket that no deleted token fell into takes those of the nearest alike."""

    def __init__(self, weights: dict[int, list[float]], order: int):
        self.weights, self.order = weights, order

    def of(self, bucket: int) -> np.ndarray:
        if bucket in self.weights:
            return np.array(self.weights[bucket])
        can = allowed(bucket, self.order)
        parts = range(self.order - 1)
        near = [(sum(abs((b >> 6 * k & 63) - (bucket >> 6 * k & 63)) for k in parts), b) for b in self.weights
                if (allowed(b, self.order) == can).all()]
        return np.array(self.weights[min(near)[1]]) if near else can / can.sum()

    def probabilities(self, bucket: np.ndarray, estimate: np.ndarray) -> np.ndarray:
        distinct, where = np.unique(bucket, return_inverse=True)
        table = np.array([self.of(int(b)) for b in distinct]).reshape(-1, self.order + 1)
        return (table[where].T * estimate).sum(axis=0)


def maximised(tokens: DataFrame, order: int, rounds: int = ROUNDS, still: float = STILL) -> dict[int, list[float]]:
    """Mixture weights by bucket from ``(bucket, p0 .. pK, n)``, one Spark aggregate a round.

    Buckets number at most 64^(K-1), whatever the table's size; each is learned by itself
    and starts even. One pseudo-token per usable component keeps weights above zero.
    """
    spark = tokens.sparkSession
    weights = {r["bucket"]: allowed(r["bucket"], order) / allowed(r["bucket"], order).sum()
               for r in tokens.select("bucket").distinct().collect()}
    columns = [f"l{k}" for k in range(order + 1)]
    for _ in range(rounds if weights else 0):
        table = spark.createDataFrame([(b, *w.tolist()) for b, w in weights.items()], "bucket long, " + ", ".join(f"{c} double" for c in columns))
        share = [F.col(c) * F.col(f"p{k}") for k, c in enumerate(columns)]
        whole = reduce(lambda a, b: a + b, share)
        found = (tokens.join(F.broadcast(table), "bucket").groupBy("bucket")
                 .agg(*(F.sum(F.col("n") * s / whole).alias(c) for s, c in zip(share, columns))).collect())
        moved = 0.0
        for r in found:
            can = allowed(r["bucket"], order)
            new = np.array([r[c] for c in columns]) + can
            new /= new.sum()
            moved = max(moved, float(np.abs(new - weights[r["bucket"]]).max()))
            weights[r["bucket"]] = new
        if moved <= still:
            break
    return {b: w.tolist() for b, w in weights.items()}


# Scores of a table

def score(docs: DataFrame, order: int = ORDER, passes: int = PASSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row."""
    index = stored(blocks(docs, order, id_col, text_col), "lm-blocks")
    positions = index.select(F.sum("positions").alias("n")).first()["n"] or 0
    buckets = max(1, -(-positions * order // BUCKET_KEYS))
    cuts = [buckets * i // passes for i in range(passes + 1)]
    parts = [stored(answered(asked(index, order, buckets, low, high)), "lm-counts") for low, high in zip(cuts, cuts[1:]) if low < high]
    replies = reduce(DataFrame.unionByName, parts)
    words, tokens, fit_words, fit_tokens = (x or 0 for x in replies.where("block IS NULL").select(
        *(F.sum(c) for c in ("words", "tokens", "fit_words", "fit_tokens"))).first())

    def deleted(block: Block, grams: np.ndarray, contexts: np.ndarray) -> pa.Table:
        p = estimates(grams, contexts, fit_tokens, fit_words)
        bucket = frequency(contexts, p.shape[1])
        alike = np.lexsort([*p[1:], bucket])                    # tokens with equal estimates are one row
        new = np.concatenate([[True], (np.diff(bucket[alike]) != 0) | (np.diff(p[1:, alike], axis=1) != 0).any(axis=0)])
        first = np.flatnonzero(new)
        return pa.table({"bucket": bucket[alike][first], **{f"p{k}": x[alike][first] for k, x in enumerate(p)},
                         "n": np.diff(np.concatenate([first, [len(alike)]]))})

    columns = [f"p{k}" for k in range(order + 1)]
    rows = _met(index.where("deleted"), replies, "fit", order, deleted,
                "bucket long, " + ", ".join(f"{c} double" for c in columns) + ", n long")
    rows = stored(rows.groupBy("bucket", *columns).agg(F.sum("n").alias("n")), "lm-deleted")
    mixture = Mixture(maximised(rows, order) if fit_tokens else {}, order)
    discard(rows)

    def scored(block: Block, grams: np.ndarray, contexts: np.ndarray) -> pa.Table:
        p = estimates(grams, contexts, tokens, words)
        if tokens:
            p = mixture.probabilities(frequency(contexts, p.shape[1]), p)
        else:
            p = p[0]
        doc = block.doc[~block.pad[block.skip:]]
        base = np.log10((grams[0] + 0.1) / (tokens + 0.1 * (words + 1)))
        sums = [np.bincount(doc, w, len(block.rows)) for w in (np.ones(len(doc)), grams[0] > 0, base, np.log10(p))]
        return pa.table({"row": pa.array(block.rows, pa.int64()), "doc_id": pa.array(block.ids, pa.int64()),
                         "held_out": pa.array(block.parts == HELD_OUT), "n_tokens": sums[0].astype(np.int64),
                         "n_known": sums[1].astype(np.int64), "base_score": sums[2], "score": sums[3]})

    found = []
    for turn in range(passes):
        mine = F.pmod(F.xxhash64("block"), F.lit(passes)) == turn
        found.append(stored(_met(index.where(mine), replies.where(mine), "total", order, scored,
                                 "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, "
                                 "score double"), "lm-parts"))
    out = stored(reduce(DataFrame.unionByName, found).groupBy("row", "doc_id", "held_out")
                 .agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
                 .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"),
                 "lm-scores")
    for table in (index, *parts, *found):
        discard(table)
    return out
