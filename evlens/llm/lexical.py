"""Ranked lexical search by NRA: sequential reads of impact-sorted lists, no random access.

Documents are dealt into shards where they are read. A shard holds, for every term the
items ask for, the documents with that term and how often. Spark sums the shards' counts
into the table-wide N, L and df, and only then are impacts known: an impact is what one
term adds to one document's score. Every shard then sorts each list by falling impact
and answers each item from its lists alone:

* each round reads the next entries of every list of the item, which raises the lower
  ends of the documents met;
* the upper end of a document is its lower end plus, for each list it has not been met
  in, the impact that list will give next at most;
* the least score that still matters is the k-th largest lower end, counting also the
  exact scores the task has kept from earlier shards;
* reading ends when no document that was never met can reach that score and every
  document that can reach it has equal ends. Membership, ties and scores are exact then.

A task hands on its k best documents of each item; Spark ranks those of all tasks.
Items are answered in blocks of ``ITEMS``, so what travels to the tasks (the terms of one
block and their weights) is bounded by that and by the length of the items.

Results: one row per item and rank. A document is a row of the table: repeated rows are
documents of their own. Null and empty texts hold no term, count for nothing and are not
found; rows with a null id count in N, L and df and are found with a null id, after all
others among equal scores. Rows that agree in id and score are alike, and their order
does not matter. Items with null or empty text have no rows; of items with a repeated id
every row is answered by itself. Other columns are not read.
"""
from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evlens.llm.common import discard, id_text, sliced, stored, workers_find_package
from evlens.llm.wordlists import translated, words_of

TOP = 20
ITEMS = 1_000            # items answered together
SHARD_BYTES = 8 << 20    # text of one shard; one longer text is a shard by itself
FIRST_READ = 64          # entries of each list read in the first round, twice as many in each further one

# Separators (and nothing else) become spaces; A-Z become a-z.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
                   for b in range(256))


def terms(text: str | None) -> list[str]:
    """Terms of one text, in order, with repeats."""
    return [t.decode() for t in (text or "").encode().translate(TERM_BYTES).split()]


def shards(docs: DataFrame, wanted: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of the table: ids and term counts of their documents, and the lists of the wanted terms.

    ``list_term``, ``list_doc`` and ``list_tf`` are parallel, ordered by term; terms are
    numbers in ``wanted``, documents are numbers in ``ids``. Documents without a term are left out.
    """

    def run(batches):
        vocabulary = pa.array(wanted, pa.string())
        for b in sliced(batches, SHARD_BYTES):
            flat, size = words_of(translated(b.column(1), TERM_BYTES))
            has = size > 0
            coded = flat.dictionary_encode()
            number = pc.fill_null(pc.index_in(coded.dictionary, vocabulary), -1).to_numpy()
            term = number[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(int(has.sum())), size[has])
            pair, tf = np.unique(term[term >= 0].astype(np.int64) * (len(size) + 1) + doc[term >= 0], return_counts=True)
            list_term, list_doc = np.divmod(pair, len(size) + 1)
            yield pa.RecordBatch.from_pydict({
                "ids": [b.column(0).filter(pa.array(has))], "n": [size[has]], "list_term": [list_term.astype(np.int32)],
                "list_doc": [list_doc.astype(np.int32)], "list_tf": [tf.astype(np.int64)]}, schema=_SHARD)

    workers_find_package(docs.sparkSession)
    return id_text(docs, id_col, text_col).mapInArrow(
        run, "ids array<long>, n array<long>, list_term array<int>, list_doc array<int>, list_tf array<long>")


_SHARD = pa.schema([("ids", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("list_term", pa.list_(pa.int32())),
                    ("list_doc", pa.list_(pa.int32())), ("list_tf", pa.list_(pa.int64()))])


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, kept: list[int],
        first: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents that may be among the k best, with their exact scores, and how many entries were read.

    ``lists``: documents and impacts of each term, impacts falling. ``kept``: scores known
    from elsewhere that compete; of equal scores all are returned.
    """
    lower = np.zeros(n_docs, np.int64)
    met = np.zeros((n_docs, len(lists)), np.int64)
    at, step, read = 0, first, 0
    kept_scores = np.array(kept, np.int64)
    while True:
        bounds = np.zeros(len(lists), np.int64)
        for j, (doc, impact) in enumerate(lists):
            part = doc[at:at + step]
            lower[part] += impact[at:at + step]
            met[part, j] = 1
            read += len(part)
            if at + step < len(impact):
                bounds[j] = impact[at + step]
        at, step = at + step, step * 2
        never = int(bounds.sum())
        competing = np.concatenate([lower[lower > 0], kept_scores])
        least = int(np.partition(competing, len(competing) - k)[len(competing) - k]) if len(competing) >= k else 1
        upper = lower + never - met @ bounds
        alive = np.flatnonzero(upper >= max(least, 1))
        seen = alive[lower[alive] > 0]
        if never == 0 or (len(seen) == len(alive) and (upper[alive] == lower[alive]).all()):
            return seen, lower[seen], read
        step = min(step, 1 << 20)


def _impacts(row: dict, weight: np.ndarray, n: int, total: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Each term's documents and impacts for one occurrence in an item, impacts falling."""
    m = 75 + (25 * row["n"] * n) // total
    term, doc, tf = row["list_term"], row["list_doc"], row["list_tf"]
    impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
    order = np.lexsort((doc, -impact, term))
    term, doc, impact = term[order], doc[order], impact[order]
    cut = np.flatnonzero(np.diff(term, prepend=-1))
    return {int(term[a]): (doc[a:z], impact[a:z]) for a, z in zip(cut, [*cut[1:], len(term)])}


def _answer(index: DataFrame, items: list[tuple[int, dict[int, int]]], weight: np.ndarray, n: int, total: int,
            k: int) -> DataFrame:
    """The k best documents of every item in each task's shards; items by their number in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, bool, int]]] = [[] for _ in items]    # heaps of (score, has an id, -doc_id), least first
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(j)[i].values.to_numpy(zero_copy_only=False) for j, c in enumerate(b.schema.names) if c != "ids"}
                ids = b.column(0)[i].as_py()
                lists = _impacts(row, weight, n, total)
                for q, (_, asked) in enumerate(items):
                    mine = [(lists[t][0], lists[t][1] * times) for t, times in asked.items() if t in lists and weight[t] > 0]
                    if not mine:
                        continue
                    found, score, _ = nra(mine, len(ids), k, [e[0] for e in best[q]])
                    for s, j in zip(score.tolist(), found.tolist()):
                        entry = (s, ids[j] is not None, -(ids[j] or 0))
                        if len(best[q]) < k:
                            heapq.heappush(best[q], entry)
                        elif entry > best[q][0]:
                            heapq.heapreplace(best[q], entry)
        rows = [(q, -d if has else None, s) for q, heap in enumerate(best) for s, has, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64()))],
                                         names=["item", "doc_id", "score"])

    return index.mapInArrow(run, "item int, doc_id long, score long")


def weights(n: int, df: np.ndarray) -> np.ndarray:
    """Weight of terms that ``df`` of ``n`` documents hold."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block: int = ITEMS, id_col: str = "doc_id",
           text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of every item."""
    spark = docs.sparkSession
    asked = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    out = None
    pending: list[tuple[int, Counter]] = []

    def answered(group: list[tuple[int, Counter]]) -> DataFrame:
        wanted = sorted({t for _, c in group for t in c})
        number = {t: i for i, t in enumerate(wanted)}
        index = stored(shards(docs, wanted, id_col, text_col), "lexical")
        n, total = index.select(F.sum(F.size("n")), F.sum(F.expr("aggregate(n, 0L, (a, x) -> a + x)"))).first()
        if not n:
            discard(index)
            return spark.createDataFrame([], "item_id long, doc_id long, score long")
        df = np.zeros(len(wanted), np.int64)
        for r in index.select(F.explode("list_term").alias("t")).groupBy("t").count().collect():
            df[r["t"]] = r["count"]
        coded = [(i, {number[t]: c for t, c in counts.items()}) for i, counts in group]
        found = stored(_answer(index, coded, weights(n, df), n, total, k), "lexical-found")
        discard(index)
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(group)], "item int, item_id long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                .join(F.broadcast(names), "item")
                .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))

    def put(group):
        nonlocal out
        part = answered(group)
        out = part if out is None else out.unionByName(part)

    for r in asked.toLocalIterator():
        counts = Counter(terms(r["text"]))
        if counts:
            pending.append((r["item_id"], counts))
        if len(pending) == block:
            put(pending)
            pending = []
    if pending:
        put(pending)
    if out is None:
        out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out
