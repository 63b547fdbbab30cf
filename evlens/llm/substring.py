"""Removal of repeated word windows, found by recompression.

Recompression rewrites every text level by level: first runs of one word become one
symbol, then, level by level, a symbol of the left half of the alphabet followed by one
of the right half becomes a new symbol. Whether two neighbours join depends on the two
alone, so equal substrings get the same symbols everywhere but at their ends. A symbol's
name is 128 bits derived from what it stands for, hence the same in every task, and
Spark's rounds settle globally what the names reveal:

1. Copies: documents of one digest are one text; all but the first are covered whole.
2. Long symbols (at least ``LONG`` words): every occurrence but the first lies under
   windows that also start earlier, so these spans are removed at once.
3. Window symbols: of the symbols of level ``ROUNDS`` that surely lie inside a window
   (whatever surrounds it), the ``RUN`` neighbours whose joint name is smallest. Equal
   windows have equal window symbols, and a stretch of windows shares one, so few are
   named; a window whose symbol occurs once occurs once. Windows with fewer such
   symbols take what they have, or are named by themselves (long runs of one word).
4. Only windows with a repeated symbol are compared, by their 128-bit names; the
   smallest (doc_id, start) of each name stays, words of the other windows go.

What repeats inside one text is settled where the text is read, so that the shuffles
only have to find the smallest doc_id of each name.

Results: one row per input row. Null and empty texts have no words. Rows with equal id
and words are one document and get equal results. Null ids order after all others.
Between different texts of one id, and between texts without an id, nothing says which
is earlier, and neither loses words to the other.
"""
from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlens.llm.common import WORD_BREAK, arrow_map, discard, id_text, stored, texts_of

WINDOW = 20          # words
LONG = 40            # words of a symbol whose repeats are settled without windows
ROUNDS = 3           # levels of pairs under a window's symbols
RUN = 3              # symbols that name a window, about seven words
LEVELS = 24          # levels looked at for long symbols
_NO_ID = (1 << 63) - 1

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M3
    return x ^ (x >> np.uint64(32))


def _salted(k: int, by: np.uint64) -> np.uint64:
    return np.uint64(k * int(by) & 0xFFFFFFFFFFFFFFFF)


def _pair(left: np.ndarray, right: np.ndarray, salt: int) -> np.ndarray:
    """Name of a sequence of two names (two 64-bit columns each)."""
    a = _mix(left[:, 0] * _M1 + right[:, 0] + np.uint64(salt))
    b = _mix(left[:, 1] * _M3 + right[:, 1] + _salted(salt, _M1))
    return np.stack([a ^ (b >> np.uint64(7)), b], 1)


class Parsed:
    """All texts of one batch, concatenated, with what recompression says of them."""

    def __init__(self, texts: list[str], window: int = WINDOW):
        self.words = [t.encode().split() for t in texts]
        self.n_words = np.array([len(w) for w in self.words], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n_words)])
        raw = b"".join(xxhash.xxh3_128_digest(w) for ws in self.words for w in ws)
        self.names = np.frombuffer(raw, "<u8").reshape(-1, 2).astype(np.uint64)
        self.doc = np.repeat(np.arange(len(texts)), self.n_words)
        self.window = window

    def digest(self, k: int) -> bytes:
        return hashlib.sha256(b" ".join(self.words[k])).digest()

    def windows(self) -> np.ndarray:
        """Start positions (in the batch) of all windows."""
        start = np.arange(len(self.doc))
        return start[start + self.window <= self.first[1:][self.doc]] if len(start) else start

    def window_names(self, at: np.ndarray) -> np.ndarray:
        """128-bit names of the windows at these positions."""
        out = np.zeros((len(at), 2), np.uint64)
        for j in range(self.window):
            nxt = self.names[at + j]
            out[:, 0] = out[:, 0] * _M1 + nxt[:, 0]
            out[:, 1] = (out[:, 1] ^ nxt[:, 1]) * _M3
            out[:, 1] ^= out[:, 1] >> np.uint64(31)
        return np.stack([_mix(out[:, 0]), _mix(out[:, 1])], 1)

    def recompress(self, long: int | None):
        """Windows, the symbol of each and where it starts; if asked, (name, start, length) of long symbols."""
        n = len(self.doc)
        win = self.windows()
        top = np.zeros(len(win), np.uint64)
        top_at = win.copy()
        found = np.zeros(len(win), bool)
        long_rows = []
        if not n:
            return win, top, top_at, long_rows
        # Runs of one word.
        new_doc = np.concatenate([[True], self.doc[1:] != self.doc[:-1]])
        begin = np.flatnonzero(new_doc | np.concatenate([[True], (self.names[1:] != self.names[:-1]).any(axis=1)]))
        run_of = np.cumsum(np.isin(np.arange(n), begin, assume_unique=True)) - 1
        length = np.diff(np.concatenate([begin, [n]]))
        start, doc = begin, self.doc[begin]
        many = length > 1
        names = self.names[begin].copy()
        names[many] = _pair(names[many], np.repeat(length[many].astype(np.uint64)[:, None], 2, 1), 1)
        # The runs a window begins and ends in may go on outside it; those between are sure.
        a, b = run_of[win] + 1, run_of[win + self.window - 1]
        for level in range(LEVELS if long else ROUNDS):
            left = (names[:, 0] >> np.uint64(level + 3) & np.uint64(1)).astype(bool)
            joins = np.zeros(len(names), bool)
            joins[:-1] = left[:-1] & ~left[1:] & (doc[:-1] == doc[1:])
            second = np.concatenate([[False], joins[:-1]])
            head = np.flatnonzero(~second)
            if level < ROUNDS:
                # A right symbol at the front or a left one at the end may join what lies outside.
                live = a < b
                a[live] += ~left[a[live]]
                live = a < b
                b[live] -= left[b[live] - 1]
                live = a < b
                place = np.cumsum(~second) - 1
                a[live], b[live] = place[a[live]], place[b[live] - 1] + 1
                b[~live] = a[~live] = 0
            made = joins[head]
            at = head[made]
            fresh, size = names[head], length[head]
            fresh[made] = _pair(names[at], names[at + 1], level + 2)
            size[made] += length[at + 1]
            if long:
                grown = np.flatnonzero(made & (size >= long))
                long_rows.append((fresh[grown], start[head][grown], size[grown]))
            names, length, start, doc = fresh, size, start[head], doc[head]
            if level == ROUNDS - 1:
                self._window_symbols(names, start, a, b, top, top_at, found)
        rest = np.flatnonzero(~found)
        top[rest] = self.window_names(win[rest])[:, 0]
        return win, top, top_at, long_rows

    def _window_symbols(self, names, start, a, b, top, top_at, found):
        """Name each window by the smallest run of ``RUN`` neighbours among its sure symbols a..b, or by all it has."""
        for m in range(1, RUN):
            few = np.flatnonzero(b - a == m)
            name = _mix(names[a[few], 1] + _salted(m, _M3))
            for k in range(1, m):
                name = _mix(name * _M1 + names[a[few] + k, 1])
            top[few], top_at[few], found[few] = name, start[a[few]], True
        many = np.flatnonzero(b - a >= RUN)
        if not len(many):
            return
        runs = names[:len(names) - RUN + 1, 0]
        for k in range(1, RUN):
            runs = _mix(runs * _M1 + names[k:len(names) - RUN + 1 + k, 0])
        first, width = a[many], b[many] - a[many] - RUN + 1     # runs that begin at first .. first + width - 1
        best = first.copy()
        table = np.arange(len(runs))                  # place of the smallest of 2^k runs from each place on
        k = 0
        while 1 << k <= width.max():
            fit = (width >> k) == 1                   # 2^k <= width < 2^(k+1)
            x, y = table[first[fit]], table[first[fit] + width[fit] - (1 << k)]
            best[fit] = np.where(runs[x] <= runs[y], x, y)
            ahead = table[np.minimum(np.arange(len(runs)) + (1 << k), len(runs) - 1)]
            table = np.where(runs[table] <= runs[ahead], table, ahead)
            k += 1
        top[many], top_at[many], found[many] = runs[best], start[best], True


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    plain = id_text(docs, id_col, text_col)
    return plain.withColumn("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)))


def _version(digest: bytes) -> int:
    """What tells texts of one doc_id apart, and orders them."""
    return int.from_bytes(digest[:8], "big", signed=True)


def parse(docs: DataFrame, window: int = WINDOW, long: int = LONG,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: word count, digest, distinct window symbols (and which repeat inside), long symbols."""

    def run(batches):
        for batch in batches:
            p = Parsed(texts_of(batch, "text"), window)
            win, top, top_at, long_rows = p.recompress(long)
            owner = p.doc[win]
            order = np.lexsort((top, owner))
            o, t, at = owner[order], top[order], top_at[order]
            new = np.concatenate([[True], (o[1:] != o[:-1]) | (t[1:] != t[:-1])]) if len(o) else np.zeros(0, bool)
            begin = np.flatnonzero(new)
            again = (np.maximum.reduceat(at, begin) != np.minimum.reduceat(at, begin)
                     if len(begin) else np.zeros(0, bool))
            o, t = o[begin], t[begin]
            cut = np.searchsorted(o, np.arange(batch.num_rows + 1)).astype(np.int32)
            if long_rows:
                name, start, size = (np.concatenate(x) for x in zip(*long_rows))
            else:
                name, start, size = np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            by = np.argsort(start, kind="stable")
            name, start, size = name[by], start[by], size[by]
            of = p.doc[start]
            seen = _seen_before(of, name, start)
            long_cut = np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32)
            items = pa.StructArray.from_arrays(
                [pa.array(name[:, 0].copy().view(np.int64)), pa.array(name[:, 1].copy().view(np.int64)),
                 pa.array((start - p.first[of]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(seen)],
                names=["h1", "h2", "start", "words", "seen"])
            digests = [p.digest(k) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p.n_words), pa.array(digests, pa.binary()),
                 pa.array([_version(d) for d in digests], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(cut), pa.array(t.view(np.int64))),
                 pa.ListArray.from_arrays(pa.array(cut), pa.array(again)),
                 pa.ListArray.from_arrays(pa.array(long_cut), items)],
                names=["doc_id", "n_words", "digest", "version", "symbols", "again", "longs"])

    return arrow_map(_named(docs, id_col, text_col), run,
                     "doc_id long, n_words long, digest binary, version long, symbols array<long>, "
                     "again array<boolean>, longs array<struct<h1:long,h2:long,start:int,words:int,seen:boolean>>")


def _seen_before(doc: np.ndarray, names: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the same text holds the same name at a smaller place."""
    order = np.lexsort((at, names[:, 1], names[:, 0], doc))
    d, n = doc[order], names[order]
    out = np.zeros(len(at), bool)
    out[order[1:]] = (d[1:] == d[:-1]) & (n[1:] == n[:-1]).all(axis=1)
    return out


def _marked(n: int, starts, lengths) -> np.ndarray:
    """Which of n places lie in any of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.asarray(starts, np.int64), 1)
    np.add.at(edge, np.asarray(starts, np.int64) + np.asarray(lengths, np.int64), -1)
    return np.cumsum(edge[:-1]) > 0


def _spans(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of row k of an array<struct<start,words>> column."""
    if not column[k].is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    v = column[k].values
    return v.field("start").to_numpy().astype(np.int64), v.field("words").to_numpy().astype(np.int64)


def windows_to_compare(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Windows whose symbol repeats, outside settled spans, from ``(doc_id, version, symbols, settled, text)``."""

    def run(batches):
        for batch in batches:
            p = Parsed(texts_of(batch, "text"), window)
            win, top, _, _ = p.recompress(None)
            cut = np.searchsorted(p.doc[win], np.arange(batch.num_rows + 1))
            keep = np.zeros(len(win), bool)
            symbols, settled = batch.column("symbols"), batch.column("settled")
            for k in range(batch.num_rows):
                i, j = cut[k], cut[k + 1]
                if i == j or not symbols[k].is_valid:
                    continue
                start, size = _spans(settled, k)
                keep[i:j] = (np.isin(top[i:j].view(np.int64), symbols[k].values.to_numpy())
                             & ~_marked(j - i, start, size - window + 1))
            at = win[keep]
            names, rows = p.window_names(at), pa.array(p.doc[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[:, 0].copy().view(np.int64)), pa.array(names[:, 1].copy().view(np.int64)),
                 batch.column("doc_id").take(rows), batch.column("version").take(rows),
                 pa.array((at - p.first[p.doc[at]]).astype(np.int32)), pa.array(_seen_before(p.doc[at], names, at))],
                names=["w1", "w2", "doc_id", "version", "start", "seen"])

    return arrow_map(texts, run, "w1 long, w2 long, doc_id long, version long, start int, seen boolean")


def _later(found: DataFrame, name: list[str]) -> DataFrame:
    """Occurrences that start earlier elsewhere: in the same text (``seen``), or in a smaller doc_id."""
    fresh = found.where("not seen")
    least = (fresh.groupBy(*name).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
             .where("least < most").select(*name, "least"))
    return found.where("seen").unionByName(fresh.join(least, name).where("doc_id > least").drop("least"))


def text_version(text: str = "text"):
    """``version`` of a text by built-in functions."""
    words = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WORD_BREAK, " "))
    return F.conv(F.substring(F.sha2(words, 256), 1, 16), 16, -10).cast("long")


def find_repeats(docs: DataFrame, window: int = WINDOW, long: int = LONG,
                 id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(rows, repeats)``.

    rows: per input row (doc_id, version, n_words, digest, copy). repeats: per distinct
    text with something to remove (doc_id, version, text, settled, starts): spans of
    settled long symbols, and starts of the windows that start earlier elsewhere.
    """
    parsed = stored(parse(docs, window, long, id_col, text_col), "parsed")
    # Stored, so that a digest with very many copies meets it in a join whose partitions can be split.
    firsts = stored(parsed.groupBy("digest").agg(F.min("doc_id").alias("first")), "firsts")
    rows = stored(parsed.select("doc_id", "version", "n_words", "digest").join(firsts, "digest")
                  .withColumn("copy", F.col("doc_id") > F.col("first")).drop("first"), "rows")
    firsts = rows.where("not copy").select("doc_id", "version").distinct()

    settled = stored(_later(parsed.select("doc_id", "version", F.explode("longs").alias("s"))
                            .select("doc_id", "version", "s.*"), ["h1", "h2"])
                     .join(firsts, ["doc_id", "version"], "left_semi")
                     .groupBy("doc_id", "version").agg(F.collect_set(F.struct("start", "words")).alias("settled")), "settled")

    # Window symbols that occur in two distinct texts, or at two places of one. Copies share
    # their version, so they do not count as two.
    occurring = parsed.select("version", F.explode(F.arrays_zip("symbols", "again")).alias("s"))
    repeated = (occurring.groupBy(F.col("s.symbols").alias("symbol"))
                .agg(F.min("version").alias("least"), F.max("version").alias("most"), F.max("s.again").alias("again"))
                .where("again or least != most").select("symbol"))
    wanted = (parsed.join(firsts, ["doc_id", "version"], "left_semi")
              .select("version", F.explode("symbols").alias("symbol")).join(repeated, "symbol", "left_semi")
              .groupBy("version").agg(F.collect_set("symbol").alias("symbols")))

    todo = stored(firsts.join(wanted, "version").join(settled, ["doc_id", "version"], "left"), "todo")
    discard(parsed)
    plain = _named(docs, id_col, text_col)
    texts = stored(plain.join(todo, "doc_id").where(text_version() == F.col("version"))
                   .select("doc_id", "version", "symbols", "settled", "text"), "candidates")
    found = stored(windows_to_compare(texts, window), "windows")
    later = stored(_later(found, ["w1", "w2"]).groupBy("doc_id", "version")
                   .agg(F.sort_array(F.collect_set("start")).alias("starts")), "later")
    discard(found)
    repeats = (texts.select("doc_id", "version", "text", "settled").dropDuplicates(["doc_id", "version"])
               .join(later, ["doc_id", "version"], "left").where("settled is not null or starts is not null"))
    return rows, repeats


def _removed(batch: pa.RecordBatch, k: int, n: int, window: int) -> np.ndarray:
    """Which words of row k of a ``repeats`` batch go."""
    start, size = _spans(batch.column("settled"), k)
    found = batch.column("starts")[k]
    at = found.values.to_numpy().astype(np.int64) if found.is_valid else np.zeros(0, np.int64)
    return _marked(n, np.concatenate([start, at]), np.concatenate([size, np.full(len(at), window)]))


def digests(docs: DataFrame, window: int = WINDOW, long: int = LONG,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` per input row."""
    rows, repeats = find_repeats(docs, window, long, id_col, text_col)

    def run(batches):
        for b in batches:
            gone, sha = [], []
            for k, t in enumerate(texts_of(b, "text")):
                words = t.encode().split()
                drop = _removed(b, k, len(words), window)
                gone.append(int(drop.sum()))
                sha.append(hashlib.sha256(b" ".join(w for w, d in zip(words, drop.tolist()) if not d)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("version"), pa.array(gone, pa.int64()),
                                              pa.array(sha, pa.string())],
                                             names=["doc_id", "version", "gone", "sha"])

    cut = arrow_map(repeats, run, "doc_id long, version long, gone long, sha string")
    whole = F.col("copy") & (F.col("n_words") >= window)
    return rows.join(cut, ["doc_id", "version"], "left").select(
        F.nullif("doc_id", F.lit(_NO_ID)).alias("doc_id"), "n_words",
        F.when(whole, F.col("n_words")).when(F.col("copy"), 0).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).when(F.col("copy") | F.col("sha").isNull(), F.lower(F.hex("digest")))
        .otherwise(F.col("sha")).alias("kept_sha256"))


def without_repeats(docs: DataFrame, window: int = WINDOW, long: int = LONG,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, version, n_removed, text)`` of the distinct texts that lose words: what is left of them.

    The white space after a removed word goes with it. Copies of an earlier text have
    no row of their own with text: they come with ``n_removed`` = all words and null text.
    """
    rows, repeats = find_repeats(docs, window, long, id_col, text_col)
    gap = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")

    def run(batches):
        for b in batches:
            gone, left = [], []
            for k, t in enumerate(texts_of(b, "text")):
                spans = [m.span() for m in gap.finditer(t)]
                drop = _removed(b, k, len(spans), window).tolist()
                gone.append(sum(drop))
                head = t[:spans[0][0]] if spans else t
                left.append(head + "".join(t[i:j] for (i, j), d in zip(spans, drop) if not d))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("version"), pa.array(gone, pa.int64()),
                                              pa.array(left, pa.string())],
                                             names=["doc_id", "version", "n_removed", "text"])

    cut = stored(arrow_map(repeats, run, "doc_id long, version long, n_removed long, text string"), "cut")
    copies = (rows.where(F.col("copy") & (F.col("n_words") >= window)).select(
        "doc_id", "version", F.col("n_words").alias("n_removed"), F.lit(None).cast("string").alias("text")).distinct())
    return cut.unionByName(copies).select(F.nullif("doc_id", F.lit(_NO_ID)).alias("doc_id"), "version", "n_removed", "text")
