"""Language identification by compression with per-language dictionaries.

Each learned language has a zstandard raw-content dictionary, cut from a bounded sample
of slices of its training texts. A text is compressed, in blocks that together cover all
of it, with every dictionary; the language whose dictionary gives the fewest bytes wins.
The margin to the second smallest is the score, and narrow margins are flagged
``rejected``.

Results: one row per input row. Null texts and texts without a letter get ``und`` with
score 0 and are rejected, and so does every text when nothing could be learned. Ties go
to the language that sorts first. Repeated rows give repeated results.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evlens.llm.common import arrow_map, stored

UNKNOWN = "und"
SAMPLE_DOCS = 200             # training texts looked at per language
SLICE = 1 << 10               # most characters of one of them
DICTIONARY_BYTES = 96 << 10   # most bytes of a dictionary
ALL_BYTES = 48 << 20          # and of all dictionaries, which travel with the tasks: many languages share it evenly
LEAST_BYTES = 8               # zstandard takes no smaller dictionary: shorter content is repeated
BLOCK = 8 << 10               # characters compressed at a time
LEVEL, MIN_MATCH = 13, 3
MARGIN = 0.02                 # narrower relative margins are rejected
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def letters_only(text: str) -> str:
    """What tells languages apart: the lower-cased words of letters of the whole text."""
    return f" {_OTHER.sub(' ', text.lower())} "


def held_out(id_col: str = "doc_id"):
    """Documents that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE_DOCS, size: int = DICTIONARY_BYTES, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """language -> raw dictionary content, from at most ``sample`` texts of each language.

    One scan for all languages. Texts are dealt into ``sample`` groups by a hash of id and
    text; each language keeps the smallest hash of each group, so repeated rows take one
    place only, and any language with a text that is not empty is learned. Of a long text
    a slice is taken, from a place the hash gives.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                       F.col(f"`{lang_col}`").cast("string").alias("lang"))
    fit = rows.where(~held_out()).where("lang is not null and text != ''").withColumn("h", F.xxhash64("doc_id", "text"))
    spare = F.greatest(F.length("text") - SLICE, F.lit(0))
    slices = fit.select("lang", "h", F.pmod("h", F.lit(sample)).alias("deal"),
                        F.substr("text", F.pmod("h", spare + 1).cast("int") + 1, F.lit(SLICE)).alias("part"))
    # One row of each group is kept per task before anything is shuffled.
    first = Window.partitionBy("lang", "deal").orderBy("h")
    picked = stored(slices.withColumn("n", F.row_number().over(first)).where("n = 1").select("lang", "h", "part"), "languages")
    languages = picked.select("lang").distinct().count()
    if not languages:
        return {}
    share = max(LEAST_BYTES, min(size, ALL_BYTES // languages))
    # A slice that begins beyond the share is not needed: what is collected stays near ALL_BYTES.
    order = Window.partitionBy("lang").orderBy("h")
    before = F.coalesce(F.sum(F.length("part")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts: dict[str, list[str]] = {}
    for r in picked.withColumn("before", before).where(F.col("before") < share).orderBy("lang", "h").collect():
        parts.setdefault(r["lang"], []).append(r["part"])
    return {lang: _content(p, share) for lang, p in parts.items()}


def _content(parts: list[str], size: int) -> bytes:
    raw = b"\n".join(letters_only(p).encode() for p in parts)[:size]
    return raw * -(-LEAST_BYTES // len(raw))


class Compressors:
    """One compressor per language, made once in each task."""

    def __init__(self, content: dict[str, bytes]):
        self.names = sorted(content)
        self.each = [self._compressor(content[n]) for n in self.names]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_content_size=0,
                                                                write_dict_id=0, write_checksum=0)
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=words, compression_params=params)

    def sizes(self, text: str) -> np.ndarray:
        """Compressed bytes of the whole text under each dictionary."""
        text = letters_only(text)
        blocks = [text[i:i + BLOCK].encode() for i in range(0, len(text), BLOCK)]
        return np.array([sum(len(c.compress(b)) for b in blocks) for c in self.each])


def predict(docs: DataFrame, content: dict[str, bytes], margin: float = MARGIN,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)``; lang_pred is the closest language even if rejected."""

    def run(batches):
        comp = Compressors(content)
        for b in batches:
            pred, score = [], []
            for t in b.column("text").to_pylist():
                if t is None or not comp.names or not _LETTER.search(t):
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    continue
                size = comp.sizes(t)
                best = int(size.argmin())
                rest = np.delete(size, best)
                pred.append(comp.names[best])
                score.append(float(1 - size[best] / rest.min()) if len(rest) else 1.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred), pa.array(score, pa.float64()),
                                              pa.array([s < margin for s in score])],
                                             names=["doc_id", "lang_pred", "score", "rejected"])

    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                        F.col(f"`{text_col}`").cast("string").alias("text"))
    return arrow_map(plain, run, "doc_id long, lang_pred string, score double, rejected boolean")
