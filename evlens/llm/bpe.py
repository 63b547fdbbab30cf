"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is cut before every single space that follows a non-space character. The
split pattern never joins characters across such a cut, so each part can be encoded
once - each match of the pattern in it by the library's BPE model -, remembered per
worker (bounded; a word before a mark is looked up as the word), and the ids of a text are the concatenation of its parts' ids. Ids travel
as little-endian unsigned 32-bit bytes. Texts with characters that are unassigned here, and
for vocabulary files with added tokens texts that hold one, are encoded at once by the
library whose ids are to be matched: its own tables then say what a letter is, and added
tokens are matched before a text is split.

Null text reads as empty: no ids. Empty texts give zero ids and decode to zero bytes.
"""
from __future__ import annotations

import base64
import codecs
import hashlib
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evlens.llm.common import arrow_map, id_text, texts_of

CACHE_PARTS = 300_000      # remembered parts per worker, twice
CACHE_PIECES = 180_000     # remembered matches of the pattern per worker, twice


@lru_cache(maxsize=1)
def byte_alphabet() -> list[str]:
    """Byte value -> printable character, the mapping of byte-level BPE vocabularies.

    Printable Latin-1 bytes stand for themselves, the others take the code points
    from 256 on in byte order.
    """
    own = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def to_alphabet(raw: bytes) -> str:
    table = byte_alphabet()
    return "".join(table[b] for b in raw)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[str, str]]:
    """The merge list a rank table stands for: each token's last join, in rank order."""
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda kv: kv[1]):
        if len(token) < 2:
            continue
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if best >= rank:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            merges.append((to_alphabet(parts[0]), to_alphabet(parts[1])))
    return merges


def tokenizer_from_ranks(path: str, pattern: str):
    """A tokenizers.Tokenizer that gives the ids of the rank table."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = read_ranks(path)
    vocab = {to_alphabet(t): r for t, r in ranks.items()}
    tok = Tokenizer(models.BPE(vocab=vocab, merges=merges_of(ranks), ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tok


def tokenizer_from_json(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def parts_of(text: str) -> list[str]:
    """Cut before each single space after a non-space; a part keeps the runs of white space it ends in."""
    out, held = [], None
    for p in text.split(" "):
        held = p if held is None else f"{held} {p}"
        if p and not p[-1].isspace():
            out.append(held)
            held = None
    if held is not None:
        out.append(held)
    return out


class _Remembered(dict):
    """A bounded memory of a function: when it is full, it becomes the older half, and a new one begins."""

    def __init__(self, fn, limit: int):
        super().__init__()
        self.fn, self.limit, self.older = fn, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.fn(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class _NotApart(Exception):
    """A part that cannot be encoded without its neighbour."""


class _Unassigned(Exception):
    """A text with characters that Unicode versions, and so the libraries' tables of letters, may differ on."""


class PartEncoder:
    """Encodes texts part by part; what parts and matches of the pattern give is remembered up to a bound.

    ``whole`` encodes a text at once, as the library with the ids to be matched does. It is
    used for texts that cannot be cut here: those with a token in ``added``, which comes
    before any splitting, and those with characters that are letters or not by version.
    """

    def __init__(self, tokenizer, pattern: str, whole: Callable[[str], list[int]], added: Iterable[str] = (),
                 parts: int = CACHE_PARTS, pieces: int = CACHE_PIECES):
        import regex

        self.model, self.at_once, self.added = tokenizer.model, whole, tuple(added)
        self.assigned: set[str] = set()             # characters met that have a meaning in this Python's Unicode version
        self.cut = regex.compile(pattern).findall
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.space = byte_alphabet()[32]
        self.packed = [i.to_bytes(4, "little") for i in range(max(tokenizer.get_vocab().values(), default=-1) + 1)]
        self.pieces = _Remembered(self._piece, pieces)
        self.parts = _Remembered(self._part, parts)

    def _tokens(self, spelled: str) -> bytes:
        """Ids of one match of the pattern in the byte alphabet, by the library's BPE model."""
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(spelled)])

    def _piece(self, piece: str) -> bytes:
        """Ids of one match of the pattern. What is raised here is never remembered."""
        if not piece.isascii() and not self.assigned.issuperset(piece):
            if any(unicodedata.category(c) == "Cn" for c in piece):     # newer tables may give it a meaning
                raise _Unassigned
            self.assigned.update(piece)
        return self._tokens(piece.encode().decode("latin-1").translate(self.alphabet))

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.cut(text)))

    def _part(self, part: str) -> bytes:
        if not part or part[-1].isspace():
            raise _NotApart
        if part.isalpha():                                      # a space and letters are one match, letters have a meaning
            spelled = part if part.isascii() else part.encode().decode("latin-1").translate(self.alphabet)
            return self._tokens(self.space + spelled)
        if part[-1] in ".,;:!?" and part[:-1].isalpha():        # and then one mark is another
            return self.parts[part[:-1]] + self.pieces[part[-1]]
        return self._whole(" " + part)

    def _cut(self, text: str) -> bytes:
        get = self.parts.__getitem__
        head, *rest = text.split(" ")
        try:
            if head and head[-1].isspace():
                raise _NotApart
            return self._whole(head) + b"".join(map(get, rest))
        except _NotApart:       # runs of white space before a space: longer parts
            head, *rest = parts_of(text)
            return self._whole(head) + b"".join(self._whole(" " + p) if p[-1:].isspace() or not p else get(p) for p in rest)

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            try:
                if any(a in text for a in self.added):
                    raise _Unassigned
                out.append(self._cut(text))
            except _Unassigned:
                out.append(np.asarray(self.at_once(text), "<u4").tobytes())
        return out


class Decoder:
    """Ids back to bytes through the reversed byte table."""

    def __init__(self, vocab: dict[str, int]):
        value = {c: b for b, c in enumerate(byte_alphabet())}
        self.table = {i: bytes(value[c] for c in t) for t, i in vocab.items() if all(c in value for c in t)}

    def bytes_of(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def pieces(self, ids: Iterable[int]) -> Iterator[str]:
        """Text id by id; a character split over several ids comes out with its last one."""
        dec = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield dec.decode(self.table[i])
        yield dec.decode(b"", True)

    def offsets(self, ids: bytes) -> list[tuple[int, int]]:
        """(start, end) in characters of every id; ids inside one character share its span."""
        toks = [self.table[i] for i in np.frombuffer(ids, "<u4").tolist()]
        raw = np.frombuffer(b"".join(toks), np.uint8)
        ends = np.cumsum([len(t) for t in toks])
        begun = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])   # characters begun before each byte
        first = begun[1:][ends - [len(t) for t in toks]] - 1 if len(toks) else []
        return list(zip(np.asarray(first).tolist(), begun[ends].tolist())) if len(toks) else []


@lru_cache(maxsize=2)
def reference_encoding(path: str, pattern: str):
    """The rank table in tiktoken, whose ids are to be matched."""
    import tiktoken

    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


_workers: dict[tuple, tuple[PartEncoder, Decoder]] = {}


def worker_codec(kind: str, path: str, pattern: str) -> tuple[PartEncoder, Decoder]:
    """One encoder and decoder per Python worker and vocabulary."""
    key = (kind, path, pattern)
    if key not in _workers:
        if kind == "ranks":
            tok, added = tokenizer_from_ranks(path, pattern), []
            whole = lambda text: reference_encoding(path, pattern).encode_ordinary(text)
        else:
            tok = tokenizer_from_json(path)
            added = [t.content for t in tok.get_added_tokens_decoder().values()]
            whole = lambda text: tok.encode(text, add_special_tokens=False).ids
        _workers[key] = PartEncoder(tok, pattern, whole, added), Decoder(tok.get_vocab())
    return _workers[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           offsets: bool = False) -> DataFrame:
    """``(doc_id, ids[, offsets])`` of every whole text."""
    schema = "doc_id long, ids array<int>" + (", offsets array<struct<start:int,end:int>>" if offsets else "")

    def run(batches):
        enc, dec = worker_codec("ranks", ranks_path, pattern)
        for b in batches:
            raw = enc.encode(texts_of(b, "text"))
            cols = [b.column(0), pa.array([np.frombuffer(r, "<i4") for r in raw], pa.list_(pa.int32()))]
            if offsets:
                cols.append(pa.array([[{"start": s, "end": e} for s, e in dec.offsets(r)] for r in raw],
                                     pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "offsets"][:len(cols)])

    return arrow_map(id_text(docs, id_col, text_col), run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, raw, text)`` from ``(doc_id, ids)``: the exact bytes, and their text (bad bytes replaced)."""

    def run(batches):
        _, dec = worker_codec("ranks", ranks_path, pattern)
        for b in batches:
            raw = [dec.bytes_of(np.asarray(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw])],
                names=["doc_id", "raw", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, raw binary, text string")


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text in one pass: token count and the two digests."""

    def run(batches):
        enc, dec = worker_codec("ranks", ranks_path, pattern)
        for b in batches:
            raw = enc.encode(texts_of(b, "text"))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(r) // 4 for r in raw], pa.int64()),
                 pa.array([hashlib.sha256(r).hexdigest() for r in raw]),
                 pa.array([hashlib.sha256(dec.bytes_of(r)).hexdigest() for r in raw])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(id_text(docs, id_col, text_col), run,
                     "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
