"""Problem 8: exact ids of a public byte-pair vocabulary for every document.

The vocabulary's pattern cuts a text into pieces. A piece is encoded by dynamic programming over its prefixes instead of by merging:
the last token of the encoding of a prefix is unique, so one entry per prefix is enough. An automaton over all tokens of the
vocabulary gives the tokens that are suffixes of a prefix; a token t is the last one if and only if it is compatible with the last token
of the prefix before it, that is, if the two bytes strings together encode to just this pair. (A sequence of tokens is the encoding of its bytes if and
only if every neighbouring pair is.) Back-pointers from the end of the piece then give the ids.

Pieces repeat, so each task keeps the ids of recent ones, within CACHE entries; the same holds for compatible pairs. The vocabulary file
(under a megabyte, of fixed size) is read once and sent to the tasks. Texts are read whole, one pass, no shuffle.

Defined results: null and empty texts have an empty list; every other text has at least one id; strings of special tokens are ordinary
text; lone surrogates cannot occur in a Parquet string.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstack.runtime import table

#: Folder of the vocabulary files.
TOKENIZERS = os.environ.get("LOOMSTACK_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
CACHE = 200_000
# Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Encodes texts with the ranks of one vocabulary file (base64 token, space, rank, on each line)."""

    def __init__(self, ranks_file: bytes):
        import ahocorasick
        import regex

        lines = (line.split() for line in ranks_file.splitlines() if line)
        self.ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in lines}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.auto = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.auto.add_word(token, (len(token), rank))
        self.auto.make_automaton()
        self.cut = regex.compile(PATTERN).findall
        self.pieces: dict[str, list[int]] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, s: str) -> list[int]:
        """The definition: merge the pair of lowest rank, leftmost first, until none is left. Only for short strings."""
        parts = list(s)
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Do the bytes of tokens a and b together encode to a, b? With a = -1: is b its own encoding?"""
        key = a << 20 | b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > CACHE:
                self.pairs.clear()
            ok = self.merged(self.tokens[b]) == [b] if a < 0 else self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
            self.pairs[key] = ok
        return ok

    def piece(self, text: str) -> list[int]:
        """Ids of one piece."""
        s = text.encode().decode("latin-1")
        last = [-1] * (len(s) + 1)
        size = [0] * (len(s) + 1)
        for end, (n, rank) in self.auto.iter(s):
            end += 1
            if size[end]:
                continue
            start = end - n
            if start and not size[start]:
                continue
            if self.compatible(last[start], rank):
                last[end], size[end] = rank, n
        out, at = [], len(s)
        while at:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.pieces
        for p in self.cut(text):
            ids = known.get(p)
            if ids is None:
                if len(known) > CACHE:
                    known.clear()
                ids = self.piece(p)
                if len(p) <= 64:
                    known[p] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return "".join(self.tokens[i] for i in ids).encode("latin-1").decode("utf-8", "replace")


_encoders: dict[int, Encoder] = {}


def encoder(ranks_file: bytes) -> Encoder:
    """One encoder per process and vocabulary; Python workers are reused by later tasks."""
    key = hash(ranks_file)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks_file)
    return _encoders[key]


def vocabulary(name: str = VOCABULARY, folder: str | None = None) -> bytes:
    with open(os.path.join(folder or TOKENIZERS, f"{name}.tiktoken"), "rb") as f:
        return f.read()


def encoded(documents: DataFrame, ranks_file: bytes) -> DataFrame:
    """(doc_id, ids) of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(ranks_file)  # a vocabulary file: fixed size, below 1 MB

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [encode(t) for t in part.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.fromiter((x for d in ids for x in d), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(scan, "doc_id long, ids array<int>")


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary())


def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, uses, documents) of every id that occurs."""
    per = ids(spark, sf_dir).select("doc_id", F.explode("ids").alias("id")).groupBy("id", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("id").agg(F.sum("n").alias("uses"), F.count("*").alias("documents"))
