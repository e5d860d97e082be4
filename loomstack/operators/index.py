"""The code index that outlives a query: files, chunks, symbols and postings under one folder.

A build writes a *segment*: the chunks and symbols of the files that changed, and their postings (term, field, positions), hashed by term into
buckets and sorted by term inside, so that a search reads the files of its terms' buckets and of these the row groups of its terms. A
*manifest* lists the live files with the segment that holds them, and what ranking needs of a file (numbers of chunks, symbols and terms); it
counts from the moment its mark is written, so a build that dies leaves the index as it was. Rows of changed or removed files stay in their
segments, unseen, until a compaction writes the live ones into one.

A file that is there again with the same content hash is not analysed again, whatever its time and size say. Another schema, tokenizer or
set of symbol patterns makes a full build of it. Statistics are those of the live files, so a refreshed index ranks like a new one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstack.functions import text as T
from loomstack.operators import bm25, chunking, fusion, snapshot, symbols
from loomstack.runtime import hadoop_fs, written

SCHEMA_VERSION, TOKENIZER_VERSION = "1", "1"
#: Segments beyond which a build compacts.
MAX_SEGMENTS = 8
FILES = "path string, file_no long, mtime long, size long, content_hash string, segment int, chunks long, chunk_terms long, symbols long, symbol_terms long"
TABLES = {
    "chunks": "file_no long, ord int, path string, start_line int, end_line int, raw_body string, len int", "symbols": "file_no long, ord int, path string, name string, kind string, start_line int, end_line int, raw_signature string, len int",
    **{f"{k}_postings": "term string, file_no long, ord int, len int, field string, positions array<int>, bucket int" for k in ("chunk", "symbol")}}
#: Weights by field of the two kinds of documents.
KINDS = {"chunk": bm25.CHUNK_WEIGHTS, "symbol": bm25.SYMBOL_WEIGHTS}
#: A file's number: the segment, the partition, the place in it.
SEGMENT, PART = 44, 28


def _numbered(files: DataFrame, segment: int) -> DataFrame:
    """``files`` with ``file_no``, in the order of their paths."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = (segment << SEGMENT) + (TaskContext.get().partitionId() << PART)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + b.num_rows)), *b.columns], ["file_no", *b.schema.names])
            at += b.num_rows

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = "file_no long, path string, mtime long, size long, content string, content_hash string"
    return files.select("path", "mtime", "size", "content", "content_hash").repartitionByRange(parts, "path").sortWithinPartitions("path").mapInArrow(number, kinds)


class CodeIndex:
    """An index under ``state``. ``files`` given to it: path, mtime, size, content, content_hash; paths are unique.

    ``buckets`` is a property of the index: the number under which it was built counts.
    """

    def __init__(self, spark: SparkSession, state: str, buckets: int = 64):
        self.spark, self.state, self.new_buckets = spark, state.rstrip("/"), buckets

    @property
    def buckets(self) -> int:
        return self.meta()["buckets"] if self.version() else self.new_buckets

    def _bucket(self, term: str):
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    # ---- manifests ----------------------------------------------------------------------------------------------------------
    def _path(self, *parts) -> str:
        return "/".join([self.state, *map(str, parts)])

    def version(self) -> int:
        """The current manifest; 0 if there is no index."""
        fs, at = hadoop_fs(self.spark, self._path("manifests"))
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def _read_text(self, path: str) -> str:
        fs, at = hadoop_fs(self.spark, path)
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def meta(self) -> dict:
        """What the index knows of itself; an error if there is none."""
        n = self.version()
        if not n:
            raise FileNotFoundError(f"no index under {self.state}: build it first")
        return json.loads(self._read_text(self._path("manifests", f"{n}.json")))

    def files(self) -> DataFrame:
        """The live files."""
        n = self.version()
        return self.spark.read.schema(FILES).parquet(self._path("manifests", n)) if n else self.spark.createDataFrame([], FILES)

    def _commit(self, number: int, files: DataFrame, meta: dict) -> None:
        files.select(*[c.split()[0] for c in FILES.split(", ")]).write.mode("overwrite").parquet(self._path("manifests", number))
        fs, at = hadoop_fs(self.spark, self._path("manifests", f"{number}.json"))
        out = fs.create(at, True)
        out.write(bytearray(json.dumps(meta, sort_keys=True).encode()))
        out.close()

    @staticmethod
    def _segments_of(files: DataFrame) -> list[int]:
        return sorted(r["segment"] for r in files.select("segment").distinct().collect())  # at most MAX_SEGMENTS and one

    def segments(self) -> list[int]:
        """Segments that hold live files."""
        return self.meta()["segments"] if self.version() else []

    def _table(self, name: str, segments: list[int]) -> DataFrame:
        parts = [self.spark.read.schema(TABLES[name]).parquet(self._path("segments", s, name)) for s in segments]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], TABLES[name])

    # ---- building -----------------------------------------------------------------------------------------------------------
    def _write_segment(self, fresh: DataFrame, segment: int, languages: frozenset[str]) -> DataFrame:
        """Analyse ``fresh`` files into a segment; their manifest rows."""
        spark = self.spark
        files = written(_numbered(fresh, segment), "files")
        plain = files.select("file_no", "path")
        cut = chunking.chunks(files, "file_no", "content").join(plain, "file_no").select("file_no", F.col("start_line").alias("ord"), "path", "start_line", "end_line", F.col("body").alias("raw_body"))
        found = symbols.symbols(files.select(F.col("file_no").alias("file_id"), "path", "content"), languages)
        found = found.select(F.col("file_id").alias("file_no"), F.row_number().over(_by_file()).alias("ord"), "path", "name", "kind", "start_line", "end_line", "raw_signature")
        cut = bm25.chunk_index(cut)
        found = found.withColumns({"name_terms": T.text_terms(F.col("name")), "path_terms": T.terms(T.path_terms(F.col("path"))), "signature_terms": T.text_terms(F.col("raw_signature"))})
        sizes = files.select("path", "file_no", "mtime", "size", "content_hash", F.lit(segment).alias("segment"))

        def write(kind: str, rows: DataFrame) -> DataFrame:
            fields = list(KINDS[kind])
            rows = written(rows.withColumn("len", reduce(lambda a, b: a + b, [F.size(f) for f in fields])), f"{kind}s")
            rows.drop(*fields).write.mode("overwrite").parquet(self._path("segments", segment, f"{kind}s"))
            each = [rows.select("file_no", "ord", "len", F.lit(f).alias("field"), F.posexplode(f).alias("pos", "term")) for f in fields]
            postings = reduce(DataFrame.unionByName, each).groupBy("term", "file_no", "ord", "field", "len").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
            postings.withColumn("bucket", self._bucket("term")).repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(self._path("segments", segment, f"{kind}_postings"))
            return rows.groupBy("file_no").agg(F.count("*").alias(f"{kind}s"), F.sum("len").alias(f"{kind}_terms"))

        with ThreadPoolExecutor(2) as both:  # the two kinds need each other as little as their jobs do
            for per in [x.result() for x in [both.submit(write, "chunk", cut), both.submit(write, "symbol", found)]]:
                sizes = sizes.join(per, "file_no", "left")
        zero = F.lit(0).cast("long")
        return written(sizes.withColumns({c: F.coalesce(F.col(c).cast("long"), zero) for k in KINDS for c in (f"{k}s", f"{k}_terms")}), "manifest")

    def build(self, files: DataFrame, languages: frozenset[str] | None = None, force: bool = False, facts: dict | None = None) -> dict:
        """Bring the index up to date with ``files``; returns counts of files added, updated, removed and unchanged, and totals.

        ``facts`` (project, commit and the like) are kept with the index.
        """
        languages = frozenset(symbols.LANGUAGES) if languages is None else languages
        number = self.version() + 1
        marks = {"schema_version": SCHEMA_VERSION, "tokenizer_version": TOKENIZER_VERSION, "symbol_fingerprint": symbols.fingerprint(languages)}
        fits = number > 1 and all(self.meta().get(k) == v for k, v in marks.items())
        full = force or not fits
        old = self.spark.createDataFrame([], FILES) if full else self.files()
        now = files.select("path", "mtime", "size", "content", "content_hash")
        changes = written(snapshot.diff(old, now, "path", "content_hash"), "changes")
        count = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
        fresh = now.join(changes.where("change in ('added', 'updated')").select("path"), "path", "left_semi")
        kept = old.join(changes.where("change = 'unchanged'").select("path"), "path", "left_semi").drop("mtime", "size").join(now.select("path", "mtime", "size"), "path")
        if count.get("added", 0) + count.get("updated", 0):
            kept = kept.unionByName(self._write_segment(fresh, number, languages))
        kept = written(kept, "manifest")
        total = kept.agg(F.count("*").alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for k in KINDS for c in (f"{k}s", f"{k}_terms")]).first().asDict()
        stats = {k: count.get(k, 0) for k in ("added", "updated", "removed", "unchanged")} | {"files": total["files"], "chunks": total["chunks"], "symbols": total["symbols"], "full_rebuild": full, "languages": sorted(languages)}
        segments = self._segments_of(kept)
        if len(segments) > MAX_SEGMENTS:
            kept = self._compacted(kept, segments, number + 1)
            number += 1
            segments = [number]
        self._commit(number, kept, {**marks, **total, **(facts or {}), "languages": sorted(languages), "buckets": self.buckets, "segments": segments})
        return stats

    def _compacted(self, files: DataFrame, segments: list[int], segment: int) -> DataFrame:
        """The live rows of all segments as one; numbers of files stay."""
        live = files.select("file_no")
        for kind in KINDS:
            self._table(f"{kind}s", segments).join(live, "file_no", "left_semi").write.mode("overwrite").parquet(self._path("segments", segment, f"{kind}s"))
            rows = self._table(f"{kind}_postings", segments).join(live, "file_no", "left_semi")
            rows.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(self._path("segments", segment, f"{kind}_postings"))
        return files.withColumn("segment", F.lit(segment))

    # ---- reading ------------------------------------------------------------------------------------------------------------
    def postings(self, kind: str, terms: list[str]) -> DataFrame:
        """Postings of the given terms in live files; only the buckets of the terms are listed and read."""
        files = self.files()
        wanted = sorted(set(terms))
        buckets = sorted({_hash(t) % self.buckets for t in wanted})
        rows = self._table(f"{kind}_postings", self.segments())
        return rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(wanted)).join(files.select("file_no"), "file_no", "left_semi")

    def vocabulary(self, kind: str = "chunk", field: str = "body_terms") -> DataFrame:
        """(term, documents, occurrences) of one field over the live files: the statistics that ranking rests on."""
        files = self.files()
        live = self._table(f"{kind}_postings", self.segments()).where(F.col("field") == field).join(files.select("file_no"), "file_no", "left_semi")
        return live.groupBy("term").agg(F.count("*").alias("documents"), F.sum(F.size("positions")).alias("occurrences"))

    def frequencies(self, kind: str, phrases: list[list[str]]) -> DataFrame:
        """(file_no, ord, len, tf_0, tf_1 ...): weighted counts of the phrases in each document that has any."""
        p = self.postings(kind, [t for ph in phrases for t in ph])
        at = p.groupBy("file_no", "ord", "len", "field").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))  # as many entries as the query has terms
        none = F.array().cast("array<int>")
        weight = F.create_map(*[F.lit(x) for kv in KINDS[kind].items() for x in kv])[F.col("field")]

        def times(phrase: list[str]):
            starts = F.coalesce(F.try_element_at("at", F.lit(phrase[0])), none)
            for k, term in enumerate(phrase[1:], 1):
                starts = F.filter(starts, _followed(F.coalesce(F.try_element_at("at", F.lit(term)), none), k))
            return F.size(starts)

        return at.groupBy("file_no", "ord", "len").agg(*[F.sum(times(ph) * weight).alias(f"tf_{i}") for i, ph in enumerate(phrases)])

    def scored(self, kind: str, phrases: list[list[str]], mode: str = "and") -> DataFrame:
        """(file_no, ord, score) of the matching documents, lower is better; statistics are those of all live files."""
        if not phrases or mode == "and" and any(not p for p in phrases) or not any(phrases):
            return self.spark.createDataFrame([], "file_no long, ord int, score double")
        phrases = [p for p in phrases if p]
        rows = self.frequencies(kind, phrases)
        stats = rows.agg(*[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(phrases))])
        meta = self.meta()
        n, length = meta[f"{kind}s"], meta[f"{kind}_terms"]
        rows = rows.crossJoin(F.broadcast(stats)).withColumns({"n": F.lit(n), "avgdl": F.lit(length / n if n else 0.0)})  # one row
        return bm25.with_score(rows, len(phrases), mode).select("file_no", "ord", "score")

    def _hits(self, kind: str, hits: DataFrame, snippet: str) -> DataFrame:
        docs = self._table(f"{kind}s", self.segments())
        j = hits.join(docs, ["file_no", "ord"])
        return j.select("path", "start_line", "end_line", "score", F.col(snippet).alias("snippet"), *(["name"] if kind == "symbol" else []))

    def hits(self, kind: str, query: str, limit: int, fallback: bool = True) -> DataFrame:
        """(path, start_line, end_line, score, snippet): best first; of chunks those with any term where none has all and the query is no name."""
        phrases = T.query_phrases(query)
        best = lambda mode: self._hits(kind, self.scored(kind, phrases, mode), "raw_body" if kind == "chunk" else "raw_signature").orderBy("score", "path", "start_line").limit(limit)
        found = written(best("and"), "hits")
        if fallback and len(phrases) > 1 and T.symbol_token(query) is None and found.isEmpty():
            found = written(best("or"), "hits")
        return found

    def search(self, query: str, top_k: int = 0, with_symbols: bool = True) -> DataFrame:
        """Ranked code search over the index: chunks by the whole query, symbols by its identifier, fused if there are symbol hits."""
        if not query.strip():
            raise ValueError("empty query")
        limit = fusion.clamp_top_k(top_k) * fusion.OVERFETCH
        chunks = self.hits("chunk", query, limit)
        name = T.symbol_token(query) if with_symbols else None
        if name:
            found = self.hits("symbol", name, limit, fallback=False)
            if not found.isEmpty():
                return fusion.fuse(chunks, found, name, top_k)
        return fusion.chunk_only(chunks, top_k)

    def ensure_fresh(self, commit: str) -> None:
        """An error if the project stands at another commit than the index; silent where either is unknown."""
        known = self.meta().get("commit", "")
        if commit and known and commit != known:
            raise RuntimeError(f"the index is of {known[:12]}, the project at {commit[:12]}: build it again")


def _hash(term: str) -> int:
    """The engine's xxhash64 of a string, without asking it."""
    h = xxhash.xxh64(term.encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def _followed(positions, distance: int):
    """Does a term stand ``distance`` behind a position?"""
    return lambda i: F.array_contains(positions, i + distance)


def _by_file():
    from pyspark.sql import Window

    return Window.partitionBy("file_id").orderBy("start_line", "name", "kind", "end_line")  # the symbols of one file
