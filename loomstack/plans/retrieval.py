"""Queries of the retrieval side: files, tokens, chunks, symbols, ranking, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstack.functions import text as T
from loomstack.operators import bm25, chunking, fusion, index, symbols, windows
from loomstack.runtime import scratch, spread, table, written

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return register


# ---- SQL building blocks ----------------------------------------------------------------------------------------------------
_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}"
_MARK = "chr(1)"


def _sql_camel(p: str) -> str:
    out = p
    for rx in (r"(\p{Ll})(\p{Lu})", r"(\p{Lu})(\p{Lu}\p{Ll})", r"(\p{L})(\p{Nd})", r"(\p{Nd})(\p{L})"):
        out = rf"regexp_replace({out}, '{rx}', '\1' || {_MARK} || '\2', 'g')"
    return f"(case when len(string_split({out}, {_MARK})) > 1 then string_split({out}, {_MARK}) else []::varchar[] end)"


def _sql_pieces(p: str) -> str:
    snake = f"flatten(list_transform(list_filter(string_split({p}, '_'), lambda q: q <> ''), lambda q: [q] || {_sql_camel('q')}))"
    return f"(case when contains({p}, '_') then {snake} else {_sql_camel(p)} end)"


def sql_tokens(c: str, query: bool = False) -> str:
    """Stage 1 in DuckDB."""
    runs = rf"flatten(list_transform(list_filter(string_split_regex({c}, '[^\p{{L}}\p{{Nd}}_{_CJK}]+'), lambda w: w <> ''), lambda w: regexp_extract_all(w, '[{_CJK}]+|[^{_CJK}]+')))"
    pairs = "(case when length(p) >= 2 then list_transform(range(1, length(p)), lambda i: substring(p, i, 2)) else []::varchar[] end)"
    word = "(case when length(p) > 2 then []::varchar[] else [p] end)" if query else "[p]"
    spell = rf"(case when regexp_matches(p, '[{_CJK}]') then {word} || {pairs} else [p] || {_sql_pieces('p')} end)"
    chains = rf"regexp_extract_all({c}, '[\p{{L}}_][\p{{L}}\p{{Nd}}_]*(?:(?:::|\.)[\p{{L}}_][\p{{L}}\p{{Nd}}_]*)+')"
    parts = r"string_split_regex(k, '::|\.')"
    one = f"[array_to_string({parts}[1:n], '')]" if query else f"[array_to_string({parts}[1:n], '::'), array_to_string({parts}[1:n], ''), array_to_string({parts}[1:n], '.')]"
    qualified = f"flatten(flatten(list_transform({chains}, lambda k: list_transform(range(2, len({parts}) + 1), lambda n: {one}))))"
    every = f"list_transform({qualified} || flatten(list_transform({runs}, lambda p: {spell})), lambda t: lower(t))"
    # Distinct, first occurrence kept.
    return f"(select list(t order by o) from (select t, min(o) as o from (select unnest({every}) as t, generate_subscripts({every}, 1) as o) group by t))"


def sql_terms(stage1: str) -> str:
    """Stage 2 in DuckDB."""
    fold = "(case when regexp_matches(t, '[À-ɏ]') then strip_accents(t) else t end)"
    return rf"flatten(list_transform({stage1}, lambda t: list_filter(string_split_regex({fold}, '[^\p{{L}}\p{{N}}\p{{Co}}]+'), lambda x: x <> '')))"


# ---- tokenizers -------------------------------------------------------------------------------------------------------------
@query(f"select doc_id, coalesce(array_to_string({sql_tokens(chr(116) + 'ext')}, ' '), '') as tokens from (select doc_id, coalesce(text, '') as text from documents)")
def tokens_stage1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", F.array_join(T.text_tokens(F.col("text")), " ").alias("tokens"))


@query(f"select id, coalesce(array_to_string({sql_tokens('title', True)}, ' '), '') as tokens from (select id, coalesce(title, '') as title from sessions)")
def tokens_query_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sessions", "id", "title").select("id", F.array_join(T.tokens(F.col("title"), query=True), " ").alias("tokens"))


@query(f"select doc_id, terms, n from (select doc_id, coalesce(array_to_string({sql_terms('s')}, ' '), '') as terms, coalesce(len({sql_terms('s')}), 0)::bigint as n from (select doc_id, {sql_tokens('text')} as s from (select doc_id, coalesce(text, '') as text from documents)))")
def tokens_stage2(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", T.text_terms(F.col("text")).alias("t"))
    return d.select("doc_id", F.array_join("t", " ").alias("terms"), F.size("t").cast("long").alias("n"))


@query(f"""select id, array_to_string({sql_tokens("p")}, ' ') as path_terms, array_to_string({sql_tokens("b")}, ' ') as basename_terms from
  (select id, translate(path, '/.-', '   ') as p, regexp_replace(regexp_extract(path, '([^/]*)/*$', 1), '^(.*)\\.([^.]*)$', '\\1 \\2') as b from files)""")
def path_and_basename_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files", "id", "path").select(
        "id", F.array_join(T.path_terms(F.col("path")), " ").alias("path_terms"), F.array_join(T.basename_terms(F.col("path")), " ").alias("basename_terms"))


# ---- BM25 -------------------------------------------------------------------------------------------------------------------
def _sql_bm25(index: str, phrases: list[str], weights: dict[str, float], mode: str, keys: str, extra: str, order: str, limit: int) -> str:
    tf = lambda p: " + ".join(f"len(list_filter({f}, lambda t: t = '{p}')) * {w}" for f, w in weights.items())
    tfs = ", ".join(f"{tf(p)} as tf_{i}" for i, p in enumerate(phrases))
    stats = ", ".join(f"sum((tf_{i} > 0)::int) as df_{i}" for i in range(len(phrases)))
    ln = " + ".join(f"len({f})" for f in weights)
    score = " + ".join(f"greatest(ln((n - df_{i} + 0.5) / (df_{i} + 0.5)), 1e-6) * tf_{i} * 2.2 / (tf_{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(phrases)))
    hit = (" and " if mode == "and" else " or ").join(f"tf_{i} > 0" for i in range(len(phrases)))
    return f"""with idx as ({index}), f as (select *, {tfs}, {ln} as dl from idx), s as (select count(*) as n, sum(dl) / count(*) as avgdl, {stats} from f)
select {keys}, round(-({score}), 6) as score{extra} from f, s where {hit} order by -({score}), {order} limit {limit}"""


_DOCS = f"(select doc_id, coalesce({sql_terms('s')}, []::varchar[]) as body_terms from (select doc_id, {sql_tokens('text')} as s from (select doc_id, coalesce(text, '') as text from documents)))"
_BODY = {"body_terms": 1.0}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written index of the documents."""
    return written(spread(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", T.text_terms(F.col("text")).alias("body_terms")), "index")


def _chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written index of the chunks."""
    return written(bm25.chunk_index(spread(table(spark, sf_dir, "chunks", "id", "path", "start_line", "end_line", "raw_body"))), "index")


def _symbol_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = symbols.symbols(windows.reassembled(table(spark, sf_dir, "chunks", "file_id", "path", "start_line", "end_line", "raw_body")))
    return written(found.withColumns({
        "name_terms": T.text_terms(F.col("name")), "path_terms": T.terms(T.path_terms(F.col("path"))), "signature_terms": T.text_terms(F.col("raw_signature"))}), "symbols")


@query(_sql_bm25(_DOCS, ["the", "view"], _BODY, "and", "doc_id", "", "doc_id", 10))
def bm25_and_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = bm25.scored(_documents(spark, sf_dir), T.query_phrases("the view"), _BODY)
    return hits.orderBy("score", "doc_id").limit(10).select("doc_id", F.round("score", 6).alias("score"))


@query(_sql_bm25(_DOCS, ["docket", "zzzunheard"], _BODY, "or", "doc_id", "", "doc_id", 20))
def bm25_or_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = bm25.search(_documents(spark, sf_dir), "docket zzzunheard", _BODY, ["doc_id"], 20)
    return hits.select("doc_id", F.round("score", 6).alias("score"))


_CHUNKS = f"""(select id, path, start_line, coalesce({sql_terms("b")}, []::varchar[]) as basename_terms, coalesce({sql_terms("p")}, []::varchar[]) as path_terms, coalesce({sql_terms("r")}, []::varchar[]) as body_terms from (
  select id, path, start_line, {sql_tokens("bn")} as b, {sql_tokens("pn")} as p, {sql_tokens("raw_body")} as r from (
  select id, path, start_line, coalesce(raw_body, '') as raw_body, translate(path, '/.-', '   ') as pn, regexp_replace(regexp_extract(path, '([^/]*)/*$', 1), '^(.*)\\.([^.]*)$', '\\1 \\2') as bn from chunks)))"""


@query(_sql_bm25(_CHUNKS, ["token", "window"], bm25.CHUNK_WEIGHTS, "and", "id, path, start_line", "", "path, start_line, id", 400))
def bm25_weighted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _chunk_index(spark, sf_dir)
    hits = bm25.scored(index, T.query_phrases("token window"), bm25.CHUNK_WEIGHTS)
    return hits.orderBy("score", "path", "start_line", "id").limit(400).select("id", "path", "start_line", F.round("score", 6).alias("score"))


@query()
def bm25_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snake-case query token is a phrase of its pieces."""
    index = _chunk_index(spark, sf_dir)
    hits = bm25.search(index, "merge_token", bm25.CHUNK_WEIGHTS, ["path", "start_line", "id"], 400)
    return hits.select("id", "path", "start_line", F.round("score", 6).alias("score"))


@query(f"with d as {_DOCS} select count(*) as n, round(sum(len(body_terms)) / count(*), 6) as avgdl, count(*) filter (where list_contains(body_terms, 'the')) as df_the, count(*) filter (where list_contains(body_terms, 'bond')) as df_bond from d")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bm25.statistics(_documents(spark, sf_dir), [["the"], ["bond"]], _BODY)
    return s.select("n", F.round("avgdl", 6).alias("avgdl"), F.col("df_0").cast("long").alias("df_the"), F.col("df_1").cast("long").alias("df_bond"))


@query(f"with d as {_DOCS}, e as (select doc_id, unnest(body_terms) as term from d) select term, count(distinct doc_id) as documents, count(*) as occurrences from e group by 1")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of the index: document frequency and occurrences of every term."""
    e = _documents(spark, sf_dir).select("doc_id", F.explode("body_terms").alias("term"))
    return e.groupBy("term", "doc_id").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences"))


# ---- chunks and symbols -----------------------------------------------------------------------------------------------------
def _sql_windows(size: int, overlap: int) -> str:
    return f"""with recursive d as (select doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) as l0 from documents where text <> ''),
n as (select doc_id, case when l0[-1] = '' then l0[1:len(l0) - 1] else l0 end as lines from d),
b as (select doc_id, lines, len(lines) as n, list_filter(range(0, len(lines)), lambda i: regexp_replace(lines[i + 1], '[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', '', 'g') = '') as blanks from n where len(lines) > 0),
w as (select doc_id, lines, n, blanks, 0::bigint as s, {_SQL_END.format(s='0', size=size)} as e from b
  union all select doc_id, lines, n, blanks, s2, {_SQL_END.format(s='s2', size=size)} from (select *, coalesce(list_min(list_filter(blanks, lambda x: x + 1 >= nx and x + 1 < least(nx + {overlap}, e))) + 1, nx) as s2
    from (select *, greatest(e - {overlap}, s + 1) as nx from w where e < n)))
select doc_id, (s + 1)::int as start_line, e::int as end_line, sha256(array_to_string(lines[s + 1:e], chr(10))) as body_sha from w"""


_SQL_END = "(case when {s} + {size} > n then n else coalesce(list_max(list_filter(blanks, lambda x: x >= {s} + {size} // 2 and x < {s} + {size})) + 1, {s} + {size}) end)"


def _windows(spark: SparkSession, sf_dir: str, size: int, overlap: int) -> DataFrame:
    c = chunking.chunks(spread(table(spark, sf_dir, "documents", "doc_id", "text")), "doc_id", "text", size, overlap)
    return c.select("doc_id", "start_line", "end_line", F.sha2("body", 256).alias("body_sha"))


@query(_sql_windows(80, 10))
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, 80, 10)


@query(_sql_windows(8, 2))
def chunk_windows_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, 8, 2)


@query()
def symbol_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbol_index(spark, sf_dir).select("file_id", "path", "name", "kind", "start_line", "end_line", "raw_signature")


def code_search(spark: SparkSession, sf_dir: str, text: str, top_k: int = 10) -> DataFrame:
    """Ranked code search: chunks by the whole query, symbols by its identifier, fused if there are symbol hits."""
    limit = fusion.clamp_top_k(top_k) * fusion.OVERFETCH
    chunk_hits = written(bm25.search(_chunk_index(spark, sf_dir), text, bm25.CHUNK_WEIGHTS, ["path", "start_line"], limit).select(
        "path", "start_line", "end_line", "score", F.col("raw_body").alias("snippet")), "hits")
    name = T.symbol_token(text)
    if name:
        hits = written(bm25.scored(_symbol_index(spark, sf_dir), T.query_phrases(name), bm25.SYMBOL_WEIGHTS).orderBy("score", "path", "start_line").limit(limit).select(
            "path", "start_line", "end_line", "score", F.col("raw_signature").alias("snippet"), "name"), "hits")
        if not hits.isEmpty():
            return fusion.fuse(chunk_hits, hits, name, top_k)
    return fusion.chunk_only(chunk_hits, top_k)


@query()
def search_code_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An identifier query: chunk and symbol hits fused."""
    return code_search(spark, sf_dir, "def merge_token").withColumn("score", F.round("score", 9))


@query()
def search_code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of several words: chunk hits only."""
    return code_search(spark, sf_dir, "scan the batch of one route", 50).withColumn("score", F.round("score", 6))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that the chunks were cut from, as an index takes them."""
    whole = windows.reassembled(table(spark, sf_dir, "chunks", "file_id", "path", "start_line", "end_line", "raw_body"))
    return whole.join(table(spark, sf_dir, "files", F.col("id").alias("file_id"), "mtime"), "file_id", "left").select(
        "path", F.coalesce("mtime", F.lit(0)).alias("mtime"), F.octet_length("content").cast("long").alias("size"), "content", F.sha2("content", 256).alias("content_hash"))


_LINES = """src as (select doc_id, string_agg(line, chr(10) order by n) as text from (select file_id as doc_id, n, any_value(line order by start_line, end_line) as line from (
  select file_id, start_line, end_line, unnest(l) as line, start_line + generate_subscripts(l, 1) - 1 as n from (select *, case when len(l0) = end_line - start_line + 2 and l0[-1] = '' then l0[1:len(l0) - 1] else l0 end as l from (
  select *, string_split_regex(coalesce(raw_body, ''), '\r\n|\n|\r') as l0 from chunks))) group by 1, 2) group by 1)"""


@query(_sql_windows(80, 10).replace("with recursive ", f"with recursive {_LINES}, ").replace("from documents", "from src").rsplit("select doc_id", 1)[0]
       + f", c as (select doc_id, s, {sql_tokens('body')} as t from (select doc_id, s, array_to_string(lines[s + 1:e], chr(10)) as body from w)), x as (select doc_id, s, unnest({sql_terms('t')}) as term from c) select term, count(distinct (doc_id, s)) as documents, count(*) as occurrences from x group by 1")
def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index refresh: an index of an earlier state, brought up to date by analysing only what changed, holds the terms of the files as they are now.

    In the earlier state young files are not there yet, some of the others read otherwise, and there are files that have gone since.
    """
    now = written(source_files(spark, sf_dir), "files")
    turn = F.pmod(F.xxhash64("path"), F.lit(5))
    other = now.withColumn("content", F.when(turn == 0, F.concat(F.lit("earlier words\n"), "content")).otherwise(F.col("content"))).withColumn("content_hash", F.sha2("content", 256))
    earlier = other.where(turn != 1).unionByName(now.where(turn == 2).withColumn("path", F.concat(F.lit("gone/"), "path")))
    at = index.CodeIndex(spark, scratch(spark, "index"), 8)
    at.build(earlier)
    at.build(now)
    return at.vocabulary()


@query()
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build the index of all files and search it for an identifier."""
    at = index.CodeIndex(spark, scratch(spark, "index"), 8)
    at.build(source_files(spark, sf_dir))
    return at.search("def merge_token").withColumn("score", F.round("score", 9))


@query("""with h as (select path, start_line, id, row_number() over (partition by path order by length(raw_body) desc, start_line, id) as k from chunks)
select path, start_line, id from h where k <= 2""")
def per_file_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two chunks of a file, the longest ones."""
    c = table(spark, sf_dir, "chunks", "id", "path", "start_line", "raw_body").select("id", "path", "start_line", F.length("raw_body").alias("n"))
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy(F.desc("n"), "start_line", "id")
    return c.withColumn("k", F.row_number().over(w)).where("k <= 2").select("path", "start_line", "id")


@query(r"""select doc_id, case when length(t) > 400 then substring(t, 1, 400) || '…' else t end as snippet
from (select doc_id, regexp_replace(text, '^[\t\n\v\f\r ]+|[\t\n\v\f\r ]+$', '', 'g') as t from documents)""")
def snippet_400(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", fusion.snippet(F.col("text")).alias("snippet"))
