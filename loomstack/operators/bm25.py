"""Ranked retrieval: column-weighted BM25 over token arrays.

An index is a DataFrame with an id and one term array (stage 2) per field. Scores follow the full-text engine's documented formula: term
frequencies weighted by field, document length over all fields, idf clamped at a small positive value, statistics over the whole
index whatever is filtered later. One aggregation gives all statistics (a single row, so its broadcast is constant in size); scoring is
an expression, and the top k never sorts more than k rows per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstack.functions import text as T

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Field weights of the three indexes.
CHUNK_WEIGHTS = {"basename_terms": 20.0, "path_terms": 8.0, "body_terms": 1.0}
SYMBOL_WEIGHTS = {"name_terms": 30.0, "path_terms": 6.0, "signature_terms": 2.0}
EVENT_WEIGHTS = {"body_terms": 1.0, "command_terms": 5.0, "file_terms": 2.0}


def chunk_index(chunks: DataFrame, body: str = "raw_body", path: str = "path") -> DataFrame:
    """Add the three term fields of the chunk index."""
    return chunks.withColumns({
        "basename_terms": T.terms(T.basename_terms(F.col(path))), "path_terms": T.terms(T.path_terms(F.col(path))), "body_terms": T.text_terms(F.col(body))})


def occurrences(terms: Column, phrase: list[str]) -> Column:
    """How often a phrase stands in a term array."""
    n = len(phrase)
    if n == 1:
        return F.size(F.filter(terms, lambda t: t == phrase[0]))
    want = F.array(*[F.lit(p) for p in phrase])
    starts = F.sequence(F.lit(1), F.greatest(F.size(terms) - n + 1, F.lit(1)))
    count = F.size(F.filter(starts, lambda i: F.slice(terms, i, n) == want))
    return F.when(F.array_contains(terms, phrase[0]) & (F.size(terms) >= n), count).otherwise(0)


def statistics(index: DataFrame, phrases: list[list[str]], weights: dict[str, float]) -> DataFrame:
    """One row: rows n, mean length avgdl, and df_i of each phrase."""
    length = reduce(lambda a, b: a + b, [F.size(f) for f in weights])
    df = [F.sum(F.when(reduce(lambda a, b: a | b, [occurrences(F.col(f), p) > 0 for f in weights]), 1).otherwise(0)).alias(f"df_{i}") for i, p in enumerate(phrases)]
    return index.agg(F.count("*").alias("n"), (F.sum(length) / F.count("*")).alias("avgdl"), *df)


def scored(index: DataFrame, phrases: list[list[str]], weights: dict[str, float], mode: str = "and") -> DataFrame:
    """Matching rows of ``index`` with ``score``; lower is better, as the full-text engine has it. An empty phrase matches nothing."""
    if not phrases or mode == "and" and any(not p for p in phrases):
        return index.withColumn("score", F.lit(0.0)).where("false")
    phrases = [p for p in phrases if p]
    tf = [reduce(lambda a, b: a + b, [occurrences(F.col(f), p) * w for f, w in weights.items()]).alias(f"tf_{i}") for i, p in enumerate(phrases)]
    length = reduce(lambda a, b: a + b, [F.size(f) for f in weights]).alias("len")
    rows = index.select("*", *tf, length)
    rows = rows.where(_matches(len(phrases), mode)).crossJoin(F.broadcast(statistics(index, phrases, weights)))  # one row
    return with_score(rows, len(phrases), mode)


def _matches(phrases: int, mode: str) -> Column:
    return reduce((lambda a, b: a & b) if mode == "and" else (lambda a, b: a | b), [F.col(f"tf_{i}") > 0 for i in range(phrases)])


def with_score(rows: DataFrame, phrases: int, mode: str) -> DataFrame:
    """``score`` of rows with tf_i, len, and the statistics df_i, n, avgdl, which are dropped; rows that do not match are left out."""
    parts = []
    for i in range(phrases):
        idf = F.greatest(F.log((F.col("n") - F.col(f"df_{i}") + 0.5) / (F.col(f"df_{i}") + 0.5)), F.lit(LEAST_IDF))
        t = F.col(f"tf_{i}")
        parts.append(idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("len") / F.col("avgdl"))))
    drop = [f"tf_{i}" for i in range(phrases)] + [f"df_{i}" for i in range(phrases)] + ["len", "n", "avgdl"]
    return rows.where(_matches(phrases, mode)).withColumn("score", -reduce(lambda a, b: a + b, parts)).drop(*drop)


def search(index: DataFrame, query: str, weights: dict[str, float], order: list[str], limit: int) -> DataFrame:
    """AND search with the OR fallback: only if nothing matched, the query is no identifier, and it has more than one token."""
    phrases = T.query_phrases(query)
    hits = scored(index, phrases, weights).orderBy("score", *order).limit(limit)
    if len(phrases) > 1 and T.symbol_token(query) is None and hits.isEmpty():
        hits = scored(index, phrases, weights, "or").orderBy("score", *order).limit(limit)
    return hits
