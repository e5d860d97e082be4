"""Reciprocal rank fusion of chunk and symbol hits, with per-file limits.

Hits of the same file whose line ranges overlap become one entry. Entries interact only within a file, so after the global ranks are
given the fold runs per path, over at most the hits that the searches were limited to.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K, CHUNK_WEIGHT, SYMBOL_WEIGHT, EXACT_BONUS = 60.0, 1.0, 2.0, 1 / 30
TOP_K, MAX_TOP_K, PER_FILE, OVERFETCH, SNIPPET = 10, 50, 2, 40, 400
NEAR_LINES = 10
FUSED = "path string, start_line int, end_line int, score double, snippet string, name string"


def clamp_top_k(k: int) -> int:
    return TOP_K if k <= 0 else min(k, MAX_TOP_K)


def richness(text: str | None) -> tuple[bool, int, int]:
    """Order of texts by what they say: blank ones last, then by lines, then by characters."""
    t = (text or "").strip()
    return bool(t), t.count("\n"), len(t)


class Place:
    """Hits of one place in a file, in the order in which they joined; all else follows from them."""

    def __init__(self, hit):
        self.hits = [hit]

    def symbols(self) -> list:
        return [h for h in self.hits if h.from_symbol]

    def span(self) -> tuple[int, int]:
        """Lines: from the first symbol's definition, if there is one, to the furthest end."""
        anchors = self.symbols()[:1] or self.hits
        return min(h.start_line for h in anchors), max(h.end_line for h in self.hits)

    def text(self) -> str:
        """A chunk's text stands for the place, else its first symbol's; a further symbol's only if it says more. The earliest of the richest."""
        chunk = next((h.snippet for h in self.hits if not h.from_symbol and (h.snippet or "").strip()), None)
        symbols = [h.snippet for h in self.symbols()]
        return max([chunk if chunk is not None else next(iter(symbols), None), *symbols[1:]], key=richness) or ""

    def row(self, path: str) -> tuple:
        first = self.symbols()[:1]
        return (path, *self.span(), sum(h.gain for h in self.hits), self.text(), first[0].name if first else "")


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    places: list[Place] = []
    for hit in pdf.sort_values(["from_symbol", "rank"], kind="stable").itertuples():
        home = next((p for p in places if p.span()[0] <= hit.end_line and hit.start_line <= p.span()[1]), None)
        if home:
            home.hits.append(hit)
        else:
            places.append(Place(hit))
    path = pdf["path"].iloc[0]
    return pd.DataFrame([p.row(path) for p in places], columns=["path", "start_line", "end_line", "score", "snippet", "name"])


def snippet(c):
    """Trimmed, at most 400 characters and an ellipsis."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(F.length(t) > SNIPPET, F.concat(F.substring(t, 1, SNIPPET), F.lit("…"))).otherwise(t)


def fuse(chunk_hits: DataFrame, symbol_hits: DataFrame, query: str, top_k: int = TOP_K, per_file: int = PER_FILE) -> DataFrame:
    """(path, start_line, end_line, score, snippet): best first within ``top_k``.

    Inputs: (path, start_line, end_line, score, snippet), symbol hits with ``name`` too, both already limited. Their scores only rank.
    """
    order = Window.orderBy("score", "path", "start_line")  # over the limited hits
    q = query.strip()
    last = q[max(q.rfind(c) for c in ".:/") + 1:] or q
    c = chunk_hits.select("path", "start_line", "end_line", "snippet", F.lit(None).cast("string").alias("name"), F.lit(False).alias("from_symbol"), F.row_number().over(order).alias("rank"))
    s = symbol_hits.select("path", "start_line", "end_line", "snippet", "name", F.lit(True).alias("from_symbol"), F.row_number().over(order).alias("rank"))
    both = c.unionByName(s).withColumn(
        "gain", F.when(F.col("from_symbol"), SYMBOL_WEIGHT).otherwise(CHUNK_WEIGHT) / (RRF_K + F.col("rank")) + F.when(F.col("from_symbol") & F.col("name").isin(q, last), EXACT_BONUS).otherwise(0.0))
    fused = both.groupBy("path").applyInPandas(_fold, FUSED)
    w = Window.partitionBy("path").orderBy(F.desc("score"), "start_line")
    best = fused.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_file)
    return best.orderBy(F.desc("score"), "path", "start_line").limit(clamp_top_k(top_k)).select("path", "start_line", "end_line", "score", snippet(F.col("snippet")).alias("snippet"))


def _distinct_places(pdf: pd.DataFrame) -> pd.DataFrame:
    kept: list[int] = []
    rows = list(pdf.sort_values(["score", "start_line"], kind="stable").itertuples())
    for k, h in enumerate(rows):
        clash = any(rows[j].start_line <= h.end_line and h.start_line <= rows[j].end_line and abs(rows[j].start_line - h.start_line) < NEAR_LINES for j in kept)
        if not clash and len(kept) < PER_FILE:
            kept.append(k)
    return pdf.sort_values(["score", "start_line"], kind="stable").iloc[kept]


def chunk_only(hits: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """Without symbols: at most two hits of a file, none nearly on top of a better one; scores stay as they are, lower is better."""
    cols = ("path", "start_line", "end_line", "score", "snippet")
    kept = hits.select(*cols).groupBy("path").applyInPandas(_distinct_places, hits.select(*cols).schema)
    return kept.orderBy("score", "path", "start_line").limit(clamp_top_k(top_k)).withColumn("snippet", snippet(F.col("snippet")))
