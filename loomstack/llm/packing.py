"""Problem 9: documents into containers of fixed capacity, with little room left.

Planning works on the histogram of lengths, not on documents: for a capacity of C tokens there are at most C lengths, so the plan is made
on the driver from C counts, however many documents there are. Lengths go from the longest to the shortest; each is put where it
leaves the least room (best fit). Bins that look alike are one group with a multiplicity, so a step places a length into a whole run of
bins at once, as often as it fits. The plan is a list of runs: ranks [start, start + n * each) of a length go to bins first + rank // each.
Kinds of container are planned one after the other. Beyond CELLS tokens of capacity lengths are planned in steps of C / CELLS tokens, rounded up,
so that a plan never has more than CELLS lengths; what that wastes is below one part in CELLS for each document of a container.

Documents then take their slots by joining on (container, length) with their rank within that length. Ranks come from salted
groups (a hot length is no single sort) whose offsets are the running counts of the groups. The plan's size depends on the capacities,
not on the data; it is broadcast up to SENT_RUNS runs, and joined as it comes beyond (that is, for thousands of kinds of container).

A document longer than the capacity is cut into full pieces, each a bin of its own, and a rest that is packed like the others;
nothing else is split. Defined results: null and empty texts have size 0 and take no bin (bin null); containers with a null or
non-positive capacity are ignored; ties are broken by document id.
"""

from __future__ import annotations

import bisect
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstack.llm import tokens
from loomstack.runtime import table, written

#: Lengths of one plan, and runs of all plans that are broadcast.
CELLS, SENT_RUNS = 1 << 16, 1_000_000
SALT_ROWS = 1_000_000


def tokenizer_file(name: str, folder: str | None = None) -> tuple[str, bytes]:
    """(ending, content) of the file of a public tokenizer; a ranks file goes before another form of the same vocabulary."""
    for ending in (".tiktoken", ".json", ".model"):
        at = os.path.join(folder or tokens.TOKENIZERS, name + ending)
        if os.path.exists(at):
            with open(at, "rb") as f:
                return ending, f.read()
    raise ValueError(f"no tokenizer {name!r}")


def counter(name: str, ending: str, content: bytes):
    """Function from texts to their sizes in tokens of a public tokenizer."""
    if ending == ".tiktoken":
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}
        enc = tiktoken.Encoding(name, pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
    if ending == ".json":
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(content.decode())
        tok.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=content)
    return lambda texts: [len(sp.encode(t, num_threads=1)) if t else 0 for t in texts]


def sizes(documents: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, tokenizer, size) of every document for each tokenizer."""
    # Tokenizer files are public and of fixed size, some megabytes at most; the driver reads them, so no executor needs the folder.
    files = documents.sparkSession.sparkContext.broadcast({n: tokenizer_file(n) for n in names})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = {n: counter(n, *files.value[n]) for n in names}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column("text").to_pylist()
                for n in names:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n] * part.num_rows), pa.array(count[n](texts), pa.int64())], ["doc_id", "tokenizer", "size"])

    return documents.select("doc_id", "text").mapInArrow(scan, "doc_id long, tokenizer string, size long")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, start, n, each, first): bins first .. first + n - 1 take ``each`` items of the length, ranks from ``start`` on.

    Best fit, longest first. Open groups of like bins are kept by the room they have left.
    """
    rooms: list[int] = []  # sorted rooms with open groups
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> [(first, n)]
    runs, bins = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                whole, rest = divmod(left, each)
                for n, k in ((whole, each), (1, rest)):
                    if n and k:
                        runs.append((length, rank, n, k, bins))
                        put(capacity - k * length, bins, n)
                        bins, rank = bins + n, rank + n * k
                break
            room = rooms[at]
            first, n = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            each = room // length
            whole = min(n, left // each)
            if whole:
                runs.append((length, rank, whole, each, first))
                put(room - each * length, first, whole)
                rank, left, first, n = rank + whole * each, left - whole * each, first + whole, n - whole
            if n and 0 < left < each:
                runs.append((length, rank, 1, left, first))
                put(room - left * length, first, 1)
                rank, first, n, left = rank + left, first + 1, n - 1, 0
            put(room, first, n)
    return runs


def packed(documents: DataFrame, containers: DataFrame) -> DataFrame:
    """(container, bin, doc_id, piece, size): one row per document, container kind and piece."""
    spark = documents.sparkSession
    kinds = containers.select("container", "tokenizer", "capacity").where("capacity > 0 and container is not null and tokenizer is not null").distinct().orderBy("container").collect()  # settings
    schema = "container string, bin long, doc_id long, piece long, size long"
    if not kinds:
        return spark.createDataFrame([], schema)
    size = written(sizes(documents, sorted({k["tokenizer"] for k in kinds})), "sizes")
    step = {k["container"]: -(-k["capacity"] // CELLS) for k in kinds}
    boxes = spark.createDataFrame([(k["container"], k["tokenizer"], k["capacity"], step[k["container"]]) for k in kinds], "container string, tokenizer string, capacity long, step long")
    fitted = size.join(boxes, "tokenizer")
    pieces = fitted.where("size > 0").select(
        "container", "capacity", "step", "doc_id", F.col("size").alias("all"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(size - 1) div capacity"))).alias("piece")
    ).select("container", "capacity", "step", "doc_id", "piece", F.least(F.col("capacity"), F.col("all") - F.col("piece") * F.col("capacity")).alias("size"))
    # What fills a container by itself has the length of all its steps, even where the capacity is no multiple of them.
    pieces = pieces.withColumn("length", F.least(F.expr("(size + step - 1) div step"), F.expr("capacity div step"))).drop("capacity", "step")
    # Salts bound the rows of one sort; their number follows the rows.
    salts = max(1, -(-size.count() * len(kinds) // SALT_ROWS)) * 4
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = written(pieces.groupBy("container", "length", "salt").agg(F.count("*").alias("n")), "counts")
    totals = written(counts.groupBy("container", "length").agg(F.sum("n").alias("n")), "lengths")
    shape = "container string, length long, start long, n long, each long, first long"
    parts, planned = [], 0
    for k in kinds:  # one histogram and one plan in memory at a time
        rows = totals.where(F.col("container") == k["container"]).select("length", "n").toArrow()  # at most CELLS
        runs = plan(dict(zip(rows["length"].to_pylist(), rows["n"].to_pylist())), k["capacity"] // step[k["container"]])
        if runs:
            columns = [pa.array([k["container"]] * len(runs)), *(pa.array(c, pa.int64()) for c in zip(*runs))]
            parts.append(written(spark.createDataFrame(pa.table(columns, names=["container", "length", "start", "n", "each", "first"])), "runs"))
            planned += len(runs)
    slots = parts[0] if parts else spark.createDataFrame([], shape)
    for p in parts[1:]:
        slots = slots.unionByName(p)
    slots = slots.groupBy("container", "length").agg(F.array_sort(F.collect_list(F.struct("start", "n", "each", "first"))).alias("runs"))
    slots = F.broadcast(slots) if planned <= SENT_RUNS else slots
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("container", "length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select(
        "container", "length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    w = Window.partitionBy("container", "length", "salt").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("rank", F.row_number().over(w) - 1).join(before, ["container", "length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    run = F.filter("runs", lambda r: (F.col("rank") >= r["start"]) & (F.col("rank") < r["start"] + r["n"] * r["each"]))[0]
    placed = ranked.join(slots, ["container", "length"]).withColumn("run", run).select(
        "container", (F.col("run.first") + F.floor((F.col("rank") - F.col("run.start")) / F.col("run.each"))).cast("long").alias("bin"), "doc_id", "piece", "size")
    empty = fitted.where("size = 0").select("container", F.lit(None).cast("long").alias("bin"), "doc_id", F.lit(0).cast("long").alias("piece"), "size")
    return placed.unionByName(empty)


def packed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "containers"))


def fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per container kind: bins used, the least number possible by volume, and the filled share."""
    p = packed_tables(spark, sf_dir).where("bin is not null").groupBy("container", "bin").agg(F.sum("size").alias("used"))
    c = table(spark, sf_dir, "containers", "container", "capacity")
    return p.groupBy("container").agg(F.count("*").alias("bins"), F.sum("used").alias("tokens"), F.max("used").alias("fullest")).join(F.broadcast(c), "container").select(
        "container", "bins", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_bins"), F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 6).alias("filled"))
