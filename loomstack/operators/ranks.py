"""Ranks and running sums within groups of any size.

A window over one group sorts the group in one task, which a group with a third of all rows does not allow. Here rows are range-partitioned
by (group, order), so a large group is spread over many tasks; each task numbers and adds up its own rows of each group, and the few
(task, group) totals, added up in turn, give what comes before. The result is exact for any distribution.

Defined results: nulls of the order come first, as in an ascending sort; a null summand counts as 0; rows that tie in the whole order are
numbered in no particular order; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstack.runtime import written


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([part] * b.num_rows, pa.int32()), *b.columns], ["_part", *b.schema.names])


def ranked(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with ``n`` (place in its group, from 1), ``of`` (rows of the group), and ``upto_x``, ``all_x`` (running and whole sum) for each of ``sums``.

    Added columns replace ones of the same name.
    """
    sums = sums or {}
    added = ["n", "of", *(f"{p}_{x}" for x in sums for p in ("upto", "all"))]
    df = df.drop(*added).withColumns({f"_v_{x}": F.coalesce(c.cast("long"), F.lit(0)) for x, c in sums.items()})
    kinds = ", ".join(["_part int", *(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order).mapInArrow(_parted, kinds), "placed")
    w = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.withColumns({"_n": F.row_number().over(w.rowsBetween(Window.unboundedPreceding, 0)), **{f"_u_{x}": F.sum(f"_v_{x}").over(w) for x in sums}})
    totals = placed.groupBy("_part", *group).agg(F.count("*").alias("_c"), *[F.sum(f"_v_{x}").alias(f"_t_{x}") for x in sums])
    before, whole = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*group)
    zero = F.lit(0).cast("long")
    offsets = totals.select(
        "_part", *group, F.coalesce(F.sum("_c").over(before), zero).alias("_c"), F.sum("_c").over(whole).alias("of"),
        *[F.coalesce(F.sum(f"_t_{x}").over(before), zero).alias(f"_t_{x}") for x in sums], *[F.sum(f"_t_{x}").over(whole).alias(f"all_{x}") for x in sums])
    on = [inside._part == offsets._part, *[inside[g].eqNullSafe(offsets[g]) for g in group]]
    keep = [inside[c] for c in df.columns if not c.startswith("_v_")]
    return inside.join(offsets, on).select(*keep, (inside["_n"] + offsets["_c"]).alias("n"), offsets["of"], *[x for s in sums for x in ((inside[f"_u_{s}"] + offsets[f"_t_{s}"]).alias(f"upto_{s}"), offsets[f"all_{s}"])])
