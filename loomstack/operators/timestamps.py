"""Problem 2: timestamps in many notations, one instant each.

Parsing is a set of Catalyst expressions (one pass of regular expressions, no Python). A value with a zone or offset of its own is
an instant at once. A value without one is local time on the clock of its log: an as-of join against exploded zone-offset intervals
gives the offset. The intervals are built per (zone, local year) from the time zone database and joined by equality on those two
columns; the interval test then runs inside the joined row over the few intervals of that year. Two matching intervals mean an
ambiguous local time (the first occurrence is taken: the larger offset), none a local time that never was (null), one the offset.

Defined results: null, blank, unparsable and impossible values (month 13, 30 February, hour 24, second 60) give null, so do instants
not after the epoch (zero values), a local time whose zone is unknown, contradicting zones for one log, and abbreviations other
than those of RFC 2822. Digits beyond the microsecond are cut off. Bare numbers are epoch counts whose unit (s, ms, µs, ns) is the one
that puts them between FROM_S and TO_S (2025 to 2027, a property of the data; the functions take other bounds). Local times are resolved from
FIRST_YEAR to LAST_YEAR, outside of which they give null: rules of zones are not known further ahead.

A log without zones that holds a third of all lines is one key of the join with the clocks; the clocks are one small row per log, which the
engine broadcasts where they fit its threshold, and beyond it the join's skew handling splits the log's lines over several tasks.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstack.functions.scalars import stripped
from loomstack.runtime import table

# Month names and the zone names of RFC 2822 with their offsets in minutes.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
NAMED_OFFSETS = {"z": 0, "utc": 0, "gmt": 0, "ut": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420}
ZONE = r"(Z|z|UTC|GMT|UT|[ECMP][SD]T|(?:UTC|GMT)?[+\-−]\d{1,2}:?\d{2}|(?:UTC|GMT)?[+\-−]\d{2})?(?:\s*\[([^\]]*)\])?"
CLOCK = r"(\d{1,2}):?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?\s*([AaPp]\.?[Mm]\.?)?\s*"
ISO = rf"^(\d{{4}})[-/.]?(\d{{2}})[-/.]?(\d{{2}})(?:(?:[Tt]|\s+){CLOCK}{ZONE})?$"
DAY_FIRST = rf"^(?:[A-Za-z]{{3,9}}\.?,?\s+)?(\d{{1,2}})[\s\-]+([A-Za-z]{{3,9}})\.?,?[\s\-]+(\d{{4}}),?\s+{CLOCK}{ZONE}$"
MONTH_FIRST = rf"^(?:[A-Za-z]{{3,9}}\.?,?\s+)?([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+(?:at\s+)?{CLOCK}{ZONE}$"
DOTTED = rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),?\s+{CLOCK}{ZONE}$"
UNIFORM = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"
FROM_S, TO_S = 1735689600, 1830297600  # 2025-01-01 and 2028-01-01
FIRST_YEAR, LAST_YEAR = 1970, 2100


def _int(c: Column) -> Column:
    return c.try_cast("long")


def _thousandth(c: Column) -> Column:
    """Exact integer division by 1000; plain ``/`` would go through a double and lose digits of a nanosecond count."""
    return F.floor((c - F.pmod(c, F.lit(1000))).cast("decimal(20,0)") / 1000).cast("long")


def epoch_number(whole: Column, fraction: Column, from_s: int = FROM_S, to_s: int = TO_S) -> Column:
    """Microseconds of an epoch count in any unit; null outside the bounds, which must lie within a factor of 1000 of each other."""
    def part(n: int) -> Column:
        return _int(F.substring(F.rpad(F.coalesce(fraction, F.lit("")), n, "0"), 1, n))

    def within(unit: int) -> Column:
        return (whole >= from_s * unit) & (whole < to_s * unit)

    return (
        F.when(within(1), whole * 1_000_000 + part(6)).when(within(1000), whole * 1000 + part(3))
        .when(within(1_000_000), whole).when(within(1_000_000_000), _thousandth(whole))
        .cast("long")
    )


def instants(df: DataFrame, value: str, keep: list[str], from_s: int = FROM_S, to_s: int = TO_S) -> DataFrame:
    """Add ``epoch_us``, ``local_us``, ``offset_min``, ``bad_zone``, ``zone`` and ``year`` for the texts of column ``value``.

    ``epoch_us`` is for bare numbers; else ``local_us`` is the wall clock in microseconds since 1970, ``offset_min`` the offset if one
    is written, and ``zone`` a bracketed region.
    """
    shapes = ((ISO, (1, 2, 3)), (DAY_FIRST, (3, 2, 1)), (MONTH_FIRST, (3, 1, 2)), (DOTTED, (3, 2, 1)))  # year, month, day
    d = df.select(*keep, value, stripped(F.col(value)).alias("_t"))
    shape = F.lit(None).cast("int")
    for k in range(len(shapes) - 1, -1, -1):
        shape = F.when(F.col("_t").rlike(shapes[k][0]), F.lit(k)).otherwise(shape)
    d = d.withColumns({"_shape": shape, "_number": F.col("_t").rlike(r"^\d{9,19}(\.\d*)?$")})
    years = tuple(s[1][0] for s in shapes)
    months = tuple(s[1][1] for s in shapes)
    days = tuple(s[1][2] for s in shapes)
    # Each shape is cut once into an array of its groups; later stages only index it.
    groups = F.lit(None).cast("array<string>")
    for k in range(len(shapes) - 1, -1, -1):
        n = 10  # groups 1..3 date, 4..7 clock, 8 am/pm, 9 zone, 10 region
        cut = F.array(*[F.regexp_extract(F.col("_t"), shapes[k][0], g) for g in range(1, n + 1)])
        groups = F.when(F.col("_shape") == k, cut).otherwise(groups)
    d = d.withColumn("_g", groups)

    def at(g: int | tuple[int, ...]) -> Column:
        if isinstance(g, int):
            return F.col("_g")[g - 1]
        out = F.col("_g")[g[0] - 1]
        for k in range(1, len(shapes)):
            out = F.when(F.col("_shape") == k, F.col("_g")[g[k] - 1]).otherwise(out)
        return out

    mtext = F.lower(F.substring(at(months), 1, 3))
    month = F.when(at(months).rlike(r"^\d"), _int(at(months))).otherwise(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), mtext).cast("long"))
    d = d.select(
        *keep, value, "_t", "_number",
        _int(at(years)).alias("y"), month.alias("mo"), _int(at(days)).alias("d"),
        F.coalesce(_int(at(4)), F.lit(0)).alias("h0"), F.coalesce(_int(at(5)), F.lit(0)).alias("mi"), F.coalesce(_int(at(6)), F.lit(0)).alias("s"),
        F.coalesce(_int(F.substring(F.rpad(at(7), 6, "0"), 1, 6)), F.lit(0)).alias("us"),
        F.lower(F.substring(at(8), 1, 1)).alias("half"), F.lower(at(9)).alias("z"), stripped(at(10)).alias("region"),
    )
    noon = F.col("half").isin("a", "p")
    hour = F.when(noon, F.when(F.col("h0").between(1, 12), F.col("h0") % 12 + F.when(F.col("half") == "p", 12).otherwise(0))).when(F.col("h0") < 24, F.col("h0"))
    leap = (F.col("y") % 4 == 0) & ((F.col("y") % 100 != 0) | (F.col("y") % 400 == 0))
    length = F.when(F.col("mo").isin(4, 6, 9, 11), 30).when(F.col("mo") == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    valid = F.col("mo").between(1, 12) & (F.col("d") >= 1) & (F.col("d") <= length) & (F.col("mi") < 60) & (F.col("s") < 60) & (F.col("y") >= 1)
    # Days since 1970 of a civil date, years counted from March.
    y = F.when(F.col("mo") <= 2, F.col("y") - 1).otherwise(F.col("y"))
    era = F.floor(y / 400).cast("long")
    yoe = y - era * 400
    doy = F.expr("(153 * ((mo + 9) % 12) + 2) div 5") + F.col("d") - 1
    day = era * 146097 + yoe * 365 + F.floor(yoe / 4).cast("long") - F.floor(yoe / 100).cast("long") + doy - 719468
    sign = F.when(F.col("z").rlike("[-−]"), -1).otherwise(1)
    digits = F.regexp_replace(F.regexp_extract("z", r"(\d{1,2}:?\d{0,2})$", 1), ":", "")
    hh = _int(F.when(F.length(digits) <= 2, digits).otherwise(F.expr("substring(%s, 1, length(%s) - 2)" % (("regexp_replace(regexp_extract(z, '([0-9]{1,2}:?[0-9]{0,2})$', 1), ':', '')",) * 2))))
    mm = F.coalesce(F.when(F.length(digits) > 2, _int(F.substring(digits, -2, 2))), F.lit(0))
    named = F.lit(None).cast("long")
    for name, minutes in NAMED_OFFSETS.items():
        named = F.when(F.col("z") == name, F.lit(minutes).cast("long")).otherwise(named)
    numeric = F.when((hh <= 18) & (mm < 60), sign * (hh * 60 + mm))
    offset = F.when(F.col("z") == "", None).when(F.col("z").rlike(r"\d"), numeric).otherwise(named)
    whole = _int(F.regexp_extract("_t", r"^(\d+)", 1))
    frac = F.regexp_extract("_t", r"\.(\d*)$", 1)
    return d.select(
        *keep, value,
        F.when(F.col("_number"), epoch_number(whole, frac, from_s, to_s)).alias("epoch_us"),
        F.when(~F.col("_number") & valid, ((day * 24 + hour) * 60 + F.col("mi")) * 60_000_000 + F.col("s") * 1_000_000 + F.col("us")).alias("local_us"),
        offset.cast("long").alias("offset_min"),
        (F.col("z").isNotNull() & (F.col("z") != "") & offset.isNull()).alias("bad_zone"),
        F.when(F.col("region") != "", F.col("region")).alias("zone"),
        F.col("y").alias("year"),
    )


def _intervals(batches: Iterator[pd.DataFrame], first: int, last: int) -> Iterator[pd.DataFrame]:
    import zoneinfo

    epoch = dt.datetime(1970, 1, 1)
    utc = dt.timezone.utc
    for pdf in batches:
        rows = []
        for name in pdf["zone"]:
            try:
                zone = zoneinfo.ZoneInfo(name)
            except Exception:  # noqa: BLE001 - an unknown region has no intervals
                continue

            def offset(second: int) -> int:
                return int((epoch.replace(tzinfo=utc) + dt.timedelta(seconds=second)).astimezone(zone).utcoffset().total_seconds())

            start = int((dt.datetime(first, 1, 1) - epoch).total_seconds()) - 2 * 86400
            stop = int((dt.datetime(last + 1, 1, 1) - epoch).total_seconds()) + 2 * 86400
            spans, since, now, at = [], start, offset(start), start
            while at < stop:
                nxt = min(at + 7 * 86400, stop)
                if offset(nxt) != now:
                    lo, hi = at, nxt
                    while hi - lo > 1:
                        mid = (lo + hi) // 2
                        lo, hi = (mid, hi) if offset(mid) == now else (lo, mid)
                    spans.append((since, hi, now))
                    since, now, nxt = hi, offset(hi), hi
                at = nxt
            spans.append((since, stop, now))
            for a, b, off in spans:
                ya, yb = (epoch + dt.timedelta(seconds=a + off)).year, (epoch + dt.timedelta(seconds=b + off - 1)).year
                rows += [(name, y, (a + off) * 1_000_000, (b + off) * 1_000_000, off) for y in range(max(ya, first), min(yb, last) + 1)]
        yield pd.DataFrame(rows, columns=["zone", "year", "from_us", "to_us", "offset_s"])


def zone_intervals(zones: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """(zone, year, spans) for the distinct regions in ``zones``: the offset intervals that touch that local year.

    Bounded by the time zone database (some 600 regions) times the years, whatever the size of the data.
    """
    rows = zones.where("zone is not null").select("zone").distinct().mapInPandas(
        lambda it: _intervals(it, first, last), "zone string, year long, from_us long, to_us long, offset_s long"
    )
    return rows.groupBy("zone", "year").agg(F.collect_list(F.struct("from_us", "to_us", "offset_s")).alias("spans"))


def resolve_local(df: DataFrame, intervals: DataFrame) -> DataFrame:
    """As-of join of (local_us, year, zone) rows to the intervals; adds ``matches`` and ``zoned_us`` (first occurrence)."""
    hit = F.filter("spans", lambda i: (F.col("local_us") >= i["from_us"]) & (F.col("local_us") < i["to_us"]))
    return (
        df.join(F.broadcast(intervals), ["zone", "year"], "left")
        .withColumn("_hit", hit)
        .withColumn("matches", F.coalesce(F.size("_hit"), F.lit(0)))
        .withColumn("zoned_us", F.col("local_us") - F.array_max(F.transform("_hit", lambda i: i["offset_s"])) * 1_000_000)
        .drop("spans", "_hit")
    )


def log_clock(discovered: DataFrame) -> DataFrame:
    """(logical_id, clock): the one zone of each log; logs with none or with contradicting ones are left out."""
    return (
        discovered.where("clock_zone is not null and logical_id is not null").groupBy("logical_id")
        .agg(F.min("clock_zone").alias("clock"), F.max("clock_zone").alias("_m")).where("clock = _m").drop("_m")
    )


def line_instants(lines: DataFrame, discovered: DataFrame) -> DataFrame:
    """(origin, record_id, timestamp, instant_us, matches) of every log line; null instant where the value denotes none."""
    p = instants(lines, "timestamp", ["origin", "record_id", "logical_id"])
    needs = F.col("local_us").isNotNull() & F.col("offset_min").isNull() & ~F.coalesce("bad_zone", F.lit(False)) & F.col("zone").isNull()
    # Rows that need no clock get a key of their own: they match nothing and spread over all partitions.
    p = p.withColumn("_log", F.when(needs, F.col("logical_id")).otherwise(F.concat(F.lit("\0"), F.col("origin"), F.col("record_id").cast("string"))))
    clock = log_clock(discovered)
    p = p.join(clock.withColumnRenamed("logical_id", "_log"), "_log", "left").withColumn("zone", F.coalesce("zone", "clock"))
    zones = clock.select(F.col("clock").alias("zone"))
    own = lines.select(F.regexp_extract("timestamp", r"\[([^\]]*)\]\s*$", 1).alias("zone")).where("zone <> ''")
    r = resolve_local(p, zone_intervals(zones.unionByName(own)))
    instant = F.coalesce(
        F.col("epoch_us"),
        F.when(~F.coalesce("bad_zone", F.lit(False)), F.coalesce(F.col("local_us") - F.col("offset_min") * 60_000_000, F.when(F.col("offset_min").isNull(), F.col("zoned_us")))),
    )
    return r.select("origin", "record_id", "timestamp", F.when(instant > 0, instant).alias("instant_us"), "matches")


def event_instants(events: DataFrame) -> DataFrame:
    """(origin, record_id, ts, instant_us) of stored events, whose ``ts`` is an epoch count in any unit."""
    ts = F.col("ts").cast("long")
    return events.select(
        F.lit("session_events").alias("origin"), F.col("id").alias("record_id"), "ts", epoch_number(ts, F.lit("")).alias("instant_us")
    )


def timestamp_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("record_id", "logical_id", "timestamp")
    codex, pi = table(spark, sf_dir, "codex", *names), table(spark, sf_dir, "pi", *names)
    return codex.withColumn("origin", F.lit("codex")).unionByName(pi.withColumn("origin", F.lit("pi")))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that denote one instant and are not yet in the uniform form."""
    lines = timestamp_lines(spark, sf_dir).where(~F.coalesce(F.col("timestamp").rlike(UNIFORM), F.lit(False)))
    logs = line_instants(lines, table(spark, sf_dir, "discovered", "logical_id", "clock_zone"))
    events = event_instants(table(spark, sf_dir, "session_events", "id", "ts"))
    foreign = events.where((F.col("ts") < FROM_S * 1000) | (F.col("ts") >= TO_S * 1000))
    cols = ("origin", "record_id", "instant_us")
    return logs.select(*cols).unionByName(foreign.select(*cols)).where("instant_us is not null")
