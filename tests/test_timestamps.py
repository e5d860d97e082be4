import pytest

from loomstack.operators import timestamps as TS

CASES = [
    ("2026-07-22T04:37:26.639990", "Europe/Berlin", "2026-07-22T02:37:26.639990"),
    ("2026-03-15 01:29", "UTC", "2026-03-15T01:29:00"),
    ("2026-11-09T23:34:25.580+09:00", None, "2026-11-09T14:34:25.580"),
    ("2026-11-18 03:19:07+0530", None, "2026-11-17T21:49:07"),
    ("Fri, 30 Oct 2026 17:15:09 -0400", None, "2026-10-30T21:15:09"),
    ("Wed, 1 Apr 2026 17:52:09 GMT", None, "2026-04-01T17:52:09"),
    ("May 22, 2026 11:46:42 pm -04:00", None, "2026-05-23T03:46:42"),
    ("Feb 5, 2026 12:31:54 AM UTC", None, "2026-02-05T00:31:54"),
    ("12.06.2026 02:07:09", "Asia/Tokyo", "2026-06-11T17:07:09"),
    ("2026-03-17T20:58:47+11:00[Australia/Sydney]", None, "2026-03-17T09:58:47"),
    ("2026-06-01T10:00:00[Europe/Paris]", None, "2026-06-01T08:00:00"),
    ("20260117T072437Z", None, "2026-01-17T07:24:37"),
    (" 2026-01-12 07:15:25 UTC", None, "2026-01-12T07:15:25"),
    ("2026-03-23T23:01:32,643Z", None, "2026-03-23T23:01:32.643"),
    ("1774746365.378", None, "2026-03-29T01:06:05.378"),
    ("1781223051861", None, "2026-06-12T00:10:51.861"),
    ("1774738609340436", None, "2026-03-28T22:56:49.340436"),
    ("1770487768662097899", None, "2026-02-07T18:09:28.662097"),
    ("2026-04-07T14:49:18.810943626Z", None, "2026-04-07T14:49:18.810943"),
    ("2026-10-25 02:30:00", "Europe/Berlin", "2026-10-25T00:30:00"),  # twice: the first
    ("2026-03-29 02:30:00", "Europe/Berlin", None),  # never
    ("2026-07-22T04:37:26", None, None), ("2026-13-04 09:00:00", "UTC", None), ("2026-02-30 09:00:00", "UTC", None), ("2026-01-01 24:00:00", "UTC", None), ("0000-00-00T00:00:00Z", None, None),
    ("0", "UTC", None), ("9999999999", "UTC", None), ("yesterday", "UTC", None), ("", "UTC", None), (None, "UTC", None), ("1970-01-01T00:00:00Z", None, None), ("x" * 50_000, "UTC", None),
    ("2026-01-05 10:00:00 XYZ", "UTC", None), ("13:00 pm", "UTC", None), ("Feb 5, 2026 13:31:54 PM UTC", None, None),
]


def test_every_notation(spark):
    lines = spark.createDataFrame([("o", i, f"log{i}", t, 7) for i, (t, _, _) in enumerate(CASES)], "origin string, record_id long, logical_id string, timestamp string, year int")
    clocks = spark.createDataFrame([(f"log{i}", z) for i, (_, z, _) in enumerate(CASES) for _ in range(2)], "logical_id string, clock_zone string")
    got = {r.record_id: r.instant_us for r in TS.line_instants(lines, clocks).collect()}
    want = dict(spark.createDataFrame([(i, w) for i, (_, _, w) in enumerate(CASES)], "i long, w string").selectExpr("i", "unix_micros(cast(w as timestamp)) u").collect())
    assert {CASES[i][0]: got[i] for i in want} == {CASES[i][0]: want[i] for i in want}


def test_contradicting_zones_and_empty_tables(spark):
    lines = spark.createDataFrame([("o", 1, "a", "2026-01-01 00:00:00")], "origin string, record_id long, logical_id string, timestamp string")
    clocks = spark.createDataFrame([("a", "UTC"), ("a", "Asia/Tokyo"), (None, "UTC")], "logical_id string, clock_zone string")
    assert TS.line_instants(lines, clocks).collect()[0].instant_us is None
    assert TS.line_instants(lines, clocks.where("false")).collect()[0].instant_us is None
    assert TS.line_instants(lines.where("false"), clocks).count() == 0


@pytest.mark.parametrize("zone,local,matches", [("Europe/Berlin", "2026-10-25 02:30:00", 2), ("Europe/Berlin", "2026-03-29 02:30:00", 0), ("Asia/Kolkata", "2026-03-29 02:30:00", 1), ("No/Where", "2026-01-01 00:00:00", 0)])
def test_interval_matches(spark, zone, local, matches):
    df = spark.createDataFrame([(zone, local)], "zone string, l string").selectExpr("zone", "unix_micros(cast(l as timestamp)) local_us", "cast(year(l) as long) year")
    assert TS.resolve_local(df, TS.zone_intervals(df.select("zone"), 2025, 2027)).collect()[0].matches == matches


def test_event_counts(spark):
    e = spark.createDataFrame([(1, 0), (2, 1793514279), (3, 1768212017065980), (4, 1770487768662097899), (5, -5), (6, None), (7, 1767627302624)], "id long, ts long")
    got = {r.record_id: r.instant_us for r in TS.event_instants(e).collect()}
    assert got == {1: None, 2: 1793514279000000, 3: 1768212017065980, 4: 1770487768662097, 5: None, 6: None, 7: 1767627302624000}
