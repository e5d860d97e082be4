import random

from pyspark.sql import functions as F

from loomstack.operators import episodes as E
from loomstack.operators import evidence as V
from loomstack.operators import ranks as R
from loomstack.operators.sessions import ORDER


def test_ranks_and_sums_of_a_hot_group(spark):
    """One group holds most rows, another is null, orders have nulls; against a walk."""
    rng = random.Random(2)
    rows = [(rng.choice([7] * 8 + [1, 2, None]), rng.choice([None, *range(50)]), i, rng.choice([None, 3, 10])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, a long, id long, v long")
    got = {r.id: r for r in R.ranked(df.withColumn("n", F.lit("clash")), ["g"], ["a", "id"], {"v": F.col("v")}).collect()}
    seen = {}
    for g, a, i, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        n, s = seen.get(g, (0, 0))
        seen[g] = n + 1, s + (v or 0)
        assert (got[i].n, got[i].upto_v) == seen[g]
    assert all((r.of, r.all_v) == seen[r.g] for r in got.values()) and len(got) == 3000
    assert R.ranked(df.where("false"), ["g"], ["a"]).count() == 0


def test_frames_and_budgets_of_a_hot_session(spark):
    rng = random.Random(4)
    rows = [(i, 1 if i % 3 else i % 7, rng.randint(0, 40), 1, i, 0, "error" if i % 11 == 0 else None) for i in range(1, 900)]
    e = spark.createDataFrame(rows, "id long, session_id long, ts long, source_id long, record_ordinal long, part_ordinal long, anchor string")
    order = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3], r[4], r[5], r[0])):
        order.setdefault(r[1], []).append(r[0])
    for before, after in ((0, 0), (3, 5), (2, None)):
        got = {r.event_id: r.frame for r in E.frames(e, before, after).collect()}
        want = {}
        for ids in order.values():
            for k, i in enumerate(ids):
                if i % 11 == 0:
                    want[i] = ids[max(0, k - before):None if after is None else k + after + 1]
        assert got == want
    sizes = {r[0]: r[0] % 90 for r in rows}
    kept = {}
    for r in V.within_budget(e, "session_id", list(ORDER), F.col("id") % 90, 500).collect():
        kept.setdefault(r.session_id, set()).add(r.id)
    for s, ids in order.items():
        total = sum(sizes[i] for i in ids)
        if total <= 500:
            assert kept[s] == set(ids)
            continue
        used, front = 0, []
        for i in ids:
            if used + sizes[i] <= 250 or not front:
                used += sizes[i]
                front.append(i)
            else:
                break
        back = []
        for i in reversed(ids[len(front):]):
            if used + sizes[i] > 500:
                break
            used += sizes[i]
            back.append(i)
        assert kept[s] == {*front, *back}
