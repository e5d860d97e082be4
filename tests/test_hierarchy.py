import random

import pytest

from loomstack.operators import hierarchy as H

LINKS = "scope_id long, node string, nid long, parent string"


def brute(links):
    """(root, depth) by walking; ('', -1) on or below a loop."""
    parent = {(s, n): (s, p) if any(x[0] == s and x[1] == p for x in links) else None for s, n, _, p in links}
    out = {}
    for key in parent:
        seen, at, d = set(), key, 0
        while at is not None and at not in seen:
            seen.add(at)
            nxt = parent[at]
            if nxt is None:
                break
            at, d = nxt, d + 1
        out[key] = (at[1], d) if parent[at] is None else ("", -1)
    return out


def run(spark, links, extra=False):
    df = spark.createDataFrame(links, LINKS)
    return {(r.scope_id, r.node): r for r in H.tours(df.selectExpr("*", "1 as depth", "2 as root") if extra else df).collect()}


@pytest.mark.parametrize("block,hot", [(400_000, 100_000), (7, 3)])
def test_random_forests_with_loops(spark, monkeypatch, block, hot):
    monkeypatch.setattr(H, "BLOCK_NODES", block)
    monkeypatch.setattr(H, "HOT_CHILDREN", hot)
    rng = random.Random(5)
    links, nid = [], 0
    for scope in (1, 2, 9):
        names = [f"n{i}" for i in range(60)]
        for i, n in enumerate(names):
            p = rng.choice(["", "absent", rng.choice(names[:i] or [""]), names[max(0, i - 1)], "n0"])
            nid += rng.randint(1, 4)
            links.append((scope, n, nid, p))
    links += [(3, "a", 9001, "c"), (3, "b", 9002, "a"), (3, "c", 9003, "b"), (3, "below", 9004, "b"), (3, "self", 9005, "self"), (3, "lone", 9006, "")]
    got, want = run(spark, links, extra=True), brute(links)
    assert {k: (r.root, r.depth) for k, r in got.items()} == want
    for (s, n), r in got.items():  # intervals tell descendants
        if r.depth >= 0:
            below = sum(1 for (s2, _), x in got.items() if s2 == s and x.root_did == r.root_did and x.entry > r.entry and x.exit < r.exit)
            assert below == r.descendants


def test_deep_chain_and_wide_parent(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_NODES", 300)
    monkeypatch.setattr(H, "HOT_CHILDREN", 100)
    chain = [(1, f"c{i}", i + 1, f"c{i - 1}" if i else "") for i in range(3000)]
    wide = [(2, "hub", 5000, "")] + [(2, f"w{i}", 5001 + i, "hub") for i in range(1500)]
    got = run(spark, chain + wide)
    assert all(got[(1, f"c{i}")].depth == i for i in range(3000)) and got[(1, "c0")].descendants == 2999
    assert got[(2, "hub")].descendants == 1500 and all(got[(2, f"w{i}")].depth == 1 for i in range(1500))


def test_paths_and_ancestors(spark):
    t = H.tours(spark.createDataFrame([(0, "r", 1, ""), (0, "a", 2, "r"), (0, "b", 3, "a"), (0, "x", 4, "x")], LINKS))
    assert {r.nid: r.path for r in H.paths(t).join(t, "did").collect()} == {1: "r", 2: "r/a", 3: "r/a/b"}
    assert sorted(r.ancestor for r in H.ancestors(t, t.where("nid = 3").select("did")).collect()) == ["a", "r"]


def test_links_fold_ids_and_take_the_lowest_row(spark):
    e = spark.createDataFrame([(5, 1, " B\n", "a"), (3, 1, "b", "Z"), (1, 1, "A", None), (7, 1, None, "a"), (8, 1, " ", "a"), (9, None, "q", "a"), (3, 1, "b", "Z")], "id long, session_id long, native_event_id string, parent_native_id string")
    assert {(r.node, r.nid, r.parent) for r in H.event_links(e).collect()} == {("b", 3, "z"), ("a", 1, "")}
    assert H.tours(H.event_links(e.where("false"))).count() == 0


def test_session_parent_by_uid_or_native_id(spark):
    s = spark.createDataFrame([(1, "pi:A", "pi", "A", ""), (2, "pi:b", "pi", "b", " a "), (3, "cx:c", "cx", "c", "PI:a"), (4, "cx:d", "cx", "d", "a"), (5, "cx:e", None, None, None)],
                              "id long, session_uid string, agent string, native_id string, parent_session_id string")
    assert {(r.node, r.parent) for r in H.session_links(s).collect()} == {("pi:a", ""), ("pi:b", "pi:a"), ("cx:c", "pi:a"), ("cx:d", ""), ("cx:e", "")}


def test_paths_of_events_and_sessions(spark, sf):
    import duckdb

    from loomstack.plans import training

    con = duckdb.connect()
    for name in ("session_events", "sessions"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    got = sorted(tuple(r) for r in training.QUERIES["p4_paths"](spark, sf).collect())
    assert len({r[0] for r in got}) > 1 and any(r[5].count(">") > 1 for r in got if r[0])
    assert got == sorted(con.execute(training.SQL["p4_paths"]).fetchall())


def test_paths_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_NODES", 7)
    rng = random.Random(8)
    links = [(s, f"n{s}.{i}", 1000 * s + i, f"n{s}.{rng.randrange(max(0, i - 3), i)}" if i else "") for s in (1, 2) for i in range(80)]
    parent = {n: p for _, n, _, p in links}
    want = {}
    for _, n, nid, _ in links:
        parts = [n]
        while parent[parts[0]]:
            parts.insert(0, parent[parts[0]])
        want[nid] = ">".join(parts)
    t = H.tours(spark.createDataFrame(links, LINKS))
    assert {r.nid: r.path for r in H.paths(t, ">").join(t, "did").collect()} == want


@pytest.mark.parametrize("ids", [(-5, -7, 9), (2**63 - 1, -(2**63), 0), (0, 0, 0)])
def test_any_ids(spark, ids):
    links = [(-4, "r", ids[0], ""), (-4, "k", ids[1], "r"), (-4, "m", ids[2], "k"), (2**62, "s", ids[0], "t"), (2**62, "t", ids[1], "s")]
    assert {k: (r.root, r.depth) for k, r in run(spark, links).items()} == brute(links)


@pytest.mark.parametrize("block,one_task", [(7, True), (7, False), (400_000, True)])
def test_loops_over_many_blocks(spark, monkeypatch, block, one_task):
    """Rings longer than a block, with trees below them, by one task or by squaring; next to trees that cross blocks without a loop."""
    monkeypatch.setattr(H, "BLOCK_NODES", block)
    if not one_task:
        monkeypatch.setattr(H, "blocks_for", lambda spark, rows: 40)
        monkeypatch.setattr(H, "BLOCK_NODES", 1)
    rng = random.Random(3)
    links = [(1, f"ring{i}", 10 * i, f"ring{(i + 1) % 50}") for i in range(50)] + [(1, f"below{i}", 10 * i + 5, rng.choice([f"ring{i}", f"below{max(i - 1, 0)}"]) if i else "ring0") for i in range(50)]
    links += [(2, f"t{i}", -i, f"t{rng.randrange(i)}" if i else "gone") for i in range(60)] + [(3, "x", 1, "y"), (3, "y", 10_000, "x"), (3, "z", 5000, "z")]
    rng.shuffle(links)
    assert {k: (r.root, r.depth) for k, r in run(spark, links).items()} == brute(links)
