"""Problem 4: parent-child rows as trees, by peeling, Euler tours and parallel list ranking.

*Numbering.* Nodes are range-partitioned by (scope, id) into blocks and numbered there: block * 2^36 + place in the block. Whatever the ids
are like (negative, sparse, as large as a long can be), the numbers are dense inside a block, positive, and tell the block.

*Peeling.* Taking leaves away until none is left exposes the loops: what stays are the nodes that the parent map, applied as often as there
are nodes, still reaches. Inside a block NumPy squares the map, which takes all rounds at once; links between blocks form a
reduced map over the topmost nodes of the blocks, which is squared in the same way. The nodes on loops are cut from their parents, so that
everything left is a tree, and the trees whose root was cut are those on or below a loop.

*Tours.* Every node gets two arcs, entering and leaving; the successor of an arc is the next one of a depth-first walk (first child, next
sibling, back to the parent). Ranking that list gives each arc its distance to the end of its tour. From the ranks follow, without
any walk from node to node: root (the node whose leaving arc ends the list), depth (the sum of +1 and -1 behind the entering arc),
entry and exit positions, hence number of descendants, and ancestor tests by interval containment.

*List ranking in blocks.* Pointer doubling alone costs a shuffle of all arcs per round. Instead NumPy contracts every chain of arcs inside a
block to one jump to its last arc there. Only arcs whose successor lies in another block remain; they are ranked in one block as long as
they fit, by doubling while they are more, and the results are joined back. A scope that holds a third of all rows is just spread over more blocks.
Children of one parent need no common task either: a hot parent's children are chained in salted groups, and the groups are linked.

Defined results: ids are trimmed and in lower case; rows with a null or blank node id or null scope are left out; of several rows
of a node the one with the lowest id gives the parent; a node whose parent does not exist is a root of depth 0; on a loop or
below one root is '' and depth -1; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstack.functions.scalars import folded
from loomstack.runtime import table, written

#: Nodes that one block may hold; its arrays take some 200 bytes a node. Blocks are planned at a quarter of it, as ranges come from samples.
BLOCK_NODES = 400_000
#: Children of one parent beyond which they are chained in salted groups.
HOT_CHILDREN = 100_000
END = -1
#: A node's number: the block above PLACE bits, the place in the block below.
PLACE = 36
#: Scope of the session tree while it shares the node table with the event trees; 0 in results.
SESSIONS = -(2**62)


def event_links(events: DataFrame) -> DataFrame:
    """(scope_id, node, nid, parent): one row for each event id of a session."""
    rows = events.select(
        F.col("session_id").alias("scope_id"), folded(F.col("native_event_id")).alias("node"), "id",
        F.coalesce(folded(F.col("parent_native_id")), F.lit("")).alias("parent"),
    ).where("node <> '' and scope_id is not null and id is not null")
    return rows.groupBy("scope_id", "node").agg(F.min(F.struct("id", "parent")).alias("s")).select("scope_id", "node", F.col("s.id").alias("nid"), "s.parent")


def session_links(sessions: DataFrame) -> DataFrame:
    """(scope_id 0, node, nid, parent uid) of sessions; a parent is a uid, or a native id of the same agent."""
    s = sessions.select(
        "id", folded(F.col("session_uid")).alias("node"), folded(F.col("agent")).alias("agent"), folded(F.col("native_id")).alias("native"),
        F.coalesce(folded(F.col("parent_session_id")), F.lit("")).alias("p"),
    ).where("node <> '' and id is not null")
    s = s.groupBy("node").agg(F.min(F.struct("id", "agent", "native", "p")).alias("s")).select("node", "s.*")
    native = s.where("native <> ''").groupBy("agent", "native").agg(F.min(F.struct("id", "node")).alias("n")).select(
        "agent", F.col("native").alias("p"), F.col("n.node").alias("by_native"))
    uid = s.select(F.col("node").alias("p")).withColumn("is_uid", F.lit(True))
    return (
        s.join(uid, "p", "left").join(native, ["agent", "p"], "left")
        .select(F.lit(0).cast("long").alias("scope_id"), "node", F.col("id").alias("nid"),
                F.when(F.col("is_uid"), F.col("p")).otherwise(F.coalesce("by_native", F.lit(""))).alias("parent"))
    )


def blocks_for(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-4 * rows // BLOCK_NODES))


def _block(c: str):
    return F.shiftright(c, PLACE).cast("int")


def _by_block(df: DataFrame, blocks: int) -> DataFrame:
    """Rows with a number ``did``, each block one partition."""
    return df.repartitionById(blocks, _block("did"))


def numbered(links: DataFrame, blocks: int) -> DataFrame:
    """``links`` (scope_id, node, nid, parent) with the number ``did`` of each node."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << PLACE
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + b.num_rows)), *b.columns], ["did", *b.schema.names])
            at += b.num_rows

    ordered = links.select("scope_id", "node", "nid", "parent").repartitionByRange(blocks, "scope_id", "nid", "node").sortWithinPartitions("scope_id", "nid", "node")
    return written(ordered.mapInArrow(number, "did long, scope_id long, node string, nid long, parent string"), "nodes")


def with_parents(nodes: DataFrame) -> DataFrame:
    """(did, pid): numbers of the nodes and of their parents; null where a parent does not exist."""
    names = nodes.select("scope_id", F.col("node").alias("parent"), F.col("did").alias("pid"))
    return written(nodes.select("scope_id", "parent", "did").join(names, ["scope_id", "parent"], "left").select("did", "pid"), "parents")


# ---- peeling ----------------------------------------------------------------------------------------------------------------
def _place(sorted_ids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, found) of each id in a sorted array."""
    if not len(sorted_ids):
        return np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    at = np.minimum(np.searchsorted(sorted_ids, ids), len(sorted_ids) - 1)
    return at, sorted_ids[at] == ids


def _tops(ids: np.ndarray, parents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the topmost node above each, still moving) after as many steps along the parents as there are nodes; ``ids`` sorted."""
    at, local = _place(ids, parents)
    jump = np.where(local, at, np.arange(len(ids)))
    for _ in range(len(ids).bit_length()):
        jump = jump[jump]
    return jump, local[jump]


def _whole(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> pa.Table:
    """A whole partition, bounded by BLOCK_NODES."""
    got = list(batches)
    return pa.table({f.name: pa.chunked_array([b.column(f.name) for b in got], f.type) for f in schema})


def _longs(batches: Iterator[pa.RecordBatch], names: str) -> list[np.ndarray]:
    """Columns of a whole partition, null as -1."""
    t = _whole(batches, pa.schema([(n, pa.int64()) for n in names.split()]))
    return [t[n].fill_null(-1).to_numpy().astype(np.int64) for n in names.split()]


PEELED = "did long, top long"


def _peel_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes on loops inside the block (``top`` null), and the topmost node above each node that another block points to, if it has a parent beyond."""
    did, pid, target = _longs(batches, "did pid target")
    wanted = did[target == 1]
    order = np.argsort(did[target < 1], kind="stable")
    did, pid = did[target < 1][order], pid[target < 1][order]
    jump, moving = _tops(did, pid)
    rings = np.unique(jump[moving])
    at, _ = _place(did, wanted)
    on = ~moving[at] & (pid[jump[at]] >= 0) if len(did) else np.zeros(0, bool)
    yield from pa.table({"did": pa.array(np.concatenate([did[rings], wanted[on]])), "top": pa.array(np.concatenate([np.zeros(len(rings), np.int64), did[jump[at[on]]]]), mask=np.arange(len(rings) + on.sum()) < len(rings))}).to_batches(max_chunksize=100_000)


def _peel_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    x, y = _longs(batches, "did y")
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    jump, moving = _tops(x, y)
    yield from pa.table({"did": pa.array(x[np.unique(jump[moving])])}).to_batches(max_chunksize=100_000)


def on_loops(parents: DataFrame, blocks: int) -> DataFrame:
    """(did) of nodes that cut every loop: all nodes of a loop inside a block, the topmost ones of a loop over several blocks."""
    exits = parents.where(_block("did") != _block("pid")).select(F.col("did").alias("x"), F.col("pid").alias("t"))
    rows = parents.withColumn("target", F.lit(0).cast("long")).unionByName(
        exits.select(F.col("t").alias("did")).distinct().select("did", F.lit(None).cast("long").alias("pid"), F.lit(1).cast("long").alias("target")))
    peeled = written(_by_block(rows, blocks).mapInArrow(_peel_block, PEELED), "peeled")
    rings = peeled.where("top is null").select("did")
    tops = peeled.where("top is not null").select(F.col("did").alias("t"), F.col("top").alias("y"))
    if tops.isEmpty():
        return rings
    live = written(exits.join(tops, "t").select(F.col("x").alias("did"), "y"), "exits")
    rest = live.count()
    if rest <= 2 * BLOCK_NODES:  # the same result in one task
        return rings.unionByName(live.coalesce(1).mapInArrow(_peel_rest, "did long"))
    for _ in range(int(rest).bit_length()):
        live = written(live.join(live.select(F.col("did").alias("y"), F.col("y").alias("z")), "y").select("did", F.col("z").alias("y")), "exits")
        if live.isEmpty():
            return rings
    return rings.unionByName(live.select(F.col("y").alias("did")).distinct())


# ---- tours ------------------------------------------------------------------------------------------------------------------
def _siblings(kids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((did, pid, next), (did, first)): the next sibling of each of ``kids`` (did, pid), the first child of each parent."""
    hot = written(kids.groupBy("pid").agg(F.count("*").alias("n")).where(F.col("n") > HOT_CHILDREN).select("pid", F.ceil(F.col("n") / HOT_CHILDREN).alias("salts")), "hot")
    if hot.isEmpty():
        kids = kids.withColumn("next", F.lead("did").over(Window.partitionBy("pid").orderBy("did")))
        return kids, kids.groupBy(F.col("pid").alias("did")).agg(F.min("did").alias("first"))
    kids = kids.join(hot, "pid", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("did"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    w = Window.partitionBy("pid", "salt").orderBy("did")
    kids = written(kids.withColumns({"next": F.lead("did").over(w), "head": F.row_number().over(w) == 1}), "kids")
    g = Window.partitionBy("pid").orderBy("salt")  # one row per salted group
    heads = kids.where("head").select("pid", "salt", "did", F.lead("did").over(g).alias("after"), F.row_number().over(g).alias("k"))
    bridges = heads.where("after is not null").select("pid", "salt", "after")
    kids = kids.join(bridges, ["pid", "salt"], "left").select("did", "pid", F.coalesce("next", "after").alias("next"))
    return kids, heads.where("k = 1").select(F.col("pid").alias("did"), F.col("did").alias("first"))


def _contract(arc: np.ndarray, succ: np.ndarray, cnt: np.ndarray, wgt: np.ndarray):
    """Follow successors inside the block: position of the last arc reached, arcs and weights passed, and arcs entered from outside.

    ``cnt`` and ``wgt`` belong to the step from an arc to its successor.
    """
    n = len(arc)
    order = np.argsort(arc, kind="stable")
    at, local = _place(arc[order], succ)
    pos = order[at] if n else at
    local &= succ >= 0
    entered = np.ones(n, bool)
    entered[pos[local]] = False
    jump = np.where(local, pos, np.arange(n))
    c, w = np.where(local, cnt, 0), np.where(local, wgt, 0)
    for _ in range(n.bit_length()):
        far = jump[jump]
        if np.array_equal(far, jump):
            break
        c, w, jump = c + c[jump], w + w[jump], far
    return jump, c, w, entered


BLOCK = pa.schema([("did", pa.int64()), ("scope_id", pa.int64()), ("nid", pa.int64()), ("node", pa.string()), ("pid", pa.int64()), ("next", pa.int64()), ("first", pa.int64()), ("cut", pa.int64())])
RANKED = "did long, scope_id long, nid long, node string, pid long, cut boolean, root string, " + ", ".join(
    f"{s}_last long, {s}_succ long, {s}_cnt long, {s}_w long, {s}_head boolean" for s in ("in", "out"))
SOLVED = "portal long, end long, cnt long, w long"


def _rank_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block: its nodes (with a name), and rows that tell the parent, the next sibling, the first child or the cut of one of them."""
    b = _whole(batches, BLOCK)
    is_node = b["node"].is_valid().to_numpy()
    nodes, facts = b.filter(pa.array(is_node)).sort_by("did"), b.filter(pa.array(~is_node))
    m = nodes.num_rows
    did = nodes["did"].to_numpy()
    told = {n: facts[n].fill_null(-1).to_numpy() for n in ("did", "pid", "next", "first", "cut")}
    at, _ = _place(did, told["did"])
    known = {}
    for n in ("pid", "next", "first", "cut"):
        known[n] = np.full(m, -1, np.int64)
        given = told[n] >= 0
        known[n][at[given]] = told[n][given]
    pid, nxt, first, cut = known["pid"], known["next"], known["first"], known["cut"] == 1
    enter, leave = did * 2, did * 2 + 1
    arc = np.concatenate([enter, leave])
    up = np.where((pid >= 0) & ~cut, pid * 2 + 1, END)
    succ = np.concatenate([np.where(first >= 0, first * 2, leave), np.where(nxt >= 0, nxt * 2, up)])
    # Leaving an arc behind counts its weight: +1 for an entering one, -1 for a leaving one.
    wgt = np.concatenate([np.ones(m, np.int64), -np.ones(m, np.int64)])
    at, c, w, entered = _contract(arc, succ, np.ones(2 * m, np.int64), wgt)
    last, out = arc[at], succ[at]
    whole = out[:m] == END
    top = np.where(whole, at[:m] % max(m, 1), 0)
    root = nodes["node"].combine_chunks().take(pa.array(top))
    root = pa.compute.if_else(pa.array(whole & ~cut[top]), root, pa.scalar(None, pa.string()))
    cols = {n: nodes[n].combine_chunks() for n in ("did", "scope_id", "nid", "node")} | {"pid": pa.array(pid, mask=pid < 0), "cut": pa.array(cut), "root": root}
    for side, k in (("in", slice(0, m)), ("out", slice(m, 2 * m))):
        cols |= {f"{side}_last": pa.array(last[k]), f"{side}_succ": pa.array(out[k]), f"{side}_cnt": pa.array(c[k]), f"{side}_w": pa.array(w[k]), f"{side}_head": pa.array(entered[k])}
    yield from pa.table(cols).to_batches(max_chunksize=100_000)


def _rank_portals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    portal, jump, cnt, wgt = _longs(batches, "portal jump cnt w")
    at, c, w, _ = _contract(portal, jump, cnt, wgt)
    # An arc whose jump leads out of the set stands before the last arc of the tour: END was replaced by that arc.
    yield from pa.table({"portal": pa.array(portal), "end": pa.array(jump[at]), "cnt": pa.array(c + cnt[at]), "w": pa.array(w + wgt[at])}).to_batches(max_chunksize=100_000)


def _solve(links: DataFrame) -> DataFrame:
    """Rank the reduced list of steps between blocks.

    ``links``: (portal, jump, cnt, w, ends), one row per portal, ``ends`` telling that the jump is the end of a tour. Result SOLVED. While
    the portals are many, rounds of doubling halve every distance; as soon as they fit one block they are contracted there.
    """
    total = links.count()
    if total <= 2 * BLOCK_NODES:  # the same result in one task
        return links.select("portal", "jump", "cnt", "w").coalesce(1).mapInArrow(_rank_portals, SOLVED)
    done = links.where("ends").select("portal", F.col("jump").alias("end"), "cnt", "w")
    live = links.where("not ends").select("portal", "jump", "cnt", "w")
    while not live.isEmpty():
        ends = done.select(F.col("portal").alias("jump"), "end", F.col("cnt").alias("c2"), F.col("w").alias("w2"))
        hops = live.select(F.col("portal").alias("jump"), F.col("jump").alias("far"), F.col("cnt").alias("c3"), F.col("w").alias("w3"))
        step = written(live.join(ends, "jump", "left").join(hops, "jump", "left").select(
            "portal", "end", F.coalesce("far", "jump").alias("jump"),
            (F.col("cnt") + F.coalesce("c2", "c3", F.lit(0))).alias("cnt"), (F.col("w") + F.coalesce("w2", "w3", F.lit(0))).alias("w")), "ranks")
        done = done.unionByName(step.where("end is not null").select("portal", "end", "cnt", "w"))
        live = step.where("end is null").select("portal", "jump", "cnt", "w")
    return done


def tours(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(scope_id, node, nid, did, pid, root_did, root, depth, entry, exit, descendants) of every node; ``pid`` is the number of the parent.

    ``entry`` and ``exit`` are positions counted back from the end of the tour, negated: within one root, u is an ancestor of v if and
    only if u.entry < v.entry and v.exit < u.exit. On a loop or below one: root '', depth -1, no root_did and no positions. ``rows`` is an
    upper bound of the number of links where it is known without counting them.
    """
    spark = links.sparkSession
    blocks = blocks_for(spark, links.count() if rows is None else rows)
    nodes = numbered(links, blocks)
    parents = with_parents(nodes)
    cut = on_loops(parents, blocks)
    linked = parents.where("pid is not null")
    kids, firsts = _siblings(linked.join(cut, "did", "left_anti"))
    null = F.lit(None).cast("long")
    one = lambda df, **given: df.select("did", *[given.get(n, null).alias(n) if n != "node" else F.lit(None).cast("string").alias(n) for n in BLOCK.names[1:]])
    told = one(kids, pid=F.col("pid"), next=F.col("next")).unionByName(one(firsts, first=F.col("first"))).unionByName(
        one(linked.join(cut, "did", "left_semi"), pid=F.col("pid"), cut=F.lit(1).cast("long")))
    named = nodes.select("did", "scope_id", "nid", "node", *[null.alias(n) for n in ("pid", "next", "first", "cut")])
    ranked = written(_by_block(named.unionByName(told), blocks).mapInArrow(_rank_block, RANKED), "arcs")
    steps, heads = [], []
    for k, s in enumerate(("in", "out")):
        arc = F.col("did") * 2 + k
        steps.append(ranked.where((F.col(f"{s}_last") == arc) & (F.col(f"{s}_succ") >= 0)).select(
            arc.alias("portal"), F.col(f"{s}_succ").alias("arc"), F.lit(1 - 2 * k).cast("long").alias("step_w")))
        heads.append(ranked.where(F.col(f"{s}_head")).select(
            arc.alias("arc"), F.col(f"{s}_last").alias("jump"), F.col(f"{s}_succ").alias("succ"), F.col(f"{s}_cnt").alias("c"), F.col(f"{s}_w").alias("v")))
    # From a portal to its outer successor, then on to the last arc of that block.
    reduced = written(steps[0].unionByName(steps[1]).join(heads[0].unionByName(heads[1]), "arc").select(
        "portal", "jump", (F.col("c") + 1).alias("cnt"), (F.col("v") + F.col("step_w")).alias("w"), (F.col("succ") == END).alias("ends")), "portals")
    solved = written(_solve(reduced), "solved")

    def placed(d: DataFrame) -> DataFrame:
        ok = F.col("root").isNotNull()
        return d.select(
            "scope_id", "node", "nid", "did", "pid", F.when(ok, F.shiftright("in_end", 1)).alias("root_did"), F.coalesce("root", F.lit("")).alias("root"),
            # The tour from an arc to the last one, which leaves the root, rises once less than it falls for every ancestor.
            F.when(ok, 1 - (F.col("in_w") + F.col("in_v"))).otherwise(F.lit(-1)).cast("long").alias("depth"),
            F.when(ok, -(F.col("in_cnt") + F.col("in_c"))).alias("entry"), F.when(ok, -(F.col("out_cnt") + F.col("out_c"))).alias("exit"),
        ).withColumn("descendants", F.expr("(exit - entry - 1) div 2"))

    zero = F.lit(0).cast("long")
    inner = (F.col("in_succ") < 0) & (F.col("out_succ") < 0)
    within = placed(ranked.where(inner).withColumns({"in_end": F.col("in_last"), "in_c": zero, "in_v": zero, "out_c": zero}))
    across = ranked.where(~inner).drop("root")
    for s in ("in", "out"):
        across = across.join(solved.select(F.col("portal").alias(f"{s}_last"), F.col("end").alias(f"{s}_far"), F.col("cnt").alias(f"{s}_c"), F.col("w").alias(f"{s}_v")), f"{s}_last", "left")
    across = across.withColumns({
        "in_end": F.when(F.col("in_succ") == END, F.col("in_last")).otherwise(F.col("in_far")),
        **{f"{s}_{x}": F.coalesce(f"{s}_{x}", zero) for s in ("in", "out") for x in ("c", "v")}})
    roots = ranked.where("pid is null").select((F.col("did") * 2 + 1).alias("in_end"), F.col("node").alias("root"))
    return within.unionByName(placed(across.join(roots, "in_end", "left")))


def ancestors(t: DataFrame, of: DataFrame) -> DataFrame:
    """(did, ancestor_did, ancestor, level) for the stated query nodes ``of`` (did), from the intervals.

    The join is by root; its output is what is asked for, the ancestors of the stated nodes.
    """
    q = of.select("did").join(t.select("did", "root_did", "entry", "exit"), "did")
    a = t.select("root_did", F.col("did").alias("ancestor_did"), F.col("node").alias("ancestor"), F.col("depth").alias("level"), F.col("entry").alias("e0"), F.col("exit").alias("x0"), "descendants")
    return q.join(a.where("descendants > 0"), "root_did").where("e0 < entry and exit < x0").select("did", "ancestor_did", "ancestor", "level")


NAMED = pa.schema([("did", pa.int64()), ("pid", pa.int64()), ("node", pa.string())])


def paths(t: DataFrame, sep: str = "/") -> DataFrame:
    """(did, path): names from the root down to each node that is not on a loop or below one.

    Joining ancestors by interval would meet all pairs of a tree before it filters. Names are put together inside the blocks of the ranking
    first; where a path leaves its block, the parts are put together by doubling, which takes the logarithm of the most parts as rounds.
    """
    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = _whole(batches, NAMED)
        dids, pids, names = (b[n].to_pylist() for n in NAMED.names)
        at = {n: k for k, n in enumerate(dids)}
        for i in range(0, len(dids), 10_000):
            ups, found = [], []
            for k in range(i, min(i + 10_000, len(dids))):
                parts, up = [names[k]], pids[k]
                while up is not None and (above := at.get(up)) is not None:
                    parts.append(names[above])
                    up = pids[above]
                ups.append(up)
                found.append(sep.join(reversed(parts)))
            yield pa.RecordBatch.from_arrays([pa.array(dids[i:i + 10_000], pa.int64()), pa.array(ups, pa.int64()), pa.array(found, pa.string())], ["did", "up", "path"])

    nodes = t.where("depth >= 0").select("did", "pid", "node")
    top = t.agg(F.max(_block("did"))).first()[0]
    state = written(_by_block(nodes, (top or 0) + 1).mapInArrow(within, "did long, up long, path string"), "paths")
    done, live = state.where("up is null"), state.where("up is not null")
    while not live.isEmpty():
        above = done.unionByName(live).select(F.col("did").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        step = written(live.join(above, "up").select("did", F.col("_up").alias("up"), F.concat_ws(sep, "_path", "path").alias("path")), "paths")
        done, live = done.unionByName(step.where("up is null")), step.where("up is not null")
    return done.select("did", "path")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "session_events", "id", "session_id", "native_event_id", "parent_native_id")


def all_tours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tours of the event trees and the session tree in one node table; the latter under the scope SESSIONS."""
    events, sessions = _events(spark, sf_dir), table(spark, sf_dir, "sessions", "id", "session_uid", "agent", "native_id", "parent_session_id")
    links = event_links(events).unionByName(session_links(sessions).withColumn("scope_id", F.lit(SESSIONS)))
    return tours(links, events.count() + sessions.count())  # both counts come from the files' footers


def scope_of_result():
    return F.when(F.col("scope_id") == SESSIONS, 0).otherwise(F.col("scope_id")).cast("long").alias("scope_id")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each node whose parent exists."""
    return all_tours(spark, sf_dir).where("pid is not null").select(scope_of_result(), "node", "root", "depth")
