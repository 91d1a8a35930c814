"""Closures, components, levels and rings over edge tables.

Large graphs go by rounds: each joins only what the last round found new, and what is known
stays in written tables in the shared folder that ``spark.checkpoint.dir`` names, so a lost
executor costs one round and plans do not grow. Closures double the length of their paths in
each round. Levels and rings contract chains: nodes with a single need are passed over by pointers
that double in each round, so a chain costs the logarithm of its length; what has no chain left is
peeled, or coloured, never made from all pairs. A graph, or what rounds have left of one, of at
most ``LOCAL_EDGES`` edges (counted first) is finished in one task, by arrays. Rounds end when
nothing is new, so cycles end too.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

LOCAL_EDGES = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stratalens-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows as a table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _unbroadcast(spark: SparkSession):
    """Joins planned within go by shuffles: what rounds broadcast adds up on the driver."""
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = [spark.conf.get(k, None) for k in keys]
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        yield
    finally:
        for k, v in zip(keys, before):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _is_small(edges: DataFrame) -> bool:
    return edges.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES


def _in_one_task(edges: DataFrame, solve, columns: list[str], weight: str | None = None, **more: DataFrame) -> DataFrame:
    """``solve(codes of src, codes of dst, number of nodes, codes of each of more)`` -> columns of codes or numbers.

    Edges (src, dst) and node tables (node) of a checked size; nodes are numbered in their order.
    With ``weight``, that column of the edges and the column ``base`` of nodes are given too.
    """
    rows = edges.select(F.lit("").alias("kind"), "src", "dst", F.col(weight).cast("long").alias("w") if weight else F.lit(0).cast("long").alias("w"))
    for name, df in more.items():
        rows = rows.union(df.select(F.lit(name), "node", "node", F.col("base") if weight else F.lit(0).cast("long")))
    schema = T.StructType([T.StructField(c, T.IntegerType() if c == "level" else rows.schema["src"].dataType) for c in columns])
    tables = list(more)

    def run(batches):
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        kind = np.array(table.column("kind").to_pylist(), object)
        both = pa.chunked_array([*table.column("src").chunks, *table.column("dst").chunks])
        names = pc.unique(both)
        names = names.take(pc.sort_indices(names))
        codes = pc.index_in(both.combine_chunks(), value_set=names).to_numpy().astype(np.int64)
        src, dst = codes[: len(kind)], codes[len(kind) :]
        given = {n: src[kind == n] for n in tables}
        if weight:
            w = table.column("w").to_numpy()
            given |= {"weights": w[kind == ""], "bases": w[kind != ""]}
        out = solve(src[kind == ""], dst[kind == ""], len(names), **given)
        yield pa.RecordBatch.from_arrays([pa.array(x) if c == "level" else names.take(pa.array(x)) for c, x in zip(columns, out)], names=columns)

    return rows.repartition(1).mapInArrow(run, schema)


def _neighbours(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to): the ends of node i's edges are to[from[i]:from[i + 1]]."""
    order = np.argsort(src, kind="stable")
    return np.searchsorted(src[order], np.arange(n + 1)), dst[order]


def _ends(start: np.ndarray, ends: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """All ends of these nodes' edges, repeats included."""
    size = start[nodes + 1] - start[nodes]
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return ends[np.repeat(start[nodes], size) + step]


def _walk(src, dst, n, roots, stop=None):
    start, ends = _neighbours(src, dst, n)
    closed = np.zeros(n, bool)
    if stop is not None:
        closed[stop] = True
    frontier, found = np.unique(roots[~closed[roots]]), []
    while len(frontier):
        closed[frontier] = True
        found.append(frontier)
        new = _ends(start, ends, frontier)
        frontier = np.unique(new[~closed[new]])
    return [np.concatenate(found) if found else np.zeros(0, np.int64)]


def _place(src, dst, n, nodes, weights, bases):
    level = np.zeros(n, np.int64)
    level[nodes] = bases
    order = np.argsort(dst, kind="stable")
    start, users, weights = np.searchsorted(dst[order], np.arange(n + 1)), src[order], weights[order]
    needs, known = np.bincount(src, minlength=n), np.zeros(n, bool)
    known[nodes] = True
    frontier, found = np.unique(nodes[needs[nodes] == 0]), []
    while len(frontier):
        found.append(frontier)
        own_users, w = _ends(start, users, frontier), _ends(start, weights, frontier)
        at = np.repeat(level[frontier], start[frontier + 1] - start[frontier])
        np.maximum.at(level, own_users, at + w)
        np.subtract.at(needs, own_users, 1)
        own_users = np.unique(own_users)
        frontier = own_users[known[own_users] & (needs[own_users] == 0)]
    found = np.concatenate(found) if found else np.zeros(0, np.int64)
    return [found, level[found].astype(np.int32)]


def _strong(src, dst, n):
    """(node, least node of its ring) by Tarjan's walk, with a stack of its own."""
    start, ends = _neighbours(src, dst, n)
    start, ends = start.tolist(), ends.tolist()
    loops = set(src[src == dst].tolist())
    number, low, on, path, count = [-1] * n, [0] * n, [False] * n, [], 0
    node_out, ring_out = [], []
    for root in range(n):
        if number[root] >= 0:
            continue
        work = [(root, start[root])]
        while work:
            v, at = work.pop()
            if number[v] < 0:
                number[v] = low[v] = count
                count += 1
                path.append(v)
                on[v] = True
            while at < start[v + 1]:
                w = ends[at]
                at += 1
                if number[w] < 0:
                    work += [(v, at), (w, start[w])]
                    break
                if on[w]:
                    low[v] = min(low[v], number[w])
            else:
                if low[v] == number[v]:
                    own = []
                    while not own or own[-1] != v:
                        own.append(path.pop())
                        on[own[-1]] = False
                    if len(own) > 1 or v in loops:
                        node_out += own
                        ring_out += [min(own)] * len(own)
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
    return [np.array(node_out, np.int64), np.array(ring_out, np.int64)]


def _walked_within(rows: DataFrame, parts: int) -> DataFrame:
    """(node, is_open) found from the roots among ``rows`` (is_edge, src, dst) within parts of the edges.

    Parts are ranges of ``src``, read in its order by as many rows at a time as one task may hold. Open
    nodes lie outside of the range that found them, so their edges may be elsewhere.
    """
    limit = LOCAL_EDGES
    kind = rows.schema["src"].dataType
    schema = T.StructType([T.StructField("node", kind), T.StructField("is_open", T.BooleanType())])

    def walked(table, more):
        """What is found, and the last src if it is: its edges may go on in the next rows."""
        edges, roots = table.filter(table.column("is_edge")), table.filter(pc.invert(table.column("is_edge"))).column("src")
        both = pa.chunked_array([*edges.column("src").chunks, *edges.column("dst").chunks, *roots.chunks, *more], type=table.schema.field("src").type)
        names = pc.unique(both)
        names = names.take(pc.sort_indices(names))
        codes = pc.index_in(both.combine_chunks(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(edges)
        src, dst, start = codes[:n], codes[n : 2 * n], codes[2 * n :]
        found = _walk(src, dst, len(names), start)[0]
        if not n:
            return names, found, np.ones(len(found), bool), []
        last = src.max()
        return names, found, (found < src.min()) | (found > last), [names.slice(last, 1)] if (found == last).any() else []

    def run(batches):
        held, n, more = [], 0, []

        def out():
            names, found, is_open, again = walked(pa.Table.from_batches(held), more)
            more[:] = again
            return pa.RecordBatch.from_arrays([names.take(pa.array(found)), pa.array(is_open)], names=["node", "is_open"])

        for b in batches:
            if held and n + len(b) > limit:
                yield out()
                held.clear()
                n = 0
            if len(b):
                held.append(b)
                n += len(b)
        if held:
            yield out()

    return rows.repartitionByRange(parts, "src").sortWithinPartitions("src", "is_edge").mapInArrow(run, schema)


def reach(roots: DataFrame, edges: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """Nodes reached from ``roots`` (node) along ``edges`` (src, dst), roots included.

    Nodes of ``stop`` are not entered. A graph too large for one task is walked within parts of its
    edges, as far as each part leads; a round goes on with what left its part, so rounds are
    few where neighbours in number are neighbours in the graph.
    """
    edges = settle(edges.select("src", "dst"))
    if _is_small(edges) and _is_small(roots) and (stop is None or _is_small(stop)):
        more = {"roots": roots.select("node")} | ({} if stop is None else {"stop": stop.select("node")})
        return _in_one_task(edges, _walk, ["node"], **more)
    frontier, parts = roots.select("node").distinct(), edges.count() * 4 // max(1, LOCAL_EDGES) + 1
    if stop is not None:
        stop = settle(stop.select("node").distinct())
        frontier = frontier.join(stop, "node", "left_anti")
        edges = settle(edges.join(stop.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    frontier = settle(frontier)
    walk_on = edges.filter("src is not null").select(F.lit(True).alias("is_edge"), "src", "dst")
    known = [frontier]
    while not frontier.isEmpty():
        rows = frontier.filter("node is not null").select(F.lit(False).alias("is_edge"), F.col("node").alias("src"), F.col("node").alias("dst"))
        out = settle(_walked_within(walk_on.union(rows), parts))
        done = out.filter("not is_open").select("node")
        frontier = settle(out.filter("is_open and node is not null").select("node").distinct().join(_union([*known, done]), "node", "left_anti"))
        known += [settle(done.distinct().join(_union(known), "node", "left_anti")), frontier]
        if len(known) > 12:
            known = [settle(_union(known))]
    return _union(known)


def closure(edges: DataFrame) -> DataFrame:
    """Every pair (src, dst) with a path of one or more edges.

    Rings are contracted first: pairs are closed over components, by rounds that double the paths'
    length, and written out over their members at the end, each pair once.
    """
    edges = edges.select("src", "dst")
    ring = settle(rings(edges))
    a, b = ring.select(F.col("node").alias("src"), F.col("ring").alias("a")), ring.select(F.col("node").alias("dst"), F.col("ring").alias("b"))
    between = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"))
    frontier = settle(between.filter("src <> dst").distinct())
    known = [frontier]
    while not frontier.isEmpty():
        step = _union(known).select(F.col("src").alias("mid"), F.col("dst").alias("far"))
        new = frontier.join(step, F.col("dst") == F.col("mid")).select("src", F.col("far").alias("dst")).distinct()
        frontier = settle(new.join(_union(known), ["src", "dst"], "left_anti"))
        known.append(frontier)
    pairs = _union(known).union(ring.select("ring", "ring").distinct())
    from_ring, to_ring = ring.select(F.col("ring").alias("src"), F.col("node").alias("x")), ring.select(F.col("ring").alias("dst"), F.col("node").alias("y"))
    return pairs.join(from_ring, "src", "left").join(to_ring, "dst", "left").select(F.coalesce("x", "src").alias("src"), F.coalesce("y", "dst").alias("dst"))


def _chains(needs: DataFrame, bases: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Nodes with a single need, and how far their needs lead.

    ``needs`` (src, dst, w), ``bases`` (node, base). Returns (ends, endless, steps): ends (node, to,
    w, base, least) of nodes whose chain leads to a node with other needs than one, with what
    the chain adds; endless (node, to, least) of those that lead into a cycle, ``to`` being on it;
    and the pointers of each round. ``least`` is the least node passed on the way.
    """
    single = needs.groupBy("src").agg(F.count("*").alias("n"), F.first("dst").alias("to"), F.first("w").alias("w")).filter("n = 1")
    here = settle(single.select(F.col("src").alias("node"), "to", "w").join(bases, "node").withColumn("least", F.col("node")))
    steps, rounds = [], max(1, here.count()).bit_length()
    for _ in range(rounds):
        steps.append(here)
        on = here.select(F.col("node").alias("to"), F.col("to").alias("far"), F.col("w").alias("more"), F.col("base").alias("b2"), F.col("least").alias("l2"))
        far = here.join(on, "to", "left")
        w = F.col("w") + F.coalesce("more", F.lit(0))
        base = F.greatest("base", F.coalesce(F.col("b2") + F.col("w"), "base"))
        new = settle(far.select("node", F.coalesce("far", "to").alias("to"), w.alias("w"), base.alias("base"), F.least("least", F.coalesce("l2", "least")).alias("least"), F.col("far").isNotNull().alias("moved")))
        here = new.drop("moved")
        if new.filter("moved").isEmpty():
            break
    inside = here.select(F.col("node").alias("to"))
    return here.join(inside, "to", "left_anti"), here.join(inside, "to", "left_semi").select("node", "to", "least"), steps


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges none of whose ends is among ``nodes`` (node)."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_anti").join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti")


def _rings_within(edges: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """((node, ring), edges) after what is a ring within a part of the edges became one node.

    A ring of some of the edges lies inside a ring of all. Parts are ranges of ``src``, so that
    neighbours in number meet; a part is solved by as many edges at a time as one task may hold.
    """
    limit = LOCAL_EDGES
    kind = edges.schema["src"].dataType
    schema = T.StructType([T.StructField("is_edge", T.BooleanType()), T.StructField("src", kind), T.StructField("dst", kind)])

    def solved(held):
        table = pa.Table.from_batches(held)
        both = pa.chunked_array([*table.column("src").chunks, *table.column("dst").chunks])
        names = pc.unique(both)
        names = names.take(pc.sort_indices(names))
        codes = pc.index_in(both.combine_chunks(), value_set=names).to_numpy().astype(np.int64)
        src, dst = codes[: len(table)], codes[len(table) :]
        nodes, ring = _strong(src, dst, len(names))
        own = np.arange(len(names))
        own[nodes] = ring
        left = np.unique(np.stack([own[src], own[dst]])[:, own[src] != own[dst]], axis=1)
        flags = pa.array([False] * len(nodes) + [True] * left.shape[1])
        out = [pa.array(np.concatenate([nodes, left[0]])), pa.array(np.concatenate([ring, left[1]]))]
        return pa.RecordBatch.from_arrays([flags, *[names.take(x) for x in out]], names=["is_edge", "src", "dst"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            if held and n + len(b) > limit:
                yield solved(held)
                held, n = [], 0
            if len(b):
                held.append(b)
                n += len(b)
        if held:
            yield solved(held)

    both = settle(edges.select("src", "dst").repartitionByRange(parts, "src").mapInArrow(run, schema))
    found = both.filter("not is_edge").select(F.col("src").alias("node"), F.col("dst").alias("ring"))
    members = settle(found.groupBy("node").agg(F.min("ring").alias("ring")))
    # a node of several rings, found at several times, makes them one: edges lead both ways between them
    again = found.join(members.withColumnRenamed("ring", "least"), "node").filter("ring <> least").select(F.col("ring").alias("src"), F.col("least").alias("dst"))
    a, b = members.select(F.col("node").alias("src"), F.col("ring").alias("a")), members.select(F.col("node").alias("dst"), F.col("ring").alias("b"))
    left = both.filter("is_edge").join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"))
    return members, settle(left.union(again).union(again.select("dst", "src")).filter("src <> dst").distinct())


def _led_on(members: DataFrame, found: DataFrame) -> DataFrame:
    """(node, ring) of the whole graph: members of rings within parts, and what was found beyond."""
    on = found.select(F.col("node").alias("ring"), F.col("ring").alias("more"))
    own = members.join(on, "ring", "left").select("node", F.coalesce("more", "ring").alias("ring"))
    return own.union(found.join(members.select("node"), "node", "left_anti"))


def rings(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves, with the least node of their ring (strong component).

    A graph too large for one task is first solved within parts of its edges; what is left is small
    where neighbours in number are neighbours in the graph.
    """
    if _is_small(edges):
        return _rings_by_rounds(edges)
    members, left = _rings_within(edges, edges.count() * 4 // max(1, LOCAL_EDGES) + 1)
    return _led_on(members, settle(_rings_by_rounds(left)))


def _rings_by_rounds(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves, with the least node of their ring (strong component).

    A graph too large for one task loses nodes without needs or users; nodes with a single need are
    passed over by the edges to them, and cycles of such nodes alone are rings at once. What has
    neither is coloured by the least node that reaches each; what reaches that node back within
    the colour is its ring. Nodes that were passed over belong to the ring of their chain's end if
    someone of that ring needs them, or one before them in the chain.
    """
    left, done, passed = edges.select("src", "dst").distinct(), [], []
    while not _is_small(left):
        left = settle(left)
        inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        inner = settle(inner)
        nodes = inner.select(F.col("src").alias("node")).distinct().withColumn("base", F.lit(0).cast("long"))
        ends, endless, steps = _chains(inner.withColumn("w", F.lit(0).cast("long")), nodes)
        ends, endless = settle(ends), settle(endless)
        if not (ends.isEmpty() and endless.isEmpty()):
            # cycles of single needs: the ends of pointers that went round at least once
            ring = endless.select(F.col("to").alias("node")).distinct().join(endless.select("node", F.col("least").alias("ring")), "node")
            done.append(settle(ring))
            rest = settle(_without(inner, endless))
            chain = ends.select(F.col("node").alias("dst"), F.col("to").alias("end"))
            users = rest.join(ends.select(F.col("node").alias("src")), "src", "left_anti").join(chain, "dst")
            passed.append((settle(users.select("src", "dst", "end")), [p.join(ends.select("node"), "node", "left_semi").select("node", "to") for p in steps], ends.select("node", "to")))
            kept = rest.join(chain, "dst", "left").select("src", F.coalesce("end", "dst").alias("dst"))
            left = kept.join(ends.select(F.col("node").alias("src")), "src", "left_anti").distinct()
            continue
        if inner.count() < left.count():
            left = inner
            continue
        colour = settle(left.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:  # the least node that reaches each
            offers = left.join(colour, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), F.col("colour").alias("offer"))
            best = offers.groupBy("node").agg(F.min("offer").alias("offer"))
            new = settle(colour.join(best, "node", "left").select("node", F.least("colour", "offer").alias("colour")))
            moved = new.join(colour, ["node", "colour"], "left_anti").isEmpty()
            colour = new
            if moved:
                break
        a = colour.select(F.col("node").alias("src"), F.col("colour").alias("a"))
        b = colour.select(F.col("node").alias("dst"), F.col("colour").alias("b"))
        left = settle(left.join(a, "src").join(b, "dst").filter("a = b").select("src", "dst"))
        back = left.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        own = settle(reach(colour.filter("node = colour").select("node"), back))
        loops = left.select(F.col("src").alias("node")).distinct()
        found = own.join(colour, "node").select("node", F.col("colour").alias("ring")).join(loops, "node", "left_semi")
        # a lone node of a colour without an edge to itself is no ring
        many = found.groupBy("ring").agg(F.count("*").alias("n")).filter("n > 1").select("ring")
        itself = left.filter("src = dst").select(F.col("src").alias("node"))
        done.append(settle(found.join(many, "ring", "left_semi").select("node", "ring").union(found.join(many, "ring", "left_anti").join(itself, "node", "left_semi").select("node", "ring"))))
        left = _without(left, own)
    done.append(_in_one_task(left, _strong, ["node", "ring"]))
    found = _union(done)
    for users, pointers, ends in reversed(passed):
        found = settle(found)
        a, b = found.select(F.col("node").alias("src"), F.col("ring").alias("a")), found.select(F.col("node").alias("end"), F.col("ring").alias("b"))
        marked = settle(users.join(a, "src").join(b, "end").filter("a = b").select(F.col("dst").alias("node")).distinct())
        for step in pointers:  # the 2 ** k th after a marked one is marked
            ahead = step.join(marked, "node", "left_semi").select(F.col("to").alias("node"))
            marked = settle(marked.union(ahead.join(ends.select("node"), "node", "left_semi")).distinct())
        own = marked.join(ends, "node").join(found.select(F.col("node").alias("to"), "ring"), "to").select("node", "ring")
        found = found.union(own)
    if not passed:
        return found
    least = settle(found).groupBy("ring").agg(F.min("node").alias("least"))
    return found.join(least, "ring").select("node", F.col("least").alias("ring"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Strongly connected component of each node (node), named by its least node."""
    ring = rings(edges)
    return nodes.select("node").distinct().join(ring, "node", "left").select("node", F.coalesce("ring", "node").alias("component"))


def condensation_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Components with their level: what a component needs (src needs dst) has a lower level."""
    comp = settle(components(nodes, edges))
    a, b = comp.select(F.col("node").alias("src"), F.col("component").alias("a")), comp.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    between = settle(edges.join(a, "src").join(b, "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    level = levels(comp.select(F.col("component").alias("node")).distinct(), between)
    return comp.join(level.select(F.col("node").alias("component"), "level"), "component").select("node", "component", "level")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest-path level of each node of an acyclic graph; src needs dst, no need is level 0.

    A graph too large for one task goes by rounds: nodes without needs are placed and raise their
    users' bases; nodes with a single need are passed over, each user needing the chain's end
    by as much more, and are placed once that end is. Nodes on a cycle or in need of one are left out.
    """
    left = nodes.select("node").distinct().withColumn("base", F.lit(0).cast("long"))
    needs = edges.select("src", "dst").distinct()
    if _is_small(needs) and _is_small(left):
        return _levels(left, needs)
    with _unbroadcast(nodes.sparkSession):  # dozens of rounds, each with tables just small enough to be sent around
        return settle(_levels(left, needs))


def _levels(left: DataFrame, needs: DataFrame) -> DataFrame:
    """``levels`` of nodes (node, base) by rounds, or in one task."""
    needs = needs.join(left.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", F.lit(1).cast("long").alias("w"))
    placed, passed = [], []
    while not (_is_small(needs) and _is_small(left)):
        left, needs = settle(left), settle(needs)
        ready = settle(left.join(needs.select(F.col("src").alias("node")), "node", "left_anti"))
        if not ready.isEmpty():
            placed.append(ready.select("node", F.col("base").alias("level")))
            met = needs.join(ready.select(F.col("node").alias("dst"), "base"), "dst", "left")
            raised = met.filter("base is not null").groupBy(F.col("src").alias("node")).agg(F.max(F.col("base") + F.col("w")).alias("raised"))
            left = settle(left.join(ready.select("node"), "node", "left_anti").join(raised, "node", "left").select("node", F.greatest("base", F.coalesce("raised", "base")).alias("base")))
            needs = settle(met.filter("base is null").select("src", "dst", "w"))
        ends, endless, _ = _chains(needs, left)
        ends, endless = settle(ends), settle(endless)
        if ready.isEmpty() and ends.isEmpty() and endless.isEmpty():
            return _placed([*placed, left.select("node", F.col("base").alias("level")).limit(0)], passed)
        lost = endless.select("node")
        passed.append(ends.select("node", "to", "w", "base"))
        chain = ends.select(F.col("node").alias("dst"), F.col("to").alias("end"), F.col("w").alias("more"), F.col("base").alias("b2"))
        users = needs.join(ends.select(F.col("node").alias("src")), "src", "left_anti").join(lost.select(F.col("node").alias("src")), "src", "left_anti").join(chain, "dst", "left")
        users = settle(users)
        raised = users.filter("b2 is not null").groupBy(F.col("src").alias("node")).agg(F.max(F.col("b2") + F.col("w")).alias("raised"))
        left = left.join(ends.select("node"), "node", "left_anti").join(lost, "node", "left_anti").join(raised, "node", "left").select("node", F.greatest("base", F.coalesce("raised", "base")).alias("base"))
        # a need of a lost node stays, so that its users are never ready
        needs = users.groupBy("src", F.coalesce("end", "dst").alias("dst")).agg(F.max(F.col("w") + F.coalesce("more", F.lit(0))).alias("w"))
    rest = _in_one_task(needs, _place, ["node", "level"], weight="w", nodes=left)
    return _placed([*placed, rest.withColumn("level", F.col("level").cast("long"))], passed)


def _placed(placed: list[DataFrame], passed: list[DataFrame]) -> DataFrame:
    """Levels of all nodes, those that were passed over by the levels of their chains' ends."""
    found = _union(placed)
    for chain in reversed(passed):
        found = settle(found)
        at = found.select(F.col("node").alias("to"), F.col("level").alias("at"))
        found = found.union(chain.join(at, "to").select("node", F.greatest("base", F.col("at") + F.col("w")).alias("level")))
    return found.select("node", F.col("level").cast("int").alias("level"))


def wave_cut(levels_df: DataFrame, bound: int) -> DataFrame:
    """Each level cut into chunks of at most ``bound`` nodes, by node.

    Ranks are counted per range of nodes first and offset by the ranges before, so one large
    level is not sorted in one task.
    """
    spark = levels_df.sparkSession
    dealt = levels_df.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "level", "node").withColumn("part", F.spark_partition_id())
    dealt = settle(dealt)
    from pyspark.sql import Window as W

    own = W.partitionBy("level", "part").orderBy("node")
    before = W.partitionBy("level").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = dealt.groupBy("level", "part").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    out = dealt.withColumn("rn", F.row_number().over(own)).join(sizes.drop("n"), ["level", "part"])
    return out.select("node", "level", F.floor((F.col("offset") + F.col("rn") - 1) / bound).cast("long").alias("chunk"))


def greedy_waves(positions: DataFrame, conflicts: DataFrame) -> DataFrame:
    """In input order, each plan goes one wave after the last wave with a plan it conflicts with.

    That is the longest path over conflict edges from earlier to later plans.
    """
    back = conflicts.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    return levels(positions.select(F.col("position").alias("node")), back).select(F.col("node").alias("position"), F.col("level").alias("wave"))
