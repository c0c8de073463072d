"""Path metrics of one large graph, as joins over canonical edges (i < j, weight > 0).

Distances spread from all sources of a batch at once. Open entries (source, node, distance) within a bucket of the
smallest open distance are relaxed by one join with the edges and one grouping (delta-stepping), until none is open.
Only sums per source leave a batch, so all-pairs metrics need room for sources of a batch times nodes, not for the square.

Long chains would need a round for every edge. So nodes of at most two neighbours are first taken out, an independent
set a round, with an edge between their neighbours; a ring or path of n nodes vanishes in O(log n) rounds. The nodes
taken out get their distances afterwards from their neighbours, in reverse order. Distances stay exact.

Betweenness follows Brandes: counts of shortest paths go forward along the edges that lie on them, dependencies backward.

Nodes may be of any type that can be compared and hashed, structs included: a struct of a key and a node makes one
graph out of many. Rounds are checkpointed; nothing but counters reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tractloom.operators.connectome import both_ways
from tractloom.operators.graph import degree_strength
from tractloom.session import checkpoint_folder

#: Entries (sources of a batch times nodes) that one batch may hold.
STATE_ROWS = 200_000_000
#: Chains are taken out while at least this share of the nodes goes in a round, and the graph has at least so many nodes.
LEAST_SHARE, LEAST_NODES = 0.05, 1000
#: Two lengths are equal within this share.
SAME = 1e-12
COSTS = {"hop": lambda w: F.lit(1.0), "weight": lambda w: w, "inverse": lambda w: 1.0 / w}


def fixed(edges: DataFrame) -> DataFrame:
    """The edges written once, so that no round and no sum computes them again."""
    checkpoint_folder(edges.sparkSession)
    return edges.select("i", "j", "weight").checkpoint()


def arcs(edges: DataFrame, kind: str = "weight") -> DataFrame:
    """(u, v, c) in both directions. hop: every edge costs 1; weight: a weight is a length; inverse: its reciprocal is."""
    e = both_ways(edges).where("u <> v")
    return e.groupBy("u", "v").agg(F.min(COSTS[kind](F.col("w")).cast("double")).alias("c"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return both_ways(edges).select(F.col("u").alias("node")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each can reach. Alternating stars: O(log^2 n) rounds at any diameter."""
    checkpoint_folder(edges.sparkSession)
    link = both_ways(edges).where("u > v").select("u", "v").distinct().checkpoint()
    mark = None
    while True:
        both = link.union(link.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        link = small.where("u <> v").distinct().checkpoint()
        now = link.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == mark:
            break
        mark = now
    roots = link.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return link.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def without_chains(e: DataFrame, keep: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The arcs left when nodes of at most two neighbours are taken out, and the arcs (node, v, c) of those of each round. keep (node) stays."""
    taken: list[DataFrame] = []
    if e.select("u").distinct().count() < LEAST_NODES:
        return e, taken
    keep = keep.select(F.col("node").alias("u"))
    while True:
        d = e.groupBy("u").agg(F.count(F.lit(1)).alias("k"))
        size = d.count()
        able = d.where("k <= 2").join(keep, "u", "left_anti").select("u", F.xxhash64("u", F.lit(len(taken))).alias("p"))
        other = able.select(F.col("u").alias("v"), F.col("p").alias("q"))
        first = (F.col("q") < F.col("p")) | ((F.col("q") == F.col("p")) & (F.col("v") < F.col("u")))
        out = able.join(e.join(able, "u").join(other, "v").where(first).select("u").distinct(), "u", "left_anti").select("u")
        gone = e.join(out, "u").select(F.col("u").alias("node"), "v", "c").checkpoint()
        here = gone.select("node").distinct()
        count = here.count()
        if not count or count < LEAST_SHARE * size:
            return e, taken
        taken.append(gone)
        pair = gone.groupBy("node").agg(F.collect_list(F.struct("v", "c")).alias("n")).where(F.size("n") == 2)
        a, b = F.col("n")[0], F.col("n")[1]
        short = pair.select(F.explode(F.array(F.struct(a["v"].alias("u"), b["v"].alias("v"), (a["c"] + b["c"]).alias("c")), F.struct(b["v"].alias("u"), a["v"].alias("v"), (a["c"] + b["c"]).alias("c")))).alias("x")).select("x.*")
        gone_u, gone_v = here.select(F.col("node").alias("u")), here.select(F.col("node").alias("v"))
        e = e.join(gone_u, "u", "left_anti").join(gone_v, "v", "left_anti").select("u", "v", "c").union(short).groupBy("u", "v").agg(F.min("c").alias("c")).checkpoint()


def spread(e: DataFrame, sources: DataFrame, delta: float | None = None) -> DataFrame:
    """(src, node, d) of all nodes that sources (node) reach over arcs e (u, v, c), by delta-stepping."""
    checkpoint_folder(e.sparkSession)
    keep = sources.distinct()
    core, taken = without_chains(e.checkpoint(), keep)
    step = delta or core.agg(F.avg("c")).first()[0] or 1.0
    best = keep.select(F.col("node").alias("src"), "node", F.lit(0.0).alias("d"), F.lit(True).alias("open")).checkpoint()
    while True:
        low = best.where("open").agg(F.min("d")).first()[0]
        if low is None:
            break
        near = F.col("open") & (F.col("d") <= F.lit(low + step))
        front = best.where(near).select("src", F.col("node").alias("u"), "d")
        found = front.join(core, "u").groupBy("src", F.col("v").alias("node")).agg(F.min(F.col("d") + F.col("c")).alias("d")).select("src", "node", "d", F.lit(True).alias("open"))
        # The smaller distance counts; of equal ones the entry that is closed already.
        both = best.withColumn("open", F.col("open") & ~near).union(found)
        best = both.groupBy("src", "node").agg(F.min(F.struct("d", "open")).alias("x")).select("src", "node", "x.d", "x.open").checkpoint()
    got = best.select("src", "node", "d")
    for gone in reversed(taken):
        back = got.withColumnRenamed("node", "v").join(gone, "v").groupBy("src", "node").agg(F.min(F.col("d") + F.col("c")).alias("d"))
        got = got.union(back.select("src", "node", "d")).checkpoint()
    return got


def batches(edges: DataFrame) -> Iterator[DataFrame]:
    """The nodes (node), in batches that keep sources times nodes below STATE_ROWS."""
    nodes = nodes_of(edges).checkpoint()
    n = nodes.count()
    parts = max(1, -(-n * n // STATE_ROWS))
    for k in range(parts if n else 0):
        yield nodes if parts == 1 else nodes.where(F.pmod(F.xxhash64("node"), F.lit(parts)) == k)


def source_sums(edges: DataFrame, kind: str = "weight") -> DataFrame:
    """(node, reached, total, inverse): nodes that each reaches, itself not counted, their distances and reciprocal distances summed."""
    checkpoint_folder(edges.sparkSession)
    e = arcs(edges, kind).checkpoint()
    out = None
    for sources in batches(edges):
        d = spread(e, sources).where("src <> node")
        s = d.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("reached"), F.sum("d").alias("total"), F.sum(1.0 / F.col("d")).alias("inverse")).checkpoint()
        out = s if out is None else out.union(s)
    if out is None:
        out = nodes_of(edges).select("node", F.lit(0).cast("long").alias("reached"), F.lit(0.0).alias("total"), F.lit(0.0).alias("inverse"))
    return out


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def closeness(edges: DataFrame, kind: str = "weight") -> DataFrame:
    """(node, closeness): nodes reached over their summed distance, times the share of the graph that is reached."""
    edges = fixed(edges)
    n = nodes_of(edges).agg((F.count(F.lit(1)) - 1.0).alias("others"))
    k = F.col("reached").cast("double")
    return source_sums(edges, kind).crossJoin(F.broadcast(n)).select("node", (_share(k, F.col("total")) * _share(k, F.col("others"))).alias("closeness"))


def path_length(edges: DataFrame, kind: str = "weight") -> DataFrame:
    """(path_length): mean distance between different nodes of the largest component (ties: the one of the smallest node)."""
    edges = fixed(edges)
    of = components(edges)
    big = of.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    s = source_sums(edges, kind).join(of, "node").join(F.broadcast(big), "component")
    return s.agg(_share(F.sum("total"), F.sum(F.col("n") - 1.0)).alias("path_length"))


def global_efficiency(edges: DataFrame) -> DataFrame:
    """(global_efficiency): mean reciprocal number of hops between different nodes, 0 where there is no path."""
    edges = fixed(edges)
    n = nodes_of(edges).agg(F.count(F.lit(1)).cast("double").alias("n"))
    s = source_sums(edges, "hop").agg(F.sum("inverse").alias("s"))
    return s.crossJoin(n).select(_share(F.col("s"), F.col("n") * (F.col("n") - 1)).alias("global_efficiency"))


def distances_from(edges: DataFrame, sources: DataFrame, kind: str = "weight") -> DataFrame:
    """(src, node, d) from some sources (node) to all that they reach, themselves included."""
    return spread(arcs(edges, kind), sources.select("node"))


def shortest_path(edges: DataFrame, source: DataFrame, target: DataFrame, kind: str = "weight") -> DataFrame:
    """(step, node, d): one shortest path between two nodes (one row, column node, each); no rows if there is none.

    From the target back, each time to the smallest neighbour on a shortest path; one small join a step.
    """
    checkpoint_folder(edges.sparkSession)
    e = arcs(edges, kind).checkpoint()
    d = spread(e, source).select("node", "d").checkpoint()
    on = d.withColumnRenamed("node", "v").withColumnRenamed("d", "dv").join(e, "v").join(d.withColumnRenamed("node", "u").withColumnRenamed("d", "du"), "u")
    before = on.where(F.abs(F.col("du") + F.col("c") - F.col("dv")) <= SAME * F.greatest(F.col("dv"), F.lit(1.0))).groupBy("v").agg(F.min("u").alias("u")).checkpoint()
    at = d.join(target, "node").first()
    rows = []
    spark = edges.sparkSession
    while at is not None:
        rows.append((len(rows), at["node"], at["d"]))
        up = before.where(F.col("v") == F.lit(at["node"])).join(d.withColumnRenamed("node", "u"), "u").select(F.col("u").alias("node"), "d")
        at = up.first() if at["d"] > 0 else None
    out = spark.createDataFrame(rows, f"step int, node {dict(d.dtypes)['node']}, d double")
    return out.withColumn("step", F.lit(len(rows) - 1) - F.col("step"))


def betweenness(edges: DataFrame, kind: str = "weight") -> DataFrame:
    """(node, betweenness): the share of shortest paths between other nodes that pass each node, over ordered pairs."""
    edges = fixed(edges)
    e = arcs(edges, kind).checkpoint()
    total = None
    for sources in batches(edges):
        part = _dependencies(e, sources)
        total = part if total is None else total.union(part)
    nodes = nodes_of(edges)
    if total is None:
        return nodes.select("node", F.lit(0.0).alias("betweenness"))
    n = nodes.agg(F.count(F.lit(1)).cast("double").alias("n"))
    got = nodes.join(total.groupBy("node").agg(F.sum("b").alias("b")), "node", "left").crossJoin(F.broadcast(n))
    return got.select("node", F.coalesce(F.try_divide(F.coalesce("b", F.lit(0.0)), (F.col("n") - 1) * (F.col("n") - 2)), F.lit(0.0)).alias("betweenness"))


def _dependencies(e: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, b): dependencies of the sources of a batch on each node, by Brandes' two sweeps."""
    d = spread(e, sources).checkpoint()
    u, v = d.select("src", F.col("node").alias("u"), F.col("d").alias("du")), d.select("src", F.col("node").alias("v"), F.col("d").alias("dv"))
    same = F.abs(F.col("du") + F.col("c") - F.col("dv")) <= SAME * F.greatest(F.col("dv"), F.lit(1.0))
    dag = u.join(e, "u").join(v, ["src", "v"]).where(same).select("src", "u", "v").checkpoint()
    need = dag.groupBy("src", F.col("v").alias("node")).agg(F.count(F.lit(1)).alias("need"))
    # Forward: a node is ready when all before it on shortest paths have given their counts.
    ready = [sources.select(F.col("node").alias("src"), "node", F.lit(1.0).alias("paths"), F.lit(0).alias("level")).checkpoint()]
    waiting = None
    while True:
        k = len(ready)
        given = ready[-1].withColumnRenamed("node", "u").join(dag, ["src", "u"]).groupBy("src", F.col("v").alias("node")).agg(F.sum("paths").alias("paths"), F.count(F.lit(1)).alias("got"))
        if waiting is not None:
            given = given.union(waiting).groupBy("src", "node").agg(F.sum("paths").alias("paths"), F.sum("got").alias("got"))
        given = given.join(need, ["src", "node"]).checkpoint()
        if given.isEmpty():
            break
        ready.append(given.where("got = need").select("src", "node", "paths", F.lit(k).alias("level")).checkpoint())
        waiting = given.where("got < need").select("src", "node", "paths", "got")
    before = ready[0]
    for x in ready[1:]:
        before = before.union(x)
    before = before.select("src", F.col("node").alias("u"), F.col("paths").alias("pu")).checkpoint()
    # Backward: from the last level on, each node hands its load to those before it, by their share of its paths.
    loads = None
    for x in reversed(ready[1:]):
        mine = x.select("src", F.col("node").alias("v"), "paths")
        mine = mine.withColumn("load", F.lit(0.0)) if loads is None else mine.join(loads.withColumnRenamed("node", "v"), ["src", "v"], "left").withColumn("load", F.coalesce("load", F.lit(0.0)))
        given = mine.join(dag, ["src", "v"]).join(before, ["src", "u"]).groupBy("src", F.col("u").alias("node")).agg(F.sum(F.col("pu") / F.col("paths") * (1.0 + F.col("load"))).alias("load"))
        loads = (given if loads is None else given.union(loads).groupBy("src", "node").agg(F.sum("load").alias("load"))).checkpoint()
    if loads is None:
        return sources.select("node", F.lit(0.0).alias("b"))
    return loads.where("src <> node").groupBy("node").agg(F.sum("load").alias("b")).checkpoint()


def local_efficiency(edges: DataFrame) -> DataFrame:
    """(node, local_efficiency): efficiency of the graph among each node's neighbours; all of them are one graph of (centre, neighbour) nodes."""
    edges = fixed(edges)
    e = both_ways(edges).select("u", "v").distinct()
    third = e.select(F.col("u").alias("v"), F.col("v").alias("t"))
    tri = e.join(third, "v").join(e.withColumnRenamed("v", "t"), ["u", "t"]).where("v < t")
    node = lambda c: F.struct(F.col("u").alias("centre"), F.col(c).alias("node"))
    s = source_sums(tri.select(node("v").alias("i"), node("t").alias("j"), F.lit(1.0).alias("weight")), "hop")
    s = s.groupBy(F.col("node.centre").alias("node")).agg(F.sum("inverse").alias("s"))
    k = F.col("degree").cast("double")
    return degree_strength(edges).join(s, "node", "left").select("node", _share(F.coalesce("s", F.lit(0.0)), k * (k - 1)).alias("local_efficiency"))


def removed_in_steps(edges: DataFrame, order: DataFrame, n_steps: int = 10) -> DataFrame:
    """(step, efficiency, size) of what is left after each step of removal. order (node, place from 0); max(1, n / n_steps) nodes go a step.

    The graphs of all steps are one graph of (step, node) nodes.
    """
    n = order.agg(F.count(F.lit(1)).alias("n"))
    steps = edges.sparkSession.range(n_steps + 1).select(F.col("id").alias("step")).crossJoin(n).withColumn("gone", F.col("step") * F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / n_steps)))
    steps = F.broadcast(steps)
    alive = order.join(steps, F.col("place") >= F.col("gone"))
    size = alive.groupBy("step").agg(F.count(F.lit(1)).alias("size"))
    place = lambda c: order.select(F.col("node").alias(c), F.col("place").alias("p" + c))
    e = edges.join(place("i"), "i").join(place("j"), "j").join(steps, F.least("pi", "pj") >= F.col("gone"))
    node = lambda c: F.struct("step", F.col(c).alias("node"))
    s = source_sums(e.select(node("i").alias("i"), node("j").alias("j"), "weight"), "hop").groupBy(F.col("node.step").alias("step")).agg(F.sum("inverse").alias("s"))
    got = steps.select("step").join(size, "step", "left").join(s, "step", "left")
    k = F.coalesce("size", F.lit(0)).cast("double")
    return got.select("step", _share(F.coalesce("s", F.lit(0.0)), k * (k - 1)).alias("efficiency"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))


def by_degree(edges: DataFrame) -> DataFrame:
    """(node, place): nodes from the highest degree on, ties by node. Degrees are counted first, so places inside one are all that is ordered."""
    d = degree_strength(edges).select("node", "degree")
    counts = d.groupBy("degree").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("degree", F.coalesce(F.sum("c").over(Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("degree").orderBy("node")) - 1
    return d.withColumn("inside", inside).join(before, "degree").select("node", (F.col("before") + F.col("inside")).alias("place"))


def at_random(edges: DataFrame, seed: int = 0) -> DataFrame:
    """(node, place): nodes in the order of md5 of 'seed:node'. Places are counted in ranges of the hash."""
    x = nodes_of(edges).withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("node").cast("string")))).withColumn("b", F.substring("h", 1, 3))
    counts = x.groupBy("b").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("b", F.coalesce(F.sum("c").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("b").orderBy("h", "node")) - 1
    return x.withColumn("inside", inside).join(before, "b").select("node", (F.col("before") + F.col("inside")).alias("place"))
