"""Graph metrics over canonical edges (i < j, weight > 0).

Local metrics are joins and aggregates over edges and scale with them. Path metrics come in two forms: one graph per
group (subject) in one task, for many graphs of bounded size, and hop distances by relational frontier expansion.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractloom.operators.connectome import both_ways
from tractloom.session import checkpoint_folder

INF = float("inf")


def degree_strength(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))


def density(edges: DataFrame) -> DataFrame:
    """Nodes are those with an edge."""
    n = both_ways(edges).agg(F.countDistinct("u").alias("n"))
    m = edges.agg(F.count(F.lit(1)).alias("m"))
    return n.crossJoin(m).select("n", "m", F.coalesce(F.try_divide(2.0 * F.col("m"), F.col("n") * (F.col("n") - 1.0)), F.lit(0.0)).alias("density"))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c, wab, wac, wbc), each once: paths out of the lowest node closed by an edge.

    Nodes are ordered by degree, then by number. Edges point to the higher end, so a hub opens few paths: in a graph of m
    edges no node has more than sqrt(2 m) edges out.
    """
    d = degree_strength(edges)
    ends = edges.join(d.select(F.col("node").alias("i"), F.col("degree").alias("di")), "i").join(d.select(F.col("node").alias("j"), F.col("degree").alias("dj")), "j")
    i, j = F.struct(F.col("di").alias("k"), F.col("i").alias("n")), F.struct(F.col("dj").alias("k"), F.col("j").alias("n"))
    e = ends.select(F.least(i, j).alias("p"), F.greatest(i, j).alias("q"), "weight").select(F.col("p.n").alias("i"), F.col("q.n").alias("j"), F.col("q.k").alias("k"), "weight")
    ab, ac = e.toDF("a", "b", "kb", "wab"), e.toDF("a", "c", "kc", "wac")
    bc = e.drop("k").toDF("b", "c", "wbc")
    up = F.struct("kb", "b") < F.struct(F.col("kc").alias("kb"), F.col("c").alias("b"))
    return ab.join(ac, "a").where(up).join(bc, ["b", "c"]).select("a", "b", "c", "wab", "wac", "wbc")


def weighted_clustering(edges: DataFrame) -> DataFrame:
    """Per node: 2 / (k (k - 1)) times the sum over its triangles of the cube root of the weights, each over the largest; 0 below degree 2."""
    top = edges.agg(F.max("weight").alias("top"))
    t = triangles(edges).crossJoin(F.broadcast(top)).select(F.explode(F.array("a", "b", "c")).alias("node"), F.pow(F.col("wab") / F.col("top") * (F.col("wac") / F.col("top")) * (F.col("wbc") / F.col("top")), F.lit(1.0) / 3).alias("t"))
    s = t.groupBy("node").agg(F.sum("t").alias("t"))
    k = F.col("degree")
    return degree_strength(edges).join(s, "node", "left").select("node", "degree", F.when(k < 2, 0.0).otherwise(2.0 * F.coalesce("t", F.lit(0.0)) / F.greatest(k * (k - 1), F.lit(1))).alias("clustering"))


def transitivity(edges: DataFrame) -> DataFrame:
    """3 triangles over connected triples."""
    t = triangles(edges).agg(F.count(F.lit(1)).alias("triangles"))
    d = degree_strength(edges).agg(F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("triples"))
    return t.crossJoin(d).select("triangles", "triples", F.coalesce(F.try_divide(3.0 * F.col("triangles"), F.col("triples")), F.lit(0.0)).alias("transitivity"))


def assortativity(edges: DataFrame) -> DataFrame:
    """Pearson correlation of the degrees at both ends, edges in both directions; null without variance."""
    d = degree_strength(edges)
    e = both_ways(edges).join(d.select(F.col("node").alias("u"), F.col("degree").alias("du")), "u").join(d.select(F.col("node").alias("v"), F.col("degree").alias("dv")), "v")
    n, sx, sy, sxy, sxx, syy = F.count(F.lit(1)), F.sum("du"), F.sum("dv"), F.sum(F.col("du") * F.col("dv")), F.sum(F.col("du") * F.col("du")), F.sum(F.col("dv") * F.col("dv"))
    return e.agg(F.try_divide((n * sxy - sx * sy).cast("double"), F.sqrt((n * sxx - sx * sx).cast("double") * (n * syy - sy * sy))).alias("assortativity"))


def rich_club(edges: DataFrame) -> DataFrame:
    """(k, phi) for k = 1 .. largest degree - 1: edges among nodes of degree over k, over all pairs of such nodes."""
    d = degree_strength(edges)
    ks = d.agg(F.explode(F.sequence(F.lit(1), F.greatest(F.max("degree") - 1, F.lit(1)))).alias("k"))
    nodes = d.groupBy("degree").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(ks), F.col("degree") > F.col("k")).groupBy("k").agg(F.sum("c").alias("n"))
    ends = edges.join(d.select(F.col("node").alias("i"), F.col("degree").alias("di")), "i").join(d.select(F.col("node").alias("j"), F.col("degree").alias("dj")), "j")
    low = ends.groupBy(F.least("di", "dj").alias("low")).agg(F.count(F.lit(1)).alias("c"))
    inside = low.join(F.broadcast(ks), F.col("low") > F.col("k")).groupBy("k").agg(F.sum("c").alias("m"))
    return nodes.where("n > 1").join(inside, "k", "left").select("k", "n", F.coalesce("m", F.lit(0)).alias("m"), (2.0 * F.coalesce("m", F.lit(0)) / (F.col("n") * (F.col("n") - 1))).alias("phi"))


def modularity(edges: DataFrame, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Q of a partition (node, community): per community, its inner share minus the squared share of its strength."""
    c = lambda x: communities.select(F.col("node").alias(x), F.col("community").alias("c" + x))
    e = edges.join(c("i"), "i").join(c("j"), "j")
    total = edges.agg(F.sum("weight").alias("m"))
    inner = e.where("ci = cj").groupBy(F.col("ci").alias("community")).agg(F.sum("weight").alias("inside"))
    strength = degree_strength(edges).join(communities, "node").groupBy("community").agg(F.sum("strength").alias("s"))
    q = strength.join(inner, "community", "left").crossJoin(F.broadcast(total))
    return q.agg(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - resolution * F.pow(F.col("s") / (2 * F.col("m")), 2)).alias("modularity"))


def hop_distances(edges: DataFrame) -> DataFrame:
    """(src, dst, hops) of all reachable pairs, by expanding the frontier one join at a time until it is empty. Each round is checkpointed."""
    checkpoint_folder(edges.sparkSession)
    near = both_ways(edges).select("u", "v").distinct()
    seen = near.select(F.col("u").alias("src"), F.col("u").alias("dst"), F.lit(0).alias("hops")).distinct().checkpoint()
    front = seen
    for k in count(1):
        step = front.join(near, F.col("dst") == F.col("u")).select("src", F.col("v").alias("dst")).distinct()
        front = step.join(seen, ["src", "dst"], "left_anti").select("src", "dst", F.lit(k).alias("hops")).checkpoint()
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen.where("hops > 0")


# One graph per group, in numpy.


class Graph:
    """A dense view of one graph: nodes in order, weights, hop and weighted distances when asked for."""

    def __init__(self, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> None:
        self.nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        self.n = len(self.nodes)
        self.w = np.zeros((self.n, self.n))
        a, b = at[: len(i)], at[len(i) :]
        self.w[a, b] = w
        self.w[b, a] = w
        self.adj = self.w > 0

    def distances(self, kind: str = "weight") -> np.ndarray:
        """hop: every edge counts 1; weight: a weight is a length; inverse: its reciprocal is."""
        cost = {"hop": np.ones_like, "weight": lambda w: w, "inverse": lambda w: 1 / np.where(w > 0, w, 1)}[kind](self.w)
        d = np.where(self.adj, cost, INF)
        np.fill_diagonal(d, 0)
        for k in range(self.n):
            np.minimum(d, d[:, k, None] + d[None, k, :], out=d)
        return d

    def components(self) -> np.ndarray:
        """The first node's place of each node's component."""
        label = np.arange(self.n)
        while True:
            new = np.minimum(label, np.where(self.adj, label[None, :], self.n).min(1, initial=self.n))
            if (new == label).all():
                return label
            label = new[new]

    def efficiency(self, among: np.ndarray | None = None) -> float:
        """Mean of 1 / hops over pairs of the given nodes, in the graph that they induce."""
        keep = np.arange(self.n) if among is None else among
        n = len(keep)
        if n < 2:
            return 0.0
        adj = self.adj[np.ix_(keep, keep)]
        total, reach, front, k = 0.0, np.eye(n, dtype=bool), np.eye(n, dtype=bool), 0
        while front.any():
            k += 1
            front = ((front.astype(np.float32) @ adj.astype(np.float32)) > 0) & ~reach
            reach |= front
            total += front.sum() / k
        return total / (n * (n - 1))

    def path_length(self, kind: str = "weight") -> float:
        """Mean distance between different nodes of the largest component."""
        label = self.components()
        ids, size = np.unique(label, return_counts=True)
        keep = np.flatnonzero(label == ids[np.argmax(size)])
        if len(keep) < 2:
            return 0.0
        d = self.distances(kind)[np.ix_(keep, keep)]
        return float(d.sum() / (len(keep) * (len(keep) - 1)))

    def closeness(self, kind: str = "weight") -> np.ndarray:
        d = self.distances(kind)
        ok = np.isfinite(d)
        r, s = ok.sum(1), np.where(ok, d, 0).sum(1)
        return np.where(s > 0, (r - 1) / np.where(s > 0, s, 1) * (r - 1) / max(self.n - 1, 1), 0.0)

    def betweenness(self, kind: str = "weight") -> np.ndarray:
        """Shares of shortest paths through each node. Counts of shortest paths follow distances in rising order from each source."""
        d = self.distances(kind)
        cost = np.where(self.adj, {"hop": np.ones_like(self.w), "weight": self.w, "inverse": 1 / np.where(self.w > 0, self.w, 1)}[kind], INF)
        total = np.zeros(self.n)
        for s in range(self.n):
            order = [v for v in np.argsort(d[s], kind="stable") if np.isfinite(d[s, v])]
            onto = self.adj & np.isclose(d[s][:, None] + cost, d[s][None, :], rtol=1e-12, atol=1e-12)
            paths, load = np.zeros(self.n), np.zeros(self.n)
            paths[s] = 1
            for v in order[1:]:
                paths[v] = paths[onto[:, v]].sum()
            for v in reversed(order[1:]):
                before = np.flatnonzero(onto[:, v])
                load[before] += paths[before] / paths[v] * (1 + load[v])
                total[v] += load[v]
        return total / ((self.n - 1) * (self.n - 2)) if self.n > 2 else total * 0

    def eigenvector(self, rounds: int = 1000, tol: float = 1e-6) -> np.ndarray:
        """Power iteration on weights plus identity; zeros where it doesn't settle."""
        x = np.full(self.n, 1 / max(self.n, 1))
        for _ in range(rounds):
            y = x + self.w @ x
            y /= np.linalg.norm(y) or 1
            if np.abs(y - x).sum() < self.n * tol:
                return y
            x = y
        return np.zeros(self.n)

    def local_efficiency(self) -> np.ndarray:
        return np.array([self.efficiency(np.flatnonzero(self.adj[v])) for v in range(self.n)])

    def clustering(self) -> float:
        """Mean weighted clustering."""
        if not self.n or not self.w.max():
            return 0.0
        r = np.cbrt(self.w / self.w.max())
        k = self.adj.sum(1)
        t = np.diag(r @ r @ r)
        return float(np.where(k > 1, t / np.maximum(k * (k - 1), 1), 0).mean())

    def resilience(self, n_steps: int = 10, order: np.ndarray | None = None) -> tuple[list[float], list[int]]:
        """Efficiency and size of the rest after each step of removal; targeted by degree unless an order is given."""
        if order is None:
            order = np.argsort(-self.adj.sum(1), kind="stable")
        per = max(1, self.n // n_steps)
        rest = [np.sort(order[s * per :]) for s in range(n_steps + 1)]
        return [self.efficiency(r) for r in rest], [len(r) for r in rest]

    def shortest_path(self, a: int, b: int, kind: str = "weight") -> tuple[float, list[int]]:
        """Distance and nodes of one shortest path between two node ids; infinite and empty if there is none."""
        at = {int(v): k for k, v in enumerate(self.nodes)}
        if a not in at or b not in at:
            return INF, []
        d = self.distances(kind)
        s, t = at[a], at[b]
        if not np.isfinite(d[s, t]):
            return INF, []
        cost = np.where(self.adj, {"hop": np.ones_like(self.w), "weight": self.w, "inverse": 1 / np.where(self.w > 0, self.w, 1)}[kind], INF)
        path = [t]
        while path[-1] != s:
            v = path[-1]
            path.append(int(np.flatnonzero(self.adj[:, v] & np.isclose(d[s] + cost[:, v], d[s, v]))[0]))
        return float(d[s, t]), [int(self.nodes[v]) for v in reversed(path)]


def _moves(w: np.ndarray, c: np.ndarray, resolution: float) -> tuple[np.ndarray, bool]:
    """Nodes in order go to the neighbouring community that raises Q most, or to one of their own, until none gains. Also whether any moved."""
    n, k, total = len(w), w.sum(1), w.sum()
    c, any_moved, moved = c.copy(), False, True
    mass = np.bincount(c, k, n)
    while moved:
        moved = False
        for v in range(n):
            links = np.bincount(c, w[v] * (np.arange(n) != v), n)
            mass[c[v]] -= k[v]
            gain = links - resolution * k[v] * mass / total
            best = int(np.argmax(gain))
            if gain[best] > gain[c[v]] + 1e-12:
                c[v] = best
                moved = any_moved = True
            mass[c[v]] += k[v]
    return c, any_moved


def _parts(w: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Communities split into their connected parts, each named by its first node."""
    same = (w > 0) & (c[:, None] == c[None, :])
    part = np.arange(len(w))
    while True:
        new = np.minimum(part, np.where(same, part[None, :], len(w)).min(1, initial=len(w)))
        if (new == part).all():
            return part
        part = new


def _folded(w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The graph of communities, and each node's place in it."""
    ids, at = np.unique(c, return_inverse=True)
    fold = np.zeros((len(ids), len(w)))
    fold[at, np.arange(len(w))] = 1
    return fold @ w @ fold.T, at


def louvain(g: Graph, resolution: float = 1.0) -> np.ndarray:
    """Communities by local moves and merging, nodes always in order."""
    w, member = g.w.copy(), np.arange(g.n)
    if not w.sum():
        return member
    while True:
        c, _ = _moves(w, np.arange(len(w)), resolution)
        small, at = _folded(w, c)
        member = at[member]
        if len(small) == len(w):
            return member
        w = small


def _refined(w: np.ndarray, c: np.ndarray, resolution: float) -> np.ndarray:
    """Inside each community, nodes that are well connected to it, and still alone, join the well-connected part that raises Q most."""
    n, k, total = len(w), w.sum(1), w.sum()
    part = np.arange(n)
    free = w * (1 - np.eye(n))
    inside = np.where(c[:, None] == c[None, :], free, 0.0)
    size = np.bincount(c, k, n)  # strength of each community
    mass, out = k.astype(float).copy(), inside.sum(1)  # of each part: strength, and links to the rest of its community
    alone = np.ones(n, bool)
    for v in range(n):
        whole = size[c[v]]
        if not alone[v] or out[v] < resolution * k[v] * (whole - k[v]) / total - 1e-12:
            continue
        links = np.bincount(part, inside[v], n)
        good = (links > 0) & (out >= resolution * mass * (whole - mass) / total - 1e-12) & (np.arange(n) != v)
        gain = np.where(good, links - resolution * k[v] * mass / total, -INF)
        best = int(np.argmax(gain))
        if gain[best] > 1e-12:
            out[best] += out[v] - 2 * links[best]
            mass[best] += k[v]
            mass[v] = out[v] = 0.0
            part[v] = best
            alone[v] = alone[best] = False
    return part


def _leiden(g: Graph, start: np.ndarray, resolution: float) -> np.ndarray:
    final = start
    while True:
        w, c, at = g.w.copy(), final, np.arange(g.n)
        while True:
            c, _ = _moves(w, c, resolution)
            part = _refined(w, c, resolution)
            small, place = _folded(w, part)
            if len(small) == len(w):
                break
            # The parts are the nodes of the next graph, and start in the communities that they are part of.
            first = np.zeros(len(small), np.int64)
            first[place] = c
            _, first = np.unique(first, return_inverse=True)
            w, c, at = small, first, place[at]
        now = _parts(g.w, c[at])
        now, moved = _moves(g.w, now, resolution)
        if not moved:
            return np.unique(now, return_inverse=True)[1]
        final = now


def leiden(g: Graph, resolution: float = 1.0) -> np.ndarray:
    """Communities by local moves, refinement and merging of the refined parts. Every community is connected, no move of one node raises Q, and Q is at least Louvain's.

    Passes are repeated from their own result until a node can't gain; should Louvain's result be better still, it is the start of further passes.
    """
    if not g.w.sum():
        return np.arange(g.n)
    got, other = _leiden(g, np.arange(g.n), resolution), louvain(g, resolution)
    if partition_quality(g, other) > partition_quality(g, got) + 1e-12:
        got = _leiden(g, other, resolution)
    return got


def partition_quality(g: Graph, member: np.ndarray) -> float:
    total = g.w.sum()
    if not total:
        return 0.0
    k = g.w.sum(1)
    same = member[:, None] == member[None, :]
    return float(((g.w - np.outer(k, k) / total) * same).sum() / total)


def per_graph(edges: DataFrame, keys: list[str], make: Callable[[Graph], dict], schema: str) -> DataFrame:
    """make() over each graph of the group columns; its columns come back beside the keys. One task holds one graph at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = make(Graph(pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf["weight"].to_numpy(float)))
        out = pd.DataFrame(got)
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edges.schema if f.name in keys)
    return edges.select(*keys, "i", "j", "weight").groupBy(*keys).applyInPandas(run, f"{kinds}, {schema}")


def node_metrics(edges: DataFrame, keys: list[str]) -> DataFrame:
    """degree, strength, betweenness, closeness, eigenvector, local efficiency per node, distances computed once per graph."""

    def make(g: Graph) -> dict:
        return {"node": g.nodes.astype(np.int64), "degree": g.adj.sum(1).astype(np.int64), "strength": g.w.sum(1), "betweenness": g.betweenness(), "closeness": g.closeness(), "eigenvector": g.eigenvector(), "local_efficiency": g.local_efficiency()}

    return per_graph(edges, keys, make, "node long, degree long, strength double, betweenness double, closeness double, eigenvector double, local_efficiency double")


def global_metrics(edges: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """One row per graph: efficiency, path length, clustering, Louvain and Leiden Q, small-world numbers against a seeded random graph."""

    def make(g: Graph) -> dict:
        m = int(np.triu(g.adj, 1).sum())
        rng = np.random.default_rng(seed)
        pairs = np.stack(np.triu_indices(g.n, 1), axis=1)
        pick = pairs[np.sort(rng.permutation(len(pairs))[:m])]
        r = Graph(pick[:, 0], pick[:, 1], np.ones(len(pick)))
        c, length, c_r, l_r = g.clustering(), g.path_length(), r.clustering(), r.path_length("hop")
        gamma, lam = (c / c_r if c_r > 0 else 0.0), (length / l_r if l_r > 0 else 0.0)
        return {
            "n": [g.n], "m": [m], "global_efficiency": [g.efficiency()], "path_length": [length], "clustering": [c],
            "louvain_q": [partition_quality(g, louvain(g))], "leiden_q": [partition_quality(g, leiden(g))],
            "gamma": [gamma], "lambda": [lam], "sigma": [gamma / lam if lam > 0 else 0.0],
        }

    cols = "n long, m long, global_efficiency double, path_length double, clustering double, louvain_q double, leiden_q double, gamma double, `lambda` double, sigma double"
    return per_graph(edges, keys, make, cols)


def communities(edges: DataFrame, keys: list[str], refine: bool = False) -> DataFrame:
    return per_graph(edges, keys, lambda g: {"node": g.nodes.astype(np.int64), "community": (leiden if refine else louvain)(g).astype(np.int64)}, "node long, community long")


def resilience(edges: DataFrame, keys: list[str], n_steps: int = 10, strategy: str = "targeted", seed: int = 0) -> DataFrame:
    def make(g: Graph) -> dict:
        order = None if strategy == "targeted" else np.random.default_rng(seed).permutation(g.n)
        e, n = g.resilience(n_steps, order)
        return {"step": np.arange(len(e)), "efficiency": e, "size": n}

    return per_graph(edges, keys, make, "step long, efficiency double, size long")


def hubs(nodes: DataFrame, share: float = 0.75) -> DataFrame:
    """Nodes above the given percentile in both degree and betweenness. The two cut-offs are one row, broadcast."""
    cut = nodes.agg(F.percentile("degree", share).alias("cd"), F.percentile("betweenness", share).alias("cb"))
    return nodes.crossJoin(F.broadcast(cut)).where((F.col("degree") > F.col("cd")) & (F.col("betweenness") > F.col("cb"))).drop("cd", "cb")
