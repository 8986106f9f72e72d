"""Interaction graph and node metrics as DataFrame jobs.

Graph = vertex DataFrame(id) + edge DataFrame(src, dst) with src < dst.
Iterative metrics (PageRank, label propagation, BFS for betweenness) run one
join + aggregate per round and cut lineage with a reliable checkpoint.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import dense_rank_in_group

N_TIERS = 19            # 20 edges of linspace -> tiers 1..19
PEERS = 9               # each member with the next 9 in order
MAX_EDGES_PER_TIER = 200
#: Edges, counted both ways, up to which a task holds the graph to search for betweenness (16 bytes each).
TASK_EDGES = 20_000_000
DEFAULT_GRAPH_RISK = 0.15


# --- G01-G04: construction ----------------------------------------------------------

def follower_tiers(df: DataFrame, key: str = "account_id", followers: str = "followers") -> DataFrame:
    """Log-scale tier 1..19 of ln(1+followers) between min and max+1e-9."""
    lf = F.log(1 + F.coalesce(F.col(followers).cast("double"), F.lit(0.0)))
    base = df.select(F.col(key).alias("id"), lf.alias("lf"))
    r = base.agg(F.min("lf").alias("lo"), (F.max("lf") + 1e-9).alias("hi")).first()   # fitted edges
    lo, hi = F.lit(r["lo"]), F.lit(r["hi"])
    width = (hi - lo) / N_TIERS
    tier = F.least(F.lit(N_TIERS), F.floor((F.col("lf") - lo) / width) + 1).cast("int")
    return base.select("id", tier.alias("tier"))


def peer_pairs(tiers: DataFrame, peers: int = PEERS) -> DataFrame:
    """Each member paired with the next `peers` members of its tier in id
    order.  Rank inside the tier is a distributed prefix count (a tier may hold a
    third of all rows), then an equi-join on (tier, rank + k)."""
    ranked = dense_rank_in_group(tiers, "tier", ["id"], name="r")
    left = ranked.select("tier", F.col("id").alias("src"),
                         F.explode(F.sequence(F.lit(1), F.lit(peers))).alias("k"), "r") \
                 .select("tier", "src", (F.col("r") + F.col("k")).alias("r2"))
    right = ranked.select("tier", F.col("r").alias("r2"), F.col("id").alias("dst"))
    return left.join(right, ["tier", "r2"]).select("tier", "src", "dst")


def sample_per_tier(pairs: DataFrame, limit: int | None = MAX_EDGES_PER_TIER) -> DataFrame:
    """Keep <= limit pairs per tier chosen by md5 order (reproducible, no
    RNG stream).  Planned as WindowGroupLimit: map tasks pre-trim to `limit`
    rows per tier before the shuffle, so a hot tier moves at most limit rows
    per task."""
    if limit is None:
        return pairs
    w = Window.partitionBy("tier").orderBy(F.md5(F.concat_ws("-", "src", "dst")))
    return pairs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")


def simple_graph(edges: DataFrame) -> DataFrame:
    """Undirected simple graph: canonical (least, greatest), no loops, no duplicates."""
    e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return e.where(F.col("src") != F.col("dst")).dropDuplicates(["src", "dst"])


def interaction_graph(accounts: DataFrame, key="account_id", limit: int | None = None):
    """G01-G04 composed: (vertices, edges).  Every peer pair is an edge; `limit`
    (G03) is the caller's choice."""
    tiers = follower_tiers(accounts, key)
    edges = simple_graph(sample_per_tier(peer_pairs(tiers), limit))
    return tiers.select("id"), edges


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


# --- G08: degree ----------------------------------------------------------------------

def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    d = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return vertices.join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_centrality(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree / (n - 1)."""
    n = vertices.agg(F.count(F.lit(1))).scalar()
    d = degrees(vertices, edges)
    return d.select("id", F.when(n > 1, F.col("degree") / (n - 1)).otherwise(F.lit(0.0)).alias("degree_centrality"))


# --- G05: PageRank ---------------------------------------------------------------------

def pagerank(vertices: DataFrame, edges: DataFrame, alpha: float = 0.85, max_iter: int = 100,
             tol: float = 1e-6, fixed_rounds: int | None = None, checkpoint_every: int = 1) -> DataFrame:
    """Power iteration; dangling mass spread evenly; stop when the L1 change
    < n*tol (or after `fixed_rounds`).  One join + groupBy per round.  Raises
    RuntimeError if `max_iter` rounds do not get there."""
    deg = cut_lineage(degrees(vertices, edges))
    n = deg.count()
    e2 = cut_lineage(both_ways(edges))
    x = deg.select("id", "degree", F.lit(1.0 / n).alias("x"))
    rounds = fixed_rounds if fixed_rounds is not None else max_iter
    for i in range(rounds):
        dangle = x.where(F.col("degree") == 0).agg(F.coalesce(F.sum("x"), F.lit(0.0))).scalar()
        contrib = (e2.join(x.where(F.col("degree") > 0)
                           .select(F.col("id").alias("src"), (F.col("x") / F.col("degree")).alias("c")), "src")
                   .groupBy(F.col("dst").alias("id")).agg(F.sum("c").alias("s")))
        new = (x.select("id", "degree", F.col("x").alias("old")).join(contrib, "id", "left")
               .select("id", "degree", "old",
                       (alpha * F.coalesce(F.col("s"), F.lit(0.0)) + alpha * dangle / n + (1 - alpha) / n).alias("x")))
        new = cut_lineage(new) if (i + 1) % checkpoint_every == 0 else new
        if fixed_rounds is None:
            err = new.agg(F.sum(F.abs(F.col("x") - F.col("old")))).first()[0]
            x = new.drop("old")
            if err < n * tol:
                break
        else:
            x = new.drop("old")
    else:
        if fixed_rounds is None and n:
            raise RuntimeError(f"PageRank did not converge in {max_iter} rounds: change {err}, wanted below {n * tol}")
    return x.select("id", F.col("x").alias("pagerank"))


# --- G07: clustering coefficient ----------------------------------------------------------

def triangle_counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Triangles per node.  Edges are oriented from lower to higher (degree, id)
    so every triangle is found once from its lowest vertex and out-degrees stay
    below sqrt(2m): a hub does not become one huge wedge group (Suri &
    Vassilvitskii 2011)."""
    d = degrees(vertices, edges)
    e = edges.join(d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src") \
             .join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    lo_first = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    o = cut_lineage(e.select(F.when(lo_first, F.col("src")).otherwise(F.col("dst")).alias("a"),
                             F.when(lo_first, F.col("dst")).otherwise(F.col("src")).alias("b")))
    # wedge a->b, a->c with b < c (order inside the pair only to count once), closed by b-c in either orientation
    wedge = o.alias("x").join(o.alias("y"), F.col("x.a") == F.col("y.a")) \
             .where(F.col("x.b") < F.col("y.b")) \
             .select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("y.b").alias("c"))
    und = o.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"))
    tri = wedge.join(und, (F.least("b", "c") == F.col("p")) & (F.greatest("b", "c") == F.col("q"))) \
               .select("a", "b", "c")
    per = tri.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("t"))
    return d.join(per, "id", "left").select("id", "degree", F.coalesce("t", F.lit(0)).alias("triangles"))


def clustering(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """2T / (d (d-1)); degree < 2 -> 0."""
    t = triangle_counts(vertices, edges)
    return t.select("id", F.when(F.col("degree") < 2, F.lit(0.0))
                    .otherwise(2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1)))
                    .alias("clustering_coefficient"))


# --- G09-G10: communities ------------------------------------------------------------------

def label_propagation(vertices: DataFrame, edges: DataFrame, rounds: int | None = None, max_rounds: int = 100) -> DataFrame:
    """G09 (first stage): synchronous label propagation, start label = id; each
    node takes the most frequent neighbour label, ties to the smallest; a node
    without neighbours keeps its label.  Runs until no label changes and raises
    RuntimeError if `max_rounds` do not get there, or for the number of `rounds`
    that the caller names."""
    e2 = cut_lineage(both_ways(edges))
    lab = vertices.select("id", F.col("id").alias("community"))
    for _ in range(max_rounds if rounds is None else rounds):
        votes = (e2.join(lab.select(F.col("id").alias("src"), F.col("community").alias("c")), "src")
                 .groupBy(F.col("dst").alias("id"), "c").agg(F.count(F.lit(1)).alias("n")))
        best = votes.groupBy("id").agg(F.min_by("c", F.struct(-F.col("n"), F.col("c"))).alias("nc"))
        new = cut_lineage(lab.join(best, "id", "left").select("id", F.coalesce("nc", "community").alias("community"),
                                                              F.coalesce(F.col("nc") != F.col("community"), F.lit(False)).alias("_new")))
        lab = new.drop("_new")
        if rounds is None and new.filter("_new").isEmpty():
            return lab
    if rounds is None:
        raise RuntimeError(f"labels still changed after {max_rounds} rounds")
    return lab


def community_size_ratio(vertices: DataFrame, communities: DataFrame) -> DataFrame:
    """Size of the node's community / node count."""
    n = vertices.agg(F.count(F.lit(1))).scalar()
    sizes = communities.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return communities.join(sizes, "community").select("id", (F.col("size") / n).alias("community_size_ratio"))


# --- G11-G12 ------------------------------------------------------------------------------------

GRAPH_FEATURES = ["pagerank", "betweenness_centrality", "clustering_coefficient", "degree_centrality",
                  "community_size_ratio"]


def graph_features(vertices: DataFrame, edges: DataFrame, with_betweenness: bool = True,
                   communities: DataFrame | None = None, pivots: int | None = None) -> DataFrame:
    """5 metrics per node, missing -> 0 (left joins on id).  `communities`
    (id, community) are those of largest modularity unless given; `pivots` as in
    betweenness()."""
    from .communities import modularity_communities
    communities = modularity_communities(vertices, edges) if communities is None else communities
    out = vertices
    parts = [pagerank(vertices, edges), clustering(vertices, edges), degree_centrality(vertices, edges),
             community_size_ratio(vertices, communities)]
    if with_betweenness:
        parts.append(betweenness(vertices, edges, pivots))
    for p in parts:
        out = out.join(p, "id", "left")
    return out.select("id", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in out.columns
                              else F.lit(0.0).alias(c) for c in GRAPH_FEATURES])


def graph_risk(degree_centrality: Column | None = None, community_ratio: Column | None = None) -> Column:
    """clip(0.5*degree + 0.5*(1 - community ratio), 0, 1); without a graph 0.15."""
    if degree_centrality is None:
        return F.lit(DEFAULT_GRAPH_RISK)
    r = 0.5 * degree_centrality + 0.5 * (1 - community_ratio)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), r))


# --- G06: betweenness -------------------------------------------------------------------

def betweenness(vertices: DataFrame, edges: DataFrame, pivots: int | None = None, seed: int = 42) -> DataFrame:
    """Normalised betweenness (Brandes 2001) from every node or, if the
    caller asks for `pivots` (a number), from so many in md5(seed-id) order,
    rescaled by n/pivots.
    Forward: BFS frontier (source, node, dist, sigma) one level per join, each
    level checkpointed.  Edges go both ways, so a neighbour of a level lies in
    it, in the one before or in the next: only those two are anti-joined.
    Backward: dependencies accumulated level by level from the deepest one.
    Work and state grow with sources x nodes.  Up to TASK_EDGES edges a task
    holds the graph and searches from its share of the sources, since a chain of
    peers has more levels than jobs could be run for."""
    n = vertices.count()
    if n <= 2:
        return vertices.select("id", F.lit(0.0).alias("betweenness_centrality"))
    sources, kk = vertices, None
    if pivots is not None and pivots < n:
        sources = vertices.orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string"))), "id").limit(pivots)
        kk = pivots
    scale = 1.0 / ((n - 1) * (n - 2)) * (n / kk if kk else 1.0)
    e2 = cut_lineage(both_ways(edges))
    if e2.count() <= TASK_EDGES:
        total = _dependencies_in_tasks(cut_lineage(sources.dropna().distinct()), e2)
        bc = total.groupBy("id").agg((F.sum("delta") * scale).alias("betweenness_centrality"))
        return vertices.join(bc, "id", "left").select(
            "id", F.coalesce("betweenness_centrality", F.lit(0.0)).alias("betweenness_centrality"))
    front = cut_lineage(sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("sigma")))
    levels = [front]
    depth = 0
    while True:
        near = front.select("s", F.col("v").alias("w"))
        if depth:
            near = near.unionByName(levels[-2].select("s", F.col("v").alias("w")))
        nxt = (front.join(e2.select(F.col("src").alias("v"), F.col("dst").alias("w")), "v")
               .groupBy("s", "w").agg(F.sum("sigma").alias("sigma"))
               .join(near, ["s", "w"], "left_anti")
               .select("s", F.col("w").alias("v"), F.lit(depth + 1).alias("d"), "sigma"))
        nxt = cut_lineage(nxt)
        if nxt.isEmpty():
            break
        depth += 1
        levels.append(nxt)
        front = nxt
    # backward: delta(s,v) = sum over children w of sigma_v / sigma_w * (1 + delta_w)
    deltas = []
    child = None
    for lv in reversed(levels):
        if child is None:
            cur = lv.select("s", "v", "sigma", F.lit(0.0).alias("delta"))
        else:
            contrib = (lv.join(e2.select(F.col("src").alias("v"), F.col("dst").alias("w")), "v")
                       .join(child.select("s", F.col("v").alias("w"), F.col("sigma").alias("sw"),
                                          F.col("delta").alias("dw")), ["s", "w"])
                       .groupBy("s", "v").agg(F.sum(F.col("sigma") / F.col("sw") * (1 + F.col("dw"))).alias("delta")))
            cur = cut_lineage(lv.join(contrib, ["s", "v"], "left")
                              .select("s", "v", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta")))
        deltas.append(cur.where(F.col("s") != F.col("v")).select("v", "delta"))
        child = cur
    total = deltas[0]
    for dlt in deltas[1:]:
        total = total.unionByName(dlt)
    bc = total.groupBy(F.col("v").alias("id")).agg((F.sum("delta") * scale).alias("betweenness_centrality"))
    return vertices.join(bc, "id", "left").select(
        "id", F.coalesce("betweenness_centrality", F.lit(0.0)).alias("betweenness_centrality"))


def _dependencies(src: np.ndarray, dst: np.ndarray, sources: np.ndarray):
    """Node ids and Brandes' dependencies on them, summed over the sources other than the node itself.  `src`, `dst`
    hold every edge both ways."""
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = at[:len(src)], at[len(src):]
    order = np.argsort(a, kind="stable")
    to = b[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(ids)))])

    def edges_of(nodes):
        size = start[nodes + 1] - start[nodes]
        first = np.repeat(start[nodes] - (np.cumsum(size) - size), size)
        return np.repeat(nodes, size), to[first + np.arange(size.sum())]

    out = np.zeros(len(ids))
    for s in np.flatnonzero(np.isin(ids, sources)):
        dist, sigma, delta = np.full(len(ids), -1), np.zeros(len(ids)), np.zeros(len(ids))
        dist[s], sigma[s] = 0, 1.0
        levels = [np.array([s])]
        while len(levels[-1]):
            v, w = edges_of(levels[-1])
            new = dist[w] < 0
            v, w = v[new], w[new]
            near, place = np.unique(w, return_inverse=True)
            sigma[near] = np.bincount(place, sigma[v], len(near))
            dist[near] = len(levels)
            levels.append(near)
        for d in range(len(levels) - 2, 0, -1):                  # the source itself is left out
            v, w = edges_of(levels[d])
            down = dist[w] == d + 1
            v, w = v[down], w[down]
            place = np.searchsorted(levels[d], v)
            delta[levels[d]] = np.bincount(place, sigma[v] / sigma[w] * (1 + delta[w]), len(levels[d]))
        out += delta
    return ids, out


def _dependencies_in_tasks(sources: DataFrame, e2: DataFrame) -> DataFrame:
    """(id, delta): every task gets the edges once and a share of the sources."""
    spark = sources.sparkSession
    shares = max(1, min(sources.count(), 2 * spark.sparkContext.defaultParallelism))
    kind = e2.schema["src"].dataType.simpleString()

    def run(s: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(s) or not len(e):
            return pd.DataFrame({"id": [], "delta": []})
        ids, delta = _dependencies(e["src"].to_numpy(), e["dst"].to_numpy(), s["id"].to_numpy())
        return pd.DataFrame({"id": ids[delta != 0], "delta": delta[delta != 0]})

    share = F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int").alias("share")
    every = e2.select("src", "dst", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    return sources.select("id", share).groupBy("share").cogroup(every.groupBy("share")).applyInPandas(run, f"id {kind}, delta double")
