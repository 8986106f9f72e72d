"""Communities by modularity, as rounds of joins.

A graph is its weighted adjacency in both directions, (src, dst, w) with one
row (i, i) for what a contracted node holds inside.  A level moves nodes into
the neighbouring community with the largest modularity gain, one part of the
nodes (by hash, dealt anew each time) a round, so that most neighbours of a
mover stand still; a round that lowers the modularity all the same is taken
back and the parts are halved.  When no node moves any more, communities become
the nodes of the next level, until a level gains nothing.

All weights are counts, so sums are exact in any order, gains compare equal on
any partitioning and ties go to the smallest community: the result depends on
the graph alone.  Nothing but totals reaches the driver.

A round reads the edges of the nodes that may move and, for the modularity,
those of the nodes that did; it writes the nodes alone, as a table whose size
Spark knows, so that small sides are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .graph import both_ways

#: A level ends when a whole deal gains less than the first, the levels when one gains less than the second.
DEAL_GAIN = 1e-3
MIN_GAIN = 1e-7
MAX_PARTS = 16
MAX_ROUNDS = 400


def _squares(state: DataFrame, total: int) -> DataFrame:
    """One row: the sum of the communities' squared shares, as decimals: the same in any order."""
    square = F.pow(F.col("t").cast("double") / total, F.lit(2)).cast("decimal(38,20)")
    return state.groupBy("community").agg(F.sum("k").alias("t")).agg(F.sum(square).alias("square"))


def _gained(adjacency: DataFrame, state: DataFrame) -> DataFrame:
    """One row: by how much the moves of `state` change the weight inside communities, and whether there are any.
    Only rows out of moved nodes are read; one into a node that stayed stands for its reverse too."""
    return (state.filter("community != was").selectExpr("id AS src", "community", "was").join(adjacency, "src")
            .join(state.selectExpr("id AS dst", "community AS cd", "was AS wd"), "dst")
            .selectExpr("sum((IF(community = cd, 1L, 0L) - IF(was = wd, 1L, 0L)) * w * IF(cd = wd, 2L, 1L)) AS more",
                        "count(*) AS rows"))


def _value(adjacency: DataFrame, state: DataFrame, total: int, inside: int) -> tuple[float, int, bool]:
    """Modularity of the state, its weight inside communities (`inside` before its moves), and whether a node moved."""
    square, gained = (_squares(state, total).selectExpr("square", "CAST(NULL AS long) AS more", "CAST(NULL AS long) AS rows")
                      .unionByName(_gained(adjacency, state).selectExpr("CAST(NULL AS decimal(38,20)) AS square", "more", "rows"))
                      .collect())
    if gained["rows"] is None:
        square, gained = gained, square
    inside += gained["more"] or 0
    return inside / total - float(square["square"] or 0), inside, gained["rows"] > 0


def _moved(adjacency: DataFrame, state: DataFrame, total: int, parts: int, part: int, deal: int) -> DataFrame:
    """The state after the nodes of one part have moved; `was` is the community before."""
    mover = f"pmod(xxhash64({{}}, {deal}), {parts}) = {part}"
    tot = state.groupBy(F.col("community").alias("c")).agg(F.sum("k").alias("t"))
    around = adjacency.filter(mover.format("src")).join(state.selectExpr("id AS dst", "community AS c"), "dst")
    # the node's own community is always a candidate, also if no edge leads into it
    rows = (around.selectExpr("src AS id", "k", "c", "IF(src != dst, w, 0L) AS w", "false AS own")
            .unionByName(state.filter(mover.format("id")).selectExpr("id", "k", "community AS c", "0L AS w", "true AS own"))
            .groupBy("id", "k", "c").agg(F.sum("w").alias("w"), F.max("own").alias("own")).join(tot, "c"))
    gain = f"CAST(w AS double) - CAST(k AS double) * CAST(t - IF(own, k, 0L) AS double) / {total}"
    goes = (rows.selectExpr("id", "c", "own", f"{gain} AS gain").groupBy("id")
            .agg(F.expr("min(struct(-gain AS less, c)) AS b"), F.expr("max(IF(own, gain, NULL)) AS stay"),
                 F.expr("max(IF(own, c, NULL)) AS own"))
            .filter("-b.less > stay + 1e-9D AND b.c != own").selectExpr("id", "b.c AS to"))
    return state.join(goes, "id", "left").selectExpr("id", "k", "coalesce(to, community) AS community", "community AS was")


def _level(adjacency: DataFrame, total: int) -> tuple[DataFrame, float, float]:
    """(state, modularity before, modularity after) of one level's moves; `adjacency` with the degree k of src."""
    state = settle(adjacency.groupBy(F.col("src").alias("id")).agg(F.max("k").alias("k"))
                   .select("id", "k", F.col("id").alias("community"), F.col("id").alias("was")))
    inside = adjacency.agg(F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("w"))), F.lit(0))).first()[0]
    value, inside, _ = _value(adjacency, state, total, inside)
    first = value
    parts, deal, rounds = 2, 0, 0
    while True:
        deal, before, finer = deal + 1, value, False
        for part in range(parts):
            rounds += 1
            if rounds > MAX_ROUNDS:
                raise RuntimeError(f"communities still changed after {MAX_ROUNDS} rounds of one level")
            new = settle(_moved(adjacency, state, total, parts, part, deal))
            new_value, new_inside, moves = _value(adjacency, new, total, inside)
            if moves and new_value > value:
                state, value, inside = new, new_value, new_inside
            elif moves and parts < MAX_PARTS:
                parts, finer = parts * 2, True                   # taken back; fewer at a time
                break
        if not finer and value - before < DEAL_GAIN:
            return state, first, value


def _weighted(rows: DataFrame) -> DataFrame:
    """(src, dst, w) with the degree k of src, kept for a level."""
    rows = settle(rows)
    return settle(rows.join(rows.groupBy("src").agg(F.sum("w").alias("k")), "src"))


def modularity(edges: DataFrame, communities: DataFrame) -> float:
    """Modularity of (id, community) over simple edges (src, dst); 0 without edges."""
    adjacency = both_ways(edges).withColumn("w", F.lit(1).cast("long"))
    total = adjacency.count()
    if not total:
        return 0.0
    degree = adjacency.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    state = settle(communities.join(degree, "id", "left").select("id", F.coalesce("k", F.lit(0)).alias("k"), "community"))
    inside = (adjacency.join(state.select(F.col("id").alias("src"), F.col("community").alias("a")), "src")
              .join(state.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst").filter("a = b").count())
    return inside / total - float(_squares(state, total).first()["square"] or 0)


def modularity_communities(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, community), the community named by its smallest id.

    `edges` (src, dst) are simple and undirected, each once.  Defined results:
    a node without edges is a community of its own; repeated vertices count
    once; an empty graph gives an empty result.
    """
    labels = settle(vertices.select("id").distinct().withColumn("community", F.col("id")))
    adjacency = _weighted(both_ways(edges).withColumn("w", F.lit(1).cast("long")))
    total = adjacency.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    if not total:
        return labels
    while True:
        state, before, after = _level(adjacency, total)
        if after - before < MIN_GAIN:
            return labels
        # communities take the name of their smallest member and become nodes; a node without edges keeps its own
        names = state.groupBy("community").agg(F.min("id").alias("name"))
        step = settle(state.join(names, "community").select("id", "name"))
        labels = settle(labels.filter("community IS NOT NULL").join(step.withColumnRenamed("id", "community"), "community", "left")
                        .select("id", F.coalesce("name", "community").alias("community")))
        adjacency = _weighted(
            adjacency.join(step.select(F.col("id").alias("src"), F.col("name").alias("a")), "src")
            .join(step.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst")
            .groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
