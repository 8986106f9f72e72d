"""Mixing sources to target weights by capped water-filling.

Targets: all words are shared over the sources by weight; a source whose share
exceeds `max_epochs` times its size is clamped there and the excess is shared
again over the others, until no share is above its cap.  Each round is one
aggregation over the source table; the sources stay in Spark.

Sampling: target / size repetitions are a whole part, which every document of
the source gets, and a fractional part, which goes to the documents that come
first in the source by a seeded hash until their words fill it.  The document
on the border gives the first words that are still wanted, so that a source's
taken words equal its target rounded down.  The border is found by a distributed
prefix sum over (source, hash); a source that holds a third of the rows is
range-partitioned like the rest, and no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import running_totals
from .common import cut_lineage, read_table

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = 42
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_weights(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sizes (source, size) -> plus weight, cycling over the sources by code point, null last."""
    ordered = running_totals(
        sizes.withColumn("_last", F.col("source").isNull()).withColumn("_key", F.coalesce("source", F.lit("")))
        .withColumn("_one", F.lit(1)), ["_last", "_key"], ["_one"]).withColumnRenamed("cum__one", "_at")
    values = F.array(*[F.lit(float(w)) for w in weights])
    return ordered.select("source", "size", F.element_at(values, (F.col("_at") % len(weights) + 1).cast("int"))
                          .alias("weight"))


def water_fill(weighted: DataFrame, max_epochs: float = MAX_EPOCHS, total: float | None = None) -> DataFrame:
    """(source, size, weight) -> plus target.  `total` words are shared (all of
    them by default); if all caps together hold less, every source is at its cap."""
    w = cut_lineage(weighted.withColumn("cap", F.col("size") * float(max_epochs)))
    if total is None:
        total = float(w.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    open_, level, left = F.lit(True), 0.0, float(total)
    clamped = -1
    while True:
        # a source is clamped for good once its share at the present level exceeds its cap
        over = F.col("weight") * F.lit(level) > F.col("cap")
        row = w.agg(F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)).alias("held"),
                    F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("weight"),
                    F.count(F.when(over, 1)).alias("n")).first()
        if row["n"] == clamped or not row["weight"]:
            break
        clamped, level = row["n"], max(0.0, left - row["held"]) / row["weight"]
    share = F.least(F.col("weight") * F.lit(level), F.col("cap"))
    return w.withColumn("target", share if row["weight"] else F.col("cap")).drop("cap")


def _mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS,
        seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The columns of `docs` as c0, c1, ... and size, source_size, target, whole, part."""
    cols = docs.columns
    src = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(cols)],
                      docs[id_col].cast("string").alias("_id"), docs[text_col].alias("_text"),
                      docs[source_col].cast("string").alias("_source"))
    src = (src.withColumn("_size", word_count(F.col("_text")))
           .withColumn("_order", F.xxhash64(F.lit(seed), "_id", "_text")).drop("_id", "_text"))
    narrow = cut_lineage(src.groupBy(F.col("_source").alias("source"), "_order", "_size")
                         .agg(F.count(F.lit(1)).alias("rows"))
                         .withColumn("size", F.col("_size") * F.col("rows")))
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("size"))
    plan = cut_lineage(
        water_fill(source_weights(sizes, weights), max_epochs)
        .withColumn("whole", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0))
        .withColumn("need", F.greatest(F.lit(0), F.floor("target").cast("long") - F.col("whole") * F.col("size"))))
    # the group of equal rows on the border of each source: its order and the words still wanted there
    ranked = running_totals(narrow.withColumn("_key", F.coalesce("source", F.lit("")))
                            .withColumn("_none", F.col("source").isNull())
                            .withColumn("_g", F.struct("_none", "_key")),
                            ["_order", "_size"], ["size"], "_g")
    border = (ranked.select("source", "_order", "_size", "rows", "size", "cum_size").alias("r")
              .join(plan.select(F.col("source").alias("s"), "need").filter("need > 0"),
                    F.col("source").eqNullSafe(F.col("s")))
              .filter((F.col("cum_size") <= F.col("need")) & (F.col("need") < F.col("cum_size") + F.col("size")))
              .select("s", F.struct("_order", "_size").alias("edge"),
                      F.floor((F.col("need") - F.col("cum_size")) / F.col("rows")).cast("long").alias("edge_words")))
    plan = cut_lineage(plan.join(border, plan["source"].eqNullSafe(border["s"]), "left").drop("s"))
    here = F.struct("_order", "_size")
    part = (F.when((F.col("need") <= 0) | (F.col("_size") == 0), 0)
            .when(F.col("edge").isNull() | (here < F.col("edge")), F.col("_size"))
            .when(here == F.col("edge"), F.col("edge_words")).otherwise(0).cast("long"))
    return (src.join(plan.withColumnRenamed("size", "source_size"), src["_source"].eqNullSafe(plan["source"]))
            .select(*[F.col(f"c{i}") for i in range(len(cols))], F.col("_size").alias("size"), "source_size", "target",
                    F.when(F.col("_size") > 0, F.col("whole")).otherwise(0).cast("int").alias("whole"),
                    part.alias("part")))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All rows of `docs` plus mix, a struct of size, source_size, target, whole
    (repetitions of the whole document) and part (words of one more repetition,
    from the front); the words taken are size * whole + part.

    Defined results: a null text has size 0 and takes nothing; a null source is
    a source of its own, last; equal rows share what the border leaves them, the
    same words each; an empty table gives an empty result; docs may have any
    other columns (one named mix is replaced).  No document exceeds
    ceil(max_epochs) times its size.
    """
    got = _mixed(docs, weights, max_epochs, seed, id_col, text_col, source_col)
    return got.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c != "mix"],
                      F.struct("size", "source_size", "target", "whole", "part").alias("mix"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS,
                    seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source") -> DataFrame:
    """The mix itself, in the columns of `docs`: each row as often as it is
    taken.  A fractional repetition on a source's border holds its first words,
    space-joined, and n_chars, where there is one, is counted anew."""
    cols = docs.columns
    got = _mixed(docs, weights, max_epochs, seed, id_col, text_col, source_col)
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(cols)]
    times = F.col("whole") + F.when((F.col("part") > 0) & (F.col("part") == F.col("size")), 1).otherwise(0)
    whole = got.withColumn("n", F.explode(F.sequence(F.lit(0), times))).filter("n > 0").select(*back)
    text = F.col(f"c{cols.index(text_col)}")
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    border = (got.filter("part > 0 and part < size")
              .withColumn("cut", F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), " ")))
    new = {text_col: F.col("cut")}
    if "n_chars" in cols:
        new["n_chars"] = F.length("cut").cast(docs.schema["n_chars"].dataType)
    return whole.unionByName(border.select(*[new.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(cols)]))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "mix.size", "mix.source_size", "mix.target",
                            (F.col("mix.size") * F.col("mix.whole") + F.col("mix.part")).alias("taken"))
