"""Queries for tree attributions (X01) and the choice of explainer."""

from pyspark.sql import functions as F

from ..operators import attribution as A
from ..operators.features import FEATURE_NAMES
from ..session import cut_lineage
from . import flow
from .common import round_doubles, with_accounts
from .registry import query
from .sql_features import FEATURES_SQL

#: Trees of two levels: (root feature, feature of the left child, feature of the right one).  Cuts are the means of
#: the labelled accounts that reach a node, leaf values their mean label; one tree splits twice on a feature.
TREES = [("log_followers", "posts_per_day", "bio_length"),
         ("followers_ratio", "log_followers", "followers_ratio"),
         ("username_entropy", "username_entropy", "digit_ratio")]
USED = [n for n in FEATURE_NAMES if any(n in t for t in TREES)]
SIDES = [(a, b) for a in "LR" for b in "LR"]


def mean_trees(lab):
    """The TREES over labelled rows as leaf-path rows: one aggregate each for cuts, children's cuts and leaves."""
    col = lambda n: F.col(f"f_{n}")
    cuts = lab.agg(*[F.round(F.avg(col(t[0])), 3).alias(f"c{i}") for i, t in enumerate(TREES)]).first()

    def at(i, side):
        return col(TREES[i][0]) <= cuts[f"c{i}"] if side == "L" else col(TREES[i][0]) > cuts[f"c{i}"]

    low = lab.agg(*[F.round(F.avg(F.when(at(i, s), col(t["LR".index(s) + 1]))), 3).alias(f"c{i}{s}")
                    for i, t in enumerate(TREES) for s in "LR"]).first()
    if low is None or any(x is None for x in low):
        return lab.sparkSession.createDataFrame([], A.PATHS)

    def below(i, a, b):
        c = col(TREES[i]["LR".index(a) + 1])
        return at(i, a) & ((c <= low[f"c{i}{a}"]) if b == "L" else (c > low[f"c{i}{a}"]))

    sums = lab.agg(F.count(F.lit(1)).alias("n"),
                   *[F.count(F.when(at(i, s), 1)).alias(f"n{i}{s}") for i in range(len(TREES)) for s in "LR"],
                   *[x for i in range(len(TREES)) for a, b in SIDES
                     for x in (F.count(F.when(below(i, a, b), 1)).alias(f"n{i}{a}{b}"),
                               F.avg(F.when(below(i, a, b), F.col("label"))).alias(f"v{i}{a}{b}"))]).first()
    rows = []
    for i, t in enumerate(TREES):
        for leaf, (a, b) in enumerate(SIDES):
            if not sums[f"n{i}{a}{b}"]:
                continue
            path = {}
            for f, side, cut, share in ((t[0], a, cuts[f"c{i}"], sums[f"n{i}{a}"] / sums["n"]),
                                        (t["LR".index(a) + 1], b, low[f"c{i}{a}"], sums[f"n{i}{a}{b}"] / sums[f"n{i}{a}"])):
                lo, hi, r = path.get(f, (None, None, 1.0))
                lo, hi = (lo, cut if hi is None else min(hi, cut)) if side == "L" else (cut if lo is None else max(lo, cut), hi)
                path[f] = (lo, hi, r * share)
            rows += [(i, leaf, float(sums[f"v{i}{a}{b}"]), FEATURE_NAMES.index(f), *p) for f, p in path.items()]
    return lab.sparkSession.createDataFrame(rows, A.PATHS)


def _sql() -> str:
    """Shapley values of paths of one or two features, written out."""
    fits, terms, base = [], {n: [] for n in USED}, []
    for i, t in enumerate(TREES):
        f, kids = t[0], {"L": t[1], "R": t[2]}
        at = {"L": f"{f} <= c", "R": f"{f} > c"}
        below = {(a, b): f"{at[a]} AND {kids[a]} {'<=' if b == 'L' else '>'} c{a}" for a, b in SIDES}
        fits.append(f"r{i} AS (SELECT round(avg({f}), 3) AS c FROM lab)")
        fits.append(f"k{i} AS (SELECT c, " + ", ".join(f"round(avg({kids[a]}) FILTER ({at[a]}), 3) AS c{a}" for a in "LR")
                    + f" FROM lab, r{i} GROUP BY c)")
        fits.append(f"t{i} AS (SELECT c, cL, cR, count(*) AS n, " + ", ".join(f"count(*) FILTER ({at[a]}) AS n{a}" for a in "LR")
                    + ", " + ", ".join(f"count(*) FILTER ({w}) AS n{a}{b}, coalesce(avg(label) FILTER ({w}), 0) AS v{a}{b}"
                                       for (a, b), w in below.items()) + f" FROM lab, k{i} GROUP BY c, cL, cR)")
        for a, b in SIDES:
            x = lambda c, i=i: f"t{i}.{c}"
            oa = f"CAST({f} {'<=' if a == 'L' else '>'} {x('c')} AS DOUBLE)"
            ob = f"CAST({kids[a]} {'<=' if b == 'L' else '>'} {x('c' + a)} AS DOUBLE)"
            ra, rb, v = f"({x('n' + a)} / {x('n')})", f"({x('n' + a + b)} / {x('n' + a)})", x(f"v{a}{b}")
            base.append(f"{v} * {ra} * {rb}")
            if kids[a] == f:
                terms[f].append(f"{v} * ({oa} * {ob} - {ra} * {rb})")
            else:
                terms[f].append(f"{v} * ({oa} - {ra}) * ({ob} + {rb}) / 2")
                terms[kids[a]].append(f"{v} * ({ob} - {rb}) * ({oa} + {ra}) / 2")
    phi = {n: " + ".join(x) for n, x in terms.items()}
    body = ", ".join(f"round({e}, 6) AS phi_{n}" for n, e in phi.items())
    total = " + ".join([*base, *phi.values()])
    return with_accounts(f"SELECT account_id, round({' + '.join(base)}, 6) AS base, round({total}, 6) AS output, {body} "
                         f"FROM features, {', '.join(f't{i}' for i in range(len(TREES)))}",
                         FEATURES_SQL, "lab AS (SELECT * FROM features WHERE label IS NOT NULL)", *fits)


@query("x01_tree_attributions", _sql())
def x01_tree_attributions(spark, sf_dir):
    """Every account's output of the mean trees, split into base and features."""
    f = flow.feature_table(spark, sf_dir, with_graph=False)
    paths = mean_trees(f.where(F.col("label").isNotNull()))
    x = F.array(*[F.col(f"f_{n}").cast("double") for n in FEATURE_NAMES])
    base = A.leaves(paths).agg(A.base_value(paths).alias("b")).first()["b"] or 0.0
    phi = A.attribution_rows(f, paths, "account_id", x)
    wide = (phi.groupBy("account_id").pivot("feature", [FEATURE_NAMES.index(n) for n in USED]).agg(F.sum("phi"))
            .select("account_id", *[F.coalesce(F.col(str(FEATURE_NAMES.index(n))), F.lit(0.0)).alias(f"phi_{n}") for n in USED]))
    total = F.lit(base) + sum((F.col(f"phi_{n}") for n in USED), F.lit(0.0))
    return round_doubles(wide.select("account_id", F.lit(base).alias("base"), total.alias("output"), *[f"phi_{n}" for n in USED]))


@query("x04_explainer_choice")
def x04_explainer_choice(spark, sf_dir):
    """Top attributions of every account by the explainer that the fitted models allow: with trees and without."""
    bundle = flow.train(spark, sf_dir, boost_iters=20, with_graph=False, models=["xgboost", "naive_bayes"], oof_folds=2)
    # read by the attributions and the ranking of both explainers
    scored = cut_lineage(flow.score_table(flow.feature_table(spark, sf_dir, with_graph=False), bundle))
    out = None
    for models in (bundle["models"], {"naive_bayes": bundle["models"]["naive_bayes"]}):
        got = flow.explain_scores(scored, bundle | {"models": models})
        got = got.select("account_id", F.lit(A.choose_explainer(models)).alias("explainer"),
                         F.posexplode("top_attributions").alias("rank", "a")).select("account_id", "explainer", "rank", "a.*")
        out = got if out is None else out.unionByName(got)
    return out
