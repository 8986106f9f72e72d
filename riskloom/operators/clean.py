"""P-series: coercion, flags, de-duplication, constant columns, stripping,
outlier capping, adversarial text normalisation, entropy and imputation.

Every operator is DataFrame -> DataFrame.  Column statistics (quantiles, modes,
min/max) are computed in one aggregate and referenced through a scalar
subquery, so nothing is collected to the driver and no cross join is planned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import entropy
from ..session import cut_lineage
from .ordering import running_totals

# Fixed values that must equal the reference.
LEET_FROM = "013457@$"          # 0->o 1->i 3->e 4->a 5->s 7->t @->a $->s
LEET_TO = "oieastas"
ZERO_WIDTH_CLASS = "[\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}\\x{00AD}]"   # U+200B/C/D, U+FEFF, U+00AD
# Python's str.isspace() set, spelled out so Java and RE2 agree (trap T11).
WS_CLASS = ("[\\t\\n\\x{0B}\\f\\r \\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
            "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]")
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]


# --- P02-P04, P06: flag parsers ------------------------------------------------

def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def yes_no_flag(c: Column) -> Column:
    """yes/y -> 1, anything else (n, other, missing) -> 0."""
    return F.when(F.lower(strip_ws(c)).isin("yes", "y"), F.lit(1)).otherwise(F.lit(0))


def class_to_label(c: Column) -> Column:
    """P03: 'real' -> 0, everything else incl. missing -> 1."""
    return F.when(F.lower(strip_ws(c)) == "real", F.lit(0)).otherwise(F.lit(1))


def presence_length(c: Column, length: int = 80) -> Column:
    """upper(strip(x)) != 'N' -> 80 else 0 (missing reads 'nan' -> present)."""
    return F.when(F.upper(strip_ws(F.coalesce(c, F.lit("nan")))) != "N", F.lit(length)).otherwise(F.lit(0))


def url_flag(c: Column, pattern: str = r"http[s]?://|www\.") -> Column:
    """Regex flag on text."""
    return F.when(F.coalesce(c, F.lit("")).rlike(pattern), F.lit(1)).otherwise(F.lit(0))


# --- P07: exact de-duplication ---------------------------------------------------

def dedup(df: DataFrame, content_cols: list[str] | None = None) -> DataFrame:
    """Drop exact duplicates over content columns (NULLs compare equal).
    Pass the content columns: generated keys make every row unique (trap T7)."""
    return df.dropDuplicates(content_cols) if content_cols else df.dropDuplicates()


# --- P08: constant columns -------------------------------------------------------

def constant_column_report(df: DataFrame, skip=("label", "_source", "username", "bio")) -> DataFrame:
    """P08 report: one row per column, is_constant when <=1 distinct non-missing value.
    One mergeable min/max aggregate; no distinct shuffle."""
    cols = [c for c in df.columns if c not in skip]
    aggs = [F.struct(F.lit(c).alias("column_name"),
                     F.min(c).eqNullSafe(F.max(c)).cast("int").alias("is_constant")) for c in cols]
    return df.agg(F.array(*aggs).alias("r")).select(F.inline("r"))


def drop_constant_columns(df: DataFrame, skip=("label", "_source", "username", "bio")) -> DataFrame:
    """The drop itself changes the schema, so it needs the one-row report."""
    const = {r["column_name"] for r in constant_column_report(df, skip).collect() if r["is_constant"]}
    return df.drop(*const)


# --- P09: strip ------------------------------------------------------------------

def strip_strings(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Strip Unicode white space on string columns; NULL stays NULL (T4)."""
    cols = cols or string_columns(df)
    return df.select(*[strip_ws(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


# --- P10: IQR capping ------------------------------------------------------------

def exact_quantiles(df: DataFrame, cols: list[str], shares: tuple[float, ...]) -> dict[str, list[float] | None]:
    """Interpolated quantiles of each column's non-null values, None without any.
    Values are counted per (column, value) and ranked by a distributed prefix
    sum, so neither one column nor one value gathers in a task; at most two
    values per column and share reach the driver."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("x"))
                                for i, c in enumerate(cols)]))
    counts = (df.select(cells.alias("c")).select("c.i", "c.x").where(F.col("x").isNotNull())
              .groupBy("i", "x").agg(F.count(F.lit(1)).alias("n")))
    ranked = cut_lineage(running_totals(counts, ["x"], ["n"], "i"))
    sizes = {r["i"]: r["n"] for r in ranked.groupBy("i").agg(F.sum("n").alias("n")).collect()}
    places = {(i, math.floor(s * (n - 1)) + up) for i, n in sizes.items() for s in shares for up in (0, 1)}
    if not places:
        return dict.fromkeys(cols)
    wanted = df.sparkSession.createDataFrame(sorted(places), "i int, k long")
    held = ranked.join(F.broadcast(wanted), "i").where(
        (F.col("k") >= F.col("cum_n")) & (F.col("k") < F.col("cum_n") + F.col("n"))).select("i", "k", "x").collect()
    at = {(r["i"], r["k"]): r["x"] for r in held}
    out: dict[str, list[float] | None] = {}
    for i, c in enumerate(cols):
        out[c] = None
        if i in sizes:
            spots = [s * (sizes[i] - 1) for s in shares]
            lows = [math.floor(p) for p in spots]
            out[c] = [at[i, k] if p == k or at[i, k] == at[i, k + 1] else (k + 1 - p) * at[i, k] + (p - k) * at[i, k + 1]
                      for p, k in zip(spots, lows)]
    return out


def iqr_bounds(df: DataFrame, cols: list[str], k: float = 5.0, approx: bool = False,
               accuracy: int = 100_000) -> dict:
    """Fit (Q1, Q3) per column -> {col: (lo, hi)}: exact_quantiles, or with
    `approx=True` the mergeable sketch in one aggregate."""
    if approx:
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), [0.25, 0.75], accuracy).alias(c) for c in cols]).first()
    else:
        row = exact_quantiles(df, cols, (0.25, 0.75))
    out = {}
    for c in cols:
        q1, q3 = (row[c] or [None, None])
        out[c] = (None, None) if q1 is None else (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return out


def iqr_cap(df: DataFrame, cols: list[str] | None = None, k: float = 5.0, approx: bool = False,
            skip_binary: bool = False) -> DataFrame:
    """P10: clip each numeric column (except label) to [Q1-k*IQR, Q3+k*IQR].
    NULL stays NULL.  `skip_binary` leaves 0/1 flags alone (trap T1)."""
    cols = cols or numeric_columns(df, exclude=("label",))
    if skip_binary:
        cols = [c for c in cols if dict(df.dtypes)[c] not in ("int", "boolean")]
    b = iqr_bounds(df, cols, k, approx)
    out = []
    for c in df.columns:
        if c in cols and b[c][0] is not None:
            x = F.col(c).cast("double")
            out.append(F.when(x.isNull(), F.lit(None))
                       .otherwise(F.least(F.greatest(x, F.lit(b[c][0])), F.lit(b[c][1]))).alias(c))
        elif c in cols:
            out.append(F.col(c).cast("double").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


# --- P11-P14: adversarial normalisation -----------------------------------------

def remove_zero_width(c: Column) -> Column:
    """P11"""
    return F.regexp_replace(c, ZERO_WIDTH_CLASS, "")


def leet_fold(c: Column) -> Column:
    """P13"""
    return F.translate(c, LEET_FROM, LEET_TO)


def nfkc(c: Column) -> Column:
    """Unicode NFKC fold (no built-in; Arrow-batched pandas UDF).  ASCII is its own fold and stays in the JVM."""
    from ..functions.udfs import nfkc as _nfkc
    wide = c.rlike(r"[^\x00-\x7F]")
    return F.coalesce(_nfkc(F.when(wide, c)), c)


def adversarial_normalise(df: DataFrame, text_cols=("username", "bio"), leet_cols=("username",),
                          keep_raw: bool = True) -> DataFrame:
    """P14 = P11 -> P12 -> P13.  With keep_raw the raw username is kept as
    `username_raw` so digit features can be counted before folding (trap T3)."""
    out = df
    if keep_raw and "username" in df.columns:
        out = out.withColumn("username_raw", F.col("username"))
    for c in text_cols:
        if c in df.columns:
            x = nfkc(remove_zero_width(F.col(c)))
            if c in leet_cols:
                x = leet_fold(x)
            out = out.withColumn(c, x)
    return out


# --- P15 --------------------------------------------------------------------------

def add_username_entropy(df: DataFrame, col: str = "username") -> DataFrame:
    """Entropy column; ''/'nan' -> 0, NULL -> 0."""
    if col not in df.columns:
        return df
    return df.withColumn("username_entropy", entropy(F.coalesce(F.col(col), F.lit("")), nan_is_empty=True))


# --- P16: mode imputation ------------------------------------------------------------

def modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mode per column: highest count, ties to the smallest value.
    Partial-aggregated group counts, then a max over (count, -value) per column."""
    parts = []
    for c in cols:
        g = (df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).count()
             .agg(F.min_by(F.col("v"), F.struct(-F.col("count"), F.col("v"))).alias("mode"),
                  F.max("count").alias("mode_count"))
             .select(F.lit(c).alias("column_name"), "mode", "mode_count"))
        parts.append(g)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mode_impute(df: DataFrame, cols: list[str] | None = None,
                skip=("_source", "username", "bio")) -> DataFrame:
    """Fill NULLs of categorical columns with their mode (scalar subquery)."""
    cols = cols or string_columns(df, exclude=skip)
    if not cols:
        return df
    m = {r["column_name"]: r["mode"] for r in modes(df, cols).collect()}     # one row per column
    return df.select(*[F.coalesce(F.col(c), F.lit(m.get(c)).cast(dict(df.dtypes)[c])).alias(c) if c in cols
                       else F.col(c) for c in df.columns])


# --- P18-P21 ---------------------------------------------------------------------------

def falsy_default(c: Column, default) -> Column:
    """P20: Python `x or d` on numbers: NULL and 0 become d."""
    return F.when(c.isNull() | (c == 0), F.lit(default)).otherwise(c)


def falsy_default_str(c: Column, default: str) -> Column:
    return F.when(c.isNull() | (c == ""), F.lit(default)).otherwise(c)


def round_half_even(c: Column, n: int) -> Column:
    """Python round() is half-even."""
    return F.bround(c, n)
