"""Column expressions shared by the operators.  All JVM-side (codegen)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def num(df: DataFrame, name: str, default: float | None = 0.0) -> Column:
    """Numeric coercion, unparsable -> missing -> default; absent column -> default."""
    if name not in df.columns:
        return F.lit(default).cast("double")
    c = F.col(name).try_cast("double") if dict(df.dtypes)[name] == "string" else F.col(name).cast("double")
    return c if default is None else F.coalesce(c, F.lit(float(default)))


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip; NULL stays NULL (least/greatest skip NULL, so guard it)."""
    out = c
    if hi is not None:
        out = F.least(out, F.lit(hi))
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    return F.when(c.isNull(), F.lit(None)).otherwise(out)


def guarded_ratio(a: Column, b: Column) -> Column:
    """a/b when b > 0 else 0 (ANSI-safe)."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def text(c: Column | str) -> Column:
    """Missing text reads as '' (trap T4: never the string 'nan')."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def entropy(u: Column, nan_is_empty: bool = False) -> Column:
    """Shannon entropy (log2) of the characters of a string; '' -> 0."""
    n = F.length(u).cast("double")
    chars = F.array_distinct(F.split(u, ""))
    h = F.aggregate(
        chars, F.lit(0.0),
        lambda acc, ch: acc - ((n - F.length(F.replace(u, ch, F.lit(""))))
                               / n) * F.log2((n - F.length(F.replace(u, ch, F.lit("")))) / n))
    out = F.when(F.length(u) == 0, F.lit(0.0)).otherwise(h)
    if nan_is_empty:
        out = F.when(u == "nan", F.lit(0.0)).otherwise(out)
    return F.coalesce(out, F.lit(0.0))


def repeat_char_count(u: Column) -> Column:
    """positions whose character equals the previous one."""
    return F.regexp_count(u, F.lit(r"(?s)(.)(?=\1)"))


def digit_count(u: Column) -> Column:
    """Unicode digits, like Python's \\d."""
    return F.regexp_count(u, F.lit(r"(?U)\d"))


def contains_flag(c: Column, pattern: str) -> Column:
    return F.when(c.rlike(pattern), F.lit(1)).otherwise(F.lit(0))


def let(value: Column, fn) -> Column:
    """Bind an expression once and use it many times inside `fn` (keeps large
    expressions small: no repeated sub-trees)."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def py_fixed(x: Column, d: int) -> Column:
    """Python's f'{x:.{d}f}' as a JVM expression: round half-even on the exact
    binary value (Java's %f rounds the shortest decimal half-up, trap T8).
    x = m * 2^-s with an integer mantissa m < 2^53; x*10^d = m*10^d / 2^s is
    split into quotient/remainder with exact DECIMAL(38,0) arithmetic."""
    if d > 4:
        raise ValueError("py_fixed supports up to 4 decimals")
    unit = F.lit(10 ** d).cast("decimal(38,0)")
    one = F.lit(1).cast("long")

    def pow2(k):
        return (F.call_function("shiftleft", one, F.least(k, F.lit(62))).cast("decimal(38,0)")
                * F.call_function("shiftleft", one, F.greatest(k - 62, F.lit(0))).cast("decimal(38,0)"))

    def from_k(k):
        if d == 0:
            return k.cast("string")
        return F.concat(F.floor(k / unit).cast("decimal(38,0)").cast("string"), F.lit("."),
                        F.lpad(F.pmod(k, unit).cast("decimal(38,0)").cast("string"), d, "0"))

    def with_s(ax, s):
        return let(ax * F.pow(F.lit(2.0), s), lambda mf: let(
            mf.cast("long").cast("decimal(38,0)") * unit, lambda n: let(
                pow2(s), lambda den: let(
                    F.floor(n / den).cast("decimal(38,0)"), lambda q: let(
                        n - q * den, lambda r: from_k((q + F.when(2 * r > den, 1).when(2 * r < den, 0)
                                                       .otherwise(F.pmod(q, F.lit(2)))).cast("decimal(38,0)")))))))

    def body(ax):
        e1 = F.floor(F.log2(ax))
        return let(ax * F.pow(F.lit(2.0), 52 - e1), lambda m1: let(
            (52 - F.when(m1 >= 2.0 ** 53, e1 + 1).when(m1 < 2.0 ** 52, e1 - 1).otherwise(e1)).cast("int"),
            lambda s: F.when(ax < 1e-12, from_k(F.lit(0).cast("decimal(38,0)")))
                       .when(s <= 0, from_k((ax.cast("decimal(38,0)") * unit).cast("decimal(38,0)")))
                       .otherwise(with_s(ax, s))))

    digits = let(F.abs(x.cast("double")), body)
    neg = (x < 0) | (x.cast("string") == "-0.0")
    out = F.when(neg, F.concat(F.lit("-"), digits)).otherwise(digits)
    return F.when(x.isNull(), F.lit(None)).when(F.isnan(x), F.lit("nan")).otherwise(out)
