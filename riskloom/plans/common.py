"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.accounts import ACCOUNTS_SQL, accounts
from ..sources.tables import Tables

DIGITS = 6


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """T-checked outputs are rounded on both sides (Spark and the oracle)."""
    return df.select(*[F.round(F.col(n), digits).alias(n) if t in ("double", "float") else F.col(n)
                       for n, t in df.dtypes])


def with_accounts(sql_body: str, *more_ctes: str) -> str:
    ctes = ",\n".join((ACCOUNTS_SQL,) + more_ctes)
    return f"WITH {ctes}\n{sql_body}"


def acc(spark, sf_dir) -> DataFrame:
    return accounts(Tables(spark, sf_dir))
