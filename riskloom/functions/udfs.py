"""Arrow-batched pandas UDFs: only where no built-in expression exists.

(No postponed annotations here: pandas_udf reads the type hints at runtime.)
"""

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.functions import arrow_udf, pandas_udf


@pandas_udf("string")
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC fold per Arrow batch."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x) if isinstance(x, str) else x)


def fourier_map(W: np.ndarray, b: np.ndarray):
    """sqrt(2/D) cos(W x + b) of an array column."""
    scale = np.sqrt(2.0 / W.shape[0])

    @pandas_udf("array<double>")
    def mapped(x: pd.Series) -> pd.Series:
        return pd.Series(list(scale * np.cos(np.stack(x.to_numpy()) @ W.T + b)) if len(x) else [], dtype=object)
    return mapped


def loading_sums(loadings: list[list[float]]):
    """Component columns -> array of the sums over components of value * loading, added in the order of the components."""
    V = np.asarray(loadings, dtype=np.float64)

    @arrow_udf("array<double>")
    def sums(*components: pa.Array) -> pa.Array:
        out = np.zeros((len(components[0]), V.shape[1]))
        for c, row in zip(components, V):
            out = out + c.to_numpy(zero_copy_only=False)[:, None] * row
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * V.shape[1], pa.int32()), pa.array(out.ravel()))
    return sums
