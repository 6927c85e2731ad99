"""A stand-in for text embeddings where no model is at hand: hashed words, normalised."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def hashed_words(text: Column, size: int = 64) -> Column:
    """A unit vector of signed counts of a text's lower-cased words; zeros for a text without words, null for a null one.

    Texts with many words in common are near each other by cosine; meaning has no part in it. Words are cut and hashed by Spark and
    counted in Arrow batches, as lambdas over arrays would pass over the whole vector for every word.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    spots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(2 * size)).cast("int"))

    @F.pandas_udf(ArrayType(DoubleType()))
    def counted(spots: pd.Series) -> pd.Series:
        def one(s: np.ndarray | None) -> np.ndarray | None:
            if s is None:
                return None
            n = np.bincount(np.asarray(s, np.int64), minlength=2 * size)
            # The two signs of dimension k are spots 2k and 2k + 1.
            v = (n[::2] - n[1::2]).astype(np.float64)
            unit = np.sqrt(v @ v)
            return v / unit if unit > 0 else v

        return spots.map(one, na_action=None)

    return counted(spots)
