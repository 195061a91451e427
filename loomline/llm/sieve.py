"""Picking a part of a wide table by its ids without moving the rest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_PER_ID = 16
MOST_BITS = 1 << 27  # 16 MB, whatever the number of ids


def with_ids(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose ``id_col`` is among the distinct ids of ``ids`` (one column i).

    A bitmap of hashed ids, of bounded size, is broadcast first, so rows that are
    not wanted are dropped where they are read; the join that follows is exact. Where
    the bitmap is full it lets more rows through to the join, never fewer.
    """
    bits = 1 << 10
    wanted = ids.count() * BITS_PER_ID
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    marks = ids.select(F.pmod(F.xxhash64("i"), F.lit(bits)).alias("at")).selectExpr("cast(at div 64 as int) as word", "shiftleft(1L, cast(at % 64 as int)) as mark")
    words = marks.groupBy("word").agg(F.bit_or("mark").alias("bits")).toArrow()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    @F.pandas_udf("boolean")
    def among(places: pd.Series) -> pd.Series:
        at = places.to_numpy(np.int64)
        return pd.Series((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0)

    near = rows.where(F.col(id_col).isNotNull()).where(among(F.pmod(F.xxhash64(id_col), F.lit(bits))))
    return near.join(ids, F.col(id_col) == F.col("i"), "left_semi")
