"""Carry-over of conversation slots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def carry_over(turns: DataFrame, session: str, order: str, slots: Sequence[str], never: Sequence[str] = (), profile: DataFrame | None = None) -> DataFrame:
    """Each slot of each turn: this turn's, else the last one said, else the profile's; `never` slots aren't carried.

    origin_<slot> is turn, carried or profile, null where there is no value.
    """
    w = W.partitionBy(session).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = turns if profile is None else turns.join(profile.select(session, *[F.col(s).alias(f"_p_{s}") for s in slots]), session, "left")
    for s in slots:
        said = F.col(s)
        held = said if s in never else F.last(s, ignorenulls=True).over(w)
        base = F.lit(None).cast("string") if profile is None else F.col(f"_p_{s}")
        out = out.withColumn(f"_v_{s}", F.coalesce(held, base)).withColumn(f"origin_{s}", F.when(said.isNotNull(), "turn").when(held.isNotNull(), "carried").when(base.isNotNull(), "profile"))
    keep = [c for c in turns.columns if c not in slots]
    return out.select(*keep, *[F.col(f"_v_{s}").alias(s) for s in slots], *[f"origin_{s}" for s in slots])
