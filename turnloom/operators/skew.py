"""Attaching a per-key result to rows whose keys may be very uneven."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/HOT_PARTS of all rows; so there are at most HOT_PARTS hot keys.
HOT_PARTS = 500


def attach(rows: DataFrame, per_key: DataFrame, keys: list[str], *, count: str = "_n") -> DataFrame:
    """Inner join of ``rows`` with ``per_key`` (one row per key, ``count`` = its number of rows), without ``count``.

    The rows of hot keys, at most :data:`HOT_PARTS` keys by construction, meet a
    broadcast table and never move; all others are joined by a shuffle in which
    no key holds more than 1/:data:`HOT_PARTS` of the rows. ``per_key`` is read
    several times: hand in a stored table. Null keys match nothing.
    """
    total, most = per_key.agg(F.sum(count), F.max(count)).first()
    if (most or 0) <= (total or 0) / HOT_PARTS:
        return rows.join(per_key.drop(count), keys)
    hot = F.col(count) > total / HOT_PARTS
    heavy = F.broadcast(per_key.where(hot))
    light = rows.join(F.broadcast(per_key.where(hot).select(*keys)), keys, "left_anti").join(per_key.where(~hot).drop(count), keys)
    return rows.join(heavy.drop(count), keys).unionByName(light)
