"""Idempotent upsert by business key: the last record of a key in a run is inserted, replaces what differs, or changes nothing."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.cleaners import strip
from millrace.functions.schema import METADATA
from millrace.session import small


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, that with the greatest order; folded before the shuffle, so a hot key is no hot task."""
    rows = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("_last"))
    return rows.select("_last.*")


def _state(kind: T.DataType, col: Column) -> Column:
    """A value without what only says when it was processed, at every depth."""
    if isinstance(kind, T.StructType):
        parts = [_state(f.dataType, col[f.name]).alias(f.name) for f in kind.fields if f.name not in METADATA and f.name != "timestamp"]
        return F.when(col.isNotNull(), F.struct(*parts)) if parts else F.lit(None)
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _state(kind.elementType, x))
    return col


def business_state(df: DataFrame, prefix: str = "", leave: tuple[str, ...] = ()) -> Column:
    """A struct of the fields that make the state of a row: two rows are equal if these are."""
    fields = [f for f in df.schema.fields if f.name not in METADATA and f.name not in leave]
    return F.struct(*[_state(f.dataType, F.col(f"{prefix}{f.name}")).alias(f.name) for f in fields])


class Upsert(NamedTuple):
    merged: DataFrame  # the new target, each row with _action: inserted, updated, unchanged or kept
    source: DataFrame  # the last record of each key

    def counts(self) -> dict[str, int]:
        found = {r["_action"]: r["count"] for r in self.merged.groupBy("_action").count().collect()}  # at most four rows
        return {a: found.get(a, 0) for a in ("inserted", "updated", "unchanged")}

    def table(self) -> DataFrame:
        return self.merged.drop("_action")


def touched(target: DataFrame, source: DataFrame, key: str = "id_order") -> DataFrame:
    """The rows of target whose key source has; keys of a checked size are brought to the target, so that it is not shuffled."""
    keys = source.select(F.nullif(strip(F.col(key)), F.lit("")).alias("_touched")).where("_touched is not null").distinct()
    return target.join(small(keys), target[key] == F.col("_touched"), "left_semi")


def upsert(target: DataFrame, source: DataFrame, now: str, key: str = "id_order", order: str = "_row", updated: str = "updated_at") -> Upsert:
    """Merge source into target, which has one row for each key.

    Rows with a blank key are skipped. A new row keeps its own update time or gets now; a changed one always gets now; an equal one
    leaves the target as it is. Columns only one side has are null on the other.
    """
    rows = source.withColumn(key, F.nullif(strip(F.col(key)), F.lit(""))).where(F.col(key).isNotNull())
    last = keep_last(rows, key, order).drop(order)
    names = [*target.columns, *[c for c in last.columns if c not in target.columns]]
    old, new = target, last
    for c in names:
        if c not in old.columns:
            old = old.withColumn(c, F.lit(None).cast(new.schema[c].dataType))
        if c not in new.columns:
            new = new.withColumn(c, F.lit(None).cast(old.schema[c].dataType))
    new = new.select(*[F.col(c).cast(old.schema[c].dataType) for c in names])
    old_side = old.select(F.col(key).alias("_old_key"), F.struct(*names).alias("_old"), business_state(old).alias("_old_state"))
    new_side = new.select(F.col(key).alias("_new_key"), F.struct(*names).alias("_new"), business_state(new).alias("_new_state"))
    both = old_side.join(new_side, F.col("_old_key") == F.col("_new_key"), "full")
    action = F.when(F.col("_new_key").isNull(), "kept").when(F.col("_old_key").isNull(), "inserted").when(F.col("_old_state").eqNullSafe(F.col("_new_state")), "unchanged").otherwise("updated")
    both = both.withColumn("_action", action)
    stays = F.col("_action").isin("kept", "unchanged")
    columns = []
    for c in names:
        value = F.when(stays, F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}"))
        if c == updated:
            value = F.when(stays, F.col(f"_old.{c}")).when(F.col("_action") == "updated", F.lit(now)).otherwise(F.coalesce(F.nullif(F.col(f"_new.{c}"), F.lit("")), F.lit(now)))
        columns.append(value.alias(c))
    return Upsert(both.select(*columns, "_action"), last)
