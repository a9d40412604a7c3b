"""Referential integrity: orphan references kept as signed counts per key.

Both sides are change deltas. A reference delta adds or removes one reference to a key; the existence of a key follows
from its versions, of which the newest decides. Counts and newest versions are plain aggregates with map-side partials,
so a key that holds a third of all rows reaches the shuffle as one row per input partition; two states merge by the
same aggregates, which keeps the report current without reading old deltas again. Keys with positive references and no
existence form the report; only the references to these keys, and to keys that came after a reference, are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reference_counts(deltas: DataFrame, key: str, at: str, sign: str | None = None) -> DataFrame:
    """(key, refs, earliest): signed number of references to each non-null key and the earliest time of one. Without a sign column every row adds one."""
    step = F.lit(1) if sign is None else F.col(sign)
    return deltas.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.sum(step.cast("bigint")).alias("refs"), F.min(at).alias("earliest"))


def merge_references(old: DataFrame, new: DataFrame) -> DataFrame:
    """Reference counts after more deltas."""
    return old.unionByName(new).groupBy("key").agg(F.sum("refs").alias("refs"), F.min("earliest").alias("earliest"))


def _exist(gone_at: Column, newest: Column) -> Column:
    """1 while the newest version isn't a deletion; a deletion wins a tie."""
    return F.when(gone_at.isNotNull() & (gone_at >= newest), 0).otherwise(1).cast("bigint")


def existence_state(versions: DataFrame, key: str, at: str, deleted: str) -> DataFrame:
    """(key, exist, first_at, last_at, gone_at): state of each non-null key after all its versions.

    ``exist`` is 1 while the newest version (by ``at``; a deletion wins a tie; null times are oldest) isn't a deletion,
    else 0; ``last_at`` and ``gone_at`` are the times of the newest version and of the newest deletion. A null deletion
    flag means not deleted.
    """
    known = F.coalesce(F.col(at), F.lit("1000-01-01").cast(versions.schema[at].dataType))
    times = versions.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(at).alias("at"), known.alias("known"), F.coalesce(F.col(deleted), F.lit(False)).alias("gone"))
    state = times.groupBy("key").agg(F.min("at").alias("first_at"), F.max("known").alias("last_at"), F.max(F.when(F.col("gone"), F.col("known"))).alias("gone_at"))
    return state.select("key", _exist(F.col("gone_at"), F.col("last_at")).alias("exist"), "first_at", "last_at", "gone_at")


def merge_existence(old: DataFrame, new: DataFrame) -> DataFrame:
    """State after more versions: the two states' keys with the newer version of each and the earliest first time."""
    state = old.unionByName(new).groupBy("key").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.max("gone_at").alias("gone_at"))
    return state.select("key", _exist(F.col("gone_at"), F.col("last_at")).alias("exist"), "first_at", "last_at", "gone_at")


def orphan_keys(refs: DataFrame, state: DataFrame) -> DataFrame:
    """(key, refs, kind): keys with positive references and no existence; kind is ``missing`` or ``deleted``."""
    return suspect_keys(refs, state).filter("kind <> 'late'").select("key", "refs", "kind")


def suspect_keys(refs: DataFrame, state: DataFrame) -> DataFrame:
    """(key, refs, kind, first_at): the orphan keys, and with kind ``late`` those that exist but came after a reference to them."""
    kind = F.when(F.col("exist").isNull(), "missing").when(F.col("exist") == 0, "deleted").when(F.col("first_at") > F.col("earliest"), "late")
    found = refs.filter("refs > 0").join(state.select("key", "exist", "first_at"), "key", "left").select("key", "refs", kind.alias("kind"), "first_at")
    return found.filter("kind IS NOT NULL")


def orphan_references(edges: DataFrame, id_column: str, key: str, at: str, state: DataFrame) -> DataFrame:
    """(id_column, kind, at): each reference without a target at its time.

    kind is ``missing`` where no version of the key exists, else ``deleted`` where it doesn't exist now, else ``late``
    where its first version is newer than the reference. References with a null key are none; a null time is never late.
    The keys come from the signed counts; a key with many references is split by adaptive execution, as the left side of
    an inner join may be.
    """
    suspects = suspect_keys(reference_counts(edges, key, at), state).select("key", "kind", "first_at")
    asked = edges.filter(F.col(key).isNotNull()).select(F.col(id_column), F.col(key).alias("key"), F.col(at).alias("_at"))
    found = asked.join(suspects, "key").filter((F.col("kind") != "late") | (F.col("first_at") > F.col("_at")))
    return found.select(id_column, "kind", F.col("_at").alias(at))
