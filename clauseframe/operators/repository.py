"""Repository operations as snapshots: a change is a new frame that is written beside the old one.

Upserts, guarded inserts, cascading deletes, expiry, versions that are active, candidate or retired, and cache lookups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import manifest_hash


def upsert(snapshot: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Changed rows replace those of the same key, others are added; of several changes of one key the last in ``changes``' own
    order has to be chosen before."""
    return snapshot.join(changes.select(key), key, "left_anti").unionByName(changes)


def insert_unique(snapshot: DataFrame, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(snapshot with the new rows, rejected rows): a key that exists, or comes twice, is rejected."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    counted = rows.withColumn("_n", n).join(snapshot.select(key, F.lit(True).alias("_known")), key, "left")
    ok = F.col("_known").isNull() & (F.col("_n") == 1)
    return snapshot.unionByName(counted.where(ok).drop("_n", "_known")), counted.where(~ok).drop("_n", "_known")


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, child_key: str, parent_key: str) -> tuple[DataFrame, DataFrame]:
    """(parents, children) after the children in ``gone`` went, and every parent that has none left because of it."""
    left = children.join(gone.select(child_key), child_key, "left_anti")
    hit = children.join(gone.select(child_key), child_key, "left_semi").select(parent_key).distinct()
    orphaned = hit.join(left.select(parent_key).distinct(), parent_key, "left_anti")
    return parents.join(orphaned, parent_key, "left_anti"), left


def unexpired(df: DataFrame, expires: str, now: Column) -> DataFrame:
    return df.where(F.col(expires).isNull() | (F.col(expires) > now))


def versions(df: DataFrame, keys: list[str], at: str, *tie: str) -> DataFrame:
    """valid_from, valid_to and status of each row: the latest of a key is ACTIVE, the others RETIRED."""
    window = Window.partitionBy(*keys).orderBy(at, *tie)
    to = F.lead(at).over(window)
    return df.withColumn("valid_from", F.col(at)).withColumn("valid_to", to).withColumn("status", F.when(F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), *(F.desc(t) for t in tie))) == 1, "ACTIVE").otherwise("RETIRED"))


def activate(states: DataFrame, approvals: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """A candidate whose identity equals its approval in every part becomes ACTIVE; what was active before becomes RETIRED."""
    a = approvals.select(key, *(F.col(c).alias(f"_{c}") for c in identity), F.lit(True).alias("_asked"))
    joined = states.join(a, key, "left")
    same = F.coalesce(F.col("_asked"), F.lit(False))
    for c in identity:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    match = (F.col("status") == "CANDIDATE") & same
    flipped = F.max(match.cast("int")).over(Window.partitionBy(key)) == 1
    status = F.when(match, "ACTIVE").when(flipped & (F.col("status") == "ACTIVE"), "RETIRED").otherwise(F.col("status"))
    return joined.withColumn("_flip", status).drop("status").withColumnRenamed("_flip", "status").select(*states.columns)


def change_decision(official_same: Column, text_same: Column, staged: Column) -> Column:
    """What a check of a monitored source means; nulls stand for a first check."""
    return (
        F.when(official_same.isNull(), "FIRST_VERSION").when(official_same & text_same, "UNCHANGED").when(F.coalesce(staged, F.lit(False)), "ALREADY_STAGED").when(~official_same & text_same, "OFFICIAL_UPDATE_PENDING").otherwise("CANDIDATE")
    )


def retained_ratio(active: Column, candidate: Column) -> Column:
    """The share of the active keys that the candidate keeps; 0 without active keys."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(active, candidate)), F.size(active)), F.lit(0.0))


def auto_approvable(active: Column, candidate: Column, matched: Column, settled_hours: Column, least_ratio: float = 0.9, least_hours: float = 24.0) -> Column:
    return (F.size(active) > 0) & matched & (settled_hours >= least_hours) & (retained_ratio(active, candidate) >= least_ratio)


def cache_hits(requests: DataFrame, keys: list[str], at: str, ttl: str, *tie: str) -> DataFrame:
    """``hit``: whether the same key was asked for within the time before. A window, so that no request meets all others."""
    before = F.lag(at).over(Window.partitionBy(*keys).orderBy(at, *tie))
    return requests.withColumn("hit", F.coalesce(before > F.col(at) - F.expr(f"INTERVAL {ttl}"), F.lit(False)))


def owned(df: DataFrame, owner: Column, column: str = "user_id") -> DataFrame:
    """The rows of one owner; a row or an owner that is null belongs to nobody."""
    return df.where(F.col(column) == owner)


def public(df: DataFrame, *private: str) -> DataFrame:
    """``df`` without its private columns; naming one that it lacks is an error, so that a renamed column cannot leak."""
    if missing := [c for c in private if c not in df.columns]:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    return df.drop(*private)


def update_fields(snapshot: DataFrame, changes: DataFrame, key: str, *fields: str) -> DataFrame:
    """``snapshot`` with ``fields`` as ``changes`` (one row a key) has them, a null there unsets a field; other rows stay as they are."""
    new = changes.select(key, F.struct(*fields).alias("_new"))
    joined = snapshot.join(new, key, "left")
    return joined.select(*(F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in snapshot.columns))


def unlink(snapshot: DataFrame, field: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """``snapshot`` with ``field`` null where it names a key of ``gone``."""
    left = gone.select(F.col(gone_key).alias(field)).distinct().withColumn("_gone", F.lit(True))
    joined = snapshot.join(left, field, "left")
    return joined.select(*(F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == field else F.col(c) for c in snapshot.columns))


def hydrated(records: DataFrame, chunks: DataFrame, version: str, ordinal: str, identity: list[str], value: str, strict: bool = False) -> DataFrame:
    """``records`` with ``value`` from ``chunks`` of the same version, and ``found_by``.

    PLACE: the chunk at the record's ordinal has its identity. Else IDENTITY: one single chunk of the version has it. Else null, or,
    if ``strict``, an error when the row is computed.
    """
    place = chunks.select(version, ordinal, *identity, F.col(value).alias("_place"), F.lit(True).alias("_at")).dropDuplicates([version, ordinal, *identity])
    single = chunks.groupBy(version, *identity).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_single")).where("_n = 1")
    joined = records.join(place, [version, ordinal, *identity], "left").join(single, [version, *identity], "left")
    by = F.when(F.col("_at"), "PLACE").when(F.col("_n") == 1, "IDENTITY")
    if strict:
        by = by.otherwise(F.raise_error(F.lit("a record's text is no longer in its source")).cast("string"))
    return joined.select(*records.columns, F.when(F.col("_at"), F.col("_place")).otherwise(F.col("_single")).alias(value), by.alias("found_by"))


def previous_version(history: DataFrame) -> DataFrame:
    """``history`` (analysis_id, contract_id, previous_contract_id, at) with previous_analysis_id: the latest analysis, ties to the
    larger id, of the agreement that this one replaced; null where there is none."""
    newest = history.groupBy(F.col("contract_id").alias("previous_contract_id")).agg(F.max(F.struct("at", "analysis_id"))["analysis_id"].alias("previous_analysis_id"))
    return history.join(newest, "previous_contract_id", "left").select(*history.columns, "previous_analysis_id")


def content_key(version: str, *columns: str) -> Column:
    """The SHA-256 of what a computation depends on: the version of its code and the columns, by name and in order, nulls included."""
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("version"), *columns), {"ignoreNullFields": "false"}), 256)


def official_fingerprint(laws: DataFrame, bindings: DataFrame, key: str, fields: list[str], binding_id: str, binding_fields: list[str]) -> DataFrame:
    """(key, fingerprint): changes with the named fields of a law, or of one of its bindings, and not with their order."""
    rows = bindings.select(key, binding_id, F.to_json(F.struct(binding_id, *binding_fields), {"ignoreNullFields": "false"}).alias("_row"))
    bound = manifest_hash(rows, [key], binding_id, "_row", "_bound")
    own = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return laws.join(bound.select(key, "_bound"), key, "left").select(key, F.sha2(F.concat_ws("\n", own, F.coalesce("_bound", F.lit(""))), 256).alias("fingerprint"))


def health(laws: DataFrame, vectors: DataFrame, status: str = "status") -> DataFrame:
    """One row (active_laws, active_vectors)."""
    rows = laws.select(F.col(status).alias("_s"), F.lit(1).alias("_law")).unionByName(vectors.select(F.col(status).alias("_s"), F.lit(0).alias("_law")))
    of = lambda law: F.count_if(F.coalesce((F.col("_s") == "ACTIVE") & (F.col("_law") == law), F.lit(False)))
    return rows.agg(of(1).alias("active_laws"), of(0).alias("active_vectors"))


def as_read(df: DataFrame, **defaults: Column) -> DataFrame:
    """``df`` as readers expect it: a field that old records lack, or have as null, has its default."""
    return df.withColumns({c: F.coalesce(F.col(c), d) if c in df.columns else d for c, d in defaults.items()})
