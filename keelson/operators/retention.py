"""Chain-aware retention: whole cohorts are kept or go together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.functions.text import blank_to_null, object_id, uri_scheme
from keelson.operators.chains import effective_chain
from keelson.plans.scans import running_rank, top_per_key
from keelson.session import materialise

#: Fixed value: chains the automatic cleanup after a run keeps.
CLEANUP_KEEP = 5

#: Groups the cohorts of a database are limited in before the last limit.
COHORT_SALTS = 64


def split_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) rules: keep-last must be positive when set, days must not be negative when set."""
    bad = F.coalesce(F.col("keep_last") <= 0, F.lit(False)) | F.coalesce(F.col("retention_days") < 0, F.lit(False))
    return rules.filter(~bad), rules.filter(bad)


def rule_from_settings(jobs: DataFrame) -> DataFrame:
    """Rule columns from a job's two text settings; what is no number counts as 0."""
    keep = F.coalesce(F.expr("try_cast(keep_last_setting as int)"), F.lit(0))
    days = F.coalesce(F.expr("try_cast(retention_days_setting as int)"), F.lit(0))
    given = (keep > 0) | (days > 0)
    return jobs.withColumn("keep_last", F.when(given, F.when(keep > 0, keep).otherwise(F.lit(1)))).withColumn(
        "retention_days", F.when(given, days)
    )


def rules_by_database(jobs: DataFrame) -> DataFrame:
    """(db, keep_last, retention_days): the rules of each database's jobs (database, two text settings) that decide.

    Every job cleans up after itself, so a backup goes when any rule gives it up. A rule that keeps at least as many chains and
    days as another one of the database gives up nothing more and is left out, as are invalid rules.
    """
    valid, _ = split_rules(rule_from_settings(jobs).filter("keep_last is not null"))
    # one row per database and count before anything is ordered
    shortest = valid.groupBy(F.col("database").alias("db"), "keep_last").agg(F.min("retention_days").alias("retention_days"))
    fewer = Window.partitionBy("db").orderBy("keep_last").rowsBetween(Window.unboundedPreceding, -1)
    reached = shortest.withColumn("_least", F.min("retention_days").over(fewer))
    return reached.filter("_least is null or retention_days < _least").drop("_least")


def cohorts(resolved: DataFrame) -> DataFrame:
    """(db, eff_chain, latest, members) from records that carry ``eff_chain``."""
    return resolved.groupBy(F.coalesce("profile_name", F.lit("default")).alias("db"), "eff_chain").agg(
        F.max(F.coalesce("end_time", "start_time")).alias("latest"), F.count(F.lit(1)).alias("members")
    )


def newest_first() -> list[Column]:
    return [F.col("latest").desc_nulls_last(), F.col("eff_chain").asc_nulls_first()]


def newest_cohorts(groups: DataFrame, keep_last: int) -> DataFrame:
    """The newest ``keep_last`` cohorts of each database with their ``rank``, an integer."""
    return top_per_key(groups, ["db"], newest_first(), keep_last, salts=COHORT_SALTS)


def fresh_enough(asof: Column, days: Column) -> Column:
    """Not older than ``days`` before ``asof``; exactly on the cutoff counts as fresh."""
    return F.coalesce(F.col("latest") >= asof - F.make_dt_interval(days), F.lit(False))


def doomed_cohorts(
    groups: DataFrame, asof: Column, keep_last: int | None = None, retention_days: int | None = None
) -> DataFrame:
    """Cohorts neither rule keeps. With no rule nothing is doomed."""
    check_rule(keep_last, retention_days)
    if keep_last is None and retention_days is None:
        return groups.limit(0)
    left = groups
    if retention_days is not None:
        left = left.filter(~fresh_enough(asof, F.lit(retention_days)))
    if keep_last is not None:
        kept = newest_cohorts(groups, keep_last).select("db", "eff_chain")
        same = (F.col("g.db") == F.col("k.db")) & F.col("g.eff_chain").eqNullSafe(F.col("k.eff_chain"))
        left = left.alias("g").join(kept.alias("k"), same, "left_anti")
    return left


def check_rule(keep_last: int | None, retention_days: int | None) -> None:
    if keep_last is not None and keep_last <= 0:
        raise ValueError("keep_last must be greater than 0")
    if retention_days is not None and retention_days < 0:
        raise ValueError("retention_days must be 0 or more")


def members_of(resolved: DataFrame, groups: DataFrame) -> DataFrame:
    """Whole records of the given cohorts; equal records collapse to one."""
    wanted = groups.select(F.col("db").alias("_db"), F.col("eff_chain").alias("_chain"))
    same = (F.coalesce("profile_name", F.lit("default")) == F.col("_db")) & F.col("eff_chain").eqNullSafe(F.col("_chain"))
    return resolved.join(wanted, same, "left_semi").dropDuplicates()


def delete_set(
    records: DataFrame,
    asof: Column,
    keep_last: int | None = None,
    retention_days: int | None = None,
    statuses: list[str] | None = None,
) -> DataFrame:
    """Records to delete under one rule for all databases. ``statuses`` limits which records are looked at."""
    seen = records if statuses is None else records.filter(F.col("status").isin(*statuses))
    resolved = effective_chain(seen)
    groups = materialise(cohorts(resolved), "cohorts")
    doomed = doomed_cohorts(groups, asof, keep_last, retention_days)
    return members_of(resolved, doomed)


def delete_set_by_rule(records: DataFrame, rules: DataFrame, asof: Column) -> DataFrame:
    """Records to delete when each database has its own rule row (db, keep_last, retention_days).

    A database may have several rules: what any of them gives up goes. Databases without a valid rule keep everything. Ranks are taken by slices, so any keep_last is exact.
    """
    valid, _ = split_rules(rules)
    valid = valid.filter("keep_last is not null or retention_days is not null")
    resolved = effective_chain(records)
    ranked = running_rank(materialise(cohorts(resolved), "cohorts"), ["db"], newest_first())
    ruled = ranked.join(valid.select("db", "keep_last", "retention_days"), "db")
    by_count = F.coalesce(F.col("rank") <= F.col("keep_last"), F.lit(False))
    by_age = F.coalesce(fresh_enough(asof, F.col("retention_days")), F.lit(False))
    return members_of(resolved, ruled.filter(~(by_count | by_age)))


def cleanup_set(current: DataFrame, asof: Column, keep_last: int = CLEANUP_KEEP) -> DataFrame:
    """What the automatic cleanup takes from the whole history of each named database."""
    return delete_set(current.filter(blank_to_null("profile_name").isNotNull()), asof, keep_last=keep_last)


def object_delete_plan(doomed: DataFrame, catalog: DataFrame) -> DataFrame:
    """(uri, scheme) that only deleted records use. Rows stay in the catalog; objects shared with a kept row stay too."""
    doomed = materialise(doomed.select("id", "destination_uri"), "doomed")
    named = doomed.filter("destination_uri is not null").select("destination_uri", object_id("destination_uri").alias("_id"))
    # one object may be spelled in several ways: it goes once, and stays if a kept row means it in any spelling
    gone = named.groupBy("_id").agg(F.min("destination_uri").alias("destination_uri"))
    kept = catalog.join(doomed.select("id"), "id", "left_anti").filter("destination_uri is not null")
    # distinct first: an object that many kept rows share must not become one task's work
    free = gone.join(kept.select(object_id("destination_uri").alias("_id")).distinct(), "_id", "left_anti")
    return free.select(F.col("destination_uri").alias("uri"), uri_scheme("destination_uri").alias("scheme"))
