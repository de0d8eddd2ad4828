"""Queries over chains and retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from keelson.operators import chains as K
from keelson.operators import retention as R
from keelson.plans.backup import Catalog
from keelson.plans.backup import cleanup_plan as plan_cleanup
from keelson.plans.chain_index import ChainIndex
from keelson.session import scratch_path
from keelson.workload.catalog_queries import LIST
from keelson.workload.fixtures import duck_history, history, table
from keelson.workload.registry import query

ASOF = "2024-01-25 00:00:00"


def asof():
    return F.lit(ASOF).cast("timestamp_ntz")


# ---- checking SQL shared by several queries. Walks of the fixture have at most 8 steps. ----
NODES = """
 h as (select *, nullif(trim(parent_backup_id), '') as par, nullif(trim(backup_chain_id), '') as own,
        coalesce(profile_name, 'default') as db from raw_history)
"""
EFF = f"""
 {NODES},
 walk as (
   select id, id as spot, own as ch, par as nxt, 0 as d from h
   union all
   select w.id, p.id, p.own, p.par, w.d + 1 from walk w join h p on p.id = w.nxt
   where w.ch is null and w.nxt is not null and w.d < 12),
 eff as (
   select h.*, coalesce(h.own, t.answer, h.parent_backup_id, h.id) as eff_chain from h left join
     (select id, coalesce(ch, spot) as answer from walk where ch is not null or nxt is null) t on t.id = h.id)
"""
COHORTS = f"""
 {EFF},
 co as (select db, eff_chain, max(coalesce(end_time, start_time)) as latest, count(*) as members from eff group by 1, 2),
 ranked as (select *, row_number() over (partition by db order by latest desc nulls last, eff_chain) as rank from co)
"""
UP = f"""
 {NODES},
 up as (
   select id, id as spot, par as nxt, 0 as d, status = 'SUCCESS' as good from h
   union all
   select u.id, coalesce(p.id, u.nxt), p.par, u.d + 1, coalesce(p.status = 'SUCCESS', true) from up u left join h p on p.id = u.nxt
   where u.nxt is not null and u.d < 12),
 ends as (
   select id, max(d) as d, bool_and(good) as good, max_by(spot, d) as end_id, max_by(case when nxt is null then 1 else 0 end, d) = 1 as ended from up group by 1),
 kinds as (
   select e.id, case when not ended then 'CYCLE' when r.id is null then 'DANGLING' else 'ROOT' end as kind, e.end_id, e.d, e.good
   from (select id, d, good, end_id, ended from ends) e left join h r on r.id = e.end_id)
"""


@query(
    "k1_chain_inheritance",
    duck_history(
        "select c.id, coalesce(nullif(trim(c.backup_chain_id), ''), nullif(trim(case when c.backup_type <> 'FULL' and c.par is not null then "
        "coalesce(p.backup_chain_id, p.id) end), ''), c.id) as backup_chain_id from h c left join h p on p.id = c.par",
        NODES,
    ),
)
def chain_inheritance(spark, sf_dir):
    rows = history(spark, sf_dir)
    return K.inherit_chain(rows, rows).select("id", "backup_chain_id")


SET = f"list_sort(list_distinct({LIST}))"


@query(
    "k2_scope_check",
    duck_history(
        "select c.id, c.parent_backup_id, array_to_string(c.s, ',') as tables, array_to_string(p.s, ',') as parent_tables "
        "from s c join s p on p.id = c.par where c.backup_type <> 'FULL' and c.s <> p.s",
        f"{NODES}, s as (select h.*, {SET} as s from h)",
    ),
)
def scope_check(spark, sf_dir):
    rows = history(spark, sf_dir)
    return K.scope_violations(rows, rows)


@query("k3_effective_chain", duck_history("select id, db, eff_chain from eff", EFF, recursive=True))
def effective_chain(spark, sf_dir):
    return K.effective_chain(history(spark, sf_dir)).select(
        "id", F.coalesce("profile_name", F.lit("default")).alias("db"), "eff_chain"
    )


LINEAGE = duck_history(
    "select t.target_id, cast(k.d - u.d as bigint) as step, u.spot as id from tg t join kinds k on k.id = t.target_id and k.kind = 'ROOT' join up u on u.id = t.target_id",
    f"{UP}, tg as (select max_by(id, start_time) as target_id from raw_history where status = 'SUCCESS' group by profile_name, dump_format)",
    recursive=True,
)


def newest_targets(rows):
    """The newest successful run of every database and format."""
    newest = rows.filter("status = 'SUCCESS'").groupBy("profile_name", "dump_format")
    return newest.agg(F.max_by("id", F.struct("start_time", "id")).alias("target_id")).select("target_id")


@query("k4_restore_lineage", LINEAGE)
def restore_lineage(spark, sf_dir):
    """Base-first steps of the newest targets, from a walk over the whole catalog."""
    rows = history(spark, sf_dir)
    return K.restore_lineage(rows, newest_targets(rows))


@query("k4_indexed_lineage", LINEAGE)
def indexed_lineage(spark, sf_dir):
    """The same from an index of parent links over two thirds of the log, extended by what came after."""
    log = history(spark, sf_dir).withColumn("seq", F.substring_index("id", "-", -1).cast("bigint"))
    index = ChainIndex(spark, scratch_path(spark, "chain-index"))
    index.extend(log.filter((F.col("seq") % 3) < 2).withColumn("seq", F.col("seq") - 2**40))
    index.extend(log)
    return index.lineage(newest_targets(log))


@query("k5_cycle_report", duck_history("select id from kinds where kind = 'CYCLE'", UP, recursive=True))
def cycle_report(spark, sf_dir):
    return K.cycle_report(history(spark, sf_dir))


@query(
    "k6_missing_parents",
    duck_history("select id, parent_backup_id as missing_parent_id from h where par is not null and par not in (select id from h)", NODES),
)
def missing_parents(spark, sf_dir):
    return K.missing_parents(history(spark, sf_dir))


@query(
    "k8_point_in_time",
    duck_history(
        "select profile_name, max_by(id, start_time) as id, max(start_time) as start_time from raw_history "
        f"where status = 'SUCCESS' and start_time <= timestamp '{ASOF}' group by 1"
    ),
)
def point_in_time(spark, sf_dir):
    return K.latest_usable(history(spark, sf_dir), asof())


@query(
    "k8_points_in_time",
    duck_history(
        "select p.event_id as point, p.db as profile_name, p.ts as at, r.id from p asof left join r on p.db = r.profile_name and p.ts >= r.start_time",
        "p as (select event_id, ts, case when event_id % 3 = 0 then 'db0' else concat('db', cast(user_id % 20 as varchar)) end as db from events "
        "where event_type = 'error'), r as (select * from raw_history where status = 'SUCCESS' and profile_name is not null)",
    ),
)
def points_in_time(spark, sf_dir):
    """For every error event the backup that would undo it."""
    number = F.col("event_id")
    points = table(spark, sf_dir, "events").filter("event_type = 'error'").select(
        number.cast("string").alias("point_id"),
        F.when(number % 3 == 0, "db0").otherwise(F.concat(F.lit("db"), (F.col("user_id") % 20).cast("string"))).alias("profile_name"),
        F.col("ts").alias("at"),
    )
    records = history(spark, sf_dir).filter("profile_name is not null")
    return K.usable_at(records, points).select(F.col("point_id").cast("bigint").alias("point"), "profile_name", "at", "id")


@query(
    "k9_chain_usability",
    duck_history(
        "select id, case when kind = 'CYCLE' then 'CYCLE' when kind = 'DANGLING' then 'MISSING_PARENT' when not good then 'NOT_SUCCESSFUL' "
        "else 'OK' end as usability from kinds",
        UP,
        recursive=True,
    ),
)
def chain_usability(spark, sf_dir):
    return K.chain_usability(history(spark, sf_dir))


# ---- retention ----
def rules(spark, sf_dir):
    """One rule per supplier number, some of them invalid or empty."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("db"), key.cast("string")).alias("db"),
        F.when(key % 4 > 0, (key % 6 - F.when(key % 11 == 0, 9).otherwise(0)).cast("int")).alias("keep_last"),
        F.when(key % 3 > 0, (key % 15 - F.when(key % 13 == 0, 20).otherwise(0)).cast("int")).alias("retention_days"),
    )


RULES = """
 rules as (select concat('db', cast(s_suppkey as varchar)) as db,
   cast(case when s_suppkey % 4 > 0 then s_suppkey % 6 - case when s_suppkey % 11 = 0 then 9 else 0 end end as integer) as keep_last,
   cast(case when s_suppkey % 3 > 0 then s_suppkey % 15 - case when s_suppkey % 13 = 0 then 20 else 0 end end as integer) as retention_days
   from supplier)
"""
VALID = "coalesce(keep_last, 1) > 0 and coalesce(retention_days, 0) >= 0"


@query("r1_rule_validation", f"with {RULES} select *, {VALID} as valid from rules")
def rule_validation(spark, sf_dir):
    valid, rejected = R.split_rules(rules(spark, sf_dir))
    return valid.withColumn("valid", F.lit(True)).unionByName(rejected.withColumn("valid", F.lit(False)))


@query("r2_cohorts", duck_history("select db, eff_chain, members from co", COHORTS, recursive=True))
def cohorts(spark, sf_dir):
    return R.cohorts(K.effective_chain(history(spark, sf_dir))).drop("latest")


@query("r3_cohort_latest", duck_history("select db, eff_chain, latest from co", COHORTS, recursive=True))
def cohort_latest(spark, sf_dir):
    return R.cohorts(K.effective_chain(history(spark, sf_dir))).drop("members")


@query(
    "r4_keep_last",
    duck_history("select db, eff_chain, cast(rank as integer) as rank from ranked where rank <= 5", COHORTS, recursive=True),
)
def keep_last(spark, sf_dir):
    groups = R.cohorts(K.effective_chain(history(spark, sf_dir)))
    return R.newest_cohorts(groups, 5).select("db", "eff_chain", "rank")


@query(
    "r5_age_cutoff",
    duck_history(f"select db, eff_chain, latest >= timestamp '{ASOF}' - interval 7 day as fresh from co", COHORTS, recursive=True),
)
def age_cutoff(spark, sf_dir):
    groups = R.cohorts(K.effective_chain(history(spark, sf_dir)))
    return groups.select("db", "eff_chain", R.fresh_enough(asof(), F.lit(7)).alias("fresh"))


DOOMED = duck_history(
    "select e.id, e.db, e.eff_chain, e.backup_type, e.status from eff e join ranked r on e.db = r.db and e.eff_chain = r.eff_chain "
    f"where r.rank > 5 and not (r.latest >= timestamp '{ASOF}' - interval 7 day)",
    COHORTS,
    recursive=True,
)


@query("r6_delete_set", DOOMED)
def delete_set(spark, sf_dir):
    """Which backups may go as of the given day, keeping five chains per database and everything of the last week."""
    doomed = R.delete_set(history(spark, sf_dir), asof(), keep_last=5, retention_days=7)
    return doomed.select("id", F.coalesce("profile_name", F.lit("default")).alias("db"), "eff_chain", "backup_type", "status")


@query(
    "r6_delete_set_by_rule",
    duck_history(
        "select e.id, r.db, r.eff_chain from ranked r join rules u using (db) join eff e on e.db = r.db and e.eff_chain = r.eff_chain "
        f"where {VALID} and (keep_last is not null or retention_days is not null) "
        "and not (coalesce(r.rank <= keep_last, false) "
        f"or coalesce(r.latest >= timestamp '{ASOF}' - to_days(retention_days), false))",
        f"{COHORTS}, {RULES}",
        recursive=True,
    ),
)
def delete_set_by_rule(spark, sf_dir):
    doomed = R.delete_set_by_rule(history(spark, sf_dir), rules(spark, sf_dir), asof())
    return doomed.select("id", F.col("profile_name").alias("db"), "eff_chain")


@query(
    "r7_delete_ids",
    duck_history(
        f"select e.id from eff e join co r on e.db = r.db and e.eff_chain = r.eff_chain where not (r.latest >= timestamp '{ASOF}' - interval 3 day)",
        COHORTS,
        recursive=True,
    ),
)
def delete_ids(spark, sf_dir):
    return R.delete_set(history(spark, sf_dir), asof(), retention_days=3).select("id")


@query(
    "r8_rule_from_settings",
    """
    with s as (select c_custkey as job, case c_custkey % 4 when 0 then 'many' when 1 then cast(c_custkey % 9 as varchar) when 2 then '0' end as k,
      case when c_custkey % 5 > 1 then cast(c_custkey % 30 as varchar) end as d from customer),
    n as (select job, coalesce(try_cast(k as integer), 0) as kn, coalesce(try_cast(d as integer), 0) as dn from s)
    select job, cast(case when kn > 0 or dn > 0 then case when kn > 0 then kn else 1 end end as integer) as keep_last,
      cast(case when kn > 0 or dn > 0 then dn end as integer) as retention_days from n
    """,
)
def rule_from_settings(spark, sf_dir):
    return R.rule_from_settings(job_settings(spark, sf_dir)).select("job", "keep_last", "retention_days")


def job_settings(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("job"),
        F.when(key % 4 == 0, "many").when(key % 4 == 1, (key % 9).cast("string")).when(key % 4 == 2, "0").alias("keep_last_setting"),
        F.when(key % 5 > 1, (key % 30).cast("string")).alias("retention_days_setting"),
    )


@query(
    "r6_delete_set_by_jobs",
    duck_history(
        "select e.id, r.db, r.eff_chain from ranked r join eff e on e.db = r.db and e.eff_chain = r.eff_chain where exists (select 1 from jobrules u "
        f"where u.db = r.db and r.rank > u.k and not coalesce(r.latest >= timestamp '{ASOF}' - to_days(u.d), false))",
        f"{COHORTS}, settings as (select concat('db', cast(c_custkey % 20 as varchar)) as db, coalesce(try_cast(case c_custkey % 4 when 0 then 'many' "
        "when 1 then cast(c_custkey % 9 as varchar) when 2 then '0' end as integer), 0) as kn, "
        "cast(case when c_custkey % 5 > 1 then c_custkey % 30 else 0 end as integer) as dn from customer), "
        "jobrules as (select distinct db, case when kn > 0 then kn else 1 end as k, dn as d from settings where kn > 0 or dn > 0)",
        recursive=True,
    ),
)
def delete_set_by_jobs(spark, sf_dir):
    """What the jobs' own settings let go, several jobs to a database."""
    jobs = job_settings(spark, sf_dir).withColumn("database", F.concat(F.lit("db"), (F.col("job") % 20).cast("string")))
    doomed = R.delete_set_by_rule(history(spark, sf_dir), R.rules_by_database(jobs), asof())
    return doomed.select("id", F.col("profile_name").alias("db"), "eff_chain")


@query(
    "r10_cleanup_plan",
    "with gone as (" + duck_history(
        "select e.id from eff e join ranked r on e.db = r.db and e.eff_chain = r.eff_chain where r.rank > 5 and e.db = 'db0'",
        COHORTS.replace("from raw_history)", "from raw_history where profile_name = 'db0')"),
        recursive=True,
    ) + "), " + duck_history(
        "select distinct destination_uri as uri, case when position(':' in destination_uri) > 0 then lower(trim(split_part(destination_uri, ':', 1))) "
        "else 'file' end as scheme from raw_history where id in (select id from gone) and destination_uri is not null and destination_uri not in "
        "(select destination_uri from raw_history where id not in (select id from gone) and destination_uri is not null)"
    )[len("with "):],
)
def cleanup_plan(spark, sf_dir):
    """Objects that the cleanup after a run of the largest database may remove, from a catalog's log."""
    catalog = Catalog(spark, scratch_path(spark, "cleanup-catalog"))
    catalog.append(history(spark, sf_dir))
    return plan_cleanup(catalog, "db0", datetime.fromisoformat(ASOF))


@query(
    "r9_automatic_cleanup",
    duck_history(
        "select e.id, e.db, e.eff_chain from eff e join ranked r on e.db = r.db and e.eff_chain = r.eff_chain where r.rank > 5",
        COHORTS.replace(
            "from raw_history)",
            "from raw_history where trim(profile_name) <> '')",
        ),
        recursive=True,
    ),
)
def automatic_cleanup(spark, sf_dir):
    return R.cleanup_set(history(spark, sf_dir), asof()).select("id", F.col("profile_name").alias("db"), "eff_chain")


@query(
    "r10_object_delete_plan",
    "with gone as (" + DOOMED + "), " + duck_history(
        "select distinct destination_uri as uri, case when position(':' in destination_uri) > 0 then lower(trim(split_part(destination_uri, ':', 1))) "
        "else 'file' end as scheme from raw_history where id in (select id from gone) and destination_uri is not null and destination_uri not in "
        "(select destination_uri from raw_history where id not in (select id from gone) and destination_uri is not null)"
    )[len("with "):],
)
def object_delete_plan(spark, sf_dir):
    rows = history(spark, sf_dir)
    return R.object_delete_plan(R.delete_set(rows, asof(), keep_last=5, retention_days=7), rows)


@query(
    "u3_kept_records",
    f"with gone as ({DOOMED}), " + duck_history("select id, status from raw_history where id not in (select id from gone)")[len("with "):],
)
def kept_records(spark, sf_dir):
    rows = history(spark, sf_dir)
    doomed = R.delete_set(rows, asof(), keep_last=5, retention_days=7)
    return rows.join(doomed.select("id"), "id", "left_anti").select("id", "status")
