"""Queries over alerts, schedules and trigger logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import alerts as N
from keelson.operators import schedule as J
from keelson.workload.fixtures import duck_history, duck_triggers, history, table, triggers
from keelson.workload.registry import query

# ---- alerts ----
ALERTS = """
 al as (select id, concat(case when status = 'SUCCESS' then 'Backup Successful: ' else 'Backup Failed: ' end, coalesce(profile_name, 'default')) as title,
  case when status = 'SUCCESS' then concat('Backup completed successfully for database ''', coalesce(profile_name, 'default'), ''' (ID: ', id, ')')
       else concat('Backup failed for database ''', coalesce(profile_name, 'default'), ''': ', error_message) end as message,
  status = 'SUCCESS' as success, backup_type as kind, cast(file_size_bytes as varchar) as size from raw_history where status in ('SUCCESS', 'FAILED')),
 heads as (select *, concat('[', case when success then 'SUCCESS' else 'FAILED' end, '] ', title) as headline from al)
"""
TELEGRAM = (
    "concat('<b>', headline, '</b>', chr(10), 'Message: ', message, chr(10), chr(10), '<b>Details:</b>', chr(10), '• <b>Type:</b> ', kind, chr(10), "
    "case when size is null then '' else concat('• <b>Size:</b> ', size, chr(10)) end)"
)
SLACK = (
    "cast(to_json({'text': concat(headline, ': ', message), 'blocks': [{'type': 'header', 'text': {'type': 'plain_text', 'text': headline}}, "
    "{'type': 'section', 'text': {'type': 'mrkdwn', 'text': concat('*Message:* ', message, chr(10), chr(10), '*Details:*', chr(10), '• *Type:* ', kind, "
    "chr(10), case when size is null then '' else concat('• *Size:* ', size, chr(10)) end)}}]}) as varchar)"
)
# What a finished run sends: no details.
TELEGRAM_PLAIN = "concat('<b>', headline, '</b>', chr(10), 'Message: ', message, chr(10))"
SLACK_PLAIN = (
    "cast(to_json({'text': concat(headline, ': ', message), 'blocks': [{'type': 'header', 'text': {'type': 'plain_text', 'text': headline}}, "
    "{'type': 'section', 'text': {'type': 'mrkdwn', 'text': concat('*Message:* ', message, chr(10))}}]}) as varchar)"
)
DISCORD = (
    "cast(to_json({'embeds': [{'title': headline, 'description': message, 'color': case when success then 3066993 else 15158332 end, 'fields': "
    "case when size is null then [{'name': 'Type', 'value': kind, 'inline': true}] else "
    "[{'name': 'Type', 'value': kind, 'inline': true}, {'name': 'Size', 'value': size, 'inline': true}] end}]}) as varchar)"
)


@query("n1_run_alerts", duck_history("select id, title, message, success from al", ALERTS))
def run_alerts(spark, sf_dir):
    return N.run_alerts(history(spark, sf_dir)).drop("details")


@query("n2_telegram_text", duck_history(f"select id, {TELEGRAM} as text from heads", ALERTS))
def telegram_text(spark, sf_dir):
    return N.run_alerts(history(spark, sf_dir), details=True).select("id", N.telegram_text().alias("text"))


@query(
    "n2_telegram_plain",
    duck_history(f"select id, {TELEGRAM_PLAIN} as text from heads", ALERTS),
)
def telegram_plain(spark, sf_dir):
    """As runs send them: without details."""
    return N.run_alerts(history(spark, sf_dir)).select("id", N.telegram_text().alias("text"))


@query("n3_slack_body", duck_history(f"select id, {SLACK} as body from heads", ALERTS))
def slack_body(spark, sf_dir):
    return N.run_alerts(history(spark, sf_dir), details=True).select("id", N.slack_body().alias("body"))


@query("n4_discord_body", duck_history(f"select id, {DISCORD} as body from heads", ALERTS))
def discord_body(spark, sf_dir):
    return N.run_alerts(history(spark, sf_dir), details=True).select("id", N.discord_body().alias("body"))


@query(
    "n1_restore_alerts",
    duck_history(
        "select id, case when error_message is null then 'Restore Successful' else 'Restore Failed' end as title, "
        "case when error_message is null then concat('Successfully restored backup chain up to target ', id) "
        "else concat('Failed to restore backup ', id, ': ', error_message) end as message, error_message is null as success from raw_history"
    ),
)
def restore_alerts(spark, sf_dir):
    """Alerts for restores of every backup; those of failed ones end with their error."""
    outcomes = history(spark, sf_dir).select(F.col("id").alias("target_id"), F.col("error_message").alias("error"))
    return N.restore_alerts(outcomes).drop("details")


def channel_lists():
    number = F.substring("id", 3, 20).cast("bigint")
    return (
        F.when(number % 4 == 0, F.array(F.lit("Slack"), F.lit("pager"), F.lit("DISCORD")))
        .when(number % 4 == 1, F.array(F.lit("telegram"), F.lit(None).cast("string")))
        .when(number % 4 == 2, F.array().cast("array<string>"))
    )


@query(
    "n5_channel_routing",
    duck_history(
        "select id, lower(channel) as channel, title, success from (select *, unnest(case cast(substr(id, 3) as bigint) % 4 when 0 then ['Slack', 'pager', 'DISCORD'] "
        "when 1 then ['telegram', null] else [] end) as channel from al) x where lower(channel) in ('slack', 'telegram', 'discord')",
        ALERTS,
    ),
)
def channel_routing(spark, sf_dir):
    alerts = N.run_alerts(history(spark, sf_dir)).withColumn("channels", channel_lists())
    return N.route(alerts).select("id", "channel", "title", "success")


# ---- schedules ----
# The cron texts given to the jobs in turn.
CRONS = ["0 2 * * *", "0 */30 9-17 * * MON-FRI", " ", "15 3 1,15 * *", "0 0 0 * * 0", None, "*/20 1 * * 1-5/2"]


def jobs(spark, sf_dir):
    """One job per customer with the cron texts in turn."""
    key = F.col("c_custkey")
    texts = F.array(*[F.lit(c) for c in CRONS])
    cron = F.element_at(texts, (key % len(CRONS) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(key.alias("job_id"), cron.alias("cron"))


def cron_case(values):
    return "case c_custkey % 7 " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


@query(
    "j1_cron_normalising",
    "select * from (select c_custkey as job_id, "
    + cron_case(["'0 0 2 * * *'", "'0 */30 9-17 * * MON-FRI'", "null", "'0 15 3 1,15 * *'", "'0 0 0 * * 0'", "null", "'0 */20 1 * * 1-5/2'"])
    + " as cron from customer) x where cron is not null",
)
def cron_normalising(spark, sf_dir):
    return J.schedulable(jobs(spark, sf_dir))


BEGIN, END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
CALENDAR = f"""
 minutes as (select unnest(generate_series(timestamp '{BEGIN}', timestamp '{END}' - interval 1 minute, interval 1 minute)) as t),
 fires as (select *, minute(t) as mi, hour(t) as h, day(t) as d, dayofweek(t) as w from minutes),
 kinds as (
   select 0 as k, t from fires where h = 2 and mi = 0
   union all select 1, t from fires where mi % 30 = 0 and h between 9 and 17 and w between 1 and 5
   union all select 3, t from fires where h = 3 and mi = 15 and d in (1, 15)
   union all select 4, t from fires where h = 0 and mi = 0 and w = 0
   union all select 6, t from fires where h = 1 and mi % 20 = 0 and w in (1, 3, 5)),
 expected as (select c_custkey as job_id, t as fire_time from customer join kinds on c_custkey % 7 = k)
"""


@query("j2_expected_runs", f"with {CALENDAR} select job_id, fire_time from expected")
def expected_runs(spark, sf_dir):
    return J.expected_runs(jobs(spark, sf_dir), BEGIN, END)


# Cron texts with calendar rules, and texts that cannot be read, given to the jobs in turn.
RULED = ["0 2 L * *", "0 2 L-3 * *", "0 2 1W * *", "0 2 15W,L * *", "0 2 LW * *", "0 2 * * 5L", "0 2 ? * FRI#2", "0 2 31W 1-6 MON#5,SUN"]
UNREADABLE = ["0 2 32W * *", "0 2 * * L", "61 2 * * *", "0 2 * *", " "]
YEAR_BEGIN, YEAR_END = "2024-01-01 00:00:00", "2026-01-01 00:00:00"


def ruled_jobs(spark, sf_dir):
    texts = F.array(*[F.lit(c) for c in RULED + UNREADABLE])
    cron = F.element_at(texts, (F.col("c_custkey") % F.size(texts) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), cron.alias("cron"))


# a date table: months as lists of their working days and of the days of each weekday
DATES = f"""
 dates as (select cast(t as date) as d, date_trunc('month', t) as m, month(t) as mo, day(t) as dom, dayofweek(t) as w
   from (select unnest(generate_series(timestamp '{YEAR_BEGIN}', timestamp '{YEAR_END}' - interval 1 day, interval 1 day)) as t) x),
 months as (select m, max(dom) as last, list(dom order by dom) filter (w between 1 and 5) as working from dates group by m),
 wanted as (select m, n from months, (values (1), (15), (31)) v(n) where n <= last),
 near as (select m, n, arg_min(dom, abs(dom - n)) as dom from wanted join dates using (m) where w between 1 and 5 group by m, n),
 nth as (select *, row_number() over (partition by m, w order by d) as up, row_number() over (partition by m, w order by d desc) as down from dates),
 marked as (select nth.*, last, working, exists (select 1 from near x where x.m = nth.m and x.dom = nth.dom and x.n = 1) as near1,
   exists (select 1 from near x where x.m = nth.m and x.dom = nth.dom and x.n = 15) as near15,
   exists (select 1 from near x where x.m = nth.m and x.dom = nth.dom and x.n = 31) as near31 from nth join months using (m)),
 ruled as (
   select 0 as k, d from marked where dom = last union all select 1, d from marked where dom = last - 3
   union all select 2, d from marked where near1 union all select 3, d from marked where near15 or dom = last
   union all select 4, d from marked where dom = working[-1] union all select 5, d from marked where w = 5 and down = 1
   union all select 6, d from marked where w = 5 and up = 2
   union all select 7, d from marked where near31 and mo <= 6 and ((w = 1 and up = 5) or w = 0))
"""


@query(
    "j2_calendar_rules",
    f"with {DATES} select c_custkey as job_id, cast(d as timestamp) + interval 2 hour as fire_time from customer join ruled on c_custkey % {len(RULED + UNREADABLE)} = k",
)
def calendar_rules(spark, sf_dir):
    """Two years of fire times of jobs on last days, nearest weekdays and nth weekdays."""
    return J.expected_runs(ruled_jobs(spark, sf_dir), YEAR_BEGIN, YEAR_END)


@query(
    "j2_unscheduled_jobs",
    "select * from (select c_custkey as job_id, case c_custkey % 13 when 8 then '0 0 2 32W * *' when 9 then '0 0 2 * * L' when 10 then '0 61 2 * * *' "
    "when 11 then '0 2 * *' when 12 then ' ' end as cron, case c_custkey % 13 when 8 then 'day: 32W' when 9 then 'weekday: L' when 10 then 'minute: 61' "
    "when 11 then 'fields: 4' when 12 then 'missing cron expression' end as reason from customer) x where reason is not null",
)
def unscheduled_jobs(spark, sf_dir):
    """Jobs the scheduler leaves out, each with its reason."""
    return J.unscheduled_jobs(ruled_jobs(spark, sf_dir))


MISSED = """
 runs as (select user_id % 50 as job_id, ts as start_time from events)
"""


@query(
    "j3_missed_runs",
    f"with {CALENDAR}, {MISSED} select job_id, fire_time from expected e where not exists "
    "(select 1 from runs r where r.job_id = e.job_id and r.start_time >= e.fire_time and r.start_time <= e.fire_time + interval 90 minute)",
)
def missed_runs(spark, sf_dir):
    return J.missed_runs(J.expected_runs(jobs(spark, sf_dir), BEGIN, END), job_runs(spark, sf_dir), 90)


def job_runs(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("job_id"), F.col("ts").alias("start_time"))


@query(
    "j3_misfire_outcome",
    f"with {CALENDAR}, {MISSED}, missed as (select job_id, fire_time from expected e where not exists "
    "(select 1 from runs r where r.job_id = e.job_id and r.start_time >= e.fire_time and r.start_time <= e.fire_time + interval 90 minute)), "
    "nx as (select m.job_id, m.fire_time, r.start_time as back, case m.job_id % 5 when 1 then 'IGNORE' when 2 then 'FIRE_ALL' when 4 then 'LATER' "
    "else 'FIRE_NOW' end as misfire from missed m asof left join runs r on m.job_id = r.job_id and m.fire_time <= r.start_time), "
    "oc as (select *, case when misfire = 'LATER' then 'UNKNOWN' when misfire = 'IGNORE' then 'DROPPED' when back is null then 'PENDING' "
    "when misfire = 'FIRE_ALL' or row_number() over (partition by job_id, back order by fire_time desc) = 1 then 'FIRED' else 'MERGED' end as outcome from nx) "
    "select job_id, fire_time, misfire, outcome, case when outcome in ('FIRED', 'MERGED') then back end as run_at from oc",
)
def misfire_outcome(spark, sf_dir):
    """What the misfire instruction of each job makes of its missed runs; a fifth of the jobs have none, another an unknown one."""
    key = F.col("c_custkey")
    text = F.when(key % 5 == 1, "ignore").when(key % 5 == 2, "FIRE_ALL").when(key % 5 == 3, " ").when(key % 5 == 4, "later")
    policies = table(spark, sf_dir, "customer").select(key.alias("job_id"), text.alias("misfire"))
    return J.misfire_outcome(missed_runs(spark, sf_dir), job_runs(spark, sf_dir), policies)


@query(
    "j4_skip_outcome",
    duck_triggers(
        "select t.trigger_id, t.job_id, r.trigger_id is not null as ran from e t left join run r using (trigger_id)",
        "e as (select *, epoch_us(start_time) as s, epoch_us(start_time) + duration_us as f from triggers), "
        "ev as (select trigger_id, job_id, s as spot, 1 as kind, 0 as sub from e union all select trigger_id, job_id, f, 0, 1 from e), "
        # trigger ids rise with time, so the least id ahead is the next trigger
        "nx as (select trigger_id, nxt from (select trigger_id, sub, min(case when sub = 0 then trigger_id end) over (partition by job_id "
        "order by spot, kind, trigger_id rows between current row and unbounded following) as nxt from ev) x where sub = 1 and nxt is not null), "
        "run as (select min(trigger_id) as trigger_id from e group by job_id union all select nx.nxt from run join nx using (trigger_id))",
        recursive=True,
    ),
)
def skip_outcome(spark, sf_dir):
    return J.skip_outcome(triggers(spark, sf_dir))


QUEUE = (
    "c as (select *, epoch_us(start_time) as s, sum(duration_us) over (partition by job_id order by start_time, trigger_id) as w from triggers), "
    "q as (select *, cast(w + max(s - (w - duration_us)) over (partition by job_id order by start_time, trigger_id) as bigint) as f from c)"
)


@query(
    "j5_queue_outcome",
    duck_triggers(
        "select trigger_id, job_id, make_timestamp(f - duration_us) as started_at, make_timestamp(f) as finished_at, f - duration_us - s as wait_us from q",
        QUEUE,
    ),
)
def queue_outcome(spark, sf_dir):
    return J.queue_outcome(triggers(spark, sf_dir))


@query(
    "j6_cancel_previous",
    duck_triggers(
        "select trigger_id, job_id, make_timestamp(least(s + duration_us, coalesce(n, s + duration_us))) as ended_at, coalesce(n < s + duration_us, false) as cancelled "
        "from (select *, epoch_us(start_time) as s, lead(epoch_us(start_time)) over (partition by job_id order by start_time, trigger_id) as n from triggers) x"
    ),
)
def cancel_previous(spark, sf_dir):
    return J.cancel_previous_outcome(triggers(spark, sf_dir))


@query(
    "j7_overlap_audit",
    duck_triggers(
        "select trigger_id, job_id, busy - s as overlap_us from (select *, epoch_us(start_time) as s, max(epoch_us(start_time) + duration_us) over "
        "(partition by job_id order by start_time, trigger_id rows between unbounded preceding and 1 preceding) as busy from triggers) x where busy > s"
    ),
)
def overlap_audit(spark, sf_dir):
    return J.overlap_audit(triggers(spark, sf_dir))
