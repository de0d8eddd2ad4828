"""Schedules and run logs: expected runs, missed runs, and what each overlap policy does to a trigger log.

A trigger is (trigger_id, job_id, start_time, duration_us). Every scan over a job's triggers goes through
``slice_rows``, so a job that owns a large part of the log is worked on by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.functions.text import blank_to_null, normal_cron, trimmed
from keelson.plans.scans import slice_rows
from keelson.session import materialise, materialise_counted, rows_per_key

# Lowest and highest number of each cron field, and the names two of them accept.
CRON_FIELDS = {"second": (0, 59), "minute": (0, 59), "hour": (0, 23), "day": (1, 31), "month": (1, 12), "weekday": (0, 7)}
# one part of a field: star or number, range end, step
CRON_PART = r"^(?:[*?]|(\d+)(?:-(\d+))?)(?:/(\d+))?$"
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
WEEKDAYS = ["SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT"]


def schedulable(jobs: DataFrame) -> DataFrame:
    """Jobs that have a cron text, with its six-field form."""
    return jobs.filter(blank_to_null("cron").isNotNull()).withColumn("cron", normal_cron("cron"))


def _numbers(part: Column, low: int, high: int) -> Column:
    """Numbers one part of a field stands for: star, number, range, each with a step. Null for other text."""
    piece = lambda group: F.regexp_extract(part, CRON_PART, group).try_cast("int")
    # a lone number with a step, and a star, run to the highest value
    open_ended = part.rlike(r"[*?/]") & ~part.contains("-")
    first = F.coalesce(piece(1), F.lit(low))
    last = F.when(open_ended, F.lit(high)).otherwise(F.coalesce(piece(2), piece(1)))
    every = F.coalesce(piece(3), F.lit(1))
    fine = part.rlike(CRON_PART) & (first >= low) & (last <= high) & (first <= last) & (every > 0)
    return F.when(fine, F.sequence(first, last, every))


def field_values(text: Column, low: int, high: int, rules: list[str] | None = None) -> Column:
    """Numbers a cron field stands for, of a comma list. Null if a part is neither a number form nor one of ``rules``.

    Parts that match a pattern of ``rules`` are read by ``rule_values``; they name no numbers here.
    """
    rule = lambda part: reduce(or_, [part.rlike(pattern) for pattern in rules or ()], F.lit(False))
    none = F.array().cast("array<int>")
    lists = F.transform(F.split(text, ","), lambda part: F.when(rule(part), none).otherwise(_numbers(part, low, high)))
    # a list that is no number list makes the whole field null
    return F.array_sort(F.array_distinct(F.flatten(lists)))


def rule_values(text: Column, pattern: str, number) -> Column:
    """What ``number`` makes of the parts of a comma list that match a pattern; an empty list if none does."""
    parts = F.filter(F.split(text, ","), lambda part: part.rlike(pattern))
    return F.coalesce(F.transform(parts, number), F.array().cast("array<int>"))


def _part(pattern: str, group: int):
    return lambda part: F.coalesce(F.regexp_extract(part, pattern, group).try_cast("int"), F.lit(0))


# Calendar rules: a pattern of the field's text, and the number kept for a part that matches it.
# L, L-3: days before the month's last. 15W: the weekday nearest to a day, LW: to the last weekday, kept as 0.
DAY_RULES = {
    "day_back": (r"^L(?:-([1-9]|[12]\d|30))?$", 1),
    "day_near": (r"^(?:([1-9]|[12]\d|3[01])|L)W$", 1),
}
# 5L: the month's last Friday. 5#2: its second, kept as week and day in one number.
WEEKDAY_LAST = r"^([0-7])L$"
WEEKDAY_NTH = r"^([0-7])#([1-9]\d?)$"


def parsed_cron(jobs: DataFrame) -> DataFrame:
    """One row for every different six-field text: numbers of its fields, calendar rules, and a reason if it has no meaning.

    Sunday is 0. ``reason`` names the number of fields if it is not six, else the first field that cannot be read.
    """
    parts = F.split(F.upper("cron"), r"\s+")
    names = {"month": [(m, n + 1) for n, m in enumerate(MONTHS)], "weekday": [(d, n) for n, d in enumerate(WEEKDAYS)]}
    texts = {}
    for place, name in enumerate(CRON_FIELDS):
        text = F.get(parts, F.lit(place))
        for word, number in names.get(name, []):
            text = F.replace(text, F.lit(word), F.lit(str(number)))
        texts[name] = text
    rules = {"day": [pattern for pattern, _ in DAY_RULES.values()], "weekday": [WEEKDAY_LAST, WEEKDAY_NTH]}
    columns = {name: field_values(texts[name], low, high, rules.get(name)) for name, (low, high) in CRON_FIELDS.items()}
    columns["weekday"] = F.array_sort(F.array_distinct(F.transform(columns["weekday"], lambda d: d % 7)))
    for name, (pattern, group) in DAY_RULES.items():
        columns[name] = rule_values(texts["day"], pattern, _part(pattern, group))
    columns["weekday_last"] = rule_values(texts["weekday"], WEEKDAY_LAST, lambda part: _part(WEEKDAY_LAST, 1)(part) % 7)
    columns["weekday_nth"] = rule_values(
        texts["weekday"], WEEKDAY_NTH, lambda part: _part(WEEKDAY_NTH, 2)(part) * 7 + _part(WEEKDAY_NTH, 1)(part) % 7
    )
    reason = F.when(F.size(parts) != len(CRON_FIELDS), F.concat(F.lit("fields: "), F.size(parts)))
    for name in CRON_FIELDS:
        reason = reason.when(F.col(name).isNull(), F.concat(F.lit(f"{name}: "), F.get(F.split("cron", r"\s+"), F.lit(list(CRON_FIELDS).index(name)))))
    # a few texts serve many jobs: parse each once, and keep the result
    parsed = jobs.select("cron").distinct().select("cron", *[c.alias(name) for name, c in columns.items()])
    return materialise(parsed.withColumn("reason", reason), "cron")


def split_cron(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs with their parsed texts, jobs whose cron text has no meaning with the ``reason``)."""
    joined = jobs.join(parsed_cron(jobs), "cron")
    return joined.filter("reason is null").drop("reason"), joined.filter("reason is not null").select(*jobs.columns, "reason")


def unscheduled_jobs(jobs: DataFrame) -> DataFrame:
    """(job_id, cron, reason) of every job that will never be given to the scheduler: no cron text, or one it cannot read."""
    blank = jobs.filter(blank_to_null("cron").isNull()).select("job_id", "cron", F.lit("missing cron expression").alias("reason"))
    return blank.unionByName(split_cron(schedulable(jobs))[1].select("job_id", "cron", "reason"))


def fires_on(d: Column) -> Column:
    """Whether a parsed cron text names a date. Day of month and day of week must both fit.

    The nearest weekday lies in the same month: a Saturday goes to Friday, the first of the month to Monday the third; a
    Sunday to Monday, the month's last day to Friday. A month without the day has none.
    """
    day, weekday, last = F.dayofmonth(d), F.dayofweek(d) - 1, F.dayofmonth(F.last_day(d))
    end = F.dayofweek(F.last_day(d)) - 1
    working = weekday.between(1, 5)
    # days of the month whose nearest weekday is d
    served = F.array(
        F.when(working, day),
        F.when((weekday == 5) & (day < last), day + 1),
        F.when((weekday == 5) & (day + 2 == last), last),
        F.when((weekday == 1) & (day > 1), day - 1),
        F.when((weekday == 1) & (day == 3), F.lit(1)),
        F.when(working & (day == last - F.when(end == 6, 1).when(end == 0, 2).otherwise(0)), F.lit(0)),
    )
    week = F.ceil(day / 7).cast("int")
    of_month = (
        F.array_contains("day", day)
        | F.array_contains("day_back", last - day)
        | F.coalesce(F.arrays_overlap("day_near", F.array_compact(served)), F.lit(False))
    )
    of_week = (
        F.array_contains("weekday", weekday)
        | (F.array_contains("weekday_last", weekday) & (day + 7 > last))
        | F.array_contains("weekday_nth", week * 7 + weekday)
    )
    return F.array_contains("month", F.month(d)) & of_month & of_week


def expected_runs(jobs: DataFrame, begin: str, end: str) -> DataFrame:
    """Fire times in [begin, end) of jobs (job_id, cron).

    Days are tested first; only the hours, minutes and seconds a job names are ever made, so the work is the
    number of fire times and not the number of minutes in the range. ``unscheduled_jobs`` has the jobs left out.
    """
    first, stop = F.lit(begin).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    named = schedulable(jobs)
    days = F.filter(F.sequence(first.cast("date"), stop.cast("date")), fires_on)
    # the days are found once per cron text, before the jobs that share it are joined
    calendar = parsed_cron(named).filter("reason is null").select("cron", "hour", "minute", "second", days.alias("days"))
    timed = named.join(calendar, "cron").select("job_id", "hour", "minute", "second", F.explode("days").alias("_day"))
    for name in ("hour", "minute", "second"):
        timed = timed.withColumn(name, F.explode(name))
    at = F.col("_day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("hour"), F.col("minute"), F.col("second"))
    return timed.select("job_id", at.alias("fire_time")).filter((F.col("fire_time") >= first) & (F.col("fire_time") < stop))


def missed_runs(expected: DataFrame, runs: DataFrame, tolerance_minutes: int) -> DataFrame:
    """Expected fire times with no run of the job from the fire time up to the tolerance after it.

    Fire times and runs are put in one time order per job and each fire time looks at the next run, so no pairs are made.
    """
    fires = materialise(expected.select("job_id", F.col("fire_time").alias("at"), F.lit(0).alias("kind")), "fires")
    seen = runs.select("job_id", F.col("start_time").alias("at"), F.lit(1).alias("kind"))
    cut = slice_rows(fires.unionAll(seen), ["job_id"], [F.col("at").asc(), F.col("kind").asc()])
    run_at = F.when(F.col("kind") == 1, F.col("at"))
    ahead = cut.ahead(F.col("at").desc(), F.col("kind").desc())
    here = cut.rows.withColumn("_next", F.last(run_at, ignorenulls=True).over(ahead))
    both = cut.with_carry(
        here, {"_first": F.min(run_at)}, {"_later": lambda w: F.last("_first", ignorenulls=True).over(w)}, backward=True
    )
    upcoming = F.coalesce("_next", "_later")
    late = upcoming.isNull() | (upcoming > F.col("at") + F.make_dt_interval(mins=F.lit(tolerance_minutes)))
    return both.filter((F.col("kind") == 0) & late).select("job_id", F.col("at").alias("fire_time"))


#: What becomes of missed fire times: one run for all of them, one run each, or none.
MISFIRES = ("FIRE_NOW", "FIRE_ALL", "IGNORE")


def misfire_outcome(missed: DataFrame, runs: DataFrame, policies: DataFrame) -> DataFrame:
    """(job_id, fire_time, misfire, outcome, run_at): the run that makes up for each missed fire time.

    A job comes back with its first run at or after the fire time. FIRE_NOW (also for a blank text or a job without a row in
    ``policies``) makes up for all fire times missed since the run before in one run: the last of them is FIRED, the others MERGED.
    FIRE_ALL fires every one then; IGNORE has them DROPPED. PENDING: the job has not come back. An unknown text has outcome UNKNOWN.

    Missed times and runs are read in one order per job; ``policies`` has (job_id, misfire), one row per job.
    """
    fires = missed.select("job_id", F.col("fire_time").alias("at"), F.lit(0).alias("kind"))
    seen = runs.select("job_id", F.col("start_time").alias("at"), F.lit(1).alias("kind"))
    cut = slice_rows(materialise(fires.unionAll(seen), "misfires"), ["job_id"], [F.col("at").asc(), F.col("kind").asc()])
    run_at = F.when(F.col("kind") == 1, F.col("at"))
    ahead = cut.ahead(F.col("at").desc(), F.col("kind").desc())
    here = cut.rows.withColumn("_run", F.last(run_at, ignorenulls=True).over(ahead)).withColumn("_kind", F.lead("kind").over(cut.window()))
    both = cut.with_carry(
        here,
        {"_first": F.min(run_at), "_head": F.min_by("kind", F.struct("at", "kind"))},
        {"_later": lambda w: F.last("_first", ignorenulls=True).over(w), "_follows": lambda w: F.last("_head").over(w)},
        backward=True,
    )
    back = both.filter("kind = 0").select(
        "job_id", F.col("at").alias("fire_time"), F.coalesce("_run", "_later").alias("back"), (F.coalesce("_kind", "_follows") == 1).alias("newest")
    )
    rules = policies.select(F.col("job_id").alias("_job"), F.upper(trimmed(blank_to_null("misfire"))).alias("_rule"))
    ruled = back.join(rules, F.col("job_id").eqNullSafe(F.col("_job")), "left")
    rule = F.coalesce("_rule", F.lit(MISFIRES[0]))
    outcome = (
        F.when(~rule.isin(*MISFIRES), "UNKNOWN")
        .when(rule == "IGNORE", "DROPPED")
        .when(F.col("back").isNull(), "PENDING")
        .when((rule == "FIRE_ALL") | F.col("newest"), "FIRED")
        .otherwise("MERGED")
    )
    told = ruled.select("job_id", "fire_time", rule.alias("misfire"), outcome.alias("outcome"), "back")
    return told.select("job_id", "fire_time", "misfire", "outcome", F.when(F.col("outcome").isin("FIRED", "MERGED"), F.col("back")).alias("run_at"))


# ---- overlap policies over a trigger log ----
def _micros(triggers: DataFrame) -> DataFrame:
    start = F.unix_micros(F.col("start_time").cast("timestamp"))
    return triggers.select("job_id", "trigger_id", start.alias("s"), F.col("duration_us").cast("bigint").alias("d"))


def _time(micros: Column) -> Column:
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def _in_order() -> list[Column]:
    return [F.col("s").asc(), F.col("trigger_id").asc()]


def queue_outcome(triggers: DataFrame) -> DataFrame:
    """QUEUE: every trigger runs, in order, when the one before has finished.

    finish = work so far + the greatest (start - work before) so far; both are running scans carried across slices.
    """
    cut = slice_rows(_micros(triggers), ["job_id"], _in_order())
    so_far = cut.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    work = cut.with_carry(
        cut.rows.withColumn("_work", F.sum("d").over(so_far)), {"_sum": F.sum("d")}, {"_before": lambda w: F.sum("_sum").over(w)}
    )
    work = work.withColumn("work", F.col("_work") + F.coalesce("_before", F.lit(0))).drop("_work", "_before")
    slack = F.col("s") - (F.col("work") - F.col("d"))
    work = work.withColumn("_slack", slack).withColumn("_most", F.max("_slack").over(so_far))
    done = cut.with_carry(work, {"_max": F.max("_slack")}, {"_earlier": lambda w: F.max("_max").over(w)})
    finish = F.col("work") + F.greatest("_most", "_earlier")
    return done.select(
        "trigger_id",
        "job_id",
        _time(finish - F.col("d")).alias("started_at"),
        _time(finish).alias("finished_at"),
        (finish - F.col("d") - F.col("s")).alias("wait_us"),
    )


def cancel_previous_outcome(triggers: DataFrame) -> DataFrame:
    """CANCEL_PREVIOUS: the next trigger ends the running one."""
    cut = slice_rows(_micros(triggers), ["job_id"], _in_order())
    here = cut.rows.withColumn("_next", F.lead("s").over(cut.window()))
    both = cut.with_carry(here, {"_first": F.min("s")}, {"_later": lambda w: F.last("_first").over(w)}, backward=True)
    upcoming, end = F.coalesce("_next", "_later"), F.col("s") + F.col("d")
    return both.select(
        "trigger_id",
        "job_id",
        _time(F.least(end, upcoming)).alias("ended_at"),
        F.coalesce(upcoming < end, F.lit(False)).alias("cancelled"),
    )


def _with_busy_until(cut, rows: DataFrame) -> DataFrame:
    """Adds ``busy``: the latest end among the job's earlier triggers."""
    before = cut.window().rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("s") + F.col("d")
    here = rows.withColumn("_ends", F.max(end).over(before))
    both = cut.with_carry(here, {"_max": F.max(end)}, {"_earlier": lambda w: F.max("_max").over(w)})
    return both.withColumn("busy", F.greatest("_ends", "_earlier")).drop("_ends", "_earlier")


def overlap_audit(triggers: DataFrame) -> DataFrame:
    """Runs that start while an earlier run of their job is still going, with how long they overlap."""
    cut = slice_rows(_micros(triggers), ["job_id"], _in_order())
    late = _with_busy_until(cut, cut.rows).filter(F.col("busy") > F.col("s"))
    return late.select("trigger_id", "job_id", (F.col("busy") - F.col("s")).alias("overlap_us"))


def skip_outcome(triggers: DataFrame, island_limit: int | None = None) -> DataFrame:
    """SKIP: a trigger that arrives while its job runs is dropped. A trigger without a start never runs; no duration counts as 0.

    A job that fits one task is read once in time order, holding nothing but the end of the running trigger. Larger jobs fall
    into islands: a trigger that starts after every earlier one could have ended surely runs, so what follows it does not depend on
    what came before. Islands of up to ``island_limit`` triggers (``spark.keelson.rowsPerKey``) are read in the same way; a larger one is
    followed by jumps from each trigger to the first one after its end, doubling every round. All give the same answer.
    """
    cut = slice_rows(_micros(triggers), ["job_id"], _in_order())
    if not cut.cut:
        return _read_in_order(cut.rows, ["job_id"])
    limit = rows_per_key(triggers.sparkSession) if island_limit is None else island_limit
    unstarted = cut.rows.filter("s is null").select("trigger_id", "job_id", F.lit(False).alias("ran"))
    rows = _with_busy_until(cut, cut.rows.filter("s is not null").fillna(0, "d"))
    head = F.when(F.col("busy").isNull() | (F.col("s") >= F.col("busy")), F.struct("s", "trigger_id"))
    so_far = cut.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_head", head).withColumn("_island", F.max("_head").over(so_far))
    rows = cut.with_carry(rows, {"_last": F.max("_head")}, {"_earlier": lambda w: F.max("_last").over(w)})
    rows = materialise(
        rows.select("job_id", "trigger_id", "s", "d", F.coalesce("_island", "_earlier")["trigger_id"].alias("island")), "islands"
    )
    large, seen = materialise_counted(
        rows.groupBy("job_id", "island").count().filter(F.col("count") > limit).select("job_id", "island"),
        "large",
        n=F.count(F.lit(1)),
    )
    keys = ["job_id", "island"]
    if not seen["n"]:
        return _read_in_order(rows, keys).unionByName(unstarted)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    named = large.select(*[F.col(k).alias(f"_{k}") for k in keys])
    small = _read_in_order(rows.join(named, same, "left_anti"), keys)
    return small.unionByName(_follow_islands(rows.join(named, same, "left_semi"))).unionByName(unstarted)


def _read_in_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Triggers of each key in time order in one pass. Only the end of the running trigger is held, across batches too."""
    # one text per key; null is a key of its own
    key = F.concat_ws("\n", *[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for k in keys])

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last = busy = None
        for batch in batches:
            ran = []
            for name, start, length in zip(*(batch.column(c).to_pylist() for c in ("_key", "s", "d"))):
                if name != last:
                    last, busy = name, None
                free = start is not None and (busy is None or start >= busy)
                if free:
                    busy = start + (length or 0)
                ran.append(free)
            yield pa.RecordBatch.from_arrays([batch.column("trigger_id"), batch.column("job_id"), pa.array(ran, pa.bool_())], ["trigger_id", "job_id", "ran"])

    types = dict(rows.dtypes)
    dealt = rows.select("trigger_id", "job_id", key.alias("_key"), "s", "d").repartition("_key").sortWithinPartitions("_key", *_in_order())
    return dealt.mapInArrow(scan, f"trigger_id {types['trigger_id']}, job_id {types['job_id']}, ran boolean")


def _next_free(rows: DataFrame) -> DataFrame:
    """(trigger_id, island, nxt): the first trigger of the island at or after this one's end."""
    starts = rows.select("job_id", "island", F.col("s").alias("at"), F.lit(1).alias("kind"), "trigger_id", F.lit(0).alias("sub"))
    # an end comes before the triggers at that moment, but a run of no length ends right after its own start
    ends = rows.select(
        "job_id",
        "island",
        (F.col("s") + F.col("d")).alias("at"),
        F.when(F.col("d") > 0, 0).otherwise(1).alias("kind"),
        "trigger_id",
        F.lit(1).alias("sub"),
    )
    order = ("at", "kind", "trigger_id", "sub")
    cut = slice_rows(starts.unionAll(ends), ["job_id", "island"], [F.col(c).asc() for c in order])
    ahead = cut.ahead(*[F.col(c).desc() for c in order])
    start_id = F.when(F.col("sub") == 0, F.col("trigger_id"))
    here = cut.rows.withColumn("_next", F.last(start_id, ignorenulls=True).over(ahead))
    first = F.min_by("trigger_id", F.when(F.col("sub") == 0, F.struct("at", "kind", "trigger_id")))
    both = cut.with_carry(
        here, {"_first": first}, {"_later": lambda w: F.last("_first", ignorenulls=True).over(w)}, backward=True
    )
    return both.filter("sub = 1").select("trigger_id", F.coalesce("_next", "_later").alias("nxt")).filter("nxt is not null")


def _follow_islands(rows: DataFrame) -> DataFrame:
    """Triggers reached from each island's head by jumps that double every round."""
    jump, seen = materialise_counted(_next_free(rows), "jump", n=F.count(F.lit(1)))
    reached = rows.filter("trigger_id = island").select("trigger_id")
    while seen["n"]:
        further = reached.join(jump, "trigger_id").select(F.col("nxt").alias("trigger_id"))
        reached = materialise(reached.unionAll(further), "reached")
        onward = jump.select(F.col("trigger_id").alias("mid"), F.col("nxt").alias("end"))
        jump, seen = materialise_counted(
            jump.join(onward, F.col("nxt") == F.col("mid")).select("trigger_id", F.col("end").alias("nxt")),
            "jump",
            n=F.count(F.lit(1)),
        )
    marks = reached.select(F.col("trigger_id").alias("_ran"))
    joined = rows.join(marks, F.col("trigger_id") == F.col("_ran"), "left")
    return joined.select("trigger_id", "job_id", F.col("_ran").isNotNull().alias("ran"))
