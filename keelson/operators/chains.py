"""Chains over parent pointers: inheritance, scope, effective chain, lineage, cycles, usability.

Walks are done for all records at once by pointer doubling. A node leaves the loop as soon as its pointer
reaches an end of the walk, so a tree that hangs off one base does not keep pointing at one hot row,
and the number of rounds is the logarithm of the longest walk. Each round is written to the shared folder.
Lookups join a pointer to a unique id: only the pointing side can be skewed, which the adaptive skew join splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.functions.text import blank_to_null, table_set
from keelson.plans.scans import slice_rows
from keelson.session import materialise, materialise_counted

ROOT, DANGLING, CYCLE = "ROOT", "DANGLING", "CYCLE"


def _nodes(records: DataFrame, stop: Column, answer: Column, ok: Column) -> DataFrame:
    """Walk state per id: where the pointer stands, how far it came, and whether the walk is over.

    Of several rows with one id the earliest started counts.
    """
    parent = blank_to_null("parent_backup_id")
    first = F.struct(
        F.col("start_time").isNull(), "start_time", F.coalesce("parent_backup_id", F.lit("")), F.coalesce("backup_chain_id", F.lit("")), F.coalesce("status", F.lit(""))
    )
    seen = ["parent_backup_id", "backup_chain_id", "status"]
    one = records.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min_by(F.struct(*seen), first).alias("_row"))
    return one.select("id", "_row.*").select(
        "id",
        parent.alias("ptr"),
        F.when(parent.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("dist"),
        ok.alias("ok"),
        F.when(stop | parent.isNull(), F.lit(ROOT)).alias("end"),
        F.when(stop | parent.isNull(), answer).alias("answer"),
    )


def walk(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Resolve every node to (id, end, answer, ok, dist): the kind of end its walk has and what it found there.

    ``dist`` counts the steps to the end, ``ok`` is the conjunction of ``ok`` from the node to the end.
    Walks that never end are marked as cycles: among nodes that do end, each doubling finishes some, so a round
    that finishes none has only cycles left.

    Also returns the jump tables met on the way: level r maps an id to its ancestor 2**r steps up.
    """
    unfinished = F.count_if(F.col("end").isNull())
    nodes, seen = materialise_counted(nodes, "walk", left=unfinished)
    done = ["id", "end", "answer", "ok", "dist"]
    ended = nodes.filter("end is not null").withColumn("dist", F.lit(0).cast("bigint")).select(*done)
    active = nodes.filter("end is null").drop("end", "answer")
    levels = [active.select("id", "ptr")]
    left = seen["left"]
    while left:
        # where a pointer can stand: on a finished node, on an active node, or on no record at all
        targets = ended.withColumn("ptr", F.lit(None).cast("string")).unionByName(active, allowMissingColumns=True)
        targets = targets.withColumnsRenamed({c: f"t_{c}" for c in targets.columns})
        moved = active.join(targets, F.col("ptr") == F.col("t_id"), "left").select(
            "id",
            F.col("t_ptr").alias("ptr"),
            (F.col("dist") + F.coalesce("t_dist", F.lit(0))).alias("dist"),
            (F.col("ok") & F.coalesce("t_ok", F.lit(True))).alias("ok"),
            F.when(F.col("t_id").isNull(), F.lit(DANGLING)).otherwise(F.col("t_end")).alias("end"),
            F.when(F.col("t_id").isNull(), F.col("ptr")).otherwise(F.col("t_answer")).alias("answer"),
        )
        moved, seen = materialise_counted(moved, "walk", left=unfinished)
        active = moved.filter("end is null").drop("end", "answer")
        if seen["left"] == left:
            break
        left = seen["left"]
        # a pointer that moved past finished nodes can still land on any of them later
        ended = ended.unionByName(moved.filter("end is not null").select(*done))
        levels.append(active.select("id", "ptr"))
    if left:
        circular = active.withColumn("end", F.lit(CYCLE)).withColumn("answer", F.lit(None).cast("string"))
        ended = ended.unionByName(circular.select(*done))
    return ended, levels


def with_parent(records: DataFrame, catalog: DataFrame, *columns: str) -> DataFrame:
    """Left lookup of the parent row; ``parent_<column>`` for each asked column, plus ``parent_found``."""
    # of several rows with one id the earliest started counts, so that no record is multiplied
    row = F.struct(*[F.col(c).alias(f"parent_{c}") for c in columns])
    first = F.struct(F.col("start_time").isNull(), "start_time", F.coalesce("backup_chain_id", F.lit("")), F.coalesce("status", F.lit("")))
    parents = catalog.filter(F.col("id").isNotNull()).groupBy(F.col("id").alias("_pid")).agg(F.min_by(row, first).alias("_row"))
    parents = parents.select("_pid", "_row.*")
    joined = records.join(parents, blank_to_null("parent_backup_id") == F.col("_pid"), "left")
    return joined.withColumn("parent_found", F.col("_pid").isNotNull()).drop("_pid")


def is_child() -> Column:
    """An incremental or differential record that names a parent."""
    return F.col("backup_type").isin("INCREMENTAL", "DIFFERENTIAL") & blank_to_null("parent_backup_id").isNotNull()


def inherited_chain() -> Column:
    """Over rows of ``with_parent``: the own chain, else (for a child) the parent's chain or id, else the own id.

    A parent chain of blank text is taken over first and then gives way to the own id.
    """
    taken = F.when(is_child(), F.coalesce("parent_backup_chain_id", "parent_id"))
    return F.coalesce(blank_to_null("backup_chain_id"), blank_to_null(taken), F.col("id"))


def scope_differs() -> Column:
    """Over rows of ``with_parent``: a child whose table set is not its known parent's."""
    return is_child() & F.col("parent_found") & (table_set("target_tables") != table_set("parent_target_tables"))


def inherit_chain(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requests with the chain id their record gets."""
    looked = with_parent(requests, catalog, "backup_chain_id", "id")
    return looked.withColumn("backup_chain_id", inherited_chain()).select(*requests.columns)


def scope_violations(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Children whose table set differs from their known parent's."""
    looked = with_parent(requests.filter(is_child()), catalog, "target_tables")
    return looked.filter(scope_differs()).select(
        "id",
        "parent_backup_id",
        F.array_join(table_set("target_tables"), ",").alias("tables"),
        F.array_join(table_set("parent_target_tables"), ",").alias("parent_tables"),
    )


def effective_chain(records: DataFrame) -> DataFrame:
    """``records`` with ``eff_chain``: first chain id met on the way to the root, or the root's id.

    A walk that ends at an unknown parent or in a cycle gives the record's own parent id. Each row starts from its own
    chain and parent, so rows that share an id, or have none, get their own answer and are never multiplied.
    """
    own, parent = blank_to_null("backup_chain_id"), blank_to_null("parent_backup_id")
    walked, _ = walk(_nodes(records, own.isNotNull(), F.coalesce(own, F.col("id")), F.lit(True)))
    found = walked.filter(F.col("end") == ROOT).select(F.col("id").alias("_wid"), F.col("answer").alias("_answer"))
    # a row that has its answer asks nothing
    asked = records.withColumn("_ask", F.when(own.isNull(), parent))
    joined = asked.join(found, F.col("_ask") == F.col("_wid"), "left")
    answer = F.coalesce(own, F.when(parent.isNull(), F.col("id")).otherwise(F.coalesce("_answer", "parent_backup_id")))
    return joined.withColumn("eff_chain", answer).drop("_ask", "_wid", "_answer")


def _rooted(records: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    ok = F.coalesce(F.col("status") == "SUCCESS", F.lit(False))
    walked, levels = walk(_nodes(records, F.lit(False), F.col("id"), ok))
    named = walked.select(
        "id", "end", F.col("answer").alias("end_id"), F.col("dist").alias("steps"), F.col("ok").alias("all_success")
    )
    return named, levels


def walk_to_root(records: DataFrame) -> DataFrame:
    """Per id: kind of end (ROOT, DANGLING, CYCLE), the root or missing id, steps, and status along the way."""
    return _rooted(records)[0]


def cycle_report(records: DataFrame) -> DataFrame:
    """Records that lie on or lead into a parent cycle."""
    return walk_to_root(records).filter(F.col("end") == CYCLE).select("id")


def missing_parents(records: DataFrame) -> DataFrame:
    """Records whose non-blank parent id is not in the catalog."""
    known = records.select(F.col("id").alias("_pid")).filter("_pid is not null")
    named = records.filter(blank_to_null("parent_backup_id").isNotNull())
    return named.join(known, F.col("parent_backup_id") == F.col("_pid"), "left_anti").select(
        "id", F.col("parent_backup_id").alias("missing_parent_id")
    )


def usability() -> Column:
    """Verdict on a row of ``walk_to_root``."""
    return (
        F.when(F.col("end") == CYCLE, "CYCLE")
        .when(F.col("end") == DANGLING, "MISSING_PARENT")
        .when(~F.col("all_success"), "NOT_SUCCESSFUL")
        .otherwise("OK")
    )


def chain_usability(records: DataFrame) -> DataFrame:
    """Whether each record can be restored: its walk reaches a root and every step succeeded."""
    return walk_to_root(records).select("id", usability().alias("usability"))


def restore_lineage(records: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, step, id) base first, for targets whose walk reaches a root. ``targets`` has ``target_id``."""
    walked, levels = _rooted(records)
    rooted = targets.distinct().join(walked.filter(F.col("end") == ROOT), F.col("target_id") == F.col("id"))
    return climb(rooted.select("target_id", "id", "steps"), levels)


def climb(rooted: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """All ancestors of each target. Every level doubles the known part, so the work is the size of the answer."""
    known = rooted.withColumn("back", F.lit(0).cast("bigint"))
    for exponent, level in enumerate(levels):
        known = materialise(known, "lineage")
        up = level.withColumnRenamed("id", "_at")
        further = known.join(up, F.col("id") == F.col("_at")).select(
            "target_id", F.col("ptr").alias("id"), "steps", (F.col("back") + 2**exponent).alias("back")
        )
        known = known.unionByName(further)
    return known.select("target_id", (F.col("steps") - F.col("back")).alias("step"), "id")


def resolve_target(records: DataFrame, target_id: str) -> tuple[str | None, str | None, DataFrame]:
    """(verdict, id the walk ends at, lineage) of one target from a single walk; the verdict is None if unknown."""
    walked, levels = _rooted(records)
    mine = walked.filter(F.col("id") == target_id)
    row = mine.select(usability().alias("verdict"), "end_id").first()
    lineage = climb(mine.filter(F.col("end") == ROOT).select(F.col("id").alias("target_id"), "id", "steps"), levels)
    return (row["verdict"] if row else None), (row["end_id"] if row else None), lineage


def latest_usable(records: DataFrame, at: Column, key: str = "profile_name") -> DataFrame:
    """Newest successful record per database that started at or before ``at``."""
    usable = records.filter((F.col("status") == "SUCCESS") & (F.col("start_time") <= at))
    return usable.groupBy(key).agg(
        F.max_by("id", F.struct("start_time", "id")).alias("id"), F.max("start_time").alias("start_time")
    )


def usable_at(records: DataFrame, points: DataFrame) -> DataFrame:
    """For many points (point_id, profile_name, at): the newest successful record not later than the point.

    Records and points are put in one time order per database and the last record seen is carried forward, so no
    pairs are made and a database of any size is scanned in slices.
    """
    seen = records.filter("status = 'SUCCESS' and start_time is not null").select(
        "profile_name", F.col("start_time").alias("at"), F.lit(0).alias("kind"), F.col("id").alias("tie"), "id"
    )
    asked = points.select(
        "profile_name", "at", F.lit(1).alias("kind"), F.col("point_id").alias("tie"), F.lit(None).cast("string").alias("id")
    )
    order = [F.col("at").asc(), F.col("kind").asc(), F.col("tie").asc()]
    cut = slice_rows(seen.unionByName(asked), ["profile_name"], order)
    so_far = cut.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.rows.withColumn("_here", F.last("id", ignorenulls=True).over(so_far))
    carried = cut.with_carry(
        local,
        {"_last": F.max_by("id", F.when(F.col("id").isNotNull(), F.struct("at", "tie")))},
        {"_earlier": lambda w: F.last("_last", ignorenulls=True).over(w)},
    )
    return carried.filter("kind = 1").select(
        F.col("tie").alias("point_id"), "profile_name", "at", F.coalesce("_here", "_earlier").alias("id")
    )
