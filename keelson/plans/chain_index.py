"""A persisted index of the catalog's parent links, so that one target does not walk the whole catalog.

For every record whose walk reaches a root the index holds its parent, root and depth, and its jumps: the ancestor 2**level steps up for
every level its depth has. Records whose walk ends at an unknown parent or in a cycle are pending; as a record that leads
into an indexed one is indexed itself, walks of pending records meet only pending ones.

``extend`` takes the log rows that came after the last mark. Only their ids and the pending ones are worked on: parents are looked up in
the index, chains among new records are doubled, and level r of a new record is one lookup of level r - 1. Each call
writes one batch (roots, pending, jumps) and, last, its mark; what a failed call left is not read and is replaced by the next one. A record
that names another parent than the indexed one makes the index start over.

Roots lie in folders by hash of the id, jumps by level and hash, so lookups of a few ids open few folders, and a target's lineage of n
steps reads n rows: each level doubles the known part. ``compact`` writes all batches as one at a new path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.text import blank_to_null
from keelson.operators import chains as K
from keelson.plans.scans import latest_per_key
from keelson.session import materialise, materialise_counted

#: Folders that ids are dealt to, per batch and level.
BUCKETS = 16
ROOTS = "id string, parent string, root string, depth bigint, batch bigint, bucket int"
JUMPS = "id string, ancestor string, batch bigint, level int, bucket int"
PENDING = "id string, parent string, batch bigint"
MARKS = "mark bigint, levels int, batch bigint"
#: The level count of a mark that voids all batches before it.
VOID = -1


@dataclass(frozen=True)
class State:
    """The last log position taken in, the live batches, and the levels they have."""

    mark: int | None
    first: int
    last: int
    levels: int


class ChainIndex:
    """Jump tables of a log of records (id, parent_backup_id, seq); one writer."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        for what, schema, folders in (("roots", ROOTS, ["bucket"]), ("jumps", JUMPS, ["level", "bucket"]), ("pending", PENDING, []), ("marks", MARKS, [])):
            # folders that hold nothing yet can be read
            nothing = spark.createDataFrame([], schema).drop("batch")
            nothing.write.mode("overwrite").partitionBy(*folders).parquet(f"{self.path}/{what}/batch=0")

    def _read(self, what: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{what}").parquet(f"{self.path}/{what}")

    def state(self) -> State:
        # one short row per batch
        marks = sorted((r["batch"], r["mark"], r["levels"]) for r in self._read("marks", MARKS).collect())
        first = max((b for b, _, levels in marks if levels == VOID), default=0) + 1
        live = [m for m in marks if m[0] >= first]
        return State(live[-1][1] if live else None, first, marks[-1][0] if marks else 0, max((m[2] for m in live), default=0))

    def _live(self, what: str, schema: str, state: State) -> DataFrame:
        return self._read(what, schema).filter(F.col("batch").between(state.first, state.last)).drop("batch")

    def roots(self, state: State) -> DataFrame:
        return self._live("roots", ROOTS, state)

    def jumps(self, state: State, level: int) -> DataFrame:
        return self._live("jumps", JUMPS, state).filter(F.col("level") == level).drop("level")

    def pending(self, state: State) -> DataFrame:
        """(id, parent) of the records that reach no root, as of the last batch."""
        return self._read("pending", PENDING).filter((F.col("batch") == state.last) & (F.col("batch") >= state.first)).drop("batch")

    def bucket(self, c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def _lookup(self, rows: DataFrame, key: str, index: DataFrame, how: str = "left") -> DataFrame:
        """``rows`` joined to the index by ``key``; the bucket is part of the join, so that other folders are pruned."""
        there = index.withColumnsRenamed({"id": "_id", "bucket": "_bucket"})
        asked = rows.withColumn("_b", self.bucket(F.col(key)))
        return asked.join(there, (F.col("_b") == F.col("_bucket")) & (F.col(key) == F.col("_id")), how).drop("_b", "_bucket", "_id")

    def extend(self, log: DataFrame) -> int:
        """Take in the log rows after the last mark; returns how many records were worked on."""
        state = self.state()
        rows = log if state.mark is None else log.filter(F.col("seq") > state.mark)
        links = rows.filter("id is not null").select("id", blank_to_null("parent_backup_id").alias("parent"), "seq")
        fresh, seen = materialise_counted(latest_per_key(links, ["id"], ["seq"]), "index-new", n=F.count(F.lit(1)), mark=F.max("seq"))
        if not seen["n"]:
            return 0
        index = self.roots(state).select("id", F.col("parent").alias("was"), F.lit(True).alias("held"), "bucket")
        told, counts = materialise_counted(
            self._lookup(fresh.select("id", "parent"), "id", index), "index-new", moved=F.count_if(F.col("held") & ~F.col("was").eqNullSafe(F.col("parent")))
        )
        if counts["moved"]:
            self._write_mark(state.last + 1, None, VOID)
            return self.extend(log)
        # a pending record may have been logged again, with another parent
        old = self.pending(state).join(fresh.select("id"), "id", "left_anti")
        return self._add(told.filter("held is null").select("id", "parent").unionByName(old), state, seen["mark"])

    def _add(self, work: DataFrame, state: State, mark: int) -> int:
        batch = state.last + 1
        indexed = self.roots(state).select("id", F.col("root").alias("_root"), F.col("depth").alias("_depth"), "bucket")
        # a walk among the new records ends at a base or below an indexed record; its answer is the depth and the root there
        below = F.concat((F.col("_depth") + 1).cast("string"), F.lit(":"), F.col("_root"))
        end = F.when(F.col("parent").isNull(), F.concat(F.lit("0:"), F.col("id"))).otherwise(below)
        nodes = self._lookup(work, "parent", indexed).select(
            "id", "parent", F.col("parent").alias("ptr"), F.col("parent").isNotNull().cast("bigint").alias("dist"), F.lit(True).alias("ok"),
            F.when(end.isNotNull(), F.lit(K.ROOT)).alias("end"), end.alias("answer"),
        )
        nodes = materialise(nodes, "index-nodes")
        ends = K.walk(nodes.drop("parent"))[0].select("id", "end", "answer", "dist")
        rooted = F.col("end") == K.ROOT
        depth, root = F.substring_index("answer", ":", 1).cast("bigint") + F.col("dist"), F.expr("substring(answer, instr(answer, ':') + 1)")
        found = nodes.select("id", "parent").join(ends, "id").select("id", "parent", "end", F.when(rooted, depth).alias("depth"), F.when(rooted, root).alias("root"))
        found, seen = materialise_counted(found, "index-ends", n=F.count(F.lit(1)), deepest=F.max("depth"))
        new = found.filter(rooted)
        self._write(new.select("id", "parent", "root", "depth"), f"roots/batch={batch}")
        found.filter(~rooted).select("id", "parent").write.mode("overwrite").parquet(f"{self.path}/pending/batch={batch}")
        level, here = 0, new.filter("parent is not null").select("id", "depth", F.col("parent").alias("ancestor"))
        while (1 << level) <= seen["deepest"]:
            here = materialise(here, "index-jumps")
            self._write(here.select("id", "ancestor"), f"jumps/batch={batch}/level={level}")
            there = here.select("id", "ancestor", self.bucket(F.col("id")).alias("bucket")).unionByName(self.jumps(state, level))
            further = here.filter(F.col("depth") >= (2 << level)).withColumnRenamed("ancestor", "middle")
            here = self._lookup(further, "middle", there).select("id", "depth", "ancestor")
            level += 1
        self._write_mark(batch, mark, max(level, state.levels))
        return seen["n"]

    def _write(self, rows: DataFrame, path: str) -> None:
        dealt = rows.withColumn("bucket", self.bucket(F.col("id"))).repartition("bucket").sortWithinPartitions("bucket", "id")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{path}")

    def _write_mark(self, batch: int, mark: int | None, levels: int) -> None:
        self.spark.createDataFrame([(mark, levels)], "mark bigint, levels int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/batch={batch}")

    def ends(self, targets: DataFrame) -> DataFrame:
        """(target_id, root, depth) of the targets that reach a root."""
        return self._ends(targets, self.state())

    def _ends(self, targets: DataFrame, state: State) -> DataFrame:
        return self._lookup(targets.select("target_id").distinct(), "target_id", self.roots(state).select("id", "root", "depth", "bucket"), "inner")

    def lineage(self, targets: DataFrame) -> DataFrame:
        """(target_id, step, id), base first, of the targets that reach a root."""
        state = self.state()
        rooted = self._ends(targets, state).select("target_id", F.col("target_id").alias("id"), F.col("depth").alias("steps"), F.lit(0).cast("bigint").alias("back"))
        known, seen = materialise_counted(rooted, "lineage", deepest=F.max("steps"))
        level = 0
        while (1 << level) <= seen["deepest"]:
            up = self._lookup(known, "id", self.jumps(state, level), "inner")
            further = up.select("target_id", F.col("ancestor").alias("id"), "steps", (F.col("back") + (1 << level)).alias("back"))
            known = materialise(known.unionByName(further), "lineage")
            level += 1
        return known.select("target_id", (F.col("steps") - F.col("back")).alias("step"), "id")

    def resolve_target(self, records: DataFrame, target_id: str) -> tuple[str | None, str | None, DataFrame]:
        """What ``chains.resolve_target`` says of one target; ``records`` are only read for the status of its lineage, or for pending ones."""
        state = self.state()
        # the hash of a literal is a literal: one folder per batch is listed
        row = self.roots(state).filter((F.col("bucket") == self.bucket(F.lit(target_id))) & (F.col("id") == target_id)).first()
        if row is None:
            return K.resolve_target(records.join(self.pending(state).select("id"), "id", "left_semi"), target_id)
        lineage = self.lineage(self.spark.createDataFrame([(target_id,)], "target_id string"))
        met = records.select("id", "status").join(lineage.select("id"), "id")
        bad = met.filter(~F.coalesce(F.col("status") == "SUCCESS", F.lit(False))).limit(1).count()
        return ("NOT_SUCCESSFUL" if bad else "OK"), row["root"], lineage

    def compact(self, path: str) -> ChainIndex:
        """All live batches as the one batch of a new index; this one stays as it is."""
        state, new = self.state(), ChainIndex(self.spark, path, self.buckets)
        new._write(self.roots(state).drop("bucket"), "roots/batch=1")
        self.pending(state).write.mode("overwrite").parquet(f"{new.path}/pending/batch=1")
        for level in range(state.levels):
            new._write(self.jumps(state, level).drop("bucket"), f"jumps/batch=1/level={level}")
        new._write_mark(1, state.mark, state.levels)
        return new
