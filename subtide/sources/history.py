"""A history of sessions and subtitles in a shared folder, written in batches of jobs.

A batch is one Parquet folder of jobs and one row in ``commits``; it counts from the moment that the row's single
file appears, so a batch is there as a whole or not at all, and a batch that is applied again changes nothing.
What a failed writer left behind has no row and is never read. Reading merges the jobs of all batches since the
last snapshot; ``compact`` writes a new snapshot, itself a list of jobs. One writer at a time, as ``foreachBatch`` is.

Jobs(seq, kind, client_id, id, started_at, at, mode, text): ``session`` adds a session or updates it and keeps its
first ``started_at``; ``subtitle`` replaces the subtitle with its id, whatever session that belonged to; ``delete``
removes a session and its subtitles. A batch that would leave a subtitle without its session, or a job without one,
is rejected as a whole, and so noted. Equal ``seq`` in a batch are not allowed.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

JOB = "seq long, kind string, client_id long, id string, started_at timestamp_ntz, at timestamp_ntz, mode string, text string"
_NAMES = [x.split()[0] for x in JOB.split(", ")]
_COMMIT = "batch long, kind string, path string"


class History:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def commits(self) -> list:
        """The rows of ``commits``, one for each batch or snapshot, in order."""
        try:
            return sorted(self.spark.read.schema(_COMMIT).parquet(f"{self.folder}/commits").collect(), key=lambda r: (r.batch, r.kind == "snapshot"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def _commit(self, batch: int, kind: str, path: str | None) -> None:
        self.spark.createDataFrame([(batch, kind, path)], _COMMIT).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def _jobs(self) -> DataFrame:
        """All jobs since the last snapshot, with ``place``, their order."""
        rows = self.commits()
        since = max((i for i, r in enumerate(rows) if r.kind == "snapshot"), default=0)
        found = self.spark.createDataFrame([], f"{JOB}, batch long")
        for r in rows[since:]:
            if r.path is not None:
                found = found.unionByName(self.spark.read.schema(JOB).parquet(r.path).withColumn("batch", F.lit(r.batch)))
        return found.withColumn("place", F.struct("batch", "seq"))

    def apply(self, jobs: DataFrame, batch: int) -> str:
        """``written``, ``rejected`` (an orphan among the jobs) or ``known`` (the batch was applied before)."""
        if any(r.batch >= batch if r.kind == "snapshot" else r.batch == batch for r in self.commits()):
            return "known"
        path = f"{self.folder}/jobs/{batch}-{uuid.uuid4().hex}"
        named = jobs.withColumn("id", F.when(F.col("kind") == "subtitle", F.coalesce("id", F.concat_ws("-", F.lit("subtitle"), F.lit(str(batch)), F.col("seq").cast("string")))))
        named.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(JOB)]).write.parquet(path)
        written = self.spark.read.schema(JOB).parquet(path)
        if self._orphans(written).limit(1).count():
            self._commit(batch, "rejected", None)
            return "rejected"
        self._commit(batch, "jobs", path)
        return "written"

    def _orphans(self, jobs: DataFrame) -> DataFrame:
        """Jobs without a session of their own, and subtitles whose session is not there at their place."""
        there = self.sessions().select(F.lit(-1).cast("long").alias("seq"), F.lit("session").alias("kind"), "client_id")
        own = jobs.select("seq", "kind", "client_id")
        before = W.partitionBy("client_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
        last = F.last(F.when(F.col("kind") != "subtitle", F.col("kind")), ignorenulls=True).over(before)
        placed = own.unionByName(there).withColumn("last", last)
        return placed.where("client_id IS NULL OR (kind = 'subtitle' AND coalesce(last, 'delete') = 'delete')")

    def _deletes(self, jobs: DataFrame) -> DataFrame:
        return jobs.where("kind = 'delete'").groupBy("client_id").agg(F.max("place").alias("deleted"))

    def sessions(self) -> DataFrame:
        """client_id, started_at (of the first job), updated_at and mode (of the last one)."""
        jobs = self._jobs()
        live = jobs.where("kind = 'session'").join(self._deletes(jobs), "client_id", "left").where(_after("place", "deleted"))
        return live.groupBy("client_id").agg(F.min_by("started_at", "place").alias("started_at"), F.max_by(F.struct("at", "mode"), "place").alias("last")).select("client_id", "started_at", F.col("last.at").alias("updated_at"), "last.mode")

    def subtitles(self) -> DataFrame:
        """id, client_id, created_at and text of each subtitle's last job."""
        jobs = self._jobs()
        last = jobs.where("kind = 'subtitle'").groupBy("id").agg(F.max_by(F.struct("client_id", "at", "text", "place"), "place").alias("x")).select("id", "x.*")
        kept = last.join(self._deletes(jobs), "client_id", "left").where(_after("place", "deleted"))
        return kept.select("id", "client_id", F.col("at").alias("created_at"), "text")

    def compact(self) -> None:
        """A snapshot of what is there, in place of all batches so far."""
        rows = self.commits()
        if not rows:
            return
        path = f"{self.folder}/jobs/snapshot-{uuid.uuid4().hex}"
        none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(JOB)}
        own = {"seq": F.lit(-2).cast("long"), "kind": F.lit("session"), "client_id": F.col("client_id"), "started_at": F.col("started_at"), "at": F.col("updated_at"), "mode": F.col("mode")}
        sub = {"seq": F.lit(-1).cast("long"), "kind": F.lit("subtitle"), "client_id": F.col("client_id"), "id": F.col("id"), "at": F.col("created_at"), "text": F.col("text")}
        parts = [frame.select(*[given[n].alias(n) if n in given else none[n] for n in _NAMES]) for frame, given in ((self.sessions(), own), (self.subtitles(), sub))]
        parts[0].unionByName(parts[1]).write.parquet(path)
        self._commit(rows[-1].batch, "snapshot", path)

    def follow(self, jobs: DataFrame, checkpoint: str):
        """A stream of jobs applied batch by batch until its input ends."""
        running = jobs.writeStream.foreachBatch(lambda frame, k: self.apply(frame, k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        running.awaitTermination()


def _after(place: str, deleted: str) -> Column:
    return F.col(deleted).isNull() | (F.col(place) > F.col(deleted))
