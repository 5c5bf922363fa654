"""Stages run in order, each over the artifact of the one before, with a log that resumes them.

An artifact's address is a hash of its stage's name and recipe and of the address
of what it was made from, so it says by itself what it is. A stage whose artifact the log knows as done
is not run again, in this run or a later one; a stage that fails is logged with its
error, and a resumed run begins there. The log is an append-only table; a stage's newest
row in a run is its status.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.shared import Files

LOG = "run_id string, stage string, position int, status string, address string, path string, rows long, ms double, error string, at timestamp"
PENDING, DONE, REUSED, FAILED, SKIPPED = "pending", "done", "reused", "failed", "skipped (until)"


class StageFailed(RuntimeError):
    """A stage failed; its run can be resumed."""


@dataclass(frozen=True)
class Stage:
    name: str
    make: Callable[[DataFrame], DataFrame]
    recipe: str = ""


def address(stage: Stage, of: str) -> str:
    return hashlib.sha256(f"{stage.name}|{stage.recipe}|{of}".encode()).hexdigest()[:16]


class Runner:
    def __init__(self, spark: SparkSession, root: str, stages: list[Stage], clock: Callable[[], datetime] = datetime.now):
        self.spark, self.root, self.stages, self.clock = spark, root.rstrip("/"), stages, clock
        self.files = Files(spark, root)

    def log(self) -> DataFrame:
        path = f"{self.root}/log"
        return self.spark.read.schema(LOG).parquet(path) if self.files.exists(path) else self.spark.createDataFrame([], LOG)

    def run(self, rows: DataFrame, version: str, until: str | None = None, run_id: str | None = None, new_id: str | None = None) -> str:
        """The id of the run, over rows whose content ``version`` names; with ``run_id`` that run is resumed, else one begins, as ``new_id`` if given.

        Raises StageFailed at the first stage that fails, and ValueError for an unknown stage or run.
        """
        names = [s.name for s in self.stages]
        last = len(names) - 1 if until is None else names.index(until)
        if run_id is not None and self.log().where(F.col("run_id") == run_id).isEmpty():
            raise ValueError(f"no run named {run_id}")
        run_id = run_id or new_id or uuid.uuid4().hex[:12]
        known = {r.address: r.path for r in artifacts(self.log()).collect()} if self.stages else {}  # a row per artifact, no data
        of, made = version, rows
        for k, stage in enumerate(self.stages[: last + 1]):
            of, began = address(stage, of), self.clock()
            if of in known:
                made = self._read(known[of])
                self._note(run_id, stage, k, REUSED, of, known[of], None, began)
                continue
            path = f"{self.root}/artifacts/{stage.name}/{of}/{uuid.uuid4().hex}"
            try:
                stage.make(made).write.parquet(path)
                made = self._read(path)
                n = made.count()
            except Exception as e:
                self._note(run_id, stage, k, FAILED, of, None, None, began, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
                raise StageFailed(f"stage {stage.name} of run {run_id} failed") from e
            self._note(run_id, stage, k, DONE, of, path, n, began)
        for k, stage in enumerate(self.stages[last + 1 :], last + 1):
            self._note(run_id, stage, k, SKIPPED, None, None, None, self.clock())
        return run_id

    def artifact(self, stage: str, at: datetime | None = None) -> DataFrame | None:
        """A stage's newest artifact, or its newest up to a time; None if there is none."""
        found = newest(self.log(), at).where(F.col("stage") == stage).collect()
        return self._read(found[0].path) if found else None

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)

    def _note(self, run_id: str, stage: Stage, position: int, status: str, of: str | None, path: str | None, n: int | None, began: datetime, error: str | None = None) -> None:
        now = self.clock()
        row = (run_id, stage.name, position, status, of, path, n, (now - began).total_seconds() * 1000, error, now)
        self.spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")


def artifacts(log: DataFrame) -> DataFrame:
    """address, path: the newest finished artifact of each address."""
    return log.where(F.col("status") == DONE).groupBy("address").agg(F.max_by("path", "at").alias("path"))


def newest(log: DataFrame, at: datetime | None = None) -> DataFrame:
    """stage, run_id, path: each stage's newest artifact, as of a time."""
    seen = log.where(F.col("path").isNotNull())
    seen = seen if at is None else seen.where(F.col("at") <= F.lit(at))
    return seen.groupBy("stage").agg(F.max_by(F.struct("run_id", "path"), "at").alias("x")).select("stage", "x.run_id", "x.path")


def statuses(log: DataFrame) -> DataFrame:
    """run_id, position, stage, status, rows, error: each stage's newest row in its run; a resumed stage has its last one."""
    row = F.struct("status", "rows", "error")
    return log.groupBy("run_id", "position", "stage").agg(F.max_by(row, "at").alias("x")).select("run_id", "position", "stage", "x.*")
