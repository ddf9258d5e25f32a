"""Batch studies: cases run one after another or several at once, can be cancelled and taken up again, and each step of each case is written down."""

from __future__ import annotations

import threading
import uuid
from collections import Counter
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphband.operators.results import latest_state

MANIFEST = "case_id long, case_key string, seq long, at long, state string, result_dir string, error_type string, error_message string"


@dataclass
class Study:
    """A folder with an append-only manifest: a row for each change of state; the newest row of a case is its state."""

    spark: SparkSession
    folder: str
    lock: threading.Lock = field(default_factory=threading.Lock)
    seq: int | None = None

    def _next(self) -> int:
        """Numbers go on after those in the manifest, also in a new driver."""
        if self.seq is None:
            self.seq = -1 if self._is_new() else self.manifest().agg(F.max("seq")).first()[0]
        self.seq += 1
        return self.seq

    def _is_new(self) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        return not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def completed(self) -> set[str]:
        """Keys of the cases that are done: a study's cases, which the driver has as a list."""
        return set() if self._is_new() else {r["case_key"] for r in self.by_key().where("state = 'completed'").collect()}

    def by_key(self) -> DataFrame:
        """(case_key, state): the newest state of each case."""
        return self.manifest().groupBy("case_key").agg(F.max_by("state", F.struct("at", "seq")).alias("state"))

    def note(self, case_id: int, case_key: str, state: str, result_dir: str | None = None, error: Exception | None = None) -> None:
        at = int(datetime.now(UTC).timestamp())
        with self.lock:
            row = (case_id, case_key, self._next(), at, state, result_dir, type(error).__name__ if error else None, str(error) if error else None)
            self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")

    def states(self) -> DataFrame:
        return latest_state(self.manifest())

    def failed(self) -> bool:
        """Whether any case ended in failure: a command's exit code."""
        return not self.states().where(F.col("state") == "failed").isEmpty()


def run_cases(study: Study, cases: Iterable[dict[str, Any]], execute: Callable[[dict[str, Any]], str], stop_on_error: bool = False) -> int:
    """Runs each case (with its ``case_key``); ``execute`` returns its result folder.  A failure is written down and the next
    case follows, unless ``stop_on_error``.  Returns how many failed."""
    bad = 0
    for i, case in enumerate(cases):
        study.note(i, case["case_key"], "running")
        try:
            study.note(i, case["case_key"], "completed", result_dir=execute(case))
        except Exception as e:  # noqa: BLE001  any failure of a case is one of its results
            bad += 1
            study.note(i, case["case_key"], "failed", error=e)
            if stop_on_error:
                break
    return bad


@dataclass
class Sweep:
    """Cases of a study in a queue, ``at_once`` of them at a time, each in a thread, a scheduler pool and with a job tag of its own.

    Cases that ``deferred`` picks wait until all others are done.  A cancelled
    case's jobs are stopped by their tag; one that still waits never starts.
    Cases that the manifest has as completed are left out, so that a restarted
    sweep goes on where the last one was.
    """

    study: Study
    execute: Callable[[dict[str, Any]], str]
    at_once: int = 2
    deferred: Callable[[dict[str, Any]], bool] = lambda case: False
    stopped: set[str] = field(default_factory=set)
    tags: dict[str, str] = field(default_factory=dict)

    def cancel(self, case_key: str) -> None:
        """Stop a case that runs or waits."""
        self.stopped.add(case_key)
        if case_key in self.tags:
            self.study.spark.sparkContext.cancelJobsWithTag(self.tags[case_key])

    def _one(self, case_id: int, case: dict[str, Any]) -> str:
        key, sc = case["case_key"], self.study.spark.sparkContext
        if key in self.stopped:
            self.study.note(case_id, key, "cancelled")
            return "cancelled"
        tag = f"case-{uuid.uuid4().hex}"
        self.study.note(case_id, key, "running")
        sc.addJobTag(tag)
        sc.setLocalProperty("spark.scheduler.pool", key)
        self.tags[key] = tag
        try:
            found, error, state = self.execute(case), None, "completed"
        except Exception as e:  # noqa: BLE001  any failure of a case is one of its results
            found, error, state = None, e, "failed"
        finally:
            self.tags.pop(key, None)
            sc.removeJobTag(tag)
            sc.setLocalProperty("spark.scheduler.pool", None)
        if key in self.stopped:
            found, error, state = None, None, "cancelled"
        self.study.note(case_id, key, state, found, error)
        return state

    def run(self, cases: Iterable[dict[str, Any]]) -> dict[str, int]:
        """How many cases ended in each state; those done before count as skipped."""
        done, counts = self.study.completed(), Counter()
        todo = []
        for i, case in enumerate(cases):
            if case["case_key"] in done:
                counts["skipped"] += 1
            else:
                todo.append((i, case))
        for late in (False, True):
            with ThreadPoolExecutor(self.at_once) as pool:
                counts.update(pool.map(lambda x: self._one(*x), [x for x in todo if bool(self.deferred(x[1])) == late]))
        return dict(counts)


def dry_run(cases: Iterable[dict[str, Any]]) -> list[str]:
    """What would run, in order."""
    return [case["case_key"] for case in cases]
