"""The durable table of scored papers: one row per scoring attempt.

A table is a folder:

* ``parts/<run>/`` has the replies of one run in complete files, and ``_done``, their manifest, once the run has ended;
* ``snapshot-<id>/`` has the best attempt of each paper of earlier runs, in few files;
* ``_generations/<number>`` names the snapshot that holds and the runs in it. The largest number counts.

Readers take the newest generation and all runs that are not in it. A compaction writes a snapshot and then
its generation, so a reader sees the table before or after it, whole in either case.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.sources.folders import Folder

PARTS, GENERATIONS, DONE = "parts", "_generations", "_done"


@dataclass(frozen=True)
class Generation:
    """What the newest compaction left: its number, its snapshot, and the runs in it."""

    number: int = 0
    snapshot: str | None = None
    runs: frozenset[str] = frozenset()


def score_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("paper_id", id_type),
            T.StructField("reply", T.StringType()),
            T.StructField("tokens", T.LongType()),
            T.StructField("error", T.StringType()),
        ]
    )


def new_run(kind: str = "p") -> str:
    """A name for a run; later runs sort later."""
    return f"{kind}-{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:12]}"


def generation(folder: Folder) -> Generation:
    numbers = [n for n in folder.names(GENERATIONS) if not n.startswith(("_", "."))]
    if not numbers:
        return Generation()
    content = json.loads(folder.read(GENERATIONS, max(numbers)))
    return Generation(int(max(numbers)), content["snapshot"], frozenset(content["runs"]))


def _places(folder: Folder) -> list[str]:
    """The folders that make up the table at this moment."""
    now = generation(folder)
    runs = [folder.at(PARTS, run).toString() for run in folder.names(PARTS) if run not in now.runs and not run.startswith(("_", "."))]
    return ([folder.at(now.snapshot).toString()] if now.snapshot else []) + runs


def _attempts(spark: SparkSession, places: list[str], id_type: T.DataType) -> DataFrame:
    schema = score_schema(id_type)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*places) if places else spark.createDataFrame([], schema)


def _best(attempts: DataFrame) -> DataFrame:
    best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "reply", "tokens", "error"))
    return attempts.groupBy("paper_id").agg(best.alias("best")).select("paper_id", "best.reply", "best.tokens", "best.error")


def score_attempts(spark: SparkSession, path: str, id_type: T.DataType, run: str | None = None) -> DataFrame:
    """Every attempt that the table has, or those of one run."""
    folder = Folder(spark, path)
    if run is None:
        return _attempts(spark, _places(folder), id_type)
    return _attempts(spark, [folder.at(PARTS, run).toString()] if folder.exists(PARTS, run) else [], id_type)


def read_scores(spark: SparkSession, path: str, id_type: T.DataType) -> DataFrame:
    """Scores written so far, one row per paper; an empty table where nothing was written yet.

    A replayed task or a retried error can leave several attempts for a paper; one without an
    error is preferred. The result stays that of the moment of the call, also while others write.
    """
    return _best(score_attempts(spark, path, id_type))


def append_scores(scored: DataFrame, path: str) -> None:
    """Adds scores made elsewhere as a run of their own."""
    folder, run = Folder(scored.sparkSession, path), new_run()
    kinds = {"reply": "string", "tokens": "long", "error": "string"}
    scored.select("paper_id", *[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()]).write.parquet(folder.at(PARTS, run).toString())
    folder.create(json.dumps({"papers": None}), PARTS, run, DONE)


def finished_runs(spark: SparkSession, path: str) -> list[tuple[str, dict]]:
    """Runs that have ended, with their manifests: parts, papers, tokens and errors."""
    folder = Folder(spark, path)
    return [(run, json.loads(folder.read(PARTS, run, DONE))) for run in folder.names(PARTS) if folder.exists(PARTS, run, DONE)]


def compact_scores(spark: SparkSession, path: str, id_type: T.DataType, only_finished: bool = True) -> None:
    """Gathers the best attempt of each paper in a new snapshot with few files, and switches to it in one step.

    Readers and runs go on meanwhile; a run that has not ended stays beside the snapshot. Where nothing
    writes to the table, ``only_finished=False`` takes in interrupted runs too. Of two compactions at a
    time the second one to end fails and leaves the table as it is. What is no longer needed stays until
    ``drop_old_scores``.
    """
    folder = Folder(spark, path)
    now = generation(folder)
    runs = [r for r in folder.names(PARTS) if r not in now.runs and not r.startswith(("_", "."))]
    runs = [r for r in runs if not only_finished or folder.exists(PARTS, r, DONE)]
    places = [folder.at(now.snapshot).toString()] if now.snapshot else []
    attempts = _attempts(spark, places + [folder.at(PARTS, r).toString() for r in runs], id_type)
    snapshot = f"snapshot-{uuid.uuid4().hex}"
    _best(attempts).hint("rebalance").write.parquet(folder.at(snapshot).toString())
    still_there = now.runs & set(folder.names(PARTS))
    content = json.dumps({"snapshot": snapshot, "runs": sorted(still_there | set(runs))})
    if not folder.create(content, GENERATIONS, f"{now.number + 1:08}"):
        folder.delete(snapshot)
        raise RuntimeError(f"{path} was compacted by someone else meanwhile")


def drop_old_scores(spark: SparkSession, path: str, after: float = 86_400.0) -> None:
    """Deletes snapshots and runs that the newest generation replaces, ``after`` seconds since it was made.

    Readers that took an older generation must have ended by then.
    """
    folder = Folder(spark, path)
    now = generation(folder)
    if not now.number or folder.age(GENERATIONS, f"{now.number:08}") < after:
        return
    for run in now.runs & set(folder.names(PARTS)):
        folder.delete(PARTS, run)
    for name in folder.names():
        if name.startswith("snapshot-") and name != now.snapshot and folder.age(name) >= after:
            folder.delete(name)
    for name in folder.names(GENERATIONS):
        if name != f"{now.number:08}":
            folder.delete(GENERATIONS, name)
