"""Scoring of papers as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.operators.prompts import render_prompts
from paperloom.operators.scoring import Scorer, Task, first_of_batch, store_scored
from paperloom.sources import score_sink
from paperloom.sources.folders import Folder
from paperloom.sources.papers import relevant_only
from paperloom.sources.scores import PARTS, score_attempts, score_schema

# Kept on disk by every executor, so the number of papers is not bound by memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Spark makes data frames of every paper's row and state, some 20 KB together, and holds those of a batch at once.
BATCH_PAPERS = 1_000


def _new_papers(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first prompt of a paper that has no score yet, null for others; rows without a prompt are scores made elsewhere.

    Spark gathers what is known of papers in a worker until they have given as many rows as a batch holds. So
    every paper gives one: a worker's memory is that of a batch, however many papers had been scored.
    """
    prompt, scored = None, state.exists
    for batch in rows:
        scored = scored or batch["prompt"].isna().any()
        if not scored and prompt is None and len(batch):
            prompt = batch["prompt"].iloc[0]
    if not state.exists:
        state.update((True,))
    yield pd.DataFrame({"paper_id": [key[0]], "prompt": [None if scored else prompt]})


def unscored(papers: DataFrame, results_path: str, only_relevant: bool, stream: str = "") -> DataFrame:
    """``paper_id, prompt`` of the papers of a stream, each once, without those that the results table had scored.

    What is known of a paper, one flag, lies in the state of the stream. Scores that others have made come
    in as a second stream, every file of the results table once: no micro-batch reads the table again. Of runs
    of streams these are those of other ones (than ``stream``) that had begun when this one is started.
    """
    spark = papers.sparkSession
    no_id = F.raise_error(F.lit("paper_id is null; see with_paper_id"))
    asked = render_prompts(relevant_only(papers, only_relevant))
    asked = asked.withColumn("paper_id", F.when(F.col("paper_id").isNull(), no_id).otherwise(F.col("paper_id")))
    folder = Folder(spark, results_path)
    folder.make(PARTS)
    id_type = papers.schema["paper_id"].dataType
    others = sorted({name.rsplit("-", 1)[0] for name in folder.names(PARTS) if name.startswith("s-")} - {f"s-{stream}"})
    places = ",".join(["snapshot-*", f"{PARTS}/p-*", *(f"{PARTS}/{name}-*" for name in others)])
    known = spark.readStream.schema(score_schema(id_type)).option("recursiveFileLookup", "true").parquet(f"{folder.path}/{{{places}}}")
    asked = asked.mapInArrow(first_of_batch, asked.schema)  # most copies fall away before the shuffle
    rows = asked.unionByName(known.select("paper_id", F.lit(None).cast("string").alias("prompt")))
    schema = T.StructType([T.StructField("paper_id", id_type), T.StructField("prompt", T.StringType())])
    found = rows.groupBy("paper_id").applyInPandasWithState(_new_papers, schema, "known boolean", "append", GroupStateTimeout.NoTimeout)
    return found.where("prompt is not null")


def score_stream(
    papers: DataFrame,
    scorer: Scorer,
    task: Task,
    results_path: str,
    checkpoint_path: str,
    papers_per_commit: int = 1_000,
    max_calls: int | None = None,
) -> StreamingQuery:
    """Scores every paper of a stream that the results table lacks, then stops when the input is used up.

    Each paper is asked for once, over all micro-batches and restarts. A micro-batch is a run of its own, named
    by its number, and is scored in one job, as in ``score_pending``; one that is replayed after a failure
    leaves out the papers whose replies it had kept. The tasks are those of the stream's state, so their number
    is ``spark.sql.shuffle.partitions`` at the first start.
    """
    spark = papers.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(provider):
        spark.conf.set(provider, STATE_STORE)
    id_type = papers.schema["paper_id"].dataType
    root, sink = Folder(spark, results_path).path, score_sink.register(spark, scorer, id_type)
    stream = Folder(spark, checkpoint_path).path.rstrip("/").rsplit("/", 1)[-1]

    def score_batch(batch: DataFrame, number: int) -> None:
        run = f"s-{stream}-{number:010}"
        kept = score_attempts(batch.sparkSession, results_path, id_type, run).select("paper_id")
        left = batch.join(kept, "paper_id", "left_anti") if kept.inputFiles() else batch
        store_scored(left, scorer, f"{root}/{PARTS}/{run}", papers_per_commit, max_calls, sink)

    writer = (
        unscored(papers, results_path, task.only_relevant, stream)
        .writeStream.foreachBatch(score_batch)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
    )
    # The stream takes the settings that hold when it starts.
    batch_rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch_rows)
    if not 0 < int(before) <= BATCH_PAPERS:
        spark.conf.set(batch_rows, str(BATCH_PAPERS))
    try:
        return writer.start()
    finally:
        spark.conf.set(batch_rows, before)
