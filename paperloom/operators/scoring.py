"""Scoring papers with a classifier supplied by the caller.

A scorer turns batches of ``paper_id, prompt`` into batches of ``paper_id, reply, tokens, error``.
Replies are written to a results table before anything reads them, because a recomputation would
ask the classifier again. One Spark job scores all papers that wait; its tasks keep their replies
part by part (see ``sources.score_sink``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from paperloom.functions.replies import MATERIAL_REPLY, METHOD_REPLY, reply_columns
from paperloom.functions.text import binary_decision
from paperloom.operators.prompts import MATERIAL_GUIDE, METHOD_GUIDE, RELEVANCE_GUIDE, render_prompts
from paperloom.sources import score_sink
from paperloom.sources.folders import Folder
from paperloom.sources.papers import relevant_only
from paperloom.sources.scores import PARTS, new_run, read_scores, score_schema

Batches = Iterator[pd.DataFrame]
Scorer = Callable[[Batches], Batches]

REMEMBERED = 10_000  # ids, without their texts, that a task compares the next ones to


@dataclass(frozen=True)
class Task:
    """A question to the classifier, and how its replies fill columns of the paper table."""

    name: str
    guide: str
    columns: Callable[[Column], list[Column]]
    only_relevant: bool


RELEVANCE = Task("relevance", RELEVANCE_GUIDE, lambda reply: [binary_decision(reply).alias("is_relevant")], False)
METHOD = Task("method", METHOD_GUIDE, lambda reply: reply_columns(reply, METHOD_REPLY), True)
MATERIAL = Task("material", MATERIAL_GUIDE, lambda reply: reply_columns(reply, MATERIAL_REPLY), True)


def per_paper(ask: Callable[[str], tuple[str, int | None]], guide: str = "", threads: int = 1) -> Scorer:
    """A scorer from a function that answers one prompt with a reply and its token count.

    An exception becomes an error on its paper and leaves the other papers alone. ``threads`` calls
    of one task wait for a remote classifier at the same time.
    """

    def answer(prompt: str) -> tuple[str | None, int | None, str | None]:
        try:
            reply, tokens = ask(f"{prompt}\n\n{guide}" if guide else prompt)
            return reply, tokens, None
        except Exception as problem:
            return None, None, f"{type(problem).__name__}: {problem}"

    def scorer(batches: Batches) -> Batches:
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                answers = list(pool.map(answer, batch["prompt"]))
                scored = pd.DataFrame(answers, columns=["reply", "tokens", "error"])
                scored["tokens"] = scored["tokens"].astype("Int64")
                scored.insert(0, "paper_id", batch["paper_id"].to_numpy())
                yield scored

    scorer.calls = threads
    return scorer


def calls_at_once(scorer: Scorer) -> int:
    """Calls that one task of the scorer makes at a time; a scorer of one's own may say so in ``calls``."""
    return getattr(scorer, "calls", 1)


def first_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each paper once among those of a batch and the ``REMEMBERED`` ids before it.

    The prompts stay in Arrow: a worker holds a batch and, of one with copies, what is left of it.
    """
    seen = None
    for batch in batches:
        ids = batch.column("paper_id").to_pandas()
        ids = ids if seen is None else pd.concat([seen, ids])
        copies = ids.duplicated().to_numpy()
        new = ~copies[len(ids) - batch.num_rows :]
        seen = ids[~copies][-REMEMBERED:]
        yield batch if new.all() else batch.filter(pa.array(new))


def pending_papers(papers: DataFrame, scores: DataFrame, retry_errors: bool = False, partitions: int | None = None) -> DataFrame:
    """``paper_id, prompt`` of papers without a score yet. Errors count as scored unless they are to be retried.

    Most copies of a paper fall away before the shuffle (see ``first_of_batch``), so one with very many copies
    does not gather in one task; of the others ``score`` takes the first. The text moves once: the join and
    the scorer use the same partitions, and the join neither sorts nor gathers it. A paper without an id
    is an error, as its score could never be found again.
    """
    done = scores.where(F.col("error").isNull()) if retry_errors else scores
    no_id = F.raise_error(F.lit("paper_id is null; see with_paper_id"))
    prompts = render_prompts(papers).withColumn("paper_id", F.when(F.col("paper_id").isNull(), no_id).otherwise(F.col("paper_id")))
    prompts = prompts.mapInArrow(first_of_batch, prompts.schema)
    prompts = prompts.repartition(partitions, "paper_id") if partitions else prompts.repartition("paper_id")
    return prompts.join(done.select("paper_id").hint("shuffle_hash"), "paper_id", "left_anti")


def score(
    papers: DataFrame, scorer: Scorer, partitions: int | None = None, observation: Observation | None = None
) -> DataFrame:
    """Runs the scorer over all papers, or over prompts that stand in partitions by id already.

    Every partition calls the classifier for its papers one after the other, or in the scorer's threads;
    so at most as many calls run at a time as the executors have cores, times the threads. Rows go to
    partitions by id, so a repeated task sees the same papers. Nothing is kept: use ``score_pending`` for
    calls that are paid for.
    """
    prompts = papers
    if "prompt" not in papers.columns:
        prompts = render_prompts(papers)
        prompts = prompts.repartition(partitions, "paper_id") if partitions else prompts
    scored = prompts.select("paper_id", "prompt").mapInPandas(scorer, score_schema(prompts.schema["paper_id"].dataType))
    if observation is not None:
        scored = scored.observe(
            observation,
            F.count(F.lit(1)).alias("papers"), F.sum("tokens").alias("tokens"), F.count("error").alias("errors"),
        )
    return scored


def usage(scores: DataFrame) -> DataFrame:
    """Scored papers, failed ones and tokens spent."""
    return scores.agg(
        F.count("*").alias("n_papers"), F.count("error").alias("n_errors"), F.sum("tokens").alias("tokens")
    )


def scatter(papers: DataFrame, scores: DataFrame, task: Task) -> DataFrame:
    """All papers with the columns of the task filled from the scores; unscored papers get nulls.

    Columns of the same name from an earlier run are replaced. A paper may have very many copies:
    Spark splits such a join partition only where both sides come straight from a shuffle of the
    join, hence the step between the scores, which may be grouped by id already, and the join.
    """
    filled = scores.hint("rebalance").select("paper_id", *task.columns(F.col("reply")))
    old = [c for c in filled.columns if c != "paper_id" and c in papers.columns]
    return papers.drop(*old).join(filled, "paper_id", "left")


def merge_earlier(papers: DataFrame, earlier: DataFrame, column: str = "is_relevant") -> DataFrame:
    """All papers with a column taken from an earlier result where the table has no value of its own.

    Of several earlier values of a paper the largest counts, so the table keeps its rows. The step between
    grouping and join lets Spark split the join for a paper with very many copies, as in ``scatter``.
    """
    known = earlier.where(F.col(column).isNotNull()).groupBy("paper_id").agg(F.max(column).alias("_earlier"))
    joined = papers.join(known.hint("rebalance"), "paper_id", "left")
    value = F.coalesce(F.col(column), F.col("_earlier")) if column in papers.columns else F.col("_earlier")
    return joined.withColumn(column, value).drop("_earlier")


def in_slots(prompts: DataFrame, scorer: Scorer, max_calls: int | None) -> DataFrame:
    """The prompts in so few tasks that at most ``max_calls`` calls run at a time, on any number of cores.

    Partitions are read one after the other by the task that holds them: nothing moves once more.
    """
    if max_calls is None:
        return prompts
    each = calls_at_once(scorer)
    if max_calls < each:
        raise ValueError(f"one task of the scorer makes {each} calls at a time, more than max_calls={max_calls}")
    return prompts.coalesce(max_calls // each)


def score_pending(
    papers: DataFrame,
    scorer: Scorer,
    task: Task,
    results_path: str,
    partitions: int | None = None,
    papers_per_commit: int = 1_000,
    retry_errors: bool = False,
    max_calls: int | None = None,
) -> str:
    """Scores what the results table lacks, adds it to the table, and returns the name of the run.

    It is one Spark job. Each task keeps its replies after every ``papers_per_commit`` papers: an
    interruption, of a task or of the whole job, loses no more calls than that for each task that ran. A
    repeated task asks for the rest only; an interrupted job is repeated with the same call. With
    ``max_calls`` at most so many calls run at a time, whatever the cluster.
    """
    spark = papers.sparkSession
    id_type = papers.schema["paper_id"].dataType
    scores = read_scores(spark, results_path, id_type)
    pending = pending_papers(relevant_only(papers, task.only_relevant), scores, retry_errors, partitions or _partitions(spark, max_calls))
    run = new_run()
    # Copies of a paper that the shuffle left stand side by side then.
    store_scored(pending.sortWithinPartitions("paper_id"), scorer, f"{Folder(spark, results_path).path}/{PARTS}/{run}", papers_per_commit, max_calls)
    return run


def _partitions(spark, max_calls: int | None) -> int | None:
    """With a bound on calls the slots are to be filled, however small the prompts are."""
    return max(max_calls, int(spark.conf.get("spark.sql.shuffle.partitions"))) if max_calls else None


def store_scored(
    prompts: DataFrame, scorer: Scorer, folder: str, every: int, max_calls: int | None = None, sink: str | None = None
) -> None:
    """Scores prompts and writes the replies to the folder of a run; ``sink`` is a format that is registered already."""
    spark = prompts.sparkSession
    rows = in_slots(prompts.select("paper_id", "prompt"), scorer, max_calls)
    sink = sink or score_sink.register(spark, scorer, prompts.schema["paper_id"].dataType)
    # Partitions are small in bytes and long in calls: merged by size, many calls would wait for each other.
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merge)
    spark.conf.set(merge, "false")
    try:
        rows.write.format(sink).mode("append").option("folder", folder).option("every", str(every)).save()
    finally:
        spark.conf.set(merge, before)


def classify(
    papers: DataFrame,
    scorer: Scorer,
    task: Task,
    results_path: str,
    partitions: int | None = None,
    papers_per_commit: int = 1_000,
    retry_errors: bool = False,
    max_calls: int | None = None,
) -> DataFrame:
    """Scores pending papers, then returns the whole table with the columns of the task."""
    score_pending(papers, scorer, task, results_path, partitions, papers_per_commit, retry_errors, max_calls)
    return scatter(papers, read_scores(papers.sparkSession, results_path, papers.schema["paper_id"].dataType), task)
