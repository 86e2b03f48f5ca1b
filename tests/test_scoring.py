import json
import sys

import pandas as pd
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.operators import prompts, scoring
from paperloom.sources import papers as scans
from paperloom.sources import score_sink
from paperloom.sources import scores as tables
from paperloom.sources.folders import Folder
from paperloom.sources.scores import append_scores, compact_scores, drop_old_scores, read_scores, score_attempts
from paperloom.streaming import incremental
from paperloom.streaming.incremental import score_stream

# Workers cannot import test modules.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def papers(spark, n=40):
    return spark.range(n).select(
        F.col("id").alias("paper_id"), F.concat(F.lit("title "), "id").alias("article_title"), F.lit("text").alias("abstract")
    )


def answer(prompt):
    if "title 7\n" in prompt:
        raise RuntimeError("no answer")
    return ("1" if "title 3" in prompt else "0"), 5


def answer_all(prompt):
    return "1", 5


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


LONG = T.LongType()


def attempts(spark, path):
    return score_attempts(spark, path, LONG).groupBy("paper_id").count()


def test_prompt_cells(spark):
    df = spark.createDataFrame([(1, "T", None, "A")], "paper_id int, article_title string, author_keywords string, abstract string")
    assert prompts.render_prompts(df).first().prompt == "Title: T\nKeywords: nan | N/A\nAbstract: A"
    assert prompts.render_prompts(df, "G").first().prompt.endswith("Abstract: A\n\nG")


def test_errors_stay_with_their_paper(spark):
    seen = Observation("scoring")
    scored = scoring.score(papers(spark), scoring.per_paper(answer, guide="guide", threads=3), 4, seen)
    rows = {r.paper_id: r for r in scored.collect()}
    assert len(rows) == 40
    assert rows[7].error == "RuntimeError: no answer" and rows[7].reply is None and rows[7].tokens is None
    assert rows[3].reply == "1" and rows[4].reply == "0"
    assert seen.get == {"papers": 40, "tokens": 195, "errors": 1}


def test_unscored_papers_keep_nulls(spark, tmp_path):
    df = papers(spark, 10).withColumn("is_relevant", (F.col("paper_id") % 2).cast("int"))
    reply = '{"material_categories": ["A"], "confidence": "high", "primary_category": "A"}'
    done = scoring.classify(df, scoring.per_paper(lambda p: (reply, 1)), scoring.MATERIAL, str(tmp_path / "s"))
    assert tuples(done.select("paper_id", "primary_material_category")) == [(i, "A" if i % 2 else None) for i in range(10)]
    assert attempts(spark, str(tmp_path / "s")).count() == 5
    again = scoring.scatter(done, read_scores(spark, str(tmp_path / "s"), df.schema["paper_id"].dataType), scoring.MATERIAL)
    assert again.columns.count("material_confidence") == 1


def test_failed_papers_take_the_default_and_are_retried_on_request(spark, tmp_path):
    path = str(tmp_path / "s")
    first = scoring.classify(papers(spark), scoring.per_paper(answer), scoring.RELEVANCE, path)
    assert dict(tuples(first.select("paper_id", "is_relevant")))[7] == 0
    same = scoring.classify(papers(spark), scoring.per_paper(answer_all), scoring.RELEVANCE, path)
    assert dict(tuples(same.select("paper_id", "is_relevant")))[7] == 0
    retried = scoring.classify(papers(spark), scoring.per_paper(answer_all), scoring.RELEVANCE, path, retry_errors=True)
    assert dict(tuples(retried.select("paper_id", "is_relevant")))[7] == 1
    assert {r.paper_id: r["count"] for r in attempts(spark, path).where("count > 1").collect()} == {7: 2}


def test_interrupted_run_goes_on_where_it_stopped(spark, tmp_path):
    """The job dies after some parts: they stay, and the same call scores the rest only."""
    path = str(tmp_path / "s")
    plain = scoring.per_paper(answer)

    def breaks(batches):
        for number, scored in enumerate(plain(batches)):
            if number == 2:
                raise SystemError("executor is gone")
            yield scored

    with pytest.raises(Exception):
        scoring.score_pending(papers(spark), breaks, scoring.RELEVANCE, path, partitions=2, papers_per_commit=5)
    assert 5 <= attempts(spark, path).count() < 40 and attempts(spark, path).where("count > 1").count() == 0
    assert tables.finished_runs(spark, path) == []
    done = scoring.classify(papers(spark), plain, scoring.RELEVANCE, path, papers_per_commit=10)
    assert done.count() == 40 and done.where("is_relevant is null").count() == 0
    assert attempts(spark, path).where("count > 1").count() == 0
    assert len(tables.finished_runs(spark, path)) == 1


class FakeTask:
    def __init__(self, attempt):
        self.attempt = attempt

    def partitionId(self):
        return 3

    def taskAttemptId(self):
        return self.attempt


def test_a_repeated_task_asks_only_for_what_its_first_attempt_did_not_keep(tmp_path, monkeypatch):
    """A task is killed half-way: at most the calls of one part are made again."""
    calls, batches = [], [pa.RecordBatch.from_pydict({"paper_id": list(range(k, k + 10)), "prompt": [f"p{i}" for i in range(k, k + 10)]}) for k in (0, 10, 20)]

    def ask(prompt):
        if prompt == "p17" and calls.count("p17") == 0:
            calls.append(prompt)
            raise KeyboardInterrupt  # the worker is killed
        calls.append(prompt)
        return "1", 1

    def attempt(number):
        monkeypatch.setattr(score_sink.TaskContext, "get", lambda: FakeTask(number))
        writer = score_sink.ScoreWriter(scoring.per_paper(ask), LONG, f"file:{tmp_path}/run", every=4)
        return writer, writer.write(iter(batches))

    with pytest.raises(KeyboardInterrupt):
        attempt(1)
    first = len(calls)
    writer, message = attempt(2)
    assert message.papers == 30 and message.tokens == 30 and message.errors == 0
    again = [p for p in set(calls) if calls.count(p) > 1]
    assert 0 < len(again) <= 4 and first + 30 - len(calls) >= first - 4 - 1
    writer.commit([message, None])
    manifest = json.loads((tmp_path / "run" / "_done").read_text())
    assert manifest["papers"] == 30 and len(manifest["parts"]) == len(list((tmp_path / "run" / "000003").glob("*.parquet")))


def test_any_number_of_commits_is_one_job(spark, tmp_path):
    tracker, jobs = spark.sparkContext.statusTracker(), {}
    for every in (3, 1000):
        path = tmp_path / f"s{every}"
        spark.sparkContext.setJobGroup(f"commits-{every}", "")
        try:
            scoring.score_pending(papers(spark, 200), scoring.per_paper(answer_all), scoring.RELEVANCE, str(path), partitions=2, papers_per_commit=every)
        finally:
            spark.sparkContext._jsc.sc().clearJobGroup()
        jobs[every] = len(tracker.getJobIdsForGroup(f"commits-{every}"))
        assert len(list((path / "parts").glob("*/*/*.parquet"))) == (2 if every == 1000 else pytest.approx(67, abs=1))
        assert tables.finished_runs(spark, str(path))[0][1]["papers"] == 200
    assert jobs[3] == jobs[1000] <= 4  # the shuffles of both sides, and one that scores


def test_calls_at_a_time_are_bounded_whatever_the_cores(spark, tmp_path):
    """Eight cores, three calls: each call leaves a mark while it runs and counts the others."""
    marks, peak = tmp_path / "marks", tmp_path / "peak"
    marks.mkdir()
    peak.mkdir()

    def ask(prompt):
        import os
        import time
        import uuid

        name = uuid.uuid4().hex
        (marks / name).touch()
        time.sleep(0.02)
        (peak / str(len(os.listdir(marks)))).touch()
        (marks / name).unlink()
        return "1", 1

    scoring.score_pending(papers(spark, 120), scoring.per_paper(ask), scoring.RELEVANCE, str(tmp_path / "s"), max_calls=3)
    assert 2 <= max(int(p.name) for p in peak.iterdir()) <= 3
    for p in peak.iterdir():
        p.unlink()
    scoring.score_pending(papers(spark, 240).where("paper_id >= 120"), scoring.per_paper(ask, threads=2), scoring.RELEVANCE, str(tmp_path / "s"), max_calls=5)
    assert max(int(p.name) for p in peak.iterdir()) <= 4
    with pytest.raises(ValueError, match="max_calls"):
        scoring.score_pending(papers(spark), scoring.per_paper(ask, threads=4), scoring.RELEVANCE, str(tmp_path / "t"), max_calls=3)
    assert attempts(spark, str(tmp_path / "s")).agg(F.max("count"), F.count("*")).first() == (1, 240)


def test_a_paper_without_id_is_an_error(spark, tmp_path):
    df = papers(spark, 3).union(spark.sql("SELECT CAST(null AS bigint), 'title', 'text'"))
    with pytest.raises(Exception, match="paper_id is null"):
        scoring.score_pending(df, scoring.per_paper(answer), scoring.RELEVANCE, str(tmp_path / "s"))


def test_derived_ids_fill_every_paper_and_ask_once(spark, tmp_path):
    """Null ids, and papers that differ in their keywords only."""
    rows = [(1, "T", "a", None), (None, "T", "a", "x"), (None, "T", "b", "x"), (None, "T", "b", "x"), (None, "U", None, None)]
    df = scans.with_paper_id(spark.createDataFrame(rows, "paper_id int, article_title string, author_keywords string, abstract string"))
    path = str(tmp_path / "s")
    for _ in range(2):  # the second run asks nothing
        done = scoring.classify(df, scoring.per_paper(answer_all), scoring.RELEVANCE, path)
        assert [r.is_relevant for r in done.collect()] == [1] * 5
        assert sorted(r["count"] for r in attempts(spark, path).collect()) == [1] * 4


def test_text_moves_once_and_is_not_sorted(spark, tmp_path):
    scores = read_scores(spark, str(tmp_path / "none"), papers(spark).schema["paper_id"].dataType)
    append_scores(spark.createDataFrame([(1, "1", 1, None)], "paper_id long, reply string, tokens long, error string"), str(tmp_path / "some"))
    scores = read_scores(spark, str(tmp_path / "some"), papers(spark).schema["paper_id"].dataType)
    scored = scoring.score(scoring.pending_papers(papers(spark), scores), scoring.per_paper(answer))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert "ShuffledHashJoin" in plan and "SortAggregate" not in plan and "Sort [" not in plan
    assert len(moved) == 2  # the prompts, and the ids of the scores


def scored(spark, low, high, reply="1", error=None):
    columns = [F.col("id").alias("paper_id"), F.lit(reply).alias("reply"), F.lit(1).cast("long").alias("tokens"), F.lit(error).cast("string").alias("error")]
    return spark.range(low, high, 1, 4).select(*columns)


def test_compaction_switches_in_one_step(spark, tmp_path):
    """A reader that began before a compaction sees the old table whole, one that begins after it the new one."""
    path = str(tmp_path / "s")
    for low in (0, 50, 100):
        append_scores(scored(spark, low, low + 70), path)
    append_scores(scored(spark, 0, 10, None, "failed"), path)
    before = read_scores(spark, path, LONG)
    expected = tuples(before)
    compact_scores(spark, path, LONG)
    append_scores(scored(spark, 170, 200), path)
    assert tuples(before) == expected and len(expected) == 170
    after = read_scores(spark, path, LONG)
    assert len(tuples(after)) == 200 and set(expected) < set(tuples(after))
    assert score_attempts(spark, path, LONG).count() == 200  # copies and errors are gone
    compact_scores(spark, path, LONG)
    drop_old_scores(spark, path, after=3600)
    assert tuples(before) == expected and len(tuples(after)) == 200  # still there
    drop_old_scores(spark, path, after=0)
    assert len(list((tmp_path / "s").glob("snapshot-*"))) == 1 and not list((tmp_path / "s" / "parts").iterdir())
    assert len(tuples(read_scores(spark, path, LONG))) == 200


def test_a_snapshot_without_its_generation_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "s")
    append_scores(scored(spark, 0, 20), path)
    scored(spark, 0, 500).write.parquet(f"{path}/snapshot-unfinished")
    assert read_scores(spark, path, LONG).count() == 20
    (tmp_path / "s" / "_generations").mkdir()
    (tmp_path / "s" / "_generations" / "_new-x").write_text("half a fi")
    assert read_scores(spark, path, LONG).count() == 20


def test_of_two_compactions_one_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    append_scores(scored(spark, 0, 20), path)
    real = tables._best

    def other_first(df):
        monkeypatch.setattr(tables, "_best", real)
        compact_scores(spark, path, LONG)
        append_scores(scored(spark, 20, 30), path)
        return real(df)

    monkeypatch.setattr(tables, "_best", other_first)
    with pytest.raises(RuntimeError, match="compacted"):
        compact_scores(spark, path, LONG)
    assert read_scores(spark, path, LONG).count() == 30
    assert len(list((tmp_path / "s").glob("snapshot-*"))) == 1


def test_runs_that_go_on_stay_beside_the_snapshot(spark, tmp_path):
    path = str(tmp_path / "s")
    append_scores(scored(spark, 0, 20), path)
    going_on = Folder(spark, path).at("parts", "p-going-on").toString()
    scored(spark, 20, 25).write.parquet(going_on)
    compact_scores(spark, path, LONG)
    scored(spark, 25, 30).write.mode("append").parquet(going_on)
    assert read_scores(spark, path, LONG).count() == 30
    compact_scores(spark, path, LONG, only_finished=False)
    drop_old_scores(spark, path, after=0)
    assert read_scores(spark, path, LONG).count() == 30 and not Folder(spark, path).names("parts")


def test_copies_are_scored_once_and_all_filled(spark, tmp_path):
    """A third of the rows are copies of one paper."""
    path = str(tmp_path / "s")
    df = papers(spark, 30).withColumn("paper_id", F.when(F.col("paper_id") % 3 == 0, 0).otherwise(F.col("paper_id")))
    done = scoring.classify(df, scoring.per_paper(answer), scoring.RELEVANCE, path)
    assert done.count() == 30 and done.where("is_relevant is null").count() == 0
    assert attempts(spark, path).agg(F.max("count"), F.count("*")).first() == (1, 21)


def test_most_copies_fall_away_before_the_shuffle_and_without_pandas(spark):
    """Also those that are a few batches apart; the texts do not become objects of Python."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, "7")
    try:
        df = papers(spark, 300).withColumn("paper_id", F.col("paper_id") % 20).coalesce(1)
        none = spark.createDataFrame([], "paper_id long, error string")
        pending = scoring.pending_papers(df, none)
        found = tuples(pending)
        plan = pending._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(rows, before)
    assert [r[0] for r in found] == list(range(20))
    assert [r[1].split("\n")[0] for r in found] == [f"Title: title {k}" for k in range(20)]  # the first of each
    assert "MapInArrow" in plan and "MapInPandas" not in plan


def test_merge_keeps_own_values(spark):
    new = spark.createDataFrame([(1, 1), (2, None), (3, None)], "paper_id int, is_relevant int")
    old = spark.createDataFrame([(1, 0), (2, 0)], "paper_id int, is_relevant int")
    assert {r.paper_id: r.is_relevant for r in scoring.merge_earlier(new, old).collect()} == {1: 1, 2: 0, 3: None}
    assert {r.paper_id: r.is_relevant for r in scoring.merge_earlier(new.drop("is_relevant"), old).collect()} == {1: 0, 2: 0, 3: None}
    repeated = old.union(old).union(spark.createDataFrame([(2, None)], old.schema))
    assert tuples(scoring.merge_earlier(new, repeated)) == [(1, 1), (2, 0), (3, None)]


def test_scores_table_may_not_exist_yet(spark, tmp_path):
    assert read_scores(spark, str(tmp_path / "none"), papers(spark).schema["paper_id"].dataType).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    source, path, state = (str(tmp_path / d) for d in ("in", "scores", "state"))
    scorer = scoring.per_paper(answer)

    def run():
        stream = spark.readStream.schema(papers(spark).schema).option("maxFilesPerTrigger", 1).parquet(source)
        score_stream(stream, scorer, scoring.RELEVANCE, path, state).awaitTermination()

    papers(spark).where("paper_id < 25").repartition(3).write.parquet(source)
    run()
    assert attempts(spark, path).count() == 25
    # A second drop overlaps the first one.
    papers(spark).where("paper_id >= 20").coalesce(1).write.mode("append").parquet(source)
    run()
    assert attempts(spark, path).where("count > 1").count() == 0
    scores = read_scores(spark, path, papers(spark).schema["paper_id"].dataType)
    batch = scoring.classify(papers(spark), scorer, scoring.RELEVANCE, str(tmp_path / "batch"))
    columns = ["paper_id", "is_relevant"]
    assert tuples(scoring.scatter(papers(spark), scores, scoring.RELEVANCE).select(columns)) == tuples(batch.select(columns))


def test_a_stream_that_lost_its_state_does_not_score_again(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "scores")
    papers(spark).write.parquet(source)
    for state in ("s1", "s2"):
        stream = spark.readStream.schema(papers(spark).schema).parquet(source)
        score_stream(stream, scoring.per_paper(answer), scoring.RELEVANCE, path, str(tmp_path / state)).awaitTermination()
    assert attempts(spark, path).count() == 40 and attempts(spark, path).where("count > 1").count() == 0


def test_a_micro_batch_reads_scores_of_others_once_and_none_of_its_own(spark, tmp_path):
    source, path, state = (str(tmp_path / d) for d in ("in", "scores", "state"))
    append_scores(scored(spark, 0, 10), path)
    # A third of the rows are copies of one paper.
    df = papers(spark).withColumn("paper_id", F.when(F.col("paper_id") % 3 == 0, 33).otherwise(F.col("paper_id")))
    read = []

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = score_stream(stream, scoring.per_paper(answer), scoring.RELEVANCE, path, state)
        query.awaitTermination()
        read.extend([s["numInputRows"] for s in p["sources"] if "scores" in s["description"]][0] for p in query.recentProgress if p["numInputRows"])

    for low, high in ((0, 14), (14, 26)):
        df.where(f"paper_id >= {low} AND paper_id < {high} OR paper_id = 33").coalesce(1).write.mode("append").parquet(source)
    run()
    assert read == [10, 0]  # scores are read when the stream first meets them
    append_scores(scored(spark, 26, 30), path)
    df.where("paper_id >= 20").coalesce(1).write.mode("append").parquet(source)
    run()
    assert read[2:] == [4]
    assert attempts(spark, path).where("count > 1").count() == 0
    assert {r.paper_id for r in attempts(spark, path).collect()} == {r.paper_id for r in df.collect()} | set(range(10)) | set(range(26, 30))


def test_a_stream_holds_few_papers_in_a_worker(spark, tmp_path, monkeypatch):
    """New papers come in small batches; those with a score count in them too and are not asked for."""
    monkeypatch.setattr(incremental, "BATCH_PAPERS", 10)
    source, path, sizes = str(tmp_path / "in"), str(tmp_path / "scores"), tmp_path / "sizes"
    sizes.mkdir()
    papers(spark, 600).write.parquet(source)
    append_scores(scored(spark, 0, 300), path)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)

    def scorer(batches):
        for batch in batches:
            (sizes / f"{len(batch)}-{batch['paper_id'].iloc[0]}").touch()
            yield batch[["paper_id"]].assign(reply="1", tokens=1, error=None)

    stream = spark.readStream.schema(papers(spark).schema).parquet(source)
    score_stream(stream, scorer, scoring.RELEVANCE, path, str(tmp_path / "state")).awaitTermination()
    found = [int(p.name.split("-")[0]) for p in sizes.iterdir()]
    assert sum(found) == 300 and max(found) <= 10
    assert spark.conf.get(rows) == before
    assert attempts(spark, path).agg(F.count("*"), F.max("count")).first() == (600, 1)


def test_every_paper_of_a_stream_gives_a_row():
    """Spark flushes by the rows that papers give: without one, the states of scored papers would pile up in the worker."""

    class State:
        exists = True

    again = pd.DataFrame({"paper_id": [1], "prompt": ["p"]})
    (found,) = incremental._new_papers((1,), iter([again]), State())
    assert found.to_dict("records") == [{"paper_id": 1, "prompt": None}]


def test_a_micro_batch_that_failed_keeps_its_replies(spark, tmp_path):
    source, path, state = (str(tmp_path / d) for d in ("in", "scores", "state"))
    papers(spark, 60).coalesce(1).write.parquet(source)
    plain = scoring.per_paper(answer)

    def breaks(batches):
        for number, scored in enumerate(plain(batches)):
            if number == 2:
                raise SystemError("executor is gone")
            yield scored

    def run(scorer):
        stream = spark.readStream.schema(papers(spark).schema).parquet(source)
        score_stream(stream, scorer, scoring.RELEVANCE, path, state, papers_per_commit=2).awaitTermination()

    with pytest.raises(Exception):
        run(breaks)
    kept = attempts(spark, path).count()
    assert 0 < kept < 60
    run(plain)
    assert attempts(spark, path).count() == 60 and attempts(spark, path).where("count > 1").count() == 0


def test_duplicate_attempts_give_one_score(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [(1, None, None, "failed"), (1, "1", 2, None), (1, "1", 2, None), (2, None, None, "failed")]
    append_scores(spark.createDataFrame(rows, "paper_id int, reply string, tokens long, error string"), path)
    got = read_scores(spark, path, spark.createDataFrame([(1,)], "paper_id int").schema["paper_id"].dataType)
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, "1", 2, None), (2, None, None, "failed")]
