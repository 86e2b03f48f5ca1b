"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import WORD_PATTERN, fresh, known_id, staged

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BUCKET_ROWS = 20_000
DEFAULTS = {"weights": WEIGHTS, "repeats": MOST_REPEATS, "seed": "mix", "bucket_rows": BUCKET_ROWS}


def words_in(text: Column) -> Column:
    """Number of words; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """``source_rank``, ``target`` for every row of ``source, source_size``.

    Sources in code point order, null last, take the weights in turn. The targets share all sizes by
    weight; none is above ``repeats`` times its source's size, the excess goes to the others by weight.
    The table of sources is one row a source, so one task orders it.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    choice = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("source_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("source_rank", F.row_number().over(order)).withColumn("weight", choice)
    # Sources meet their limit in the order of size over weight, so one running sum finds the level.
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "source_rank")
    whole = Window.partitionBy()
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    limit = F.lit(repeats) * F.col("source_size")
    levels = (
        ranked.withColumn("limit", limit)
        .withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(upto), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("weights_left"))
        .withColumn("open", F.col("limit") > F.col("level") * F.col("weight"))
        # The level of the first source that stays below its limit holds for all after it.
        .withColumn("level", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, 0)))
    )
    return levels.select(
        "source", "source_size", "source_rank",
        F.coalesce(F.col("level") * F.col("weight"), F.col("limit").cast("double")).alias("target"),
    )


def _queue(documents: DataFrame, weights: Sequence[float], repeats: int, seed: str, bucket_rows: int) -> DataFrame:
    """All copies of all documents with their finish times, and whether the mix takes them."""
    rows = documents.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.xxhash64("text").alias("row_hash"),
        words_in(F.col("text")).alias("size"),
        # The text counts too, so rows that share an id, or have none, are spread like others.
        F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit(""))), F.lit(seed))).alias("turn"),
    )
    rows = staged(rows, "mix")  # the texts are read once
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    n, budget = sources.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    buckets = 1 << (n // bucket_rows).bit_length()
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("turn", 1, 6), 16, 10).cast("long") * buckets / (1 << 24)).cast("int"))

    # What comes next reads these tables from the shared folder: in one plan they would stand in it many times,
    # and the driver's memory goes by the size of its plans.
    shares = staged(targets(sources.select("source", "source_size"), weights, repeats), "mix-shares")
    # Documents without words take no time and pass the queue by.
    empty = rows.where("size = 0").join(shares.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    empty = empty.select("*", F.lit(0).alias("seat"), F.lit(0).alias("copy"), F.lit(0.0).alias("finish"), F.lit(True).alias("taken"))
    rows = rows.where("size > 0")

    order = ["turn", "doc_id", "size", "row_hash"]
    inside = Window.partitionBy("source", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    offsets = offsets.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset")
    )
    offsets = staged(offsets, "mix-offsets")  # a row a bucket
    shares = shares.withColumnRenamed("source", "s")
    finish = (F.col("copy") * F.col("source_size") + F.col("offset") + F.col("within")) / F.col("target")
    copies = (
        rows.withColumn("within", F.sum("size").over(inside))
        .withColumn("seat", F.row_number().over(inside))
        .join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .drop("s", "b")
        .join(shares, F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .withColumn("finish", finish)
        # All targets are met at the time 1, so the cut lies near it; late copies have wider slots.
        .withColumn("slot", F.floor(buckets * F.when(F.col("finish") < 4, F.col("finish")).otherwise(F.log2("finish") + 2)).cast("int"))
    )
    copies = staged(copies, "mix-copies")
    earlier = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = copies.groupBy("slot").agg(F.sum("size").alias("words"))
    slots = slots.select(F.col("slot").alias("at"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("earlier"))
    slots = staged(slots, "mix-slots")
    queue = Window.partitionBy("slot").orderBy("finish", "source_rank", "copy", *order).rowsBetween(Window.unboundedPreceding, 0)
    timed = copies.join(slots, F.col("slot") == F.col("at")).drop("at")
    # Only slots that begin within the budget need the order of their rows.
    sure_not = timed.where(F.col("earlier") >= F.lit(budget)).withColumn("taken", F.lit(False))
    ordered = timed.where(F.col("earlier") < F.lit(budget))
    ordered = ordered.withColumn("taken", F.col("earlier") + F.sum("size").over(queue) <= F.lit(budget))
    columns = ["doc_id", "source", "row_hash", "size", "bucket", "seat", "source_size", "target", "copy", "finish", "taken"]
    return ordered.select(columns).unionByName(sure_not.select(columns)).unionByName(empty.select(columns))


def mix(
    documents: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    repeats: int = MOST_REPEATS,
    seed: str = "mix",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row for each copy that the mix takes, with ``finish``, its virtual finish time.

    Every source is shuffled by a hash of the id, the text and the seed, and its documents queue up to
    ``repeats`` times. A copy's finish time is the cumulative number of words of its source divided by
    the source's target; sorting all copies by it interleaves the sources in proportion, and the mix is
    cut where the words reach the total of all documents. Copies are dealt to tasks by ranges of the
    finish time; sort by ``finish`` and ``source`` to get the mixed order.

    Returns doc_id, row_hash, size, source, source_size, target, copy (from 0), finish. ``row_hash``, a
    hash of the text, tells rows with one doc_id apart. Documents without words are taken once and add
    nothing. Null texts have no words; null sources and ids are a source and an id of their own; equal
    rows queue as separate documents; an empty table gives an empty mix. Other columns are ignored.
    Running sums are taken in two steps, within buckets of about ``bucket_rows`` rows and over the
    buckets, so a source with most of the rows is spread over many tasks; rows that are equal in id and text
    stand in one bucket. One task orders the sources, another the buckets of a source and the slots of
    time, a row each. Only the numbers of documents and words reach the driver.
    """
    queue = _queue(documents, weights, repeats, seed, bucket_rows)
    return queue.where("taken").select("doc_id", "row_hash", "size", "source", "source_size", "target", "copy", "finish")


def words_taken(
    documents: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    repeats: int = MOST_REPEATS,
    seed: str = "mix",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Every document with doc_id, source, size, source_size, target, copies and ``taken``, its words in the mix."""
    queue = _queue(documents, weights, repeats, seed, bucket_rows)
    columns = ["doc_id", "source", "size", "source_size", "target"]
    counted = queue.where("size > 0").groupBy("bucket", "seat", *columns).agg(F.sum(F.when(F.col("taken"), 1).otherwise(0)).alias("copies"))
    empty = queue.where("size = 0").withColumn("copies", F.lit(1).cast("long"))
    found = counted.select(*columns, "copies").unionByName(empty.select(*columns, "copies"))
    return found.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(documents: DataFrame, **parameters) -> DataFrame:
    """The documents that the mix takes, each as often as it does, with all their columns; see ``mix``."""
    id_text, row_hash, origin, total, rows_of, seat, copy = fresh(documents, "id_text", "row_hash", "origin", "total", "rows_of", "seat", "copy")
    queue = _queue(documents, **(DEFAULTS | parameters))
    taken = queue.groupBy(
        known_id("doc_id").alias(id_text), F.col("row_hash").alias(row_hash), F.coalesce("source", F.lit("")).alias(origin)
    ).agg(F.sum(F.col("taken").cast("int")).alias(total), F.count_if(F.col("copy") == 0).alias(rows_of))
    rows = (
        documents.withColumn(id_text, known_id("doc_id"))
        .withColumn(row_hash, F.xxhash64("text"))
        .withColumn(origin, F.coalesce(F.col("source").cast("string"), F.lit("")))
        .join(taken.where(F.col(total) > 0), [id_text, row_hash, origin])
    )
    # Equal rows share the copies that they have together.
    turn = F.row_number().over(Window.partitionBy(id_text, row_hash, origin).orderBy(F.lit(0)))
    own = F.expr(f"int({total} div {rows_of})") + F.when(F.col(seat) <= F.col(total) % F.col(rows_of), 1).otherwise(0)
    return (
        rows.withColumn(seat, turn)
        .withColumn(copy, F.explode(F.array_repeat(F.lit(0), own.cast("int"))))
        .select(*documents.columns)
    )
