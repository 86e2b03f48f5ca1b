"""Judging URLs by rules on hosts and paths, by a sort-merge range join; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import fresh, staged

SLOT_ROWS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL, PATH = "\x01", "\x00"  # end of a label, begin of the path


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case, else empty."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What stands between the host and ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_key(host: Column) -> Column:
    """The labels of a host from the last to the first, each with an end mark.

    A host is a subdomain of another, or the same, if and only if its key begins with the other's.
    """
    plain = F.replace(host, F.lit("\x02"), F.lit("\x02c"))
    plain = F.replace(F.replace(plain, F.lit(LABEL), F.lit("\x02b")), F.lit(PATH), F.lit("\x02a"))
    return F.concat_ws("", F.transform(F.reverse(F.split(plain, "[.]")), lambda label: F.concat(label, F.lit(LABEL))))


def sweep(probes: DataFrame, prefixes: DataFrame, slot_rows: int = SLOT_ROWS, every_level: bool = False) -> DataFrame:
    """The probes, each with the longest prefix that its key begins with: a range join of points and intervals.

    ``probes`` has a text ``key``, ``prefixes`` distinct texts ``prefix``, each with an ``entry``. A prefix is the interval of all
    keys from itself to itself and the byte FF, which no UTF-8 text has; two such intervals are nested or
    disjoint. Points and both ends of all intervals are sorted together and dealt to slots by ranges of the
    key (and a hash, so that a key on most rows is dealt to many slots). Each slot is swept with a stack of
    open intervals: a running count of ends is its depth, and the entry at a depth is the last interval
    opened there. Intervals that reach into later slots are opened again in each; these are at most the
    depth for each slot, however long the intervals are.

    Returns the columns of ``probes`` with the ``entry`` of the prefix. Probes in no
    interval give no row; with ``every_level`` a probe gives a row for each interval that holds it.
    """
    key, kind, change, slot, depth, level, salt = fresh(probes, "at", "kind", "change", "slot", "depth", "level", "salt")
    begin = F.encode("prefix", "UTF-8")
    opened = prefixes.select("prefix", "entry", begin.alias(key), F.lit(0).alias(kind), F.lit(1).alias(change))
    closed = prefixes.select("prefix", "entry", F.concat(begin, F.unhex(F.lit("FF"))).alias(key), F.lit(2).alias(kind), F.lit(-1).alias(change))
    points = probes.select("*", F.encode("key", "UTF-8").alias(key), F.lit(1).alias(kind), F.lit(0).alias(change), F.xxhash64(*probes.columns).alias(salt))
    events = points.unionByName(opened, allowMissingColumns=True).unionByName(closed, allowMissingColumns=True)
    slots = probes.count() // slot_rows + 1
    dealt = staged(events.repartitionByRange(slots, key, kind, salt).withColumn(slot, F.spark_partition_id()), "sweep")

    reach = dealt.where(F.col(kind) != 1).groupBy("prefix").agg(F.first("entry").alias("entry"), F.min(slot).alias("first"), F.max(slot).alias("last"))
    later = reach.where("last > first").select(
        "prefix", "entry", begin.alias(key), F.lit(0).alias(kind), F.lit(1).alias(change),
        F.explode(F.sequence(F.col("first") + 1, F.col("last"))).alias(slot),
    )
    line = Window.partitionBy(slot).orderBy(key, kind, salt).rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.unionByName(later, allowMissingColumns=True).withColumn(depth, F.sum(change).over(line))
    # At a close the depth is that of the intervals around it, which its point of the stack must not hide.
    swept = swept.where(F.col(kind) != 2).where(F.col(depth) > 0)
    lowest = F.when(F.col(kind) == 1, F.lit(1)).otherwise(F.col(depth)) if every_level else F.col(depth)
    swept = swept.withColumn(level, F.explode(F.sequence(lowest, F.col(depth))))
    stack = Window.partitionBy(slot, level).orderBy(key, kind, salt).rowsBetween(Window.unboundedPreceding, 0)
    held = swept.withColumn("entry", F.last("entry", ignorenulls=True).over(stack))
    return held.where(F.col(kind) == 1).select(*probes.columns, "entry")


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", slot_rows: int = SLOT_ROWS) -> DataFrame:
    """All pages with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and all subdomains, where the
    page's path begins with the rule's. Of the rules that fit, the longest one (host and path together, then
    the longer host) gives the verdict; where none fits, ``rule`` is null and the verdict is the default.

    Two sweeps do it. In the first each distinct host meets the hosts of rules that it lies under. In the
    second the path of a page is looked up below each of these, and finds the longest path of a rule there.
    Nothing depends on the number of rules of a host, or of pages of one.

    A url that is null or has no ``://`` has an empty host and path. Hosts keep ports and names of users.
    Rules with a null or empty host fit all hosts, those with a null or empty path all paths; of equal rules
    with different verdicts the last in the order of text counts. Repeated pages are judged each; an empty
    table of pages or rules is no special case. Columns of ``pages`` called host, path, rule or verdict are
    replaced, other columns pass through.
    """
    made = {"host", "path", "rule", "verdict"}
    kept = [c for c in pages.columns if c.lower() not in made]
    row = fresh(pages, "page_row")[0]
    numbered = pages.select(*[F.col(f"`{c}`") for c in kept], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    pages = staged(numbered.withColumn(row, F.monotonically_increasing_id()), "urls")  # ids hold from here on

    place = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER)
    rules = rules.select(place.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    under = F.when(F.col("host") == "", F.lit("")).otherwise(host_key(F.col("host")))
    rules = rules.select(
        under.alias("under"), F.concat(under, F.lit(PATH), "path").alias("prefix"),
        F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict").alias("entry"),
    )

    hosts = pages.select("host").distinct().withColumn("key", host_key(F.col("host")))
    outer = rules.select(F.col("under").alias("prefix"), F.col("under").alias("entry")).distinct()
    above = staged(sweep(hosts, outer, slot_rows, every_level=True).select("host", F.col("entry").alias("under")), "hosts")
    probes = pages.select(row, "host", "path").join(above, "host")
    probes = staged(probes.select(F.col(row).alias("page_row"), F.concat("under", F.lit(PATH), "path").alias("key")), "paths")
    found = sweep(probes, rules.select("prefix", "entry"), slot_rows)
    best = found.groupBy(F.col("page_row").alias(row)).agg(F.max("entry").alias("best"))
    return pages.join(best, row, "left").select(
        *[F.col(f"`{c}`") for c in kept], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
