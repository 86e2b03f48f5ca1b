"""Secret scans by a trigram index; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from re import _constants as ops
from re import _parser  # the standard library's reader of patterns; its tree is plain tuples

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import staged, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a Java regular expression, the group that must be long enough, and that length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules of the contract. A run is at least as long as its least length, so a pattern
# with that length finds the same runs as one without it that drops the short ones.
BASE = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Public formats of keys and tokens, added by the method.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("live", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("basic", r"[a-z][a-z0-9+.-]{1,9}://[^\s:/@]{1,64}:[^\s/@]{3,64}@"),
)

CHUNK = 256  # matches of a rule in a text that are added up at a time
MOST_STRINGS = 64  # of an exact part of a pattern; beyond it the part ends there, which asks for less, never more

Query = list[list[frozenset[str]]]  # all of: one of: all these trigrams


def _strings(tree) -> set[str] | None:
    """All strings that a part of a pattern matches, in lower case, if they are few."""
    found = {""}
    for op, value in tree:
        if op is ops.LITERAL:
            more = {chr(value).lower()}
        elif op is ops.IN and all(o is ops.LITERAL for o, _ in value):
            more = {chr(v).lower() for _, v in value}
        elif op is ops.SUBPATTERN:
            more = _strings(value[3])
        elif op is ops.BRANCH:
            parts = [_strings(p) for p in value[1]]
            more = None if None in parts else set().union(*parts)
        elif op is ops.MAX_REPEAT and value[1] == 1:
            more = _strings(value[2])
            more = None if more is None else more | ({""} if value[0] == 0 else set())
        else:
            more = None
        if more is None or len(found) * len(more) > MOST_STRINGS:
            return None
        found = {a + b for a, b in product(found, more)}
    return found


def trigram_query(pattern: str) -> Query:
    """Which trigrams a text must have for the pattern to match it, after lower case; empty if any text may match.

    Exact strings of the pattern that stand side by side are joined; where something unbounded follows, all
    their trigrams are asked for, one of the strings' sets being enough. Sets that ask for more than another
    are left out.
    """
    query: Query = []

    def close(strings: set[str]) -> None:
        sets = [frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings]
        if all(sets):
            query.append(sorted({x for x in sets if not any(y < x for y in sets)}, key=sorted))

    def walk(tree, before: set[str]) -> set[str]:
        for item in tree:
            exact = _strings([item])
            if exact is None or len(before) * len(exact) > MOST_STRINGS:
                op, value = item
                if op is ops.SUBPATTERN:
                    before = walk(value[3], before)
                elif op is ops.MAX_REPEAT and value[0] > 0 and (once := _strings(value[2])) and len(before) * len(once) <= MOST_STRINGS:
                    close({a + b for a, b in product(before, once)})
                    before = {""}
                else:
                    close(before)
                    before = exact or {""}
            else:
                before = {a + b for a, b in product(before, exact)}
        return before

    close(walk(_parser.parse(pattern), {""}))
    return query


def index(documents: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``trigram, doc_id, row_hash``: the postings of all trigrams that the rules ask for."""
    wanted = sorted({t for r in rules for one_of in trigram_query(r.pattern) for s in one_of for t in s})
    lower = documents.select("doc_id", F.xxhash64("text").alias("row_hash"), F.lower(text_or_empty()).alias("lower"))
    held = F.array_compact(F.array(*[F.when(F.contains("lower", F.lit(t)), F.lit(t)) for t in wanted]))
    return lower.select(F.explode(held).alias("trigram"), "doc_id", "row_hash")


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``doc_id, row_hash, kinds``: by intersection of postings, the documents that a rule may match, and the rules."""
    held = postings.groupBy("doc_id", "row_hash").agg(F.collect_set("trigram").alias("held"))  # at most all asked for
    kinds = []
    for rule in rules:
        may = F.lit(True)
        for one_of in trigram_query(rule.pattern):
            any_of = F.lit(False)
            for trigrams in one_of:
                any_of = any_of | (F.size(F.array_except(F.array(*map(F.lit, sorted(trigrams))), "held")) == 0)
            may = may & any_of
        kinds.append(F.when(may, F.lit(rule.kind)))
    return held.select("doc_id", "row_hash", F.array_compact(F.array(*kinds)).alias("kinds")).where(F.size("kinds") > 0)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it inside other functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Places of the rule's matches, leftmost first and not overlapping: start, order of the rule, end, kind.

    The parts between the matches and the matches themselves give the places, in code points.
    """
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.greatest(F.lit(1), F.size(matches)))
    enough = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    steps = F.zip_with(
        F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))),
        enough,
        lambda s, e: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), (F.length(e) >= rule.least).alias("keep")),
    )
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    numbers = F.array().cast("array<int>")

    def next_start(state: Column, size: Column) -> Column:
        return F.struct((state["at"] + size).alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts"))

    def add(state: Column, step: Column) -> Column:
        start = state["at"] + step["gap"]
        end = start + step["size"]
        span = F.struct(start.alias("start"), F.lit(order).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(step["keep"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    def of_chunk(chunk: Column, start: Column) -> Column:
        return F.aggregate(chunk, F.struct(start.alias("at"), none.alias("spans")), add, lambda state: state["spans"])

    def chunked(steps: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(steps), F.lit(CHUNK)), lambda at: F.slice(steps, at, F.lit(CHUNK)))

    def placed(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda chunk: F.aggregate(chunk, F.lit(0), lambda at, step: at + step["gap"] + step["size"]))
        starts = F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), next_start, lambda state: state["starts"])
        return F.flatten(F.zip_with(chunks, starts, of_chunk))

    # Adding to an array copies it, so matches are added up in chunks, and the chunks' sums to where they begin.
    found = _once(_once(steps, chunked), placed)
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def scan(documents: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """``doc_id, row_hash, spans`` for every row: the secrets in its text, by start, then in the rules' order.

    A span has ``start`` and ``end`` (code points, end exclusive), ``rank`` (the rule's number) and ``kind``.
    Every rule's pattern is turned into a Boolean query of trigrams. The postings of these trigrams are
    written once; their intersection names the documents that a rule may match, and only there is its
    pattern tried. Rules without a mandatory trigram are tried on all texts. Null texts are empty; rows
    without an id are scanned too; repeated rows come back repeated; an empty table gives an empty result;
    other columns are ignored. All work is done by DataFrame functions.
    """
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    rank = {r.kind: k for k, r in enumerate(rules)}
    rows = documents.select("doc_id", F.xxhash64("text").alias("row_hash"), text_or_empty().alias("text"))
    everywhere = [_spans(F.col("text"), r, rank[r.kind]) for r in rules if r not in indexed]
    scanned = rows.select("doc_id", "row_hash", (F.concat(*everywhere) if everywhere else F.array()).alias("spans"))
    if indexed:
        wanted = candidates(staged(index(documents, indexed), "postings"), indexed)
        wanted = wanted.select(F.col("doc_id").alias("id"), F.col("row_hash").alias("hash"), "kinds")
        same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("hash"))
        tried = [F.when(F.array_contains("kinds", r.kind), _spans(F.col("text"), r, rank[r.kind])) for r in indexed]
        found = rows.join(wanted, same).select("id", "hash", F.flatten(F.array_compact(F.array(*tried))).alias("found"))
        found = found.where(F.size("found") > 0).dropDuplicates(["id", "hash"])
        scanned = scanned.join(found, same, "left").withColumn("spans", F.concat("spans", F.coalesce("found", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>"))))
    return scanned.select("doc_id", "row_hash", F.array_sort("spans").alias("spans"))


def as_text(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(documents: DataFrame) -> DataFrame:
    """The scan as counts of the base rules, a hash of their spans, and all spans as text."""
    found = scan(documents)
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in BASE]
    return found.select("doc_id", *counts, F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
