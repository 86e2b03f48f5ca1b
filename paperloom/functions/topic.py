"""Boolean topic search over paper text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom import taxonomy
from paperloom.functions.phrases import WORD, Phrase, in_the_book, pattern_of, phrases_found

TOPIC_FIELDS = ["article_title", "abstract", "author_keywords", "keywords_plus"]


def term_phrase(term: str) -> Phrase:
    """A term: blanks match any white space, a trailing star any word ending."""
    return Phrase(term.removesuffix("*"), any_ending=term.endswith("*"))


def group_pattern(terms: Sequence[str]) -> str:
    """Any of the terms, whole words only, in any letter case, as a regular expression."""
    return pattern_of([term_phrase(t) for t in terms])


def topic_text(df: DataFrame, fields: Sequence[str]) -> Column:
    """The present fields as one text; the bar between them keeps phrases from crossing fields."""
    present = [F.col(c) for c in fields if c in df.columns]
    return F.concat_ws(" | ", *present)


def topic_match(text: Column, all_of: Sequence[Sequence[str]], none_of: Sequence[Sequence[str]] = ()) -> Column:
    """Every group of ``all_of`` has a hit, no group of ``none_of`` has one; one pass finds all."""
    groups = [[term_phrase(t) for t in terms] for terms in (*all_of, *none_of)]
    listed = [k for k, group in enumerate(groups) if in_the_book(group)]
    found = phrases_found(text, [groups[k] for k in listed])
    match = F.lit(True)
    for k, group in enumerate(groups):
        hit = F.size(found[listed.index(k)]) > 0 if k in listed else F.coalesce(text.rlike(pattern_of(group)), F.lit(False))
        match = match & (hit if k < len(all_of) else ~hit)
    return match


def topic_filter(
    df: DataFrame,
    all_of: Sequence[Sequence[str]] = tuple(taxonomy.TOPIC_ALL_OF),
    none_of: Sequence[Sequence[str]] = tuple(taxonomy.TOPIC_NONE_OF),
    fields: Sequence[str] = tuple(TOPIC_FIELDS),
    category_column: str = "wos_category",
    excluded_categories: Sequence[str] = tuple(taxonomy.TOPIC_EXCLUDED_CATEGORIES),
) -> DataFrame:
    """Papers on the topic; the category test is left out where the table has no such column."""
    if category_column in df.columns and excluded_categories:
        names = F.transform(F.split(F.col(category_column), ";"), lambda c: F.lower(F.trim(c)))
        unwanted = F.arrays_overlap(names, F.array(*[F.lit(c.lower()) for c in excluded_categories]))
        df = df.where(~F.coalesce(unwanted, F.lit(False)))
    return df.where(topic_match(topic_text(df, fields), all_of, none_of))
