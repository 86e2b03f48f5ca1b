"""Word-list classifier: labels from indicator words, without a model."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom import taxonomy
from paperloom.functions.phrases import Phrase, in_the_book, pattern_of, phrases_found
from paperloom.functions.topic import TOPIC_FIELDS, topic_text


def _is_plain(word: str) -> bool:
    return word == word.lower()


def _singular(word: str) -> str:
    """The word without a plural s, so that both forms match."""
    return word[:-1] if re.search(r"[^sui]s$", word) else word


def word_phrase(word: str) -> Phrase:
    """Plain words match in any letter case and with any ending; names and acronyms match as written.
    Both match with or without a plural s, also where the list has the plural."""
    plain, word = _is_plain(word), _singular(word)
    return Phrase(word, any_ending=True) if plain else Phrase(word, plural=True, as_written=True)


def label_pattern(words: Sequence[str]) -> str:
    return pattern_of([word_phrase(w) for w in words])


def _hits(text: Column, lists: Sequence[Sequence[str]]) -> list[Column]:
    """How often words of each list occur; one pass over the text for all lists."""
    phrases = [[word_phrase(w) for w in words] for words in lists]
    listed = [k for k, some in enumerate(phrases) if in_the_book(some)]
    found = phrases_found(text, [phrases[k] for k in listed])
    return [
        F.size(found[listed.index(k)]) if k in listed else F.coalesce(F.regexp_count(text, F.lit(pattern_of(some))), F.lit(0))
        for k, some in enumerate(phrases)
    ]


def tag_with_lexicon(
    df: DataFrame,
    lexicon: Mapping[str, Sequence[str]],
    fallback: str,
    title: str = "article_title",
    fields: Sequence[str] = tuple(TOPIC_FIELDS),
) -> DataFrame:
    """Adds ``labels`` (with hits, in lexicon order), ``primary_label`` and ``confidence``.

    The primary label has the most hits, the earlier one in the lexicon on a tie. A hit in the title
    gives high confidence, a hit elsewhere medium; no hit gives the fallback label and low.
    """
    in_text = F.array(*_hits(F.col("_text"), list(lexicon.values())))
    everything = [w for words in lexicon.values() for w in words]
    in_title = _hits(F.col(title), [everything])[0] > 0 if title in df.columns else F.lit(False)
    # The fields become one text, and hits one array, in their own steps: both are read many times below.
    counted = df.withColumn("_text", topic_text(df, fields)).withColumns({"_counts": in_text, "_in_title": in_title})
    entries = [
        F.struct(F.col("_counts")[i].alias("hits"), F.lit(-i).alias("order"), F.lit(label).alias("label"))
        for i, label in enumerate(lexicon)
    ]
    counted = counted.withColumn("_hits", F.filter(F.array(*entries), lambda h: h["hits"] > 0))
    found = F.size("_hits") > 0
    return counted.withColumns(
        {
            "labels": F.when(found, F.transform("_hits", lambda h: h["label"])).otherwise(F.array(F.lit(fallback))),
            "primary_label": F.when(found, F.array_max("_hits")["label"]).otherwise(fallback),
            "confidence": F.when(found & F.col("_in_title"), "high").when(found, "medium").otherwise("low"),
        }
    ).drop("_text", "_counts", "_in_title", "_hits")


def classify_materials_by_words(df: DataFrame) -> DataFrame:
    """Fills the three material columns from the indicator words."""
    tagged = tag_with_lexicon(df, taxonomy.MATERIAL_WORDS, taxonomy.MATERIAL_FALLBACK)
    return tagged.withColumnsRenamed(
        {"labels": "material_categories", "primary_label": "primary_material_category", "confidence": "material_confidence"}
    )


def classify_methods_by_words(df: DataFrame) -> DataFrame:
    """Fills the four method columns: category and confidence from method words, models and tags as found."""
    names = [w for words in taxonomy.METHOD_WORDS.values() for w in words if not _is_plain(w)]
    # Longest name first, so that a name is not taken for a shorter one it starts with.
    names.sort(key=len, reverse=True)
    found = phrases_found(F.col("_all"), [[Phrase(n, plural=True, as_written=True) for n in names]])[0]
    listed = F.array(*[F.lit(n) for n in names])
    tags = [F.when(F.lower("_all").contains(tag), tag) for tag in taxonomy.METHOD_TAGS]
    df = (
        df.withColumn("_all", topic_text(df, TOPIC_FIELDS))
        .withColumns(
            {
                "model_specific_models": F.transform(F.array_distinct(found), lambda k: F.get(listed, k)),
                "model_secondary_tags": F.array_compact(F.array(*tags)),
            }
        )
        .drop("_all")
    )
    tagged = tag_with_lexicon(df, taxonomy.METHOD_WORDS, taxonomy.METHOD_FALLBACK)
    return tagged.drop("labels").withColumnsRenamed(
        {"primary_label": "model_primary_category", "confidence": "model_confidence"}
    )
