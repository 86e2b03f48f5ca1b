"""Prompt text for a classifier that reads papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom import taxonomy


def _cell(df: DataFrame, name: str) -> Column:
    """Text of a cell: ``N/A`` where the table has no such column, ``nan`` where the cell is empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("nan")) if name in df.columns else F.lit("N/A")


def paper_text(df: DataFrame) -> Column:
    """The paper as the classifier sees it."""
    return F.concat(
        F.lit("Title: "), _cell(df, "article_title"),
        F.lit("\nKeywords: "), _cell(df, "author_keywords"), F.lit(" | "), _cell(df, "keywords_plus"),
        F.lit("\nAbstract: "), _cell(df, "abstract"),
    )


def render_prompts(df: DataFrame, guide: str = "") -> DataFrame:
    """``paper_id`` and the prompt of each paper.

    The guide is the same for all papers; scoring jobs hand it to the scorer once per task instead
    of putting it on every row.
    """
    return df.select("paper_id", F.concat(paper_text(df), F.lit(f"\n\n{guide}" if guide else "")).alias("prompt"))


def _words(lexicon: dict[str, list[str]], labels: list[str]) -> str:
    return "\n".join(f"- {label}: {', '.join(lexicon[label])}" if label in lexicon else f"- {label}" for label in labels)


# What a paper must do to count: every question with yes. They follow from the definition of the task,
# a program that turns written reports about substances into data.
RELEVANCE_TEST = {
    "source": "Are written documents the input (articles, patents, theses, reports, their tables or figures)?",
    "content": "Do the facts it is after belong to substances: what they consist of, how they are made, how they behave?",
    "reader": "Does software find these facts, or is a method, data set or tool for such software the paper's subject?",
}
METHOD_ADVICE = (
    "Look for the step that turns text into facts and classify that step; what is done with the facts afterwards "
    "does not matter. If two steps share the work, the one without which nothing would be found decides. "
    f"Use {taxonomy.METHOD_FALLBACK} when title, keywords and abstract leave the step open. specific_models holds "
    "names as the paper writes them, and is empty if it gives none; secondary_tags holds only tags from the list."
)
MATERIAL_ADVICE = (
    "A category belongs to the paper if someone who collects papers on that category would want this one. "
    "Judge by use where a category is named for a use and by build where it is named for a build; both may hold. "
    f"{taxonomy.MATERIAL_FALLBACK} stands alone, for papers that no other category fits."
)
CONFIDENCE_ADVICE = (
    "confidence says where the answer comes from: "
    + ", ".join(f"{level} {origin}" for level, origin in zip(taxonomy.CONFIDENCE_LEVELS, ("quoted from the text", "concluded from it", "guessed"), strict=True))
    + "."
)


def _object(**keys: str) -> str:
    return "Reply with a JSON object and nothing else: " + "; ".join(f"{name} = {what}" for name, what in keys.items()) + "."


RELEVANCE_GUIDE = (
    "Three questions about the paper above.\n"
    + "\n".join(f"{name}: {question}" for name, question in RELEVANCE_TEST.items())
    + "\nReply 1 if the answer to all three is yes, otherwise 0. Nothing but the digit."
)
METHOD_GUIDE = "\n".join(
    [
        "Which kind of method extracts the information in the paper above? The kinds, with words that often go with them:",
        _words(taxonomy.METHOD_WORDS, taxonomy.METHOD_LABELS),
        METHOD_ADVICE,
        f"Tags: {', '.join(taxonomy.METHOD_TAGS)}.",
        CONFIDENCE_ADVICE,
        _object(primary_category="one kind", specific_models="list of names", secondary_tags="list of tags", confidence="/".join(taxonomy.CONFIDENCE_LEVELS)),
    ]
)
MATERIAL_GUIDE = "\n".join(
    [
        "Which materials is the paper above about? The categories, with words that often go with them:",
        _words(taxonomy.MATERIAL_WORDS, taxonomy.MATERIAL_LABELS),
        MATERIAL_ADVICE,
        CONFIDENCE_ADVICE,
        _object(material_categories="list of categories", primary_category="the first of them by weight", confidence="/".join(taxonomy.CONFIDENCE_LEVELS)),
    ]
)
