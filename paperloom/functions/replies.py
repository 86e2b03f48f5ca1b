"""Strict parsing of classifier replies into typed columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom import taxonomy
from paperloom.functions.lists import STRICT_JSON, once, surely_without_null, well_formed
from paperloom.functions.text import strip_space

TEXT, LIST = "string", "array<string>"
_FENCE = "`" * 3


@dataclass(frozen=True)
class Field:
    """One field of a reply: its key, the column it fills and its two defaults."""

    key: str
    column: str
    type: str
    if_missing: object
    if_unreadable: object


@dataclass(frozen=True)
class ReplyFormat:
    fields: tuple[Field, ...]
    strip_inside_fence: bool = False

    @property
    def columns(self) -> list[str]:
        return [f.column for f in self.fields]


METHOD_REPLY = ReplyFormat(
    (
        Field("primary_category", "model_primary_category", TEXT, taxonomy.METHOD_FALLBACK, taxonomy.METHOD_FALLBACK),
        Field("specific_models", "model_specific_models", LIST, [], []),
        Field("secondary_tags", "model_secondary_tags", LIST, [], []),
        Field("confidence", "model_confidence", TEXT, "low", "low"),
    )
)
MATERIAL_REPLY = ReplyFormat(
    (
        Field("material_categories", "material_categories", LIST, [], [taxonomy.MATERIAL_FALLBACK]),
        Field("confidence", "material_confidence", TEXT, "low", "low"),
        Field(
            "primary_category", "primary_material_category", TEXT,
            taxonomy.MATERIAL_FALLBACK, taxonomy.MATERIAL_FALLBACK,
        ),
    ),
    strip_inside_fence=True,
)


def unfence(reply: Column, strip_inside: bool = False) -> Column:
    """Text inside the first code fence if the reply starts with one, without a leading ``json`` tag."""
    text = strip_space(reply)
    inside = F.split_part(text, F.lit(_FENCE), F.lit(2))
    inside = F.when(inside.startswith("json"), F.substring(inside, F.lit(5), F.length(inside))).otherwise(inside)
    if strip_inside:
        inside = strip_space(inside)
    return F.when(text.startswith(_FENCE), inside).otherwise(text)


def _literal(value: object, type_: str) -> Column:
    if isinstance(value, list):
        return F.array(*[F.lit(v) for v in value]).cast(type_)
    return F.lit(value).cast(type_)


def reply_columns(reply: Column, fmt: ReplyFormat) -> list[Column]:
    """The columns a reply fills, one per field.

    A reply that is not exactly one JSON object gives the whole default record. A missing key
    gives the default of that key; a key that is present but null, or not a list where a list is
    due, gives null.
    """
    layout = ", ".join(f"{f.key}: {f.type}" for f in fmt.fields)

    def record_of(body: Column) -> Column:
        # The end mark is a second element: anything after the object breaks the pair.
        pair = F.from_json(
            F.concat(F.lit("["), body, F.lit(',{"_end": 1}]')), f"array<struct<{layout}, _end: int>>", STRICT_JSON
        )
        return once(pair, lambda parsed: _filled(parsed, body, fmt))

    record = once(unfence(reply, fmt.strip_inside_fence), record_of)
    return [record[f.column].alias(f.column) for f in fmt.fields]


def _filled(pair: Column, body: Column, fmt: ReplyFormat) -> Column:
    record = F.get(pair, F.lit(0))
    one_object = (F.size(pair) == 2) & record.isNotNull() & (F.get(pair, F.lit(1))["_end"] == 1)
    # The reader leaves a null where it skipped damage, so replies with a null are looked at again.
    complete = F.lit(True)
    for f in fmt.fields:
        complete = complete & record[f.key].isNotNull()
        if f.type == LIST:
            complete = complete & surely_without_null(record[f.key])
    readable = one_object & (complete | well_formed(body))

    def value(f: Field) -> Column:
        present = F.array_contains(F.json_object_keys(body), f.key)
        return F.coalesce(record[f.key], F.when(~present, _literal(f.if_missing, f.type)))

    as_given = F.struct(*[value(f).alias(f.column) for f in fmt.fields])
    default = F.struct(*[_literal(f.if_unreadable, f.type).alias(f.column) for f in fmt.fields])
    return F.when(readable, as_given).otherwise(default)
