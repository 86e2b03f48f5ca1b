"""List cells: JSON text at the edges, ``array<string>`` inside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once per row, however often ``use`` reads it.

    Spark shares repeated expressions in a projection, but not in a filter or a conditional branch,
    where a repeated parse would run again.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def well_formed(text: Column) -> Column:
    """Whether the text is JSON throughout.

    The JSON reader skips over damage inside a value and goes on, unless it has a column to report
    the damage in.
    """
    checked = F.from_json(
        F.concat(F.lit('{"_value":'), text, F.lit(',"_end":1}')),
        "_value string, _end int, _damage string",
        {**STRICT_JSON, "columnNameOfCorruptRecord": "_damage"},
    )
    return checked["_damage"].isNull() & (checked["_end"] == 1)


def surely_without_null(items: Column) -> Column:
    """True for a list without null and empty elements; other lists need a second look.

    ``array_contains`` is null where a list has a null and not the value looked for.
    """
    return ~F.array_contains(items, "")


def parse_list(text: Column) -> Column:
    """JSON text to ``array<string>``; null where the text is not exactly one JSON list.

    ``from_json`` ignores whatever follows the first value. Parsing the cell as the first of
    two elements makes trailing text an error. A null element may stand for damage, so lists with
    one are looked at again.
    """
    pair = F.from_json(F.concat(F.lit("["), text, F.lit(',["_end"]]')), "array<array<string>>", STRICT_JSON)

    def first(parsed: Column) -> Column:
        items = F.get(parsed, F.lit(0))
        whole = (F.size(parsed) == 2) & (F.get(parsed, F.lit(1)) == F.array(F.lit("_end")))
        return F.when(whole & (surely_without_null(items) | well_formed(text)), items)

    return once(pair, first)


def list_column(df: DataFrame, name: str, given: Column | None = None) -> Column:
    """The column as ``array<string>``, whether it is held as a list or as JSON text.

    ``given`` makes it null where a condition fails.
    """
    cell = F.col(name) if given is None else F.when(given, F.col(name))
    return cell if isinstance(df.schema[name].dataType, T.ArrayType) else parse_list(cell)


def list_text(items: Column) -> Column:
    return F.to_json(items)


def sorted_combination(items: Column) -> Column:
    """Sorted list of two or more labels, duplicates kept; null for shorter lists and lists with a null."""
    # array_sort would call a comparator for every pair of labels; sort_array is compiled and puts nulls first.
    ordered = F.sort_array(items)
    return F.when((F.size(items) > 1) & F.get(ordered, F.lit(0)).isNotNull(), ordered)
