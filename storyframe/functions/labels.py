"""Values of labelled regions.

A value is JSON with `labels`, `choices` or `text` lists or a `number`, and optionally `start` and `end`.
A flattened value is a struct of its text and whether it came from `number`; numbers keep their JSON spelling.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyframe.functions.text import after_slash, json_text, or_default

FLAT = "struct<value:string,is_number:boolean>"
VALUE = "struct<start:string,end:string,labels:array<string>,choices:array<string>,text:array<string>,number:string>"


def parsed_value(value_json: Column) -> Column:
    return F.from_json(value_json, VALUE)


def flat_value(value_json: Column, parsed: Column) -> Column:
    """The first choice, else the first text, else the number; bilingual texts lose all through the first `/`."""
    choice = _first(value_json, parsed, "choices")
    text = F.coalesce(choice, _first(value_json, parsed, "text"))
    listed = parsed["choices"].isNotNull() | parsed["text"].isNotNull() | text.isNotNull()
    return (
        F.when(listed, F.struct(after_slash(text).alias("value"), F.lit(False).alias("is_number")))
        .when(parsed["number"].isNotNull(),
              F.struct(parsed["number"].alias("value"), F.lit(True).alias("is_number")))
    )


def region_label(labels: Column) -> Column:
    """Upper-cased region type of a label list; null if there is none."""
    first = F.nullif(F.get(labels, F.lit(0)), F.lit(""))
    return F.upper(after_slash(first))


def described(flat: Column) -> Column:
    """Text of a flattened value, `N/A` where it is missing, empty or the number zero."""
    zero = flat["is_number"] & (flat["value"].try_cast("double") == 0)
    return F.when(zero, F.lit("N/A")).otherwise(or_default(flat["value"]))


def flat_json(flat: Column) -> Column:
    """JSON literal of a flattened value."""
    return F.when(flat["is_number"], flat["value"]).otherwise(json_text(flat["value"]))


def flat_number(flat: Column) -> Column:
    return flat["value"].try_cast("double")


def _first(value_json: Column, parsed: Column, key: str) -> Column:
    # A bare string in place of the list counts by its first character.
    unlisted = parsed[key].isNull() & F.contains(value_json, F.lit(f'"{key}"'))
    bare = F.when(unlisted, F.substring(F.get_json_object(value_json, f"$.{key}"), 1, 1))
    return F.coalesce(F.get(parsed[key], F.lit(0)), bare)
