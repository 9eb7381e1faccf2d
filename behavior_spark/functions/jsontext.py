"""Reading loosely typed JSON messages.

Objects are parsed with an all-string schema: one field of the wrong type then costs
only itself, never the whole row. Numbers are cast afterwards, field by field.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from behavior_spark.functions.numbers import finite

CORRUPT = "_corrupt_record"
# Reject what is not JSON: single quotes, bare NaN, unquoted control characters.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def json_fields(names: Iterable[str], **nested: Iterable[str]) -> str:
    """Schema text: string fields, and per keyword an inner object of string fields."""
    fields = [f"`{name}` STRING" for name in names]
    fields += [
        f"`{name}` STRUCT<{', '.join(f'`{inner}`: STRING' for inner in inner_names)}>"
        for name, inner_names in nested.items()
    ]
    return ", ".join(fields)


def json_object(col: Column, fields: Iterable[str], corrupt: bool = False, **nested: Iterable[str]) -> Column:
    """Parse one object into a struct of strings; nested values keep their JSON text.

    A keyword such as ``properties=(...)`` opens an inner object in the same pass; it is
    NULL when the value is no object. With ``corrupt`` the struct has a field that holds
    the text if it is no JSON object, or if an inner object was none.
    """
    names = list(fields)
    options = dict(STRICT)
    if corrupt:
        names.append(CORRUPT)
        options["columnNameOfCorruptRecord"] = CORRUPT
    return F.from_json(col, json_fields(names, **nested), options)


def json_objects(col: Column, fields: Iterable[str]) -> Column:
    """Parse a list of objects into structs of strings; an element that is no object has no
    fields, and anything but a list is NULL.
    """
    names = list(fields)
    inner = ", ".join(f"`{name}`: STRING" for name in names)
    # One pass as a rule. Spark gives NULL for a mixed list, which is then read by element.
    whole = F.from_json(col, f"ARRAY<STRUCT<{inner}>>", STRICT)
    single = F.transform(json_array(col), lambda element: json_object(element, names))
    return F.when(F.startswith(col, F.lit("[")), F.coalesce(whole, single))


def parsed_once(df: DataFrame, name: str, parsed: Column) -> DataFrame:
    """Add a parsed column that is computed a single time per row.

    As a plain column Spark would copy the parsing into every filter that looks at the
    result. It does not push filters on a generator's output below the generator.
    """
    return df.select("*", F.explode(F.array(parsed)).alias(name))


def json_array(col: Column) -> Column:
    """Parse a list; every element keeps its JSON text. NULL if it is no list."""
    return F.from_json(col, "ARRAY<STRING>", STRICT)


def text_of(col: Column) -> Column:
    """Missing text reads as the empty string."""
    return F.coalesce(col, F.lit(""))


def double_of(col: Column) -> Column:
    # Java would read a type letter at the end of a number.
    plain = F.when(~F.right(F.trim(col), F.lit(1)).isin("d", "D", "f", "F"), col)
    return finite(plain.try_cast("double"))


def decimal_of(col: Column) -> Column:
    """Money from the JSON text itself, so that no binary fraction creeps in."""
    return col.try_cast("decimal(18,2)")


def uint_of(col: Column, bits: int) -> Column:
    """Unsigned whole number of 16 or 32 bits; out of range or a fraction gives NULL."""
    number = col.try_cast("bigint")
    kept = F.when(number.between(0, 2**bits - 1), number)
    return kept.cast("int") if bits <= 16 else kept
