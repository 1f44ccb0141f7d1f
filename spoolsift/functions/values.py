"""Reading loosely typed JSON values held as VARIANT."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# JSON spellings that count as false.
_FALSY = ("null", "false", "0", "-0", "0.0", "-0.0", '""', "[]", "{}")


def get(value: Column, path: str, kind: str = "variant") -> Column:
    """Value at a JSON path, NULL where it is absent or of another kind."""
    return F.try_variant_get(value, path, kind)


def text_at(value: Column, path: str) -> Column:
    """Text at a path; absent and JSON null both give the empty text."""
    return F.coalesce(get(value, path, "string"), F.lit(""))


def has(value: Column, path: str) -> Column:
    """Is the key present, JSON null included?"""
    return get(value, path).isNotNull()


def list_at(value: Column, path: str) -> Column:
    """Array at a path, NULL where the value is not an array."""
    return get(value, path, "array<variant>")


def is_object(value: Column) -> Column:
    """Is the value a JSON object?"""
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))


def is_string(value: Column) -> Column:
    """Is the value a JSON string?"""
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def truthy(value: Column) -> Column:
    """Does the value count as true: not null, false, zero or empty?"""
    return F.coalesce(~F.to_json(value).isin(*_FALSY), F.lit(False))


def word(value: Column) -> Column:
    """A value as a word in running text: None, True and False for null and booleans."""
    text = F.try_variant_get(value, "$", "string")
    return (
        F.when(value.isNull(), F.lit(None))
        .when(F.is_variant_null(value), F.lit("None"))
        .when(F.schema_of_variant(value) == "BOOLEAN", F.initcap(text))
        .otherwise(text)
    )


def first_truthy(*values: Column) -> Column:
    """Word form of the first value that counts as true, else the empty text."""
    chain = F.when(truthy(values[0]), word(values[0]))
    for value in values[1:]:
        chain = chain.when(truthy(value), word(value))
    return chain.otherwise("")


def joined_text(parts: Column) -> Column:
    """The ``text`` of the object parts of a list, one per line."""
    objects = F.filter(F.transform(parts, lambda p: get(p, "$", "struct<text:string>")), lambda p: p.isNotNull())
    return F.array_join(F.transform(objects, lambda p: F.coalesce(p["text"], F.lit(""))), "\n")


def string_or_parts(value: Column) -> Column:
    """Text of a value that is a string or a list of parts; anything else is empty."""
    parts = list_at(value, "$")
    return (
        F.when(parts.isNotNull(), joined_text(parts))
        .when(is_string(value), F.try_variant_get(value, "$", "string"))
        .otherwise("")
    )


def spaced(json_text: Column) -> Column:
    """Compact JSON with a blank after every comma and colon outside strings."""
    # \G: each match starts where the last one ended, never inside a string.
    token = r'\G((?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^",:])*+)([,:])'
    return F.regexp_replace(json_text, token, "$1$2 ")
