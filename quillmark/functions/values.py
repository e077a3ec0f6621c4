"""JSON values with their types: what a text holds, and whether it is strict JSON, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions import texts

#: Places of parameters: quoted strings, and a bracketed part without brackets inside.
STRING = r'"(?:[^"\\]|\\.)*+"'
INNERMOST = r"[\[{][^\[\]{}]*+[\]}]"


def kind(value: Column) -> Column:
    """object, array, text, integer, number, boolean or null of a variant; SQL's null where there is none."""
    schema = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), None)
        .when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema == "STRING", "text")
        .when(schema == "BIGINT", "integer")
        .when(schema == "VOID", "null")
        .when(schema == "BOOLEAN", "boolean")
        .otherwise("number")
    )


def member(value: Column, name: str) -> Column:
    """A member of an object, as a variant."""
    return F.try_variant_get(value, f"$['{name}']", "variant")


def there(value: Column) -> Column:
    """Whether a variant is there and isn't JSON's null."""
    return F.coalesce(kind(value) != "null", F.lit(False))


def plain(value: Column, longest: int) -> Column:
    """A variant's text if it is one that texts.valid_text takes; null for all else."""
    text = F.when(kind(value) == "text", F.try_variant_get(value, "$", "string"))
    return F.when(texts.valid_text(text, longest), text)


def members(value: Column) -> Column:
    """An object as map<string,variant>; null for anything else."""
    return F.when(kind(value) == "object", F.try_variant_get(value, "$", "map<string,variant>"))


def elements(value: Column) -> Column:
    """An array as array<variant>; null for anything else."""
    return F.when(kind(value) == "array", F.try_variant_get(value, "$", "array<variant>"))


def problem(text: Column, most_depth: int = 64, most_nodes: int = 100_000) -> Column:
    """Why a text isn't strict JSON within bounds, or null: too_deep and too_large by its brackets, before it is parsed; then invalid, not_finite,
    duplicate_key. Numbers beyond a double aren't finite.

    Bracketed parts are taken out from the inside, as often as the depth may be; one value then leaves one word. A value stands behind each
    comma, at the head of each bracketed part that isn't empty, and at the top.
    """

    def judged(s: Column) -> Column:
        bare, rest = s["bare"], s["rest"]
        nodes = 1 + F.regexp_count(bare, F.lit(",")) + F.regexp_count(bare, F.lit(r"[\[{](?!\s*[\]}])"))
        beyond = lambda t: F.regexp_count(t, F.lit('"-?Infinity"'))
        return (
            F.when(rest.rlike(INNERMOST) | (F.regexp_count(rest, F.lit(r"[\[{]")) > most_depth), "too_deep")
            .when(nodes > most_nodes, "too_large")
            .when(bare.rlike(r"(?<![\w.+-])-?(?:NaN|Infinity)(?![\w.+-])"), "not_finite")
            .when(~rest.rlike(r"^[ \t\n\r]*[^\s\[\]{},:]+[ \t\n\r]*\z"), "invalid")
            .when(F.try_parse_json(text).isNotNull(), F.when(beyond(s["lenient"]) > beyond(text), "not_finite"))
            .when(s["lenient"].isNotNull() & ~bare.contains("'"), "duplicate_key")
            .otherwise("invalid")
        )

    bare = F.regexp_replace(text, STRING, "0")
    rest = F.aggregate(F.sequence(F.lit(1), F.lit(most_depth)), bare, lambda left, _: F.regexp_replace(left, INNERMOST, "0"))
    return F.when(text.isNull(), "invalid").otherwise(texts.bound(F.struct(bare.alias("bare"), rest.alias("rest"), F.get_json_object(text, "$").alias("lenient")), judged))


def sent(array: Column, body: Column, path: str) -> Column:
    """The elements of the array of JSON at a dotted path of body, each as JSON text with its numbers, duplicate keys and order as they were sent; array is the same
    as array<variant>. Only blanks, escapes and the spelling of a fraction are one of several that mean the same."""
    schema = "array<string>"
    for part in reversed(path.split(".")):
        schema = f"struct<`{part}`:{schema}>"
    raw = F.from_json(body, schema)
    for part in path.split("."):
        raw = raw[part]
    pairs = F.arrays_zip(array.alias("v"), raw.alias("r"))
    return F.transform(pairs, lambda p: F.when(kind(p["v"]) == "text", F.to_json(p["v"])).when(kind(p["v"]) == "null", "null").otherwise(p["r"]))
