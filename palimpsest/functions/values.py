"""JSON of messages as VARIANT values: a text is parsed once a row, and every branch looks into the value.

``parsed`` makes the value a column; the optimizer does not copy it into the expressions that use it.
A text that is no JSON, one over 16 MB and one with a key twice in an object have no value (null).
Objects that are written out again have their keys sorted and no blanks between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: What counts as blank around a text.
BLANKS = " \t\n\r\x0b\x0c"


def _closed(text: Column) -> Column:
    """An array of the text's value and the text's length: Spark's parser stops where a value ends, this shows that it was the whole text."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), F.length(text), F.lit("]")))


def _is_whole(closed: Column, text: Column) -> Column:
    return F.coalesce((F.try_variant_get(closed, "$[1]", "long") == F.length(text)) & F.try_variant_get(closed, "$[2]", "variant").isNull(), F.lit(False))


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else."""
    return _is_whole(_closed(text), text)


def parsed(rows: DataFrame, text: Column | str, to: str = "json") -> DataFrame:
    """``rows`` with the VARIANT ``to`` of a JSON text."""
    text = F.col(text) if isinstance(text, str) else text
    closed = rows.withColumns({"__text": text, "__closed": _closed(text)})
    return closed.withColumn(to, F.when(_is_whole(F.col("__closed"), F.col("__text")), F.try_variant_get("__closed", "$[0]", "variant"))).drop("__text", "__closed")


def kind(value: Column) -> Column:
    """The outermost type: OBJECT, ARRAY, STRING, BOOLEAN, VOID for JSON's null, else that of a number."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def text_at(value: Column, *paths: str) -> Column:
    """The first path of a value that holds a text that is not empty; numbers and objects count as they are written."""
    return F.coalesce(*[F.nullif(F.try_variant_get(value, p, "string"), F.lit("")) for p in paths])


def number_at(value: Column, *paths: str) -> Column:
    """The first path of a value that holds a whole number other than zero."""
    return F.coalesce(*[F.nullif(F.try_variant_get(value, p, "long"), F.lit(0)) for p in paths])


def items_at(value: Column, path: str = "$") -> Column:
    """The items of an array as values of their own; null if there is no array."""
    return F.try_variant_get(value, path, "array<variant>")


def _block_text(block: Column) -> Column:
    k = kind(block)
    return F.when(k == "STRING", F.try_variant_get(block, "$", "string")).when(k == "OBJECT", text_at(block, "$.text"))


def block_texts(value: Column, path: str = "$") -> Column:
    """The texts of an array of texts and blocks (objects with a text), empty ones and other items left out."""
    return F.filter(F.transform(items_at(value, path), _block_text), lambda t: t.isNotNull() & (t != ""))


def content_text(value: Column) -> Column:
    """A message's content as text: of a text itself without blanks around it, of an array its ``block_texts``, one to a line,
    of an object, a number or true their JSON; of nothing, null, 0 and false an empty text.
    """
    k, written = kind(value), F.try_variant_get(value, "$", "string")
    return (
        F.when(value.isNull() | (k == "VOID"), "")
        .when(k == "STRING", F.btrim(written, F.lit(BLANKS)))
        .when(k == "ARRAY", F.array_join(block_texts(value), "\n"))
        .when(k == "OBJECT", F.to_json(value))
        .otherwise(F.when(written.isin("false", "0"), "").otherwise(written))
    )


def with_content(rows: DataFrame, column: str, to: str | None = None) -> DataFrame:
    """``rows`` with a text column of contents made plain: JSON arrays as by ``content_text``; anything else is a text and stays, trimmed.

    A text that only looks like an array, ``[1] as said``, is a text.  Null stays null.
    """
    found = parsed(rows, column, "__json")
    plain = F.when(kind(F.col("__json")) == "ARRAY", content_text(F.col("__json"))).otherwise(F.btrim(F.col(column), F.lit(BLANKS)))
    return found.withColumn(to or column, plain).drop("__json")


def shapes(rows: DataFrame, value: Column, *by: str) -> DataFrame:
    """``by``, schema, n: one schema that fits every value of a group, and how many values there are.

    Schemas merge in partial aggregates, so a group of any size costs a row for each task.
    """
    return rows.where(value.isNotNull()).groupBy(*by).agg(F.schema_of_variant_agg(value).alias("schema"), F.count("*").alias("n"))
