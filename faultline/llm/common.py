"""Word pattern, word counts, and the identity of a document, shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.session import cut

# Words are runs of anything but ASCII white space (fixed by the contracts of the queries).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def word_count(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def content_key(doc_id: str, text: str) -> Column:
    """60 bits of the MD5 of id and text: with the id, the identity of a row."""
    both = F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), text_or_empty(text))
    return F.conv(F.substring(F.md5(both), 1, 15), 16, 10).cast("long")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later expressions read without computing it again.

    A plain projection would be merged into every use, inside lambdas too; rows
    of a one-element array are not.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def private(docs: DataFrame) -> str:
    """A beginning of names that no column of ``docs`` has, whatever its case."""
    begin = "__"
    while any(c.lower().startswith(begin) for c in docs.columns):
        begin += "_"
    return begin


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _tie, _text): null text as empty, null id as the largest number.

    ``_tie`` is 0, but where an id is null or stands on more rows; there it is
    the content key, so rows equal in id and text have one identity. The rows
    are distinct.
    """
    top = 2**63 - 1
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(top)).alias("_id"), text_or_empty(text_col).alias("_text"))
    many = d.groupBy("_id").agg(F.count("*").alias("_n")).where(f"_n > 1 or _id = {top}").select(F.col("_id").alias("_m"))
    zero = F.lit(0).cast("long").alias("_tie")
    if many.isEmpty():  # reads ids only; the texts then need no join
        return d.select("_id", zero, "_text")
    many = cut(many)
    again = d.join(many, F.col("_id") == F.col("_m")).select("_id", content_key("_id", "_text").alias("_tie"), "_text").distinct()
    return d.join(many, F.col("_id") == F.col("_m"), "left_anti").select("_id", zero, "_text").unionByName(again)


def plain_id(c: str = "_id") -> Column:
    return F.when(F.col(c) != 2**63 - 1, F.col(c))
