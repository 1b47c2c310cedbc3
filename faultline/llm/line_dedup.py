"""Line dedup: repeated multi-line chunks with content-defined bounds.

A text is split at newlines. The rolling hash of a line is a polynomial in the
hashes of the last ``WINDOW`` lines; a chunk ends at a line whose rolling hash
is below those of both neighbours. Bounds depend on nearby lines alone, so an
inserted line moves none but those next to it, and no two lines in a row end a
chunk, so all but a text's last chunk have two lines or more. A chunk of two
or more lines whose bytes occur anywhere before (smaller id, then the text's
hash, then line) is removed.

Hashes are counted first, so texts of chunks are shuffled only where a hash
repeats; grouping by the bytes then is the comparison. Counting combines
before the shuffle, and the join back is split by AQE where a chunk is hot.

Defined cases: null text stays null; an empty text has one empty line and
stays. Rows equal in id and text are one document. Rows without an id come
last. Identical lines in a row never end a chunk between them. Texts of one
line are never changed. Extra columns stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import content_key, once, private
from faultline.session import cut

WINDOW = 2
PRIME = 2147483647
BASE = 48271


def _rolling(hashes: Column) -> Column:
    def at(i, back):
        return F.coalesce(F.get(hashes, i - back), F.lit(0)) * (BASE**back % PRIME)

    return F.transform(hashes, lambda _, i: reduce(lambda a, b: a + b, [at(i, k) for k in range(WINDOW)]) % PRIME)


def with_chunks(docs: DataFrame, text: str, lines="_lines", chunks="_chunks") -> DataFrame:
    """Add the lines of the text and its chunks, structs of first and last line."""
    d = once(docs, lines, F.split(F.col(text), "\n"))
    d = once(d, "_h", F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long")))
    d = once(d, "_r", _rolling(F.col("_h")))
    r, n = F.col("_r"), F.size("_r")
    ends = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: (i == n - 1) | ((i > 0) & (F.get(r, i) < F.get(r, i - 1)) & (F.get(r, i) < F.get(r, i + 1))),
    )
    d = once(d, "_ends", F.when(F.col(lines).isNotNull(), ends))
    spans = F.transform("_ends", lambda e, k: F.struct(F.when(k == 0, 0).otherwise(F.get(F.col("_ends"), k - 1) + 1).alias("first"), e.alias("last")))
    return d.withColumn(chunks, spans).drop("_h", "_r", "_ends")


def line_dedup(docs: DataFrame, id_col="doc_id", text_col="text", counts=("n_lines", "n_removed")) -> DataFrame:
    """The documents with repeated chunks taken out of the text, and ``counts``: lines, lines removed.

    Columns of the documents that are named like the counts give way to them.
    """
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), content_key(id_col, text_col).alias("_key"))
    rows = with_chunks(d, "_text").select("_id", "_key", "_lines", F.explode("_chunks").alias("_c")).where("_c.last > _c.first")
    body = F.array_join(F.slice("_lines", F.col("_c.first") + 1, F.col("_c.last") - F.col("_c.first") + 1), "\n")
    rows = rows.select("_id", "_key", "_c", body.alias("_body")).withColumn("_hash", F.xxhash64("_body"))
    # rows equal in id and text are one document, hence one occurrence
    often = rows.groupBy("_hash").agg(F.count("*").alias("_n")).where("_n > 1").select("_hash")
    some = cut(rows.join(often, "_hash", "left_semi"))
    place = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_key").alias("k"), F.col("_c.first").alias("l"))
    first = some.groupBy("_hash", "_body").agg(F.min(place).alias("_first"))
    again = some.join(first, ["_hash", "_body"]).where(place > F.col("_first"))
    p = private(docs)
    gone = again.groupBy("_id", "_key").agg(F.collect_set("_c").alias(f"{p}gone")).withColumnsRenamed({"_id": f"{p}gid", "_key": f"{p}gkey"})
    d = docs.withColumn(f"{p}key", content_key(id_col, text_col))
    d = d.join(gone, F.col(id_col).eqNullSafe(F.col(f"{p}gid")) & (F.col(f"{p}key") == F.col(f"{p}gkey")), "left")
    d, lines = once(d, f"{p}lines", F.split(F.col(text_col), "\n")), F.col(f"{p}lines")
    gone = F.col(f"{p}gone")
    kept = F.filter(lines, lambda _, i: ~F.exists(gone, lambda g: (i >= g["first"]) & (i <= g["last"])))
    removed = F.aggregate(gone, F.lit(0), lambda s, g: s + g["last"] - g["first"] + 1)
    n_lines, n_removed = counts
    out = d.withColumns(
        {
            n_lines: F.coalesce(F.size(lines), F.lit(0)).cast("long"),
            n_removed: F.coalesce(removed, F.lit(0)).cast("long"),
            text_col: F.when(gone.isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")),
        }
    )
    return out.select(*[c for c in docs.columns if c not in counts], n_lines, n_removed)
