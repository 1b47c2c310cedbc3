"""Language ID by compression with per-language dictionaries.

A language is a raw-content zstandard dictionary: parts of a bounded sample of
labelled documents, ``PER_LANGUAGE`` of them with at most ``PART_CHARS``
characters each, from a hashed place of the text; they share ``DICT_BYTES``
evenly. A text, its letters and their marks in lower case with single spaces, is
encoded in blocks of ``BLOCK`` bytes with every dictionary; the language of the
fewest bytes is predicted. In a text below ``SHORT`` bytes a byte decides, so it
is encoded behind each of ``CARRIERS`` parts of the dictionary, whose own size
is taken off; the part lends the text its symbol statistics. Where the runner-up needs less than
``MIN_MARGIN`` more bytes, as a part of the least, the text is rejected.

Defined cases: a null text or one without letters is ``und`` with score 0 and
rejected. Ties go to the language first in code-point order. With no labelled
text every document is ``und``. Labels that are null are not learned from.
Extra columns stay, and the input is not reordered.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import private

UNKNOWN = "und"
PER_LANGUAGE = 64
PART_CHARS = 2048
DICT_BYTES = 112 << 10
BLOCK = 8 << 10
SHORT = 320
CARRIERS = 8
CARRIER_BYTES = 3 << 10
LEVEL = 6
MIN_MARGIN = 0.001
SCALE = 4.0  # bytes of difference that make a language e times less likely, at least
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def learn(labelled: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", per_language: int = PER_LANGUAGE) -> dict[str, bytes]:
    """Dictionary content per language, from the sample with the least hash in each hash class.

    The driver gets ``per_language`` parts of ``PART_CHARS`` characters for each
    of the languages, of which there are some hundreds in the world.
    """
    d = labelled.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    h = F.xxhash64(F.col(id_col))
    # another hash than the one that chooses documents
    begin = F.pmod(F.xxhash64(F.col(id_col), F.lit("part")), F.greatest(F.length(text_col) - PART_CHARS + 1, F.lit(1)))
    part = F.substring(F.col(text_col), (begin + 1).cast("int"), F.lit(PART_CHARS))
    d = d.select(F.col(lang_col).alias("lang"), F.pmod(h, F.lit(per_language)).alias("k"), h.alias("h"), part.alias("part"))
    chosen = d.groupBy("lang", "k").agg(F.min("h").alias("h"))
    parts = d.join(chosen, ["lang", "k", "h"]).groupBy("lang", "k").agg(F.min("part").alias("part"))
    found: dict[str, list[bytes]] = {}
    for row in parts.orderBy("lang", "k").collect():
        found.setdefault(row["lang"], []).append(_fold(row["part"]))
    return {lang: b"\n".join(p[: DICT_BYTES // len(parts) - 1] for p in parts) for lang, parts in sorted(found.items())}


def _fold(text: str) -> bytes:
    return (_OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-8", "surrogatepass")


class _Language:
    def __init__(self, content: bytes):
        import zstandard as z

        d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        self.encoder = z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        step = max(1, len(content) // CARRIERS)
        self.carriers = [content[k * step : k * step + CARRIER_BYTES] for k in range(CARRIERS)]
        # carriers are encoded without the dictionary, in which they stand
        self.plain = z.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        self.own = sum(len(self.plain.compress(c)) for c in self.carriers)

    def size(self, data: bytes) -> float:
        if len(data) < SHORT:
            return (sum(len(self.plain.compress(c + data)) for c in self.carriers) - self.own) / CARRIERS
        return sum(len(self.encoder.compress(data[k : k + BLOCK])) for k in range(0, len(data), BLOCK))


def classifier(model: dict[str, bytes], min_margin: float = MIN_MARGIN):
    """A vectorized function of a text column: lang, score (0 to 1), margin, rejected."""
    kept: dict[str, list] = {}

    def one(text):
        if text is None or not model or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0, True
        data = _fold(text)
        sizes = [language.size(data) for language in kept.values()]
        least = min(sizes)
        best = sizes.index(least)
        second = min(sizes[:best] + sizes[best + 1 :], default=2 * least + 1)
        margin = (second - least) / max(least, 1.0)
        scale = max(SCALE, 0.005 * least)
        score = 1.0 / sum(2.718281828459045 ** ((least - s) / scale) for s in sizes)
        return list(kept)[best], score, margin, margin < min_margin

    @F.pandas_udf("lang string, score double, margin double, rejected boolean")
    def classify(texts: pd.Series) -> pd.DataFrame:
        if not kept:
            kept.update({lang: _Language(content) for lang, content in model.items()})
        return pd.DataFrame([one(t) for t in texts], columns=["lang", "score", "margin", "rejected"])

    return classify


def learn_fold(docs: DataFrame, id_col="doc_id") -> DataFrame:
    """The documents to learn from: CRC-32 of the id as text is not 0 modulo 5."""
    return docs.where(~held_out(id_col))


def held_out(id_col="doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def predict(docs: DataFrame, model: dict[str, bytes], text_col="text", out="_lang") -> DataFrame:
    """Add a struct column of the prediction."""
    return docs.withColumn(out, classifier(model)(F.col(text_col)))


def keep_identified(docs: DataFrame, model: dict[str, bytes]) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    verdict = f"{private(docs)}verdict"
    return predict(docs, model, out=verdict).where(f"not {verdict}.rejected").select(*docs.columns)
