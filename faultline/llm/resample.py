"""Importance resampling of documents towards the distribution of a target corpus.

Features of a text are its words and pairs of neighbouring words, hashed into
buckets. A bucket's gain is the logarithm of how much likelier the target is to
hold it than the documents, a document's weight the mean gain of its features,
and the documents of highest weight plus Gumbel noise are drawn, which samples
without replacement in proportion to the weights' exponentials.

In a task, the n-grams of a stretch of texts are interned in an open-addressed
table of numpy arrays: the xxhash64 of an n-gram names its slot, the bytes are
compared with those of the slot's first n-gram, and whatever differs goes on to
the next slot. A slot stores bucket and count, so each distinct n-gram is hashed
into its bucket once; gains reach documents by the slot numbers of their
occurrences. Texts are read twice and never shuffled: once to count buckets,
once to gather gains.

Only ``buckets`` counts for each corpus reach the driver. Ranks come from the counts of
scores, of which there are some 100,000 at most (a gain lies within 44,000 of
0, the noise between -3,200 and 23,000), and from ranks within a score; noise
depends on the id alone, so no score holds more than 0.04% of distinct ids.
Rows that are equal throughout are counted, not sorted.

Defined cases: a null text has no features, weight 0. A null id is noise of the
empty text and comes last among ties. Rows equal in id and score share the
ranks that follow each other in any order. A text longer than ``STRETCH`` is
taken in several stretches, each starting with the last word of the one before.
With an empty target every bucket has the target's prior count. Extra columns
do not pass.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import cut

BUCKETS = 10_000
STRETCH = 1 << 19
SCORE_STEP = 1024

_UPPER = bytes(range(0x41, 0x5B))
# ASCII but for digits and lower-case letters parts words, once upper case is lowered
_PARTS = bytes(b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b in _UPPER))
_FOLD = bytes.maketrans(_UPPER + _PARTS, _UPPER.lower() + b" " * len(_PARTS))
_BLANK = 0x20


# The five primes of xxHash64.
_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in _PRIMES)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """xxhash64 of many slices: those of one length at once; from 32 bytes on one by one."""
    import xxhash

    padded = data + bytes(8)
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    fours = np.ndarray((len(data) + 1,), dtype="<u4", buffer=padded, strides=(1,))
    ones = np.frombuffer(padded, dtype=np.uint8)
    short = np.minimum(end - start, 32).astype(np.uint8)
    order = np.argsort(short, kind="stable")
    ends = np.cumsum(np.bincount(short, minlength=33))
    out = np.empty(len(start), dtype=np.uint64)
    for length in range(32):
        which = order[ends[length - 1] if length else 0 : ends[length]]
        if not len(which):
            continue
        at, left = start[which], length
        h = np.full(len(at), np.uint64(length) + _P5)
        while left >= 8:
            h = _turned(h ^ (_turned(eights[at] * _P2, 31) * _P1), 27) * _P1 + _P4
            at, left = at + 8, left - 8
        if left >= 4:
            h = _turned(h ^ (fours[at].astype(np.uint64) * _P1), 23) * _P2 + _P3
            at, left = at + 4, left - 4
        for k in range(left):
            h = _turned(h ^ (ones[at + k].astype(np.uint64) * _P5), 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        out[which] = h ^ (h >> np.uint64(32))
    long = order[ends[31] :]
    out[long] = [xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist())]
    return out


class Interned:
    """Distinct n-grams of a buffer in an open-addressed table.

    ``slot`` is the table's slot of each occurrence, ``used`` the occupied slots,
    ``bucket`` and ``count`` their contents.
    """

    def __init__(self, data: bytes, start: np.ndarray, end: np.ndarray, buckets: int, hashed=None):
        keys = (hashed or hashes)(data, start, end)
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        raw = np.frombuffer(data, dtype=np.uint8)
        first = np.full(size, -1, dtype=np.int64)  # the occurrence that took the slot
        self.slot = np.zeros(len(keys), dtype=np.int64)
        left = np.arange(len(keys))
        at = (keys & np.uint64(size - 1)).astype(np.int64)
        while len(left):
            free = first[at] < 0
            first[at[free]] = left[free]  # of several that want a free slot one gets it
            owner = first[at]
            same = keys[owner] == keys[left]
            same[same] = _equal(raw, start, end, owner[same], left[same])
            self.slot[left[same]] = at[same]
            left, at = left[~same], (at[~same] + 1) & (size - 1)
        self.used = np.flatnonzero(first >= 0)
        self.bucket = np.zeros(size, dtype=np.int64)
        begun = first[self.used]
        self.bucket[self.used] = [zlib.crc32(data[a:b]) % buckets for a, b in zip(start[begun].tolist(), end[begun].tolist())]
        self.count = np.bincount(self.slot, minlength=size)


def _equal(raw: np.ndarray, start: np.ndarray, end: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the n-grams x and y hold the same bytes."""
    length = end[x] - start[x]
    same = (x == y) | (length == end[y] - start[y])
    ask = np.flatnonzero(same & (x != y))
    n = length[ask]
    before = np.cumsum(n) - n
    inside = np.arange(int(n.sum())) - np.repeat(before, n)
    differs = raw[np.repeat(start[x[ask]], n) + inside] != raw[np.repeat(start[y[ask]], n) + inside]
    if len(ask):
        same[ask] = np.add.reduceat(differs, before, dtype=np.int64) == 0
    return same


def _stretches(column: pa.Array) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, bool]]:
    """(folded bytes, first byte and row of each text, whether the first word was counted before)."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + STRETCH, "right")) - 1)
        data = bytes(body[offsets[row] : offsets[last]]).translate(_FOLD) if body is not None else b""
        if last > row + 1 or len(data) <= STRETCH:
            yield data, offsets[row:last] - offsets[row], np.arange(row, last), False
        else:
            begin, at, carried = 0, 0, False
            while at < len(data):
                at = data.find(b" ", at + STRETCH)
                at = len(data) if at < 0 else at
                yield data[begin:at], np.zeros(1, dtype=np.int64), np.array([row]), carried
                held = data[begin:at].rstrip(b" ")
                carried = bool(held)
                begin = begin + held.rfind(b" ") + 1 if carried else at
        row = last


def _ngrams(data: bytes, begins: np.ndarray):
    """Words parted by one blank each, and start, end and text of every n-gram."""
    raw = np.frombuffer(data, dtype=np.uint8)
    letter = raw != _BLANK
    before = np.zeros(len(raw), dtype=bool)
    before[1:] = letter[:-1]
    before[begins[begins < len(raw)]] = False
    starts = np.flatnonzero(letter & ~before)
    text = np.searchsorted(begins, starts, "right") - 1
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    place = np.cumsum(keep) - 1
    after = np.ones(len(raw), dtype=bool)
    after[:-1] = ~letter[1:]
    inner = begins[(begins > 0) & (begins <= len(raw))]
    after[inner - 1] = True
    ends = np.flatnonzero(letter & after)
    packed = raw[keep].tobytes()
    start, end = place[starts], place[ends] + 1
    pair = np.flatnonzero(text[1:] == text[:-1])
    return packed, np.concatenate([start, start[pair]]), np.concatenate([end, end[pair + 1]]), np.concatenate([text, text[pair]]), len(start)


def _occurrences(column: pa.Array, buckets: int):
    """For each stretch: the table, slot and row of every n-gram that counts, the rows of the words."""
    for data, begins, rows, carried in _stretches(column):
        packed, start, end, text, n_words = _ngrams(data, begins)
        skip = int(carried and n_words > 0)  # the first word belongs to the stretch before
        table = Interned(packed, start[skip:], end[skip:], buckets)
        yield table, rows[text[skip:]], rows[text[skip:n_words]]


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of features by bucket, over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for table, _, _ in _occurrences(batch.column(0), buckets):
                np.add.at(total, table.bucket[table.used], table.count[table.used])
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    some = texts.select(F.col(text_col).alias("text")).where("text is not null")
    rows = some.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket in thousandths, floored; every bucket has one occurrence more than counted."""
    size, own = len(source), int(source.sum()) + len(source)
    aim = int(target.sum()) + size
    return np.array([math.floor(1000 * math.log(float(t + 1) * own / (float(s + 1) * aim))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean gain of each text's features."""
    kept = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = kept.value
        for batch in batches:
            words, features, total = (np.zeros(len(batch), dtype=np.int64) for _ in range(3))
            for table, rows, word_rows in _occurrences(batch.column(1), len(gain)):
                each = gain[table.bucket[table.slot]]
                total += np.bincount(rows, weights=each, minlength=len(batch)).astype(np.int64)
                features += np.bincount(rows, minlength=len(batch))
                words += np.bincount(word_rows, minlength=len(batch))
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features, weight))], names=["id", "n_words", "n_features", "weight"])

    some = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return some.mapInArrow(score, f"id {kind}, n_words long, n_features long, weight long")


def noise(id_col: str, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, from 32 bits of the SHA-256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS,
) -> DataFrame:
    """Every document's id, n_features, weight, score, and rank where it is drawn.

    Of the documents with at least ``min_words`` words ``percent`` per cent are drawn, by score.
    """
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text_col, buckets))
    d = weigh(docs, gain, id_col, text_col).withColumn("fit", F.col("n_words") >= min_words)
    d = d.withColumn("score", F.col("weight") + noise("id", seed))
    # equal rows are one with their number
    d = cut(d.groupBy("id", "n_features", "weight", "score", "fit").agg(F.count("*").alias("rows")))
    scores = d.where("fit").groupBy("score").agg(F.sum("rows").alias("n"))
    scores = cut(scores.withColumn("step", F.floor(F.col("score") / SCORE_STEP)))
    steps = scores.groupBy("step").agg(F.sum("n").alias("n"))
    above = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select("step", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("over"))  # about a hundred rows
    higher = Window.partitionBy("step").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    first = scores.join(F.broadcast(steps), "step").select("score", (F.col("over") + F.coalesce(F.sum("n").over(higher), F.lit(0))).alias("over"))
    drawn = (scores.agg(F.sum("n")).first()[0] or 0) * percent // 100
    d = d.join(F.broadcast(first), "score", "left")  # some 100,000 scores at most
    ties = Window.partitionBy("score", "fit").orderBy(F.col("id").asc_nulls_last(), "n_features").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("over", F.col("over") + F.coalesce(F.sum("rows").over(ties), F.lit(0)))
    d = d.withColumn("place", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).withColumn("place", F.col("over") + F.col("place"))
    rank = F.when(F.col("fit") & (F.col("place") <= drawn), F.col("place")).cast("long")
    return d.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))
