"""Substring dedup over words by difference-cover anchors.

{0, 1, 3, 9} modulo 13 is a difference cover: for any two places there is a
shift below 13 that brings both onto the cover. Anchors are the ANCHOR = 8 word
windows at cover places of a document, so any two equal windows of 20 = 8 + 13 - 1
words share an anchor at the same shift. An anchor's context is the 32 words of
the 13 windows that may hold it (less at a document's ends). ``repeats`` settles
equal contexts; windows of the rest are extended to 20 words and compared by
128-bit hashes. A window goes if its words start earlier anywhere.

Defined cases: null text has no words; rows equal in id and text are one
document; equal ids with other texts are ordered by content key; rows without
id come last. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import repeats
from faultline.llm.common import identified, plain_id
from faultline.llm.rolling import Words, text_slices
from faultline.session import cut

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
_ON_COVER = np.isin(np.arange(PERIOD), COVER)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, ties = batch.column("_id").to_numpy(), batch.column("_tie").to_numpy()
        for row, offsets, data in text_slices(batch.column("_text")):
            w = Words(offsets, data)
            n = w.count[w.doc]
            at = np.flatnonzero(_ON_COVER[w.place % PERIOD] & (w.place + ANCHOR <= n) & (n >= WINDOW))
            if not len(at):
                continue
            first, second = w.prefix(0), w.prefix(1)
            place, rest = w.place[at], n[at] - w.place[at] - ANCHOR
            left, right = np.minimum(place, PERIOD - 1), np.minimum(rest, PERIOD - 1)
            anchor = first.window(at, at + ANCHOR) >> np.uint64(16)  # brings contexts together; their equality rests on all 112 bits
            context = second.window(at - left, at + ANCHOR + right) + (left * PERIOD + right).astype(np.uint64)
            doc = w.doc[at] + row
            yield repeats.anchor_batch(anchor, context, ids[doc], ties[doc], place, np.zeros(len(at)), first_only=True)


def _windows_of(place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last window start of the contexts around anchors in a text of n words."""
    return np.maximum(place - (PERIOD - 1), 0), np.minimum(place, n - WINDOW)


def _open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the single windows of open anchors."""
    for batch in batches:
        ids, ties, opened = batch.column("_id").to_numpy(), batch.column("_tie").to_numpy(), batch.column("open")
        for row, offsets, data in text_slices(batch.column("_text")):
            w = Words(offsets, data)
            wanted = []
            for k in range(len(offsets) - 1):
                place, _ = repeats.spots(opened, row + k)
                n = int(w.count[k])
                a, b = _windows_of(place, n)
                wanted.append(np.flatnonzero(repeats.covered(n, a, b + 1)) + w.first[k] if len(place) else place)
            at = np.concatenate(wanted)
            if not len(at):
                continue
            first, second = w.prefix(0), w.prefix(1)
            doc = w.doc[at] + row
            yield repeats.anchor_batch(
                first.window(at, at + WINDOW), second.window(at, at + WINDOW), ids[doc], ties[doc], w.place[at], np.zeros(len(at)), first_only=True
            )


OUT = "_id long, _tie long, n_words long, n_removed long, kept_sha256 string, removed array<struct<first:int,end:int>>, _text string, settled array<struct<place:int,extent:int>>, open array<struct<place:int,extent:int>>"


def _result(final: bool):
    """Finish documents; those with open anchors wait, with their text, unless ``final``.

    ``settled`` holds anchors (extent 0) and, when final, single windows (extent 1).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in OUT.replace("<struct<first:int,end:int>>", "").replace("<struct<place:int,extent:int>>", "").split(", ")]
        span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows, settled, opened = [], batch.column("settled"), batch.column("open")
            wait = np.zeros(len(batch), dtype=bool) if final else np.array([bool(n) for n in opened.value_lengths().fill_null(0).to_pylist()], dtype=bool)
            for row, offsets, data in text_slices(batch.column("_text")):
                w = Words(offsets, data)
                for k in range(len(offsets) - 1):
                    if wait[row + k]:
                        rows.append((None, None, None, None))
                        continue
                    place, extent = repeats.spots(settled, row + k)
                    n, at = int(w.count[k]), int(w.first[k])
                    a, b = _windows_of(place, n)
                    a = np.where(extent > 0, place, a)
                    b = np.where(extent > 0, place, b)
                    gone = repeats.covered(n, a, b + WINDOW) if len(place) else np.zeros(n, dtype=bool)
                    keep = np.flatnonzero(~gone) + at
                    text = b" ".join(data[s:e].tobytes() for s, e in zip(w.start[keep], w.end[keep]))
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    spans = [{"first": int(x), "end": int(y)} for x, y in edges.reshape(-1, 2)]
                    rows.append((n, int(gone.sum()), hashlib.sha256(text).hexdigest(), spans))
            types = [pa.int64(), pa.int64(), pa.string(), span]
            done = [pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)]
            keep_text = pa.compute.if_else(pa.array(wait), batch.column("_text"), pa.scalar(None, batch.column("_text").type))
            none = pa.nulls(len(batch), settled.type)
            lists = [pa.compute.if_else(pa.array(wait), x, none) if wait.any() else none for x in (settled, opened)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_tie"), *done, keep_text, *lists], names=names)

    import pyarrow.compute  # noqa: F401  pa.compute

    return run


def substring_dedup(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed word spans of every distinct document."""
    d = identified(docs, id_col, text_col)
    found = cut(repeats.settle(d.mapInArrow(_anchors, repeats.ROWS), first_only=True))
    stage = cut(repeats.with_marks(d, found).mapInArrow(_result(final=False), OUT))
    waiting = stage.where("_text is not null").select("_id", "_tie", "_text", "settled", "open")
    windows = repeats.settle(waiting.mapInArrow(_open_windows, repeats.ROWS), first_only=True, open_windows=False)
    windows = cut(windows.withColumn("extent", F.lit(1)))
    again = repeats.marks(windows).select("_mid", "_mtie", F.col("settled").alias("more"))
    same = (F.col("_id") == F.col("_mid")) & (F.col("_tie") == F.col("_mtie"))
    both = waiting.join(again, same, "left").select(
        "_id", "_tie", "_text", F.concat("settled", F.coalesce("more", F.array().cast("array<struct<place:int,extent:int>>"))).alias("settled"), "open"
    )
    last = both.mapInArrow(_result(final=True), OUT)
    out = stage.where("_text is null").unionByName(last)
    return out.select(plain_id().alias("doc_id"), "n_words", "n_removed", "kept_sha256", "removed")
