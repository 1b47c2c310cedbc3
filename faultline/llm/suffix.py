"""Suffix-array dedup: bytes of 400-byte strings that also start anywhere else.

Shards are cut by content: the anchor of a 400-byte window is the 64-byte
string in it of least hash (leftmost if equal), so equal windows meet in the
shard of their anchor, however large the corpus. ``repeats`` settles equal
contexts; where the contexts of an anchor differ, their bytes, at most 736 or
so each, go to the anchor's shard. There all suffixes are sorted by induction
(``induced``), and two windows are equal where neighbours share 400 bytes.

A shard is sorted in memory, so none may outgrow a task. Where the open contexts
of an anchor sum to more than ``HOT_BYTES``, their windows are dealt again by the
anchor's offset in the window, ``NARROW[0]`` offsets at a time, and by the hash
of the bytes that all windows of these offsets share; equal windows have equal
ones. Equal contexts are settled again, and only what still differs is sorted.
Groups beyond the bound even then are dealt by single windows, whose hashes decide.

Defined cases: null text is empty. Rows equal in id and text are distinct
strings of the corpus, so all their windows repeat; they are returned once. A repeat within one document
counts. Rows without id come out as such. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import repeats
from faultline.llm.common import identified, plain_id, text_or_empty
from faultline.llm.induced import sorted_suffixes
from faultline.llm.rolling import byte_prefix, text_slices
from faultline.session import cut

WINDOW = 400
ANCHOR = 64
SHARD_BYTES = 1 << 20
HOT_BYTES = 4 << 20
NARROW = (16, 1)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks both ways."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _runs(offsets: np.ndarray, data: np.ndarray):
    """Runs of windows with one anchor: text, first window, windows, anchor's place; and the hash sums."""
    if len(data) < WINDOW:
        return None
    sums = byte_prefix(data, 0)
    at = np.arange(len(data) - ANCHOR + 1)
    hashes = sums.window(at, at + ANCHOR)
    key = (hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)  # leftmost of equal ones
    anchor = (_least(key, WINDOW - ANCHOR + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(anchor))
    doc = np.searchsorted(offsets, start, "right") - 1
    inside = start + WINDOW <= offsets[doc + 1]
    start, doc, anchor = start[inside], doc[inside], anchor[inside]
    if not len(start):
        return None
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    count = np.diff(np.concatenate([first, [len(start)]]))
    return doc[first], start[first], count, anchor[first], hashes


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, ties = batch.column("_id").to_numpy(), batch.column("_tie").to_numpy()
        for row, offsets, data in text_slices(batch.column("_text")):
            found = _runs(offsets, data)
            if found is None:
                continue
            doc, start, count, anchor, hashes = found
            other = byte_prefix(data, 1)
            context = other.window(start, start + count - 1 + WINDOW) + (anchor - start).astype(np.uint64)
            yield repeats.anchor_batch(
                hashes[anchor], context, ids[doc + row], ties[doc + row], start - offsets[doc], count, first_only=False
            )


def _open_spots(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Per slice of texts with open contexts: ids, ties, document begins, bytes, place and extent of each context."""
    ids, ties, opened = batch.column("_id").to_numpy(), batch.column("_tie").to_numpy(), batch.column("open")
    for row, offsets, data in text_slices(batch.column("_text")):
        found = [(k, *repeats.spots(opened, row + k)) for k in range(len(offsets) - 1)]
        place = np.concatenate([offsets[k] + p for k, p, _ in found])
        if len(place):
            doc = np.concatenate([np.full(len(p), k) for k, p, _ in found])
            yield ids[doc + row], ties[doc + row], offsets[doc], data, place, np.concatenate([e for _, _, e in found])


def _core_key(sums, anchor: np.ndarray, part: np.ndarray, width: int) -> np.ndarray:
    """Hash of what all windows share that have the anchor at the offsets of a part."""
    low = part * width
    high = np.minimum(low + width - 1, WINDOW - ANCHOR)
    return sums.window(anchor - low, anchor - high + WINDOW) + part.astype(np.uint64)


def _narrowed(width: int):
    """Rows of open contexts, cut where the anchor's offset passes a multiple of ``width``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, ties, begin, data, place, extent in _open_spots(batch):
                sums, other = byte_prefix(data, 0), byte_prefix(data, 1)
                _, offset = _anchor_of(sums, place)
                most = offset // width
                count = most - (offset - extent + 1) // width + 1
                of = np.repeat(np.arange(len(place)), count)
                part = most[of] - (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
                high = np.minimum(offset[of], part * width + width - 1)
                low = np.maximum((offset - extent + 1)[of], part * width)
                anchor = (place + offset)[of]
                start, windows = anchor - high, high - low + 1
                context = other.window(start, start + windows - 1 + WINDOW) + high.astype(np.uint64)
                key = _core_key(sums, anchor, part, width)
                yield repeats.anchor_batch(key, context, ids[of], ties[of], start - begin[of], windows, first_only=False)

    return rows


SEGMENT = "anchor long, _id long, _tie long, place int, extent int, body binary"


def _segments(width: int):
    """The bytes of open contexts, with their anchors, or the keys they were dealt by at a width."""
    names = [x.split()[0] for x in SEGMENT.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, ties, begin, data, place, extent in _open_spots(batch):
                sums = byte_prefix(data, 0)
                key, offset = _anchor_of(sums, place)
                if width:
                    key = _core_key(sums, place + offset, offset // width, width).view(np.int64)
                bodies = [data[a : a + e - 1 + WINDOW].tobytes() for a, e in zip(place, extent)]
                columns = [key, ids, ties, (place - begin).astype(np.int32), extent.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(bodies, type=pa.binary())], names=names)

    return rows


def _anchor_of(sums, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and offset of the anchor of the window at each place."""
    step = np.arange(WINDOW - ANCHOR + 1)
    out, offset = np.empty(len(place), dtype=np.int64), np.empty(len(place), dtype=np.int64)
    for k in range(0, len(place), 1024):  # windows are taken in blocks to bound memory
        at = place[k : k + 1024, None] + step
        hashes = sums.window(at, at + ANCHOR)
        best = np.argmin((hashes & np.uint64(0xFFFFFFFF00000000)) | step.astype(np.uint64), axis=1)
        out[k : k + 1024] = hashes[np.arange(len(best)), best].view(np.int64)
        offset[k : k + 1024] = best
    return out, offset


def _repeated(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts that another place of the shard equals: segment, first start, count."""
    lengths = np.array([len(b) for b in bodies])
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    text = np.zeros(begin[-1], dtype=np.int16)
    raw = np.frombuffer(b"\0".join(bodies) + b"\0", dtype=np.uint8)
    text[:] = raw
    text += 1
    text[begin[1:] - 1] = 0
    hit = np.zeros(len(text) + 1, dtype=bool)
    for position, shared in sorted_suffixes(text):
        long = np.flatnonzero(shared >= WINDOW)
        hit[position[long]] = True
        hit[position[long - 1]] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).reshape(-1, 2)
    segment = np.searchsorted(begin, edge[:, 0], "right") - 1
    return segment, edge[:, 0] - begin[segment], edge[:, 1] - edge[:, 0]


def _sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; whole anchors are sorted together."""
    names = [x.split()[0] for x in "_id long, _tie long, place int, extent int".split(", ")]
    held, size, last = [], 0, None

    def flush():
        segment, first, count = _repeated([r[4] for r in held])
        rows = [held[s] for s in segment]
        columns = [
            pa.array([r[1] for r in rows], type=pa.int64()),
            pa.array([r[2] for r in rows], type=pa.int64()),
            pa.array([r[3] + int(f) for r, f in zip(rows, first)], type=pa.int32()),
            pa.array(count.astype(np.int32)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("anchor", "_id", "_tie", "place", "body")]
        for row in zip(*columns):
            if row[0] != last and size >= SHARD_BYTES:
                yield flush()
                held, size = [], 0
            last = row[0]
            held.append(row)
            size += len(row[4])
    if held:
        yield flush()


OUT = "_id long, _tie long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<first:int,end:int>>"


def _result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["_id", "_tie", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
    span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        rows, settled, copies = [], batch.column("settled"), batch.column("_rows").to_pylist()
        for row, offsets, data in text_slices(batch.column("_text")):
            for k in range(len(offsets) - 1):
                body = data[offsets[k] : offsets[k + 1]]
                place, extent = repeats.spots(settled, row + k)
                if copies[row + k] > 1 and len(body) >= WINDOW:
                    place, extent = np.array([0]), np.array([len(body) - WINDOW + 1])
                gone = repeats.covered(len(body), place, place + extent - 1 + WINDOW) if len(place) else np.zeros(len(body), dtype=bool)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2)
                kept = hashlib.sha256(body[~gone].tobytes() if len(edges) else body.tobytes()).hexdigest()
                rows.append((len(body), int(gone.sum()), len(edges), kept, [{"first": int(a), "end": int(b)} for a, b in edges]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span]
        done = [pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_tie"), *done], names=names)


def _settled(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repeated places that hashes settle, and the segments to sort, no key's beyond ``HOT_BYTES``."""
    heavy = (F.col("extent") + (WINDOW - 1), HOT_BYTES)
    level = cut(repeats.settle(d.mapInArrow(_anchors, repeats.ROWS), first_only=False, heavy=heavy))
    done, segments = level.where("not open"), None
    for width, narrower in zip((0, *NARROW), (*NARROW, None)):
        opened = repeats.with_marks(d, level.where("open and not hot")).where("open is not null")
        if segments is None:
            segments = opened.mapInArrow(_segments(width), SEGMENT)
        elif width > 1:
            segments = segments.unionByName(opened.mapInArrow(_segments(width), SEGMENT))
        hot = level.where("open and hot")
        if narrower is None or hot.isEmpty():
            break
        rows = repeats.with_marks(d, hot).where("open is not null").mapInArrow(_narrowed(narrower), repeats.ROWS)
        # contexts of one window do not differ where their keys are equal
        level = cut(repeats.settle(rows, first_only=False, open_windows=narrower > 1, heavy=heavy))
        done = done.unionByName(level.where("not open"))
    return done.drop("hot"), segments


def suffix_dedup(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte spans."""
    d = identified(docs, id_col, text_col)
    done, segments = _settled(d)
    sorted_out = segments.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sort_shards, "_id long, _tie long, place int, extent int")
    every = done.unionByName(sorted_out.withColumn("open", F.lit(False)))
    # rows equal in id and text count as so many copies, all repeated
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("_rid"), F.xxhash64(text_or_empty(text_col)).alias("_rh"))
    rows = rows.groupBy("_rid", "_rh").agg(F.count("*").alias("_rows")).where("_rows > 1")
    same = (F.col("_id") == F.col("_rid")) & (F.xxhash64("_text") == F.col("_rh"))
    marked = repeats.with_marks(d, every).join(rows, same, "left").select("_id", "_tie", "_text", "settled", F.coalesce("_rows", F.lit(1)).alias("_rows"))
    return marked.mapInArrow(_result, OUT).select(plain_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")
