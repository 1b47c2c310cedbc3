"""Phrase collocation mining with stripes.

A stripe is a prefix of 0 to ``most - 1`` words with an associative counter of
the words that follow it. Tasks count the stripes of ``CHUNK`` bytes of text at
once, stripes of one prefix are merged elementwise after one shuffle, and every
count is read from them: the counter of a word in its prefix's stripe is the
count of the phrase of both, so a prefix's total stands in the stripe of its own
prefix, the totals of the empty prefix are a language's words, and a phrase's
greatest extension by a word behind it is the greatest counter of its stripe.

Lengths go up one by one. An extension can only be frequent where the prefix and
what remains without the first word are, so after each length the phrases found
enter a filter of ``FILTER_BITS`` bits (two bits a phrase), and the next length
counts stripes only where both may be frequent. False hits cost work, never
results; a fuller filter, as on larger corpora, prunes less.

Stripes of very frequent prefixes are dealt over parts by the hash of the next
word: a word with one occurrence in ``PARTS`` or more has a part for each such
share, a prefix as many as its rarest word, the empty prefix ``EMPTY_PARTS``. So
no part has more than one in ``PARTS`` of all words, and the words dealt are
at most ``PARTS``, which all tasks get. The merge reads sorted stripes and keeps
one part.

Within a task phrases are compared by 64-bit hashes of their bytes and then by
their bytes; where different phrases share a hash, bytes alone decide.

A candidate is a phrase of 2 to ``most`` words counted ``least`` times. Cutting
it in two parts of counts l and r gives ``floor(2000000 a / (l + r))``; the
lowest cut counts, the first of equal ones. A candidate inside a longer one that
has at least ``inside`` percent of its count is dropped; with counts that fall
with length, one word more on either side decides that.

Defined cases: a null text is empty, a null language ``und``, together with
documents that are labelled so. Phrases never cross documents or marks
``. , ; : ! ?`` and line breaks. Only A to Z are folded. A text longer than
``STRETCH`` is counted in stretches that overlap, each start once. Ids are not
used, so repeated rows count again; extra columns are not read. Empty tables give
no rows. Counts below 2^60 are exact; scores are computed in decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm import rolling
from faultline.session import cut

CHUNK = 6 << 20  # bytes of text counted together
STRETCH = 1 << 20  # bytes hashed together
ENTRIES = 1 << 18  # counters merged together
PARTS, EMPTY_PARTS = 4096, 1024
FILTER_BITS = 1 << 25
RANK_SALTS = 64

_UPPER = bytes(range(0x41, 0x5B))
_MARKS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes.maketrans(_UPPER + _MARKS + b"\t", _UPPER.lower() + b"\n" * len(_MARKS) + b" ")
_BLANK, _BREAK = 0x20, 0x0A
U = np.uint64


def stretches(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[tuple[bytes, list[int], list[bytes]]]:
    """(folded bytes, first byte and language of each text) of (lang, text) rows.

    Every text ends with a line break. Where a text is parted, its last ``overlap``
    words stand in both stretches.
    """
    held, begins, langs, size = [], [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            lang, data = lang.as_buffer().to_pybytes(), text.as_buffer().to_pybytes().translate(_FOLD)
            if size and size + len(data) >= STRETCH:
                yield b"".join(held), begins, langs
                held, begins, langs, size = [], [], [], 0
            begin = reach = 0
            while len(data) - reach > STRETCH:
                at = min((p for p in (data.find(b" ", reach + STRETCH), data.find(b"\n", reach + STRETCH)) if p >= 0), default=len(data))
                if at == len(data):
                    break
                yield data[begin:at] + b"\n", [0], [lang]
                reach = at
                for _ in range(overlap):  # back over one word
                    at = len(data[begin:at].rstrip(b" \n")) + begin
                    at = max(data.rfind(b" ", begin, at), data.rfind(b"\n", begin, at), begin - 1) + 1
                begin = at
            held += [data[begin:], b"\n"]
            begins.append(size)
            langs.append(lang)
            size += len(data) - begin + 1
    if held:
        yield b"".join(held), begins, langs


def _lang_hash(lang: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(lang)


class Words:
    """Words of a stretch, each followed by one blank in ``data``."""

    def __init__(self, text: bytes, begins: list[int]):
        raw = np.frombuffer(text, dtype=np.uint8)
        letter = (raw != _BLANK) & (raw != _BREAK)
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the text ends with a break
        first = letter.copy()
        first[1:] &= ~letter[:-1]
        starts = np.flatnonzero(first)
        self.text = np.searchsorted(np.array(begins), starts, "right") - 1
        self.piece = np.cumsum(raw == _BREAK)[starts]
        place = np.cumsum(keep) - 1
        self.start = place[starts]
        self.data = np.where(letter, raw, np.uint8(_BLANK))[keep]
        self.end = np.append(self.start[1:], len(self.data)) - 1
        self.prefix = rolling.byte_prefix(self.data, 0)

    def hashes(self, at: np.ndarray, length: int, salt: np.ndarray) -> np.ndarray:
        return self.prefix.window(self.start[at], self.end[at + length - 1]) ^ salt[at]


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a phrase in the filter."""
    mask = U(FILTER_BITS - 1)
    return h & mask, (h >> U(32)) & mask


def _known(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), dtype=bool)
    for place in _bits(h):
        out &= (bits[(place >> U(6)).astype(np.int64)] >> (place & U(63))) & U(1) == 1
    return out


def _frequent_starts(words: Words, depth: int, salt: np.ndarray, bits) -> np.ndarray:
    """Words that start ``depth + 1`` words of a piece whose parts may be frequent."""
    n = len(words.start)
    at = np.arange(n)
    if depth == 0:
        return at
    valid = np.zeros(n, dtype=bool)
    together = np.append(words.piece[1:] == words.piece[:-1], False)
    for length in range(1, depth + 1):
        valid[:] = False
        valid[at] = _known(words.hashes(at, length, salt), bits)
        at = np.flatnonzero(valid[:-1] & valid[1:] & together[:-1]) if n else at
    return at


def gathered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of many slices, one after the other."""
    before = np.cumsum(length) - length
    return data[np.repeat(start - before, length) + np.arange(int(length.sum()))]


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray) -> np.ndarray:
    """Whether slices that begin at a and b hold the same bytes."""
    same = length_a == length_b
    ask = np.flatnonzero(same & (a != b) & (length_a > 0))
    if len(ask):
        n = length_a[ask]
        differs = gathered(data, a[ask], n) != gathered(data, b[ask], n)
        same[ask] = np.add.reduceat(differs, np.cumsum(n) - n, dtype=np.int64) == 0
    return same


def binaries(data: np.ndarray, length: np.ndarray) -> pa.Array:
    """Slices that follow each other as an Arrow array."""
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


class Chunk:
    """Places of phrases in the words of several stretches."""

    def __init__(self):
        self.size, self.data, self.found = 0, [], []
        self.langs: dict[bytes, int] = {}

    def add(self, text: bytes, begins: list[int], langs: list[bytes], depth: int, bits, dealt) -> None:
        words = Words(text, begins)
        if not len(words.start):
            return
        number = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs])[words.text]
        salt = np.array([_lang_hash(x) for x in self.langs], dtype=U)[number]
        at = _frequent_starts(words, depth, salt, bits)
        after = words.hashes(at + depth, 1, salt)
        if depth:
            heavy, shares = dealt
            own = words.hashes(np.arange(len(words.start)), 1, salt)
            spot = np.minimum(np.searchsorted(heavy, own), max(0, len(heavy) - 1))
            parts = np.where(heavy[spot] == own, shares[spot], 1) if len(heavy) else np.ones(len(own), dtype=np.int64)
            parts = np.min([parts[at + k] for k in range(depth)], axis=0)
            prefix = words.hashes(at, depth, salt)
        else:
            parts, prefix = np.full(len(at), EMPTY_PARTS), salt[at]
        part = ((after >> U(20)) % parts.astype(U)).astype(np.int32)
        begin = words.start[at]
        split = words.start[at + depth]
        self.found.append((begin + self.size, split + self.size, words.end[at + depth] + self.size, number[at], prefix, words.hashes(at, depth + 1, salt), part))
        self.data.append(words.data)
        self.size += len(words.data)

    def stripes(self) -> pa.RecordBatch:
        data = np.concatenate(self.data)
        begin, split, end, lang, prefix, whole, part = (np.concatenate(x) for x in zip(*self.found))
        langs = list(self.langs)
        order = np.lexsort((whole, part, prefix))
        begin, split, end, lang, prefix, whole, part = (x[order] for x in (begin, split, end, lang, prefix, whole, part))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (whole[1:] != whole[:-1]) | (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1]) | (lang[1:] != lang[:-1])
        # a phrase that only shares a hash with the one before begins a counter of its own; the merge adds those of one word
        near = np.flatnonzero(~new)
        new[near] = ~same_bytes(data, begin[near], begin[near - 1], (end - begin)[near], (end - begin)[near - 1])
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(order)))
        begin, split, end, lang, prefix, part = (x[at] for x in (begin, split, end, lang, prefix, part))
        first = np.ones(len(at), dtype=bool)
        first[1:] = (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1]) | (lang[1:] != lang[:-1])
        near = np.flatnonzero(~first)
        first[near] = ~same_bytes(data, begin[near], begin[near - 1], (split - begin)[near], (split - begin)[near - 1])
        head = np.flatnonzero(first)
        width = end - split + 1  # with the blank behind it
        nexts = gathered(data, split, width)
        nexts[np.cumsum(width) - 1] = _BREAK
        lead = np.maximum(split - begin - 1, 0)[head]  # without the blank before the next word
        return pa.RecordBatch.from_arrays(
            [
                pa.array(langs, pa.binary()).take(pa.array(lang[head])),
                binaries(gathered(data, begin[head], lead), lead),
                pa.array(part[head]),
                binaries(nexts, np.add.reduceat(width, head)),
                pa.ListArray.from_arrays(pa.array(np.append(head, len(at)).astype(np.int32)), pa.array(counts.astype(np.int64))),
            ],
            names=["lang", "prefix", "part", "next", "n"],
        )


def _count_stripes(depth: int, sent):
    """Stripes of the prefixes of ``depth`` words; the next words of a stripe each end with a line break."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, dealt = sent.value if depth else (None, None)
        chunk = Chunk()
        for text, begins, langs in stretches(batches, depth):
            chunk.add(text, begins, langs, depth, bits, dealt)
            if chunk.size >= CHUNK or sum(len(x[0]) for x in chunk.found) >= CHUNK:
                if any(len(x[0]) for x in chunk.found):
                    yield chunk.stripes()
                chunk = Chunk()
        if any(len(x[0]) for x in chunk.found):
            yield chunk.stripes()

    return run


STRIPES = "lang binary, prefix binary, part int, next binary, n array<long>"


def _merge_stripes(least: int, totals: bool):
    """Elementwise sums of sorted stripes; (lang, prefix, next, n) of counters that reach ``least``.

    With ``totals`` also (lang, prefix, null, total) of each stripe.
    """

    def summed(t: pa.Table):
        """First row of each stripe; stripe, word and sum of each counter."""
        keys = [t.column(k).combine_chunks() for k in range(3)]
        new = np.zeros(len(t) - 1, dtype=bool)
        for key in keys:
            new |= pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.concatenate([[True], new]))
        stripe = np.cumsum(np.concatenate([[0], new.astype(np.int64)]))
        lists = t.column(4).combine_chunks()
        text = np.frombuffer(b"".join(t.column(3).to_pylist()), dtype=np.uint8)
        ends = np.flatnonzero(text == _BREAK)
        length = np.diff(np.concatenate([[-1], ends]))  # with the break
        words = binaries(text[text != _BREAK], length - 1).dictionary_encode()
        width = max(1, len(words.dictionary))
        code = np.repeat(stripe, pc.list_value_length(lists).to_numpy()) * width + words.indices.to_numpy()
        counts = lists.flatten().to_numpy()
        order = np.argsort(code, kind="stable")
        code = code[order]
        begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        sums = np.add.reduceat(counts[order], begin)
        code = code[begin]
        return first, code // width, words.dictionary, code % width, sums

    def rows(t: pa.Table, first, stripe, names, word, sums) -> pa.RecordBatch:
        keep = np.flatnonzero(sums >= least)
        at, after, n = first[stripe[keep]], names.take(pa.array(word[keep])), sums[keep]
        keys = [t.column(k).combine_chunks() for k in range(2)]
        found = [*(key.take(pa.array(at)) for key in keys), after, pa.array(n)]
        if totals and len(first):
            total = pa.array(np.bincount(stripe, weights=sums, minlength=len(first)).astype(np.int64))
            more = [*(key.take(pa.array(first)) for key in keys), pa.nulls(len(first), pa.binary()), total]
            found = [pa.concat_arrays(x) for x in zip(found, more)]
        return pa.RecordBatch.from_arrays(found, names=["lang", "prefix", "next", "n"])

    def limited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of about ``ENTRIES`` counters, or one stripe."""
        for batch in batches:
            upto = np.cumsum(pc.list_value_length(batch.column(4)).to_numpy())
            at = 0
            while at < len(batch):
                done = upto[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(upto, done + ENTRIES)))
                yield batch.slice(at, to - at)
                at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # the last stripe, which may go on in the next batch
        for batch in limited(batches):
            t = pa.Table.from_batches([batch])
            t = t if kept is None else pa.concat_tables([kept, t])
            first, stripe, names, word, sums = summed(t)
            last = len(first) - 1
            whole = stripe < last
            if last:
                yield rows(t, first[:last], stripe[whole], names, word[whole], sums[whole])
            rest = np.flatnonzero(~whole)
            text = b"".join(w + b"\n" for w in names.take(pa.array(word[rest])).to_pylist())
            key = [t.column(k).slice(int(first[last]), 1) for k in range(3)]
            one = pa.ListArray.from_arrays(pa.array([0, len(rest)], pa.int32()), pa.array(sums[rest]))
            kept = pa.Table.from_arrays([*key, pa.array([text], pa.binary()), one], schema=t.schema)
        if kept is not None:
            yield rows(kept, *summed(kept))

    return run


def _set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """64-bit words of the filter with the bits of (lang, phrase) rows."""
    for batch in batches:
        if not len(batch):
            continue
        phrases = batch.column(1).to_pylist()
        length = np.array([len(p) + 1 for p in phrases])
        end = np.cumsum(length)
        prefix = rolling.byte_prefix(np.frombuffer(b" ".join(phrases) + b" ", dtype=np.uint8), 0)
        known = {x: _lang_hash(x) for x in set(batch.column(0).to_pylist())}
        h = prefix.window(end - length, end - 1) ^ np.array([known[x] for x in batch.column(0).to_pylist()], dtype=U)
        places = np.concatenate(_bits(h))
        k, at = np.unique(places >> U(6), return_inverse=True)
        v = np.zeros(len(k), dtype=U)
        np.bitwise_or.at(v, at, U(1) << (places & U(63)))
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(v.view(np.int64))], names=["k", "v"])


def _filter_of(phrases: DataFrame, bits: np.ndarray) -> np.ndarray:
    """``bits`` with those of (lang, phrase) set; at most one row for 64 bits reaches the driver."""
    found = phrases.select("lang", "phrase").mapInArrow(_set_bits, "k long, v long").groupBy("k").agg(F.bit_or("v").alias("v")).toArrow()
    bits = bits.copy()
    bits[found["k"].to_numpy()] |= found["v"].to_numpy().view(U)
    return bits


def _dealt(words: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words with a share of one in ``PARTS`` or more, sorted, and their number of such shares."""
    least = 2 * total / PARTS
    heavy = words.where(F.col("n") >= least).collect()  # PARTS / 2 at most
    found = sorted((hash_of(bytes(r["lang"]), bytes(r["phrase"])), int(r["n"] * PARTS // total)) for r in heavy)
    return np.array([h for h, _ in found], dtype=U), np.array([k for _, k in found], dtype=np.int64)


def hash_of(lang: bytes, phrase: bytes) -> int:
    window = rolling.byte_prefix(np.frombuffer(phrase + b" ", dtype=np.uint8), 0).window(np.array([0]), np.array([len(phrase)]))
    return int(window[0]) ^ _lang_hash(lang)


def phrase_counts(docs: DataFrame, least: int = 30, most: int = 4, text_col="text", lang_col="lang") -> tuple[list[DataFrame], DataFrame]:
    """(lang, phrase, n) of frequent phrases of each length, and (lang, n) of all words; both keys in bytes."""
    spark = docs.sparkSession
    d = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).cast("binary").alias("lang"), F.col(text_col).cast("binary").alias("text"))
    d = d.where("text is not null")
    bits, dealt, found, totals = np.zeros(FILTER_BITS // 64, dtype=U), None, [], None
    for depth in range(most):
        sent = spark.sparkContext.broadcast((bits, dealt)) if depth else None
        stripes = d.mapInArrow(_count_stripes(depth, sent), STRIPES)
        merged = stripes.repartition("lang", "prefix", "part").sortWithinPartitions("lang", "prefix", "part")
        merged = cut(merged.mapInArrow(_merge_stripes(least, depth == 0), "lang binary, prefix binary, next binary, n long"))
        gap = F.lit(b" " if depth else b"")
        found.append(merged.where("next is not null").select("lang", F.concat("prefix", gap, "next").alias("phrase"), "n"))
        if depth == 0:
            totals = merged.where("next is null").groupBy("lang").agg(F.sum("n").alias("n"))
            dealt = _dealt(found[0], totals.agg(F.sum("n")).first()[0] or 1)
        if depth < most - 1:
            bits = _filter_of(found[-1], bits)
    return found, totals


def collocations(docs: DataFrame, least: int = 30, most: int = 4, inside: int = 80, top: int | None = 2000, text_col="text", lang_col="lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases; None: of all."""
    found, totals = phrase_counts(docs, least, most, text_col, lang_col)
    every = None
    for length, t in enumerate(found, 1):
        one = t.select(F.col("lang").cast("string").alias("lang"), F.split(F.col("phrase").cast("string"), " ").alias("words"), F.col("n").alias("a"), F.lit(length).alias("length"))
        every = one if every is None else every.unionByName(one)
    phrase = F.array_join("words", " ").alias("phrase")
    every = cut(every)
    parts = every.where(F.col("length") < most).select("lang", phrase, F.col("a").alias("f"))
    candidates = every.where("length > 1").select("*", phrase)
    k = F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k")
    cuts = candidates.select("*", k)
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("p1"), F.expr("array_join(slice(words, k + 1, length - k), ' ')").alias("p2"))
    for name, count in (("p1", "l"), ("p2", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(name), F.col("f").alias(count)), ["lang", name])
    whole = "cast(cast({} as decimal(19,0)) as decimal(38,0))".format
    score = F.expr(f"cast((2000000 * {whole('a')}) div ({whole('l')} + {whole('r')}) as bigint)")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    longer = candidates.where("length > 2").select(
        "lang", F.col("a").alias("longer"), F.explode(F.array(F.expr("slice(words, 1, length - 1)"), F.expr("slice(words, 2, length - 1)"))).alias("words")
    )
    longer = longer.groupBy("lang", phrase).agg(F.max("longer").alias("longer"))
    d = candidates.join(longer, ["lang", "phrase"], "left").where(F.expr(f"longer is null or 100 * {whole('longer')} < {inside} * {whole('a')}"))
    d = d.join(lowest, ["lang", "phrase"]).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    if top is not None:  # first among each part of a language, then among what is left of it
        salt = F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALTS))
        d = d.withColumn("_s", salt).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).where(F.col("_r") <= top).drop("_s", "_r")
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    d = d if top is None else d.where(F.col("rank") <= top)
    totals = totals.select(F.col("lang").cast("string").alias("lang"), "n")
    return d.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
