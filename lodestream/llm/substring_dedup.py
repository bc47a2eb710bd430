"""Substring dedup: windows of words that start more than once, behind a count-min prefilter.

First pass: every partition counts its windows, and the partitions' counts are
merged into one count-min sketch. A window is represented in the sketch by the
least of its gram hashes; a repeated window picks the same gram at each of its
places, so the sketch counts the places where a least gram of a window lies and
never falls below a window's count, at a twelfth of the counters. The sketch is
cut into ranges of gram hashes, a task for each, so that it grows with the corpus
and no task or driver holds it whole: a task merges what all partitions send for
its range and answers each text with those of its grams that are estimated to
occur twice or more.

Second pass: only windows with such a gram are shuffled, by a 128-bit hash of
their words (two hashes that share neither the words' hashes nor the base), and
counted exactly. Those that occur once are what the sketch was wrong about; each
belongs to one text, and they alone are sent back to it. The windows that remain
cover the words to remove.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.llm.scratch import save, without
from lodestream.llm.words import U, WordHashes, blank, lean, numbers, odd, planes, scramble, slices, spans, texts, width_of

GRAM = 12
#: Rows of the sketch and counters of a row for each gram; the most that a counter holds.
DEPTH, CELLS_PER_GRAM, FULL = 2, 8.0, 255
#: Grams that a task sorts and packs at a time, and those of a range.
FLUSH, RANGE_GRAMS = 500_000, 500_000
#: Bits of a gram's hash at most: with the number of a text in its slice they make one word.
MOST_BITS = 55
#: Copies of a text from which on they are not counted one by one, as a number and as a share of all documents.
HOT_COPIES, HOT_SHARE = 1000, 1e-3
#: Bits of a gram's hash beyond the logarithm of their number: one in 2^15 meets another by chance.
SPARE_BITS = 15
#: Of the polynomial hashes, and the seed of the second one's word hashes: the two share nothing.
_BASES, _SEED = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)), 41
_INVERSES = tuple(U(pow(int(b), -1, 1 << 64)) for b in _BASES)


@lru_cache(maxsize=8)
def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base), U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    if n > 1 << 24:  # a text longer than any slice: not worth keeping
        return _powers_of.__wrapped__(int(base), n)
    return _powers_of(int(base), 1 << max(10, (n - 1).bit_length()))[:n]


def _runs(h: np.ndarray, width: int, which: int) -> np.ndarray:
    """A polynomial hash of every run of so many words, from prefix sums modulo 2^64."""
    n = max(0, len(h) - width + 1)
    total = np.concatenate((np.zeros(1, U), np.cumsum(h * _powers(_BASES[which], len(h)), dtype=U)))
    return (total[len(total) - n :] - total[:n]) * _powers(_INVERSES[which], n)


def _slide(x: np.ndarray, width: int, how: np.ufunc) -> np.ndarray:
    """how over every run of so many numbers, by doubling."""
    n = 1
    while 2 * n <= width:
        x, n = how(x[: max(0, len(x) - n)], x[n:]), 2 * n
    return how(x[: max(0, len(x) - (width - n))], x[width - n :]) if n < width else x


def picked(h: np.ndarray, edges: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(grams, places, starts, least) of texts that lie one after another, with bounds `edges`.

    starts: of all windows within a text; least: the least gram hash of each,
    which is the gram that the window picks; grams and places: hash and place of
    the grams that are picked, one for each place that a window's pick may be at.
    """
    grams = scramble(_runs(h, gram, 0) + odd(21))
    span = width - gram + 1
    starts = spans(edges[:-1], np.maximum(np.diff(edges) - width + 1, 0))
    if not len(starts):
        return grams[:0], starts, starts, grams[:0]
    least = _slide(grams, span, np.minimum)[starts]
    # A gram is picked if one of the windows that cover it has no lesser one.
    held = np.zeros(len(grams) + span - 1, U)
    held[starts + span - 1] = least
    places = np.flatnonzero(_slide(held, span, np.maximum) == grams)
    return grams[places], places, starts, least


class Ranges(NamedTuple):
    """How many bits of a gram's hash are used, how many of them name its range, and counters of a sketch's row for a gram."""

    bits: int
    range_bits: int
    cells: float

    @classmethod
    def for_grams(cls, n: int, range_grams: int, cells: float) -> Ranges:
        return cls(min(MOST_BITS, max(32, math.ceil(math.log2(n + 1)) + SPARE_BITS)), min(30, max(0, math.ceil(math.log2(max(1, n) / range_grams)))), cells)

    def short(self, grams: np.ndarray) -> np.ndarray:
        return grams >> U(64 - self.bits)

    def pack(self, grams: np.ndarray, docs: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, bytes, int, bytes, bytes]]:
        """(range, steps, bytes of a step, places among the ids, ids) of sorted grams, for each range that has any; ids are rows of two numbers."""
        rest = U(self.bits - self.range_bits)
        edges = np.searchsorted(grams >> rest, np.arange((1 << self.range_bits) + 1, dtype=U)) if self.range_bits else np.array([0, len(grams)])
        for r in range(len(edges) - 1):
            g, d = grams[edges[r] : edges[r + 1]], docs[edges[r] : edges[r + 1]]
            if len(g):
                steps = np.diff(g, prepend=U(r) << rest)
                own, place = np.unique(d, return_inverse=True)
                yield r, planes(steps, width_of(int(steps.max()))), width_of(int(steps.max())), planes(place, width_of(len(own))), ids[own].tobytes()

    def unpack(self, r: int, steps: bytes, width: int, places: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(grams, places among the ids, ids)."""
        own = np.frombuffer(ids, np.int64).reshape(-1, 2)
        grams = np.cumsum(numbers(steps, width), dtype=U) + (U(r) << U(self.bits - self.range_bits))
        return grams, numbers(places, width_of(len(own))).astype(np.int64), own


def cells(grams: np.ndarray, row: int, count: int) -> np.ndarray:
    """The counter of each gram in a row of the sketch with so many counters."""
    return (scramble(grams + odd(31 + row)) % U(count)).astype(np.int64)


class Sketch:
    """A count-min sketch that saturates."""

    def __init__(self, counters: int) -> None:
        self.rows = [np.zeros(max(1, counters), np.uint8) for _ in range(DEPTH)]

    def merge(self, grams: np.ndarray) -> None:
        """Count these, of which some may be equal."""
        for i, row in enumerate(self.rows):
            at, n = np.unique(cells(grams, i, len(row)), return_counts=True)
            row[at] = np.minimum(row[at] + np.minimum(n, FULL).astype(np.int64), FULL)

    def estimates(self, grams: np.ndarray) -> np.ndarray:
        return np.minimum.reduce([row[cells(grams, i, len(row))] for i, row in enumerate(self.rows)])


_SENT = pa.schema([("range", pa.int32()), ("steps", pa.binary()), ("width", pa.int32()), ("places", pa.binary()), ("ids", pa.binary())])
_LIKELY = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("grams", pa.list_(pa.int64()))])


def _count(width: int, gram: int, ranges: Ranges):
    """Rows of (text, a, b) as the grams of their windows' places, packed by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, ids, n, docs = WordHashes(), [], [], 0, 0

        def flush():
            grams, owner = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(grams, kind="stable")
            packed = list(zip(*ranges.pack(grams[order], owner[order], np.concatenate(ids)), strict=True))
            yield blank(_SENT, len(packed[0]), **{f.name: pa.array(v, f.type) for f, v in zip(_SENT, packed, strict=True)})

        for batch in slices(batches):
            h, edges = hashes.flat([t.split() for t in texts(batch.column(0))])
            grams, at, _, _ = picked(h, edges, width, gram)
            if len(grams):
                held.append((ranges.short(grams), np.searchsorted(edges, at, "right") - 1 + docs))
                n += len(grams)
                ids.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)], axis=1))
                docs += batch.num_rows
            if n >= FLUSH:
                yield from flush()
                held, ids, n, docs = [], [], 0, 0
        if n:
            yield from flush()

    return run


def _answer(ranges: Ranges):
    """Rows sorted by range as each text's grams that are estimated to occur twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush():
            sketch = Sketch(int(ranges.cells * sum(len(g) for g, _, _ in held)))
            for grams, _, _ in held:
                sketch.merge(grams)
            for grams, place, ids in held:
                often = sketch.estimates(grams) > 1
                g, d = grams[often], place[often]
                if not len(g):
                    continue
                order = np.lexsort((g, d))
                g, d = g[order], d[order]
                fresh = np.concatenate(([True], (d[1:] != d[:-1]) | (g[1:] != g[:-1])))
                g, d = g[fresh], d[fresh]
                own, first = np.unique(d, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(g)), pa.int32()), pa.array(g.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[own, 0]), pa.array(ids[own, 1]), lists], schema=_LIKELY)

        for batch in batches:
            for i in range(batch.num_rows):
                r, *packed = (batch.column(c)[i].as_py() for c in range(5))
                if r != now:
                    yield from flush()
                    now, held = r, []
                held.append(ranges.unpack(r, *packed))
        yield from flush()

    return run


def _estimated(h: np.ndarray, edges: np.ndarray, width: int, gram: int, ranges: Ranges, likely: pa.Array) -> np.ndarray:
    """Starts of the windows whose estimated count is two or more; likely: the grams of each text that are."""
    _, _, starts, least = picked(h, edges, width, gram)
    if not len(starts):
        return starts
    # A text's number is put beside each gram, so that one look-up serves all texts.
    counts = np.diff(edges)
    doc = np.repeat(np.arange(len(counts)), np.maximum(counts - width + 1, 0))
    lists = likely.combine_chunks() if isinstance(likely, pa.ChunkedArray) else likely
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    grams = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U)
    known = np.sort((np.repeat(np.arange(len(lengths)), lengths).astype(U) << U(MOST_BITS)) + grams)
    if not len(known):
        return starts[:0]
    fresh = np.concatenate(([True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])))  # neighbours mostly pick the same
    asked = (doc[fresh].astype(U) << U(MOST_BITS)) + ranges.short(least[fresh])
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return starts[(known[at] == asked)[np.cumsum(fresh) - 1]]


def _candidates(width: int, gram: int, ranges: Ranges, text: str):
    """(h1, h2, a, b, at): the words of each window as 128 bits, and the text and place it is from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, others = WordHashes(), WordHashes(_SEED)
        for batch in slices(batches):
            split = [t.split() for t in texts(batch.column(text))]
            h, edges = hashes.flat(split)
            at = _estimated(h, edges, width, gram, ranges, batch.column("_grams"))
            if not len(at):
                continue
            doc = np.searchsorted(edges, at, "right") - 1
            # the second hash is over other word hashes and another base, of the texts that need it
            own, place = np.unique(doc, return_inverse=True)
            more, bounds = others.flat([split[d] for d in own.tolist()])
            inside = at - edges[doc]
            one, two = _runs(h, width, 0)[at], _runs(more, width, 1)[bounds[place] + inside]
            a, b = (batch.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("_x", "_y"))
            columns = [scramble(one).view(np.int64), scramble(two).view(np.int64), a, b, inside.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h1", "h2", "a", "b", "at"])

    return run


def _remove(width: int, gram: int, ranges: Ranges, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            split = [t.split() for t in texts(batch.column(text))]
            h, edges = hashes.flat(split)
            edge = np.zeros(len(h) + 1, np.int64)
            at = _estimated(h, edges, width, gram, ranges, batch.column("_grams"))
            edge[at] += 1  # starts are distinct, and so are ends
            edge[at + width] -= 1
            for d in np.flatnonzero(batch.column("_once").is_valid().to_numpy(zero_copy_only=False)).tolist():
                once = np.array(batch.column("_once")[d].as_py(), np.int64) + edges[d]
                edge[once] -= 1
                edge[once + width] += 1
            cover = np.cumsum(edge)[:-1] > 0
            counted = np.concatenate(([0], np.cumsum(cover)))[edges]
            gone = np.diff(counted)
            stay = ~cover
            kept = [b" ".join(compress(w, stay[a:b].tolist()) if n else w) for w, n, a, b in zip(split, gone.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            more = [pa.array(np.diff(edges), pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            old = batch.drop_columns(["_x", "_y", "_grams", "_once"])
            yield pa.RecordBatch.from_arrays([*old.columns, *more], names=[*old.schema.names, "_words", "_gone", "_kept"])

    return run


def _clear(width: int, text: str):
    """Rows whose text has copies: all of its words go if it has a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            split = [t.split() for t in texts(batch.column(text))]
            total = [len(w) for w in split]
            gone = [n if n >= width else 0 for n in total]
            kept = [b"" if g else b" ".join(w) for w, g in zip(split, gone, strict=True)]
            more = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            old = batch.drop_columns(["_x", "_y"])
            yield pa.RecordBatch.from_arrays([*old.columns, *more], names=[*old.schema.names, "_words", "_gone", "_kept"])

    return run


def remove_repeats(
    docs: DataFrame,
    width: int = 50,
    gram: int = GRAM,
    key: str = "doc_id",
    text: str = "text",
    carry: bool = True,
    range_grams: int = RANGE_GRAMS,
    cells_per_gram: float = CELLS_PER_GRAM,
    hot_copies: int = HOT_COPIES,
) -> DataFrame:
    """Adds n_words, n_removed and kept_text to every document.

    A word is removed if a window of `width` consecutive words that covers it
    has the same words as a window that starts anywhere else, in the same
    document too; all windows are judged on the input. Words are runs without
    ASCII white space; kept words are joined by one space. Texts shorter than a
    window, empty and null ones lose nothing; null counts as empty. Repeated
    rows repeat each other's windows and so lose them all. Input columns named
    like an output are replaced. Without rows the result is empty. carry=False
    returns the key and the new columns alone.

    A task's part of the sketch is for some range_grams grams, whatever the
    corpus. Fewer counters for a gram let more windows through to the exact
    count, and the result stays the same.
    """
    docs = without(docs, "n_words", "n_removed", "kept_text")
    gram = min(gram, width)
    told = docs.agg(F.sum(F.octet_length(text)), F.count(F.lit(1))).first()
    ranges = Ranges.for_grams(int((told[0] or 0) / 6.5 * 2 / (width - gram + 2)), range_grams, cells_per_gram)
    spare = [f"_c{i}" for i in range(len(docs.columns))]
    key_col, text_col = spare[docs.columns.index(key)], spare[docs.columns.index(text)]
    rows = docs.toDF(*spare)
    rows = rows if carry else rows.select(key_col, text_col)
    rows = rows.withColumn("_x", F.xxhash64(text_col)).withColumn("_y", F.xxhash64(F.lit(_SEED), F.col(text_col)))
    names = rows.columns

    # Every window of a text that occurs twice is repeated. Of a text with very many copies two go on to be counted; the
    # copies themselves need no count.
    copies = rows.groupBy(F.col("_x").alias("_hx"), F.col("_y").alias("_hy")).agg(F.count(F.lit(1)).alias("n"))
    copies = save(copies.where(F.col("n") >= hot_copies), "substring-copies")
    bound = max(hot_copies, math.ceil(told[1] * HOT_SHARE))
    hot = F.broadcast(copies.where(F.col("n") >= bound).select("_hx", "_hy"))  # at most 1 / HOT_SHARE rows
    same = (F.col("_x") == F.col("_hx")) & (F.col("_y") == F.col("_hy"))
    crowd = rows.join(hot, same, "left_semi")
    two = crowd.groupBy("_x", "_y").agg(F.min(text_col).alias(text_col)).withColumn("_twin", F.explode(F.array(F.lit(True), F.lit(True))))
    two = two.select(*[F.col(c) if c in ("_x", "_y", text_col) else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names], "_twin")
    rows = rows.join(hot, same, "left_anti").withColumn("_twin", F.lit(False)).unionByName(two)

    sent = rows.select(text_col, "_x", "_y").mapInArrow(lean(_count(width, gram, ranges)), "range int, steps binary, width int, places binary, ids binary")
    likely = sent.repartition("range").sortWithinPartitions("range").mapInArrow(lean(_answer(ranges)), "a long, b long, grams array<long>")
    likely = save(likely, "substring-likely")
    likely = likely.groupBy(F.col("a").alias("_a"), F.col("b").alias("_b")).agg(F.flatten(F.collect_list("grams")).alias("_grams"))
    # Always by a sort-merge join: both sides grow with the corpus. The texts move once: the second join has the
    # same key, and the candidates read the same columns, so that the exchange is used again.
    told = rows.join(likely.hint("merge"), (F.col("_x") == F.col("_a")) & (F.col("_y") == F.col("_b")), "left").drop("_a", "_b")

    found = told.mapInArrow(lean(_candidates(width, gram, ranges, text_col)), "h1 long, h2 long, a long, b long, at int")
    exact = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a"), F.min("b").alias("b"), F.min("at").alias("at"))
    once = exact.where("n = 1").groupBy(F.col("a").alias("_a"), F.col("b").alias("_b")).agg(F.collect_list("at").alias("_once"))
    told = told.join(once.hint("merge"), (F.col("_x") == F.col("_a")) & (F.col("_y") == F.col("_b")), "left").drop("_a", "_b")
    more = [T.StructField("_words", T.LongType()), T.StructField("_gone", T.LongType()), T.StructField("_kept", T.StringType())]
    fields = lambda df: [f for f in df.schema.fields if f.name not in ("_x", "_y", "_grams", "_once")]
    result = told.mapInArrow(lean(_remove(width, gram, ranges, text_col)), T.StructType([*fields(told), *more])).where("not _twin").drop("_twin")
    result = result.unionByName(crowd.mapInArrow(lean(_clear(width, text_col)), T.StructType([*fields(crowd), *more])))
    kept = list(zip(spare, docs.columns, strict=True)) if carry else [(key_col, key)]
    return result.select(*[F.col(s).alias(c) for s, c in kept], F.col("_words").alias("n_words"), F.col("_gone").alias("n_removed"), F.col("_kept").alias("kept_text"))
