"""N-gram Jaccard join by PartEnum signatures.

Sets of shingles fall into bands by size. Within a band, similar sets differ in
at most k elements. The domain of shingles is cut into n1 first-level parts of
THIRDS second-level parts each; k differences leave at least one first-level
part with at most one of them, so one of the enumerated subsets of THIRDS - 1
second-level parts holds none: both sets have the same elements there, and the
same signature. EXTRA further parts ensure that this also holds for a subset
that is not empty, so that sets are never brought together by the absence of
elements; the rare set with too many empty subsets is signed again under
another cut of the domain.

Nearly all signatures belong to one set only, so they are moved as cheaply as
can be: a task sorts what it signed, joins sets with equal signatures on the
spot, and sends one packed block for each range of signatures. Sets of a band
that share signatures form clusters. Passages that many documents share make
signatures meet by chance, so clusters are refined first: each set is present
with a byte for each second-level part, linked sets differ in at most k of them,
and the components of that relation are what is left to compare. Only their
texts are moved, once, and links are tested exactly. Clusters beyond a bound are
cut into blocks, and every pair of blocks is one task. No pairs are written
anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestream.llm.components import components
from lodestream.llm.scratch import save, spent, without
from lodestream.llm.words import U, WordHashes, blank, lean, numbers, odd, planes, scramble, slices, spans, texts, width_of

#: Second-level parts of a first-level part; subsets of all but one are enumerated.
THIRDS = 3
#: First-level parts beyond those that the differences need, so that empty subsets can be left out.
EXTRA = 2
#: More of them for larger bands, as the share of parts that have an empty subset by chance.
EXTRA_SHARE = 0.08
#: Cuts of the domain that are tried before empty subsets are signed too.
CUTS = 6
#: Ratio of the largest to the smallest size of a band.
BAND = 1.3
#: Shingles of a cluster's block: 8 bytes each, and some ten times that in work; and bytes of its sets' cells.
BLOCK_SHINGLES, BLOCK_BYTES = 1_500_000, 8_000_000
#: Sets of a block of a cluster that fits one task, so that more tasks share its work, and the most such blocks.
BLOCK_SETS, MOST_BLOCKS = 500, 16
#: Sets of a cluster that are simply compared with each other, in full and by their cells.
FEW, MANY = 6, 3_000
#: Signatures that a task sorts and packs at a time, those of a range, and bytes of text for each.
FLUSH, RANGE_SIGNS, SIGN_BYTES = 500_000, 500_000, 5
#: Bits of a signature beyond the logarithm of their number: one pair in 2^15 signatures meets by chance.
SPARE_BITS = 15
#: Bytes of a node's id, and its bits above and below the start of its band.
NODE_BYTES, BAND_BITS = 6, 7
NODE_HASH = 8 * NODE_BYTES - BAND_BITS
#: Sets that a task remembers so as not to sign their copies.
SEEN = 300_000


class Sets(NamedTuple):
    """Sorted distinct elements of some sets, one set after another, and where each begins, with the end."""

    elements: np.ndarray
    edges: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.edges)

    def of(self, i: int) -> np.ndarray:
        return self.elements[self.edges[i] : self.edges[i + 1]]

    def folded(self, values: np.ndarray, how: np.ufunc) -> np.ndarray:
        """how over the values of each set; 0 for empty sets."""
        out = np.zeros(len(self.edges) - 1, U)
        held = self.sizes > 0
        if held.any():
            out[held] = how.reduceat(values, self.edges[:-1][held])
        return out

    def sums(self) -> np.ndarray:
        return self.folded(self.elements, np.add)

    def names(self) -> list[bytes | None]:
        """128-bit names of the sets; none for empty ones."""
        pair = np.stack((self.sums(), self.folded(scramble(self.elements + odd(11)), np.bitwise_xor)), axis=1)
        return [row.tobytes() if n else None for row, n in zip(pair, self.sizes.tolist(), strict=True)]


def shingle_sets(documents: list[bytes], n: int, hashes: WordHashes) -> Sets:
    """The hashes of the n-word shingles of each text, A-Z in lower case.

    Of fewer words the whole sequence is one shingle; no words, no shingle.
    """
    h, edges = hashes.flat([t.lower().split() for t in documents])
    lengths = np.diff(edges)
    counts = np.where(lengths > 0, np.maximum(lengths - n + 1, 1), 0)
    whole = max(0, len(h) - n + 1)
    total = np.full(whole, odd(100 + n), U)
    for i in range(n):
        total += h[i : i + whole] * odd(i)
    ends = np.cumsum(counts)
    out = np.empty(ends[-1] if len(ends) else 0, U)
    long = lengths >= n
    out[np.repeat(long, counts)] = total[spans(edges[:-1][long], counts[long])]
    for d in np.flatnonzero((lengths > 0) & ~long).tolist():
        own = h[edges[d] : edges[d + 1]]
        out[ends[d] - 1] = (own * np.array([odd(i) for i in range(len(own))], U)).sum(dtype=U) + odd(100 + len(own))
    out = scramble(out)
    starts = ends - counts
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[starts[counts > 0]] = True
    return Sets(out[fresh], np.concatenate(([0], np.cumsum(fresh)))[np.concatenate(([0], ends))])


class Bands:
    """Bands of sizes, each with its bound k on differences, for links of similarity num/den or more."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * BAND)))
        every = range(len(self.lows) - 1)
        self._k = np.array([self.differences(b) for b in every])
        self._extra = np.array([self.extra(b) for b in every])
        self._parts = np.array([self.parts(b) for b in every])

    def linked(self, both: int, a: int, b: int) -> bool:
        return self.den * both >= self.num * (a + b - both)

    def differences(self, band: int) -> int:
        """The most elements that linked sets of a band have apart.

        |A| + |B| - 2 both, where both >= num (|A| + |B|) / (num + den) and neither is above the band.
        """
        return 2 * (self.lows[band + 1] - 1) * (self.den - self.num) // (self.den + self.num)

    def extra(self, band: int) -> int:
        """First-level parts beyond those that the differences need."""
        return EXTRA + int(EXTRA_SHARE * (self.differences(band) // 2 + 1))

    def parts(self, band: int) -> int:
        """First-level parts: at most differences // 2 of them hold two differences or more."""
        return self.differences(band) // 2 + 1 + self.extra(band)

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set, band): the band of each set, and those above it that hold sets it may be linked with.

        Bands in which only equal sets are linked are left out, as are empty sets.
        """
        first = np.searchsorted(self.lows, sizes, "right") - 1
        last = np.searchsorted(self.lows, self.den * sizes // self.num, "right") - 1
        counts = np.where(sizes > 0, last - first + 1, 0)
        at, band = np.repeat(np.arange(len(sizes)), counts), spans(first, counts)
        apart = self._k[band] > 0
        return at[apart], band[apart]


def nodes_of(sums: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Ids of sets in bands, for finding candidates only; the band is on top."""
    return (scramble(sums + odd(7) + band.astype(U) * odd(8)) >> U(64 - NODE_HASH)) + (band.astype(U) << U(NODE_HASH))


class Cells(NamedTuple):
    """The elements of some sets by second-level part: a hash of them and their number, and where each set's cells end."""

    sums: np.ndarray
    counts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, sets: Sets, at: np.ndarray, cells: np.ndarray, cut: int = 0) -> Cells:
        """Of the sets at[i], in cells[i] cells each."""
        sizes, ends = sets.sizes[at], np.cumsum(cells)
        placed = sets.elements[spans(sets.edges[at], sizes)]
        if cut:
            placed = scramble(placed + odd(200 + cut))
        cell = (placed.astype(np.float64) * np.repeat(cells / 2.0**64, sizes)).astype(np.int64)
        cell = np.minimum(cell, np.repeat(cells - 1, sizes)) + np.repeat(ends - cells, sizes)
        if cut:
            order = np.argsort(cell, kind="stable")
            placed, cell = placed[order], cell[order]
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        sums = np.zeros(ends[-1], U)
        sums[cell[first]] = np.add.reduceat(scramble(placed + odd(3)), first)
        return cls(sums, np.bincount(cell, minlength=ends[-1]), ends)

    def told(self) -> np.ndarray:
        """A byte for each cell: 0 if it is empty, else from the hash of its elements."""
        return np.where(self.counts > 0, np.maximum(scramble(self.sums) >> U(56), U(1)), U(0)).astype(np.uint8)


class Signed(NamedTuple):
    """Signatures (64 bits) and the place in `at` of each one's set, and the cells of every at[i] as bytes; 0 is an empty cell."""

    signs: np.ndarray
    owner: np.ndarray
    cells: list[bytes]


def _of_cut(sets: Sets, at: np.ndarray, band: np.ndarray, bands: Bands, cut: int) -> tuple[Cells, np.ndarray, np.ndarray, np.ndarray]:
    """(cells, signatures, owners, which of `at` must be signed under another cut)."""
    parts = bands._parts[band] * THIRDS
    cells = Cells.of(sets, at, parts, cut)
    sums, counts = cells.sums.reshape(-1, THIRDS), cells.counts.reshape(-1, THIRDS)
    own = sums.sum(axis=1, dtype=U, keepdims=True) - sums
    held = counts.sum(axis=1, keepdims=True) - counts > 0
    name = (spans(np.zeros(len(at), np.int64), parts) + np.repeat((band << 40) + (cut << 36), parts)).astype(U)
    signs = scramble(own.ravel() ^ scramble(name + odd(5)))
    # extra + 1 parts have a subset in common: if no more than extra parts have an empty subset, one
    # that is common and not empty remains.
    bare = np.add.reduceat((~held.all(axis=1)).astype(np.int64), (cells.ends - parts) // THIRDS)
    unsure = bare > bands._extra[band]
    keep = held.ravel() | np.repeat(unsure & (cut == CUTS - 1), parts)
    return cells, signs[keep], np.repeat(np.arange(len(at)), parts)[keep], np.flatnonzero(unsure)


def signatures(sets: Sets, at: np.ndarray, band: np.ndarray, bands: Bands) -> Signed:
    """Of the sets at[i] in bands band[i]; a set's signatures do not repeat."""
    if not len(at):
        return Signed(np.empty(0, U), np.empty(0, np.int64), [])
    cells, signs, owner, rest = _of_cut(sets, at, band, bands, 0)
    told = cells.told()
    found, owners, cut = [signs], [owner], 1
    while len(rest) and cut < CUTS:
        _, signs, owner, more = _of_cut(sets, at[rest], band[rest], bands, cut)
        found.append(signs)
        owners.append(rest[owner])
        rest, cut = rest[more], cut + 1
    ends = cells.ends.tolist()
    return Signed(np.concatenate(found), np.concatenate(owners), [told[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)])


def _stars(signs: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct signatures, the least node of each) and (hub, node): edges from it to the others, without repeats."""
    order = np.argsort(signs, kind="stable")
    signs, nodes = signs[order], nodes[order]
    first = np.flatnonzero(np.concatenate(([True], signs[1:] != signs[:-1])))
    hubs = np.minimum.reduceat(nodes, first)
    hub = np.repeat(hubs, np.diff(np.concatenate((first, [len(signs)]))))
    other = np.flatnonzero(hub != nodes)
    a, b = hub[other], nodes[other]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return signs[first], hubs, a[fresh], b[fresh]


class Packing(NamedTuple):
    """How many bits of a signature are used, and how many of them name its range."""

    bits: int
    range_bits: int

    @classmethod
    def for_bytes(cls, size: int) -> Packing:
        n = max(1, size // SIGN_BYTES)
        return cls(min(64, max(32, math.ceil(math.log2(n + 1)) + SPARE_BITS)), max(0, math.ceil(math.log2(n / RANGE_SIGNS))))

    def pack(self, signs: np.ndarray, nodes: np.ndarray) -> Iterator[tuple[int, bytes, int, bytes, bytes]]:
        """Sorted distinct signatures as (range, steps, bytes of a step, nodes, places among the nodes) for each range that has any."""
        rest = U(self.bits - self.range_bits)
        edges = np.searchsorted(signs >> rest, np.arange((1 << self.range_bits) + 1, dtype=U)) if self.range_bits else np.array([0, len(signs)])
        for r in range(len(edges) - 1):
            s, v = signs[edges[r] : edges[r + 1]], nodes[edges[r] : edges[r + 1]]
            if not len(s):
                continue
            steps = np.diff(s, prepend=U(r) << rest)
            width = width_of(int(steps.max()))
            own, place = np.unique(v, return_inverse=True)
            at = width_of(len(own))
            if len(own) * NODE_BYTES + len(v) * at < len(v) * NODE_BYTES:
                yield r, planes(steps, width), width, planes(own, NODE_BYTES), planes(place, at)
            else:
                yield r, planes(steps, width), width, planes(v, NODE_BYTES), b""

    def unpack(self, r: int, steps: bytes, width: int, nodes: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray]:
        signs = np.cumsum(numbers(steps, width), dtype=U) + (U(r) << U(self.bits - self.range_bits))
        own = numbers(nodes, NODE_BYTES)
        return signs, own[numbers(places, len(places) // len(signs)).astype(np.int64)] if places else own


#: What a task sends: blocks of a range (from 0 on), edges, and one row for each document (range below 0).
_MOVED = "range int, steps binary, width int, nodes binary, places binary, a long, b long, x long, n long, name binary, own array<struct<node: bigint, cells: binary>>"
#: Ranges over which edges and documents are spread.
_SPREAD = 4096


def _arrow(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])


def _sign(n: int, bands: Bands, packing: Packing, schema: pa.Schema):
    """Rows of (key, x, text) as what a task sends: see _MOVED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, held, count, dealt = WordHashes(), set(), [], 0, 0

        def flush():
            nodes = np.concatenate([v for _, v in held])
            # The last bits kept are the band, so that sets of two bands never meet.
            signs = ((np.concatenate([s for s, _ in held]) >> U(64 - packing.bits + BAND_BITS)) << U(BAND_BITS)) + (nodes >> U(NODE_HASH))
            signs, nodes, a, b = _stars(signs, nodes)
            packed = list(zip(*packing.pack(signs, nodes), strict=True))
            names = ("range", "steps", "width", "nodes", "places")
            yield blank(schema, len(packed[0]), **{k: pa.array(v, schema.field(k).type) for k, v in zip(names, packed, strict=True)})
            if len(a):
                yield blank(schema, len(a), range=pa.array(-1 - (a % U(_SPREAD)).astype(np.int32)), a=pa.array(a.astype(np.int64)), b=pa.array(b.astype(np.int64)))

        for batch in slices(batches):
            sets = shingle_sets(texts(batch.column(2)), n, hashes)
            at, band = bands.of(sets.sizes)
            sums = sets.sums()
            nodes = nodes_of(sums[at], band)
            signed = signatures(sets, at, band, bands)
            offsets = np.searchsorted(at, np.arange(batch.num_rows + 1))
            held_by = pa.StructArray.from_arrays([pa.array(nodes.astype(np.int64)), pa.array(signed.cells, pa.binary())], fields=list(schema.field("own").type.value_type))
            own = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), held_by, type=schema.field("own").type)
            dealt += batch.num_rows
            where = -1 - (np.arange(dealt, dealt + batch.num_rows) % _SPREAD)
            yield blank(schema, batch.num_rows, range=pa.array(where, pa.int32()), key=batch.column(0), x=batch.column(1), n=pa.array(sets.sizes, pa.int64()), name=pa.array(sets.names(), pa.binary()), own=own)
            fresh = np.zeros(len(sums), bool)
            for i, s in enumerate(sums.tolist()):
                if s not in seen:
                    seen.add(s)
                    fresh[i] = True
            if len(seen) >= SEEN:
                seen.clear()
            kept = fresh[at][signed.owner]
            held.append((signed.signs[kept], nodes[signed.owner[kept]]))
            count += int(kept.sum())
            if count >= FLUSH:
                yield from flush()
                held, count = [], 0
        if count:
            yield from flush()

    return run


def _meet(packing: Packing, schema: pa.Schema):
    """Rows sorted by range: signatures as edges; the others are handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush():
            if len(held) > 1:  # within one block all signatures differ
                signs, nodes = (np.concatenate(c) for c in zip(*held, strict=True))
                _, _, a, b = _stars(signs, nodes)
                if len(a):
                    yield blank(schema, len(a), a=pa.array(a.astype(np.int64)), b=pa.array(b.astype(np.int64)))

        for batch in batches:
            blocks = np.flatnonzero(batch.column(0).to_numpy() >= 0)
            passed = batch.slice(0, blocks[0]) if len(blocks) else batch  # sorted: ranges below 0 come first
            if passed.num_rows:
                yield pa.RecordBatch.from_arrays([passed.column(f.name) for f in schema], schema=schema)
            for i in blocks.tolist():
                r, *packed = (batch.column(c)[i].as_py() for c in range(5))
                if r != now:
                    yield from flush()
                    now, held = r, []
                held.append(packing.unpack(r, *packed))
        yield from flush()

    return run


class Labels:
    """Which sets are joined already, and the edges that joined them."""

    def __init__(self, names: list[bytes]) -> None:
        self.names, self.label, self.found = names, np.arange(len(names)), []

    def join(self, i: int, j: int, told: bool = True) -> None:
        """told: whether the edge is one to hand on, or is handed on by another task."""
        self.label[self.label == self.label[j]] = self.label[i]
        if told:
            self.found.append((self.names[i], self.names[j]))


def _near(labels: Labels, cells: np.ndarray, inside: np.ndarray, sizes: np.ndarray, low: int, k: int, bands: Bands, test, block: np.ndarray | None, within: bool) -> None:
    """Join sets of one band whose cells differ in k places or fewer, if test(i, j) agrees.

    cells: a row for each of the sets `inside`, which rise in size. Pairs that
    are joined are passed over; with two blocks only pairs within one are taken,
    whose edges another task hands on, or only pairs across. Up to MANY sets are compared with each other. Beyond, only those that share a
    subset of a part: linked sets share one that is not empty, unless both have
    too many empty ones, and those are compared with each other.
    """
    least = np.searchsorted(sizes, -(-sizes * bands.num // bands.den))

    def compare(j: int, rest: np.ndarray) -> None:
        rest = rest[(rest >= least[j]) & (labels.label[inside[rest]] != labels.label[inside[j]])]
        if block is not None:
            rest = rest[(block[rest] == block[j]) == within]
        if len(rest):
            for i in rest[np.count_nonzero(cells[rest] != cells[j], axis=1) <= k].tolist():
                if labels.label[inside[i]] != labels.label[inside[j]] and test(inside[i], inside[j]):
                    labels.join(inside[i], inside[j], not within)

    own = sizes >= low  # the larger set of a pair is in its own band
    if len(inside) <= MANY:
        for j in np.flatnonzero(own).tolist():
            compare(j, np.arange(j))
        return
    wide = cells.reshape(len(inside), -1, THIRDS).astype(np.uint16)
    bare = ((np.count_nonzero(wide, axis=2) <= 1).sum(axis=1) > bands._extra[int(np.searchsorted(bands.lows, low, "right")) - 1]).nonzero()[0]
    for at, j in enumerate(bare.tolist()):
        if own[j]:
            compare(j, bare[:at])
    for part in range(wide.shape[1]):
        for out in range(THIRDS):
            a, b = (wide[:, part, i] for i in range(THIRDS) if i != out)
            code = (a << 8) + b
            order = np.argsort(code, kind="stable")
            code = code[order]
            starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
                members = order[x:y]
                if y - x > 1 and code[x] and (labels.label[inside[members]] != labels.label[inside[members[0]]]).any():
                    for at in range(1, y - x):
                        if own[members[at]]:
                            compare(int(members[at]), members[:at])


def _passes(block: np.ndarray) -> list[tuple[np.ndarray | None, bool]]:
    """One pass over all pairs of a single block; of two blocks those within, so that few edges are found across, and then those."""
    return [(None, False)] if block.min() == block.max() else [(block, True), (block, False)]


def _refined(names: list[bytes], cells: list[bytes], sizes: list[int], blocks: list[int], band: int, bands: Bands) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the sets of a band whose cells differ in k places or fewer."""
    order = sorted(range(len(names)), key=lambda i: (sizes[i], names[i]))
    labels = Labels([names[i] for i in order])
    table = np.frombuffer(b"".join(cells[i] for i in order), np.uint8).reshape(len(order), -1)
    block = np.array([blocks[i] for i in order])
    for mixed, within in _passes(block):
        _near(labels, table, np.arange(len(order)), np.array([sizes[i] for i in order]), bands.lows[band], bands.differences(band), bands, lambda i, j: True, mixed, within)
    return labels.found


def _links(names: list[bytes], own: list[np.ndarray], blocks: list[int], bands: Bands) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links between sets; pairs that are joined already are not tested.

    blocks: with two blocks, only edges that join what is not joined within them.
    Most pairs fall by their cells; the rest are compared in full.
    """
    order = sorted(range(len(own)), key=lambda i: (len(own[i]), names[i]))
    own, block = [own[i] for i in order], np.array([blocks[i] for i in order])
    labels, sizes = Labels([names[i] for i in order]), np.array([len(s) for s in own])
    linked = lambda i, j: bands.linked(len(np.intersect1d(own[i], own[j], assume_unique=True)), int(sizes[i]), int(sizes[j]))
    if len(own) <= FEW:
        for mixed, within in _passes(block):
            for i, j in combinations(range(len(own)), 2):
                if labels.label[i] != labels.label[j] and (mixed is None or (block[i] == block[j]) == within) and linked(i, j):
                    labels.join(i, j, not within)
        return labels.found
    sets = Sets(np.concatenate(own), np.concatenate(([0], np.cumsum(sizes))))
    at, band = bands.of(sizes)
    for mixed, within in _passes(block):
        for b in np.unique(band).tolist():
            inside = at[band == b]
            if len(inside) > 1:
                cells = Cells.of(sets, inside, np.full(len(inside), bands.parts(b) * THIRDS)).told().reshape(len(inside), -1)
                _near(labels, cells, inside, sizes[inside], bands.lows[b], bands.differences(b), bands, linked, None if mixed is None else mixed[inside], within)
    return labels.found


def _by_task(keys: int, read, solve):
    """Rows sorted by task (the first `keys` columns, then block and name) as edges: solve(key, names, values, blocks) for each task.

    read(batch) gives a value for each row, from the columns after these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, values, blocks = None, [], [], []

        def flush():
            found = solve(key, names, values, blocks) if len(names) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.binary()) for i in (0, 1)], names=["a", "b"])

        for batch in slices(batches):
            told = read(batch)
            for k, block, name, value in zip(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True), batch.column(keys).to_pylist(), batch.column(keys + 1).to_pylist(), told, strict=True):
                if k != key:
                    yield flush()
                    key, names, values, blocks = k, [], [], []
                if not names or names[-1] != name:  # sorted by set: repeats follow each other
                    names.append(name)
                    values.append(value)
                    blocks.append(block)
        yield flush()

    return run


def _refine(bands: Bands):
    def solve(key, names, values, blocks):
        return _refined(names, [c for c, _ in values], [n for _, n in values], blocks, key[0] >> NODE_HASH, bands)

    return _by_task(3, lambda batch: list(zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True)), solve)


def _verify(n: int, bands: Bands):
    hashes = WordHashes()

    def read(batch: pa.RecordBatch) -> list[np.ndarray]:
        sets = shingle_sets(texts(batch.column(5)), n, hashes)
        return [sets.of(i) for i in range(batch.num_rows)]

    return _by_task(3, read, lambda key, names, values, blocks: _links(names, values, blocks, bands))


def _tasks(members: DataFrame, size: str, bound: int, sets: int, most: int) -> DataFrame:
    """members with i, j and block: a row for each pair of blocks of its cluster that it takes part in; a single block meets itself.

    Blocks are no larger than the bound; smaller clusters are cut into blocks of
    so many sets, at most so many of them.
    """
    held = members.groupBy(F.col("cluster").alias("_of")).agg(F.sum(F.expr(size)).alias("_all"), F.count(F.lit(1)).alias("_sets"))
    blocks = F.greatest(F.ceil(F.col("_all") / bound), F.least(F.ceil(F.col("_sets") / sets), F.lit(most)), F.lit(1))
    members = members.join(held, F.col("cluster") == F.col("_of")).withColumn("_blocks", blocks.cast("int")).drop("_sets")
    members = members.withColumn("block", F.pmod(F.xxhash64("name"), F.col("_blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    return members.withColumn("_pair", F.explode(others)).select("*", "_pair.i", "_pair.j").drop("_of", "_all", "_blocks", "_pair")


def jaccard_components(
    docs: DataFrame,
    words: int = 5,
    num: int = 4,
    den: int = 5,
    key: str = "doc_id",
    text: str = "text",
    carry: bool = True,
    block_shingles: int = BLOCK_SHINGLES,
    block_bytes: int = BLOCK_BYTES,
    block_sets: int = BLOCK_SETS,
) -> DataFrame:
    """Adds n_shingles and component_id to every document.

    Two documents are linked if the Jaccard similarity of their sets of shingles
    of so many words is num/den or more; component_id is the least key that is
    reachable by links. Documents with equal sets are linked. Null and wordless
    texts have no shingles, are linked with nothing and keep their own key. Null
    keys are passed over in the minimum; a component of null keys has a null id.
    Repeated rows each get the same result. Input columns named like an output
    are replaced. Without rows the result is empty. carry=False returns the key
    and the new columns alone.

    Links are found exactly, whatever the size of a group: 64-bit ids serve only
    to find candidates, and sets are compared in full.
    """
    docs = without(docs, "n_shingles", "component_id")
    bands = Bands(num, den)
    spare = [f"_c{i}" for i in range(len(docs.columns))]  # names that no operator's own column has
    key_col, text_col = spare[docs.columns.index(key)], spare[docs.columns.index(text)]
    rows = docs.toDF(*spare)
    narrow = rows.select(F.col(key_col).alias("key"), F.xxhash64(text_col).alias("x"), F.col(text_col).alias("text"))
    packing = Packing.for_bytes(rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)

    moved = T.StructType([*T.StructType.fromDDL(_MOVED).fields, T.StructField("key", narrow.schema["key"].dataType)])
    met = T.StructType([f for f in moved.fields if f.name in ("a", "b", "x", "n", "name", "own", "key")])
    signed = narrow.mapInArrow(lean(_sign(words, bands, packing, _arrow(moved))), moved)
    told = save(signed.repartition("range").sortWithinPartitions("range").mapInArrow(lean(_meet(packing, _arrow(met))), met), "ngram-told")
    sets = told.where("a is null").select("key", "x", "n", "name", "own")
    clusters = save(components(told.where("a is not null").select("a", "b")), "ngram-clusters")

    # The sets of each cluster, once each, with their cells; copies are combined before the shuffle.
    spread = sets.select("name", "n", F.explode("own").alias("own")).join(clusters, F.col("own.node") == F.col("node"))
    members = spread.groupBy(F.col("root").alias("cluster"), "name", "n").agg(F.min("own.cells").alias("cells"))
    members = save(members, "ngram-members")
    tasks = _tasks(members, "octet_length(cells)", block_bytes, block_sets, MOST_BLOCKS).select("cluster", "i", "j", "block", "name", "cells", "n")
    tasks = tasks.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "name")
    edges = save(tasks.mapInArrow(lean(_refine(bands)), "a binary, b binary"), "ngram-edges")  # so that no task has two Python workers
    near = save(components(edges), "ngram-near")
    spent(clusters, members, edges)

    # The text of one document of each set that is left. Always by a sort-merge join: both sides grow with the corpus.
    one = sets.where("name is not null").groupBy("name").agg(F.min(F.struct("x", "key")).alias("of"), F.min("n").alias("n"), F.min("key").alias("least"))
    wanted = one.select(F.col("of.key").alias("_key"), F.col("of.x").alias("_x"), "name", "n").join(near, F.col("name") == F.col("node"))
    wanted = _tasks(wanted.select("_key", "_x", "name", "n", F.col("root").alias("cluster")), "n", block_shingles, block_sets, MOST_BLOCKS // 2)
    found = narrow.join(wanted.hint("merge"), (F.col("x") == F.col("_x")) & F.col("key").eqNullSafe(F.col("_key"))).select("cluster", "i", "j", "block", "name", "text")
    found = found.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "name")
    links = save(found.mapInArrow(lean(_verify(words, bands)), "a binary, b binary"), "ngram-links")

    # By sets first, so that copies of one text are counted before they meet.
    roots = components(links).select(F.col("node").alias("_linked"), F.col("root").alias("_root"))
    of_set = one.join(roots, F.col("name") == F.col("_linked"), "left").select(F.col("name").alias("_name"), "least", F.coalesce("_root", "name").alias("_group"))
    least = of_set.groupBy(F.col("_group").alias("_of")).agg(F.min("least").alias("_least"))
    of_set = of_set.join(least, F.col("_group") == F.col("_of")).select("_name", "_least")
    own = F.when(F.col("_name").isNull(), F.col("key")).otherwise(F.col("_least"))
    result = sets.join(of_set, F.col("name") == F.col("_name"), "left").select("key", "x", "n", own.alias("component"))
    if not carry:
        return result.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    # Rows with the same key and text have the same result.
    result = result.select(F.col("key").alias("_key"), F.col("x").alias("_x"), "n", "component").distinct()
    result = rows.join(result, (F.xxhash64(text_col) == F.col("_x")) & F.col(key_col).eqNullSafe(F.col("_key")))
    kept = zip(spare, docs.columns, strict=True)
    return result.select(*[F.col(s).alias(c) for s, c in kept], F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
