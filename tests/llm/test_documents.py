"""Operators on documents, against brute force."""

from __future__ import annotations

import hashlib
import json
import random
import re
import struct
from collections import Counter, defaultdict

import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestream.llm import bpe, components, exact_dedup, mixing, ngram_join, substring_dedup
from lodestream.llm.words import Memo
from pyspark.sql import functions as F
from tests.llm.conftest import ROWS
from tokenizers import Tokenizer

SPACE = re.compile("[\x20\x09-\x0d]+")


def words(text):
    return (text or "").encode().split()


# exact dedup


def expected_dedup(rows):
    groups = defaultdict(list)
    for i, (key, text, *_) in enumerate(rows):
        groups[SPACE.sub(" ", text or "")].append((key is None, key or 0, i, key))
    out = []
    for text, members in groups.items():
        keep = min(members)[3]
        out += [(m[3], keep, len(members), hashlib.sha256(text.encode()).hexdigest()) for m in members]
    return Counter(out), len(groups)


@pytest.mark.parametrize("options", [{}, {"first_digit": 1, "growth": 2, "broadcast_rows": 0}, {"first_digit": 3, "growth": 7}])
def test_exact_dedup(docs, options):
    got = exact_dedup.exact_dedup(docs, **options).collect()
    want, groups = expected_dedup(ROWS)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == groups
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got if r.doc_id not in (None, 11))


def test_exact_dedup_prefixes(spark):
    texts = ["a" * n for n in (1, 2, 2, 63, 64, 64, 65, 128, 128)] + ["a" * 64 + "b", "a" * 64 + "b"]
    rows = list(enumerate(texts))
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected_dedup(rows)[0]


def test_exact_dedup_clashes_and_empty(clashing, no_docs):
    got = exact_dedup.exact_dedup(clashing)
    assert got.columns == [c for c in clashing.columns if c != "KEEP_ID"] + ["keep_id", "group_size", "kept", "text_sha256"]
    assert got.count() == len(ROWS) and {r._c1 for r in got.collect()} == {3}
    assert exact_dedup.exact_dedup(no_docs).collect() == []


# n-gram join


def expected_components(rows, n, num, den):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    forest = components.Forest()
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                forest.join(b, a)
    least = {}
    for i, (key, *_) in enumerate(rows):
        root = forest.find(i)
        if key is not None:
            least[root] = min(least.get(root, key), key)
    return Counter((r[0], len(s), least.get(forest.find(i))) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(seed, groups=6, copies=8, length=60, edits=3):
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, length))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(edits)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(400)}"
            rows.append((len(rows) * 7 % 101 + 1000 * len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize(("n", "num", "den"), [(5, 4, 5), (4, 85, 100), (2, 1, 2)])
def test_jaccard_components(spark, n, num, den):
    rows = near_copies(n)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = expected_components(rows, n, num, den)
    for options in ({}, {"block_shingles": 60, "block_bytes": 100}, {"block_sets": 3}):
        got = ngram_join.jaccard_components(frame, n, num, den, **options).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


@pytest.mark.parametrize("held", [500_000, 700, 10])
def test_components_of_a_group_that_many_tasks_met(spark, monkeypatch, held):
    """Each of its nodes has an edge or so in the rounds, and not one from each task; results do not hang on how many edges a task holds."""
    rng = random.Random(5)
    edges = [(rng.randrange(i), i) for i in range(1, 120) if i % 40] * 24 + [(1000 + i, 1001 + i) for i in range(9)]
    rng.shuffle(edges)
    seen, stars = [], components._stars
    monkeypatch.setattr(components, "LOCAL_EDGES", held)
    monkeypatch.setattr(components, "_stars", lambda e, ends, large: seen.append(ends) or stars(e, ends, large))
    got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(24)).collect()
    forest = components.Forest()
    for a, b in edges:
        forest.join(a, b)
    assert Counter((r.node, r.root) for r in got) == Counter((x, forest.find(x)) for x in {n for edge in edges for n in edge})
    assert held < 700 or max(seen) <= 3 * len(got)


def test_jaccard_troubles(docs, clashing, no_docs):
    want = expected_components(ROWS, 4, 85, 100)
    got = ngram_join.jaccard_components(docs, 4, 85, 100, carry=False).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    got = ngram_join.jaccard_components(clashing, 4, 85, 100)
    assert got.columns == [*clashing.columns, "n_shingles", "component_id"] and got.count() == len(ROWS)
    assert ngram_join.jaccard_components(no_docs).collect() == []


def test_partenum_loses_no_link():
    """Sets at the similarity share a signature, whatever their sizes."""
    import numpy as np

    rng = np.random.default_rng(3)
    for num, den in ((4, 5), (85, 100), (1, 2)):
        bands = ngram_join.Bands(num, den)

        def signs(elements, bands=bands):
            sets = ngram_join.Sets(elements, np.array([0, len(elements)]))
            return ngram_join.signatures(sets, *bands.of(sets.sizes), bands).signs

        for size in (1, 2, 5, 6, 7, 11, 20, 57, 200, 1500):
            for _ in range(30):
                base = rng.integers(0, 2**64, size, dtype=np.uint64, endpoint=False)
                other = np.unique(np.concatenate((base[rng.random(size) > 0.08], rng.integers(0, 2**64, rng.integers(0, size // 8 + 1), dtype=np.uint64))))
                base = np.unique(base)
                both = len(np.intersect1d(base, other))
                if len(other) and bands.linked(both, len(base), len(other)) and both < max(len(base), len(other)):
                    assert len(np.intersect1d(signs(base), signs(other)))


def test_refinement_keeps_links(monkeypatch):
    """Sets that are linked stay together when only those with a common subset of a part are compared."""
    import numpy as np

    rng = np.random.default_rng(8)
    bands = ngram_join.Bands(4, 5)
    own = []
    for size in (4, 9, 40, 150):
        for _ in range(12):
            base = rng.integers(0, 2**64, size, dtype=np.uint64, endpoint=False)
            own += [np.unique(np.concatenate((base[rng.random(size) > 0.05], rng.integers(0, 2**64, size // 20, dtype=np.uint64)))) for _ in range(5)]
    names = [b"%04d" % i for i in range(len(own))]
    forest = lambda edges: {frozenset(g) for g in _groups(names, edges)}
    want = forest(ngram_join._links(names, own, [0] * len(own), bands))
    monkeypatch.setattr(ngram_join, "MANY", 1)
    assert forest(ngram_join._links(names, own, [0] * len(own), bands)) == want and max(map(len, want)) > 3
    halves = [i % 2 for i in range(len(own))]
    parts = [ngram_join._links([n for n, h in zip(names, halves, strict=True) if h == side], [s for s, h in zip(own, halves, strict=True) if h == side], [side] * halves.count(side), bands) for side in (0, 1)]
    assert forest([*parts[0], *parts[1], *ngram_join._links(names, own, halves, bands)]) == want


def _groups(names, edges):
    forest = components.Forest()
    for n in names:
        forest.up.setdefault(n, n)
    for a, b in edges:
        forest.join(a, b)
    out = defaultdict(set)
    for n in names:
        out[forest.find(n)].add(n)
    return out.values()


@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**48 - 1)), min_size=1, max_size=200, unique_by=lambda x: x[0]), st.integers(0, 10**12))
def test_packing(rows, size):
    """What is packed comes back, whatever the number of ranges."""
    import numpy as np

    packing = ngram_join.Packing.for_bytes(size)._replace(range_bits=min(6, ngram_join.Packing.for_bytes(size).range_bits))
    signs, first = np.unique(np.array([s for s, _ in rows], np.uint64) >> np.uint64(64 - packing.bits), return_index=True)
    nodes = np.array([v for _, v in rows], np.uint64)[first]
    back = [packing.unpack(*block) for block in packing.pack(signs, nodes)]
    assert np.array_equal(np.concatenate([s for s, _ in back]), signs) and np.array_equal(np.concatenate([v for _, v in back]), nodes)


def test_shingles_of_a_batch():
    """A batch of texts gives each text's own set."""
    batch = [(t or "").encode() for _, t, _ in ROWS]
    for n in (1, 4, 5):
        whole = ngram_join.shingle_sets(batch, n, ngram_join.WordHashes())
        for i, text in enumerate(batch):
            alone = ngram_join.shingle_sets([text], n, ngram_join.WordHashes())
            w = text.lower().split()
            assert whole.of(i).tolist() == alone.of(0).tolist() and len(whole.of(i)) == len({tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else ())


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(None, 3), (5, 5)]
    forest = components.Forest()
    for a, b in edges:
        if a is not None:
            forest.join(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(root == forest.find(node) for node, root in got.items())
    assert set(got) == {x for a, b in edges if a is not None and a != b for x in (a, b)}


# substring dedup


def expected_removal(rows, width):
    counts = Counter(tuple(w[i : i + width]) for _, t, *_ in rows for w in [words(t)] for i in range(len(w) - width + 1))
    out = []
    for key, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if counts[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((key, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"range_grams": 5, "cells_per_gram": 0.05}, {"gram": 1, "range_grams": 40, "hot_copies": 2}])
@pytest.mark.parametrize("width", [3, 13])
def test_remove_repeats(docs, spark, width, options):
    rng = random.Random(width)
    rows = ROWS + [(100 + i, " ".join(rng.choice("abc") for _ in range(rng.randrange(60)))) + ("s",) for i in range(12)] + [(200, "z " * 40, "s")]
    frame = spark.createDataFrame(rows, docs.schema)
    got = substring_dedup.remove_repeats(frame, width, **options).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == expected_removal(rows, width)


@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 6)), min_size=1, max_size=200), st.integers(0, 10**9))
def test_sketch_never_falls_short(rows, n):
    """What is packed comes back, and merged sketches estimate no gram below its count."""
    import numpy as np

    ranges = substring_dedup.Ranges.for_grams(n, 50_000_000, 8.0)
    grams = ranges.short(np.sort(np.array([g for g, _ in rows], np.uint64)))
    docs, ids = np.array([d for _, d in rows]), np.arange(14).reshape(7, 2)
    back = [ranges.unpack(*block) for block in ranges.pack(grams, docs, ids)]
    assert np.array_equal(np.concatenate([g for g, _, _ in back]), grams)
    assert np.array_equal(np.concatenate([own[place] for _, place, own in back]), ids[docs])
    for counters in (1, 7, 4000):
        sketch = substring_dedup.Sketch(counters)
        sketch.merge(grams[::2])
        sketch.merge(grams[1::2])
        for g, estimate in zip(grams.tolist(), sketch.estimates(grams).tolist(), strict=True):
            assert estimate >= min(int((grams == g).sum()), 255)


def test_remove_repeats_clashes_and_empty(clashing, no_docs):
    got = substring_dedup.remove_repeats(clashing, 4)
    assert got.columns == [*clashing.columns, "n_words", "n_removed", "kept_text"] and got.count() == len(ROWS)
    assert substring_dedup.remove_repeats(no_docs).collect() == []


# mixing


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(40))), f"s{rng.randrange(5)}" if i % 2 else "s0") for i in range(600)] + [(900, "a b", None), (901, None, "s1"), (902, "x y z", "tiny")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = {"schedules": [[(0, 1.5), (1, 0.5)], 2.0, [(0, 1.5), (0.5, 3), (1, 4.5)]]}
    got = mixing.mix(frame, **options, carry=False, bucket_rows=20).collect()
    again = mixing.mix(frame, **options, bucket_rows=20).collect()
    assert {(r.doc_id, r.taken, tuple(r.positions)) for r in got} == {(r.doc_id, r.taken, tuple(r.positions)) for r in again}
    size, taken, longest, target = Counter(), Counter(), Counter(), {}
    by = {k: (t, s) for k, t, s in rows}
    for r in got:
        t, s = by[r.doc_id]
        assert r.size == len(words(t)) and r.taken == r.size * len(r.positions) and len(r.positions) <= 3
        assert all(0 <= p <= 1 for p in r.positions) and sorted(r.positions) == r.positions
        size[s] += r.size
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
        target[s] = r.target
    assert all(r.source_size == size[by[r.doc_id][1]] for r in got)
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    want, free, left = {}, set(order), float(sum(size.values()))
    while True:  # the excess of the capped ones is dealt again by weight
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 3 * size[s] <= level * weight[s]}
        if not full:
            break
        want |= {s: 3.0 * size[s] for s in full}
        left -= sum(3.0 * size[s] for s in full)
        free -= full
    want |= {s: level * weight[s] for s in free}
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in order)
    places = [r.positions[0] if r.positions else 2.0 for r in got]
    assert places == sorted(places)


def test_mix_schedule_and_emit(spark):
    """With a rising schedule the first quarter of the time holds less than a quarter of the tokens."""
    frame = spark.createDataFrame([(i, "w " * 10, "a") for i in range(400)], "doc_id long, text string, source string")
    mixed = mixing.mix(frame, [[(0, 0), (1, 2)]])
    stream = mixing.emit(mixed)
    assert stream.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken", "position"]
    places = [r.position for r in stream.collect()]
    assert len(places) == 400 and places == sorted(places)
    assert sum(p < 0.25 for p in places) == pytest.approx(400 / 16, abs=3)


def test_mix_of_every_document(spark):
    """Each document's positions against prefix sums in plain order and an integral taken in small steps."""
    import numpy as np

    rng = random.Random(4)
    rows = [(i // 2 * 2, " ".join("w" for _ in range(rng.randrange(30))), rng.choice(["a", "b", "b", "c", None])) for i in range(300)] + [(1, "same text", "a")] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    schedules = [[(0.1, 0.2), (0.4, 2), (0.4, 0.5), (0.9, 0.0)], [(0, 1), (1, 3)]]
    got = mixing.mix(frame, schedules, 2.0, bucket_rows=7).collect()
    assert len(got) == len(rows)
    hashes = {(r.doc_id, r.text): r.h for r in frame.select("doc_id", "text", F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id", "text"), 1).alias("h")).collect()}
    grid = np.linspace(0, 1, 200_001)
    weight = lambda s: np.interp(grid, *zip(*s, strict=True)) if s is not schedules[0] else np.where(grid < 0.4, np.interp(grid, [0.1, 0.4], [0.2, 2]), np.interp(grid, [0.4, 0.9], [0.5, 0.0]))
    cumulative = [np.concatenate(([0], np.cumsum((w[1:] + w[:-1]) / 2))) / (len(grid) - 1) for w in map(weight, schedules)]
    assert [mixing.weight_of(s) for s in schedules] == pytest.approx([c[-1] for c in cumulative], abs=1e-4)
    order = ["a", "b", "c", None]
    for i, source in enumerate(order):
        c = cumulative[i % 2]
        mine = sorted((r for r in got if r.source == source), key=lambda r: hashes[r.doc_id, r.text])
        whole, at, want = sum(r.size for r in mine), 0, defaultdict(list)
        for r in mine:
            middle = at + r.size / 2
            places = [] if not r.size else [np.interp((middle + k * whole) / r.target * c[-1], c, grid) for k in range(2) if middle + k * whole < r.target]
            want[r.doc_id, r.text].append(places)
            at += r.size
        have = defaultdict(list)
        for r in mine:
            assert r.source_size == whole and r.taken == r.size * len(r.positions)
            have[r.doc_id, r.text].append(r.positions)
        assert have.keys() == want.keys()
        for k in want:  # repeated rows are interchangeable
            for a, b in zip(sorted(have[k]), sorted(want[k]), strict=True):
                assert a == pytest.approx(b, abs=2e-3)


def test_mix_troubles(docs, clashing, no_docs):
    got = mixing.mix(docs, [1.0, 2.0, 3.0]).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 3 * r.size for r in got)
    mixed = mixing.mix(clashing, [1.0, 2.0, 3.0])
    assert mixed.columns == [c for c in clashing.columns if c not in ("size", "target")] + ["size", "source_size", "target", "taken", "positions"]
    assert mixed.count() == len(ROWS)
    assert mixing.emit(mixed).count() > 0
    assert mixing.mix(no_docs, [1.0, 2.0]).collect() == [] and mixing.mix(no_docs, [1.0], carry=False).collect() == []


# BPE

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as _f:
    OWN = bpe.load(_f.read())


def both_ways(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    packed = OWN.encode(text)
    assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == ids
    assert OWN.decode(packed) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text() | st.lists(st.sampled_from(["'s", "the", "ing", "<|endoftext|>", "<|startoftext|>", "Σ", "σ", "é", "é", " ", "\x1c", "\x85", " ", "aaa", "lll", "123", "$$", "꟏", "Ᲊ"])).map("".join))
def test_bpe_as_the_library(text):
    both_ways(text)


def test_bpe_words():
    for word in ["a" * 3000, "the" * 999, "loveliness", "abcdefghijklmnopqrstuvwxyz" * 40, "日本語" * 50, "مرحبا", "💩🏽"]:
        both_ways(word)


def test_memo_keeps_what_is_asked_for_again():
    made = []
    memo = Memo(lambda w: made.append(w) or w.upper(), 3, 6)
    for i in range(50):
        assert memo["the"] == "THE" and memo[f"w{i}"] == f"W{i}" and memo["lengthy"] == "LENGTHY"
        assert len(memo) <= 3 and len(memo.old) <= 3
    assert made.count("the") == 1 and made.count("lengthy") == 50


def test_bpe_with_full_caches(monkeypatch):
    for name in ("CACHE_WORDS", "CACHE_CHUNKS", "CACHE_PAIRS"):
        monkeypatch.setattr(bpe, name, 2)
    with open(PATH, encoding="utf-8") as f:
        own = bpe.Bpe(json.loads(f.read()))
    for text in [t or "" for _, t, _ in ROWS] + ["the loveliness, of (the) loveliness! " * 9]:
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == struct.pack(f"<{len(ids)}I", *ids), text
    assert len(own.words) <= 2 and len(own.words.old) <= 2 and own.pairs <= 2


def test_bpe_frame(docs, clashing, no_docs):
    got = bpe.encode_decode(docs, PATH, carry=False).collect()
    want = Counter()
    for key, text, _ in ROWS:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        want[key, len(ids), struct.pack(f"<{len(ids)}I", *ids), LIBRARY.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in got) == want
    got = bpe.encode_decode(clashing, PATH)
    assert got.columns == [*clashing.columns, "n_tokens", "ids", "decoded"] and got.where(F.col("_c1") == 3).count() == len(ROWS)
    assert bpe.encode_decode(no_docs, PATH, decode=False).collect() == []
