"""Toxicity: a lexicon trie met with Levenshtein automata, and context windows.

The lexicon is learned: words and stems that labelled toxic documents have and
others lack. Its trie and the automaton of one edit are walked together; the
states of the product are made deterministic as texts reach them, so a word
costs a table look-up per letter, spelled right or not. Each hit is weighed by
the window of words around it, where quotation marks and words of report speak
for quotation, words of address for abuse. A logistic model on the sums of a
document gives its score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.llm.labelled import SAMPLE_ROWS, logistic, sample, sigmoid
from lodestream.llm.scratch import save, without
from lodestream.llm.words import Memo, lean, slices

#: Toxic documents that an entry must be in, the share of its documents that must be toxic, letters of a stem, words that show
#: it, and letters of an entry that may be misspelled, unless the caller says.
LEAST_DOCS, LEAST_SHARE, STEMS, STEM_WORDS, EDITABLE = 4, 0.8, (3, 4, 5, 6, 7, 8), 4, 5
STEM_SHARE = 0.85
#: Letters of a learned entry that may be misspelled: all that are looked for.
LEARNED_LETTERS = 3
#: Entries that chance alone may bring, about exp(-SURE).
SURE = 1.0
#: Words on either side of a hit that make up its context.
WINDOW = 6
STATES = 100_000
#: Words in each of the two generations that a worker keeps, and their greatest length.
CACHE_WORDS, CACHE_LETTERS = 150_000, 64
#: Quotation marks, words of report and of address.
QUOTES = "\"“”„«»‹›"
REPORT = frozenset("said says wrote writes called quote quoted quotes cited citing according reported dit disait selon cité sagte sagt schrieb zitiert laut dijo dice escribió según citado".split())
ADDRESS = frozenset("you your youre yourself u tu toi vous vos votre du dich dir ihr euch tú vos usted ustedes te".split())
NOTHING = (0.0, 0.0)
#: What a misspelled hit weighs against one that is spelled right.
MISSPELLED = 0.8
#: Sum of log odds beyond which more hits tell nothing more.
MOST = 12.0
WORD = re.compile(r"[^\W\d_]+")


class Matcher:
    """Finds a word's best entry within one edit. Entries map a word, or a stem ending in *, to a weight."""

    def __init__(self, entries: dict[str, float], proper: frozenset[str] = frozenset(), letters: int = EDITABLE) -> None:
        """proper: words that are never taken for a misspelling; letters: the least length of an entry that may be misspelled."""
        self.proper, self.letters = proper, letters
        self.children: list[dict[str, int]] = [{}]
        self.whole: list[float] = [0.0]
        self.stem: list[float] = [0.0]
        self.depth: list[int] = [0]
        for entry, weight in entries.items():
            node = 0
            for c in entry.removesuffix("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.whole.append(0.0)
                    self.stem.append(0.0)
                    self.depth.append(self.depth[node] + 1)
                node = self.children[node][c]
            store = self.stem if entry.endswith("*") else self.whole
            store[node] = max(store[node], weight)
        self.known = Memo(self._of, CACHE_WORDS, CACHE_LETTERS)
        self._reset()

    def _reset(self) -> None:
        # A state is the set of (trie node, edits) that a prefix of a word can stand at.
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.value: list[tuple[float, float]] = []
        self.stemmed: list[float] = []
        self.start = self._state({(0, 0)})

    def _state(self, raw: set[tuple[int, int]]) -> int:
        closed = set(raw)
        for node, edits in raw:
            if edits == 0:  # a letter of the entry is left out
                closed.update((child, 1) for child in self.children[node].values())
        exact = {n for n, e in closed if e == 0}
        state = frozenset((n, e) for n, e in closed if e == 0 or n not in exact)
        if state not in self.states:
            self.states[state] = len(self.sets)
            self.sets.append(state)
            self.moves.append({})
            right = max((self.whole[n] for n, e in state if e == 0), default=0.0)
            wrong = max((self.whole[n] for n, e in state if e == 1 and self.depth[n] >= self.letters), default=0.0)
            self.value.append((right, 0.0 if right else wrong))
            self.stemmed.append(max((self.stem[n] for n, e in state if e == 0), default=0.0))
        return self.states[state]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, edits in self.sets[state]:
            if c in self.children[node]:
                out.add((self.children[node][c], edits))
            if edits == 0:
                out.add((node, 1))  # a letter too many
                out.update((child, 1) for child in self.children[node].values())  # another letter
        to = self.moves[state][c] = self._state(out) if out else -1
        return to

    def of(self, word: str) -> tuple[float, float]:
        """(weight spelled right, weight misspelled); zeros if nothing fits."""
        return self.known[word]

    def _of(self, word: str) -> tuple[float, float]:
        if len(self.sets) >= STATES:
            self._reset()
        state, stem = self.start, 0.0
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                break
            stem = max(stem, self.stemmed[state])
        right, wrong = self.value[state] if state >= 0 else (0.0, 0.0)
        right = max(right, stem)
        wrong = 0.0 if right or word in self.proper else wrong
        return (right, wrong) if right or wrong else NOTHING


def features(text: str, matcher: Matcher) -> list[float]:
    """What the hits of a text add up to: all (a misspelled one less), whether there are any, those in address, those quoted."""
    lower = text.lower()
    known = matcher.known
    weights = {w: found for w in set(WORD.findall(lower)) if len(w) > 2 and (found := known[w]) is not NOTHING}
    if not weights:
        return [0.0] * 4
    spans = list(WORD.finditer(lower))
    hits = [(i, weights[m[0]]) for i, m in enumerate(spans) if m[0] in weights]
    abuse = quoted = addressed = 0.0
    for i, (right, wrong) in hits:
        first, last = max(0, i - WINDOW), min(len(spans) - 1, i + WINDOW)
        around = {spans[j][0] for j in range(first, last + 1)}
        before, after = lower[spans[first].start() : spans[i].start()], lower[spans[i].end() : spans[last].end() + 2]
        weight = right or MISSPELLED * wrong
        if any(q in before for q in QUOTES) and any(q in after for q in QUOTES) or around & REPORT:
            quoted += weight
        else:
            abuse += weight
            addressed += weight * bool(around & ADDRESS)
    return [min(abuse, MOST), float(abuse > 0), min(addressed, MOST), min(quoted, MOST)]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, documents, toxic documents) of a partition."""
    docs, toxic = Counter(), Counter()
    for batch in slices(batches):
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            terms = {w for w in WORD.findall(text.lower()) if len(w) > 2}
            docs.update(terms)
            if label:
                toxic.update(terms)
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array(list(docs)), pa.array(list(docs.values()), pa.int64()), pa.array([toxic[t] for t in docs], pa.int64())], names=["term", "n", "toxic"])


def learn_lexicon(labelled: DataFrame) -> tuple[dict[str, float], frozenset[str]]:
    """Entries with weights from (_text, _label), and words near to an entry that clean documents use: words of the bounded sample."""
    words = labelled.mapInArrow(lean(_terms), "term string, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    words = save(words, "toxic-words")
    # Of so many words, some are in toxic documents alone by chance, unless there are enough of these.
    rate = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("_label").alias("toxic")).first()
    asked = words.where("n > 1").count()
    share = min(0.5, max(1e-6, (rate["toxic"] or 0) / max(1, rate["n"])))
    least = max(LEAST_DOCS, math.ceil((math.log(asked + 1) + SURE) / -math.log(share)))
    sure = (F.col("toxic") >= least) & (F.col("toxic") >= LEAST_SHARE * F.col("n"))
    ends = F.explode(F.array(*[F.when(F.length("term") > n, F.substring("term", 1, n)) for n in STEMS]))
    stems = words.select(ends.alias("stem"), "n", "toxic").where("stem is not null").groupBy("stem")
    stems = stems.agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"), F.count(F.when(F.col("toxic") > 0, 1)).alias("words"))
    # A stem is a sign of its own only if several words that begin with it are.
    stems = stems.where(sure & (F.col("toxic") >= STEM_SHARE * F.col("n")) & (F.col("words") >= STEM_WORDS)).select(F.concat("stem", F.lit("*")).alias("term"), "n", "toxic")
    found = words.where(sure).unionByName(stems)
    best = found.orderBy(F.col("toxic").desc(), "term").collect()
    # Words that a stem covers stay: only words are looked for with an edit.
    entries = {r["term"]: math.log((r["toxic"] + 0.5) / (r["n"] - r["toxic"] + 0.5)) for r in best}  # log odds
    near = words.where("n > toxic").select("term", "n").mapInArrow(lean(_near(entries)), "term string, n long")
    proper = near.orderBy("term").collect()
    return entries, frozenset(r["term"] for r in proper)


def matcher(entries: dict[str, float], proper: frozenset[str] = frozenset()) -> Matcher:
    return Matcher(entries, proper, LEARNED_LETTERS)


def _near(entries: dict[str, float]):
    """The words that would be taken for a misspelled entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = matcher(entries)
        for batch in batches:
            yield batch.filter(pa.array([own.of(w)[1] > 0 for w in batch.column(0).to_pylist()], pa.bool_()))

    return run


class Model:
    def __init__(self, entries: dict[str, float], proper: frozenset[str], weights: list[float]) -> None:
        self.entries, self.proper, self.weights = entries, proper, weights
        self._matcher: Matcher | None = None

    @property
    def matcher(self) -> Matcher:
        if self._matcher is None:
            self._matcher = matcher(self.entries, self.proper)
        return self._matcher

    def __getstate__(self):
        return self.entries, self.proper, self.weights

    def __setstate__(self, state) -> None:
        (self.entries, self.proper, self.weights), self._matcher = state, None

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([[1.0, *features(t, self.matcher)] for t in texts]).reshape(-1, len(self.weights))
        return sigmoid(x @ np.array(self.weights))


def _featured(entries: dict[str, float], proper: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = matcher(entries, proper)
        for batch in slices(batches):
            rows = [features(t, own) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    return run


def fit(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most `rows` labelled documents for which train (a condition on _key) holds.

    Of equal texts one counts, as toxic if one of its labels is. Without labelled
    documents the lexicon is empty and every score is low.
    """
    labelled = sample(docs, labels, "toxic", train, key, text, rows).groupBy("_text").agg(F.max("_label").alias("_label"))
    labelled = save(labelled, "toxic-sample")
    entries, proper = learn_lexicon(labelled)
    got = labelled.mapInArrow(lean(_featured(entries, proper)), "x array<double>, y int").collect()
    if not got:
        return Model({}, frozenset(), [-3.0] + [0.0] * 4)
    x, y = np.array([[1.0, *r["x"]] for r in got]), np.array([float(r["y"]) for r in got])
    used, weights = list(range(x.shape[1])), np.zeros(x.shape[1])
    while True:  # abuse never speaks for a text: a sign that would is left out
        found = logistic(x[:, used], y, 1e-4)
        against = [(w, i) for w, i in zip(found, used, strict=True) if i in (1, 2, 3) and w < 0]
        if not against:
            break
        used.remove(min(against)[1])
    weights[used] = found
    return Model(entries, proper, weights.tolist())


def score(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from the threshold on) to every document.

    Only the text counts. Null is as empty, and both score as a text without
    hits. Repeated rows get the same score. Input columns named like an output
    are replaced. Without rows the result is empty.
    """
    docs = without(docs, "score", "predicted")
    held = docs.sparkSession.sparkContext.broadcast(model)  # words of the bounded sample
    spare = [f"_c{i}" for i in range(len(docs.columns))]
    rows, text_col = docs.toDF(*spare), spare[docs.columns.index(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in slices(batches):
            found = own.scores([t or "" for t in batch.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "_score"])

    result = rows.mapInArrow(lean(run), T.StructType([*rows.schema.fields, T.StructField("_score", T.DoubleType())]))
    result = result.select(*[F.col(s).alias(c) for s, c in zip(spare, docs.columns, strict=True)], F.col("_score").alias("score"))
    return result.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
