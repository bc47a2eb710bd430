"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one token can come last in its encoding: a
token that ends there and is compatible with the last token of the prefix before
it. An automaton reports all tokens that end at a place; the compatibility test
decides between them; back-pointers then give the ids. The work is linear in
the length of a word, however long it is.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, normalizers, pre_tokenizers

from lodestream.llm.scratch import without
from lodestream.llm.words import Memo, lean, slices

#: Words and stretches in each of the two generations that a worker keeps, their greatest length, and pairs whose compatibility it keeps.
CACHE_WORDS, CACHE_CHUNKS, CACHE_LETTERS, CACHE_PAIRS = 150_000, 150_000, 64, 400_000
NEVER = 1 << 40


class Newer(Exception):
    """A text has a character that this interpreter's Unicode tables do not know."""


class Fits(dict):
    """Whether a token may follow another, by the one before, computed when it is first asked for."""

    __slots__ = ("bpe", "token")

    def __init__(self, bpe: Bpe, token: int) -> None:
        self.bpe, self.token = bpe, token

    def __missing__(self, before: int) -> bool:
        self.bpe.count_pair()
        fits = self[before] = self.bpe.apart(before, self.token)
        return fits


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: its own if it is printable Latin-1, else the next from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Bpe:
    """A byte-level BPE vocabulary with word ends, as a tokenizers file describes it."""

    def __init__(self, described: dict) -> None:
        model = described["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.names: dict[int, str] = {i: s for s, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.names |= {i: s for s, i in self.special.items()}
        ids = model["vocab"]
        # Places of a word's characters: the last one carries the word's end and is a letter of its own.
        self.rank: dict[int, int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            whole = ids[a + b]
            self.split[whole], self.rank[whole] = (ids[a], ids[b]), rank
            self.merge[ids[a], ids[b]] = (rank, whole)
        self.alphabet = byte_alphabet()
        self.spines: tuple[dict, dict] = ({}, {})
        self.fits: list[Fits] = []
        self.pairs = 0
        self.words, self.chunks = Memo(self._packed, CACHE_WORDS, CACHE_LETTERS), Memo(self.ids, CACHE_CHUNKS, CACHE_LETTERS)
        self.automaton = ahocorasick.Automaton()
        for s, i in ids.items():
            if (i not in self.split and len(s.removesuffix(self.end)) == 1) or (i in self.split and self.whole(i)):
                letters = self._letters(s.removesuffix(self.end), s.endswith(self.end) and bool(self.end) and s != self.end)
                self.fits.append(Fits(self, i))
                self.automaton.add_word(letters, (i, len(letters), self.fits[-1]))
        self.automaton.make_automaton()
        words = next(p["pattern"]["Regex"] for p in described["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.library_split = pre_tokenizers.Split(Regex(words), "removed", invert=True)
        self.library_form = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        known = regex.findall(r"\P{Cn}", "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000))
        self.newer = frozenset(c for c in known if unicodedata.category(c) == "Cn")
        self.pattern = regex.compile(words.replace(r"\s", r"\p{White_Space}"))
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def _letters(self, s: str, ends: bool) -> str:
        return s[:-1] + chr(ord(s[-1]) + 0x10000) if ends and self.end else s

    def whole(self, token: int) -> bool:
        """Whether the token's own letters are encoded as the token."""
        a, b = self.split[token]
        return self.apart(a, b, self.rank[token])

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces below a token along one side, each with the rank of what takes it."""
        found = self.spines[side].get(token)
        if found is None:
            found, t = [], token
            while t in self.split:
                found.append((self.split[t][side], self.rank[t]))
                t = found[-1][0]
            self.spines[side][token] = found
        return found

    def apart(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether no merge of a rank below `before` joins the end of a to the start of b.

        At the border stand the last piece of a and the first piece of b, as far
        as they are merged; a piece lasts until the merge that takes it into the
        next larger one. Two pieces that stand there together are joined if their
        merge comes before either of these. Equal merges act from the left.
        """
        right, left = self._spine(a, 1), self._spine(b, 0)
        right, left = [(a, before), *right], [(b, before), *left]
        i, j = len(right) - 1, len(left) - 1
        while i >= 0 and j >= 0:
            (x, x_taken), (y, y_taken) = right[i], left[j]
            met = self.merge.get((x, y))
            if met is not None and met[0] < x_taken and (met[0] < y_taken or (met[0] == y_taken and y_taken < before)):
                return False
            # the piece that is taken first gives way; with equal ranks the left one is first
            if x_taken <= y_taken:
                i -= 1
            else:
                j -= 1
        return True

    def word(self, letters: str) -> list[int]:
        """Ids of one word, its last letter marked as the end."""
        n = len(letters) + 1
        last, length = [-1] * n, [0] * n
        for end, (token, size, fits) in self.automaton.iter(letters):
            at = end + 1
            if last[at] >= 0:
                continue  # the one token is known; others that end here are not last
            if size < at:
                before = last[at - size]
                if before < 0 or not fits[before]:
                    continue
            last[at], length[at] = token, size
        out, at = [], len(letters)
        while at > 0:
            if last[at] < 0:
                at -= 1  # a letter that the vocabulary lacks
                continue
            out.append(last[at])
            at -= length[at]
        return out[::-1]

    def ids(self, chunk: str) -> bytes:
        """Packed ids of the words of a stretch of normalised text."""
        if not chunk.isascii() and not self.newer.isdisjoint(chunk):
            raise Newer
        return b"".join([self.words[w] for w in self.pattern.findall(chunk)])

    def _packed(self, word: str) -> bytes:
        """Packed ids of one word."""
        letters = word if word.isascii() and word.isprintable() else "".join([self.alphabet[b] for b in word.encode()])
        return array("I", self.word(self._letters(letters, True))).tobytes()

    def _plain(self, text: str) -> list[bytes]:
        raw, text = text, unicodedata.normalize("NFC", text)
        # letter by letter: the form of a letter does not depend on its neighbours
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        # No word crosses white space; str.split() cuts at four separators more than the pattern does.
        chunks = [text] if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        try:
            return list(map(self.chunks.__getitem__, chunks))
        except Newer:  # the library's own tables decide what is a letter, and its lower case
            return [self._packed(w) for w, _ in self.library_split.pre_tokenize_str(self.library_form.normalize_str(raw))]

    def encode(self, text: str) -> bytes:
        """Packed little-endian unsigned 32-bit ids."""
        if self.special_pattern is None or not self.special_pattern.search(text):
            return b"".join(self._plain(text))
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [*self._plain(text[at : m.start()]), array("I", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, *self._plain(text[at:])])

    def count_pair(self) -> None:
        """One more pair is kept; beyond the bound all that were are dropped first."""
        if self.pairs >= CACHE_PAIRS:
            self.pairs = 0
            for kept in (*self.fits, *self.spines):
                kept.clear()
        self.pairs += 1

    def decode(self, packed: bytes) -> str:
        """The tokens' names, special ones too, with a space between."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def load(described: str) -> Bpe:
    return Bpe(json.loads(described))


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", carry: bool = True, decode: bool = True) -> DataFrame:
    """Adds n_tokens, ids (packed little-endian unsigned 32-bit integers) and decoded to every document.

    path is a tokenizers file on the driver; its content is broadcast, a few MB
    whatever the corpus. Null counts as empty; an empty text has no ids and the
    decoded text "". Special tokens in a text are recognised as the library does.
    Every row is encoded for itself, repeated ones too. Input columns named like
    an output are replaced. carry=False returns the key and the new columns
    alone; decode=False leaves out decoded.
    """
    docs = without(docs, "n_tokens", "ids", *(["decoded"] if decode else []))
    with open(path, encoding="utf-8") as f:
        described = docs.sparkSession.sparkContext.broadcast(f.read())
    spare = [f"_c{i}" for i in range(len(docs.columns))]
    key_col, text_col = spare[docs.columns.index(key)], spare[docs.columns.index(text)]
    rows = docs.toDF(*spare)
    rows = rows if carry else rows.select(key_col, text_col)
    fields = [f for f in rows.schema.fields if carry or f.name == key_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(described.value)  # with the words that earlier tasks of this worker met
        for batch in slices(batches, 64):
            packed = [bpe.encode(t or "") for t in batch.column(text_col).to_pylist()]
            more = [pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())]
            more += [pa.array([bpe.decode(p) for p in packed], pa.string())] * decode
            old = batch if carry else batch.select([key_col])
            yield pa.RecordBatch.from_arrays([*old.columns, *more], names=[*old.schema.names, "_n", "_ids", "_decoded"][: len(old.columns) + len(more)])

    more = [T.StructField("_n", T.LongType()), T.StructField("_ids", T.BinaryType())] + [T.StructField("_decoded", T.StringType())] * decode
    result = rows.mapInArrow(lean(run), T.StructType([*fields, *more]))
    kept = list(zip(spare, docs.columns, strict=True)) if carry else [(key_col, key)]
    return result.select(*[F.col(s).alias(c) for s, c in kept], F.col("_n").alias("n_tokens"), F.col("_ids").alias("ids"), *([F.col("_decoded").alias("decoded")] if decode else []))
