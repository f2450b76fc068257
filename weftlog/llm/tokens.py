"""Token ids of a whole corpus under a public byte-level BPE, by an automaton compiled from its merges."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from weftlog.functions.columns import col

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

# The endings that the public pre-split pattern cuts off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3


class MergeAutomaton:
    """A deterministic automaton over tokens that accepts exactly the BPE encodings of words.

    States are the start and "the last token was t". At first every state has
    an arc for every byte. The merges then act in order, each by a gadget: the
    merge of a and b cuts the arc b from state a, then gives the arc ab to every
    state from which a and then b could be read; state ab begins as state b was
    just before. (Cutting first makes equal merges of one word act from the left.) The gadgets are kept sparse, as cuts and births
    in order; an arc of the final automaton is looked up once and then read
    from the transition table.
    """

    MOST_ARCS = 1_000_000  # of the transition table that are remembered

    def __init__(self, data: bytes):
        model = json.loads(data)["model"]
        to_byte = _byte_letters()
        self.ids = {bytes(to_byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in to_byte for c in token)}
        self.text = {i: t for t, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.born: dict[int, int] = {}  # merge number at which a token's arcs appear; bytes have none
        self.parts: dict[int, tuple[int, int]] = {}
        self.cut: dict[int, int] = {}  # (state, token) -> merge number that cut the arc
        self.table: dict[int, bool] = {}
        self.opening: set[int] = {self.ids[bytes([b])] for b in range(256) if bytes([b]) in self.ids}
        for number, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self._gadget(number, *(self.ids[bytes(to_byte[c] for c in part)] for part in (left, right)))

    def _gadget(self, number: int, a: int, b: int) -> None:
        made = self.ids[self.text[a] + self.text[b]]
        readable = a in self.opening and self._arc(a, b, number)
        self.cut[a << 20 | b] = number
        if made not in self.parts:
            self.parts[made], self.born[made] = (a, b), number
            if readable:
                self.opening.add(made)

    def _arc(self, state: int, token: int, now: int) -> bool:
        """Whether ``state`` has an arc ``token`` after the gadgets numbered below ``now``."""
        while True:
            if self.cut.get(state << 20 | token, now) < now:
                return False
            came_state, came_token = self.born.get(state, -1), self.born.get(token, -1)
            if came_state < 0 and came_token < 0:
                return True
            if came_state > came_token:
                state, now = self.parts[state][1], came_state
            else:
                token, now = self.parts[token][0], came_token + 1

    def encode(self, word: bytes) -> list[int]:
        """The ids of one pre-split word; every prefix has one accepted path, whose last arc is kept."""
        ids, table = self.ids, self.table
        if len(table) > self.MOST_ARCS:
            table.clear()
        if ids.get(word) in self.opening:
            return [ids[word]]
        arrived: list[int] = [-1]
        for end in range(1, len(word) + 1):
            for begin in range(max(0, end - self.longest), end):
                token = ids.get(word[begin:end])
                if token is None:
                    continue
                if begin == 0:
                    reads = token in self.opening
                else:
                    key = arrived[begin] << 20 | token
                    reads = table.get(key)
                    if reads is None:
                        reads = table[key] = self._arc(arrived[begin], token, 1 << 40)
                if reads:
                    arrived.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        out, end = [], len(word)
        while end:
            out.append(arrived[end])
            end -= len(self.text[arrived[end]])
        return out[::-1]

    def decode(self, ids) -> str:
        """The text whose encoding ``ids`` is: the labels of its arcs in a row."""
        return b"".join(self.text[int(i)] for i in ids).decode("utf-8", errors="replace")


# The bytes that stand for themselves in public byte-level vocabularies, first and last of each range.
SHOWN_BYTES = ((33, 126), (161, 172), (174, 255))


def _byte_letters() -> dict[str, int]:
    """The public letter for each byte: printable ones stand for themselves, the rest for letters from U+0100 on."""
    shown = [b for first, last in SHOWN_BYTES for b in range(first, last + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordTable:
    """Ids of the words met so far, found by 64-bit keys for whole arrays of words at once.

    A key only proposes a word: its letters are kept and compared with those
    of the text, and a word that shares another's key is looked up by itself.
    """

    SLOTS = 1 << 21
    MOST_LETTERS = 1 << 24  # kept of all words together

    def __init__(self, automaton: MergeAutomaton):
        self.automaton = automaton
        everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.kind = np.full(0x110000, OTHER, dtype=np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, everything):
                a, b = (p + (0x800 if p >= 0xD800 else 0) for p in m.span())
                self.kind[a:b] = kind
        rng = np.random.default_rng(20_240_517)
        self.mix = rng.integers(1, 1 << 63, 0x110000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(self.SLOTS, -1, dtype=np.int64)
        self.keys = np.zeros(1 << 12, dtype=np.uint64)
        self.at = np.zeros(1 << 12, dtype=np.int64)
        self.size = np.zeros(1 << 12, dtype=np.int64)
        self.pool = np.zeros(1 << 14, dtype=np.int32)
        self.letters = np.zeros(1 << 16, dtype=np.uint32)
        self.spelt_at = np.zeros(1 << 12, dtype=np.int64)
        self.length = np.zeros(1 << 12, dtype=np.int64)
        self.twins: dict[str, int] = {}  # words whose key another word has
        self.n = self.used = self.spelt = 0

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.base, dtype=np.uint64)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.inverse, dtype=np.uint64)])

    def starts(self, points: np.ndarray, ends_of_texts: np.ndarray) -> np.ndarray:
        """Where the words of the public pre-split pattern begin in texts that follow each other."""
        n = len(points)
        kind = self.kind[points]
        fresh = np.zeros(n + 1, dtype=bool)
        fresh[0] = True
        fresh[ends_of_texts] = True
        run = fresh[:n].copy()
        run[1:] |= kind[1:] != kind[:-1]
        begin = run.copy()
        space = kind == SPACE
        # The last white space before a word: a blank belongs to the word, anything else stands alone.
        last = np.zeros(n, dtype=bool)
        last[:-1] = space[:-1] & ~space[1:] & ~fresh[1:n]
        begin |= last
        blank = np.zeros(n, dtype=bool)
        blank[1:] = last[:-1] & (points[:-1] == 32)
        begin &= ~blank
        # Contractions: an apostrophe that begins a word and is followed by one of the endings.
        marks = np.flatnonzero((points == 39) & begin)
        if len(marks):
            padded = np.r_[points, np.zeros(3, points.dtype)]
            of_text = np.searchsorted(ends_of_texts, marks, side="right")
            left = ends_of_texts[of_text] - marks - 1
            for ending in CONTRACTIONS:
                size = len(ending)
                fits = (left >= size) & np.logical_and.reduce([padded[marks + 1 + i] == ord(c) for i, c in enumerate(ending)])
                p = marks[fits]
                begin[p + 1] = False
                after = p + 1 + size
                inside = after < n
                after = after[inside]
                begin[after[~fresh[after]]] |= True
        return begin

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each text."""
        joined = "".join(texts)
        counts = np.zeros(len(texts), dtype=np.int64)
        if not joined:
            return np.empty(0, dtype=np.int32), counts
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        n = len(points)
        ends = np.cumsum([len(t) for t in texts])
        begin = np.flatnonzero(self.starts(points, ends))
        stop = np.r_[begin[1:], n]
        self._powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.mix[points] * self.down[:n], out=sums[1:])
        keys = (sums[stop] - sums[begin]) * self.up[begin] + (stop - begin).astype(np.uint64)
        entry = self._find(keys)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            fresh, first = np.unique(keys[missing], return_index=True)
            for key, i in zip(fresh, missing[first]):
                self._insert(key, joined[begin[i] : stop[i]])
            entry[missing] = self._find(keys[missing])
        for i in np.flatnonzero(self._differs(entry, points, begin, stop)):
            word = joined[begin[i] : stop[i]]
            if word not in self.twins:
                self.twins[word] = self._store(word)
            entry[i] = self.twins[word]
        size = self.size[entry]
        before = np.cumsum(size) - size
        ids = self.pool[np.repeat(self.at[entry] - before, size) + np.arange(int(size.sum()))]
        words_before = np.searchsorted(begin, np.r_[0, ends])
        totals = np.r_[before, size.sum()]
        counts = np.diff(totals[words_before])
        if self.n > self.SLOTS // 3 or self.spelt > self.MOST_LETTERS:
            self.clear()  # bounded memory: start again rather than grow
        return ids, counts

    def _find(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys >> np.uint64(40)).astype(np.int64) & (self.SLOTS - 1)
        found = self.slots[slot]
        wrong = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (self.SLOTS - 1)
            found[wrong] = self.slots[slot[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.keys[found[wrong]] != keys[wrong])]
        return found

    def _differs(self, entry: np.ndarray, points: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Which words of a text, one after the other, are not the words of their entries."""
        size = stop - begin
        other = self.length[entry] != size
        shift = np.where(other, 0, self.spelt_at[entry]) - begin
        at = np.repeat(shift, size) + np.arange(len(points))
        return np.add.reduceat(self.letters[at % len(self.letters)] != points, begin) + other > 0

    def _insert(self, key: np.uint64, word: str) -> None:
        slot = int(key) >> 40 & (self.SLOTS - 1)
        while self.slots[slot] >= 0:
            slot = (slot + 1) & (self.SLOTS - 1)
        entry = self._store(word)
        self.slots[slot], self.keys[entry] = entry, key

    def _store(self, word: str) -> int:
        """Keep a word's letters and ids; returns its entry."""
        ids, letters = self.automaton.encode(word.encode()), np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32)
        if self.n == len(self.keys):
            self.keys, self.at, self.size, self.spelt_at, self.length = (np.resize(x, 2 * len(x)) for x in (self.keys, self.at, self.size, self.spelt_at, self.length))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        while self.spelt + len(letters) > len(self.letters):
            self.letters = np.resize(self.letters, 2 * len(self.letters))
        self.at[self.n], self.size[self.n], self.spelt_at[self.n], self.length[self.n] = self.used, len(ids), self.spelt, len(letters)
        self.pool[self.used : self.used + len(ids)] = ids
        self.letters[self.spelt : self.spelt + len(letters)] = letters
        self.n, self.used, self.spelt = self.n + 1, self.used + len(ids), self.spelt + len(letters)
        return self.n - 1


_TABLES: dict[str, WordTable] = {}


def word_table(data: bytes) -> WordTable:
    """The compiled automaton of a vocabulary file, one per worker process."""
    name = hashlib.sha1(data).hexdigest()
    if name not in _TABLES:
        _TABLES[name] = WordTable(MergeAutomaton(data))
    return _TABLES[name]


def _encoder(vocabulary, most_points: int = 1 << 20):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_table(vocabulary.value)
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, points = lo, 0
                while hi < len(texts) and (hi == lo or points + len(texts[hi]) <= most_points):
                    points += len(texts[hi])
                    hi += 1
                tokens, counts = words.encode(texts[lo:hi])
                offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), lists], names=["doc_id", "ids"])
                lo = hi

    return encode


def encode_corpus(documents: DataFrame, vocabulary_path: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Token ids of every document: ``doc_id`` and ``ids``, without special tokens.

    ``vocabulary_path`` names a byte-level BPE vocabulary file; it is read on
    the driver (its size is checked) and sent to the tasks, where its merges
    are compiled into a :class:`MergeAutomaton` once per worker. Texts are
    pre-split for whole Arrow batches by character classes, words are looked
    up by key and compared letter by letter, and only words new to the worker run through the automaton.
    There is no shuffle.

    Defined cases: null and empty texts give an empty list; special-token
    strings in a text are ordinary text; repeated rows each keep theirs; texts
    of any length are taken whole; an empty table gives no rows; extra columns
    are not read.
    """
    with open(vocabulary_path, "rb") as f:
        data = f.read((64 << 20) + 1)
    if len(data) > 64 << 20:
        raise ValueError("a vocabulary file of more than 64 MB is not broadcast")
    shared = documents.sparkSession.sparkContext.broadcast(data)
    rows = documents.select(col(id_column).cast("long").alias("doc_id"), col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(_encoder(shared), "doc_id long, ids array<int>")
