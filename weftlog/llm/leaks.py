"""Documents that contain passages of held-out evaluation items."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from operator import ne

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.functions.columns import col
from weftlog.llm.cues import folded, lost_letters, spoken

GRAM = 12  # characters of a fingerprint
WINDOW = 12  # grams of which the least is kept: spans of GRAM + WINDOW - 1 sound characters are always found
BREAK = "\x01"  # between texts; in no gram of an item
BASE = np.uint64(0x9E3779B97F4A7C15)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
MARGIN = 64  # empty places before and after all texts
ANY, SOUND, LOSSY = range(3)  # the documents that a form of an item is for


def _mixed(points: np.ndarray) -> np.ndarray:
    h = points.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0x94D049BB133111EB)


def gram_keys(points: np.ndarray) -> np.ndarray:
    """A 64-bit key of the ``GRAM`` characters from each position on (by doubling, not by character)."""
    if len(points) < GRAM:
        return np.empty(0, dtype=np.uint64)
    h1 = _mixed(points)
    power = [np.uint64(pow(int(BASE), k, 1 << 64)) for k in range(9)]
    h2 = h1[:-1] * power[1] + h1[1:]
    h4 = h2[:-2] * power[2] + h2[2:]
    h8 = h4[:-4] * power[4] + h4[4:]
    key = h8[:-4] * power[4] + h4[8:]
    return key ^ (key >> np.uint64(31))


def _least_of_windows(order: np.ndarray) -> np.ndarray:
    """Which positions hold the least value of some window of ``WINDOW`` values."""
    n = len(order)
    if n <= WINDOW:
        return order == order.min() if n else np.empty(0, dtype=bool)

    def slide(x: np.ndarray, least) -> np.ndarray:
        span = 1
        while span * 2 <= WINDOW:
            x = least(x[:-span], x[span:])
            span *= 2
        rest = WINDOW - span
        return least(x[:-rest], x[rest:]) if rest else x

    low = slide(order, np.minimum)
    edge = np.zeros(WINDOW - 1, dtype=np.uint64)
    return slide(np.r_[edge, low, edge], np.maximum) == order


class Fingerprints:
    """The winnowed fingerprints of a block of evaluation items.

    The order by which windows choose their least gram puts grams of few items
    first; it is the same for items and documents, so what a shared span
    chooses, it chooses on both sides, and phrases that every item uses are
    rarely chosen at all.
    """

    def __init__(self, items: list[tuple[int, str]], words: int):
        full = [(item, text) for item, text in items if text]
        both = [(item, folded(text), folded(text, lossy=True)) for item, text in full]
        # An item is kept a second time, as texts that lost letters have it, where that differs.
        kept = [(item, sound, ANY if sound == lossy else SOUND) for item, sound, lossy in both] + [(item, lossy, LOSSY) for item, sound, lossy in both if sound != lossy]
        texts = [(item, w if len(w) >= words else []) for item, w in ((item, text.split(" ")) for item, text, _ in kept)]
        self.loss = np.array([how for _, _, how in kept], dtype=np.int8)
        self.items = np.array([item for item, _ in texts], dtype=np.int64)
        self.words = [w for _, w in texts]
        joined = BREAK.join("".join(w) for w in self.words) + BREAK
        self.points = np.r_[np.zeros(MARGIN, np.uint32), np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32), np.zeros(2 * MARGIN, np.uint32)]
        lengths = np.array([sum(map(len, w)) for w in self.words], dtype=np.int64)
        self.begin = MARGIN + np.r_[0, np.cumsum(lengths + 1)[:-1]] if len(texts) else np.empty(0, np.int64)
        # Where all words begin, and where the last of each item ends.
        self.starts = np.concatenate([b + np.cumsum([0, *map(len, w)]) for b, w in zip(self.begin, self.words)]) if len(texts) else np.empty(0, np.int64)
        self.first = np.r_[0, np.cumsum([len(w) + 1 for w in self.words])[:-1]] if len(texts) else np.empty(0, np.int64)
        keys = gram_keys(self.points)
        # All grams that lie inside one item, and whose they are.
        n_grams = np.maximum(lengths - GRAM + 1, 0)
        owner = np.repeat(np.arange(len(texts)), n_grams)
        at = np.repeat(self.begin - np.cumsum(n_grams) + n_grams, n_grams) + np.arange(len(owner))
        by_key = np.lexsort((self.items[owner], keys[at]))
        key, item = keys[at][by_key], self.items[owner][by_key]
        fresh = np.diff(key, prepend=~key[:1]) != 0
        pair = fresh | (np.diff(item, prepend=item[:1]) != 0)
        self.known = key[fresh]
        shared = np.add.reduceat(pair.astype(np.int64), np.flatnonzero(fresh)) if len(key) else np.empty(0, np.int64)
        self.order = np.minimum(shared, 0xFFFE).astype(np.uint64) << np.uint64(48) | self.known >> np.uint64(16)
        self.sieve = np.zeros(1 << 22, dtype=bool)
        self.sieve[self.known >> np.uint64(42)] = True
        ranked = self.ranked(keys)[at]
        picked = np.concatenate([_least_of_windows(part) for part in np.split(ranked, np.cumsum(n_grams)[:-1])]) if len(texts) else np.empty(0, bool)
        at, owner = at[picked], owner[picked]
        by_key = np.argsort(keys[at], kind="stable")
        self.pick_at, self.pick_owner = at[by_key], owner[by_key]
        self.pick_keys = keys[self.pick_at]

    def ranked(self, keys: np.ndarray) -> np.ndarray:
        """The place of each gram in the choosing order; grams of no item come last."""
        out = np.full(len(keys), NONE)
        maybe = np.flatnonzero(self.sieve[keys >> np.uint64(42)])
        if len(maybe) and len(self.known):
            place = np.minimum(np.searchsorted(self.known, keys[maybe]), len(self.known) - 1)
            hit = self.known[place] == keys[maybe]
            out[maybe[hit]] = self.order[place[hit]]
        return out


def _follow(solid: str, d: int, bounds: np.ndarray, words: list[str], w: int, step: int, seen: set[tuple[int, int]]) -> int:
    """How many successive item words, from word ``w`` on in direction ``step``, the document has from ``d`` on.

    ``solid`` has the document's characters without blanks. A word may differ
    by one character in five (none in short words), as damaged words do; the
    last one counted must end where a document word ends. The places where
    words of the item begin in the document are added to ``seen``.
    """
    n, matched = 0, 0
    while 0 <= w < len(words):
        word = words[w]
        size = len(word)
        if solid.startswith(word, d) if step > 0 else solid.endswith(word, 0, d):
            d += size * step
        else:
            taken = _damaged(solid, d, word, step)
            if not taken:
                break
            d += taken * step
        w, n = w + step, n + 1
        seen.add((w, d) if step > 0 else (w + 1, d))
        if bounds[d]:
            matched = n
    return matched


def _damaged(solid: str, d: int, word: str, step: int) -> int:
    """How many characters from ``d`` on are the damaged word, 0 if none are."""
    size = len(word)
    allowed = 0 if size < 5 else 1 if size < 10 else 2
    if not allowed:
        return 0
    text = solid[d : d + size + 1] if step > 0 else solid[max(0, d - size - 1) : d]
    same, longer, shorter = (text[:size], text, text[: size - 1]) if step > 0 else (text[-size:], text, text[1 - size :])
    cost = sum(map(ne, same, word)) if len(same) == size else size
    if 1 < cost:
        if len(longer) > size and _one_off(word, longer):
            return size + 1
        if len(shorter) == size - 1 and _one_off(shorter, word):
            return size - 1
    return size if cost <= allowed else 0


def _one_off(short: str, long: str) -> bool:
    """Whether one inserted character makes the texts, whose lengths differ by one, equal."""
    for i, (a, b) in enumerate(zip(short, long)):
        if a != b:
            return short[i:] == long[i + 1 :]
    return True


def _leaks_of(texts: list[str], prints: Fingerprints, least_words: int) -> list[tuple[int, int]]:
    """Pairs (index of text, item) of a batch."""
    if not len(prints.pick_keys):
        return []
    speech = [spoken(t) for t in texts]
    lost = [i for i, t in enumerate(texts) if lost_letters(t)]
    # Texts that lost letters somewhere stand there a second time, without all that may be lost.
    cleaned = [folded(t) for t in speech] + [folded(speech[i], lossy=True) for i in lost]
    spaced = np.frombuffer((BREAK.join(cleaned) + BREAK).encode("utf-32-le"), dtype=np.uint32)
    solid = spaced != 32
    bound_spaced = np.ones(len(spaced) + 1, dtype=bool)
    bound_spaced[1:-1] = (spaced[1:] == 1) | (spaced[:-1] == 1) | ~solid[:-1]
    points = np.r_[np.zeros(MARGIN, np.uint32), spaced[solid], np.zeros(2 * MARGIN, np.uint32)]
    bounds = np.ones(len(points) + 1, dtype=bool)
    bounds[MARGIN : MARGIN + int(solid.sum())] = bound_spaced[:-1][solid]
    ends = MARGIN + np.flatnonzero(spaced[solid] == 1)

    keys = gram_keys(points)
    order = prints.ranked(keys)
    at = np.flatnonzero((order != NONE) & _least_of_windows(order))
    lo = np.searchsorted(prints.pick_keys, keys[at], side="left")
    n = np.searchsorted(prints.pick_keys, keys[at], side="right") - lo
    at, lo = at[n > 0], lo[n > 0]
    n = n[n > 0]
    if not len(at):
        return []
    place = np.repeat(at, n)
    pick = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    form = np.searchsorted(ends, place)
    text = np.r_[np.arange(len(texts)), np.array(lost, dtype=np.int64)][form]
    owner, item_at = prints.pick_owner[pick], prints.pick_at[pick]
    how = prints.loss[owner]
    fits = (how == ANY) | (how == np.where(form < len(texts), SOUND, LOSSY))
    place, owner, item_at, text = place[fits], owner[fits], item_at[fits], text[fits]
    # The first word that begins at the hit or after it, and where it lies in the document.
    start = np.searchsorted(prints.starts, item_at)
    begins = place + prints.starts[start] - item_at
    _, once = np.unique(start * len(points) + begins, return_index=True)
    once = once[np.lexsort((begins[once], owner[once], text[once]))]
    word = start - prints.first[owner]
    solid_text = points.tobytes().decode("utf-32-le")
    found: set[tuple[int, int]] = set()
    last, seen = None, set()
    for d, w, o, t in zip(begins[once].tolist(), word[once].tolist(), owner[once].tolist(), text[once].tolist()):
        pair = (t, int(prints.items[o]))
        if pair in found:
            continue
        if last != (t, o):
            last, seen = (t, o), set()
        # A hit inside words that were counted around another one adds nothing.
        if (w, d) in seen:
            continue
        seen.add((w, d))
        total = _follow(solid_text, d, bounds, prints.words[o], w, 1, seen) + _follow(solid_text, d, bounds, prints.words[o], w - 1, -1, seen)
        if total >= least_words:
            found.add(pair)
    return list(found)


_PRINTS: dict[str, Fingerprints] = {}


def _finder(name: str, block, words: int):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _PRINTS:
            _PRINTS.clear()  # a worker keeps the fingerprints of one block
            _PRINTS[name] = Fingerprints(block.value, words)
        for batch in batches:
            ids, texts = batch["doc_id"].to_numpy(), batch["text"].tolist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= 1 << 20):
                    size += len(texts[hi])
                    hi += 1
                pairs = _leaks_of(texts[lo:hi], _PRINTS[name], words)
                yield pd.DataFrame({"doc_id": ids[[lo + t for t, _ in pairs]] if pairs else np.empty(0, np.int64), "item_id": np.array([i for _, i in pairs], dtype=np.int64)})
                lo = hi

    return find


def leaked_items(documents: DataFrame, items: DataFrame, words: int = 10, block: int = 5_000_000) -> DataFrame:
    """Documents that contain at least ``words`` successive words of an item: ``doc_id, item_id``.

    Winnowing: texts are folded (wrong encodings undone; case, accents,
    punctuation, cue marks, markup and sound descriptions dropped; characters
    that recognition confuses made equal; blanks dropped). Texts whose
    encoding lost letters somewhere are matched as they are and also without
    all letters that may be lost. Of every
    ``WINDOW`` neighbouring grams of ``GRAM`` characters the least is a
    fingerprint, so every sound shared span of ``GRAM + WINDOW - 1``
    characters has one in common. Documents are scanned where they lie,
    against the fingerprints of the items, every hit that is not inside words
    already counted is extended both ways, and the successive words of the
    item around it are counted, a damaged word counting as what it was.

    Items go to the tasks as broadcasts of about ``block`` characters (some
    ten thousand items), a stated query set against all documents: one scan
    of the corpus for each block, whatever the corpus holds.

    Defined cases: null or empty texts and items with fewer words leak
    nothing; repeated rows give one row; texts are taken whole; empty tables
    give no rows; extra columns are not read.
    """
    rows = documents.select(col("doc_id").cast("long").alias("doc_id"), col("text").cast("string").alias("text")).where("text is not null and text != ''")
    wanted = items.select(col("item_id").cast("long").alias("item_id"), col("item_text").cast("string").alias("item_text")).where("item_text is not null and item_text != ''").distinct()
    total = wanted.agg(F.coalesce(F.sum(F.length("item_text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // block))
    context = documents.sparkSession.sparkContext
    out = None
    for b in range(n_blocks):
        part = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).orderBy("item_id", "item_text")
        shared = context.broadcast([(r["item_id"], r["item_text"]) for r in part.collect()])
        hits = rows.mapInPandas(_finder(uuid.uuid4().hex, shared, words), "doc_id long, item_id long")
        out = hits if out is None else out.unionByName(hits)
    return out.distinct()
