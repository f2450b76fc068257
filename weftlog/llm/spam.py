"""Keyword-stuffed, link-list and product-list pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.functions.checkpoints import materialise
from weftlog.functions.columns import col
from weftlog.llm.cues import folded, speech_lines

LINK = re.compile(r"https?://|\bwww\.|[\w-]\.[a-z]{3,7}(?:[/)\]>]|\W*$)", re.ASCII)
TAG = re.compile(r"^\W{0,2}#\w{2,}")
MARK = re.compile(r"^\|+$|\w;$")
CODE = re.compile(r"^\W*(?:[A-Z]{1,3}-?\d{4,}|\d+[.,]\d\d|\d{3,4}p|\d+(?:kg|cm|mm|ml|l|w|g))\W*$", re.IGNORECASE)
SENTENCE_END = re.compile(r"[.?!…]\W*$")

#: Features of a page, in the order of the vector.
FEATURES = ("spam_share", "speech_share", "mean_score", "link_share", "tag_share", "mark_share", "code_share", "repeat_share", "top_word_share", "comma_share", "sentence_share", "token_length", "log_tokens")
NEAR = 4  # tokens on each side that decide what a token is part of
STRETCH = 8  # tokens in a row that stay in one half of a page
CLIP = 4.0
MOST_TOKENS = 250_000  # distinct tokens that a worker remembers
MOST_POINTS = 1 << 20  # characters that a worker looks at together (or one whole text)


class Tokens:
    """What is known of the distinct tokens that a worker has met: kind, length, and weight in a lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.keys: list[str] = []
        self.key_ids: dict[str, int] = {}
        self.table = np.empty((0, 8))

    def add(self, token: str) -> int:
        link, tag = bool(LINK.search(token)), bool(TAG.search(token))
        mark, code = bool(MARK.search(token)), bool(CODE.search(token))
        key = "" if link else folded(token).replace(" ", "")
        weight = self.lexicon.get(key, 0.0)
        if link or tag:
            weight = CLIP
        elif code or mark:
            weight = max(weight, 1.0)
        self.ids[token] = at = len(self.rows)
        self.rows.append((len(token), link, tag, mark, code, token.endswith(","), bool(SENTENCE_END.search(token)), weight))
        self.keys.append(key)
        return at

    def look_up(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all tokens in a row, and how many each text has."""
        if len(self.ids) > MOST_TOKENS:
            self.clear()
        ids, add = self.ids, self.add
        flat = [ids[t] if t in ids else add(t) for text in texts for t in text]
        if len(self.table) < len(self.rows):
            self.table = np.vstack([self.table, np.array(self.rows[len(self.table) :], dtype=float)])
        return np.array(flat, dtype=np.int64), np.array([len(t) for t in texts], dtype=np.int64)


def _around(values: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Sums over each token and its neighbours in the same text."""
    total = np.r_[0.0, np.cumsum(values)]
    begin = np.r_[0, ends[:-1]]
    at = np.arange(len(values))
    return total[np.minimum(at + NEAR + 1, ends[owner])] - total[np.maximum(at - NEAR, begin[owner])]


def _cleaned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts as their tokens without cue times and markup, single blanks between them."""
    for batch in _parts(batches):
        yield batch.assign(text=[" ".join(speech_lines(t).split()) for t in batch["text"]])


def _words(texts: list[str]) -> list[list[str]]:
    return [t.split(" ") if t else [] for t in texts]


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut into runs of whole texts, so that memory does not grow with the batch."""
    for batch in batches:
        if len(batch):
            total = batch["text"].str.len().cumsum()
            for _, part in batch.groupby((total // MOST_POINTS).to_numpy(), sort=False):
                yield part


def _lexicon_counter(lexicon: dict[str, float]):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """How often each word stands in spam-like and in speech-like surroundings."""
        tokens = Tokens(lexicon)
        for batch in _parts(batches):
            flat, lengths = tokens.look_up(_words(batch["text"].tolist()))
            if not len(flat):
                continue
            ends, owner = np.cumsum(lengths), np.repeat(np.arange(len(lengths)), lengths)
            weight = tokens.table[flat, 7]
            spam = _around(np.maximum(weight, 0), ends, owner) > _around(np.maximum(-weight, 0), ends, owner) + 1.5 * CLIP
            size = len(tokens.rows)
            s, h = np.bincount(flat[spam], minlength=size), np.bincount(flat[~spam], minlength=size)
            used = np.flatnonzero(s + h)
            yield pd.DataFrame({"key": [tokens.keys[i] for i in used], "n_spam": s[used], "n_speech": h[used]})

    return count


def spam_lexicon(cleaned: DataFrame, rounds: int = 3, one_in: int = 20_000) -> dict[str, float]:
    """Log-odds of words to stand among links, tags and listings rather than in speech.

    Grown from the marks alone (no word list): each round counts the words of
    all texts by what surrounds them under the last round's weights. Words below one in
    ``one_in`` of the tokens of either kind are left out, so at most
    ``2 * one_in`` words come to the driver and go to the tasks.
    """
    lexicon: dict[str, float] = {}
    for _ in range(rounds):
        counts = cleaned.mapInPandas(_lexicon_counter(lexicon), "key string, n_spam long, n_speech long").where("key != ''").groupBy("key").agg(F.sum("n_spam").alias("s"), F.sum("n_speech").alias("h"))
        counts = materialise(counts)
        total = counts.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("h"), F.lit(0))).first()
        if not total[0] or not total[1]:
            return lexicon
        kept = counts.where((F.col("s") * one_in > total[0]) | (F.col("h") * one_in > total[1])).where("s + h >= 5").collect()
        lexicon = {}
        for r in kept:
            odds = np.log((r["s"] + 0.5) / (total[0] + 1)) - np.log((r["h"] + 0.5) / (total[1] + 1))
            if abs(odds) > 0.5:
                lexicon[r["key"]] = float(np.clip(odds, -CLIP, CLIP))
    return lexicon


def _vectors(tokens: Tokens, texts: list[list[str]]) -> np.ndarray:
    """The features of texts, one row each."""
    flat, lengths = tokens.look_up(texts)
    n = len(lengths)
    ends, owner = np.cumsum(lengths), np.repeat(np.arange(n), lengths)
    info = tokens.table[flat] if len(flat) else np.empty((0, 8))
    size, weight = info[:, 0], info[:, 7]
    around = _around(weight, ends, owner) if len(flat) else weight

    def share(of: np.ndarray) -> np.ndarray:
        return np.bincount(owner, of * size, n) / np.maximum(np.bincount(owner, size, n), 1)

    def rate(of: np.ndarray) -> np.ndarray:
        return np.bincount(owner, of, n) / np.maximum(lengths, 1)

    pairs, often = np.unique(owner * np.int64(1 << 32) + flat, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, pairs >> 32, often)
    distinct = np.bincount(pairs >> 32, minlength=n)
    return np.stack(
        [share(around > 0), share(around < 0), rate(weight), share(info[:, 1]), share(info[:, 2]), rate(info[:, 3]), rate(info[:, 4]), 1 - distinct / np.maximum(lengths, 1), top / np.maximum(lengths, 1), rate(info[:, 5]), rate(info[:, 6]), rate(size), np.log1p(lengths)],
        axis=1,
    )


def _featurer(lexicon: dict[str, float]):
    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens(lexicon)
        for batch in _parts(batches):
            yield pd.DataFrame({"doc_id": batch["doc_id"], "host": batch["host"], "features": list(_vectors(tokens, _words(batch["text"].tolist())))})

    return features


def _halved(words: list[str]) -> tuple[list[str], list[str]]:
    """Every other stretch of ``STRETCH`` tokens, and the rest."""
    parts = [words[i : i + STRETCH] for i in range(0, len(words), STRETCH)]
    return [w for p in parts[::2] for w in p], [w for p in parts[1::2] for w in p]


def _labeller(lexicon: dict[str, float]):
    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Features of one half of each page, and as its weak label what the other half is."""
        tokens = Tokens(lexicon)
        for batch in _parts(batches):
            halves = [_halved(w) for w in _words(batch["text"].tolist())]
            seen, hidden = (_vectors(tokens, [h[i] for h in halves]) for i in (0, 1))
            frame = pd.DataFrame({"doc_id": batch["doc_id"], "features": list(seen), "label": (hidden[:, 0] > 0.5).astype(float)})
            yield frame[[bool(h[1]) for h in halves]]

    return label


def _fit(training: DataFrame, trees: int):
    """Bagged trees, or None where all labels are of one kind."""
    if training.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=6, featureSubsetStrategy="all", bootstrap=True, subsamplingRate=0.8, seed=11)
    return forest.fit(training.select(array_to_vector("features").alias("vector"), "label"))


def _cleaned_pages(documents: DataFrame) -> DataFrame:
    rows = documents.select(col("doc_id").cast("long").alias("doc_id"), F.coalesce(col("source").cast("string"), F.lit("")).alias("host"), col("text").cast("string").alias("text")).where("text is not null and text != ''")
    return materialise(rows.mapInPandas(_cleaned, "doc_id long, host string, text string"))


def _weakly_labelled(cleaned: DataFrame, lexicon: dict[str, float], sample_rows: int) -> DataFrame:
    """The pages whose hash is below the share of ``sample_rows``: ``doc_id, features, label``."""
    share = min(1.0, sample_rows / max(1, cleaned.count()))
    bound = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
    return materialise(cleaned.where(F.xxhash64("doc_id") <= F.lit(bound)).select("doc_id", "text").mapInPandas(_labeller(lexicon), "doc_id long, features array<double>, label double"))


def weak_label_accuracy(documents: DataFrame, sample_rows: int = 20_000, trees: int = 20) -> DataFrame:
    """How well hidden halves of pages held out from the fit are told from the seen ones: ``n, plain, forest``.

    ``plain`` is the share that the rule "more than half is spam" gets right
    from the seen half, ``forest`` the share that trees fitted on the other
    four fifths of the sample get right.
    """
    cleaned = _cleaned_pages(documents)
    pages = _weakly_labelled(cleaned, spam_lexicon(cleaned.select("text")), sample_rows)
    held = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(5)) == 0
    model = _fit(pages.where(~held), trees)
    if model is None:
        raise ValueError("all weak labels are of one kind")
    judged = model.transform(pages.where(held).select("features", "label", array_to_vector("features").alias("vector")))
    return judged.agg(F.count(F.lit(1)).alias("n"), F.avg(((F.col("features")[0] > 0.5).cast("double") == F.col("label")).cast("double")).alias("plain"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("forest"))


def spam_pages(documents: DataFrame, sample_rows: int = 20_000, trees: int = 20, host_weight: float = 0.25) -> DataFrame:
    """Documents more than half of whose text is keywords, links, tags or listings: ``doc_id`` with ``score``.

    1. Texts are cleaned once, and a lexicon is grown from links, tags and
       listing marks over all documents.
    2. About ``sample_rows`` documents (chosen by a hash of the id; all where
       there are fewer) are cut into two halves, every other stretch of
       ``STRETCH`` tokens. Whether more than half of the hidden half is such
       text is the weak label of the seen half, whose content and link
       features bagged decision trees are fitted to: no label is a function of
       the features beside it.
    3. Every document is scored, whole text, in one pass without a shuffle.
    4. The spam rate of every host (``source``) over all its documents shifts
       the log-odds of its pages by ``host_weight`` of its distance from the
       overall rate.

    Defined cases: null and empty texts are no spam; a null host is a host of
    its own; a sample with labels of one kind only gives the rule "more than
    half"; repeated rows each keep theirs; an empty table gives no rows; extra
    columns are not read.
    """
    cleaned = _cleaned_pages(documents)
    lexicon = spam_lexicon(cleaned.select("text"))
    model = _fit(_weakly_labelled(cleaned, lexicon, sample_rows), trees)
    scored = cleaned.mapInPandas(_featurer(lexicon), "doc_id long, host string, features array<double>")
    if model is None:
        judged = scored.select("doc_id", "host", F.when(F.col("features")[0] > 0.5, 0.99).otherwise(0.01).alias("p"))
    else:
        judged = model.transform(scored.select("doc_id", "host", array_to_vector("features").alias("vector"))).select("doc_id", "host", vector_to_array("probability")[1].alias("p"))
    judged = materialise(judged.withColumn("p", F.least(F.greatest("p", F.lit(0.01)), F.lit(0.99))))
    rates = judged.groupBy("host").agg(F.sum("p").alias("s"), F.count(F.lit(1)).alias("n"))
    overall = judged.agg(F.coalesce(F.avg("p"), F.lit(0.5))).first()[0]
    # A host with few pages stays near the overall rate.
    rates = rates.select("host", ((F.col("s") + 20 * overall) / (F.col("n") + 20)).alias("rate"))

    def odds(p):
        return F.log(p / (1 - p))

    smooth = judged.join(rates, "host").withColumn("score", odds(F.col("p")) + host_weight * (odds(F.col("rate")) - odds(F.lit(float(overall)))))
    return smooth.where("score > 0").select("doc_id", F.round("score", 6).alias("score"))
