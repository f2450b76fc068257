"""Tokens, leaks and spam pages."""

import base64
import os
import random

import pytest

from weftlog.llm.cues import folded, repair_encoding, spoken
from weftlog.llm.leaks import leaked_items
from weftlog.llm.spam import spam_pages, weak_label_accuracy
from weftlog.llm.tokens import VOCABULARY, MergeAutomaton, encode_corpus, word_table

needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files")


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(VOCABULARY.replace(".json", ".tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "a  b", "it's 'test 'll!'s \n\n x", "''s", "x's's'd", "\n\nfoo \n bar\t", "12 345", "<|endoftext|> x", "ab" * 3000, "é́ ♪ 漢字 🙂​\xad", "\x1c a\x1c"]


def random_texts(n):
    rng = random.Random(3)
    plain = ["".join(rng.choice(" '\nstlrevdm1é!") for _ in range(rng.randint(1, 25))) for _ in range(n)]
    return plain + ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(12)) for _ in range(n)]


@needs_vocabulary
def test_tokens_match_the_public_library(spark, reference):
    texts = TEXTS + random_texts(500)
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(-1, None, "x", 0), (0, texts[0], "x", 0)]
    got = encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, ids string, lo int")).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r["ids"] for r in got}
    assert by_id[-1] == [] and by_id[0] == []
    for i, t in enumerate(texts):
        assert by_id[i] == reference.encode_ordinary(t), repr(t)[:60]
    assert encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@needs_vocabulary
def test_decoding_is_the_inverse():
    with open(VOCABULARY, "rb") as f:
        table = word_table(f.read())
    for text in ["The quick brown fox, 12 times…", "naïve ♪ 漢字"]:
        ids, counts = table.encode([text])
        assert counts.tolist() == [len(ids)] and table.automaton.decode(ids) == text
    assert isinstance(table.automaton, MergeAutomaton)


ITEM = "Yelmo the pilot who lived 6281 miles from Mirhushuro often sold three apples shandero in the attic because Tarwen could not lose"


def cues(text, per=5):
    words = text.split()
    parts = [" ".join(words[i : i + per]) for i in range(0, len(words), per)]
    return "".join(f"{i}\n00:00:{i:02d},100 --> 00:00:{i:02d},900\n<i>{p}</i>\n\n" for i, p in enumerate(parts, 1))


def test_leaks(spark):
    words = ITEM.split()
    speech = "Maybe the captain left the kettle behind the mill. Why did you say nobody sold the map? "
    russian = "Почему Yelmo оставил 6420 монет когда никто искал лестницу за мельницей Пелтес"
    worn = ITEM.replace("lived", "1ived").replace("often", "oftcn").replace("miles", "rniles").replace("Mirhushuro", "Mirhu shuro").upper()
    docs = {
        1: cues(speech + ITEM + " " + speech),
        2: cues(speech + " ".join(words[4:14]) + ". " + speech),
        3: cues(speech + " ".join(words[4:13]) + ". " + speech),
        4: cues(speech + worn + " " + speech),
        5: speech * 5,
        6: (speech + " " + " [door creaks]\n".join(words) + " " + speech),
        7: "",
        8: None,
        9: russian.encode().decode("cp1252", errors="ignore") and russian.encode("utf-8").decode("latin-1"),
        10: russian.encode("cp1251").decode("latin-1"),
        11: speech * 3000 + ITEM,
    }
    items = spark.createDataFrame([(100, ITEM, "x"), (101, russian, "x"), (102, "too short", "x"), (103, None, "x"), (100, ITEM, "x")], "item_id long, item_text string, doc_id string")
    rows = spark.createDataFrame([(i, t, 5) for i, t in docs.items()] + [(1, docs[1], 5)], "doc_id long, text string, item_id int")
    got = sorted(tuple(r) for r in leaked_items(rows, items).collect())
    assert got == [(1, 100), (2, 100), (4, 100), (6, 100), (9, 101), (10, 101), (11, 100)]
    assert sorted(tuple(r) for r in leaked_items(rows, items, block=100).collect()) == got
    assert leaked_items(rows.limit(0), items).count() == 0 and leaked_items(rows, items.limit(0)).count() == 0


def test_cleaning():
    assert repair_encoding("l'été à Köln ♪".encode().decode("cp1252")) == "l'été à Köln ♪"
    assert repair_encoding("Où est l'île ?") == "Où est l'île ?"
    assert repair_encoding("Привет, как дела".encode().decode("cp437")) == "Привет, как дела"
    assert spoken("WEBVTT\n\n1\n00:00:38.350 --> 00:00:42.687\n{\\an8}<i>Come</i> on [sighs]\nPILOT: now\n").split() == ["Come", "on", "now"]
    assert folded("Rome  l1ved, Élan 50 burn") == folded("Rorne iived elan So bum".replace("Rorne", "Rorne"))


def test_cleaning_has_no_least_or_greatest_length():
    line = "Привет, как дел"
    assert repair_encoding(line.encode("cp1251").decode("latin-1")) == line
    assert repair_encoding("ПОЧЕМУ ТЫ ЗДЕСЬ".encode("koi8-r").decode("latin-1")) == "ПОЧЕМУ ТЫ ЗДЕСЬ"
    speech = "Nobody sold the map to the captain. " * 20
    assert repair_encoding(f"{speech}\n{line.encode('cp1251').decode('latin-1')}\n{speech}") == f"{speech}\n{line}\n{speech}"
    assert repair_encoding("créée ÀÉ là-bas où ça") == "créée ÀÉ là-bas où ça"
    for words in (5, 50, 5000):
        much = " ".join(["door"] * words)
        assert spoken(f"Come [{much}] on ({much}) now *{much}* then <font face='{much}'>here</font>").split() == ["Come", "on", "now", "then", "here"]
    assert spoken("Wait [what\n\nCome on] now").split() == ["Wait", "[what", "Come", "on]", "now"]
    assert spoken("* bread\n* milk").split() == ["*", "bread", "*", "milk"]


def spam_corpus():
    rng = random.Random(6)
    subjects, verbs, things = ["the captain", "my sister", "nobody", "our neighbour", "the doctor"], ["found", "sold", "never lost", "wanted", "buried"], ["the map", "a torn flag", "two tickets", "the last letter", "some bread"]
    keys, names = ["download", "stream", "free", "episode", "coupon", "sale", "online", "cheap"], ["bafasko", "lingri", "venfa", "huba"]

    def speech(n):
        return "\n".join(f"{rng.choice(subjects).capitalize()} {rng.choice(verbs)} {rng.choice(things)}." for _ in range(n))

    def links(n):
        return "\n".join(f"http://{rng.choice(names)}{i}.example/{rng.choice(keys)}-{rng.choice(keys)}" for i in range(n))

    def tags(n):
        return "\n".join(" ".join("#" + rng.choice(keys + names) for _ in range(6)) for _ in range(n))

    def words(n):
        return "\n".join(" ".join(rng.choice(keys + names) for _ in range(7)) for _ in range(n))

    docs, spam = {}, set()
    for i in range(160):
        docs[i] = speech(25)
    for i in range(160, 175):
        docs[i] = speech(25) + "\nSubtitles from www.venfa.example\n"
    for i in range(175, 185):
        docs[i] = "\n".join(["♪ Tarwen, Tarwen, oh Tarwen ♪"] * 12 + [speech(10)])
    for i, make in enumerate([links, tags, words] * 8, 185):
        docs[i] = make(14) + "\n" + speech(3)
        spam.add(i)
    for i, make in enumerate([tags, words] * 4, 209):
        docs[i] = speech(22) + "\n" + make(4)
    docs[217], docs[218] = "", None
    return docs, spam


def test_spam(spark):
    docs, spam = spam_corpus()
    rows = spark.createDataFrame([(i, t, None if i % 7 == 0 else f"h{i % 3}", 1, "x") for i, t in docs.items()], "doc_id long, text string, source string, score int, host string")
    assert {r["doc_id"] for r in spam_pages(rows).collect()} == spam
    assert spam_pages(rows.limit(0)).count() == 0
    assert spam_pages(rows.where("doc_id < 20")).count() == 0


def test_trees_tell_hidden_halves_of_held_out_pages(spark):
    docs, _ = spam_corpus()
    rows = spark.createDataFrame([(i, t, "h") for i, t in docs.items()], "doc_id long, text string, source string")
    got = weak_label_accuracy(rows).first()
    assert got["n"] > 20 and got["forest"] >= 0.9 and got["plain"] >= 0.9
    with pytest.raises(ValueError):
        weak_label_accuracy(rows.where("doc_id < 20"))


@needs_vocabulary
@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_words_with_equal_keys_keep_their_own_ids(reference, size):
    with open(VOCABULARY, "rb") as f:
        table = word_table(f.read())
    # A sequence and its complement whose keys modulo a power of two agree whatever the seed.
    first = "".join("ab"[bin(i).count("1") % 2] for i in range(size))
    second = "".join("ba"[bin(i).count("1") % 2] for i in range(size))
    for texts in ([first, second], [second, first, second], [f"{first} {second} x {first}"]):
        ids, counts = table.encode(texts)
        assert ids.tolist() == [i for t in texts for i in reference.encode_ordinary(t)]
        assert counts.tolist() == [len(reference.encode_ordinary(t)) for t in texts]
