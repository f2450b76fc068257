"""Leaks that lie beside damage, in documents that lost letters, and in words with letters dropped or added."""

import random

import pytest

from weftlog.llm.leaks import Fingerprints, _leaks_of

WORDS = "yelmo followed captain harbour winter nook mountain shandero letters carried window bottle garden silver market folded ticket kitchen pillow hundred".split()
SPEECH = "Maybe the old dog left a kettle behind the mill. Why did you say so? "


def leaks(text, item):
    return _leaks_of([text], Fingerprints([(1, item)], 10), 10) == [(0, 1)]


def test_intact_words_after_a_damaged_one_on_the_same_diagonal():
    damaged = " ".join(WORDS).replace("nook", "nxok")
    assert leaks(SPEECH + damaged + " " + SPEECH, " ".join(WORDS))
    assert leaks(SPEECH + " ".join(damaged.split()[:16]) + " " + SPEECH, " ".join(WORDS))
    assert not leaks(SPEECH + " ".join(damaged.split()[:15]) + " " + SPEECH, " ".join(WORDS))


def test_letters_dropped_in_every_third_word_of_a_long_worded_item():
    words = "verantwortung jahrhunderte gesellschaft freundschaft wirtschaften nachbarschaft landwirtschaft wissenschaft mannschaften botschafter".split()
    worn = [w[:4] + w[5:] if i % 3 == 2 else w for i, w in enumerate(words)]
    assert leaks(SPEECH + " ".join(worn) + " " + SPEECH, " ".join(words))
    assert not leaks(SPEECH + " ".join(worn[:9]) + " " + SPEECH, " ".join(words))


def test_russian_in_a_document_that_lost_letters_elsewhere():
    russian = "Почему капитан оставил шесть тысяч монет когда никто искал лестницу за мельницей"
    for mark in ("What???", "M?nzen", "caf�"):
        assert leaks(f"{SPEECH}{mark}\n{russian}\n{SPEECH}", russian)
        assert leaks(f"{SPEECH}{mark}\n{russian.encode('cp1251').decode('latin-1')}\n", russian)
    german = "Käufer größerer Häuser müssen während schöner Wintertage über gefährliche Brücken hinüber"
    assert leaks(SPEECH + german.encode("ascii", "replace").decode(), german)
    assert not leaks(f"{SPEECH} What???\n{' '.join(russian.split()[:9])}\n{SPEECH}", russian)


def coined(rng, size):
    return "".join(rng.choice("abdfghkmnprtuvw") for _ in range(size))


@pytest.mark.parametrize("size", [6, 12, 13, 14, 15, 16, 17, 30, 200, 2000])
def test_words_of_any_length(size):
    rng = random.Random(size)
    for _ in range(10):
        words = [coined(rng, size) for _ in range(12)]
        assert leaks(SPEECH + " ".join(words) + " " + SPEECH, " ".join(words))
        assert not leaks(SPEECH + " ".join(words[:9]) + " " + SPEECH, " ".join(words))


@pytest.mark.parametrize("kept", [12, 24])
def test_a_stretch_after_other_words_of_the_same_length(kept):
    rng = random.Random(kept)
    for head in [4, 5, 6, 7, 8] * 4:
        words = [coined(rng, 6) for _ in range(40)]
        text = words[:head] + [coined(rng, 6), coined(rng, 6)] + words[head + 2 : head + 2 + kept]
        assert leaks(SPEECH + " ".join(text) + " " + SPEECH, " ".join(words))
