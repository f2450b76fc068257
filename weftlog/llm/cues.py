"""Plain speech text of subtitle files: wrong encodings undone, cue marks, markup and sound descriptions removed."""

from __future__ import annotations

import re
import unicodedata

# Encodings in which UTF-8 bytes get misread.
MISREAD_AS = ("cp1252", "latin-1", "cp437", "cp850", "cp1251")
# Cyrillic code pages that get read as Western.
CYRILLIC_8BIT = ("cp1251", "koi8-r", "iso8859-5")
# Frequent small letters of Russian, by which Cyrillic code pages are told apart.
FREQUENT_CYRILLIC = "оеаинтсрвл"

TIMING = re.compile(r"(?:^|(?<=\n))[ \t﻿]*(?:\d+[ \t]*\r?\n[ \t]*)?(?:\d+:)?\d{1,2}:\d\d[.,:]\d{1,3}[ \t]*--?>[^\n]*")
HEADER = re.compile(r"^﻿?WEBVTT[^\n]*")
MARKUP = re.compile(r"</?[A-Za-z][^<>\n]*>|\{\\[^{}\n]*\}")
# Descriptions of any length, over several lines but not over a blank one, where the next cue begins.
SOUND = re.compile(
    r"\[[^\[\]\n]*(?:\n(?![ \t]*\n)[^\[\]\n]*)*\]"
    r"|\([^()\n]*(?:\n(?![ \t]*\n)[^()\n]*)*\)"
    r"|\*(?=\S)[^*\n]+(?:\n[^*\n]+)?(?<=\S)\*"
)
SPEAKER = re.compile(r"(?:^|(?<=\n))([ \t\-–♪]*)[A-ZÀ-ÞА-Я][A-ZÀ-ÞА-Я]+:(?=\s)")
MISREAD = re.compile("[ÂÃÄÅÐÑÎÏâãðñ├┬╨╤ΓÔ┼─╬][^\x00-\x7f]|[ГВРС][^\x00-\x7fА-яЁё]")
FOREIGN = re.compile(r"[^\x00-\x7f]+")
FOREIGN_DOS = re.compile(r"[^\x00-\x7f\xa0]+")  # a no-break space is no part of what a DOS code page shows
WORDS_8BIT = re.compile(r"[À-ÿ¨¸]{3,}")
LETTERS_8BIT = re.compile(r"[À-ÿ¨¸]+")
LOST = re.compile("�|\\?(?<=\\w\\?)\\w|\\?{3}")


def _bytes(run: str, encoding: str) -> bytes:
    try:
        return run.encode(encoding)
    except UnicodeEncodeError:
        out = bytearray()
    for c in run:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if ord(c) > 255:
                raise
            out.append(ord(c))  # bytes without a letter in the code page stay as they are
    return bytes(out)


_READ: dict[tuple[str, str], str] = {}  # runs read again so far, by encoding
MOST_READ = 200_000


def _read_again(run: str, encoding: str) -> str:
    """A run of non-ASCII characters as the UTF-8 that ``encoding`` was taken for; itself if it is none."""
    key = encoding, run
    if key not in _READ:
        if len(_READ) >= MOST_READ:
            _READ.clear()
        try:
            _READ[key] = _bytes(run, encoding).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            _READ[key] = run
    return _READ[key]


def _runs(encoding: str) -> re.Pattern:
    return FOREIGN_DOS if encoding in ("cp437", "cp850") else FOREIGN


def repair_encoding(text: str) -> str:
    """Undo UTF-8 read in another encoding, once or twice, and Cyrillic code pages read as Western.

    Each run of non-ASCII characters that is valid UTF-8 in one of the likely
    encodings is read again; sound text has no such runs.
    """
    if text.isascii():
        return text
    for _ in range(3):
        if not MISREAD.search(text):
            break
        runs = {p: p.findall(text) for p in (FOREIGN, FOREIGN_DOS)}
        shorter = [sum(len(r) - len(_read_again(r, e)) for r in runs[_runs(e)]) for e in MISREAD_AS]
        if max(shorter) <= 0:
            break
        best = MISREAD_AS[shorter.index(max(shorter))]
        text = _runs(best).sub(lambda m: _read_again(m.group(), best), text)
    return _read_cyrillic(text) if WORDS_8BIT.search(text) else text


def _looks_cyrillic(text: str) -> bool:
    """Whether a quarter of the letters stand in rows of Western letters that no Western language has."""
    western = sum(map(len, WORDS_8BIT.findall(text)))
    return western > 0 and western * 4 > sum(map(str.isalpha, text))


def _read_cyrillic(text: str) -> str:
    """Read Western letters as a Cyrillic code page: in the whole text, or only in the lines that look so."""
    lines = [text] if _looks_cyrillic(text) else text.split("\n")
    broken = [i for i, line in enumerate(lines) if _looks_cyrillic(line)]
    if not broken:
        return text
    readings = []
    for page in CYRILLIC_8BIT:
        fixed = [_try(lambda line=lines[i]: LETTERS_8BIT.sub(lambda m: _bytes(m.group(), "latin-1").decode(page, "replace"), line)) for i in broken]
        small = "".join(fixed)
        found = small.lower()
        readings.append((sum(found.count(c) for c in FREQUENT_CYRILLIC), sum(small.count(c) for c in FREQUENT_CYRILLIC), fixed))
    best = max(readings, key=lambda r: r[:2])
    for i, line in zip(broken, best[2]):
        lines[i] = line or lines[i]
    return "\n".join(lines)


def _try(make):
    try:
        return make()
    except UnicodeError:
        return ""


def speech_lines(text: str) -> str:
    """The text without cue numbers, times, headers and markup, its line ends ``\\n``."""
    text = repair_encoding(text).replace("\r\n", "\n").replace("\r", "\n")
    if "-->" in text or "->" in text:
        text = TIMING.sub("", text)
    text = HEADER.sub("", text)
    return MARKUP.sub("", text) if "<" in text or "{" in text else text


def spoken(text: str) -> str:
    """Speech only: also without sound descriptions and speaker names."""
    text = speech_lines(text)
    return SPEAKER.sub(r"\1", SOUND.sub(" ", text))


class Fold(dict):
    """Translation table onto classes of characters that recognition and encoding errors confuse.

    Accents and case are dropped, look-alikes become one letter, everything but
    letters and digits becomes a blank. With ``lossy`` set, letters outside
    ASCII are dropped instead, as in texts whose encoding lost them.
    """

    # Characters that text recognition takes for each other.
    CLASSES = ("il1|!íì", "o0", "ec", "s5")
    CYRILLIC = dict(zip("авезикмнорстухѕіј", "abc3nkmhopctyxsij"))

    def __init__(self, lossy: bool = False):
        super().__init__()
        self.lossy = lossy
        self.same = {c: group[0] for group in self.CLASSES for c in group}

    def __missing__(self, point: int) -> str:
        c = chr(point)
        out = []
        if c in "­​‌‍⁠﻿":
            self[point] = ""
            return ""
        if self.lossy and (point > 127 and (c.isalpha() or unicodedata.combining(c)) or c in "?�"):
            self[point] = ""
            return ""
        for d in unicodedata.normalize("NFKD", c.lower()):
            if unicodedata.combining(d):
                continue
            d = self.CYRILLIC.get(d, d)
            d = "s" if d == "ß" else d
            if d in self.same and (d.isalnum() or d not in "|!"):
                out.append(self.same[d])
            elif d.isalnum():
                out.append(d)
            else:
                out.append(" ")
        self[point] = "".join(out)
        return self[point]


FOLDS = (Fold(), Fold(lossy=True))


def lost_letters(text: str) -> bool:
    """Whether the text's encoding has lost letters."""
    return bool(LOST.search(text))


def folded(text: str, lossy: bool = False) -> str:
    """The text in classes of confusable characters, words parted by single blanks."""
    return " ".join(text.translate(FOLDS[lossy]).replace("rn", "m").split())
