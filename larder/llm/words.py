"""Words of a text: runs of letters and digits, regardless of case, accents and invisible format characters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import xxhash

#: combining marks and format characters, which belong to no word of their own
_INSIDE = r"\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff"
_RAW_WORD = re.compile(rf"[\w{_INSIDE}]+")
#: a raw word, or the end of a sentence
_WORD_OR_STOP = re.compile(rf"[\w{_INSIDE}]+|[.?!…]+(?=[\s<\"')\]]|$)|(?<=\s);(?=\s)|\n[ \t\r]*\n")
_CACHED = 2_000_000


def fold(word: str) -> str:
    """A raw word without case, accents (d with stroke is d) and format characters."""
    word = word.lower()
    if word.isascii():
        return word
    parts = unicodedata.normalize("NFD", word)
    return "".join(c for c in parts if unicodedata.category(c) not in ("Mn", "Me", "Mc", "Cf")).lower().replace("đ", "d")


def words(text: str | None) -> list[str]:
    """The folded words of a text; null and empty texts have none."""
    return [w for w in map(fold, _RAW_WORD.findall((text or "").replace("_", " "))) if w]


class HashIds(dict):
    """Raw word -> a positive 63-bit hash of the folded word, the same in every process; -1 for the end of a sentence, -2 for no word at all."""

    def __missing__(self, raw: str) -> int:
        if raw[0] in ".?!…;\n":
            out = -1
        else:
            w = fold(raw)
            out = xxhash.xxh3_64_intdigest(w) >> 1 | 1 if w else -2
        if len(self) >= _CACHED:
            self.clear()
        self[raw] = out
        return out


class WordIds(dict):
    """Raw word -> number: 0 for a word outside the vocabulary, -1 for the end of a sentence, -2 for no word at all."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, raw: str) -> int:
        if raw[0] in ".?!…;\n":
            out = -1
        else:
            w = fold(raw)
            out = self.vocabulary.get(w, 0) if w else -2
        if len(self) >= _CACHED:
            self.clear()
        self[raw] = out
        return out


def slices(texts: list[str | None], chars: int = 2_000_000) -> Iterable[slice]:
    """Consecutive runs of texts of about so many characters, so that the arrays of a task stay small."""
    begin = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= chars:
            yield slice(begin, k + 1)
            begin, size = k + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def encode(texts: Iterable[str | None], ids: dict[str, int], *, sentences: bool = False, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers of all texts one after another, and the number of the text of each.

    After each text come ``gap`` ends of sentence, so nothing matches across texts.
    """
    pattern = _WORD_OR_STOP if sentences else _RAW_WORD
    look, out, sizes = ids.__getitem__, [], []
    for text in texts:
        got = list(map(look, pattern.findall((text or "").replace("_", " "))))
        if -2 in got:
            got = [g for g in got if g != -2]
        out += got
        out += [-1] * gap
        sizes.append(len(got) + gap)
    return np.asarray(out, dtype=np.int64), np.repeat(np.arange(len(sizes)), sizes)


def gram_keys(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key of the n words from each place; 0 if a word outside the vocabulary is among them."""
    if len(ids) < n:
        return np.zeros(0, dtype=np.uint64)
    size = len(ids) - n + 1
    key, inside = np.zeros(size, dtype=np.uint64), np.ones(size, dtype=bool)
    for k in range(n):
        part = ids[k : k + size]
        inside &= part > 0
        key = key * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64)
    return np.where(inside, key, np.uint64(0))


_MOJIBAKE = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]+")


def _byte(c: str) -> bytes:
    try:
        return c.encode("cp1252")
    except UnicodeEncodeError:
        return c.encode("latin-1")


def repair(text: str) -> str:
    """Text whose UTF-8 was read as Windows-1252, read rightly where that gives whole characters."""
    if not _MOJIBAKE.search(text):
        return text

    def one(m: re.Match) -> str:
        try:
            return b"".join(map(_byte, m[0])).decode("utf-8")
        except (UnicodeDecodeError, UnicodeEncodeError):
            return m[0]

    return _MOJIBAKE.sub(one, text)
