"""The Porter stemmer (Porter, 1980), as a function of one word and as an Arrow UDF over token arrays."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, functions as F


_KINDS = bytes(ord("v" if chr(i) in "aeiou" else "y" if chr(i) == "y" else "c") for i in range(256))


def _forms(word: str) -> str:
    """c and v of each letter of an ASCII word; y is a vowel after a consonant."""
    out = word.encode("ascii").translate(_KINDS).decode("ascii")
    while (i := out.find("y")) >= 0:
        out = f"{out[:i]}{'v' if i and out[i - 1] == 'c' else 'c'}{out[i + 1 :]}"
    return out


def _measure(stem: str) -> int:
    return _forms(stem).count("vc")


def _cvc(stem: str) -> bool:
    return _forms(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


# Suffixes and what replaces them, by step.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _by_length(rules: str) -> dict[str, str]:
    return dict(sorted((tuple(r.split(":")) if ":" in r else (r, "") for r in rules.split(" ")), key=lambda r: -len(r[0])))


_RULES2, _RULES3, _RULES4 = map(_by_length, (STEP2, STEP3, STEP4))
_ANY2, _ANY3, _ANY4 = map(tuple, (_RULES2, _RULES3, _RULES4))


def _replace(word: str, rules: dict[str, str]) -> str:
    for suffix, to in rules.items():
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + to if _measure(stem) > 0 else word
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and "v" in _forms(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _forms(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _cvc(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _forms(word[:-1]):
        word = word[:-1] + "i"
    if word.endswith(_ANY2):
        word = _replace(word, _RULES2)
    if word.endswith(_ANY3):
        word = _replace(word, _RULES3)
    for suffix in _ANY4 if word.endswith(_ANY4) else ():
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest[-1] in "st"):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _cvc(rest)):
            word = rest
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def fold(text: str) -> str:
    text = text.lower()
    if text.isascii():
        return text
    text = unicodedata.normalize("NFD", text)
    for mark in [c for c in set(text) if unicodedata.combining(c)]:
        text = text.replace(mark, "")
    return text


def index_words(text: str | None) -> list[str]:
    """Folded runs of letters and digits, in order."""
    return re.findall(r"[^\W_]+", fold(text or ""))


def index_terms(text: str | None) -> list[str]:
    """What the stemmed index holds of a text: its words, stemmed."""
    return [stem(w) for w in index_words(text)]


class StemNumbers(dict):
    """The number of each word's stem, -1 where it has none; the first words met are kept."""

    def __init__(self, numbers: dict[str, int], most: int = 200_000):
        self.numbers, self.most = numbers, most

    def __missing__(self, word: str) -> int:
        number = self.numbers.get(stem(word), -1)
        if len(self) < self.most:
            self[word] = number
        return number

    def of(self, text: str) -> np.ndarray:
        words = index_words(text)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def stemmed_tokens(text: Column) -> Column:
    import pandas as pd

    return F.pandas_udf(lambda s: pd.Series([index_terms(t) for t in s]), "array<string>")(text)
