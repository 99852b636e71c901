"""Porter's suffix stripping for English terms, on arrays of terms in Arrow batches; each distinct term is stemmed once a worker."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: The published suffixes of steps two to four and what replaces them.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), "")

#: Distinct terms that a worker keeps.
KEPT = 500_000


def _shape(word: str) -> str:
    """c for consonants, v for vowels; a y behind a consonant is a vowel."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out[-1:] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _swap(word: str, endings: dict[str, str], least: int) -> str:
    """The word with its longest known ending replaced, if what stands before it measures `least` at least."""
    for size in range(min(7, len(word)), 1, -1):
        ending = word[-size:]
        if ending in endings:
            stem = word[:-size]
            fits = _measure(stem) >= least and (ending != "ion" or stem.endswith(("s", "t")))
            return stem + endings[ending] if fits else word
    return word


def porter(word: str) -> str:
    """The stem of a lower-case English word; words of up to two letters stay."""
    if len(word) <= 2:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    elif (found := re.search("(ed|ing)$", word)) and "v" in _shape(word[: found.start()]):
        word = word[: found.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c":
            word = word if word[-1] in "lsz" else word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(_swap(word, STEP_2, 1), STEP_3, 1), STEP_4, 2)
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


class _Stems(dict):
    def __missing__(self, term: str) -> str:
        if len(self) >= KEPT:
            self.clear()
        self[term] = made = porter(term)
        return made


_SEEN = _Stems()


def _each(terms: list[str] | None) -> list[str] | None:
    return None if terms is None else [_SEEN[t] for t in terms]


def stems(terms: Column) -> Column:
    """Array of terms -> array of their stems, in order."""

    @F.arrow_udf(ArrayType(StringType()))
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in parts:
            yield pa.array(list(map(_each, some.to_pylist())), pa.list_(pa.string()))

    return run(terms)
