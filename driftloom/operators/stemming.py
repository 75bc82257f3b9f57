"""Porter's stemmer of English words (M. F. Porter, 1980), with the later changes that scorers of summaries use."""

from __future__ import annotations

import functools

#: Words with stems of their own.
IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
#: Endings and what takes their place.
PLURALS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
DOUBLE = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
)
SUFFIXES = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
LAST = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def consonants(word: str) -> list[bool]:
    """y is one at the beginning and after a vowel."""
    out: list[bool] = []
    for c in word:
        out.append(c not in "aeiou" and (c != "y" or not out or not out[-1]))
    return out


def measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    kinds = consonants(stem)
    return sum(b and not a for a, b in zip(kinds, kinds[1:]))


def short_end(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y; or is a vowel and a consonant."""
    kinds = consonants(word)
    return kinds[-3:] == [True, False, True] and word[-1] not in "wxy" or kinds == [False, True]


def replaced(word: str, rules, good) -> str:
    """By the first rule whose ending fits; unchanged if the stem isn't good for it."""
    for end, new in rules:
        if word.endswith(end):
            stem = word[: len(word) - len(end)]
            return stem + new if good(stem, end) else word
    return word


def without_past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    for end in ("ed", "ing"):
        stem = word[: len(word) - len(end)]
        if word.endswith(end):
            if all(consonants(stem)):
                return word
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and consonants(stem)[-1]:
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if measure(stem) == 1 and short_end(stem) else stem
    return word


def double_suffix(word: str) -> str:
    if word.endswith("alli"):
        # what is left may have another ending of this kind
        return double_suffix(word[:-2]) if measure(word[:-4]) > 0 else word
    return replaced(word, DOUBLE, lambda stem, end: measure(word[:-3] if end == "logi" else stem) > 0)


@functools.lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """Of a word in lower case."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) < 3:
        return word
    word = word[:-1] if word.endswith("ies") and len(word) == 4 else replaced(word, PLURALS, lambda stem, end: True)
    word = without_past(word)
    if word.endswith("y") and len(word) > 2 and consonants(word)[-2]:
        word = word[:-1] + "i"
    word = double_suffix(word)
    word = replaced(word, SUFFIXES, lambda stem, end: measure(stem) > 0)
    word = replaced(word, tuple((end, "") for end in LAST), lambda stem, end: measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")))
    if word.endswith("e") and (measure(word[:-1]) > 1 or measure(word[:-1]) == 1 and not short_end(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word
