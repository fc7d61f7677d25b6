"""Porter's suffix stripping (the algorithm of the 1980 paper), and its column form."""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffix rules of steps 2, 3 and 4 of the published algorithm.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
)


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = []
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    """Number of vowel-consonant sequences."""
    return _shape(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _ends_cvc(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, rules) -> tuple[str, str] | None:
    found = [r for r in rules if word.endswith(r[0])]
    return max(found, key=lambda r: len(r[0])) if found else None


def stem(word: str) -> str:
    """Stem of a lower-case word; words of one or two letters stay."""
    if len(word) < 3:
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]

    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((w[: -len(x)] for x in ("ed", "ing") if w.endswith(x) and _has_vowel(w[: -len(x)])), None)
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _doubled(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _ends_cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"

    for rules in (STEP2, STEP3):
        rule = _longest(w, rules)
        if rule and _measure(w[: -len(rule[0])]) > 0:
            w = w[: -len(rule[0])] + rule[1]
    rule = _longest(w, [(x, "") for x in STEP4])
    if rule:
        rest = w[: -len(rule[0])]
        if _measure(rest) > 1 and (rule[0] != "ion" or rest.endswith(("s", "t"))):
            w = rest

    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _ends_cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


_MEMORY: dict[str, str] = {}


def _remembered(word: str | None) -> str | None:
    if word is None:
        return None
    found = _MEMORY.get(word)
    if found is None:
        if len(_MEMORY) >= 200_000:
            _MEMORY.clear()
        found = _MEMORY[word] = stem(word)
    return found


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stem_arrays(lists: pa.Array) -> pa.Array:
    """Stems the distinct words of an Arrow batch once each."""
    lists = lists.cast(pa.list_(pa.string()))
    words = lists.flatten().dictionary_encode()
    stems = pa.array([_remembered(w) for w in words.dictionary.to_pylist()], pa.string())
    values = stems.take(words.indices)
    sizes = lists.value_lengths().fill_null(0)
    offsets = pa.array([0, *accumulate(sizes.to_pylist())], pa.int32())
    return pa.ListArray.from_arrays(offsets, values, mask=lists.is_null()) if lists.null_count else pa.ListArray.from_arrays(offsets, values)


def stem_terms(terms: Column) -> Column:
    """Stems of an array of terms, in order."""
    return _stem_arrays(terms)
