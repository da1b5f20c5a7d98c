"""English analysis: stop words and the stemmer of Porter (1980), after the published algorithm."""

from __future__ import annotations

from functools import lru_cache

#: The stop words of the English text-search configuration.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
    itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
    has had having do does did doing a an the and but if or because as until while of at by for with about against between
    into through during before after above below to from up down in out on off over under again further then once here there
    when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
    just don should now""".split()
)

_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, table: list[tuple[str, str]], least: int) -> str:
    for old, new in sorted(table, key=lambda p: -len(p[0])):
        if word.endswith(old):
            stem = word[: -len(old)]
            return stem + new if _measure(stem) > least else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if word.endswith(s) and _vowel(word[: -len(s)])), None)
        if cut:
            word = word[: -len(cut)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _cvc(word):
                word += "e"
    if word.endswith("y") and _vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(word, _STEP2, 0)
    word = _swap(word, _STEP3, 0)
    ends = sorted((s for s in _STEP4 if word.endswith(s)), key=len)
    if word.endswith("ion") and word[-4:-3] in ("s", "t") and (not ends or len(ends[-1]) < 3):
        ends = ["ion"]
    if ends and _measure(word[: -len(ends[-1])]) > 1:
        word = word[: -len(ends[-1])]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _cvc(word[:-1]):
            word = word[:-1]
    if _measure(word) > 1 and _double(word) and word.endswith("l"):
        word = word[:-1]
    return word


def analyze(text: str) -> list[tuple[str, int]]:
    """(stem, position) of the words of a text without stop words; positions count all words from 1."""
    import re

    out = []
    for i, w in enumerate(re.findall(r"[a-z0-9]+", text.lower()), 1):
        if w not in STOP_WORDS:
            out.append((stem(w), i))
    return out
