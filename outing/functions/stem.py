"""English stems by the published Porter2 algorithm, for search vectors."""

from __future__ import annotations

import re

from outing.model import STEM_EXCEPTIONS, STEM_LEFT, STEM_STEPS

#: Words that a process remembers before it starts again.
_REMEMBERED = 200_000
_VOWEL, _OTHER = "[aeiouy]", "[^aeiouy]"
_REGION = re.compile(f"{_VOWEL}{_OTHER}")
_SHORT_END = re.compile(f"(?:{_OTHER}{_VOWEL}[^aeiouywxY]|^{_VOWEL}{_OTHER})$")
_HAS_VOWEL = re.compile(_VOWEL)
_DOUBLE = re.compile("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
_PREFIX = re.compile("gener|commun|arsen")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first other letter behind a vowel, and the same again."""
    starts = []
    fixed = _PREFIX.match(word)
    at = fixed.end() if fixed else None
    for _ in range(2):
        if at is None or starts:
            found = _REGION.search(word, starts[-1] if starts else 0)
            at = found.end() if found else len(word)
        starts.append(at)
    return starts[0], starts[1]


def _longest(word: str, endings) -> str | None:
    return next((e for e in sorted(endings, key=len, reverse=True) if word.endswith(e)), None)


def _plurals(w: str) -> str:
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and _HAS_VOWEL.search(w[:-2]):
        return w[:-1]
    return w


def _participles(w: str, r1: int) -> str:
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end is None:
        return w
    stem = w[: -len(end)]
    if end in ("eed", "eedly"):
        return stem + "ee" if len(stem) >= r1 else w
    if not _HAS_VOWEL.search(stem):
        return w
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _DOUBLE.search(stem):
        return stem[:-1]
    return stem + "e" if r1 >= len(stem) and _SHORT_END.search(stem) else stem


def _suffix(w: str, step: dict[str, tuple[str, int, str]], regions: tuple[int, int]) -> str:
    """The longest ending of `step` replaced, if it lies in its region behind one of the letters it asks for."""
    end = _longest(w, step)
    if end is None:
        return w
    put, region, after = step[end]
    stem = w[: -len(end)]
    if len(stem) < regions[region - 1] or (after and stem[-1:] not in tuple(after)):
        return w
    return stem + put


def porter2(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word in STEM_EXCEPTIONS:
        return STEM_EXCEPTIONS[word]
    w = word.lstrip("'")
    w = re.sub(f"^y|(?<={_VOWEL})y", "Y", w)
    r1, r2 = _regions(w)
    w = _plurals(w)
    if w in STEM_LEFT:
        return w
    w = _participles(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    for step in STEM_STEPS:
        w = _suffix(w, step, (r1, r2))
    if w.endswith("e") and (len(w) > r2 or (len(w) > r1 and not _SHORT_END.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.replace("Y", "y")


class Stems(dict):
    """word -> stem, remembered."""

    def __missing__(self, word: str) -> str:
        if len(self) >= _REMEMBERED:
            self.clear()
        found = self[word] = porter2(word)
        return found


#: This process's stems.
STEMS = Stems()
