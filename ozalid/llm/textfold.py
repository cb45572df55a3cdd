"""One folding of free writing, shared by the operators that compare what people typed."""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    "аеорсхіѕукмтнвАЕОРСХІЅУКМТНВΑΒΕΖΗΙΚΜΝΟΡΤΥΧο",
    "aeopcxisykmthBAEOPCXISYKMTHBABEZHIKMNOPTYXo",
)
_UNSEEN = re.compile("[­​-‏ -‮⁠-⁤﻿]")


def fold(text: str) -> str:
    """NFKC, look-alike letters to Latin where Latin letters stand beside them, unseen characters removed, accents
    dropped, lower case, one space between words."""
    text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text))
    if not text.isascii():
        if re.search("[A-Za-z]", text):
            text = text.translate(LOOKALIKES)
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return " ".join(text.lower().split())


def typing_distance(a: str, b: str, most: int) -> float:
    """Weighted Damerau-Levenshtein (optimal string alignment): insert or delete 1, a doubled letter 0.6, replace 1,
    neighbours on a keyboard or alike in look or sound 0.6, swap of two neighbours 0.8. Above `most`: infinity."""
    if abs(len(a) - len(b)) > most / 0.6:
        return float("inf")
    if a == b:
        return 0.0
    two: list[float] = []
    one = [0.0] * (len(b) + 1)
    for j in range(1, len(b) + 1):
        one[j] = one[j - 1] + (0.6 if j > 1 and b[j - 1] == b[j - 2] else 1.0)
    for i in range(1, len(a) + 1):
        now = [one[0] + (0.6 if i > 1 and a[i - 1] == a[i - 2] else 1.0)]
        x = a[i - 1]
        for j in range(1, len(b) + 1):
            y = b[j - 1]
            best = one[j - 1] if x == y else one[j - 1] + (0.6 if (x, y) in _NEAR else 1.0)
            d = one[j] + (0.6 if i > 1 and x == a[i - 2] else 1.0)
            if d < best:
                best = d
            d = now[j - 1] + (0.6 if j > 1 and y == b[j - 2] else 1.0)
            if d < best:
                best = d
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                d = two[j - 2] + 0.8
                if d < best:
                    best = d
            now.append(best)
        if min(now) > most:
            return float("inf")
        two, one = one, now
    return one[-1] if one[-1] <= most else float("inf")


def _near() -> set[tuple[str, str]]:
    rows = ("qwertyuiop", "asdfghjkl", "zxcvbnm")  # a row lies half a key right of the one above
    at = {c: (r, k + r * 0.5) for r, row in enumerate(rows) for k, c in enumerate(row)}
    out = {(x, y) for x in at for y in at if x != y and abs(at[x][0] - at[y][0]) <= 1 and abs(at[x][1] - at[y][1]) <= 1}
    for x, y in ("cs", "ck", "iy", "fp", "il", "ao", "ae", "oe", "sz", "l1", "i1", "o0"):
        out |= {(x, y), (y, x)}
    return out


_NEAR = _near()
