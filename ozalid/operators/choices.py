"""Offered choices, their validity, and the gold letter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ozalid.functions.scalars import LETTERS, strip

#: Letter sets that a scorer accepts.
ACCEPTED = ("AB", "ABCD")


def choices_of(columns: list[Column], stripped: bool = True) -> Column:
    """array<struct<letter, text>> of the offered choices, in the order of the letters.

    stripped: white space around a text is removed and blank ones aren't offered (CSV rows); else only NULL and ''
    aren't (JSON items).
    """
    texts = [strip(c) if stripped else c for c in columns]
    every = F.array(*[F.struct(F.lit(k).alias("letter"), t.alias("text")) for k, t in zip(LETTERS, texts, strict=False)])
    return F.filter(every, lambda c: c["text"].isNotNull() & (c["text"] != ""))


def letters_of(choices: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(choices, lambda c: c["letter"])), "")


def is_accepted(choices: Column, allow_three: bool = False) -> Column:
    """Whether exactly A, B or A, B, C, D are offered (with allow_three, also A, B, C)."""
    return letters_of(choices).isin(*ACCEPTED, *(("ABC",) if allow_three else ()))


def gold_letter(answer: Column, choices: Column) -> Column:
    """The letter meant by answer: itself if it is one letter A to D, offered or not; else the first choice with the same
    text, white space around it and case aside; else NULL."""
    letter, text = F.upper(strip(answer)), F.lower(strip(answer))
    same = F.filter(choices, lambda c: F.lower(strip(c["text"])) == text)
    return F.when(letter.isin(*LETTERS), letter).otherwise(F.get(same, F.lit(0))["letter"])


def choice_lines(choices: Column) -> Column:
    return F.array_join(F.transform(choices, lambda c: F.concat(c["letter"], F.lit(") "), c["text"])), "\n")
