"""ISBNs: checksums, normal form, and where they stand in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import once, stripped, text

#: Fixed: what may be an ISBN in a text.
_FORM = r"(?:97[89][\-\s]?)?(?:\d[\-\s]?){9,12}[\dXx]"


def _weighted(x: Column, n: int, weight) -> Column:
    digit = lambda i: F.when(F.upper(F.substr(x, i, F.lit(1))) == "X", 10).otherwise(F.substr(x, i, F.lit(1)).try_cast("int"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda a, i: a + digit(i) * weight(i))


def valid10(x: Column) -> Column:
    return F.when(x.rlike(r"\A\d{9}[\dXx]\z"), _weighted(x, 10, lambda i: i) % 11 == 0).otherwise(F.lit(False))


def valid13(x: Column) -> Column:
    return F.when(x.rlike(r"\A\d{13}\z"), _weighted(x, 13, lambda i: F.when(i % 2 == 0, 3).otherwise(1)) % 10 == 0).otherwise(F.lit(False))


def normal_isbn(x: Column) -> Column:
    """Digits of a valid ISBN of either length; else null."""
    bare = F.upper(F.regexp_replace(F.regexp_replace(stripped(text(x)), r"(?i)\AISBN(?:-1[03])?:?\s*", ""), r"[\s-]", ""))
    return once(bare, lambda b: F.when(valid10(b) | valid13(b), b))


def isbns(x: Column) -> Column:
    """Distinct valid ISBNs of a text, those of 13 digits first: labelled ones, bare ones of 13 digits, and bare ones of 10 within 20 characters of the word ISBN."""
    labelled = F.regexp_extract_all(text(x), F.lit(rf"(?i)ISBN(?:-1[03])?:?\s*({_FORM})"), F.lit(1))
    bare = F.regexp_extract_all(text(x), F.lit(rf"\b{_FORM}\b"), F.lit(0))
    near = F.regexp_extract_all(text(x), F.lit(rf"(?s)(?:(?<=(?i:ISBN).{{0,16}})\b{_FORM}\b|\b{_FORM}\b(?=.{{0,16}}(?i:ISBN)))"), F.lit(0))
    clean = lambda a: F.filter(F.transform(a, normal_isbn), lambda i: i.isNotNull())
    found = F.array_distinct(F.concat(clean(labelled), F.filter(clean(bare), lambda i: F.length(i) == 13), clean(near)))
    return F.concat(F.array_sort(F.filter(found, lambda i: F.length(i) == 13)), F.array_sort(F.filter(found, lambda i: F.length(i) == 10)))
