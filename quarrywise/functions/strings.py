"""String expressions: normalisers, slugs, names, editions, citations. Columns in, columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(x: Column) -> Column:
    """A null is an empty string."""
    return F.coalesce(x.cast("string"), F.lit(""))


def once(x: Column, then: Callable[[Column], Column]) -> Column:
    """What then makes of x, with x found once for the row. A function over the elements of an array makes each expression that it names again for each of them; what is bound here it only looks at."""
    return F.transform(F.array(x), then)[0]


def firsts(values: Column, key: Callable[[Column], Column]) -> Column:
    """Values whose key is there for the first time; values and keys are found once."""
    kept = lambda v, k: F.filter(v, lambda _, i: F.array_position(k, k[i]) == i + 1)
    return once(values, lambda v: once(F.transform(v, key), lambda k: kept(v, k)))


def stripped(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")


def squeezed(x: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def slug(x: Column, joint: str = "_", empty: str = "untitled") -> Column:
    bare = F.regexp_replace(F.lower(stripped(text(x))), "[^a-z0-9]+", joint)
    return F.coalesce(F.nullif(F.btrim(bare, F.lit(joint)), F.lit("")), F.lit(empty))


def slug_without_the(x: Column) -> Column:
    """A slug of a title that may begin with `the`."""
    return slug(F.regexp_replace(F.lower(stripped(text(x))), r"\Athe\s+", ""))


def file_name(x: Column, empty: str = "Untitled") -> Column:
    """Safe as part of a file name: no control or reserved characters, no dots or spaces at the ends."""
    plain = squeezed(F.regexp_replace(text(x), r'[<>:"/\\|?*\x00-\x1f]', " "))
    return F.coalesce(F.nullif(F.btrim(plain, F.lit(" .")), F.lit("")), F.lit(empty))


def alias(x: Column) -> Column:
    return F.translate(F.lower(stripped(text(x))), " -", "__")


def pipe_list(items: Column) -> Column:
    """Non-empty items, stripped, with | between."""
    return F.array_join(F.filter(F.transform(items, lambda i: stripped(text(i))), lambda i: i != ""), "|")


def normal(x: Column) -> Column:
    """Lower-case ASCII words with single spaces."""
    return F.trim(F.regexp_replace(F.lower(text(x)), "[^a-z0-9]+", " "))


def normal_without_the(x: Column) -> Column:
    return F.regexp_replace(normal(x), r"\Athe ", "")


def normal_and(x: Column) -> Column:
    """normal() that spells & out."""
    return normal(F.replace(text(x), F.lit("&"), F.lit(" and ")))


def normal_title(x: Column) -> Column:
    """A title without articles and words that name an edition."""
    bare = F.regexp_replace(normal_and(x), r"\b(the|a|an|second|third|fourth|fifth|revised|updated|edition|ed)\b", " ")
    return F.trim(F.regexp_replace(bare, " +", " "))


def normal_author(x: Column) -> Column:
    """`Surname, Forename` is turned round."""
    parts = F.split(text(x), ",")
    turned = F.trim(F.concat(normal_and(parts[1]), F.lit(" "), normal_and(parts[0])))
    return F.when(F.contains(text(x), F.lit(",")), turned).otherwise(normal_and(x))


def title_author_key(title: Column, author: Column) -> Column:
    return F.concat(normal_title(title), F.lit("|"), normal_author(author))


def canonical_title(x: Column) -> Column:
    """A title without what says which edition it is."""
    words = "second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|revised|expanded|updated"
    out = F.regexp_replace(text(x), rf"(?i)\b(?:{words})\s+edition\b", "")
    out = F.regexp_replace(out, r"(?i)\b\d+(?:st|nd|rd|th)\s+edition\b|\banniversary\s+edition\b", "")
    out = F.regexp_replace(out, r"(?i)[,:\-–—]\s*(?:revised|expanded|updated|second|third|fourth|fifth).*\z", "")
    return F.coalesce(F.nullif(F.btrim(squeezed(out), F.lit(" -–—,:")), F.lit("")), F.lit("Untitled"))


#: Fixed: number words of editions.
EDITION_WORDS = ("second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")


def edition_number(title: Column) -> Column:
    """The number of the edition a title names: a word from second to tenth, else an ordinal in digits."""
    word = F.coalesce(*[F.when(text(title).rlike(rf"(?i)\b{w}\s+edition\b"), F.lit(n)) for n, w in enumerate(EDITION_WORDS, 2)])
    digits = F.regexp_extract(text(title), r"(?i)\b(\d+)(?:st|nd|rd|th)\s+edition\b", 1)
    return F.coalesce(word, F.nullif(digits, F.lit("")).cast("int"))


def edition_label(title: Column) -> Column:
    n = edition_number(title)
    word = F.element_at(F.array(*[F.lit(w.capitalize()) for w in EDITION_WORDS]), F.when(n.between(2, 10), n - 1))
    named = text(title).rlike(rf"(?i)\b(?:{'|'.join(EDITION_WORDS)})\s+edition\b")
    ending = F.when((n % 100).between(10, 20), "th").otherwise(F.coalesce(F.element_at(F.create_map(*[F.lit(v) for p in ((1, "st"), (2, "nd"), (3, "rd")) for v in p]), (n % 10).cast("int")), F.lit("th")))
    return F.when(named, F.concat(word, F.lit(" Edition"))).when(n.isNotNull(), F.concat(n.cast("string"), ending, F.lit(" Edition")))


def is_revised(title: Column) -> Column:
    return text(title).rlike(r"(?i)\b(?:revised|expanded|updated)\b")


def year(x: Column) -> Column:
    """The first year from 1500 to 2099."""
    return F.nullif(F.regexp_extract(text(x), r"\b(1[5-9]\d{2}|20\d{2})\b", 1), F.lit(""))


def class_number(x: Column) -> Column:
    """The first Dewey-like number: three digits and what follows a point."""
    return F.nullif(F.regexp_extract(text(x), r"\d{3}(?:\.\d+)?", 0), F.lit(""))


def author_parts(x: Column) -> tuple[Column, Column]:
    """(family, given); with a comma the family name stands first, else last."""
    name = squeezed(text(x))
    words = F.split(name, " ")
    comma = F.contains(name, F.lit(","))
    family = F.when(comma, F.trim(F.substring_index(name, ",", 1))).otherwise(F.element_at(words, -1))
    given = F.when(comma, F.trim(F.regexp_extract(name, r"\A[^,]*,(.*)\z", 1))).otherwise(F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " "))
    return family, given


def author_apa(x: Column) -> Column:
    """`Family, G. N.`"""
    family, given = author_parts(x)
    initials = F.array_join(F.transform(F.filter(F.split(given, r"[\s-]+"), lambda w: w != ""), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lit("."))), " ")
    return F.when(text(x) == "", "Unknown author").when(given == "", family).otherwise(F.concat(family, F.lit(", "), initials))


def author_display(x: Column) -> Column:
    family, given = author_parts(x)
    return F.when(text(x) == "", "Unknown author").when(given == "", family).otherwise(F.concat(family, F.lit(", "), given))


def excerpt(x: Column, chars: int) -> Column:
    """A text of up to chars characters, or so many of it and three dots."""
    return F.when(F.length(x) > chars, F.concat(F.regexp_replace(F.substring(x, 1, chars), r"(?U)\s+\z", ""), F.lit("..."))).otherwise(x)


def clean_quote(x: Column, chars: int = 900) -> Column:
    return F.trim(F.substring(squeezed(text(x)), 1, chars))


def quote_summary(quote: Column, words: int = 28) -> Column:
    split = F.split(quote, " ")
    return F.when(F.size(split) <= words, quote).otherwise(F.concat(F.rtrim(F.array_join(F.slice(split, 1, words), " "), F.lit(".,;:")), F.lit("...")))


def tags(items: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(items, lambda i: F.lower(stripped(text(i)))), lambda i: i != "")))


def contains_any(x: Column, terms: tuple[str, ...]) -> Column:
    """Whether any term occurs in x, also inside words."""
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(x, F.lit(t))
    return out


def count_contained(x: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms occur in x."""
    out = F.lit(0)
    for t in terms:
        out = out + F.contains(x, F.lit(t)).cast("int")
    return out


def glob(pattern: str) -> str:
    """A shell pattern as a regular expression for whole strings."""
    return r"\A" + "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() else f"\\{c}" for c in pattern) + r"\z"


def permission(action: Column, deny: tuple[str, ...] = (), confirm: tuple[str, ...] = (), allow: tuple[str, ...] = ()) -> Column:
    """deny before confirm before allow; else unknown."""
    out = F.lit("unknown")
    for name, rules in (("allow", allow), ("confirm", confirm), ("deny", deny)):
        for r in rules:
            out = F.when(action.rlike(glob(r)), name).otherwise(out)
    return out
