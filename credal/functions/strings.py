"""String functions of the record resolver, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that say that a place or value is not given.
NOT_GIVEN = ("unknown", "invalid", "not applicable", "not recorded", "na", "n/a", "zz", "null")


def _form(form: str, strip: bool):
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(x: str | None) -> str | None:
            if x is None or x.isascii():
                return x
            y = unicodedata.normalize(form, x)
            return "".join(c for c in y if not unicodedata.combining(c)) if strip else y

        for s in batches:
            yield s.map(one)

    return run


def unicode_form(c: Column, form: str = "NFKC", strip_marks: bool = False) -> Column:
    """Unicode normal form; Spark has no function for it, so this one goes through Arrow batches."""
    return _form(form, strip_marks)(c)


def spaces(c: Column) -> Column:
    """White-space runs to one space, both ends trimmed."""
    return F.trim(F.regexp_replace(c, r"[\s  -​　]+", " "))


def punctuation(c: Column, remove: bool = False) -> Column:
    """Typographic quotes and dashes to plain ones, or all punctuation to spaces."""
    if remove:
        return F.regexp_replace(c, r"\p{Punct}+", " ")
    return F.translate(c, "‘’“”‐‑‒–—−", "''\"\"------")


def normalise(c: Column, remove_punctuation: bool = False, lower: bool = False, accents: bool = False, unicode: bool = True) -> Column:
    """The normaliser: compatibility form, punctuation, accents, spaces, case; empty text becomes null."""
    c = unicode_form(c) if unicode else c
    c = punctuation(c, remove_punctuation)
    c = unicode_form(c, "NFD", True) if accents else c
    c = spaces(c)
    return F.nullif(F.lower(c) if lower else c, F.lit(""))


def substitute(c: Column, rules: list[tuple[str, str]], ignore_case: bool = False) -> Column:
    """Replacements one after the other."""
    for pattern, value in rules:
        c = F.regexp_replace(c, f"(?i){pattern}" if ignore_case else pattern, value)
    return c


def phonetic(c: Column) -> Column:
    """Soundex codes of a text's words, joined without a gap."""
    plain = F.filter(F.split(unicode_form(c, "NFD", True), "[^A-Za-z]+"), lambda w: w != "")
    return F.array_join(F.transform(plain, lambda w: F.soundex(w)), "")


def prefixes(c: Column, least: int, most: int) -> Column:
    """The prefixes of least + 1 to most + 1 characters that are shorter than the text."""
    return F.filter(F.transform(F.sequence(F.lit(least + 1), F.lit(most + 1)), lambda n: F.substring(c, F.lit(1), n)), lambda p: F.length(p) < F.length(c))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    n = F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(0), n), lambda k: F.when(F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k), k).otherwise(0))
    return F.array_max(same)


def prefix_fidelity(a: Column, b: Column) -> Column:
    """Common prefix over the longer length, 1 for two empty texts; null if either is null."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a.isNull() | b.isNull(), None).when(longest == 0, 1.0).otherwise(common_prefix(F.lower(a), F.lower(b)) / longest)


def prefix_equal(a: Column, b: Column, least: int = 4) -> Column:
    """Whether one is a prefix of the other and the shorter one has ``least`` characters."""
    n = F.least(F.length(a), F.length(b))
    return (n >= least) & (F.lower(F.substring(a, F.lit(1), n)) == F.lower(F.substring(b, F.lit(1), n)))


def given(c: Column) -> Column:
    """Null for texts that say that there is no value."""
    c = F.nullif(spaces(c), F.lit(""))
    return F.when(F.lower(c).isin(*NOT_GIVEN), None).otherwise(c)


def phrase(c: Column) -> Column:
    """A phrase name's comparison form: without s.n., letters and digits only, upper case."""
    return F.upper(F.regexp_replace(F.regexp_replace(c, r"(?i)\bs\.\s*n\.", ""), r"[^\p{L}\p{N}]+", ""))


def ngrams(c: Column, least: int, most: int) -> Column:
    """The distinct runs of ``least`` to ``most`` characters; a shorter text stands for itself."""
    c = F.lower(c)
    at = lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda k: F.substring(c, k, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(c) < least, F.array(c)).otherwise(F.array_distinct(F.concat(*[at(n) for n in range(least, most + 1)])))


def spelling_variants(c: Column) -> Column:
    """A common name, without possessives, with dashes as spaces, and without dashes."""
    return F.array_distinct(F.array(c, F.replace(c, F.lit("'"), F.lit("")), F.replace(c, F.lit("-"), F.lit(" ")), F.replace(c, F.lit("-"), F.lit(""))))
