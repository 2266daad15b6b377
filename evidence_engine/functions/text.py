"""Text predicates and tokenisers as Column expressions; the regular expressions are the same in Java and RE2."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns.
ASCII_WORD, CJK_RUN, DIGITS = "[a-z][a-z0-9_]*", "[一-龥]{2,6}", "[0-9]+"
QUERY_TERM = "[A-Za-z_][A-Za-z0-9_]{2,}|[A-Z]{2,}|[一-龥]{2,6}"
CLAIM_TERM = "[A-Za-z_][A-Za-z0-9_]{2,}|[一-龥]{2,6}"


def all_of(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def tokens(text: Column) -> Column:
    """BM25 tokens: ASCII words of the lower-cased text, runs of 2 to 6 CJK characters, numbers; with repeats."""
    return F.concat(all_of(F.lower(text), ASCII_WORD), all_of(text, CJK_RUN), all_of(text, DIGITS))


def query_terms(text: Column, most: int = 10) -> Column:
    """The first distinct terms of a query."""
    return F.slice(F.array_distinct(all_of(text, QUERY_TERM)), 1, most)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def contains_any(text: Column, words: Collection[str]) -> Column:
    """Whether text holds one of the words; the caller folds case. One pattern, so a long list is no long expression."""
    return text.rlike("|".join(re.escape(w) for w in words)) if words else F.lit(False)


def count_of(text: Column, words: Iterable[str]) -> Column:
    """How many of the words text holds."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def hits(terms: Column, text: Column) -> Column:
    """How many of an array's terms, case folded, stand in text, which is lower-cased."""
    return F.size(F.filter(terms, lambda t: F.contains(text, F.lower(t))))


def scaled(x: Column) -> Column:
    """A score as millionths: the same integer in every engine, where doubles differ in their last bits."""
    return F.floor(x * 1e6 + 0.5).cast("bigint")


def pieces_of(text: Column, size: int) -> Column:
    """All pieces of `size` characters of a text; none of a shorter one."""
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
