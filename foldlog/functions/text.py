"""Column functions over text: whitespace, sentences, words, keywords, set scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token patterns and word lists that results depend on.
TOKEN = r"[A-Za-z0-9_.:/+=-]+"
WORD = r"[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*"
SENTENCE = r"[^.!?]+[.!?]?"
#: Everything that ends a line in Python's str.splitlines().
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"

_empty = lambda c: F.coalesce(c, F.lit(""))


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), for a value that `of` uses in functions of elements: it is computed once a row, not once an element."""
    return F.element_at(F.transform(F.array(value), of), 1)


def one_space(text: Column) -> Column:
    """Runs of white space become one space; none at the ends. Null counts as empty."""
    return F.trim(F.regexp_replace(_empty(text), r" \s+|[\t-\r]\s*", " "))


def normalized(text: Column) -> Column:
    """one_space() in lower case, the form in which evidence is compared."""
    return F.lower(one_space(text))


def token_count(text: Column) -> Column:
    """How many technical tokens a text holds."""
    return F.regexp_count(_empty(text), F.lit(TOKEN)).cast("long")


def word_count(text: Column) -> Column:
    return F.regexp_count(_empty(text), F.lit(WORD)).cast("long")


def words(text: Column) -> Column:
    """Lower-case words, in order."""
    return F.transform(F.regexp_extract_all(_empty(text), F.lit(WORD), F.lit(0)), F.lower)


def sentences(text: Column) -> Column:
    found = F.regexp_extract_all(one_space(text), F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def keywords(text: Column, stop: list[str], least: int = 1) -> Column:
    """Distinct words in order of first appearance, without stop words and words shorter than `least`."""
    every = F.transform(F.array_distinct(F.regexp_extract_all(_empty(text), F.lit(WORD), F.lit(0))), F.lower)
    return F.array_distinct(F.filter(every, lambda w: ~w.isin(stop) & (F.char_length(w) >= least) if least > 1 else ~w.isin(stop)))


def limited(values: Column, limit: int) -> Column:
    """The first `limit` distinct values, sorted."""
    return F.sort_array(F.slice(F.array_distinct(values), 1, limit))


def coverage(reference: Column, observed: Column, empty: float) -> Column:
    """Share of reference items that were observed, repeats counted; `empty` where the reference is empty."""
    held = F.size(F.filter(reference, lambda x: F.array_contains(observed, x)))
    return F.when(F.size(reference) == 0, F.lit(empty)).otherwise(held / F.size(reference)).cast("double")


def jaccard(left: Column, right: Column) -> Column:
    """Shared over all distinct items; 1 where both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(left, right)) / union).cast("double")


def overlap(original: Column, other: Column) -> Column:
    """Share of distinct original items among the other's; 0 where there are none."""
    n = F.size(F.array_distinct(original))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(original, other)) / n).cast("double")


def difference(left: Column, right: Column) -> Column:
    """Distinct items of left alone, sorted."""
    return F.sort_array(F.array_except(left, right))


def shared(left: Column, right: Column) -> Column:
    return F.sort_array(F.array_intersect(left, right))


def joined(values: Column, sep: str = ",") -> Column:
    return F.array_join(values, sep)


def redacted(lines: Column, pattern: str, mask: str = "[redacted]") -> Column:
    """Lines, those that match replaced as a whole."""
    return F.transform(lines, lambda x: F.when(x.rlike(pattern), F.lit(mask)).otherwise(x))
