"""Document fingerprints by I-Match with randomised lexicon subsets, in DataFrame functions alone.

Terms are lower-cased words; their document frequencies are counted over groups of copies, however many rows
each has: rows count once where SKETCH smallest hashes of their terms agree, as those of exact copies always and
those of near copies mostly do. The band of inverse document frequency keeps terms that at most MOST_SHARE of
the groups hold: what lies outside is at most the mean number of distinct terms of a group, divided by
MOST_SHARE, so that list has a bound that does not grow with the corpus. A text without a term in the band is
told by all its terms. A random deal of the lexicon gives SUBSETS lexicons; each is thinned by powers of two, and a
document uses the two thinnings that leave it about one term in each lexicon, however long it is. Its sorted
distinct terms within each lexicon are hashed: a fingerprint is the two levels' numbers and hashes.

Two fingerprints are alike by the share of lexicons, of those not empty in both, whose hashes agree at the finest
level that both have.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldlog.session import cut

#: Lexicons dealt, and terms wanted in each.
SUBSETS, TERMS = 32, 1
#: The band: groups of copies that hold a term, as a share of all, at most. Rare terms tell documents apart.
MOST_SHARE = 0.1
#: Smallest hashes that copies agree in; terms up to which those that many rows hold are broadcast.
SKETCH, BROADCAST_TERMS = 3, 500_000

_named = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)  # noqa: E731  names an expression, so that it is computed once


def terms(text: Column) -> Column:
    """Hashes of the distinct words."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w)))


def copies_key(held: Column) -> Column:
    """One hash for texts whose terms have the same SKETCH smallest hashes."""
    return F.xxhash64(*(F.array_min(F.transform(held, lambda t: F.xxhash64(t, F.lit(k)))) for k in range(SKETCH)))


def out_of_band(texts: DataFrame, most_share: float = MOST_SHARE) -> list[int]:
    """Hashes of the terms that more than most_share of the groups of copies (and more than one) hold."""
    sketched = texts.select(_named(terms(F.col("text")), lambda held: F.struct(copies_key(held).alias("g"), held.alias("held"))).alias("s"))
    least = max(1, most_share * sketched.select("s.g").distinct().count())
    # no more groups than rows hold a term: only what enough rows hold is counted by groups
    rows = texts.select(F.explode(terms(F.col("text"))).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    often = cut(rows.where(F.col("n") > least).select("t"))
    pairs = sketched.select("s.g", F.explode("s.held").alias("t")).join(F.broadcast(often) if often.count() <= BROADCAST_TERMS else often, "t", "left_semi")
    held = pairs.distinct().groupBy("t").agg(F.count("*").alias("n"))
    return sorted(r.t for r in held.where(F.col("n") > least).select("t").collect())


def fingerprint(text: Column, frequent: list[int]) -> Column:
    """The fingerprint of a text: "level:hash,hash,..;level+1:hash,.." of hexadecimal hashes, '' for an empty lexicon."""
    banded = lambda held: _named(F.filter(held, lambda t: ~t.isin(frequent)), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(held))
    inside = _named(terms(text), banded) if frequent else terms(text)
    level = lambda kept: F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.size(kept), F.lit(1)) / F.lit(SUBSETS * TERMS)))).cast("int")
    thin = lambda t, k: F.pmod(F.shiftright(t, 40), F.call_function("shiftleft", F.lit(1).cast("long"), k)) == 0
    # the lexicon that a term is dealt to stands in its high bits, so that sorting sorts by lexicon, then term
    dealt = lambda t: F.shiftleft(F.pmod(t, F.lit(SUBSETS)), 40).bitwiseOR(F.shiftright(t, 8).bitwiseAND(F.lit((1 << 40) - 1)))
    digest = lambda held: F.when(F.size(held) == 0, F.lit("")).otherwise(F.lower(F.hex(F.xxhash64(held).bitwiseAND(F.lit(0xFFFFFF)))))

    def hashes(kept: Column, k: Column) -> Column:
        thinned = F.sort_array(F.transform(F.filter(kept, lambda t: thin(t, k)), dealt))
        lexicons = lambda held: F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda i: _named(F.filter(held, lambda t: F.shiftright(t, 40) == i), digest))
        return _named(thinned, lambda held: F.array_join(lexicons(held), ","))

    both = lambda kept, k: F.concat(k.cast("string"), F.lit(":"), hashes(kept, k), F.lit(";"), (k + 1).cast("string"), F.lit(":"), hashes(kept, k + 1))
    return _named(inside, lambda kept: _named(level(kept), lambda k: both(kept, k)))


def likeness(a: Column, b: Column) -> Column:
    """Share of lexicons, of those not empty in both, that agree at the finest level both fingerprints have."""
    level = lambda x: F.split(x, ":")[0].cast("int")
    k = F.least(level(a), level(b)) + 1
    part = lambda x: F.split(F.split(F.filter(F.split(x, ";"), lambda p: F.startswith(p, F.concat(k.cast("string"), F.lit(":"))))[0], ":")[1], ",")
    pairs = F.zip_with(part(a), part(b), lambda x, y: F.when((x == "") & (y == ""), None).otherwise((x == y).cast("int")))
    told = F.filter(pairs, lambda x: x.isNotNull())
    share = F.when(F.size(told) > 0, F.aggregate(told, F.lit(0), lambda s, x: s + x) / F.size(told)).otherwise(F.lit(0.0))
    return F.when(a == b, 1.0).when(F.abs(level(a) - level(b)) > 1, 0.0).otherwise(share).cast("double")


#: Rows of one range in which neighbours by id are found, about, and ranges at most: beyond, ranges hold more rows.
RANGE_ROWS, MOST_RANGES = 2_000, 10_000


def id_ranges(docs: DataFrame) -> DataFrame:
    """Adds `bucket` to rows of (doc_id, tie): ranges of about as many rows each, the greatest ids first, null ids last.

    The borders are quantiles of the ids, so outlying ids and clusters do no harm. Null ids, and an id that fills whole
    ranges by itself, are dealt on by their tie, which is spread evenly.
    """
    n = docs.count()
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    as_double = F.col("doc_id").cast("double")
    found = docs.select(as_double.alias("x")).stat.approxQuantile("x", [k / ranges for k in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    hot = sorted(x for x, k in Counter(found).items() if k > 1)
    borders = [-math.inf, *sorted({*(found or [0.0]), *(math.nextafter(x, math.inf) for x in hot)}), math.inf]
    dealt = Bucketizer(splits=borders, inputCol="as_double", outputCol="range", handleInvalid="keep").transform(docs.withColumn("as_double", F.coalesce(as_double, F.lit(float("nan")))))
    place = F.when(F.col("doc_id").isNull(), F.lit(len(borders))).otherwise(F.lit(len(borders) - 1) - F.col("range")).cast("long")
    inside = F.floor((F.lit(2.0**63) - F.col("tie").cast("double")) / 2.0**64 * ranges).cast("long")
    split = F.when(F.col("doc_id").isNull() | (F.col("as_double").isin(hot) if hot else F.lit(False)), inside).otherwise(0)
    return dealt.withColumn("bucket", place * (ranges + 1) + split).drop("as_double", "range")


def with_next(docs: DataFrame) -> DataFrame:
    """Adds next_text and next_print to (doc_id, text, print): of the next document by descending id; after the last, the first.

    Neighbours are found within a range of ids by a window, and the last of a range takes the first of the next range
    that has rows, by a join of one row a range; ranges are bounded in number. Null ids come last, ties are ordered
    by the text's hash.
    """
    placed = id_ranges(docs.withColumn("tie", F.xxhash64("text")))
    firsts = placed.groupBy("bucket").agg(F.max(F.struct("doc_id", "tie")).alias("first"))
    # one row a range: the range before each, which borrows its first text; the last range borrows from the first
    ring = Window.orderBy("bucket")
    around = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    borrows = firsts.select(F.coalesce(F.lag("bucket").over(ring), F.max("bucket").over(around)).alias("by"), F.col("bucket").alias("of"), F.col("first.doc_id").alias("first_id"), F.col("first.tie").alias("first_tie"))
    same = (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie"))
    lent = placed.join(F.broadcast(borrows), same).select(F.col("by").alias("bucket"), F.struct("text", "print").alias("lent")).dropDuplicates(["bucket"])
    w = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), F.desc("tie"))
    inside = placed.withColumn("follow", F.lead(F.struct("text", "print")).over(w)).join(lent, "bucket", "left").withColumn("follow", F.coalesce("follow", "lent"))
    return inside.select("doc_id", "text", "print", F.col("follow.text").alias("next_text"), F.col("follow.print").alias("next_print"))


def imatch(df: DataFrame, most_share: float = MOST_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row.

    The edited text: the last floor(n_chars/3) code points replaced by the first as many (or all) of the next
    document's text, by descending id (after the last: the first). near_edited is the likeness of the fingerprint
    to the edited text's, near_next to the next document's. Equal texts have equal fingerprints and likeness 1.
    Nulls: a null text counts as empty; without terms all lexicons are empty, such a fingerprint is like its
    equal alone. Null ids come behind all others. Texts of any length are read whole; repeated rows
    stay rows and are each other's neighbours. Extra columns are not carried. Empty in, empty out.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    frequent = out_of_band(docs, most_share)
    rows = with_next(docs.withColumn("print", fingerprint(F.col("text"), frequent)))
    edited = F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 3) as int))"), F.expr("left(next_text, cast(floor(char_length(text) / 3) as int))"))
    made = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), edited.alias("edited"), "print", "next_print")
    prints = made.select("*", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited"), frequent).alias("edited_fingerprint"))
    return prints.select(F.col("doc_id").alias(id_col), "n_chars", "edited_sha256", F.col("print").alias("fingerprint"), "edited_fingerprint", likeness(F.col("print"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"))
