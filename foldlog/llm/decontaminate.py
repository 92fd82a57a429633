"""Benchmark decontamination with SimHash windows, in DataFrame functions alone.

Documents and benchmark items become 5-word shingles. A window of a document, as long as an item, can only be
similar to it if it holds one of its shingles, and the best such window may start at one: moving the start to the
first shared shingle loses none and keeps the length (at a text's end the window moves back to fit). At least `percent` in a hundred
of the window's places must then hold shingles of items of that length, so other starts are dropped. Windows are compared with
items of their own length only.

Each window's and item's shingles, weighted by how often they stand in it, make TABLES independent 64-bit SimHashes.
Fingerprints are cut into four 16-bit blocks; two that differ in at most RADIUS = 15 bits have a block with at most three
differing bits, so items are indexed under every such value of each block, and no pair within the radius is missed.
At similarity 0.8 fingerprints differ in about 10 bits, and in more than the radius about once in 50, so in both tables
about once in 2,500. Candidates are then compared by the exact weighted Jaccard similarity of their shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlog.llm.common import free_name, row_key
from foldlog.session import cut

WIDTH, PERCENT = 5, 80
RADIUS, BLOCKS, TABLES = 15, 4, 2
#: Distinct benchmark shingles up to which they go to every task as a list; beyond it documents are joined with them.
LISTED = 50_000

_named = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)  # noqa: E731  names an expression, so that it is computed once


def shingles(text: Column, width: int = WIDTH) -> Column:
    """Hashes of the word n-grams in order; of all words together where there are fewer; none without words.

    Words are runs of letters and digits, lower-cased.
    """
    words = F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    grams = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(*(F.element_at(h, i + k) for k in range(width))))
    return _named(words, lambda h: F.when(F.size(h) >= width, grams(h)).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>")))


def numbered(grams: Column) -> Column:
    """A set that stands for the multiset: an element's second, third .. occurrences become elements of their own."""
    count = lambda x, i: F.xxhash64(x, F.size(F.filter(F.slice(grams, 1, i + 1), lambda y: y == x)))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.transform(grams, lambda x: F.xxhash64(x, F.lit(1)))).otherwise(F.transform(grams, count))


def simhash(grams: Column, table: int = 0) -> Column:
    """Bit b is set where more than half of the weight has it set; each table hashes shingles anew."""
    if table:
        return simhash(F.transform(grams, lambda x: F.xxhash64(x, F.lit(table))))
    bit = lambda b: F.when(F.aggregate(grams, F.lit(0), lambda s, x: s + F.getbit(x, b).cast("int")) * 2 > F.size(grams), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def blocks(fingerprint: Column) -> Column:
    width = 64 // BLOCKS
    return F.array(*(F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(fingerprint, k * width).bitwiseAND((1 << width) - 1).cast("int").alias("v")) for k in range(BLOCKS)))


def hits(docs: DataFrame, items: DataFrame, listed: int = LISTED) -> DataFrame:
    """(doc_id, grams, at) of the documents that hold a benchmark shingle: all their shingles, and where (from 0)."""
    known = cut(items.select(F.explode("grams").alias("g")).distinct())
    if known.count() <= listed:
        names = sorted(r.g for r in known.collect())
        inside = lambda x: x.isin(names) if names else F.lit(False)
        own = shingles(F.col("text"))
        found = docs.where(F.exists(own, inside)).select("doc_id", own.alias("grams"))
        places = F.filter(F.transform("grams", lambda x, i: F.when(inside(x), i)), lambda i: i.isNotNull())
        return found.withColumn("at", places)
    rows = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    spots = rows.select("row", F.posexplode(shingles(F.col("text"))).alias("i", "g")).join(known, "g", "left_semi")
    spots = spots.groupBy("row").agg(F.sort_array(F.collect_set("i")).alias("at"))
    return rows.join(spots, "row").select("doc_id", shingles(F.col("text")).alias("grams"), "at")


def contamination(df: DataFrame, benchmark: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", listed: int = LISTED) -> DataFrame:
    """(id, item, similarity, start_word, n_words): each document and item of which some window is similar enough.

    similarity is the best exact weighted Jaccard similarity of windows of the item's length (of the whole text, where it is shorter), at least percent/100;
    start_word (from 0) the first such window. Nulls and empty texts hold no shingle and match nothing. A text or item of fewer
    than five words is one shingle, and matches only its like. Texts of any length are read whole. Ties go to
    the first window; repeated rows are one result. Benchmark and documents may be empty. Extra columns are
    not carried.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = cut(benchmark.select(F.col(item_col).alias("item_id"), shingles(F.col("text")).alias("grams")).where(F.size("grams") > 0))
    held = cut(hits(docs, items, listed).withColumn("h", F.monotonically_increasing_id()))
    sizes = items.select(F.size("grams").alias("n"), F.explode("grams").alias("g")).distinct()
    # small structs are exploded alone: no place carries the document's shingles
    spots = held.select("h", F.explode(F.transform("at", lambda i: F.struct(i.alias("i"), F.col("grams")[i].alias("g")))).alias("x")).select("h", "x.*")
    places = spots.join(sizes, "g").groupBy("h", "n").agg(F.sort_array(F.collect_set("i")).alias("p"))
    least = F.ceil(F.col("n") * percent / 100).cast("int")
    enough = F.filter("p", lambda x, j: F.coalesce(F.get("p", j + least - 1) < x + F.col("n"), F.lit(False)))
    starts = places.select("h", "n", F.explode(enough).alias("i")).join(held.select("h", "doc_id", "grams"), "h")
    starts = starts.withColumn("i", F.least("i", F.greatest(F.lit(0), F.size("grams") - F.col("n")))).select("doc_id", "n", "i", F.slice("grams", F.col("i") + 1, F.col("n")).alias("grams"))
    # SimHash and comparison once for each distinct window, however many copies hold it
    windows = cut(starts.withColumn("w", F.xxhash64("grams")))
    tables = F.array(*(F.struct(F.lit(t).alias("t"), simhash(F.col("grams"), t).alias("f")) for t in range(TABLES)))
    prints = cut(windows.dropDuplicates(["w", "n"]).select("w", "n", "grams", tables.alias("fs")))
    item_prints = cut(items.withColumns({"n": F.size("grams"), "fs": tables}))
    near = F.expr(f"filter(sequence(0, {(1 << 64 // BLOCKS) - 1}), x -> bit_count(x) <= {RADIUS // BLOCKS})")
    split = lambda df, *kept: df.select(*kept, F.explode("fs").alias("x")).select(*kept, "x.*").select(*kept, "t", "f", F.explode(blocks(F.col("f"))).alias("b")).select(*kept, "t", "f", "b.k", "b.v")
    index = split(item_prints, "item_id", "n").withColumnRenamed("f", "e").select("item_id", "n", "t", "e", "k", "v", F.explode(near).alias("x"))
    index = index.withColumn("v", F.col("v").bitwiseXOR(F.col("x"))).drop("x")
    # Spark sizes the index without its explosion: it is joined by sorting, never broadcast
    within = split(prints, "w", "n").join(index.hint("merge"), ["n", "t", "k", "v"]).where(F.bit_count(F.col("f").bitwiseXOR(F.col("e"))) <= RADIUS)
    pairs = within.select("w", "n", "item_id").distinct()
    both = pairs.join(prints.select("w", "n", F.col("grams").alias("a")), ["w", "n"]).join(items.select("item_id", F.col("grams").alias("b")), "item_id")
    sets = both.select("w", "n", "item_id", numbered(F.col("a")).alias("a"), numbered(F.col("b")).alias("b"))
    told = sets.select("w", "n", "item_id", F.size("a").alias("x"), F.size("b").alias("y"), F.size(F.array_intersect("a", "b")).alias("o"))
    similar = told.where(f"100 * o >= {percent} * (x + y - o)").select("w", "n", "item_id", (F.col("o") / (F.col("x") + F.col("y") - F.col("o"))).alias("similarity"))
    found = windows.select("doc_id", "i", "n", "w", F.size("grams").alias("length")).join(similar, ["w", "n"])
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("i")).alias("back"), "length")).alias("m"))
    return best.select(F.col("doc_id").alias(id_col), F.col("item_id").alias(item_col), "m.similarity", (-F.col("m.back")).cast("int").alias("start_word"), (F.col("m.length") + WIDTH - 1).alias("n_words"))


def decontaminate(df: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of df whose text holds no benchmark item; all columns, of any names.

    Rows are judged by id and text together, so null and repeated ids do no harm, and repeated rows go or stay together.
    Null and empty texts stay. Texts of any length are read whole. An empty table or benchmark drops nothing.
    """
    row = free_name(df, "_row")
    found = contamination(df.select(row_key().alias("row"), "text"), benchmark, percent, id_col="row").select(F.col("row").alias(row)).distinct()
    return df.withColumn(row, row_key()).join(found, row, "left_anti").select(*df.columns)
