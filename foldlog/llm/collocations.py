"""Phrase mining by dynamic itemset counting over shards of the documents.

Documents are dealt into shards, which are scanned in a cycle, one a step. Words are counted from step 1. After each step
phrases whose count so far reaches the threshold are marked with the next step's number; a longer phrase is active
from the later of the marks of its two subphrases (all but the last word, all but the first), is counted in the next
`shards` steps, one full cycle from wherever it began, and is then complete and exact. So one scan counts words,
pairs and triples at once, and the search ends when no phrase is active.

Marks are kept by slots of a hash, in arrays of fixed size that every task holds: a phrase's mark is its slot's, set by
the first frequent phrase in it. So each task knows, without a join, which phrases are active and since when, and
every phrase is counted over exactly one cycle. Slots that phrases share only let some infrequent ones be counted as well; those
stay below the threshold. As slots fill, more such phrases are counted, and the result is the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldlog.llm.common import small_batches
from foldlog.session import cut, discard, keep

SHARDS = 2
#: log2 of the slots for words, and for longer phrases: one byte each, in every Python worker.
SLOTS = (22, 24)
#: Bytes of text that are counted together in a task.
CHUNK = 5 << 20
#: Bits of one bitmap of Spark's bitmap functions.
BITMAP = 32_768
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: A counted phrase is one text: a character for the step it started in, the language, a tab (no word holds one), its words.
NUMBERS = "key string, c long"
FIRST = 33


def word_hashes(lang: str, words: list[str]) -> np.ndarray:
    seed = zlib.crc32(lang.encode())
    return np.fromiter((zlib.crc32(w.encode(), seed) for w in words), np.uint64, len(words))


def longer(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of phrases with one more word."""
    x = hashes * SPREAD + word + np.uint64(1)
    return x ^ (x >> np.uint64(29))


def slot_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Places in an array of slots, whose size is a power of two."""
    return (hashes * SPREAD >> np.uint64(65 - size.bit_length())).astype(np.int64)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words in order with "\\n" for each end of a piece, and each one's text. A-Z are lower-cased."""
    low = pc.replace_substring(pc.ascii_lower(texts), "\t", " ")
    parts = pc.split_pattern(pc.replace_substring_regex(low, "[.,;:!?\\x0A-\\x0D]", " \n "), " ")
    flat, owner = pc.list_flatten(parts), pc.list_parent_indices(parts)
    some = pc.not_equal(flat, "")
    return flat.filter(some), owner.filter(some).to_numpy(zero_copy_only=False)


def phrase_counts(lang: str, texts: pa.Array, step: int, shards: int, marks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of these texts that are active in this step; marks[n] are the slots of phrases of n words."""
    flat, owner = tokens(texts)
    coded = flat.dictionary_encode()
    names = coded.dictionary
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(code):
        return
    end = pc.index(names, "\n").as_py()
    is_word = code != end

    def batch(n: int, first: np.ndarray, since: np.ndarray, how_often: np.ndarray) -> pa.RecordBatch:
        words = [names.take(pa.array(code[first + k])) for k in range(n)]
        phrase = words[0] if n == 1 else pc.binary_join_element_wise(*words, " ")
        starts = pa.array([f"{chr(FIRST + k)}{lang}" for k in range(step + 1)], pa.string()).take(pa.array(since))
        return pa.RecordBatch.from_arrays([pc.binary_join_element_wise(starts, phrase, "\t"), pa.array(how_often.astype(np.int64))], ["key", "c"])

    def counted(n: int, at: np.ndarray, since: np.ndarray) -> pa.RecordBatch:
        key = code[at]
        for k in range(1, n):
            if k > 1:
                key = pd.factorize(key)[0].astype(np.int64)  # so that keys stay within 64 bits
            key = key * len(names) + code[at + k]
        ids, _ = pd.factorize(key)
        how_often = np.bincount(ids)
        first = np.empty(len(how_often), np.int64)
        first[ids[::-1]] = np.arange(len(ids))[::-1]
        return batch(n, at[first], since[first], how_often)

    at = np.flatnonzero(is_word)
    if step <= shards and len(at):
        yield counted(1, at, np.ones(len(at), np.int64))
    word = word_hashes(lang, names.to_pylist())[code]
    hashes, mark = word, np.where(is_word, marks[1][slot_of(word, len(marks[1]))], 0)
    for n in range(2, len(marks) + 1):
        m = len(mark) - 1
        if m < 1:
            return
        whole = (mark[:m] > 0) & (mark[1:] > 0) & (owner[: m] == owner[n - 1 : m + n - 1])
        since = np.where(whole, np.maximum(mark[:m], mark[1:]), 0).astype(np.int64)
        at = np.flatnonzero((since > 0) & (since <= step) & (step < since + shards))
        if len(at):
            yield counted(n, at, since[at])
        if n < len(marks):
            hashes = longer(hashes[:m], word[n - 1 : m + n - 1])
            mark = np.where(whole, marks[n][slot_of(hashes, len(marks[n]))], 0)


def packed(marks: list[np.ndarray]) -> list[bytes]:
    """Mostly empty slots take little room on the disks that broadcasts pass through."""
    return [zlib.compress(x.tobytes(), 1) for x in marks]


def step_counts(shard: DataFrame, step: int, shards: int, marks) -> DataFrame:
    """Counts (key, c) of one step, a row for each task's chunk of texts; marks: arrays, broadcast as packed()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        slots = [np.frombuffer(zlib.decompress(x), np.uint8) for x in marks.value]

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            for lang in pc.unique(rows["lang"]).to_pylist():
                of_lang = rows.filter(pc.equal(rows["lang"], lang))["text"].combine_chunks()
                parts = of_lang.chunks if isinstance(of_lang, pa.ChunkedArray) else [of_lang]
                for texts in parts:
                    for out in phrase_counts(lang, texts, step, shards, slots):
                        for k in range(0, out.num_rows, 50_000):
                            yield out.slice(k, 50_000)

        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= CHUNK:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return shard.mapInArrow(run, NUMBERS)


def new_marks(frequent: DataFrame, sizes: list[int]) -> dict[int, np.ndarray]:
    """By n, the slots that the frequent phrases (lang, n, phrase) fall into; they come to the driver as bitmaps of bounded size."""

    @F.pandas_udf("long")
    def slot(lang: pd.Series, phrase: pd.Series) -> pd.Series:
        out = np.empty(len(phrase), np.int64)
        for k, (one, said) in enumerate(zip(lang, phrase)):
            words = word_hashes(one, said.split(" "))
            h = reduce(lambda h, w: longer(h, words[w : w + 1]), range(1, len(words)), words[:1])
            out[k] = slot_of(h, sizes[len(words)])[0]
        return pd.Series(out)

    bits = frequent.where(F.col("n") < len(sizes)).select("n", slot("lang", "phrase").alias("slot")).groupBy("n", F.floor(F.col("slot") / BITMAP).alias("part")).agg(F.expr(f"bitmap_construct_agg(slot % {BITMAP})").alias("bits"))
    found: dict[int, list[np.ndarray]] = {}
    for r in bits.collect():
        set_bits = np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little"))
        found.setdefault(r.n, []).append(set_bits + r.part * BITMAP)
    return {n: np.concatenate(parts) for n, parts in found.items()}


def told(counts: DataFrame) -> DataFrame:
    """(key, c) with the parts of the key: lang, n, phrase."""
    phrase, rest = F.substring_index("key", "\t", -1), F.col("key").substr(F.lit(2), F.char_length("key"))
    n = F.char_length(phrase) - F.char_length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1
    return counts.select("key", "c", F.left(rest, F.char_length(rest) - F.char_length(phrase) - 1).alias("lang"), n.alias("n"), phrase.alias("phrase"))


def frequent_phrases(docs: DataFrame, threshold: int, longest: int, shards: int = SHARDS, slots: tuple[int, int] = SLOTS) -> tuple[DataFrame, DataFrame]:
    """((lang, n, phrase, f) of all phrases of up to `longest` words that occur `threshold` times, (lang, n) of all words)."""
    spark = docs.sparkSession
    small_batches(spark)
    dealt = keep(docs.select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).alias("shard")), "shard")
    sizes = [0, *(1 << slots[n > 1] for n in range(1, longest))]
    marks = [np.zeros(size, np.uint8) for size in sizes]
    complete, words, pending, step, last = [], None, None, 0, shards
    while step < last:
        step += 1
        held = spark.sparkContext.broadcast(packed(marks))
        counts = step_counts(dealt.where(F.col("shard") == (step - 1) % shards).select("lang", "text"), step, shards, held)
        counts = counts if pending is None else counts.unionByName(pending)
        before, summed = pending, keep(counts.groupBy("key").agg(F.sum("c").alias("c")))
        over = F.ascii("key") - FIRST + (shards - 1) <= step
        table = told(summed)
        complete.append(cut(table.where(over & (F.col("c") >= threshold)).select("lang", "n", "phrase", F.col("c").alias("f"))))
        if step == shards:
            words = cut(table.where("n = 1").groupBy("lang").agg(F.sum("c").alias("n")))
        for n, found in new_marks(table.where(F.col("c") >= threshold), sizes).items():
            fresh = found[marks[n][found] == 0]
            marks[n][fresh] = step + 1
            if len(fresh):
                last = max(last, step + shards)
        held.destroy()
        if before is not None:
            discard(before)
        pending = summed.where(~over)
    discard(pending)
    discard(dealt)
    return reduce(DataFrame.unionByName, complete), words


def collocations(df: DataFrame, threshold: int = 10, longest: int = 3, top: int = 2000, inside: int = 50, shards: int = SHARDS, slots: tuple[int, int] = SLOTS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to `longest` words of each language.

    a, l, r: occurrences of the phrase, and of its two parts at the cut of the lowest floor(10**6 a**2 / (l r)), which
    is the score; n: all words of the language. Phrases that stand in a longer one which occurs at least `inside`
    percent as often are left out. Words, and the ends of pieces, are those of tokens(). Exact for counts below 10**16. A null
    text is empty, a null language `und`; ids only deal documents to shards, so null and repeated ids count each
    row. Texts of any length are read whole. Ties of score go to the larger a, then the lesser phrase in bytes. Extra
    columns are not carried. Empty in, empty out.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), F.coalesce(lang_col, F.lit("und")).alias("lang"))
    known, words = frequent_phrases(docs, threshold, longest, shards, slots)
    part = lambda first, count: F.array_join(F.slice(F.split("phrase", " "), first, count), " ")
    longer_ones = known.where("n > 1")
    cuts = longer_ones.select("lang", "n", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.select("lang", "n", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("n") - F.col("k")).alias("right"))
    sides = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    ratio = F.expr("CAST(1000000 AS DECIMAL(7,0))") * (wide("a") * wide("a"))
    scored = sides.withColumns({"over": ratio.cast("decimal(38,0)"), "under": (wide("l") * wide("r")).cast("decimal(38,0)")}).withColumn("score", F.expr("over div under"))
    lowest = scored.groupBy("lang", "n", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "n", "phrase", "a", "m.l", "m.r", "m.score")
    holds = longer_ones.where("n > 2").select("lang", F.col("f").alias("whole"), F.explode(inner_phrases(F.col("phrase"))).alias("phrase"))
    most = holds.groupBy("lang", "phrase").agg(F.max("whole").alias("whole"))
    free = lowest.join(most, ["lang", "phrase"], "left").where(F.coalesce(F.col("whole") * 100 < F.col("a") * inside, F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = free.select("lang", "phrase", "a", "l", "r", "score", F.row_number().over(order).cast("long").alias("rank")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def inner_phrases(phrase: Column) -> Column:
    """The distinct shorter phrases of at least two words that stand in a phrase."""
    words = F.split(phrase, " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size(words) - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    return F.array_distinct(spans)
