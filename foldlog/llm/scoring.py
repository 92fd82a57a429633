"""Language-model scores of whole texts: a unigram base over exact counts, and a gated recurrent model (gru.py).

Counts cover every training document. The most frequent words, LISTED at most, go to every task with their counts;
words outside the list are looked up by a join, so every count is exact. The recurrent model knows gru.SIZE - 1 words and
the end of a text; any other word is its class of other words times the word's smoothed share of them. Its weights are fitted on every
word of all training documents. A hash of id and text deals them to rounds, each as large as all before it together, and within a
round to lanes of about LANE words. Each lane learns from the weights of the round before; the mean of the lanes, weighted by
their words, is the next round's start. Lanes depend on ids and texts alone, so the model doesn't depend on partitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from foldlog.llm import gru
from foldlog.llm.common import free_name, held_out, small_batches
from foldlog.session import keep

#: Words whose counts every task holds, at most.
LISTED = 1 << 17
#: Words of training texts, about, that one task learns from before weights are averaged. Up to so many are one lane, read gru.PASSES times at most.
LANE = 2_000_000
#: Weights in a row when lanes are averaged.
PIECE = 1 << 14
#: Bytes of text, or of its numbers, that a task works on at once.
CHUNK = 8 << 20
#: The end of a text among words: no word is empty.
END = ""
LN10 = math.log(10)
READ = "n_tokens long, n_known long, base double, others double, ids binary, rare array<struct<word: string, n: long>>"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words in order, A-Z lower-cased, and each one's text."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # at blanks and \x09 to \x0D
    flat, owner = pc.list_flatten(parts), pc.list_parent_indices(parts)
    some = pc.not_equal(flat, "")
    return flat.filter(some), owner.filter(some).to_numpy(zero_copy_only=False)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together up to CHUNK bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= CHUNK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def column(rows: pa.Table, name: str) -> pa.Array:
    c = rows[name].combine_chunks()
    return c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks)


def token_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts, the end of each text included as END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches):
            flat, _ = words_of(column(rows, "text"))
            found = pc.value_counts(flat)
            word = pa.concat_arrays([found.field("values"), pa.array([END], pa.string())])
            c = pa.concat_arrays([found.field("counts"), pa.array([rows.num_rows], pa.int64())])
            out = pa.RecordBatch.from_arrays([word, c], ["word", "c"])
            for k in range(0, out.num_rows, 50_000):
                yield out.slice(k, 50_000)

    return texts.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """The words above the least count that at most `most` words reach, by falling count, then in order.

    The cut comes from a histogram of counts (exact to 1,024, in steps of 1 % beyond), so words are not sorted in one place.
    """
    step = F.when(F.col("c") <= 1024, F.col("c")).otherwise(1024 + F.floor(F.log(F.col("c") / 1024.0) * 100).cast("long"))
    sizes = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    total, least = 0, None
    for r in sizes:
        total += r["count"]
        if total > most:
            break
        least = r.step
    if least is None:
        return []
    rows = counts.where(step >= least).toPandas()
    return sorted(zip(rows["word"], rows["c"].tolist()), key=lambda x: (-x[1], x[0]))


def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all texts one after the other, and how many are each text's."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    first = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset]) if len(column) else 0
    return np.frombuffer(column.buffers()[2], np.uint8)[first : first + int(size.sum())].view("<u2") if size.any() else np.zeros(0, np.uint16), size // 2


def joined_ids(ids: np.ndarray, owner: np.ndarray, m: int) -> pa.Array:
    """Each of m texts' numbers and its end, 0, as binary."""
    out = np.zeros(len(ids) + m, "<u2")
    out[np.arange(len(ids)) + owner] = ids
    offsets = np.append(0, 2 * np.cumsum(np.bincount(owner, minlength=m) + 1)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def rounds(n: int) -> list[tuple[int, int, int, int]]:
    """(modulus, from, to, lanes): a round's texts are those whose hash modulo the modulus falls in [from, to). Together they are all texts."""
    k = 0 if n <= LANE else math.ceil(math.log2(n / LANE))
    edges = [0, *(1 << j for j in range(k + 1))]
    return [(1 << k, a, b, max(1, round(n * (b - a) / (1 << k) / LANE))) for a, b in zip(edges, edges[1:])]


def lane_learner(start: Broadcast, passes: int, span: tuple[float, float], windows: int | None) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        """(piece, lane, n, own): the weights after one lane's texts, in pieces, and how many words they learned from."""
        texts = [np.frombuffer(x.as_buffer(), "<u2") for x in rows.sort_by([("h", "ascending")])["ids"]]
        own = gru.learn(gru.shaped(start.value), texts, passes, span, windows).flat().astype("<f4")
        pieces = [own[i : i + PIECE].tobytes() for i in range(0, len(own), PIECE)]
        m, lane, n = len(pieces), rows["lane"][0].as_py(), sum(map(len, texts))
        return pa.table([pa.array(range(m), pa.int32()), pa.array([lane] * m, pa.int32()), pa.array([n] * m, pa.int64()), pa.array(pieces, pa.binary())], ["piece", "lane", "n", "own"])

    return run


def piece_means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, own): each piece's mean over its lanes, by words. Rows come by piece, then lane."""
    now, n, total = None, 0, None
    made = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([(total / n).astype("<f4").tobytes()], pa.binary())], ["piece", "own"])
    for batch in batches:
        for r in batch.to_pylist():
            if r["piece"] != now:
                if now is not None:
                    yield made()
                now, n, total = r["piece"], 0, 0.0
            n, total = n + r["n"], total + r["n"] * np.frombuffer(r["own"], "<f4").astype(np.float64)
    if now is not None:
        yield made()


def fitted(texts: DataFrame, n: int, weights: gru.Weights, windows: int | None = None) -> gru.Weights:
    """The weights after all texts (h, ids) of together n words, round after round. windows: at most so many a lane, for trials."""
    sc, plan = texts.sparkSession.sparkContext, rounds(n)
    passes = max(1, min(gru.PASSES, LANE // max(1, n))) if len(plan) == 1 else 1
    pieces = -(-gru.N_WEIGHTS // PIECE)
    for k, (modulus, a, b, lanes) in enumerate(plan):
        start = sc.broadcast(weights.flat())
        part = F.pmod("h", F.lit(modulus))
        dealt = texts.where((part >= a) & (part < b)).select(F.pmod(F.shiftright("h", 32), F.lit(lanes)).cast("int").alias("lane"), "h", "ids")
        learned = dealt.repartition(lanes, "lane").groupBy("lane").applyInArrow(lane_learner(start, passes, (k / len(plan), (k + 1) / len(plan)), windows), "piece int, lane int, n long, own binary")
        means = learned.repartition(min(lanes, pieces), "piece").sortWithinPartitions("piece", "lane").mapInArrow(piece_means, "piece int, own binary").collect()
        if means:  # a round may have no text
            weights = gru.shaped(np.concatenate([np.frombuffer(r.own, "<f4") for r in sorted(means, key=lambda r: r.piece)]))
        start.unpersist()
    return weights


def score_texts(df: DataFrame, folds: int = 7, fold: int = 2, id_col: str = "doc_id", text_col: str = "text", out_col: str = "lm", carry: list[str] | None = None, listed: int = LISTED, windows: int | None = None) -> DataFrame:
    """The columns `carry` of df (all, by default; the id among them) and out_col: STRUCT<held_out, n_tokens, n_known, train_tokens, base_score, score>.

    Rows whose crc32 of the id falls in the fold are held out of counts and training; a null id counts as ''. A null or empty text is
    its end alone. base_score is the sum of log10((c + 1) / (N + V + 1)) over a text's words and end; score the recurrent model's
    log10 probability of the whole text, the state carried from its first word to its end. Texts of any length are
    read whole. Repeated rows score alike; without training rows every count is 0. Columns may have any name; empty in, empty
    out. The input is read twice (counts, numbers of the model); training and scores read the numbers.
    """
    spark = df.sparkSession
    small_batches(spark)
    text = F.coalesce(text_col, F.lit(""))
    is_held_out = held_out(F.col(id_col), folds, fold)
    counts = keep(token_counts(df.where(~is_held_out).select(text.alias("text"))))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = most_frequent(counts, listed)
    ends = next((c for w, c in frequent if w == END), None)
    ends = ends if ends is not None else (counts.where(F.col("word") == END).agg(F.coalesce(F.max("c"), F.lit(0))).first()[0])
    frequent = [(w, c) for w, c in frequent if w != END]
    known = frequent[: gru.SIZE - 1]
    own = np.array([ends, *(c for _, c in known)], np.float64)
    rest, others = int(n - own.sum()), int(v - len(known) - (v > 0))
    listing = spark.sparkContext.broadcast((pa.array([w for w, _ in frequent], pa.string()), np.array([c for _, c in frequent], np.int64)))
    carried = carry or df.columns
    told_col, row, rare_col, text_in, hash_col = (free_name(df, c) for c in ("_told", "_row", "_rare", "_text", "_hash"))
    all_words, all_others = math.log10(n + v + 1), math.log10(rest + others + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, each_count = listing.value
        # after the listed words one place for all others
        logs = np.append(np.log10(each_count + 1.0), 0.0)
        for rows in chunks(batches):
            texts = column(rows, text_in).dictionary_encode()  # copies are read once
            each = texts.dictionary
            flat, owner = words_of(each)
            coded = flat.dictionary_encode()
            names = coded.dictionary
            of_word = pc.fill_null(pc.index_in(names, value_set=words), len(words)).to_numpy(zero_copy_only=False).astype(np.int64)
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            at = of_word[code] if len(code) else code
            m = len(each)
            there, in_model = at < len(words), at < gru.SIZE - 1
            count = lambda mask: np.bincount(owner[mask], minlength=m)
            n_tokens = np.bincount(owner, minlength=m) + 1
            n_known = count(there) + (ends > 0)
            of_listed = np.bincount(owner, logs[at], minlength=m)
            base = of_listed + math.log10(ends + 1) - n_tokens * all_words
            ids = joined_ids(np.where(in_model, at + 1, gru.SIZE), owner, m)
            outside = np.flatnonzero(~in_model)
            in_class = np.bincount(owner[outside], logs[at[outside]] - all_others, minlength=m) + 0.0  # a float, also of nothing
            # what is not listed: each text's words and how often they stand in it
            missing = np.flatnonzero(~there)
            key, often = np.unique(owner[missing].astype(np.int64) * max(1, len(names)) + code[missing], return_counts=True)
            offsets = np.searchsorted(key // max(1, len(names)), np.arange(m + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([names.take(pa.array(key % max(1, len(names)))), pa.array(often.astype(np.int64))], ["word", "n"])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pairs)
            pick = texts.indices.to_numpy(zero_copy_only=False)
            told = [pa.array(x[pick]) for x in (n_tokens.astype(np.int64), n_known.astype(np.int64), base, in_class)]
            told = pa.StructArray.from_arrays([*told, ids.take(pa.array(pick)), lists.take(pa.array(pick))], ["n_tokens", "n_known", "base", "others", "ids", "rare"])
            out = pa.RecordBatch.from_arrays([*(column(rows, c) for c in carried), column(rows, hash_col), told], [*carried, hash_col, told_col])
            for k in range(0, out.num_rows, 256):
                yield out.slice(k, 256)

    shape = StructType([*df.select(*carried).schema, StructField(hash_col, DataType.fromDDL("long")), StructField(told_col, DataType.fromDDL(READ))])
    rows = df.select(*carried, F.when(~is_held_out, F.xxhash64(id_col, text)).alias(hash_col), text.alias(text_in)).mapInArrow(run, shape)
    # numbered as they are written, so that a row's rare words find it again
    read = keep(rows.withColumn(row, F.monotonically_increasing_id()))
    weights = fitted(read.where(F.col(hash_col).isNotNull()).select(F.col(hash_col).alias("h"), F.col(f"{told_col}.ids").alias("ids")), int(n), gru.fresh(own, rest), windows)
    model = spark.sparkContext.broadcast(weights.flat())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = gru.shaped(model.value)
        for rows in chunks(batches):
            texts = column(rows, "ids").dictionary_encode()
            log = gru.log_likelihoods(weights, *ids_of(texts.dictionary)) / LN10
            yield pa.RecordBatch.from_arrays([column(rows, row), pa.array(log[texts.indices.to_numpy(zero_copy_only=False)])], [row, "log"])

    at = lambda c: F.col(f"{told_col}.{c}")
    logs = read.select(row, at("ids").alias("ids")).mapInArrow(score, f"`{row}` long, log double")
    rare = read.select(F.col(row).alias("row"), F.explode(at("rare")).alias("r")).select("row", "r.word", "r.n")
    looked_up = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("logs"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known"))
    told_by_row = logs.join(looked_up, logs[row] == looked_up["row"], "left").select(row, F.struct("log", "logs", "known").alias(rare_col))
    of_row = lambda c, none: F.coalesce(F.col(f"{rare_col}.{c}"), F.lit(none))
    made = F.struct(
        is_held_out.alias("held_out"), at("n_tokens").alias("n_tokens"), (at("n_known") + of_row("known", 0)).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (at("base") + of_row("logs", 0.0)).alias("base_score"), (F.col(f"{rare_col}.log") + at("others") + of_row("logs", 0.0)).alias("score"),
    )
    return read.join(told_by_row, row).select(*[c for c in carried if c.lower() != out_col.lower()], made.alias(out_col))
