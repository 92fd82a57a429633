"""Exact self-join of documents by Jaccard similarity of their word n-grams, and its components.

Token-combination prefixes. A token is the 64-bit hash of an n-gram; a document is its set of tokens.

* Tokens whose hash is in the lowest part (zone()) are counted over all documents. A token is unique if one set holds
  it, rare if at most RARE do, frequent if more do or it was not counted. Every set is ordered unique, rare, frequent
  tokens, each by hash. Two similar sets share a token of their prefixes; while a prefix holds no frequent token each
  of its rare ones is indexed singly. Unique tokens take their place in the prefix but need no entry, so that most
  documents without a near copy have none.
* A set whose prefix runs into frequent tokens extends it over all of them and indexes combinations of k = 2: the
  pairs that follow each other in hash order. A token that two sets do not share breaks at most two pairs of its own
  set and one of the other's, so two similar sets also share pairs, and a prefix of the pairs (by their hash) is
  enough again. That is 2 (1 - t) n + 1 pairs for n tokens at threshold t; all pairs of the extended prefix would be
  some ((1 - t) n)^2 / 2 (180,300 for 3,000 tokens at 0.8 instead of 1,201).

No pair of similar sets is lost. If one prefix holds no frequent token, the shared token is rare and indexed by both.
Else both sets index all their rare tokens: they share one, or none, and then all they share is frequent, and a pair
is shared.

Entries of at most PAIRED sets are paired. The members of larger ones are compared with one of them, the pivot, and
linked to it where similar. Members of one pivot that are then still in different components are compared with each
other within the join itself, in blocks of BLOCK sets: by component, size, distance from the pivot (the symmetric
difference of sets obeys the triangle inequality) and a 512-bit parity signature. So what linked with the pivot is
never paired, and pairs that cannot link are never emitted; but comparisons of members in different components grow
with the square of their number. Candidates pass a longer parity bitmap (sets that differ in d tokens differ in at
most d bits, so nothing is lost), then the sets themselves are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlog.llm.common import batch_rows, free_name
from foldlog.llm.components import components
from foldlog.session import cut, discard, keep

#: A token is frequent if more sets than this hold it. Doubled until no more than LISTED tokens are, as their list
#: (8 bytes each) goes to every task.
RARE, LISTED = 8, 1_000_000
#: Entries of at most so many sets are paired; larger ones go by pivots, in blocks of BLOCK.
PAIRED, BLOCK = 32, 512
#: Tokens that a task gathers before it counts them.
COUNTED = 500_000
#: Bits of the bitmaps that say which tokens are not unique and which documents a later pass reads: 32 for each, 2**26
#: (8 MB) at most. Where that is not enough more tokens are indexed, or documents read, than need be.
MARK_BITS = 26

U = np.uint64
_word = xxhash.xxh64_intdigest


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words; h: the words' hashes."""
    n = len(h) - k + 1
    out = np.full(n, k, dtype=U)
    for j in range(k):
        out = mix(out * U(0x9E3779B97F4A7C15) + h[j : n + j])
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def token_sets_of(texts: list[str | None], width: int) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its `width`-word n-grams.

    A shorter text has the whole sequence as its one n-gram, a text without words none. A-Z are lower-cased; words
    are runs of anything but space, tab, line feed, vertical tab, form feed, return.
    """
    split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = [len(w) for w in split]
    h = np.fromiter((_word(w) for words in split for w in words), dtype=U, count=sum(sizes))
    grams = _grams(h, width) if len(h) >= width else None
    out, at = [], 0
    for n in sizes:
        if n >= width:
            out.append(_distinct(grams[at : at + n - width + 1]))
        else:
            out.append(_grams(h[at : at + n], n) if n else np.empty(0, dtype=U))
        at += n
    return out


def prefix(n: int, percent: int) -> int:
    """Tokens of a set of n, in any order, of which a similar set must hold one in its own."""
    return n - -(-percent * n // 100) + 1


def zone(percent: int) -> float:
    """The part of all tokens, by hash, that is counted: two and a half prefixes."""
    return min(1.0, (100 - percent) / 40)


def smallest_paired(percent: int) -> float:
    """Sets of at most this size may share no pair with a similar set; infinite where none need to."""
    if 2 * percent <= 100:
        return math.inf
    most = 300 // (2 * percent - 100) + 2
    return max((n for n in range(1, most + 1) if n - 1 - 2 * (100 - percent) * n // 100 < 1), default=0)


def index_keys(t: np.ndarray, unique: np.ndarray, frequent: np.ndarray, percent: int, small: float) -> np.ndarray:
    """Keys under which a set is indexed. unique, frequent: for each token, whether it is; small: smallest_paired(percent)."""
    n = len(t)
    rare = t[~(unique | frequent)]
    left = prefix(n, percent) - int(unique.sum())
    if len(rare) >= left:
        return rare[: max(0, left)]
    left -= len(rare)
    often, out = t[frequent], [rare]
    if n * percent <= 100 * small:
        out.append(often[:left])
    if n > small:
        pairs = np.sort(mix(mix(often[:-1]) + often[1:]))
        out.append(pairs[: 2 * (100 - percent) * n // 100 - 2 * (n - len(often)) + 1])
    return np.concatenate(out)


def set_number(t: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(t.tobytes()) - (1 << 63)


def parity(t: np.ndarray) -> np.ndarray:
    """Bit b: whether an odd number of tokens fall to b. Twice as many bits as tokens, rounded up to a power of two."""
    bits = max(64, 1 << (2 * len(t) - 1).bit_length())
    odd = np.bincount((t & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def signature(t: np.ndarray) -> np.ndarray:
    """The parity bitmap of 512 bits."""
    return np.packbits((np.bincount((t & U(511)).astype(np.int64), minlength=512) & 1).astype(np.uint8), bitorder="little").view(np.int64)


class Marks:
    """A bitmap of 64-bit hashes that the driver gathers and tasks test; no false absences."""

    def __init__(self, hashes: DataFrame) -> None:
        """hashes: one column of longs."""
        h = F.col(hashes.columns[0])
        hashes = hashes.where(h.isNotNull()).distinct()
        self.bits = min(MARK_BITS, max(10, (32 * hashes.count()).bit_length()))
        at = F.pmod(h, F.lit(1 << self.bits))
        words = hashes.select(F.floor(at / 64).cast("int").alias("word"), (at % 64).cast("int").alias("bit"))
        words = words.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("w")).toArrow()
        table = np.zeros((1 << self.bits) // 64, dtype=np.int64)
        table[words["word"].to_numpy()] = words["w"].to_numpy()
        self.table = table.view(np.uint8).tobytes()

    def test(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.astype(np.int64) & ((1 << self.bits) - 1)
        return (np.frombuffer(self.table, dtype=np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def hold(self, hashed: Column) -> Column:
        @F.pandas_udf("boolean")
        def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                yield pd.Series(self.test(b.to_numpy()))

        return held(hashed)


def id_hash(column: str) -> Column:
    """A null id has a hash too."""
    return F.xxhash64(F.col(column).isNull(), column)


class Kinds:
    """Which tokens are unique and which frequent, from counts of the zone's tokens over all documents."""

    def __init__(self, docs: DataFrame, width: int, percent: int) -> None:
        edge = self.edge = U(min(2**64 - 1, int(zone(percent) * 2**64)))

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: set[int] = set()
            held, n = [], 0

            def counted() -> pd.DataFrame:
                c, k = np.unique(np.concatenate(held), return_counts=True)
                return pd.DataFrame({"c": c.astype(np.int64), "n": k.astype(np.int64)})

            for b in batches:
                for t in token_sets_of(b["text"].tolist(), width):
                    if len(t) and (number := set_number(t)) not in seen:
                        seen.add(number)
                        held.append(token_class(t[: np.searchsorted(t, edge, side="right")]))
                        n += len(held[-1])
                if n > COUNTED:
                    yield counted()
                    held, n = [], 0
            if held:
                yield counted()

        with batch_rows(docs.sparkSession):
            made = docs.select("text").mapInPandas(count, "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
            counts = keep(made.where("n > 1"))
        self.repeated = Marks(counts.select("c"))
        least = RARE
        while counts.where(F.col("n") > least).count() > LISTED:
            least *= 2
        self.often = np.sort(counts.where(F.col("n") > least).select("c").toArrow()["c"].to_numpy().astype(np.uint64))
        discard(counts)

    def of(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether unique, whether frequent) of sorted tokens."""
        k = np.searchsorted(t, self.edge, side="right")
        c = token_class(t[:k])
        unique, frequent = np.zeros(len(t), dtype=bool), np.ones(len(t), dtype=bool)
        unique[:k] = ~self.repeated.test(c)
        frequent[:k] = self.often[np.minimum(np.searchsorted(self.often, c), len(self.often) - 1)] == c if len(self.often) else False
        return unique, frequent


def token_class(t: np.ndarray) -> np.ndarray:
    """The low 32 bits: what is counted and listed."""
    return t & U(0xFFFFFFFF)


def profiles(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, set_id, n, level, parity, signature, keys) of each document, kept. level: tokens that are not frequent; bitmaps and keys are null for a set without keys, or seen before in the task."""
    kinds, small = Kinds(docs, width, percent), smallest_paired(percent)

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            rows = []
            for t in token_sets_of(b["text"].tolist(), width):
                number = set_number(t) if len(t) else 0
                unique, frequent = kinds.of(t)
                keys = index_keys(t, unique, frequent, percent, small) if len(t) and number not in seen else t[:0]
                seen.add(number)
                rows.append((number, len(t), len(t) - int(frequent.sum()), *((parity(t), signature(t), keys.view(np.int64)) if len(keys) else (None, None, None))))
            out = pd.DataFrame(rows, columns=["set_id", "n", "level", "parity", "signature", "keys"])
            out.insert(0, "id", b["id"].to_numpy())
            out.insert(1, "is_null", b["is_null"].to_numpy())
            yield out

    # pandas has no null integers: they travel beside the number
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNull().alias("is_null"), "text")
    with batch_rows(docs.sparkSession):
        made = rows.mapInPandas(profile, "id long, is_null boolean, set_id long, n long, level long, parity array<long>, signature array<long>, keys array<long>")
        return keep(made.select(F.when(~F.col("is_null"), F.col("id")).alias("doc_id"), F.when(F.col("n") > 0, F.col("set_id")).alias("set_id"), "n", "level", "parity", "signature", "keys"))


def shared(entries: DataFrame) -> DataFrame:
    """(key, set_id, n, pivot, members), kept, of (key, set_id, n, level): the entries that two sets hold.

    The pivot is the set with the fewest tokens that are not frequent: of a group of near copies, one with few edits.
    """
    by = entries.groupBy("key").agg(F.min(F.struct("level", "set_id")).alias("first"), F.min("set_id").alias("low"), F.max("set_id").alias("high"), F.count("*").alias("members"))
    by = by.where("low < high").select("key", F.col("first.set_id").alias("pivot"), "members")
    return keep(entries.select("key", "set_id", "n").join(by, "key"))


def token_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(set_id, tokens), kept, one row for each row of wanted (doc_id, set_id).

    One function tells the documents that may be wanted and makes their sets, so that a task needs one Python worker.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            told = held.test(b.column("h").to_numpy())
            found = [(set_number(t), t) for t in token_sets_of(b.column("text").filter(pa.array(told)).to_pylist(), width) if len(t)]
            found = [(number, t) for number, t in found if not (number in seen or seen.add(number))]
            offsets = np.cumsum([0, *(len(t) for _, t in found)], dtype=np.int32)
            tokens = np.concatenate([t for _, t in found]).view(np.int64) if found else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([number for number, _ in found], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens))], ["set_id", "tokens"])

    held = Marks(wanted.select(id_hash("doc_id")))
    with batch_rows(docs.sparkSession):
        rows = docs.select(id_hash("doc_id").alias("h"), "text").mapInArrow(of, "set_id long, tokens array<long>")
        return keep(rows.join(wanted.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"]))


def may_link(n: str, p: str, m: str, q: str, percent: int) -> Column:
    """Whether sets of sizes n and m with parity bitmaps p and q can be similar enough. Bitmaps fold to the shorter's length."""
    fold = lambda x, y: f"if(size({x}) <= size({y}), {x}, transform(sequence(0, size({y}) - 1), i -> {x}[i] ^ {x}[i + size({y})]))"
    differ = f"aggregate(zip_with({fold(p, q)}, {fold(q, p)}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    return F.expr(f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) and (100 + {percent}) * {differ} <= (100 - {percent}) * ({n} + {m})")


def candidates(found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of shared(): members of small entries with each other, of large ones with the pivot, whose sizes and bitmaps allow a link."""
    small = found.where(F.col("members") <= PAIRED).select("key", F.col("set_id").alias("a"), "n")
    other = small.select("key", F.col("a").alias("b"), F.col("n").alias("m"))
    pairs = small.join(other, "key").where(f"a < b and 100 * least(n, m) >= {percent} * greatest(n, m)").select("a", "b")
    star = found.where((F.col("members") > PAIRED) & (F.col("set_id") != F.col("pivot"))).select(F.least("pivot", "set_id").alias("a"), F.greatest("pivot", "set_id").alias("b"))
    return may_be_similar(pairs.unionByName(star), sets, percent)


def may_be_similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    side = lambda k: sets.select(F.col("set_id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("n", "parity")))
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    return cut(both.where(may_link("n_a", "parity_a", "n_b", "parity_b", percent)).select("a", "b"))


def similar(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    both = pairs.join(held.select(F.col("set_id").alias("a"), F.col("tokens").alias("s")), "a").join(held.select(F.col("set_id").alias("b"), F.col("tokens").alias("t")), "b")
    told = both.select("a", "b", F.size("s").alias("x"), F.size("t").alias("y"), F.size(F.array_intersect("s", "t")).alias("o"))
    return cut(told.where(f"100 * o >= {percent} * (x + y - o)").select("a", "b"))


def apart(stars: DataFrame, sets: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of a pivot in different components that may be similar. stars: (pivot, set_id, c).

    The left side is dealt to blocks of about BLOCK sets, the right side goes to every block of its pivot.
    """
    both = stars.join(held.select(F.col("set_id").alias("pivot"), F.col("tokens").alias("p")), "pivot").join(held.select("set_id", F.col("tokens").alias("x")), "set_id")
    measured = both.select("pivot", "set_id", "c", (F.size("p") + F.size("x") - 2 * F.size(F.array_intersect("p", "x"))).alias("d"))
    blocks = stars.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
    members = cut(measured.join(blocks, "pivot").join(sets.select("set_id", "n", "signature"), "set_id"))
    bits = [F.col("signature")[k] for k in range(8)]
    left = members.select("pivot", F.pmod(F.xxhash64("set_id"), "blocks").alias("block"), F.col("set_id").alias("a"), "c", "d", "n", *(x.alias(f"x{k}") for k, x in enumerate(bits)))
    right = members.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    right = right.select("pivot", "block", F.col("set_id").alias("b"), F.col("c").alias("c2"), F.col("d").alias("d2"), F.col("n").alias("m"), *(x.alias(f"y{k}") for k, x in enumerate(bits)))
    plus, minus = 100 + percent, 100 - percent
    differ = " + ".join(f"bit_count(x{k} ^ y{k})" for k in range(8))
    keep_ = f"a < b and c <> c2 and {plus} * abs(d - d2) <= {minus} * (n + m) and {plus} * abs(n - m) <= {minus} * (n + m) and {plus} * ({differ}) <= {minus} * (n + m)"
    return left.join(right, ["pivot", "block"]).where(keep_).select("a", "b")


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs but for the rows whose id is among ids (one column, no nulls); rows of null id stay, and all columns.

    A bitmap tells most rows that stay without moving them; only rows it cannot clear are joined with the ids.
    """
    listed = ids.select(F.col(ids.columns[0]).alias(id_col))
    doubtful, gone = free_name(docs, "_doubtful"), free_name(docs, "_gone")
    told = docs.withColumn(doubtful, Marks(listed.select(id_hash(id_col))).hold(id_hash(id_col)))
    rest = told.where(F.col(doubtful)).join(listed.withColumnRenamed(id_col, gone), F.col(id_col) == F.col(gone), "left_anti")
    return told.where(~F.col(doubtful)).unionByName(rest).drop(doubtful)


def jaccard_components(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) per row: documents link when their sets' Jaccard similarity is at least percent/100.

    component_id is the smallest id reachable by links. Nulls and empty texts: a text without a word has an empty
    set, links with nothing, and is its own component; a null id is no component's name unless all are null.
    Texts of any length are read whole. Equal sets are one vertex, so copies are never paired. Repeated rows stay
    rows. Extra columns, whatever their names, are not carried. Empty in, empty out.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = profiles(docs, width, percent)
    reps = cut(rows.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("rep")))
    found = shared(rows.where("keys is not null").select(F.explode("keys").alias("key"), "set_id", "n", "level"))
    sets = rows.where("keys is not null").select("set_id", "n", "parity", "signature").dropDuplicates(["set_id"])
    sets = cut(sets.join(found.select("set_id").distinct(), "set_id", "left_semi"))
    pairs = candidates(found, sets, percent)
    large = cut(found.where(F.col("members") > PAIRED).select("key", "set_id", "pivot").distinct())
    ends = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).unionByName(large.select("set_id")).distinct()
    held = token_sets(docs, cut(ends.join(reps, "set_id").select("set_id", F.col("rep").alias("doc_id"))), width)
    links = similar(pairs, held, percent)
    labels = components(links)
    # members of large entries, but for the pivot, that are in different components
    placed = large.where("set_id <> pivot").join(labels.withColumnRenamed("v", "set_id"), "set_id", "left").withColumn("c", F.coalesce("c", "set_id"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    stars = cut(placed.join(mixed, "key").select("pivot", "set_id", "c").distinct())
    if not stars.isEmpty():
        more = similar(may_be_similar(apart(stars, sets, held, percent), sets, percent), held, percent)
        labels = components(links.unionByName(more))
    for kept in (found, held):
        discard(kept)
    named = reps.join(labels.withColumnRenamed("v", "set_id"), "set_id", "left").select("set_id", "rep", F.coalesce("c", "set_id").alias("c"))
    lowest = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    of_set = cut(named.join(lowest, "c").select("set_id", "component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "set_id").join(of_set, "set_id", "left").select(F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
