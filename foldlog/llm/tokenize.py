"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps a score-ordered agenda of adjacent symbol pairs: it takes the best-scored pair (the
leftmost among equals), joins it, and puts the two new neighbour pairs on the agenda until no pair is a
piece. Two facts make that affordable per text:

* A place between characters a and b where no piece of the vocabulary contains "ab" can never be joined
  across, so a text falls apart there exactly. Runs of spaces with the characters behind them are such units.
* Units repeat, so each worker keeps the ids of units it has seen, as bytes (bounded, see CACHE_UNITS).

The agendas of new units are rows of one matrix of pair costs: each round takes the best pair of every row. Units
that are long, or hold a character that is no piece, have a heap or a list of their own.

The split into units holds for models that normalise nothing but blanks (a blank in front, no blanks removed), as
merge-type vocabularies with byte fallback do; plain_model() checks that by the library. For others whole texts
take the library's ids and count as differing.

Every unit that enters the cache is checked, an Arrow batch at a time, against the sentencepiece library;
should they differ the library's ids are taken and the unit is counted in `n_differing`.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain
from operator import add

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlog.llm.common import small_batches

SPACE = "▁"
#: New units that a worker remembers before the older ones that no text has used since are forgotten.
CACHE_UNITS = 300_000
#: Up to this many symbols the agenda is a plain list of scores, beyond it a heap.
SHORT = 48
NONE = float("inf")
#: More than there are symbols: pieces and code points.
SYMBOLS = 1 << 24


class MergeEncoder:
    """The vocabulary of one model, and the agenda over it. Lives in a Python worker."""

    def __init__(self, model: bytes) -> None:
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [(sp.id_to_piece(i), i) for i in range(sp.get_piece_size())]
        self.bytes_ = {int(p[3:5], 16): i for p, i in pieces if sp.is_byte(i)}
        usable = [(p, i) for p, i in pieces if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = dict(usable)
        self.cost = {p: -sp.get_score(i) for p, i in usable if len(p) > 1}
        self.joins = {p[k : k + 2] for p, _ in usable for k in range(len(p) - 1)}
        self.unknown = sp.unk_id()
        self.open, self.close = struct.pack("<I", sp.bos_id()), struct.pack("<I", sp.eos_id())
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.differing: set[str] = set()
        self._tables(pieces)
        self.plain = self.plain_model()

    def _tables(self, pieces: list[tuple[str, int]]) -> None:
        """Symbols as numbers: pieces by their id, other characters behind them, last what fills a row up.

        pair_keys: sorted left * SYMBOLS + right; what these join to, and its cost.
        """
        self.n_pieces, self.filler = len(pieces), len(pieces) + 0x110000
        self.symbol = np.arange(len(pieces), self.filler, dtype=np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        joins = sorted((self.ids[p[:k]] * SYMBOLS + self.ids[p[k:]], i, self.cost[p]) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        self.pair_keys, self.pair_ids = (np.array([x[k] for x in joins] or [-1], dtype=np.int64) for k in (0, 1))
        self.pair_costs = np.array([x[2] for x in joins] or [NONE])
        # a piece that is not made of two pieces can only be joined from characters that are none
        self.closed = all(c in self.ids for p in self.ids for c in p)

    def plain_model(self) -> bool:
        """Whether the library neither removes nor changes blanks, nor changes characters, in a few telling texts."""
        seen = "".join(p.replace(SPACE, "") for p in list(self.ids)[:2000] if len(p) < 8)
        return all(self.library.decode(self.library.encode(t)) == t for t in (" a  b ", "\tﬁ Ａ①é e\u0301", seen))

    def _costs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(what each pair joins to, its cost); infinite where it is no piece."""
        key = left * SYMBOLS + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return self.pair_ids[at], np.where(self.pair_keys[at] == key, self.pair_costs[at], NONE)

    def merge_rows(self, s: np.ndarray) -> np.ndarray:
        """Merges the symbols of each row; both before and after, rows are filled up with symbols that join nothing."""
        s = s.copy()
        joined, cost = self._costs(s[:, :-1], s[:, 1:])
        rows, columns = np.arange(len(s)), np.arange(s.shape[1])
        work = s
        while len(rows):
            k = cost.argmin(axis=1)
            going = cost[np.arange(len(rows)), k] < NONE
            s[rows[~going]] = work[~going]
            rows, work, joined, cost, k = rows[going], work[going], joined[going], cost[going], k[going]
            if not len(rows):
                break
            at = np.arange(len(rows))
            work[at, k] = joined[at, k]
            # what stands behind the pair moves up by one
            source = np.minimum(columns + (columns > k[:, None]), len(columns) - 1)
            work = np.take_along_axis(work, source, axis=1)
            work[:, -1] = self.filler
            joined, cost = (np.take_along_axis(x, source[:, :-1].clip(max=x.shape[1] - 1), axis=1) for x in (joined, cost))
            cost[:, -1] = NONE
            for near in (k - 1, k):
                ok = np.flatnonzero((near >= 0) & (near < len(columns) - 1))
                joined[ok, near[ok]], cost[ok, near[ok]] = self._costs(work[ok, near[ok]], work[ok, near[ok] + 1])
        return s

    def units(self, chunks: list[str]) -> list[bytes]:
        """Ids of SPACE + chunk for each chunk, little-endian."""
        out: list[bytes] = [b""] * len(chunks)
        by_size: dict[int, list[int]] = {}
        for j, x in enumerate(chunks):
            by_size.setdefault(-(-(len(x) + 1) // 4) if self.closed and len(x) < SHORT else 0, []).append(j)
        for size, which in by_size.items():
            if not size:
                for j in which:
                    out[j] = self.unit(chunks[j])
                continue
            width = 4 * size
            codes = np.frombuffer("".join([(SPACE + chunks[j]).ljust(width, "\0") for j in which]).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(which), width)
            symbols = self.symbol[codes]
            lengths = np.array([len(chunks[j]) + 1 for j in which])
            inside = np.arange(width) < lengths[:, None]
            symbols[~inside] = self.filler
            made = self.merge_rows(symbols)
            held = made < self.filler
            known = ((made < self.n_pieces) | ~held).all(axis=1)
            data, ends = made[held].astype("<u4").tobytes(), np.cumsum(held.sum(axis=1)) * 4
            start = 0
            for j, ok, end in zip(which, known.tolist(), ends.tolist()):
                out[j] = data[start:end] if ok else self.spelled(data[start:end])
                start = end
        return out

    def merge(self, symbols: list[str]) -> list[str]:
        return self._merge_short(symbols) if len(symbols) <= SHORT else self._merge_long(symbols)

    def _merge_short(self, s: list[str]) -> list[str]:
        cost = self.cost.get
        agenda = [cost(x, NONE) for x in map(add, s, s[1:])]
        while agenda:
            best = min(agenda)
            if best == NONE:
                break
            k = agenda.index(best)
            s[k : k + 2] = [s[k] + s[k + 1]]
            del agenda[k]
            if k:
                agenda[k - 1] = cost(s[k - 1] + s[k], NONE)
            if k < len(agenda):
                agenda[k] = cost(s[k] + s[k + 1], NONE)
        return s

    def _merge_long(self, s: list[str]) -> list[str]:
        n, cost = len(s), self.cost.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(c, k, len(s[k]) + len(s[k + 1])) for k in range(n - 1) if (c := cost(s[k] + s[k + 1], NONE)) != NONE]
        heapq.heapify(agenda)
        while agenda:
            c, k, length = heapq.heappop(agenda)
            right = after[k]
            if not s[k] or right < 0 or len(s[k]) + len(s[right]) != length or cost(s[k] + s[right], NONE) != c:
                continue  # one of the pair has been joined meanwhile
            s[k] += s[right]
            s[right] = ""
            after[k] = after[right]
            if after[k] >= 0:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and (follow := after[left]) >= 0 and (c := cost(s[left] + s[follow], NONE)) != NONE:
                    heapq.heappush(agenda, (c, left, len(s[left]) + len(s[follow])))
        return [x for x in s if x]

    def spelled(self, symbols: bytes) -> bytes:
        """Ids of symbols among which are characters that are no pieces: their bytes, or one unknown id for a run of them."""
        out: list[int] = []
        for x in np.frombuffer(symbols, dtype="<u4").tolist():
            if x < self.n_pieces:
                out.append(x)
            elif self.bytes_:
                out += [self.bytes_[b] for b in chr(x - self.n_pieces).encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return struct.pack(f"<{len(out)}I", *out)

    def unit(self, chunk: str) -> bytes:
        """Ids of SPACE + chunk, little-endian."""
        text, found, start, joins = SPACE + chunk, [], 0, self.joins
        if chunk and joins.issuperset(map(add, text, chunk)):
            found = self.merge(list(text))
        else:
            for k in range(1, len(text) + 1):
                if k == len(text) or text[k - 1 : k + 1] not in joins:
                    part = text[start:k]
                    found += [part] if k - start == 1 else self.merge(list(part))
                    start = k
        out: list[int] = []
        for piece in found:
            if (i := self.ids.get(piece)) is not None:
                out.append(i)
            elif self.bytes_:
                out += [self.bytes_[b] for b in piece.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return struct.pack(f"<{len(out)}I", *out)

    def chunks(self, text: str) -> list[str]:
        """Units of a text without the SPACE before each; the text itself gets one in front."""
        if not text:
            return []
        if text[0] in (" ", SPACE) or "  " in text or SPACE in text:
            return [x[1:] for x in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def learn(self, parts: list[list[str]]) -> None:
        """Puts the units of a batch into the cache, those that are new checked against the library."""
        if len(self.cache) > CACHE_UNITS:
            self.older, self.cache = self.cache, {}
        fresh = []
        for x in set(chain.from_iterable(parts)).difference(self.cache):
            if (ids := self.older.get(x)) is not None:
                self.cache[x] = ids
            else:
                fresh.append(x)
        made = self.units(fresh)
        self.cache.update(zip(fresh, made))
        # the library never sees a lone SPACE: it gives '' no ids
        checked = [(x, ids) for x, ids in zip(fresh, made) if x]
        right = self.library.encode([x for x, _ in checked], num_threads=1)
        if np.fromiter(chain.from_iterable(right), dtype="<u4").tobytes() != b"".join(ids for _, ids in checked) or any(4 * len(r) != len(ids) for r, (_, ids) in zip(right, checked)):
            for r, (x, ids) in zip(right, checked):
                if (r := struct.pack(f"<{len(r)}I", *r)) != ids:
                    self.cache[x] = r
                    self.differing.add(x)

    def batch(self, texts: list[str]) -> tuple[list[bytes], list[int]]:
        """(ids of each text with begin and end ids, as little-endian unsigned 32-bit integers; its units that differed from the library)"""
        if not self.plain:
            return [struct.pack(f"<{len(i)}I", *i) for i in self.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)], [1] * len(texts)
        parts = [self.chunks(t) for t in texts]
        self.learn(parts)
        of = self.cache.__getitem__
        coded = [b"".join([self.open, *map(of, p), self.close]) for p in parts]
        return coded, [sum(x in self.differing for x in p) if self.differing else 0 for p in parts]


_encoders: dict[str, MergeEncoder] = {}


def encoder(model: bytes) -> MergeEncoder:
    """One encoder a worker process and model, so that tasks of one worker share what it has seen."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _encoders:
        _encoders[key] = MergeEncoder(model)
    return _encoders[key]


def sentencepiece_encode(df: DataFrame, model_path: str, text_col: str = "text", out_col: str = "pieces", tokens: bool = True) -> DataFrame:
    """Adds out_col: STRUCT<n_tokens, ids, ids_sha256, decoded, decoded_sha256, n_differing>.

    ids are those of the library with begin and end ids and without sampling; decoded is the library's
    decode(ids). tokens=False leaves `ids` and `decoded` null, where only counts and digests are wanted.
    Nulls: a null text counts as empty, which gives the begin and end ids alone. Whole texts of any length
    are encoded. Repeated rows are encoded each. Every other column stays as it is; a column already called
    out_col is replaced. An empty table gives an empty table. The model file is read once, by the driver.
    """
    small_batches(df.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()

    @F.pandas_udf("n_tokens long, ids array<int>, ids_sha256 string, decoded string, decoded_sha256 string, n_differing long")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoder(model)
        for texts in batches:
            coded, differing = enc.batch([t or "" for t in texts])
            ids = [np.frombuffer(x, dtype="<u4") for x in coded]
            decoded = [enc.library.decode(x.tolist()) for x in ids]
            yield pd.DataFrame({
                "n_tokens": [len(x) for x in ids],
                "ids": [x.astype("int32") for x in ids] if tokens else None,
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in coded],
                "decoded": decoded if tokens else None,
                "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in decoded],
                "n_differing": differing,
            })

    return df.withColumn(out_col, encode(F.col(text_col)))


def sentencepiece_decode(df: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds out_col: the library's decode() of an array of ids. Null ids give null, an empty array ''."""
    small_batches(df.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        library = encoder(model).library
        for ids in batches:
            yield pd.Series([None if x is None else library.decode([int(i) for i in x]) for x in ids], dtype=object)

    return df.withColumn(out_col, decode(F.col(ids_col)))
