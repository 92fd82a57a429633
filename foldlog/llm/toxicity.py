"""Toxicity by a weighted finite-state pattern grammar.

Words become tags (insult, threat, target, negation, reported speech, other), each by a lexicon; four small
weighted transducers read the tags of a clause, and their composition scores it:

* insult: an insult scores its lexicon weight, more if a target has been named in the clause ("you idiot"), and a
  target that follows an insult scores the rest ("idiot you"),
* threat: a threat verb scores if a target follows within a few words ("kill you"), by what negation and report made
  of the verb,
* negation and reported speech: what stands shortly behind "not" or "she said" scores less.

A document's score is that at least one of its clauses is toxic (noisy or). The insult lexicon is learned: words
and word beginnings that labelled toxic texts hold in many different surroundings and other texts do not.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlog.llm.common import small_batches, training_rows
from foldlog.session import cut

#: Labelled rows that the lexicon is learned from, at most.
TRAIN_ROWS = 12_000
#: Different words that must stand before an entry in toxic texts. Copies of one text count once by this.
CONTEXTS = 3
#: Share of toxic texts among those that hold an entry, at least.
PRECISION = 0.8
#: Lengths of word beginnings that may be entries.
STEMS = (4, 5, 6, 7)
#: Words that a task remembers the tag of, at most but for one text.
CACHE_WORDS = 100_000

# General closed-class and threat vocabulary of the four languages.
WORDS = {
    "threat": {"kill", "hurt", "destroy", "beat", "shoot", "stab", "burn", "töten", "umbringen", "schlagen", "tuer", "frapper", "matar", "golpear"},
    "target": {"you", "your", "youre", "they", "them", "he", "she", "du", "dich", "dir", "ihr", "euch", "tu", "te", "toi", "vous", "tú", "ti", "usted", "ustedes", "vosotros"},
    "negation": {"not", "never", "no", "isnt", "arent", "dont", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "jamás"},
    "reported": {"said", "says", "called", "quoted", "wrote", "claimed", "sagte", "nannte", "dit", "appelé", "dijo", "llamó"},
}
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORTED = range(6)
TAGS = {"threat": THREAT, "target": TARGET, "negation": NEGATION, "reported": REPORTED}
SPAN = 3

#: (state, tag) -> (state, factor): state 0 starts; the factor scales what the tag scores.
Transducer = dict[tuple, tuple]
NEGATED, REPORT = 0.3, 0.6
#: Weight of a threat that meets its target; what a target adds to an insult, as a share of the insult's weight.
THREAT_WEIGHT, TARGETED = 2.5, 0.5


def after(trigger: int, factor: float, span: int) -> Transducer:
    """Scales insults and threats within `span` words behind a trigger."""
    return {(k, tag): (span if tag == trigger else max(k - 1, 0), factor if k and tag in (INSULT, THREAT) else 1.0) for k in range(span + 1) for tag in range(6)}


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both at once: pairs of states, products of factors."""
    return {((s, t), tag): ((s2, t2), f * g) for (s, tag), (s2, f) in a.items() for (t, tag2), (t2, g) in b.items() if tag == tag2}


def insults(scale: Transducer) -> Transducer:
    """Behind `scale`: insult and target of a clause. State: (that of scale, whether a target was named, factor of an insult without one).

    The outputs are (kind, factor): an insult scores more once a target is named; a target pays for the insult before it.
    """
    out: Transducer = {}
    for (s, tag), (s2, f) in scale.items():
        for named in (0, 1):
            for owed in (0.0, 1.0, NEGATED, REPORT, NEGATED * REPORT):
                score, left, seen = 0.0, owed, named
                if tag == INSULT:
                    score, left = (f * (1 + TARGETED), 0.0) if named else (f, f)
                elif tag == TARGET:
                    score, left, seen = owed * TARGETED, 0.0, 1
                out[(s, named, owed), tag] = ((s2, seen, left), score)
    return out


def threats(scale: Transducer) -> Transducer:
    """Behind `scale`: a threat verb and its target. State: (that of scale, words left for the target, factor of the verb)."""
    out: Transducer = {}
    for (s, tag), (s2, f) in scale.items():
        for left in range(SPAN + 1):
            for held in (0.0, 1.0, NEGATED, REPORT, NEGATED * REPORT) if left else (0.0,):
                score = 0.0
                if tag == THREAT:
                    after_, kept = SPAN, f
                elif tag == TARGET and left:
                    score, after_, kept = held, 0, 0.0
                else:
                    after_ = max(left - 1, 0)
                    kept = held if after_ else 0.0
                out[(s, left, held), tag] = ((s2, after_, kept), score)
    return out


def grammar() -> Transducer:
    """The product of all four, from its start: (state, tag) -> (state, (share of an insult's weight, share of a threat's)). States are numbered."""
    scale = compose(after(NEGATION, NEGATED, SPAN), after(REPORTED, REPORT, 5))
    insult, threat = insults(scale), threats(scale)
    start = (((0, 0), 0, 0.0), ((0, 0), 0, 0.0))
    number, todo, out = {start: 0}, [start], {}
    while todo:
        state = todo.pop()
        for tag in range(6):
            (i, x), (t, y) = insult[state[0], tag], threat[state[1], tag]
            if (i, t) not in number:
                number[i, t] = len(number)
                todo.append((i, t))
            out[number[state], tag] = (number[i, t], (x, y))
    return out


class Scorer:
    """Tags words and runs the composed transducer over the clauses that hold an insult or threat."""

    def __init__(self, lexicon: dict[str, float], base: float) -> None:
        self.lexicon, self.base, self.arcs = lexicon, base, grammar()
        self.fixed = {w: TAGS[k] for k, ws in WORDS.items() for w in ws}
        self.cache: dict[str, tuple[int, float, bool]] = {}

    def tag(self, token: str) -> tuple[int, float, bool]:
        """(tag, weight, whether a clause ends behind the token)"""
        end = token[-1] in ".!?;:" if token else False
        word = "".join(c for c in token if c.isalnum())
        best = max([self.lexicon.get(word, 0.0), *(self.lexicon.get(word[:n] + "*", 0.0) for n in STEMS if len(word) >= n)])
        if best > 0:
            return INSULT, best, end
        return self.fixed.get(word, OTHER), 0.0, end

    def clauses(self, tagged: list[tuple[int, float, bool]]) -> list[float]:
        """Scores of the clauses that match."""
        out, state, score, weight_owed = [], 0, 0.0, 0.0
        arcs = self.arcs
        for tag, weight, end in tagged:
            state, (insult, threat) = arcs[state, tag]
            if tag == INSULT:
                weight_owed = weight
            score += insult * weight_owed + threat * THREAT_WEIGHT
            if end:
                if score:
                    out.append(score)
                state, score = 0, 0.0
        return out + [score] * bool(score)

    def score(self, text: str) -> tuple[float, int]:
        """(score, matched clauses)"""
        cache, tokens = self.cache, text.lower().split()
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for t in set(tokens):
            if t not in cache:
                cache[t] = self.tag(t)
        tagged = [cache[t] for t in tokens]
        if not any(x[0] in (INSULT, THREAT) for x in tagged):
            return self.base, 0
        found = self.clauses(tagged)
        return 1 - (1 - self.base) * math.exp(-sum(found)), len(found)


def terms(text: str, cores: dict[str, str]) -> list[tuple[str, str]]:
    """(word before, word) with letters and digits alone. cores: those of the tokens that a task has seen; it goes with the task, as the worker lives on."""
    tokens = text.lower().split()
    if len(cores) > CACHE_WORDS:
        cores.clear()
    for t in tokens:
        if t not in cores:
            cores[t] = "".join(c for c in t if c.isalnum())
    words = [cores[t] for t in tokens]
    return list(zip(["", *words], words))


def entries(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)] if len(word) >= 3 and not word.isdigit() else []


def learn_lexicon(rows: DataFrame) -> tuple[dict[str, float], float]:
    """({entry: weight}, base rate) from rows (y, text). Counts are made in tasks and summed by Spark.

    What comes to the driver is bounded by the sample: entries that CONTEXTS words precede in its toxic texts.
    """

    def toxic(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cores: dict[str, str] = {}
        for b in batches:
            seen = {(e, before) for text in b["text"] for before, w in terms(text, cores) for e in entries(w)}
            yield pd.DataFrame(list(seen), columns=["entry", "context"])

    def held(names: frozenset[str]):
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, cores = Counter(), {}
            for b in batches:
                for y, text in zip(b["y"], b["text"]):
                    total.update((e, int(y)) for e in {e for _, w in set(terms(text, cores)) for e in entries(w)} & names)
            yield pd.DataFrame([(e, y, n) for (e, y), n in total.items()], columns=["entry", "y", "n"])

        return count

    sizes = {int(r.y): r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    base = min(0.5, 0.1 * (pos + 1) / (pos + neg + 2))
    contexts = rows.where("y = 1").select("text").mapInPandas(toxic, "entry string, context string").distinct().groupBy("entry").agg(F.count("*").alias("n")).where(F.col("n") >= CONTEXTS)
    names = [r.entry for r in contexts.select("entry").collect()]
    counts = rows.mapInPandas(held(frozenset(names)), "entry string, y int, n long").groupBy("entry", "y").agg(F.sum("n").alias("n"))
    by = counts.groupBy("entry").agg(*(F.coalesce(F.sum(F.when(F.col("y") == y, F.col("n"))), F.lit(0)).alias(f"n{y}") for y in (0, 1)))
    kept = by.where(F.col("n1") >= PRECISION * (F.col("n0") + F.col("n1") + 1)).collect()
    return {r.entry: math.log((r.n1 + 0.5) / (r.n0 + 0.5)) / 2.5 for r in kept}, base


def score_toxicity(df: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, fold: int = 1, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """Adds out_col: STRUCT<score, predicted, clauses>.

    Learns from at most train_rows rows of `labels` (id_col, toxic) outside the fold; only their texts and
    labels are used. Nulls: a null text counts as empty; an empty text, or one with no match, gets the base
    score, a small constant. Texts of any length are read whole. Ties and repeated rows score alike. Without
    labelled rows the lexicon is empty, and threats alone score. Other columns stay; empty in, empty out.
    """
    small_batches(df.sparkSession)
    rows = cut(training_rows(df, labels, "toxic", folds, fold, train_rows, id_col, text_col))
    lexicon, base = learn_lexicon(rows)

    @F.pandas_udf("score double, predicted int, clauses int")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(lexicon, base)
        for texts in batches:
            found = [scorer.score(t or "") for t in texts]
            yield pd.DataFrame({"score": [s for s, _ in found], "predicted": [int(s >= threshold) for s, _ in found], "clauses": [n for _, n in found]})

    return df.withColumn(out_col, score(F.col(text_col)))
