"""Phrase mining against plain counting, for any number of shards and slots, and on odd rows."""

import glob
import os
import random
import re
from collections import Counter

import duckdb
import pytest

from foldlog.llm import collocations as C
from foldlog.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, n int, phrase string, shard string"


def plain(rows, threshold, longest, top, inside):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < threshold:
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        held = any(100 * b >= inside * a for (other, q), b in f.items() if other == lang and len(p) < len(q) <= longest and b >= threshold and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
        if not held:
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def texts(seed, n, vocabulary):
    rng = random.Random(seed)
    phrases = [" ".join(f"p{rng.randrange(40)}" for _ in range(rng.choice([2, 3, 4]))) for _ in range(15)]
    for _ in range(n):
        parts = [rng.choice(phrases) if rng.random() < 0.3 else f"W{int(vocabulary * rng.random() ** 3)}" for _ in range(rng.randrange(60))]
        yield "".join(p + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", ";"]) for p in parts)


@pytest.mark.parametrize("shards,longest,slots", [(1, 3, 22), (4, 3, 22), (3, 4, 22), (3, 3, 6), (2, 2, 15)])
def test_phrases_are_plain_counts(spark, shards, longest, slots):
    langs = ["en", "de", None, "und"]
    rows = [(t, langs[i % 4]) for i, t in enumerate(texts(shards * 10 + longest, 400, 300))]
    df = spark.createDataFrame([(i, t, lang, 0, "x", "y") for i, (t, lang) in enumerate(rows)], DOCS)
    got = C.collocations(df, threshold=5, longest=longest, top=40, inside=60, shards=shards, slots=(slots, slots))
    assert sorted(map(tuple, got.collect())) == plain(rows, 5, longest, 40, 60)


def test_odd_rows(spark):
    odd = [None, "", " \t ", "...", "a", "É é É é É é 日本 語 日本 語", "A b, a b. a\x0bb a b\r\na b", "x\x00y z " * 12, "  w w v " * 12, "A " * 20_000, "long" * 9_000 + " tail"]
    rows = [(t, lang) for t in odd for lang in ("en", None)] * 6
    df = spark.createDataFrame([(None if i % 3 else 5, t, lang, 0, "x", "y") for i, (t, lang) in enumerate(rows)], DOCS)
    assert sorted(map(tuple, C.collocations(df, threshold=6).collect())) == plain(rows, 6, 3, 2000, 50)


def test_no_rows(spark):
    assert C.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert C.collocations(spark.createDataFrame([(1, None, None, 0, "", "")], DOCS)).collect() == []


def test_query_gives_what_its_sql_gives(spark):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = Q.op12_collocations(spark, SF)
    want = c.sql(Q.ORACLE_SQL["op12_collocations"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
