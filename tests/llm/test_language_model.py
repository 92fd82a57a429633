"""Language-model scores: the base against plain counting, the model against slow versions of its gradients and sums."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from foldlog.llm import gru, scoring
from foldlog.llm import queries as Q
from foldlog.session import table

SF = "/root/testdata/sf0.001"


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [""]


def plain(rows):
    """{(id, text): (held_out, n_tokens, n_known, N, base)} by plain counting."""
    out_of_fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2
    c = Counter(w for i, text in rows if out_of_fold(i) for w in tokens(text))
    n, v = sum(c.values()), len(c)
    return {(i, text): (not out_of_fold(i), len(w := tokens(text)), sum(x in c for x in w), n, sum(np.log10((c.get(x, 0) + 1) / (n + v + 1)) for x in w)) for i, text in rows}


def test_gradients_are_differences():
    rng = np.random.default_rng(1)
    w = gru.fresh(rng.integers(1, 90, 500), 100)
    for name in ("gates", "turn", "of_class", "class_bias", "member", "member_bias"):
        setattr(w, name, getattr(w, name).astype(np.float64))
    words = rng.choice([0, 1, 5, 70, 130, 499, gru.SIZE], (6, 4))
    first = np.zeros((6, 4), bool)
    first[0, :2] = first[3, 1] = True
    h = rng.normal(0, 0.5, (4, gru.HIDDEN))
    _, g, _ = gru.gradients(w, h, words, first)
    checked = 0
    for x, gx in zip(w.all(), g.all()):
        flat, gflat = x.reshape(-1), gx.reshape(-1)
        for k in np.argsort(-np.abs(gflat))[:4].tolist() + rng.integers(0, len(flat), 2).tolist():
            old, e = flat[k], 1e-5
            flat[k] = old + e
            up = gru.gradients(w, h, words, first)[0]
            flat[k] = old - e
            down = gru.gradients(w, h, words, first)[0]
            flat[k] = old
            assert gflat[k] == pytest.approx((up - down) / (2 * e), abs=2e-7)
            checked += 1
    assert checked == 36


def one_by_one(w, text):
    h, total = np.zeros(gru.HIDDEN), 0.0
    for y in text:
        lp = gru.log_softmax((h @ w.of_class + w.class_bias)[None])[0]
        total += lp[y // gru.MEMBERS]
        if y < gru.SIZE:
            c = y // gru.MEMBERS
            total += gru.log_softmax((h @ w.member[c] + w.member_bias[c])[None])[0][y % gru.MEMBERS]
        h = gru.forward(w, h[None], np.array([y]))[0][0]
    return total


def test_texts_side_by_side_score_as_alone():
    rng = np.random.default_rng(2)
    w = gru.fresh(rng.integers(1, 90, 3000), 500)
    texts = [np.append(rng.integers(1, 3000, n), 0) for n in (0, 1, 5, 63, 64, 65, 700, 3, 64)]
    assert gru.log_likelihood(w, texts) == pytest.approx([one_by_one(w, x) for x in texts], rel=1e-5)
    assert list(gru.log_likelihood(w, [])) == []


def test_probabilities_sum_to_one():
    """Over the model's words and the class of all others, after any state, also with fewer words than classes hold."""
    for known in (3, 200, gru.SIZE):
        w = gru.fresh(np.arange(known) + 1, 10)
        h = np.random.default_rng(3).normal(0, 1, (1, gru.HIDDEN)).astype(np.float32)
        words = np.append(np.arange(known), gru.SIZE)
        told, _ = gru.output(w, np.repeat(h, len(words), 0), words)
        assert np.exp(told).sum() == pytest.approx(1, abs=1e-4)


def test_training_learns_order():
    rng = random.Random(4)
    texts = [np.array([*(1 + (k + j) % 10 for j in range(rng.randrange(5, 40))), 0]) for k in range(200)]
    counts = np.bincount(np.concatenate(texts), minlength=11)
    untrained, trained = gru.fresh(counts, 0), gru.train(texts * 8, counts, 0, windows=60)
    per_word = lambda w: gru.log_likelihood(w, texts).sum() / sum(map(len, texts))
    assert per_word(trained) > per_word(untrained) + 1
    again = gru.train(texts * 8, counts, 0, windows=60)
    assert all((a == b).all() for a, b in zip(trained.all(), again.all()))


@pytest.mark.parametrize("n", [0, 1, 999, 2_000_001, 6_500_000, 114_000_000, 7 * 10**9])
def test_rounds_are_all_texts_once(n):
    plan = scoring.rounds(n)
    modulus = {m for m, *_ in plan}
    assert len(modulus) == 1 and [k for _, a, b, _ in plan for k in range(a, b)] == list(range(*modulus))
    assert all(n * (b - a) / m / lanes <= 1.5 * scoring.LANE for m, a, b, lanes in plan)


@pytest.mark.parametrize(("sizes", "passes"), [([1], 1), ([3, 40, 1, 700], 2), ([9000, 2, 2, 2500], 3)])
def test_each_pass_reads_every_word(monkeypatch, sizes, passes):
    read, begun = Counter(), 0

    def look(w, h, words, first, g):
        nonlocal begun
        read.update(words.ravel().tolist())
        begun += int(first.sum())
        return 0.0, g, h

    monkeypatch.setattr(gru, "gradients", look)
    texts = np.split(np.arange(sum(sizes)), np.cumsum(sizes)[:-1])
    gru.learn(gru.fresh(np.ones(4), 0), texts, passes)
    again = sum(read.values()) - passes * sum(sizes)  # what fills up the last stretch
    assert set(read) == set(range(sum(sizes))) and min(read.values()) == passes and 0 <= again < 128 * passes
    assert begun >= passes * len(sizes)


def test_windows_use_their_arrays_again():
    """New large arrays cost 2,400 to 2,900 page faults a window, a fifth of the time of learning. Two windows are learned from before, for what is made once."""
    resource = pytest.importorskip("resource")
    rng = np.random.default_rng(8)
    texts = [np.append(rng.integers(1, gru.SIZE + 1, 999), 0).astype(np.uint16) for _ in range(1010)]
    w = gru.fresh(np.ones(gru.SIZE), 5)
    faults = []
    for windows in (2, 22):
        before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
        gru.learn(w, texts, windows=windows)
        faults.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)
    assert faults[1] - faults[0] < 20 * 500


def test_rows_are_added_at_frequent_and_rare_places():
    rng = np.random.default_rng(7)
    at, rows = rng.zipf(1.3, 3000) % 50, rng.normal(0, 1, (3000, 4))
    want, got = np.zeros((60, 4)), np.zeros((60, 4))
    np.add.at(want, at, rows)
    gru.add_rows(got, at, rows)
    assert got == pytest.approx(want)


def test_model_learns_from_every_training_text(spark, monkeypatch):
    """What a word adds to the gates changes only where it was read: 4,000 texts of a word each, in five rounds of lanes."""
    monkeypatch.setattr(scoring, "LANE", 1000)
    rows = [(zlib.crc32(str(k).encode()) * 2**31 + k, np.array([k, k, k, 0], "<u2").tobytes()) for k in range(1, 4001)]
    df = spark.createDataFrame(rows, "h long, ids binary")
    before = gru.fresh(np.ones(4096), 0)
    assert [lanes for *_, lanes in scoring.rounds(16_000)] == [1, 1, 2, 4, 8]
    one, seven = (scoring.fitted(df.repartition(k), 16_000, before) for k in (1, 7))
    changed = (one.gates != before.gates).any(1)
    assert changed[1:4001].all() and not changed[4001:].any()  # 0 ends a text: nothing comes after it
    assert all((a == b).all() for a, b in zip(one.all(), seven.all()))


def scored(spark, rows, **more):
    df = spark.createDataFrame([(i, t, 0, "x", "y", 1.0) for i, t in rows], "doc_id long, text string, _row int, rare string, word string, score double")
    out = scoring.score_texts(df, windows=5, **more)
    assert set(df.columns) | {"lm"} == set(out.columns)
    return out.select("doc_id", "text", "lm.*").collect()


@pytest.mark.parametrize("listed", [3, 40, 1 << 17])
def test_base_is_plain_counting(spark, listed):
    rng = random.Random(5)
    odd = [None, "", " \t\n", "The the THE é É 日本 \x00", "a\x0bb\x0cc\x85d", "long" * 5000, "word " * 9000 + "end"]
    rows = [(i, " ".join(f"w{int(300 * rng.random() ** 4)}" for _ in range(rng.randrange(80)))) for i in range(120)]
    rows += [(200 + i, t) for i, t in enumerate(odd)] + [(None, "w1 w2 new"), (None, None), (7, "w1 twice"), (7, "w1 twice"), (2**60 + 1, "W0 w0 only")]
    want = plain(rows)
    got = scored(spark, rows, listed=listed)
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(map(repr, rows))
    for r in got:
        held_out, n_tokens, n_known, n, base = want[r.doc_id, r.text]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out, n_tokens, n_known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9) and r.score < 0


def test_scores_do_not_depend_on_the_list(spark):
    said = [f"w{k}" for k in range(5000)] * 3 + [f"x{k}" for k in range(4000)]
    random.Random(6).shuffle(said)
    rows = [(3 * 10**9 + i, " ".join(said[i::150])) for i in range(150)]
    many, few = ({r.doc_id: r.score for r in scored(spark, rows, listed=n)} for n in (1 << 17, 7000))
    assert many == pytest.approx(few, rel=1e-5)


def test_no_rows_and_no_training_rows(spark):
    assert scored(spark, []) == []
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    for r in scored(spark, [(i, "some words") for i in held]):
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)


def test_list_is_cut_between_counts(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 5), ("c", 9), ("d", 90_000), ("e", 1)], "word string, c long")
    assert scoring.most_frequent(counts, 2) == [("d", 90_000), ("c", 9)]
    assert scoring.most_frequent(counts, 3) == [("d", 90_000), ("c", 9)]
    assert [w for w, _ in scoring.most_frequent(counts, 4)] == ["d", "c", "a", "b"]
    assert scoring.most_frequent(counts.limit(0), 4) == []


def test_words_are_those_of_the_pattern():
    flat, owner = scoring.words_of(pa.array(["A b\tC", "", "É\r\nx\x0b\x0c"]))
    assert flat.to_pylist() == ["a", "b", "c", "É", "x"] and owner.tolist() == [0, 0, 0, 2, 2]


def test_model_beats_the_base_on_held_out_texts(spark):
    rows = Q.op13_language_model(spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count()
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > 0.97 * sum(r.base_score for r in held)
