"""Language model, lexical search and hard negatives against plain versions, with their edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loghelm.llm import hard_negatives, language_model, lexical

SCHEMA = "doc_id long, text string"


def plain_tokens(text):
    return [w for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())] + [b"\n"]


def make_texts(n, seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "River", "sea", "ÉTÉ", "und"]) if rng.random() < 0.4 else f"w{int(rng.paretovariate(0.7)) % 400}"
    rows = [(i, " ".join(word() for _ in range(rng.randrange(1, 120)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \t\x0b\n"), (n + 3, rows[0][1]), (n + 3, rows[0][1]), (None, "the sea"), (n + 4, "a b\x1cc " * 3000)]


@pytest.mark.parametrize("order,slice_bytes", [(1, 1 << 28), (2, 1 << 28), (3, 1 << 28), (2, 3000), (3, 3000)])
def test_language_model(spark, monkeypatch, order, slice_bytes):
    """Counts and base scores are exact; scores are those of the quantised counts but for a few false finds, in any slices."""
    monkeypatch.setattr(language_model, "PART_BYTES", 1 << 12)
    monkeypatch.setattr(language_model, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(language_model, "STEP_TOKENS", 700)
    monkeypatch.setattr(language_model, "COUNT_TOKENS", 900)
    rows = make_texts(150)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("Score", F.lit("own")).withColumn("state", F.lit(1))
    learn = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))
    got = language_model.language_model_scores(docs, learn, order=order, probes=16).collect()
    assert len(got) == len(rows) and got[0].state == 1 and isinstance(got[0].score, float)
    counts = Counter()
    grams = [Counter() for _ in range(order)]
    begin = [b"\n\n"] * order
    for i, text in rows:
        if i is None or i % 3:
            tokens = plain_tokens(text)
            counts.update(tokens)
            padded = begin + tokens
            for n in range(order):
                grams[n].update(tuple(padded[at - n : at + 1]) for at in range(order - 1, len(padded)))
    total, distinct = sum(counts.values()), len(counts)
    mean = lambda c: language_model.MEANS[np.searchsorted(language_model.LEVELS, c, side="right")]

    def score(tokens):
        padded, out = begin + tokens, 0.0
        for at in range(order, len(padded)):
            p = (mean(grams[0][(padded[at],)]) + 1) / (total + distinct + 1)
            for n in range(1, order):
                context = mean(grams[n - 1][tuple(padded[at - n : at])])
                p = (min(mean(grams[n][tuple(padded[at - n : at + 1])]), context) + language_model.PRIOR * p) / (context + language_model.PRIOR)
            out += math.log10(p)
        return out

    scores = {}
    for r in got:
        tokens = plain_tokens(r.text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[t] > 0 for t in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens))
        assert r.score == pytest.approx(score(tokens), rel=2e-3) and r.score <= 0
        scores.setdefault(r.text or "", set()).add(r.score)
    assert all(len(s) == 1 for s in scores.values())


def test_language_model_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], SCHEMA)
    nothing = language_model.language_model_scores(docs, F.lit(False)).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in nothing} == {(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)}
    assert language_model.language_model_scores(docs.limit(0), F.lit(True)).count() == 0


def test_filter_never_finds_too_low_a_level():
    rng = np.random.default_rng(5)
    grams, counts = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)), rng.integers(1, 10**9, 5000)
    counts[:4000] = 1
    part = {"part": 0, "words": b"", "word_counts": b"", "filter": language_model._filter(grams, counts, 6).tobytes()}
    there = language_model.Slice([part], 0, 6).levels(grams)
    true = np.searchsorted(language_model.LEVELS, counts, side="right")
    assert (there >= true).all() and (there > true).mean() < 0.04
    absent = language_model.Slice([part], 0, 6).levels(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64))
    assert (absent > 0).mean() < 0.03


def plain_search(docs, items, k):
    terms = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, bag) for i, bag in bags if bag]
    df = Counter(t for _, bag in bags for t in bag)
    n, total = len(bags), sum(sum(bag.values()) for _, bag in bags)
    out = set()
    for item, text in items:
        hits = []
        for i, bag in bags:
            m = 25 + 75 * sum(bag.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in terms(text) if bag[t])
            if score > 0:
                hits.append((-score, i is None, i))
        out |= {(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(hits)[:k], 1)}
    return out


@pytest.mark.parametrize("group", [50, 10**6])
def test_lexical_search(spark, monkeypatch, group):
    """Ties, repeated rows, nulls, strata in several groups and tasks, blocks of items, clashing names."""
    monkeypatch.setattr(lexical, "GROUP_POSTINGS", group)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 6)
    rows = make_texts(120) + [(200 + i, "the sea the SEA of w1-w2") for i in range(30)]
    items = [(i, " ".join((t or "").split()[:9])) for i, t in make_texts(12, 9)] + [(70, "sea sea zzz"), (71, "???")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("row", F.lit(1)).withColumn("terms", F.lit(2))
    got = lexical.ranked_search(docs, spark.createDataFrame(items, "item_id long, text string").withColumn("block", F.lit(1)), 7).collect()
    want = plain_search(rows, [x for x in items if x[0] is not None and x[0] != 15], 7)
    assert {tuple(r) for r in got if r.item_id is not None and r.item_id != 15} == want
    assert Counter((r.item_id, r.rank) for r in got if r.item_id == 15) == {(15, rank): 2 for rank in range(1, 8)}  # the item that repeats
    assert lexical.ranked_search(docs.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert lexical.ranked_search(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def plain_negatives(rows, positives=5, negatives=3):
    out = Counter()
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None for x in r[2])]
    for anchor, label, vector in [r for r in rows if r[0] % 10 == 0]:
        scored = [(sum(x * y for x, y in zip(vector, v)), i, own) for i, own, v in rows]
        best = sorted([(-s, i) for s, i, own in scored if own == label and i != anchor])[:positives]
        for p, positive in best:
            band = sorted((-s, i) for s, i, own in scored if own != label and 50 * -p <= 100 * s <= 95 * -p)[:negatives]
            out.update((anchor, positive, rank, i, -p, -s) for rank, (s, i) in enumerate(band, 1))
    return out


@pytest.mark.parametrize("block", [4 << 20, 1024])
def test_hard_negatives(spark, monkeypatch, block):
    """Ties, repeats, nulls, zero vectors, vectors of several lengths, several blocks of anchors and steps of rows."""
    monkeypatch.setattr(hard_negatives, "BLOCK_COMPONENTS", block)
    monkeypatch.setattr(hard_negatives, "STEP_ROWS", 37)
    monkeypatch.setattr(hard_negatives, "STEP_ANCHORS", 3)
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 3)), rng.integers(-40, 60, 20).tolist()) for i in range(150)]
    rows += [(200 + i, i % 2, rows[10][2]) for i in range(12)] + [(12, 1, rows[12][2])] * 2 + [(310, 1, [5] * 70), (311, 0, [4] * 70), (320, 0, []), (321, 0, [0, 0])]
    rows += [(400, None, [1]), (410, 1, None), (420, 1, [1, None]), (None, 1, [1])]
    frame = spark.createDataFrame(rows, "id long, label long, vector array<long>").repartition(4).withColumn("code", F.lit(1))
    got = hard_negatives.mine_hard_negatives(frame, F.col("id") % 10 == 0).collect()
    assert Counter(map(tuple, got)) == plain_negatives(rows)
    assert hard_negatives.mine_hard_negatives(frame.limit(0), F.col("id") % 10 == 0).count() == 0
    assert hard_negatives.mine_hard_negatives(frame, F.lit(False)).count() == 0


def test_hard_negative_columns(spark):
    rows = [(0, [float("nan")], 1), (7, [0.5, -0.001], 9), (50, [1.0, None], 1), (100, None, 1), (150, [1.0, 0.5], 0), (151, [0.25, 0.25], None), (152, [1.0, 0.1], 0), (153, [0.6, 0.1], 3), (None, [1.0], 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("ID", F.lit("x"))
    got = hard_negatives.op11_hard_negatives(frame).collect()
    # Vector 7 has label (9 + 1) % 10 = 0; components are (128, -1), (256, 128), (256, 25), (153, 25).
    assert {tuple(r) for r in got} == {(150, 152, 1, 153, 68736, 42368)}


def test_intervals_hold_and_narrow():
    """The inner product lies in its interval, which is narrower than the norms allow."""
    rng = np.random.default_rng(0)
    rows, asked = rng.integers(-300, 300, (200, 64)), rng.integers(-300, 300, (20, 64))
    rows[0], asked[0], rows[1] = 0, 0, asked[1]
    anchors = hard_negatives.Anchors(asked)
    lower, upper = anchors.intervals(slice(0, 20), *hard_negatives.codes_of(rows))
    true = asked @ rows.T
    assert (lower <= true).all() and (true <= upper).all()
    norms = np.linalg.norm(asked, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :]
    assert np.median((upper - lower)[1:, 2:] / (2 * norms[1:, 2:])) < 0.75
