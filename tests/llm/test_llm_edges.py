"""Nulls, empty and long texts, ties and repeated rows, empty tables and clashing names, operator by operator."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_queries import plain_classes, plain_passages

from loghelm.llm import decontaminate, exact_dedup, html_text, mixing, near_duplicates, quality, secrets, sharding, substring_dedup, toxicity
from loghelm.llm.fm_index import FMIndex
from loghelm.llm.graph import connected_components

SCHEMA = "doc_id long, text string, source string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
ROWS = [
    (1, "a b c d e f g", "s"), (2, "a b c d e f g", "s"), (2, "a b c d e f g", "s"), (3, None, None), (4, "", "s"), (None, "one two", "t"),
    (None, None, "t"), (5, LONG, "t"), (6, LONG + " end", "t"), (7, "   \t\n", "s"), (8, "é" * 50_000, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_classes(spark, docs, none):
    out = exact_dedup.exact_classes(docs.withColumn("kept", F.lit("own")).withColumn("x", F.lit(1)), keep="smallest").collect()
    assert len(out) == len(ROWS) and {r.x for r in out} == {1}
    by_text = {r.text: r for r in out if r.doc_id == 2}
    assert by_text["a b c d e f g"].keep_id == 1 and by_text["a b c d e f g"].group_size == 3
    assert Counter((r.keep_id, r.group_size) for r in out if not r.text) == {(3, 3): 3}
    assert [r.kept for r in out if r.doc_id is None] == [True, False] or [r.kept for r in out if r.doc_id is None] == [False, True]
    assert exact_dedup.exact_classes(none).count() == 0


def test_exact_classes_tell_collisions_apart(docs):
    out = exact_dedup.exact_classes(docs, keep="largest", content_hash=F.lit("same")).collect()
    want = exact_dedup.exact_classes(docs, keep="largest").collect()
    row = lambda r: (str(r.doc_id), r.text, str(r.keep_id), r.group_size, r.kept, r.text_sha256)
    assert sorted(map(row, out), key=str) == sorted(map(row, want), key=str)


def test_mixing(spark, docs, none):
    out = mixing.mix_sources(docs.withColumn("copy", F.lit("own")), weights={"s": 1.0, "t": 3.0}, epochs=200.0).collect()
    assert {r.source for r in out} == {"s", "t"} and Counter(r.doc_id for r in out)[8] == 0
    assert mixing.mix_sources(none).count() == 0
    again = mixing.mix_sources(docs, weights={"s": 1.0, "t": 3.0}, epochs=200.0).collect()
    assert Counter((r.doc_id, r.copy) for r in out) == Counter((r.doc_id, r.copy) for r in again)


@pytest.mark.parametrize("rate", [0.3, 2.5, 40.0])
def test_mixing_counts_are_poisson(spark, rate):
    one = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text"), F.lit("s").alias("source"))
    counts = Counter(r.doc_id for r in mixing.mix_sources(one, epochs=rate).select("doc_id").collect())
    n = np.array([counts.get(i, 0) for i in range(4000)])
    assert abs(n.mean() - rate) < 4 * (rate / 4000) ** 0.5
    assert abs(n.var() / rate - 1) < 0.15


def test_near_duplicates(spark, docs, none):
    out = near_duplicates.near_duplicate_classes(docs.withColumn("class_id", F.lit("own"))).collect()
    assert len(out) == len(ROWS)
    by_id = {r.doc_id: r for r in out if r.doc_id}
    assert (by_id[5].class_id, by_id[5].n_links, by_id[6].class_id) == (5, 1, 5)
    assert (by_id[2].class_id, by_id[2].n_links, by_id[2].n_copies) == (1, 0, 3)
    assert (by_id[4].class_id, by_id[7].class_id) == (3, 7)
    assert near_duplicates.near_duplicate_classes(none).count() == 0
    kept = near_duplicates.keep_one_of_each_class(docs.withColumn("node", F.lit(9))).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "5", "7", "8", "None"] and {r.node for r in kept} == {9}


def test_near_duplicates_in_a_large_group(spark, monkeypatch):
    """Blocks of one group, and a chain of texts whose ends aren't alike."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 7)
    rng = random.Random(4)
    base = [f"v{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), "s"))
    for i in range(60, 80):
        base = [*base[3:], f"c{i}", f"d{i}", f"e{i}"]
        rows.append((i, " ".join(base), "s"))
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates.near_duplicate_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain_classes([r[:2] for r in rows])


def test_passages(spark, docs, none):
    out = substring_dedup.repeated_passages(docs.withColumn("edges", F.lit("own")).drop("source")).collect()
    assert len(out) == len(ROWS)
    assert {r.doc_id: r.n_removed for r in out}[5] == 60_000 and {r.doc_id: r.n_removed for r in out}[6] == 60_000
    assert all(r.n_removed == 0 for r in out if r.doc_id in (1, 2, 3, 4, 7, 8))
    assert substring_dedup.repeated_passages(none).count() == 0


def test_passages_with_frequent_ones_taken_apart(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MANY_SEGMENTS", 5)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 300)
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(200)}"
    passage = [word() for _ in range(50)]
    rows = []
    for i in range(40):
        text = [word() for _ in range(rng.randrange(60))]
        text += passage[: rng.randrange(20, 51)] if i % 2 else []
        text += ["tick"] * rng.choice([0, 34, 35, 36, 90])
        rows.append((i, " ".join([*text, *(word() for _ in range(rng.randrange(40)))]), "s"))
    rows.append((99, rows[3][1], "s"))
    out = substring_dedup.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == plain_passages([r[:2] for r in rows])


def test_passages_split_at_ascii_blanks_only(spark):
    odd = " ".join(f"a\u00a0{i}\x1cb\u2028{i}\x85 c\x0bd\x0c\re{i}\t\n f" for i in range(12))
    rows = [(1, odd, "s"), (2, "x " + odd.replace(" ", "\t\x0b") + " y", "s"), (3, odd.replace("\u00a0", " "), "s")]
    out = substring_dedup.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out}
    assert got == plain_passages([r[:2] for r in rows]) and got[1][1] == got[1][0] and got[3][1] == 0


def test_fm_index_counts_windows():
    rng = np.random.default_rng(1)
    segments = [rng.integers(1, 4, rng.integers(4, 30)) for _ in range(30)]
    weights = rng.integers(1, 5, 30)
    index = FMIndex(segments, weights, 4)
    want = Counter()
    for s, w in zip(segments, weights, strict=True):
        for k in range(len(s) - 3):
            want[tuple(s[k : k + 4])] += int(w)
    for s, got in zip(segments, index.weights_of_windows(segments), strict=True):
        assert got.tolist() == [want[tuple(s[k : k + 4])] for k in range(len(s) - 3)]


def test_components(spark):
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("x", "y"), ("y", "x"), ("z", "z")]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {**{f"{i:03}": "000" for i in range(41)}, "x": "x", "y": "x"}


ITEM = "The quick brown foxes jumped over all of the lazy dogs that slept near the old river bank today"


def test_benchmark(spark, docs, none):
    items = [(1, ITEM), (2, None), (3, ""), (4, "short one"), (5, ITEM.upper()), (6, "..."), (7, "zq")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    typo = ITEM.replace("quick", "quikc").replace("lazy ", "")
    texts = [(1, "Before. " + ITEM + " After"), (2, typo + "!"), (3, ITEM[:50]), (4, "a short   one."), (5, "shortone"), (6, None), (7, LONG + " " + ITEM), (8, "zqx")]
    out = decontaminate.find_benchmark(spark.createDataFrame(texts, "doc_id long, text string").withColumn("hits", F.lit(0)), benchmark)
    found = {r.doc_id: {(h.item_id, h.edits == 0) for h in r.hits} for r in out.collect()}
    assert found[1] == {(1, True), (5, True)} and found[2] == {(1, False), (5, False)} and found[7] == found[1]
    assert found[4] == {(4, True)} and not any(found[i] for i in (3, 5, 6, 8))
    span = next(h for r in out.collect() if r.doc_id == 1 for h in r.hits)
    assert texts[0][1][span.begin : span.end] == ITEM
    assert decontaminate.decontaminate(docs, benchmark).count() == len(ROWS)
    assert decontaminate.decontaminate(docs, benchmark.limit(0)).count() == len(ROWS)
    assert decontaminate.find_benchmark(none, benchmark).count() == 0


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    items = [(i, f"item number {i} " + " ".join(f"x{i}y{k}" for k in range(12))) for i in range(5)]
    texts = [(i, "pad " + items[i][1] + " pad " + items[(i + 2) % 5][1]) for i in range(5)]
    out = decontaminate.find_benchmark(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: sorted(h.item_id for h in r.hits) for r in out.collect()} == {i: sorted([i, (i + 2) % 5]) for i in range(5)}


def test_benchmark_edits_within_the_budget_are_found():
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    items = ["".join(rng.choice(letters + " ") for _ in range(rng.randrange(60, 200))).strip() for _ in range(40)]
    block = decontaminate.Items(list(range(40)), items)
    for i in range(40):
        codes = list(decontaminate._string(block.codes[i]))
        for _ in range(int(block.edits[i])):
            at, kind = rng.randrange(len(codes)), rng.choice("sid")
            codes[at : at + (kind != "i")] = [] if kind == "d" else [rng.choice(letters)]
        text = " ".join(["x" * rng.randrange(30), "".join(codes), "y z"])
        assert any(h["item_id"] == i for h in block.search([text])[0])


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body class="page">
<header><a href="/">Home</a> Site</header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies and that is all of it for you to read in the end</div>
<h1>Of rivers &amp; seas</h1>
<p>The river is <b>long</b> and it is the one of the many that run to the sea, and it was known for that by all &#8211; then.
<p>Short.<p>That is the end of the text, and with it goes the view that it was not as long as the others in the land.</div>
<form>Name <input name=n> <button>Send</button></form><aside>Also in this place: the other story of the day and of the week.</aside>
<section id="comments"><p>This is what I have to say on the river, and it is not at all what you have to say on it.</p></section>
<footer>&copy; the site and all of the people in it</footer>"""


def test_main_text(spark):
    pages = [(1, PAGE), (2, None), (3, ""), (4, "plain"), (5, "<p>"), (6, "<p><b>x < y</p><"), (7, "<article><p>A&nbsp;b</p><p>c</article>"), (7, "<article><p>A&nbsp;b</p><p>c</article>")]
    out = html_text.extract_main_text(spark.createDataFrame(pages, "page_id long, html string").withColumn("text", F.lit(1))).collect()
    text = {r.page_id: r.text for r in out}
    assert text[1] == (
        "Of rivers & seas The river is long and it is the one of the many that run to the sea, and it was known for that by all – then."
        " Short. That is the end of the text, and with it goes the view that it was not as long as the others in the land."
    )
    assert (text[2], text[3], text[5], text[7]) == ("", "", "", "A b c")
    assert len(out) == len(pages)
    assert html_text.extract_main_text(spark.createDataFrame([], "html string")).count() == 0


def test_secrets(spark, docs, none):
    key = "AKIA" + "B7Q2" * 4
    strong = "tOkEn = 'abcd1234efgh' " + key + " " + "0123456789abcdef" * 2
    weak = "Zx81kQpL09vTr4WmYb"
    texts = [
        (1, strong), (2, f"it says {weak} here"), (3, f"{key} and {weak}"), (4, f"{key}\n\n{weak}"), (5, f"{key} {'pad ' * 100}{weak}"),
        (6, f"https://api.example.com/v1 {weak}"), (7, "https://api.example.com/v1 alone"), (8, None), (9, "secret: short"), (10, "ſecret=abcdefgh1"),
    ]
    out = secrets.find_credentials(spark.createDataFrame(texts, "doc_id long, text string").withColumn("spans", F.lit(1))).collect()
    kinds = {r.doc_id: [s.kind for s in r.spans] for r in out}
    assert kinds == {
        1: ["assign", "access", "hex"], 2: [], 3: ["access", "secret"], 4: ["access"], 5: ["access"], 6: ["endpoint", "secret"], 7: [],
        8: [], 9: [], 10: [],
    }
    assert secrets.find_credentials(docs).count() == len(ROWS) and secrets.find_credentials(none).count() == 0


def test_sharding(spark, docs, none):
    out = sharding.shard_documents(docs.withColumn("slot", F.lit("own")), shards=4).collect()
    assert len(out) == len(ROWS)
    by = Counter(r.shard for r in out)
    assert max(by.values()) - min(by.values()) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in by.items())
    assert sharding.shard_documents(none).count() == 0


def test_sharding_cuts_a_group_that_is_too_large(spark):
    rows = [(i, "copy" if i < 400 else f"text {i // 3}", "s") for i in range(900)]
    out = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA), shards=6).collect()
    assert sorted(Counter(r.shard for r in out).values()) == [150] * 6
    groups = {}
    for r in out:
        groups.setdefault(r.text, set()).add(r.shard)
    # All rows are linked and one group is three shards large, so some others must give way.
    assert sum(len(s) > 1 for s in groups.values()) < len(groups) / 3


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers(docs, none, module):
    good = [f"the river {i} is wide and the road is long" for i in range(60)]
    bad = [f"THE RIVER {i} badword !!! WIDE WIDE WIDE" for i in range(60)]
    texts, labels = good + bad, np.array([0] * 60 + [1] * 60, np.float32)
    part = np.linspace(0, 1, 120, endpoint=False)[np.random.default_rng(0).permutation(120)]
    fit = {toxicity: toxicity.toxicity_scores, quality: quality.quality_scores}[module]
    rows = fit(docs.withColumn("score", F.lit("own")), texts, labels, part).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    scorer = module.train(texts, labels, part)
    score = scorer if callable(scorer) else module.Scorer(scorer)
    assert (score(good) < 0.5).mean() > 0.9 and (score(bad) >= 0.5).mean() > 0.9
    assert fit(none, texts, labels, part).count() == 0
    for few in ([], ["a"], ["a", "b"]):
        one = fit(docs, few, np.ones(len(few), np.float32), np.linspace(0, 1, len(few))).collect()
        assert len({r.score for r in one}) == 1


def test_attention_gradients():
    """Against differences of the loss."""
    rng = np.random.default_rng(0)
    net = quality.AttentionNet(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items() if k != "E"}
    x, counts = rng.standard_normal((7, quality.DIMENSIONS + quality.MEASURES)), np.array([3, 0, 4])
    error = np.array([0.3, -0.2, 0.5])
    got, _ = net.gradients(x, net.forward(x, counts), error)
    for name, value in net.p.items():
        at = tuple(rng.integers(0, n) for n in value.shape)
        before, step = value[at], 1e-4
        losses = []
        for shift in (step, -step):
            value[at] = before + shift
            losses.append(float(net.forward(x, counts)["logits"].astype(np.float64) @ error))
        value[at] = before
        assert abs((losses[0] - losses[1]) / (2 * step) - got[name][at]) < 5e-3
