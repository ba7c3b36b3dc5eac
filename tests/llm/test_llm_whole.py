"""Cases in which an operator once did less than its whole job."""

import numpy as np
from pyspark.sql import functions as F

from loghelm.llm import html_text, labelled, secrets, toxicity


def test_toxicity_cut_does_not_depend_on_the_bound(spark):
    """Labels 1 to 8 with overlapping scores: the cut from a sample bounded at 1 to 1 is that from all rows."""
    rng = np.random.default_rng(1)
    logits = np.concatenate([rng.normal(0, 1, 8000), rng.normal(1.5, 1, 1000)])
    truth = np.repeat(np.float32([0, 1]), [8000, 1000])
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(truth)], "doc_id long, toxic int")
    weights = labelled.label_weights(labels, "toxic", F.lit(True), 1000)
    assert weights == (8.0, 1.0) and labelled.label_weights(labels, "toxic", F.lit(True), 10_000) == (1.0, 1.0)
    bounded = np.r_[0:1000, 8000:9000]
    whole = toxicity._threshold(logits, truth, (1.0, 1.0))
    assert abs(toxicity._threshold(logits[bounded], truth[bounded], weights) - whole) < 0.25
    assert whole - toxicity._threshold(logits[bounded], truth[bounded], (1.0, 1.0)) > 0.5  # the cut of before


SENTENCE = "This is the text of the article, and it is long enough to stand by itself as the main part of the page that it is on. "


def test_main_text_keeps_pages_with_open_or_self_closing_elements():
    p = f"<p>{SENTENCE}</p>"
    want = SENTENCE.strip()
    for page in (
        f"<html><head><meta charset=utf-8><title>T</title><body>{p}", f"<head><title>T</title><link href=x>{p}", f"<head><title>T<body>{p}",
        f"<svg class='i'/>{p}", f"<svg class='i'/>{p}<svg><text>no</text></svg>", f"<video-player src=x>{p}</video-player>",
        f"<video-player src=x>{p}", f"<iframe src=x/>{p}", f"<div><button></div>{p}", f"<div><select></div>{p}<select><option>no</select>",
    ):
        assert html_text.main_text(page) == want, page
    assert html_text.main_text(f"<p>{SENTENCE}<svg><title>no</title><g><p>no</p></g></svg> End.</p>") == f"{want} End."
    assert html_text.main_text(f"{p}<script>no") == want and html_text.main_text(f"<p>{SENTENCE}<!-- no") == want
    assert html_text.main_text(f"{p}<textarea></div><p>{SENTENCE}</textarea>") == want


def test_main_text_takes_parts_around_the_article_as_wrappers():
    article = f"<article><h1>Title</h1><p>{SENTENCE}</p></article>"
    want = f"Title {SENTENCE.strip()}"
    for names in ("id='page' class='has-sidebar'", "class='no-sidebar'", "class='content with-banner'", "class='sidebar-right'", "id=page class='ads menu-open'"):
        assert html_text.main_text(f"<body><div {names}>{article}<div class=sidebar><p>{SENTENCE}</p></div></div>") == want, names
        assert html_text.main_text(f"<main><div {names}>{article}</div></main>") == want, names
    related = "<div class=related><article><p>Another article that is only shown in short, with a link to it at the end.</p></article></div>"
    assert html_text.main_text(f"<div class='sidebar-right'>{article}{related}</div>") == want
    assert html_text.main_text(f"{article}{related}") == want
    comments = f"<div id=comments><article class=comment><p>{SENTENCE * 3}</p></article></div>"
    assert html_text.main_text(f"<div><p>{SENTENCE}</p></div>{comments}") == SENTENCE.strip()
    for tag in ("nav", "footer", "aside", "form"):
        assert html_text.main_text(f"<{tag} class=sidebar>{article}</{tag}>") == ""


def test_long_tokens_are_judged_whole():
    key = "".join("aZ3kQ9xB7mW2pL5vT8cR1nY6"[i * 7 % 24] for i in range(600))
    spans = lambda token: [s["kind"] for s in secrets.scan(f"see https://host.example.com/x then {token} end")]
    assert spans(key) == ["endpoint", "secret"]
    assert spans("A1" * 150 + key) == ["endpoint", "secret"]  # a dull header first
    assert spans(key[:300] + "A1" * 20_000) == spans("A1" * 20_000 + key[:300]) == ["endpoint", "secret"]
    assert spans("A1" * 150) == []


def test_labelled_ids_give_one_text_each(spark):
    docs = spark.createDataFrame([(i % 6, f"t{i}") for i in range(600)] + [(7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    texts, truth, part = labelled.labelled_sample(docs, labels, "toxic", F.lit(True), 100)
    assert len(texts) == len(truth) == len(part) == 7
    smallest = [(min(f"t{i}" for i in range(k, 600, 6)), k % 2) for k in range(6)]
    assert sorted(zip(texts, truth)) == sorted([("", 1), *smallest])
