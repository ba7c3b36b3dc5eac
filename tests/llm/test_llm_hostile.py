"""Inputs a web crawl holds: other scripts, odd class names, unclosed tags, long runs, templates."""

import random
import time

import pytest

from loghelm.llm import decontaminate, html_text, near_duplicates, secrets

RUSSIAN = (
    "Река берёт начало на склонах хребта, где снег лежит до середины лета, и течёт на север через широкую долину. "
    "Весной вода поднимается на несколько метров, заливает луга и приносит ил, от которого зависит урожай."
)
CHINESE = "这条河发源于高山的北坡，山上的积雪直到夏天才会融化。每年春天，河水上涨，淹没两岸的草地，给农田带来肥沃的泥土。几百年来，人们在河边建造村庄，靠捕鱼和种田为生，河水决定了他们的生活。" * 2
POLISH = (
    "Rzeka bierze swój początek na północnych stokach gór, gdzie śnieg leży aż do połowy lata, i płynie szeroką doliną. "
    "Wiosną woda podnosi się o kilka metrów, zalewa łąki i przynosi muł, od którego zależą zbiory w okolicy."
)
ENGLISH = "The river rises on the slopes of the range where the snow lies until the middle of summer, and it flows to the north in a wide valley that is full of farms. " * 2
MENU = "<div class=menu><ul><li><a href=/a>{0}</a><li><a href=/b>{0}</a><li><a href=/c>{0}</a></ul></div>"


@pytest.mark.parametrize(("text", "word"), [(RUSSIAN, "Новости"), (CHINESE, "新闻"), (POLISH, "Aktualności"), (ENGLISH, "News")])
def test_main_text_in_any_language(text, word):
    page = f"<html><body>{MENU.format(word)}<ul><li><a href=/x>{word}</a></ul><div><h1>{word}</h1><p>{text}</p><p>{word}.</p><p>{text}</p></div><div class=footer>{text[:60]}</div></body></html>"
    text = text.strip()
    assert html_text.main_text(page) == f"{word} {text} {word}. {text}"


@pytest.mark.parametrize("names", [
    "post category-legal", "entry-content share-buttons-on", "story social-policy", "content comments-open", "post tag-social", "post-content",
    "sidebar-page", "page has-sidebar", "site-content", "banner-page", "widget-area",
])
def test_main_text_under_any_class(names):
    page = f"<body>{MENU.format('News')}<div class='{names}'><p>{ENGLISH}</p><p>{ENGLISH}</p></div><div class='comments-area'><p>{ENGLISH * 9}</p></div></body>"
    want = ENGLISH.strip()
    assert html_text.main_text(page) == f"{want} {want}"


@pytest.mark.parametrize("names", ["comments", "comment-list", "comment-content", "related-posts", "cookie-notice", "nav-links", "sidebar-left", "share-buttons", "ad", "site-footer"])
def test_parts_stay_out(names):
    article = f"<div><p>{ENGLISH}</p><p>{ENGLISH}</p></div>"
    assert html_text.main_text(f"{article}<div class='{names}'><p>{ENGLISH}</p></div>") == " ".join([ENGLISH.strip()] * 2)


def test_comments_alone_are_no_article():
    assert html_text.main_text(f"<div id=comments><p>{ENGLISH}</p></div>") == ""


def seconds(work, *given):
    start = time.process_time()
    work(*given)
    return time.process_time() - start


def long_text(unit, size=500_000):
    return (unit * (size // len(unit) + 1))[:size]


OPEN = ["<a ", '<a "', "<a '", "<a '\"", "<a x=\"'", "</", "<!", "<script ", "<title>", "<svg>", "<div>", "</p>", "<p class='a", "<textarea><title>", "&amp", "<div>x</b></p>"]


@pytest.mark.parametrize("unit", OPEN)
def test_pages_are_read_in_linear_time(unit):
    assert seconds(html_text.main_text, long_text(unit)) < 4


def test_deep_pages_are_read_in_linear_time():
    assert seconds(html_text.main_text, "<div>" * 50_000 + "</p></section></div>" * 50_000) < 6


@pytest.mark.parametrize("unit", ["1.", "a-", "a.b", "7", "-", "A1", "aB3", "a.com ", "_a.", "userid   ", "http://", "token = ", "a:1 ", "x1y2z3w4v5u6t7s8r9 "])
def test_secrets_are_searched_in_linear_time(unit):
    assert seconds(secrets.scan, long_text(unit) + " https://a.example.com/b c1") < 4


def plain_linked(text, base, weak):
    """Every weak part against all parts: same section, and no more than REACH characters around both apart."""
    free = []
    taken = [(b, e) for _, b, e in base]
    for kind, b, e in weak:
        if all(e <= x or b >= y for x, y in taken):
            free.append((kind, b, e))
            taken.append((b, e))
    section = lambda at: sum(m.start() < at for m in secrets._SECTION.finditer(text))
    out = []
    for kind, b, e in free:
        wanted = secrets.COMPLETED_BY[secrets.ROLES[kind]]
        for other, x, y in [*base, *free]:
            if secrets.ROLES[other] in wanted and section(x) == section(b) and x <= e + secrets.REACH and y >= b - secrets.REACH:
                out.append((kind, b, e))
                break
    return out


def test_linked_spans_equal_a_plain_version():
    rng = random.Random(6)
    parts = [
        "AKIA" + "B7Q2" * 4, "password=abcd1234efgh", "Zx81kQpL09vTr4WmYb", "https://api.example.com/v1", "db.internal:5432", "user_id: root42", "A1B2C3D4E5F6",
        "deadbeef" * 4, "\n\n", "\n \t\n", "pad " * 20, "pad " * 70, "words here", "a..b.com", "_x.net", "mail.foo-bar.org-", "key id = xyz9",
    ]
    linked = 0
    for _ in range(400):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(2, 25)))
        base = secrets.base_spans(text)
        got = secrets.linked_spans(text, base)
        assert sorted(got) == sorted(plain_linked(text, base, secrets.weak_candidates(text)))
        linked += len(got)
    assert linked > 400


def fewest_edits(item, text):
    """Of the item against any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def edited(rng, item, edits, letters):
    codes = list(item)
    for _ in range(edits):
        at, kind = rng.randrange(len(codes)), rng.choice("sid")
        codes[at : at + (kind != "i")] = [] if kind == "d" else [rng.choice(letters)]
    return "".join(codes)


@pytest.mark.parametrize("stem", ["", "which of the following "])
def test_benchmark_equals_edit_distance_at_every_length(stem):
    """Every item length from 10 to 120, texts with edits around the budget, also at the ends of a text."""
    rng, letters = random.Random(4), "abcdefghij"
    items = [(stem + "".join(rng.choice(letters) for _ in range(130)))[:n] for n in range(10, 121)]
    block = decontaminate.Items(list(range(len(items))), items)
    folded = ["".join(map(chr, codes)) for codes in block.codes]
    texts = []
    for i, item in enumerate(folded):
        for extra in (-1, 0, 1):
            body = edited(rng, item, max(0, int(block.edits[i]) + extra), letters)
            texts.append(rng.choice(["", "x" * rng.randrange(40) + " "]) + body + rng.choice(["", " zz " + "y" * rng.randrange(40)]))
    got = block.search(texts)
    assert sum(bool(g) for g in got) > 200
    fold = lambda text: "".join(map(chr, decontaminate.folded([text])[0][:-1]))
    for text, hits in zip(texts, got):
        found = {}
        for h in hits:
            found[h["item_id"]] = min(found.get(h["item_id"], 99), h["edits"])
            assert fewest_edits(folded[h["item_id"]], fold(text[h["begin"] : h["end"]])) == h["edits"]
        near = rng.sample(range(len(items)), 25)
        body = fold(text)
        for i in near:
            if abs(len(folded[i]) - len(body)) > 95 and i not in found:
                continue
            least = fewest_edits(folded[i], body)
            assert (found.get(i) == least) if least <= block.edits[i] else i not in found, (text, folded[i], least)


def test_benchmark_items_with_one_stem():
    """8,192 items that begin alike, and texts that hold the beginning again and again."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    stem = "which one of the following statements about the given passage is true "
    items = [stem + " ".join(word() for _ in range(rng.randrange(5, 12))) for _ in range(8192)]
    block = decontaminate.Items(list(range(8192)), items)
    texts, want = [], []
    for i in range(60):
        own = rng.sample(range(8192), 2)
        parts = [stem + " ".join(word() for _ in range(20)) for _ in range(4)] + [items[own[0]], edited(rng, items[own[1]], 3, "xyz")]
        rng.shuffle(parts)
        texts.append(". ".join(parts))
        want.append(set(own))
    start = time.process_time()
    got = block.search(texts)
    assert time.process_time() - start < 40
    assert [{h["item_id"] for h in hits} for hits in got] == want


def test_benchmark_of_repeated_characters():
    block = decontaminate.Items([1, 2], ["a" * 150, "ab" * 60])
    got = seconds(block.search, ["a" * 200_000, "ab" * 100_000])
    assert got < 30
    hits = block.search(["a" * 3000, "ab" * 1500 + " c"])
    assert [{h["item_id"] for h in found} for found in hits] == [{1}, {2}]


def template_rows(n, changed, seed=2):
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(100)]
    rows = []
    for i in range(n):
        words = list(template)
        for at in rng.sample(range(100), changed):
            words[at] = f"c{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("changed", "block"), [(8, 16), (3, 16), (1, 16)])
def test_templates_equal_all_pairs(spark, monkeypatch, changed, block):
    """Texts of one template, unlike, at the border and alike: units are buckets or the whole, results those of all pairs."""
    from test_llm_queries import plain_classes

    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    rows = template_rows(150, changed) + template_rows(10, 1, 5)
    rows = [(i, text) for i, (_, text) in enumerate(rows)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.99999).collect()}
    assert got == plain_classes(rows)


def test_templates_are_compared_by_bucket(spark):
    """Comparisons follow the pairs that share a bucket, not the square of the chain that accidental ties make."""
    docs = spark.createDataFrame(template_rows(1600, 5), "node long, text string").selectExpr("cast(node as string) node", "text")
    signed = near_duplicates.signatures(docs, 5, near_duplicates.bands_for(0.8, 0.99, 8), 8).cache()
    units = near_duplicates.candidate_units(signed, docs.selectExpr("node", "cast(length(text) as long) bytes")).collect()
    sizes = {r.unit: r.n for r in units}
    compared = sum(n * n // 2 for n in sizes.values())
    buckets = signed.selectExpr("explode(bands) band").groupBy("band").count().where("count > 1").collect()
    assert compared <= sum(r["count"] ** 2 // 2 for r in buckets) + 1600 * 256 / 2
    assert compared < 1600**2 / 8 and any(unit.startswith("band ") for unit in sizes)


def test_blocks_are_cut_by_bytes(spark, monkeypatch):
    from test_llm_queries import plain_classes

    monkeypatch.setattr(near_duplicates, "BLOCK_BYTES", 2000)
    rows = template_rows(60, 1)
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.99999).collect()}
    assert got == plain_classes(rows)
