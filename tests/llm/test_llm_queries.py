"""The registered queries on whole tables against SQL, plain versions and held-out labels."""

import hashlib
import re
from collections import Counter, defaultdict
from zlib import crc32

import corpus_pipeline
import pytest
from compare import compare, open_tables

import __spark_entry__ as driver
from loghelm.llm import queries

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def table(folder, sql):
    return open_tables(folder).execute(sql).fetchall()


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(driver.queries())
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SMALL), open_tables(SMALL), queries.ORACLES[name]) is None


@pytest.mark.parametrize(("name", "label", "modulus", "rest"), [("op1_toxicity", "toxic", 5, 0), ("op8_quality", "quality", 3, 1)])
def test_classifiers_on_held_out_rows(spark, name, label, modulus, rest):
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, "/root/testdata/sf0.1").collect()}
    truth = dict(table("/root/testdata/sf0.1", f"SELECT doc_id, {label} FROM labels"))
    assert len(got) == 10000
    assert all(r.held_out == (crc32(str(i).encode()) % modulus == rest) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [i for i in truth if got[i].held_out]
    recalls = [sum(got[i].predicted == truth[i] for i in held if truth[i] == v) / max(1, sum(truth[i] == v for i in held)) for v in (0, 1)]
    assert min(recalls) > 0.8


def test_decontamination_finds_every_verbatim_item(spark):
    got = {(r.doc_id, r.item_id): r for r in queries.QUERIES["op2_decontaminate"](spark, LARGER).collect()}
    docs, items = dict(table(LARGER, "SELECT doc_id, text FROM documents")), dict(table(LARGER, "SELECT item_id, text FROM benchmark"))
    fold = lambda text: " ".join(re.findall(r"[^\W_]+", text.lower()))
    want = {(d, i) for d, text in docs.items() for i, item in items.items() if f" {fold(item)} " in f" {fold(text)} "}
    assert want <= set(got)
    for (d, i), r in got.items():
        found, item = fold(docs[d][r.begin : r.end]), fold(items[i])
        assert (found == item) if r.edits == 0 else edit_distance(found, item) <= 0.08 * len(item) + 2


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_passages(docs, window=35):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", text or "") for i, text in docs}
    starts = Counter(tuple(w[k : k + window]) for w in words.values() for k in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if starts[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_passages_equal_the_plain_version(spark):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op4_substring_dedup"](spark, SMALL).collect()}
    assert got == plain_passages(table(SMALL, "SELECT doc_id, text FROM documents"))


def plain_classes(docs, threshold=0.8, n=5):
    """doc_id -> (class_id, n_links) from all pairs of different texts."""
    ids = defaultdict(list)
    for i, text in docs:
        ids[text or ""].append(i)
    texts = list(ids)
    sets = []
    for text in texts:
        w = text.split()
        m = min(n, len(w))
        sets.append({tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set())
    links, root = [0] * len(texts), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    first = {}
    for k, text in enumerate(texts):
        first[find(k)] = min([first.get(find(k), 10**9), *ids[text]])
    return {i: (first[find(k)], links[k]) for k, text in enumerate(texts) for i in ids[text]}


def test_near_duplicates_equal_the_plain_version(spark):
    got = {r.doc_id: (r.class_id, r.n_links) for r in queries.QUERIES["op6_near_duplicates"](spark, SMALL).collect()}
    assert got == plain_classes(table(SMALL, "SELECT doc_id, text FROM documents"))


def test_main_text_is_the_article(spark):
    import html

    pages = dict(table(SMALL, "SELECT page_id, html FROM pages"))
    for r in queries.QUERIES["op7_html_text"](spark, SMALL).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert r.n_chars == len(r.text)


def plain_secrets(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_secrets_hold_the_plain_ones(spark):
    docs = dict(table(LARGER, "SELECT doc_id, text FROM documents"))
    rows = queries.QUERIES["op10_secrets"](spark, LARGER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain_secrets(docs[r.doc_id] or "")
        shown = ",".join(f"{k}:{b}:{e}" for k, b, e in want)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in want) for k in ("assign", "access", "hex"))
        assert set(shown.split(",")) <= set(r.spans.split(",")) or not shown


def test_shards_are_even_and_gapless(spark):
    rows = queries.QUERIES["op9_sharding"](spark, LARGER).collect()
    docs = dict(table(LARGER, "SELECT doc_id, text FROM documents"))
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, crc32(raw), "rows", None)
    assert set(by_shard) == set(range(8)) and len(rows) == len(docs)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    groups = defaultdict(set)
    for r in rows:
        groups[docs[r.doc_id]].add(r.shard)
    # At most one group is cut for each shard.
    assert sum(len(s) > 1 for s in groups.values()) <= 8


def test_pipeline_stages_equal_plain_versions(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs, ids, seen = documents, None, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stage(spark, docs, SMALL).cache()
        seen[name] = docs.collect()
        assert docs.columns[: len(before)] == before
    texts = dict(table(SMALL, "SELECT doc_id, text FROM documents"))
    kept = sorted(r.doc_id for r in seen["quality"])
    truth = dict(table(SMALL, "SELECT doc_id, quality FROM labels"))
    assert sum(truth[i] for i in kept if i in truth) >= 0.9 * sum(truth.values())
    classes = plain_classes([(i, texts[i]) for i in kept])
    ids = sorted(r.doc_id for r in seen["near duplicates"])
    assert ids == sorted({c for c, _ in classes.values()})
    fold = lambda text: " ".join(re.findall(r"[^\W_]+", text.lower()))
    items = [fold(t) for (t,) in table(SMALL, "SELECT text FROM benchmark")]
    assert [i for i in ids if not any(x in fold(texts[i]) for x in items)] == sorted(r.doc_id for r in seen["decontamination"])
    mixed = Counter(r.doc_id for r in seen["mixing"])
    assert set(mixed) <= {r.doc_id for r in seen["decontamination"]}
    assert Counter(r.doc_id for r in seen["sharding"]) == mixed
    sizes = Counter(r.shard for r in seen["sharding"])
    assert max(sizes.values()) - min(sizes.values()) <= 1
    again = corpus_pipeline.run(spark, SMALL)
    assert Counter(r.doc_id for r in again.collect()) == mixed
