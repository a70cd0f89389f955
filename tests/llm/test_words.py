"""Collocations, toxicity and ranked search against plain versions, on the smallest tables and on hand-made rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tradebook.llm import collocations, queries, ranked_search, toxicity, word_ids

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, word string, score string, m long, id string, f long"
EXTRA = ("w", "s", 3, "i", 4)


def rows_of(*rows):
    return [(*r, "src", 1, *EXTRA) for r in rows]


LONG = "fast red car and slow blue van. " * 4000
DOCS = rows_of(
    (1, LONG, "en"), (2, None, "en"), (3, "", None), (None, "Fast RED car! fast red car", "en"), (5, LONG, None),
    (6, "a b a b a b a b a b a b a b a b a b a b a b a b", "x"), (6, "a b a b a b a b a b a b a b a b a b a b a b a b", "x"),
    (7, "p q r " * 12 + "; p q " * 3, "x"), (8, "no repeats at all here", ""), (9, "tie one " * 10 + ". tie two " * 10, "t"),
    (10, "\tß É é ß É é \n" * 11, "fr"), (11, ".,;:!?\n\r\x0b\x0c  \t", "fr"),
)


def plain_collocations(docs):
    pieces = defaultdict(list)
    for text, lang in docs:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            pieces["und" if lang is None else lang].append(tuple(re.findall("[^ \t]+", piece)))
    out = set()
    for lang, rows in pieces.items():
        f = Counter(w[i : i + k] for w in rows for k in (1, 2, 3) for i in range(len(w) - k + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= 10}
        kept = []
        for p, a in candidates.items():
            if len(p) == 2 and any(100 * c >= 50 * a for q, c in candidates.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:2000], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return out


def found_collocations(df):
    rows = collocations.collocations(df).collect()
    got = {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows}
    assert len(got) == len(rows) and all(" ".join(r.words) == r.phrase for r in rows)
    return got


def test_collocations(spark, sf_dir):
    hand = spark.createDataFrame(DOCS, FIELDS)
    assert found_collocations(hand.repartition(5)) == plain_collocations([(r[1], r[2]) for r in DOCS])
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found_collocations(table) == plain_collocations([(r.text, r.lang) for r in table.collect()])
    assert found_collocations(hand.limit(0)) == set()


def test_collocations_by_many_buckets(spark, sf_dir, monkeypatch):
    """Prefixes of frequent words are cut by the third word, and their totals still add up."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain_collocations([(r.text, r.lang) for r in table.collect()])
    monkeypatch.setattr(collocations, "PART", 500)
    packed = []
    kept = collocations.written
    monkeypatch.setattr(collocations, "written", lambda df, label: packed.append(kept(df, label)) or packed[-1])
    assert found_collocations(table) == want
    words = packed[0].filter("f > 500").count()
    assert words >= 10 and packed[0].agg({"f": "sum"}).first()[0] // 500 > 50


def test_slices_cut_long_texts(monkeypatch):
    """Three words are counted once each, however a text is cut into blocks and slices."""
    import pyarrow as pa

    def counts(texts, part, block):
        monkeypatch.setattr(collocations, "SLICE", part)
        monkeypatch.setattr(word_ids, "BLOCK", block)
        triples, words = Counter(), Counter()
        batch = pa.record_batch({"lang": ["x"] * len(texts), "text": texts})
        for own in collocations._slices(iter([batch])):
            n, names = own["x"].numbers(), own["x"].words().to_pylist()
            for i in range(len(n) - 2):
                words[names[n[i]]] += 1
                if n[i] and n[i + 1]:
                    triples[tuple(names[j] for j in n[i : i + 3])] += 1
        words.pop("", None)
        return triples, words

    texts = ["a b c a b. c a b\nd e f g h a b c", "", "a  b", "x", None, "q w e r t y " * 50]
    whole = counts(texts, 10**9, 1 << 20)
    assert sum(whole[1].values()) == 319 and whole[0]["q", "w", "e"] == 50
    for part in (2, 3, 7, 100):
        for block in (1, 8, 64):
            assert counts(texts, part, block) == whole


TERM = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def terms(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=20):
    docs = [(i, Counter(t)) for i, t in ((i, terms(x)) for i, x in docs) if t]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    queries_ = defaultdict(Counter)
    for item, text in items:
        queries_[item].update(terms(text))
    out = Counter()
    for item, query in queries_.items():
        scored = []
        for doc_id, c in docs:
            m = 75 + (25 * sum(c.values()) * n) // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                        for t, times in query.items() if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, none, doc_id) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, None if none else doc_id, -score] += 1
    return out


def found(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


ITEMS = [(1, "red car"), (2, None), (3, ""), (None, "blue van blue"), (5, "unknown words only"), (6, "fast, RED; car! é"), (7, "red"), (7, "car")]


def test_ranked_search_edges(spark):
    docs = [*DOCS, *rows_of(*[(100 + i, "red car " + "x " * (i % 7) + "blue " * (i % 3), "en") for i in range(60)]),
            *rows_of((200, "red car", "en"), (200, "red car", "en"), (None, "red car", "en"), (None, "red car", "en"))]
    table = spark.createDataFrame(docs, FIELDS).repartition(4)
    items = spark.createDataFrame([(i, t, "doc", 1) for i, t in ITEMS], "item_id long, text string, doc_id string, score long")
    want = plain_search([(r[0], r[1]) for r in docs], ITEMS)
    assert found(ranked_search.ranked_search(table, items)) == want
    # A general index of all terms, and ids of another type.
    index = ranked_search.build_index(table)
    named = spark.createDataFrame([(str(i), t) for i, t in ITEMS], "item_id string, text string")
    got = found(ranked_search.search(index, ranked_search.query_terms(named), 7))
    assert got == plain_search([(r[0], r[1]) for r in docs], [(str(i), t) for i, t in ITEMS], 7)
    assert index.terms.filter("term = 'repeats'").first().df == 1
    assert not found(ranked_search.ranked_search(table.limit(0), items))
    assert not found(ranked_search.ranked_search(table, items.limit(0)))


@pytest.mark.parametrize("small", [False, True])
def test_ranked_search_on_the_table(spark, sf_dir, monkeypatch, small):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    if small:
        # Strata of several blocks, queries in several blocks, a threshold from few documents, all terms indexed.
        for name, value in (("BLOCK_DOCS", 3), ("BLOCK_POSTINGS", 300), ("QUERY_TERMS", 60), ("SEED", 1)):
            monkeypatch.setattr(ranked_search, name, value)
        index = ranked_search.build_index(docs)
        assert index.rows.groupBy("m").count().filter("count > 1").count() > 10
        assert max(len(r.docs) for r in index.rows.collect()) < 20
    assert found(ranked_search.ranked_search(docs, items)) == want


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    scored = {r.doc_id: r for r in queries.QUERIES["op12_toxicity"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert sorted(scored) == sorted(r.doc_id for r in docs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == held_out(r.doc_id) for r in scored.values())
    test = [(labels[i], r.predicted) for i, r in scored.items() if r.held_out and labels.get(i) is not None]
    hit = sum(y and p for y, p in test)
    assert hit >= 0.9 * sum(y for y, _ in test) and hit >= 0.9 * sum(p for _, p in test)


def toxic_rows():
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        text = " ".join(rng.choice(words, 30)) + (" you vile oaf" * 2 if toxic else "")
        rows.append((i, text, "en"))
        if i % 5 < 3:
            labels.append((i, int(toxic)))
    return rows, labels


LABELS = "doc_id long, toxic int, quality int, text string"


def test_toxicity_learns_from_allowed_labels_only(spark):
    rows, labels = toxic_rows()
    extra = rows_of((None, None, None), (1000, "", "en"), (1001, "vile oaf vile oaf " * 20000, "en"), (1001, "calm words", "en"))
    docs = spark.createDataFrame([*rows_of(*rows), *extra], FIELDS)
    given = [(i, t, None, "x") for i, t in labels]
    more = [(None, 1, 0, ""), (0, None, 0, ""), (0, 1, 1, ""), (99999, 1, 1, "")]

    def run(labels):
        out = toxicity.score(docs, spark.createDataFrame(labels, LABELS)).collect()
        assert len(out) == len(rows) + len(extra)
        return sorted(((r.doc_id is None, r.doc_id or 0, r.score, r.predicted, r.held_out) for r in out))

    got = run([*given, *more])
    by_id = {i: (score, predicted) for none, i, score, predicted, _ in got if not none}
    assert all(by_id[i][1] == (i % 6 == 0) for i in range(600)) and not by_id[1000][1]
    assert sorted(g[3] for g in got if g[1] == 1001) == [0, 1]
    # Labels of the held-out rows have no bearing, neither do other columns.
    flipped = [(i, 1 - t if held_out(i) else t, 1, None) for i, t in labels]
    assert run([*flipped, *more]) == got
    assert any(held_out(i) for i, _ in labels)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame(rows_of((1, "a b c", "en"), (2, None, None)), FIELDS)
    def scores(docs, labels):
        return [r.score for r in toxicity.score(docs, spark.createDataFrame(labels, LABELS)).collect()]

    assert scores(docs, []) == [0, 0] and scores(docs.limit(0), [(1, 1, 1, "")]) == []
    assert scores(docs, [(1, 0, 1, ""), (2, 0, 1, "")]) == [0, 0]
    assert scores(docs, [(1, 1, 1, "")]) == [1, 1]
    some = scores(docs, [(1, 1, 1, ""), (4, 0, 1, "")])
    assert all(0 < s < 1 for s in some)


def test_clean_risk_is_not_let_below_zero():
    """A point that learns its examples by heart is taken back to where the corrected risk is not negative."""
    rng = np.random.default_rng(5)
    pool = (rng.random((4000, 40)) < 0.1).astype(float)
    x = np.hstack([pool, np.ones((4000, 1))])
    examples = x[:12].copy()
    examples[np.arange(12), np.arange(12)] = 1
    seen = []

    def sums_at(which, points):
        added = [toxicity.sums(x, np.ones(len(x)), b) for b in points]
        seen.extend(toxicity.clean_risk(a, len(x), examples, b, 0.3) for a, b in zip(added, points))
        return added

    start = np.append(np.zeros(40), np.log(0.3 / 0.7))
    beta = toxicity.descend(sums_at, len(x), [examples], [start], [np.append(np.full(40, 1e-4), 1e-9)], 0.3, 30)[0]
    assert min(seen) < 0
    assert toxicity.clean_risk(toxicity.sums(x, np.ones(len(x)), beta), len(x), examples, beta, 0.3) >= 0
    assert not np.array_equal(beta, start)
