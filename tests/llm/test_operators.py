"""The operators against plain versions, on the smallest tables and on hand-made rows."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tradebook.llm import (
    chats, decontamination, embedding_links, mixing, near_duplicates, quality, queries, substring_dedup, surrogates,
    token_files, warc,
)
from tradebook.session import scratch_dir

LONG = "alpha beta gamma delta " * 3000
PASSAGE = " ".join(f"word{i}" for i in range(60))
DOCS = [
    (1, PASSAGE + " tail one", "en", "a", 10, "x"), (2, "head " + PASSAGE, "en", "a", None, "x"), (3, None, None, None, None, None),
    (4, "", "en", "b", 0, "x"), (5, LONG, "en", "a", 5, "x"), (5, LONG, "en", "a", 5, "x"), (6, LONG + "end", "fr", "b", 7, "x"),
    (None, PASSAGE, "en", None, 1, "x"), (7, "one two three", "de", "c", 3, "x"), (8, "One two  three", "de", "c", 3, "x"),
]
FIELDS = "doc_id long, text string, lang string, source string, n_chars long, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, FIELDS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], FIELDS)


def plain_repeats(rows, k):
    """{(doc_id, text): (n_words, kept)} by remembering all windows in order."""
    seen, out = {}, {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        words = (text or "").encode().split()
        covered = np.zeros(len(words), bool)
        for a in range(len(words) - k + 1):
            if seen.setdefault(b" ".join(words[a : a + k]), (doc_id, a)) != (doc_id, a):
                covered[a : a + k] = True
        out[doc_id, text] = len(words), b" ".join(w for w, c in zip(words, covered) if not c)
    return out


@pytest.mark.parametrize("given", ["hand", "table"])
def test_substring_dedup(spark, sf_dir, docs, given):
    table = docs if given == "hand" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    want = plain_repeats(rows, 20)
    got = substring_dedup.substring_dedup(table).collect()
    expected = Counter((d, want[d, t][0], hashlib.sha256(want[d, t][1]).hexdigest()) for d, t in rows)
    assert Counter((r.doc_id, r.n_words, r.kept_sha256) for r in got) == expected


def multiset(text):
    words = (text or "").encode().lower().split()
    return Counter(tuple(words[a : a + 5]) for a in range(max(len(words) - 4, 1))) if words else Counter()


def plain_classes(rows):
    sets = [multiset(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = sum((sets[i] & sets[j]).values())
            if shared and shared >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - shared):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc_id)
    least = {g: min(ids, key=lambda d: (d is None, d or 0)) for g, ids in groups.items()}
    return Counter((d, least[root(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("given", ["hand", "table"])
def test_near_duplicates(spark, sf_dir, docs, given):
    table = docs if given == "hand" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    got = near_duplicates.near_duplicates(table).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == plain_classes(rows)


def test_signatures_are_unbiased():
    """Components agree as often as the weighted Jaccard similarity says."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 200), rng.integers(0, 9, 200)
    text = np.repeat([0, 1], 200)
    shingle = np.tile(rng.integers(1, 1 << 62, 200).astype(np.uint64), 2)
    count = np.concatenate([a, b])
    has = count > 0
    sig = near_duplicates.signatures(text[has], shingle[has], count[has], 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_warc_round_trip(spark):
    rows = [(3, "http://a/ü b", "<p>x</p>", 1), (1, None, "<p>x</p>", 1), (2, "http://c", None, 1), (5, "http://d\r\nX: y", "", 1),
            (None, "http://e", "<p>x</p>", 1), (7, "http://f", "é" * 2_000_000, 1), (8, "http://g", "z", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload long")
    folder = scratch_dir(spark, "warc-test")
    index = warc.write_bundles(pages, folder)
    got = {r.page_id: r for r in warc.read_bundles(index, folder, payload=True).collect()}
    for page, url, html, _ in rows:
        raw, row = (html or "").encode(), got[page]
        first = {"<p>x</p>": 1, "": 2, None: 2}.get(html, page)
        assert row.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode() and row.payload_bytes == len(raw)
        assert (row.record_type, row.refers_to) == (("response", None) if page == first else ("revisit", first))
        assert bytes(row.payload) == (raw if page == first else b"") and row.url == (url or "")
    fs, base = token_files.open_place(folder)
    for entry in index.collect():
        assert warc.Bundle(fs, f"{base}/{entry.bundle}").record(entry.frame, entry.offset)["page_id"] == entry.page_id
    assert warc.archive(pages.limit(0)).count() == 0


def test_surrogates_move_every_number_once():
    for n in (2, 3, 10, 97, 1000):
        moved = [surrogates._moved(x, n, b"k") for x in range(n)]
        assert sorted(moved) == list(range(n)) and all(a != b for a, b in enumerate(moved))


def test_surrogates(spark):
    text = ("an.Be.19@mail5.example.com AN.BE.19@MAIL5.EXAMPLE.COM +1 (743) 555-3824, 743-555-3824 8.196.197.208 4111 1111 1111 1111 "
            'token = "24be64439e3e49cf46b2d7c90f3602a3" Mrs Ada Lovelace, Mrs. Lovelace, Herr Otto Weiß, г-н Иван')
    docs = spark.createDataFrame([(1, text, 5), (2, None, 5), (3, "", 5), (4, "nothing 12 here", 5)], "doc_id long, text string, n_entities int")
    got = {r.doc_id: r for r in surrogates.pseudonymise(docs).collect()}
    new = got[1].text
    assert got[2].text is None and got[3].text == "" and got[4].text == "nothing 12 here" and got[1].n_entities == 13
    for a, b, _ in surrogates.find(text):
        assert text[a:b] not in new
    mails, kinds = new.split()[:2], [k for _, _, k in surrogates.find(new)]
    assert mails[0].lower() == mails[1].lower() and kinds == [k for _, _, k in surrogates.find(text)]
    cards = [new[a:b] for a, b, k in surrogates.find(new) if k == "card"]
    digits = cards[0].replace(" ", "")
    assert surrogates._check_digit(digits[:-1]) == int(digits[-1]) and digits != "4111111111111111"
    names = [new[a:b] for a, b, k in surrogates.find(new) if k == "name-f"]
    assert names[1] == names[2] and new.split()[-1][0] in surrogates.ALPHABETS[8]


def test_names_that_collide_draw_again(spark, monkeypatch):
    names = [(f"name-f", f"n{i}") for i in range(3000)]
    entities = spark.createDataFrame(names, "kind string, entity string")
    again = surrogates.redraws(entities, b"k")
    attempts = {(r.kind, r.entity): r.attempt for r in again.collect()} if again else {}
    drawn = [surrogates.surrogate(k, e, b"k", attempts.get((k, e), 0)) for k, e in names]
    assert len(set(drawn)) == len(names)


def test_chats_edges(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "bot", None), (3, 0, "user", "hi"), (3, 1, "bot", None), (4, None, None, "x"),
            (None, 0, "user", "lost"), (5, 0, "user", "hi"), (5, 0, "user", "hi"), *[(6, t, "user", str(t)) for t in range(2500)],
            *[(7, t, "user", str(t)) for t in range(2400)]]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, position int")
    got = {(r.conv_id, r.part): r for r in chats.chats(table).collect()}
    assert sorted(got) == [(2, 0), (4, 0), (6, 0), (6, 1), (6, 2)]
    assert got[2, 0].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>bot\n<|im_end|>\n" and got[6, 2].n_turns == 2500 - 2048
    assert chats.chats(table.limit(0)).count() == 0


@pytest.mark.parametrize("shares", [queries.SHARES, {"a": 1}, {"a": 7, "b": 2, "c": 1}, {"a": 50, **{f"s{i}": 1 for i in range(50)}}])
def test_schedule_deviates_less_than_one_block(shares):
    total, done = sum(shares.values()), Counter()
    for t, source in enumerate(mixing.period(shares), 1):
        done[source] += 1
        assert all(abs(done[s] - t * a / total) < 1 for s, a in shares.items())
    assert done == Counter(shares)


def test_mixing_keeps_all(spark, docs, none):
    got = mixing.mixed(docs, {"a": 2, "b": 1}).collect()
    assert Counter(got) == Counter(docs.collect()) and got[0].asDict().keys() == docs.first().asDict().keys()
    assert mixing.mixed(none, {"a": 2}).count() == 0


def test_decontamination_edges(spark, docs, none):
    items = spark.createDataFrame([(1, "WORD5 word6"), (2, " ".join(f"word{i}" for i in range(20, 35))), (3, None), (4, "!!"), (5, "absent")],
                                  "item_id long, text string")
    got = Counter((r.doc_id, r.n_hit, r.n_items) for r in decontamination.decontaminate(docs, items).collect())
    assert got == Counter({(1, 17, 2): 1, (2, 17, 2): 1, (None, 17, 2): 1, (3, 0, 0): 1, (4, 0, 0): 1, (5, 0, 0): 2, (6, 0, 0): 1, (7, 0, 0): 1, (8, 0, 0): 1})
    assert decontamination.decontaminate(none, items).count() == 0
    assert decontamination.decontaminate(docs, items.limit(0)).filter("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b c"), (2, "a b c"), (3, "a x x x b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    hit = lambda slack: {r.doc_id for r in decontamination.decontaminate(docs, items, slack=slack).filter("contaminated").collect()}
    assert hit(0) == {2} and hit(1) == {1, 2}


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train = labels.filter("pmod(xxhash64(doc_id, 7), 4) > 0")
    scores = quality.score(docs, train).join(labels.join(train, "doc_id", "left_anti"), "doc_id").toPandas()
    assert ((scores.p_quality >= 0.5) == (scores.quality == 1)).mean() > 0.97
    assert ((scores.p_toxic > 0.5) == (scores.toxic == 1)).mean() > 0.96


def test_quality_edges(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, labels).count() == len(DOCS)
    assert quality.keep_accepted(docs, labels).columns == docs.columns
    assert quality.score(none, labels).count() == 0 and quality.score(docs, labels.limit(0)).count() == len(DOCS)


def test_token_files(spark, docs, none):
    folder = scratch_dir(spark, "tokens-test")
    encoder = token_files.PieceEncoder(queries.TOKENIZER)
    odd = ["a  b", "\n x", " lead", "trail ", "a\n  b  x    y", "hi <|endoftext|> yo", "don't  stop's", "   ", "x  y\n  z q", "a   b"]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    shards = token_files.write_shards(table, folder, queries.TOKENIZER, length=64)
    got = sorted(token_files.read_documents(shards, folder).collect(), key=lambda r: r.start)
    texts = {}
    for r in table.collect():
        texts.setdefault(r.doc_id, r.text)
    start = 0
    for row in got:
        ids = np.array([*encoder.tokenizer.encode(texts[row.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert [r.doc_id for r in got] == sorted(texts | {5: 0}, key=lambda d: (d is not None, d or 0))[:1] + sorted([r.doc_id for r in table.collect() if r.doc_id is not None])
    fs, base = token_files.open_place(folder)
    shard = token_files.Shard(fs, f"{base}/shard-{shards.first().shard:06d}.arrow")
    ids, mask = shard.sequence(0)
    assert len(ids) == len(mask) == 64 and (ids[: mask.sum()] == next(shard.batches())[:64][: mask.sum()]).all()
    assert token_files.tokenise(none, queries.TOKENIZER).count() == 0


def test_embedding_links(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 16))
    near = base[:40] + 0.05 * rng.standard_normal((40, 16))
    hub = base[50] + 0.08 * rng.standard_normal((400, 16))
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(base)] + [(1000 + i, v.tolist(), i % 2) for i, v in enumerate(near)]
    rows += [(2000 + i, v.tolist(), 0) for i, v in enumerate(hub)] + [(3000 + i, base[0].tolist(), 0) for i in range(5)]
    rows += [(1, base[1].tolist(), 1), (5000, None, 0), (5001, [0.0] * 16, 0), (5002, [1.0, None] + [0.0] * 14, 0), (5003, base[0].tolist(), None),
             (5004, [float("nan")] * 16, 0), (None, base[0].tolist(), 0), (5005, [], 0), (5006, [1.0, 2.0], 0)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, node int")
    sound = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    n = len(sound)
    cos = np.zeros((n, n))
    for i, (_, v, label) in enumerate(sound):
        for j, (_, w, other) in enumerate(sound):
            if i != j and label == other and len(v) == len(w):
                cos[i, j] = np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)
    linked = cos >= 0.93
    label = np.arange(n)
    ids = np.array([r[0] for r in sound])
    least = ids.copy()
    for _ in range(n):
        new = np.minimum(least, np.where(linked, least[None, :], 1 << 40).min(1))
        if (new == least).all():
            break
        least = new
    want = Counter(zip(ids.tolist(), linked.sum(1).tolist(), least.tolist()))
    want += Counter((r[0], 0, r[0]) for r in rows if r not in sound and r[0] != 5004) + Counter([(5004, 0, 5004)])
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in embedding_links.embedding_links(table).collect()) == want
    assert embedding_links.embedding_links(table.limit(0)).count() == 0


def table_of(spark, vectors):
    return spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")


def test_embedding_links_beyond_full_lists(spark):
    rng = np.random.default_rng(5)
    a = rng.standard_normal((20, 1, 32))
    b = a + 0.3 * rng.standard_normal((20, 1, 32))
    vectors = (np.concatenate([np.repeat(a, 15, 1), np.repeat(b, 15, 1)], 1) + 0.01 * rng.standard_normal((20, 30, 32))).reshape(600, 32)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.93).sum(1) - 1
    got = embedding_links.embedding_links(table_of(spark, vectors)).toPandas().set_index("vec_id").sort_index()
    assert (linked >= 29).sum() > 400 and got.n_links.tolist() == linked.tolist()


def test_embedding_audit_sees_small_groups(spark):
    rng = np.random.default_rng(6)
    hub = rng.standard_normal(16) + 0.01 * rng.standard_normal((1000, 16))
    pairs = np.repeat(rng.standard_normal((500, 16)), 2, 0) + 0.001 * rng.standard_normal((1000, 16))
    vectors = np.concatenate([hub, pairs])
    nodes, rows = embedding_links.nodes_of(table_of(spark, vectors))
    found = nodes.filter("first < 1000").selectExpr("node", "999L as others")
    whole = found.union(nodes.filter("first >= 1000").selectExpr("node", "1L"))
    one = nodes.filter("first < 1000").selectExpr("node", "-1L as label")
    both = one.union(nodes.filter("first >= 1000").selectExpr("node", "first div 2"))
    assert embedding_links.audit(found, one, nodes, 0.93) < 0.5
    assert embedding_links.audit(whole, both, nodes, 0.93) == 1
    alone = embedding_links.nodes_of(table_of(spark, np.eye(16)))[0]
    assert embedding_links.audit(found.limit(0), one.limit(0), alone, 0.93) is None


def test_embedding_buckets_at_every_size(spark):
    for bits in range(1, 28):
        shared = (1 - np.arccos(0.93) / np.pi) ** bits
        assert (1 - shared) ** embedding_links.tables(bits, 0.93) <= 1e-4
    rng = np.random.default_rng(7)
    nodes = embedding_links.nodes_of(table_of(spark, rng.standard_normal((700, 8))))[0]
    one = nodes.selectExpr("1L as grp", "node")
    v = np.stack([r.v for r in nodes.collect()])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    ids = [r.node for r in nodes.collect()]
    ends = embedding_links.across(one, spark.createDataFrame([], "node long, label long"), nodes, 0.93).collect()
    linked = np.triu(unit @ unit.T >= 0.93, 1)
    assert {i for r in ends for i in r} == {ids[i] for ij in zip(*np.nonzero(linked)) for i in ij} and linked.any()


def test_quality_learns_from_all_unlabelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    seed = quality.seed(quality._sample(docs, labels, ["quality"]), "quality")
    rest = docs.join(labels, "doc_id", "left_anti").select("text", "source", "lang", "n_chars").toArrow().to_batches()
    text, meta = [], []
    for batch in rest:
        at, bucket, shape = quality.text_features(batch["text"].to_pylist())
        text.append(np.hstack([shape, quality.presence(at, bucket, seed.chosen, len(batch))]))
        meta.append(quality.metadata_features(batch))
    views = [np.concatenate(text), np.concatenate(meta)]
    assert len(views[0]) > 6000
    own, y = [v[seed.train] for v in seed.views], seed.y[seed.train]
    betas = [quality.fit(v, y, np.ones(len(y))) for v in own]
    label = np.full((2, len(views[0])), np.nan)
    for _ in range(quality.ROUNDS):
        for v in (0, 1):
            p = 1 / (1 + np.exp(-quality.margin(views[v], betas[v])))
            new = np.isnan(label[1 - v])
            label[1 - v][new & (p >= quality.SURE)] = 1
            label[1 - v][new & (1 - p >= quality.SURE)] = 0
        has = ~np.isnan(label)
        betas = [quality.fit(np.vstack([own[v], views[v][has[v]]]), np.r_[y, label[v][has[v]]], np.r_[np.ones(len(y)), np.full(has[v].sum(), 0.5)]) for v in (0, 1)]
    model = quality.train(docs, labels, ("quality",)).models["quality"]
    assert has.sum() > 1000 and np.allclose(model.text, betas[0], atol=1e-4) and np.allclose(model.metadata, betas[1], atol=1e-4)


def test_quality_sample_takes_one_document_of_an_id(spark):
    rows = [(1, f"text {i % 7}", "en", "a", 5, "x") for i in range(500)] + [(2, "other words", "en", "b", 5, "x")]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0)], "doc_id long, quality int")
    sample = quality._sample(spark.createDataFrame(rows, FIELDS), labels, ["quality"])
    assert sorted(zip(sample.doc_id, sample.quality)) == [(1, 0), (1, 1), (2, 1)]


def test_mixing_counts_repeated_rows(spark):
    rows = [(i // 3, "same", "en", "a", 1, "x") for i in range(90)] + [(100, "b", "en", "b", 1, "x")] * 40
    docs = spark.createDataFrame(rows, FIELDS)
    got = mixing.schedule(docs, {"a": 2, "b": 1}).collect()
    assert len(got) == len(rows) and len({(r.slot, r.place) for r in got}) == len(rows) and max(r.place for r in got) < mixing.BLOCK
    assert Counter(r.block for r in got if r.source == "b") == {0: 16, 1: 16, 2: 8}
    assert Counter(mixing.mixed(docs, {"a": 2, "b": 1}).collect()) == Counter(docs.collect())
