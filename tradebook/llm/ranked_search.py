"""Ranked lexical search on an index whose strata are the documents of equal length normaliser m.

A stratum is cut into blocks by a hash of the document, so that a block has about `BLOCK_DOCS` documents
or `BLOCK_POSTINGS` postings, however many documents share an m. A block is one row of the written
index: its documents, its terms, and for each term and tf the documents that hold it so often. Within a
stratum a posting's impact depends on tf alone, and is computed once per tf.

A search takes the queries in blocks. For each query the strata are ordered by their bound, which is
the score of a document with each term as often as any document of the stratum has it. The strata with
the highest bounds are visited first, up to `SEED` times k documents for each query; the k-th score found is a
threshold, and of the other strata those whose bound reaches it are visited. No other document can
be among the first k, so the result is that of a full scan.

Rules: null and empty texts, and those without terms, are no documents of the index; a null document id
comes last among equal scores; rows that repeat are documents of their own; items that repeat an id are
taken together as one query, a null item id is an id; an item without known terms has no rows; further columns are
ignored; no documents or no items give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window, functions as F

from .common import pin, small, written
from .word_ids import Ids, blocks, byte_map, counted, texts

TOP = 20
BLOCK_DOCS = 256
BLOCK_POSTINGS = 32_768
# Documents visited for the threshold, as a multiple of those wanted.
SEED = 10
# Distinct terms of the queries that are searched for at once, and their bytes; more queries make more blocks.
QUERY_TERMS = 16_384
QUERY_BYTES = 8_000_000
# Words that a task numbers at once, and their bytes.
SLICE = 1_000_000
SLICE_BYTES = 16_000_000

# Letters, digits and all other than ASCII make terms.
_MAP = byte_map(bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)))
_PACKED = "m long, block long, docs array<long>, terms array<string>, term array<int>, tf array<int>, size array<int>, at array<int>"


def _counts(own: list[tuple[object, list[np.ndarray]]], key: pa.DataType, ids: Ids, wanted: int | None) -> pa.RecordBatch:
    """Terms and their tf for each text of a slice; with `wanted`, of the first so many terms only."""
    n = np.array([sum(map(len, parts)) for _, parts in own], np.int64)
    flat = np.concatenate([np.zeros(0, np.int32), *(p for _, parts in own for p in parts)]).astype(np.int64)
    text = np.repeat(np.arange(len(own)), n)
    if wanted is not None:
        use = flat <= wanted
        flat, text = flat[use], text[use]
    keys, tf = counted((text << 32) | flat)
    cuts = pa.array(np.searchsorted(keys >> 32, np.arange(len(own) + 1)).astype(np.int32))
    return pa.record_batch({
        "id": pa.array([i for i, _ in own], key), "n": pa.array(n),
        "terms": pa.ListArray.from_arrays(cuts, ids.words().take(pa.array(keys & 0xFFFFFFFF))),
        "tfs": pa.ListArray.from_arrays(cuts, pa.array(tf.astype(np.int32))),
    })


def term_counts(rows: DataFrame, key: str, wanted: list[bytes] | None = None) -> DataFrame:
    """Per text its id, number n of terms, and distinct terms with their tf; with `wanted`, those alone."""
    first = (b"", *(wanted or ()))
    bound = None if wanted is None else len(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own, n, size = Ids(first), [], 0, 0
        for batch in batches:
            kind = batch.schema.field("id").type
            for at, text in zip(batch["id"].to_pylist(), texts(batch), strict=True):
                parts = []
                for words in blocks(text.translate(_MAP)):
                    numbers = ids.numbers(words)
                    parts.append(numbers[numbers > 0])
                own.append((at, parts))
                n, size = n + sum(map(len, parts)) + 1, size + len(text)
                if n >= SLICE or size >= SLICE_BYTES:
                    yield _counts(own, kind, ids, bound)
                    ids, own, n, size = Ids(first), [], 0, 0
        if own:
            yield _counts(own, kind, ids, bound)

    given = rows.select(F.col(key).alias("id"), F.col("text"))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(run, f"id {kind}, n long, terms array<string>, tfs array<int>")


@dataclass
class Index:
    """Blocks of the strata, (term, df), (m, docs, postings, blocks), the largest tf (m, term, tf); N and L."""

    rows: DataFrame
    terms: DataFrame
    strata: DataFrame
    largest: DataFrame
    n_docs: int
    n_terms: int


def packed(table: pa.Table) -> pa.Table:
    """One row of the index from the documents of a block; postings are in order of term and tf."""
    sizes = np.asarray(pa.compute.list_value_length(table["terms"].combine_chunks()), np.int64)
    codes = table["terms"].combine_chunks().flatten().dictionary_encode()
    term = codes.indices.to_numpy().astype(np.int64)
    tf = table["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
    at = np.repeat(np.arange(len(table)), sizes)
    order = np.lexsort((at, tf, term))
    term, tf, at = term[order], tf[order], at[order]
    first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(tf, prepend=-1) != 0))
    lists = {
        "docs": table["id"].combine_chunks(), "terms": codes.dictionary,
        "term": pa.array(term[first].astype(np.int32)), "tf": pa.array(tf[first].astype(np.int32)),
        "size": pa.array(np.diff(np.append(first, len(term))).astype(np.int32)), "at": pa.array(at.astype(np.int32)),
    }
    return pa.table({
        "m": table["m"][:1], "block": table["block"][:1],
        **{k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for k, v in lists.items()},
    })


def build_index(docs: DataFrame, wanted: list[bytes] | None = None) -> Index:
    """Index all documents by all their terms, or by the `wanted` ones where the queries are known."""
    counts = term_counts(docs, "doc_id", wanted).filter("n > 0").select("id", "n", "terms", "tfs", F.monotonically_increasing_id().alias("row"))
    counts = written(counts, "counted")
    n_docs, n_terms = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    placed = counts.withColumn("m", F.expr(f"75L + (25L * n * {n_docs}L) div {max(n_terms, 1)}L"))
    blocks_ = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("postings") / BLOCK_POSTINGS))
    strata = placed.groupBy("m").agg(F.count("*").alias("docs"), F.sum(F.size("terms")).alias("postings"))
    strata = written(strata.withColumn("blocks", blocks_), "strata")
    of = placed.join(small(strata.select("m", "blocks"), strata.count()), "m")
    of = of.select("m", F.pmod(F.xxhash64("id", "row"), F.col("blocks")).alias("block"), "id", "terms", "tfs")
    rows = written(of.groupBy("m", "block").applyInArrow(packed, _PACKED), "index")
    posted = rows.select("m", "terms", F.explode(F.arrays_zip("term", "tf", "size")).alias("p"))
    posted = posted.select("m", F.expr("terms[p.term]").alias("term"), "p.tf", "p.size")
    largest = written(posted.groupBy("m", "term").agg(F.max("tf").alias("tf"), F.sum("size").alias("docs")), "largest")
    terms = written(largest.groupBy("term").agg(F.sum("docs").alias("df")), "terms")
    return Index(rows, terms, strata, largest, n_docs, n_terms)


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    """What a term adds to a document's score for each unit of the term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Queries:
    """The queries of a block: each one's id, and the numbers and weights (repeats included) of its terms."""

    def __init__(self, rows: list[tuple[object, str, int]]):
        self.ids: list[object] = []
        self.number: dict[str, int] = {}
        self.terms: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []
        by_id: dict[object, list[tuple[int, int]]] = {}
        for query, term, weight in rows:
            by_id.setdefault(query, []).append((self.number.setdefault(term, len(self.number)), weight))
        for query, own in by_id.items():
            number, weight = np.array(own, np.int64).T
            self.ids.append(query)
            self.terms.append(number)
            self.weights.append(weight)


class Best:
    """The k best documents of each query so far, as (score, document, whether it has no id)."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k = least.copy(), k
        self.found: dict[int, np.ndarray] = {}

    def add(self, query: int, scores: np.ndarray, docs: np.ndarray, nameless: np.ndarray) -> None:
        at = np.flatnonzero(scores >= self.least[query])
        if not len(at):
            return
        new = np.stack([scores[at], docs[at], nameless[at]])
        if query in self.found:
            new = np.hstack([self.found[query], new])
        if new.shape[1] > self.k:
            new = new[:, np.lexsort((new[1], new[2], -new[0]))[: self.k]]
            self.least[query] = new[0, -1]
        self.found[query] = new


def _lists(batch: pa.RecordBatch, row: int, *columns: str) -> list[np.ndarray]:
    return [batch[c][row].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]


def scores(batch: pa.RecordBatch, row: int, queries: Queries) -> Iterator[tuple[int, np.ndarray]]:
    """The scores of all documents of a block for each query that visits it."""
    m = batch["m"][row].as_py()
    number = np.array([queries.number.get(t, -1) for t in batch["terms"][row].values.to_pylist()], np.int64)
    term, tf, size, at = _lists(batch, row, "term", "tf", "size", "at")
    each, place = np.unique(tf, return_inverse=True)
    impacts = impact(each, m)[place]
    asked = np.flatnonzero(number >= 0)
    line = np.full(len(number), -1)
    line[asked] = np.arange(len(asked))
    matrix = np.zeros((len(asked), len(batch["docs"][row])), np.int64)
    lines = np.repeat(line[term], size)
    use = lines >= 0
    matrix[lines[use], at[use]] = np.repeat(impacts, size)[use]
    of_query = np.full(len(queries.number), -1)
    of_query[number[asked]] = np.arange(len(asked))
    for query in batch["queries"][row].values.to_pylist():
        own = of_query[queries.terms[query]]
        yield query, queries.weights[query][own >= 0] @ matrix[own[own >= 0]]


def visit(index: Index, visits: DataFrame, queries: Queries, least: np.ndarray, k: int) -> DataFrame:
    """The k best documents of each task for each query of `visits` (m, query), with a score of `least` or more."""
    by_stratum = written(visits.groupBy("m").agg(F.collect_list("query").alias("queries")), "visits")
    n = by_stratum.agg(F.sum(F.size("queries") + 4)).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(np.maximum(least, 1), k)
        for batch in batches:
            for row in range(batch.num_rows):
                docs = batch["docs"][row].values
                nameless = np.asarray(docs.is_null()).astype(np.int64)
                numbers = pa.compute.fill_null(docs, 0).to_numpy(zero_copy_only=False)
                for query, score in scores(batch, row, queries):
                    best.add(query, score, numbers, nameless)
        for query, (score, doc, nameless) in best.found.items():
            yield pa.record_batch({
                "query": pa.array(np.full(len(score), query, np.int32)), "doc_id": pa.array(doc, mask=nameless.astype(bool)), "score": pa.array(score),
            })

    return index.rows.join(small(by_stratum, n), "m").mapInArrow(run, "query int, doc_id long, score long")


def _search(index: Index, queries: Queries, weights: DataFrame, k: int) -> DataFrame:
    """(query, rank, doc_id, score) for the queries of one block."""
    known = small(weights, sum(map(len, queries.terms)))
    most = F.expr("weight * ((1000000000L * tf) div (1000L * tf + 12L * m))")
    bounds = index.largest.join(known, "term").groupBy("query", "m").agg(F.sum(most).alias("bound")).filter("bound > 0")
    by_bound = Window.partitionBy("query").orderBy(F.desc("bound"), "m").rowsBetween(Window.unboundedPreceding, -1)
    bounds = bounds.join(index.strata.select("m", "docs"), "m").withColumn("before", F.coalesce(F.sum("docs").over(by_bound), F.lit(0)))
    bounds = written(bounds.select("query", "m", "bound", (F.col("before") < SEED * k).alias("seed")), "bounds")
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))

    least = np.ones(len(queries.ids), np.int64)
    seeds = written(visit(index, bounds.filter("seed"), queries, least, k).withColumn("rank", first).filter(F.col("rank") <= k), "seeds")
    for r in seeds.filter(F.col("rank") == k).collect():  # at most one row for each query of the block
        least[r["query"]] = r["score"]
    thresholds = weights.sparkSession.createDataFrame([(i, int(s)) for i, s in enumerate(least)], "query int, least long")
    left = bounds.filter("not seed").join(small(thresholds, len(least)), "query").filter("bound >= least")
    rest = visit(index, left.select("m", "query"), queries, least, k)
    return seeds.drop("rank").unionByName(rest).withColumn("rank", first).filter(F.col("rank") <= k)


def _query_blocks(terms: DataFrame) -> list[DataFrame]:
    """The queries' terms (id, term, times), dealt to blocks of bounded size by their ids."""
    n, size = terms.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()
    blocks_ = max(-(-n // QUERY_TERMS), -(-size // QUERY_BYTES))
    return [terms.filter(F.pmod(F.xxhash64("id"), F.lit(blocks_)) == b) for b in range(blocks_)]


def query_terms(items: DataFrame) -> DataFrame:
    """Terms of the queries as (id, term, times), written."""
    each = term_counts(items, "item_id").select("id", F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
    return written(each.groupBy("id", F.col("t.terms").alias("term")).agg(F.sum("t.tfs").alias("times")), "queries")


def search(index: Index, terms: DataFrame, k: int = TOP) -> DataFrame:
    """The k best documents of every query of `terms` with a score above 0: item_id, rank, doc_id, score."""
    pin(terms.sparkSession)
    weight = F.floor(1000 * F.log((F.lit(2.0) * index.n_docs + 2) / (2 * F.col("df") + 1)))
    kind = terms.schema["id"].dataType.simpleString()
    found = terms.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in _query_blocks(terms):
        weighted = block.join(index.terms, "term").select("id", "term", (weight * F.col("times")).cast("long").alias("weight")).filter("weight > 0")
        rows = [tuple(r) for r in weighted.orderBy("id", "term").collect()]  # a block of queries: QUERY_TERMS rows or so
        if not rows:
            continue
        queries = Queries(rows)
        number = {query: i for i, query in enumerate(queries.ids)}
        weights = terms.sparkSession.createDataFrame([(number[q], t, w) for q, t, w in rows], "query int, term string, weight long")
        names = terms.sparkSession.createDataFrame([(i, q) for q, i in number.items()], f"query int, item_id {kind}")
        best = _search(index, queries, weights, k).join(small(names, len(number)), "query")
        found = found.unionByName(best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return found


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Index the documents by the terms that the items use, and search for the items: item_id, rank, doc_id, score.

    Where the items' vocabulary is above the size of a block of queries, all terms are indexed.
    """
    pin(docs.sparkSession)
    terms = query_terms(items)
    words = terms.select("term").distinct()
    n, size = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()
    wanted = [r.term.encode() for r in words.collect()] if n <= QUERY_TERMS and size <= QUERY_BYTES else None
    return search(build_index(docs, wanted), terms, k)
