"""Matches of benchmark passages in documents by a positional inverted index, with DataFrames only.

The index holds one posting (row, term, position) for every word of the documents that is a word of
the benchmark, and one posting per document with its number of words. Words are split once, when the
index is written; all else reads the index. A benchmark item's windows are looked up from their
rarest term: its postings, shifted back by the term's offset, give candidate places; the next rarest
term's postings thin these out, and all other terms' postings must lie at their offsets.

With a `slack` of 0 a match is the exact phrase; with more, each term may lie that many words from
where the phrase has it (proximity).

Rules: a null or empty text has no words; an item without words matches nothing, one with fewer than
`k` words is one window; rows with equal doc_id are separate documents; further columns are ignored;
no documents give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import BROADCAST_ROWS, pin, small, written

K = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What separates words once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The term of the posting that holds a document's number of words; no word is empty.
LENGTH = ""


def words(text: str) -> Column:
    """Lower-case words of a text column; A-Z alone change case."""
    given = F.coalesce(F.col(text), F.lit(""))
    ascii_only = F.octet_length(given) == F.char_length(given)
    lower = F.when(ascii_only, F.lower(given)).otherwise(F.translate(given, UPPER, LOWER))
    return F.array_remove(F.split(lower, SEPARATORS), "")


@dataclass
class Index:
    """Written postings (row, doc_id, text_hash, term, pos), the benchmark's terms (term, word, n) and their number."""

    postings: DataFrame
    terms: DataFrame
    n_terms: int


def build_index(docs: DataFrame, benchmark: DataFrame) -> Index:
    """Index the documents by the benchmark's words."""
    vocabulary = written(
        benchmark.select(F.explode(words("text")).alias("word")).distinct()
        .select("word", F.monotonically_increasing_id().alias("term")), "terms",
    )
    n_terms = vocabulary.count()
    known = vocabulary.unionByName(docs.sparkSession.createDataFrame([(LENGTH, -1)], "word string, term long"))
    split = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), words("text").alias("w"))
    # The posting of the length stands behind the last word, so its position is the number of words.
    placed = split.select("row", "doc_id", "text_hash", F.posexplode(F.concat("w", F.array(F.lit(LENGTH)))).alias("pos", "word"))
    postings = written(placed.join(small(known, n_terms), "word").select("row", "doc_id", "text_hash", "term", "pos"), "postings")
    counts = postings.filter("term >= 0").groupBy("term").agg(F.count("*").alias("n"))
    terms = written(vocabulary.join(counts, "term", "left").select("term", "word", F.coalesce("n", F.lit(0)).alias("n")), "term-counts")
    return Index(postings, terms, n_terms)


def windows(benchmark: DataFrame, index: Index, k: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows as (win, size, rank, term, off), rarest term first, and (win, item_id).

    Windows with a word that no document has are left out: they match nothing.
    """
    items = benchmark.select("item_id", words("text").alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - k, F.lit(0)))
    each = items.select("item_id", "w", F.explode(starts).alias("at")).select(
        "item_id", F.slice("w", F.col("at") + 1, k).alias("phrase")
    )
    phrases = written(each.groupBy("phrase").agg(F.collect_set("item_id").alias("items"))
                      .select(F.monotonically_increasing_id().alias("win"), "phrase", "items"), "windows")
    placed = phrases.select("win", F.size("phrase").alias("size"), F.posexplode("phrase").alias("off", "word"))
    rarest = Window.partitionBy("win").orderBy("n", "term", "off")
    ranked = (
        placed.join(index.terms, "word").withColumn("rank", F.row_number().over(rarest))
        .withColumn("least", F.min("n").over(Window.partitionBy("win"))).filter("least > 0")
        .select("win", "size", "rank", "term", "off")
    )
    return written(ranked, "ranked"), phrases.select("win", F.explode("items").alias("item_id"))


def matches(index: Index, ranked: DataFrame, slack: int = 0) -> DataFrame:
    """Places (row, start, size, win) where all terms of a window stand, each within `slack` words."""
    postings = index.postings.filter("term >= 0").select("row", "term", "pos")
    n_windows = ranked.filter("rank = 1").count()
    shifts = F.explode(F.sequence(F.lit(-slack), F.lit(slack)))

    def terms_at(rank: Column) -> DataFrame:
        return ranked.filter(rank)

    first = terms_at(F.col("rank") == 1).select("win", "size", "term", "off")
    found = written(
        postings.join(small(first, n_windows), "term").select("row", "win", "size", (F.col("pos") - F.col("off")).alias("start"))
        .filter("start >= 0"), "places",
    )

    def wanted(rank: Column) -> DataFrame:
        """The terms that each place needs, at their positions."""
        n = n_windows * 16  # a window has few terms; beyond the limit the join shuffles
        need = found.join(small(terms_at(rank).select("win", "term", "off"), n), "win")
        return need.select("row", "win", "size", "start", "off", "term", shifts.alias("by")).withColumn(
            "pos", F.col("start") + F.col("off") + F.col("by")
        ).filter("pos >= 0")

    second = terms_at(F.col("rank") == 2)
    of_second = postings.join(small(second.select("term").distinct(), index.n_terms), "term", "left_semi")
    kept = wanted(F.col("rank") == 2).join(of_second, ["row", "term", "pos"], "left_semi").select("row", "win", "size", "start")
    found = written(kept.distinct().unionByName(found.filter("size = 1")), "places-2")

    rows = written(found.select("row").distinct(), "rows")
    near = postings.join(small(rows, rows.count(), BROADCAST_ROWS), "row", "left_semi")
    rest = (
        wanted(F.col("rank") > 2).join(near, ["row", "term", "pos"], "left_semi")
        .select("row", "win", "size", "start", "off").distinct()
        .groupBy("row", "win", "size", "start").agg(F.count("*").alias("n"))
        .filter("n = size - 2").drop("n")
    )
    return rest.unionByName(found.filter("size <= 2")).select("row", "start", "size", "win")


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = K, slack: int = 0) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, text_hash.

    With a slack above 0, the words from a match's start to its end count as hit.
    """
    pin(docs.sparkSession)
    index = build_index(docs, benchmark)
    ranked, items = windows(benchmark, index, k)
    found = written(matches(index, ranked, slack), "matches")
    # Hit words: each place adds what lies behind the end of all places before it.
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    hits = (
        found.groupBy("row", "start").agg(F.max("size").alias("size"))
        .withColumn("until", F.max(F.col("start") + F.col("size")).over(before))
        .withColumn("added", F.greatest(F.col("start") + F.col("size") - F.greatest("start", F.coalesce("until", "start")), F.lit(0)))
        .groupBy("row").agg(F.sum("added").alias("n_hit"))
    )
    named = (
        found.select("row", "win").distinct().join(small(items, index.n_terms), "win")
        .groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    marked = written(hits.join(named, "row", "left"), "hits")
    lengths = index.postings.filter("term = -1").select("row", "doc_id", "text_hash", F.col("pos").cast("long").alias("n_words"))
    names = F.coalesce("items", F.array().cast("array<string>"))
    return lengths.join(marked, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), names.alias("items"), "text_hash",
    )
