"""Removal of word sequences that occur earlier, by super-k-mers.

Words are runs of characters other than ASCII white space. A window is `k` consecutive words; its
minimiser is its least hash of `M` consecutive words. Consecutive windows that share a minimiser make
one packed string, sent to the minimiser's bucket; in the bucket equal windows are found by sorting
their hashes and comparing the words themselves, so that hashes decide nothing alone.

Skew: equal strings of a slice leave one copy, the earliest, the others are known repeats at once.
Minimisers that hold more than a bucket's fair share send each window by its own hash instead, so
that only equal windows meet. Buckets grow in number, not in size, with the input.

Rules: a null or short text loses nothing; rows with equal doc_id and text give equal results, rows
with equal doc_id and different text are ordered by the hash of their text; a null doc_id counts as
larger than any; further columns are ignored; no documents give no rows. `kept_sha256` is of the kept
words joined by one space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import pin, written
from .words import Words, mix, slices, words_of

K = 20
M = 4
# Words of the corpus per bucket, and the least number of buckets.
BUCKET_WORDS = 400_000
MIN_BUCKETS = 256
SLICE = 4_000_000
# Groups that known repeats are spread over.
KNOWN = 1024
LAST_ID = (1 << 63) - 1

PARTS = "bucket int, texts binary, docs binary, ties binary, firsts binary"
RUNS = "doc long, tie long, first int, n int"


def _minimisers(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows inside one text (by first word), and the minimiser of each."""
    at = words.inside(k)
    least = words.windows(M)
    width, span = k - M + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        rest = width - span
        least = np.minimum(least[:-rest], least[rest:])
    return at, least[at]


def heavy_minimisers(docs: DataFrame, k: int) -> tuple[int, np.ndarray]:
    """Number of buckets for the corpus, and minimisers with more windows than half a bucket's share.

    Every task reports its words and the minimisers that could be heavy (those above the share in
    proportion to its words), at most twice the number of buckets; so the list is bounded.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, keys, counts = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held = []

        def fold():
            nonlocal keys, counts
            every = np.concatenate([keys, *[h[0] for h in held]])
            weight = np.concatenate([counts, *[h[1] for h in held]])
            keys, back = np.unique(every, return_inverse=True)
            counts = np.bincount(back, weight, len(keys)).astype(np.int64)
            # What is far below a share of the words so far cannot decide the balance.
            kept = counts * 16 * MIN_BUCKETS > total
            keys, counts = keys[kept], counts[kept]
            held.clear()

        for batch in (b for whole in batches for b in slices(whole, size=SLICE)):
            words = words_of(batch["text"].to_pylist())
            total += len(words.hashes)
            _, least = _minimisers(words, k)
            held.append(np.unique(least, return_counts=True))
            fold()
        yield pa.record_batch({"key": np.array([0], np.int64), "n": np.array([total], np.int64), "total": [True]})
        yield pa.record_batch({"key": keys.view(np.int64), "n": counts, "total": np.zeros(len(keys), bool)})

    found = (
        docs.select("text").mapInArrow(count, "key long, n long, total boolean")
        .groupBy("key", "total").agg(F.sum("n").alias("n"))
    )
    found = written(found, "minimisers")
    words = found.filter("total").agg(F.sum("n")).first()[0] or 0
    buckets = max(MIN_BUCKETS, -(-words // BUCKET_WORDS))
    heavy = found.filter(f"not total and n > {words / buckets / 2}").select("key").collect()  # at most 2 * buckets
    return int(buckets), np.sort(np.array([r["key"] for r in heavy], np.int64).view(np.uint64))


def pack(docs: DataFrame, k: int, buckets: int, heavy: np.ndarray) -> DataFrame:
    """Super-k-mers by bucket (PARTS), and repeats known within a slice (buckets below 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=4)
        for batch in (b for whole in batches for b in slices(whole, size=SLICE)):
            words = words_of(batch["text"].to_pylist())
            at, least = _minimisers(words, k)
            if not len(at):
                continue
            text_of = np.searchsorted(words.offsets, at, side="right") - 1
            alone = np.isin(least, heavy) if len(heavy) else np.zeros(len(at), bool)
            new = np.ones(len(at), bool)
            new[1:] = (least[1:] != least[:-1]) | (text_of[1:] != text_of[:-1]) | alone[1:]
            first = np.flatnonzero(new)
            n = np.diff(first, append=len(at))
            a = at[first]
            key = np.where(alone[first], words.windows(k)[a], least[first])
            bucket = (mix(key ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)
            doc = batch["doc"].to_numpy()[text_of[first]]
            tie = batch["tie"].to_numpy()[text_of[first]]
            start = a - words.offsets[text_of[first]]
            order = np.lexsort((start, tie, doc))
            raw = words.data.tobytes()
            begin, end = words.starts[a].tolist(), words.ends[a + n + k - 2].tolist()
            seen: dict[bytes, int] = {}
            keep, repeat = [], []
            for i in order.tolist():
                text = raw[begin[i] : end[i]]
                first_seen = seen.setdefault(text, i)
                if first_seen == i:
                    keep.append(i)
                elif (doc[i], tie[i], start[i]) != (doc[first_seen], tie[first_seen], start[first_seen]):
                    repeat.append(i)
            texts = list(seen)
            if repeat:
                yield _part([-1 - int(doc[repeat[0]]) % KNOWN], [b""], [(doc[repeat], tie[repeat], np.stack([start[repeat], n[repeat]], 1))])
            keep = np.array(keep)
            by = np.argsort(bucket[keep], kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[keep][by], prepend=-1, append=-1))
            names, blobs, arrays = [], [], []
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                rows = keep[by[x:y]]
                names.append(int(bucket[rows[0]]))
                blobs.append(squeeze.compress(b"\n".join([texts[j] for j in by[x:y].tolist()])))
                arrays.append((doc[rows], tie[rows], start[rows]))
            yield _part(names, blobs, arrays)

    keyed = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), F.xxhash64("text").alias("tie"), "text")
    return keyed.mapInArrow(run, PARTS)


def _part(names: list[int], blobs: list[bytes], arrays: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch({
        "bucket": pa.array(names, pa.int32()), "texts": pa.array(blobs, pa.binary()),
        "docs": pa.array([a[0].astype("<i8").tobytes() for a in arrays], pa.binary()),
        "ties": pa.array([a[1].astype("<i8").tobytes() for a in arrays], pa.binary()),
        "firsts": pa.array([a[2].astype("<i4").tobytes() for a in arrays], pa.binary()),
    })


def repeats_in_bucket(k: int):
    """For one bucket's super-k-mers: runs of windows whose words also occur earlier."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return known_repeats(table)
        texts = [t for blob in table["texts"].to_pylist() for t in zstandard.decompress(blob).split(b"\n")]
        doc, tie, first = (
            np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in (("docs", "<i8"), ("ties", "<i8"), ("firsts", "<i4"))
        )
        lists = pc.split_pattern(pa.array(texts, pa.large_binary()).cast(pa.large_string(), safe=False), " ")
        code = np.asarray(lists.flatten().dictionary_encode().indices).astype(np.int64)
        offsets = np.asarray(lists.offsets).astype(np.int64)
        counts = np.diff(offsets) - k + 1
        owner = np.repeat(np.arange(len(texts)), counts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = offsets[owner] + nth
        start = first[owner] + nth
        hashed = Words(np.zeros(0, np.uint8), offsets, offsets, offsets, mix(code + 1)).windows(k)[at]
        removed = np.zeros(len(at), bool)
        left = np.arange(len(at))
        while len(left):
            # Order by hash, then by place: the first of a hash is the earliest of its words.
            order = left[np.lexsort((start[left], tie[owner[left]], doc[owner[left]], hashed[left]))]
            new = np.ones(len(order), bool)
            new[1:] = hashed[order[1:]] != hashed[order[:-1]]
            head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
            others = np.flatnonzero(~new)
            same = np.ones(len(others), bool)
            for j in range(k):
                same &= code[at[order[others]] + j] == code[at[head[others]] + j]
            # A row that repeats the head's own place is the same document once more, no repeat of its words.
            twin = (start[order] == start[head]) & (doc[owner[order]] == doc[owner[head]]) & (tie[owner[order]] == tie[owner[head]])
            removed[order[others[same & ~twin[others]]]] = True
            left = order[others[~same]]  # different words with one hash: once more among themselves
        hit = np.flatnonzero(removed)
        join = np.zeros(len(hit), bool)
        join[1:] = (hit[1:] == hit[:-1] + 1) & (owner[hit[1:]] == owner[hit[:-1]])
        begin = np.flatnonzero(~join)
        return pa.table({
            "doc": doc[owner[hit[begin]]], "tie": tie[owner[hit[begin]]],
            "first": start[hit[begin]].astype(np.int32), "n": np.diff(begin, append=len(hit)).astype(np.int32),
        })

    return run


def known_repeats(table: pa.Table) -> pa.Table:
    pairs = np.frombuffer(b"".join(table["firsts"].to_pylist()), "<i4").reshape(-1, 2)
    return pa.table({
        "doc": np.frombuffer(b"".join(table["docs"].to_pylist()), "<i8"),
        "tie": np.frombuffer(b"".join(table["ties"].to_pylist()), "<i8"),
        "first": np.ascontiguousarray(pairs[:, 0]), "n": np.ascontiguousarray(pairs[:, 1]),
    })


def kept_words(text: str | None, runs: list[dict] | None, k: int) -> tuple[list[bytes], int]:
    """Words of a text outside all windows of the runs, and the number of its words."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    if not runs:
        return words, len(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for run in runs:
        edge[run["first"]] += 1
        edge[run["first"] + run["n"] + k - 1] -= 1
    covered = np.cumsum(edge[:-1]) > 0
    return [words[i] for i in np.flatnonzero(~covered).tolist()], len(words)


def substring_dedup(docs: DataFrame, k: int = K) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and the kept text."""
    spark = pin(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    buckets, heavy = heavy_minimisers(docs, k)
    runs = (
        pack(docs, k, buckets, heavy).groupBy("bucket").applyInArrow(repeats_in_bucket(k), RUNS)
        .groupBy("doc", "tie").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    )
    runs = written(runs, "repeats")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in slices(whole)):
            sizes, removed, digests, texts = [], [], [], []
            for text, own in zip(batch["text"].to_pylist(), batch["runs"].to_pylist(), strict=True):
                words, n = kept_words(text, own, k)
                kept = b" ".join(words)
                sizes.append(n)
                removed.append(n - len(words))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode("utf-8", "surrogatepass"))
            yield pa.record_batch({
                "doc_id": batch["doc_id"], "n_words": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                "kept_sha256": pa.array(digests, pa.string()), "kept_text": pa.array(texts, pa.string()),
            })

    keyed = docs.withColumn("doc", F.coalesce("doc_id", F.lit(LAST_ID))).withColumn("tie", F.xxhash64("text"))
    return keyed.join(runs, ["doc", "tie"], "left").select("doc_id", "text", "runs").mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
