"""Collocations of two and three words by stripes: each prefix keys a counter of the words that follow.

There are two stripes. That of the empty prefix counts the words of a language. That of a prefix of two
words counts the third words; the end of a piece counts as one. A task counts a slice of texts into
stripes of its own and cuts them by bucket of the prefix; those of a bucket travel together, each word
spelt once and referred to by its number. A bucket merges the stripes of all slices element by element. From the merged stripe come the extensions (its elements), the prefix's total
(its sum, since the end of a piece is an element) and the largest extension (its maximum).

A bucket holds about `PART` occurrences. A prefix can only exceed that if both its words do, so the
prefixes of two such words are cut further by the third word, and their totals are added up once more.
The words concerned are at most `HEAVY_WORDS`, as their threshold grows with the corpus.

Rules: null texts are empty, a null language is `und`; A-Z alone change case; repeated rows and rows
without an id count like all others; phrases do not reach over a piece's end; further columns are
ignored; no documents give no rows. Counts stay exact up to 10^16 words of a language.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import pin, written
from .word_ids import Ids, blocks, byte_map, counted, summed, texts
from .words import mix

LEAST = 10
TOP = 2000
# A longer candidate with this share (in percent) of a phrase's occurrences takes its place.
COVERED = 50
# Occurrences in a bucket; words that a task counts at once, and their bytes.
PART = 2_000_000
SLICE = 4_000_000
SLICE_BYTES = 32_000_000
# At most so many words are looked up to tell the prefixes that are cut by the third word.
HEAVY_WORDS = 1_000_000
# Bits of a word's number in a slice; three numbers make one key.
_BITS = 21
# Bytes up to which a side of a join may be broadcast.
BROADCAST_BYTES = 16_000_000

_MAP = byte_map(b"\t", ends=b".,;:!?\x0b\x0c\r\n")
_END = 0
# No word is empty: the empty one stands for the end of a piece.
_RESERVED = (b"\n", b"")
# Ranks are first taken in so many parts of a language.
RANK_PARTS = 256


class _Slice:
    """Word numbers of the texts of one language; every piece ends with _END, and every text with two."""

    def __init__(self) -> None:
        self.ids = Ids(_RESERVED)
        self.parts: list[np.ndarray] = []

    def take(self, words: list[bytes]) -> None:
        numbers = self.ids.numbers(words)
        self.parts.append(numbers[numbers != 1])

    def last(self) -> list[bytes]:
        """The last two words or ends of pieces: they start the next slice of a text that is cut here."""
        names = list(self.ids.of)
        return [names[i] for i in np.concatenate(self.parts)[-2:]]

    def numbers(self) -> np.ndarray:
        """All but the last two stand here with the two that follow; these are ends, or start the next slice."""
        return np.concatenate(self.parts)

    def words(self) -> pa.Array:
        """Words by number; that of _END is empty."""
        return pa.concat_arrays([pa.array([""]), self.ids.words()[1:]])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, _Slice]]:
    """Slices of at most about SLICE words and SLICE_BYTES, by language; a longer text takes several."""
    own: dict[str, _Slice] = defaultdict(_Slice)
    size = n = 0
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), texts(batch), strict=True):
            lang = "und" if lang is None else lang
            for words in blocks(text.translate(_MAP).replace(b"\n", b" \n ")):
                own[lang].take(words)
                size, n = size + sum(map(len, words)) + len(words), n + len(words)
                if n >= SLICE or size >= SLICE_BYTES or len(own[lang].ids) >= 1 << (_BITS - 1):
                    last = own[lang].last()
                    yield own
                    own, size, n = defaultdict(_Slice), 0, 0
                    own[lang].take(last)
            own[lang].take([b"\n", b"\n"])
    if own:
        yield own


def word_counts(docs: DataFrame) -> DataFrame:
    """The stripe of the empty prefix: (lang, word, f), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _slices(batches):
            for lang, part in own.items():
                n = np.bincount(part.numbers()[:-2], minlength=len(part.ids))
                n[: len(_RESERVED)] = 0
                used = np.flatnonzero(n)
                yield pa.record_batch({
                    "lang": pa.array([lang]).take(pa.array(np.zeros(len(used), np.int32))),
                    "word": part.words().take(pa.array(used)), "f": pa.array(n[used]),
                })

    counts = docs.select("lang", "text").mapInArrow(run, "lang string, word string, f long")
    return written(counts.groupBy("lang", "word").agg(F.sum("f").alias("f")), "words")


def _ints(values: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest needs; the first byte tells how many."""
    size = 1 if not len(values) or values.max() < 1 << 8 else 2 if values.max() < 1 << 16 else 4
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _runs(*values: np.ndarray) -> np.ndarray:
    """Where runs of equal values, of the first array and then of the others, begin."""
    changed = np.zeros(len(values[0]), bool)
    changed[:1] = True
    for v in values:
        changed[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(changed)


def _of_slice(lang: str, part: _Slice, heavy: dict[tuple[str, str], int], limit: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """A slice's stripes, packed by bucket: words, then nested first words, second words, third words and counts."""
    ids, words = part.numbers(), part.words()
    part.parts.clear()
    at = np.flatnonzero((ids[:-2] != _END) & (ids[1:-1] != _END))
    keys = ids[at].astype(np.int64)
    for shift in (1, 2):
        keys <<= _BITS
        keys |= ids[at + shift]
    keys, n = counted(keys)
    low = (1 << _BITS) - 1
    first, second, third = keys >> (2 * _BITS), (keys >> _BITS) & low, keys & low
    names = words.to_pylist()
    hashed = np.array([zlib.crc32(w.encode()) for w in names], np.uint64)
    often = np.array([heavy.get((lang, w), 0) for w in names] if heavy else np.zeros(len(names)), np.int64)
    least = np.minimum(often[first], often[second])
    split = least > 0
    segment = hashed[third] % np.maximum(-(-least // limit), 1).astype(np.uint64)
    prefix = mix(hashed[first] * np.uint64(0x100000001) + np.uint64(zlib.crc32(lang.encode())))
    bucket = (mix(prefix + hashed[second] * np.uint64(0x100000001) + segment) % np.uint64(buckets)).astype(np.int64)
    group = bucket * 2 + split
    order = np.argsort(group, kind="stable")
    cuts = np.append(_runs(group[order]), len(order))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        mine = order[a:b]
        used, local = np.unique(np.concatenate([[_END], first[mine], second[mine], third[mine]]), return_inverse=True)
        one, two, three = local[1:].reshape(3, -1)
        stripe, many = _runs(one, two), np.flatnonzero(n[mine] > 1)
        starts = _runs(one[stripe])
        yield pa.record_batch({
            "bucket": pa.array([group[order[a]] // 2], pa.int64()), "lang": pa.array([lang]), "split": pa.array([bool(split[mine[0]])]),
            "words": pa.array([" ".join([names[i] for i in used[1:]])]),
            **{k: pa.array([_ints(v)], pa.binary()) for k, v in {
                "first": one[stripe[starts]], "n_second": np.diff(np.append(starts, len(stripe))),
                "second": two[stripe], "n_third": np.diff(np.append(stripe, b - a)),
                "third": three, "many": many, "n": n[mine][many],
            }.items()},
        })


def _unpacked(table: pa.Table, ids: Ids) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First, second and third word and count of each element, slice by slice."""
    for row in zip(*(table[c].to_pylist() for c in ("words", *PACKED_NUMBERS)), strict=True):
        number = np.append(np.zeros(1, np.int32), ids.numbers(row[0].encode().split(b" ")))
        first, n_second, second, n_third, third, many, n_many = map(_numbers, row[1:])
        n = np.ones(len(third), np.int64)
        n[many] = n_many
        yield (np.repeat(np.repeat(number[first], n_second), n_third), np.repeat(number[second], n_third), number[third], n)


def merged(table: pa.Table) -> pa.Table:
    """The stripes of a bucket added element by element: totals and largest extensions of prefixes, and frequent extensions.

    A total's row has no third word. Of prefixes cut by the third word, all totals are kept.
    """
    ids = Ids((b"",))
    first, second, third, n = (np.concatenate(c).astype(np.int64) for c in zip(*_unpacked(table, ids), strict=True))
    names, v = ids.words(), len(ids)
    pairs, of = np.unique(first * v + second, return_inverse=True)
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, of, n)
    keep = (total >= LEAST) | table["split"][0].as_py()
    use = keep[of]
    keys, f = summed(of[use] * v + third[use], n[use])
    extends = (f >= LEAST) & (keys % v != _END)
    keys, f = keys[extends], f[extends]
    longest = np.zeros(len(pairs), np.int64)
    np.maximum.at(longest, keys // v, f)
    prefixes = np.append(np.flatnonzero(keep), keys // v)
    third = np.append(np.full(int(keep.sum()), -1), keys % v)
    return pa.table({
        "lang": pa.array([table["lang"][0].as_py()]).take(pa.array(np.zeros(len(prefixes), np.int32))),
        "first": names.take(pa.array(pairs[prefixes] // v)), "second": names.take(pa.array(pairs[prefixes] % v)),
        "third": names.take(pa.array(third, pa.int64(), mask=third < 0)),
        "f": pa.array(np.append(total[keep], f)), "longest": pa.array(np.append(longest[keep], np.zeros(len(f), np.int64))),
    })


MERGED = "lang string, first string, second string, third string, f long, longest long"
PACKED_NUMBERS = ("first", "n_second", "second", "n_third", "third", "many", "n")
PACKED = "bucket long, lang string, split boolean, words string, " + ", ".join(f"{c} binary" for c in PACKED_NUMBERS)


def stripes(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Merged stripes of all prefixes of two words as `merged` gives them, written."""
    total = words.agg(F.sum("f")).first()[0] or 0
    buckets = max(-(-total // PART), 1)
    # Fewer than total / limit words are above the limit, so HEAVY_WORDS at most.
    limit = max(PART, -(-total // HEAVY_WORDS))
    heavy = {(r.lang, r.word): r.f for r in words.filter(F.col("f") > limit).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _slices(batches):
            for lang, part in own.items():
                yield from _of_slice(lang, part, heavy, limit, buckets)

    packed = docs.select("lang", "text").mapInArrow(run, PACKED)
    return written(packed.groupBy("bucket", "lang", "split").applyInArrow(merged, MERGED), "stripes")


def _light(df: DataFrame, *texts_: str) -> DataFrame:
    """A broadcast hint behind a count of the bytes sent; beyond the limit the join shuffles."""
    size = df.agg(F.sum(sum((F.octet_length(c) for c in texts_), F.lit(96)))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _score(a: str, l: str, r: str) -> Column:
    """floor(1000000 * a * a / (l * r)) in whole numbers of 38 digits."""
    def whole(c: str) -> str:
        return f"cast({c} as decimal(19, 0))"

    return F.expr(f"cast(1000000 as decimal(7, 0)) * ({whole(a)} * {whole(a)}) div ({whole(l)} * {whole(r)})")


def candidates(docs: DataFrame) -> DataFrame:
    """All candidates with their cut: lang, phrase, words, a, l, r, score, n, covered (largest longer candidate)."""
    pin(docs.sparkSession)
    words = word_counts(docs)
    found = stripes(docs, words)
    frequent = _light(words.filter(F.col("f") >= LEAST), "lang", "word")
    pairs = written(
        found.filter("third is null").groupBy("lang", "first", "second")
        .agg(F.sum("f").alias("a"), F.max("longest").alias("longest")).filter(F.col("a") >= LEAST), "pairs",
    )
    triples = found.filter("third is not null").select("lang", "first", "second", "third", F.col("f").alias("a"))
    known = _light(pairs.select("lang", "first", "second", "a"), "lang", "first", "second")

    def word(at: str, f: str) -> DataFrame:
        return frequent.select("lang", F.col("word").alias(at), F.col("f").alias(f))

    def pair(one: str, two: str, f: str) -> DataFrame:
        return known.select("lang", F.col("first").alias(one), F.col("second").alias(two), F.col("a").alias(f))

    behind = triples.groupBy("lang", F.col("second").alias("first"), F.col("third").alias("second")).agg(F.max("a").alias("before"))
    twos = (
        pairs.join(behind, ["lang", "first", "second"], "left").join(word("first", "l"), ["lang", "first"]).join(word("second", "r"), ["lang", "second"])
        .select("lang", F.array("first", "second").alias("words"), "a", "l", "r", _score("a", "l", "r").alias("score"),
                F.greatest("longest", F.coalesce("before", F.lit(0))).alias("covered"))
    )
    cut = F.col("score_2") < F.col("score_1")
    threes = (
        triples.join(pair("first", "second", "l2"), ["lang", "first", "second"]).join(pair("second", "third", "r1"), ["lang", "second", "third"])
        .join(word("first", "l1"), ["lang", "first"]).join(word("third", "r2"), ["lang", "third"])
        .withColumn("score_1", _score("a", "l1", "r1")).withColumn("score_2", _score("a", "l2", "r2"))
        .select("lang", F.array("first", "second", "third").alias("words"), "a", F.when(cut, F.col("l2")).otherwise(F.col("l1")).alias("l"),
                F.when(cut, F.col("r2")).otherwise(F.col("r1")).alias("r"), F.least("score_1", "score_2").alias("score"), F.lit(0).cast("long").alias("covered"))
    )
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return twos.unionByName(threes).join(_light(totals, "lang"), "lang").withColumn("phrase", F.array_join("words", " "))


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """The `top` candidates of each language that no longer candidate covers: lang, rank, phrase, a, l, r, n, score, words."""
    left = candidates(docs).filter(F.col("covered") * 100 < F.col("a") * COVERED)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best))
    few = left.withColumn("part", part).withColumn("rank", first).filter(F.col("rank") <= top)
    return few.withColumn("rank", rank).filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "words"
    )
