"""Near-duplicate documents by weighted Jaccard similarity of word shingles (BagMinHash).

Shingles are runs of five words (lower-cased A-Z, split at ASCII white space); a shorter text is one
shingle. A document is the multiset of its shingles. For the signature every shingle's weight range
is cut at powers of two, and each piece [2^j, 2^(j+1)) has its own Poisson process in time with a
rate of its width; points fall on a random component and, inside the piece that the weight cuts, on a
random level that must lie below the weight. A component's value is its earliest point, so two
documents agree in a component with the probability of their weighted Jaccard similarity. Only points
before the time by which all components are expected to be filled are made; a document that is not
filled by then goes on to twice that time.

Signatures are cut into bands; a band's hash is a bucket. Copies (equal normalised words) are one
node. Every bucket's smallest node is compared with all its others, exactly, on the whole multisets.
Buckets whose nodes are not one component by then are cut into blocks of about `BLOCK` nodes, and a
task compares two blocks and gives back a tree of links for each component it finds. So every pair
that shares a bucket is joined or compared, no task gets more than two blocks, and no group's pairs
are ever rows.

Rules: null and blank texts have no shingles and are each a class of their own; rows with equal
doc_id are separate texts that share the id; a null doc_id takes part, and is larger than any other;
further columns are ignored; no documents give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import components, pin, small, written
from .words import SLICE_BYTES, Words, mix, slices, words_of

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 25
ROWS = 5
# Nodes per block of a bucket, and shingles per matrix product.
BLOCK = 400
COLUMNS = 4096
LAST_ID = (1 << 63) - 1
_U = np.uint64


def multisets(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts: text, hash and count, in order of text."""
    at = words.inside(size)
    text = np.searchsorted(words.offsets, at, side="right") - 1
    hashed = words.windows(size)[at] if len(at) else np.zeros(0, _U)
    n = np.diff(words.offsets)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        whole = np.array([np.bitwise_xor.reduce(mix(words.hashes[a:b] + np.arange(1, b - a + 1, dtype=_U)))
                          for a, b in zip(words.offsets[short], words.offsets[short + 1], strict=True)], _U)
        text, hashed = np.concatenate([text, short]), np.concatenate([hashed, whole])
    order = np.lexsort((hashed, text))
    text, hashed = text[order], hashed[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashed[1:] != hashed[:-1])
    first = np.flatnonzero(new)
    return text[first], hashed[first], np.diff(first, append=len(text))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(text: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_texts: int, size: int) -> np.ndarray:
    """`size` components for each text; texts without shingles get zeros."""
    out = np.zeros((n_texts, size), _U)
    # Pieces of the weight ranges: [0, 1), [1, 2), [2, 4), ... as far as the weight reaches.
    top = np.floor(np.log2(np.maximum(count - 1, 1))).astype(np.int64) + 1
    pieces = np.where(count > 1, top + 1, 1)
    owner = np.repeat(np.arange(len(text)), pieces)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    low = np.where(level > 0, 2.0 ** (level - 1.0), 0.0)
    rate = np.maximum(low, 1.0)
    seed = mix(shingle[owner] ^ mix(level.astype(_U) + _U(77)))
    weight = count[owner].astype(np.float64)
    doc = text[owner]
    total = np.bincount(text, count, n_texts)
    limit = np.where(total > 0, size * (np.log(size) + 3) / np.maximum(total, 1), 0.0)
    todo = total > 0
    while todo.any():
        rows = np.flatnonzero(todo[doc])
        time = np.zeros(len(rows))
        best, ids = np.full(n_texts * size, np.inf), np.zeros(n_texts * size, _U)
        slots, times, marks = [], [], []
        i = 0
        while len(rows):
            point = mix(seed[rows] + _U(i * 0x9E3779B97F4A7C15 % (1 << 64)))
            time = time - np.log(_uniform(point)) / rate[rows]
            alive = time < limit[doc[rows]]
            rows, time, point = rows[alive], time[alive], point[alive]
            more = mix(point ^ _U(0xD1B54A32D192ED03))
            ok = low[rows] + _uniform(mix(more)) * rate[rows] < weight[rows]
            slots.append(doc[rows[ok]] * size + (more[ok] % _U(size)).astype(np.int64))
            times.append(time[ok])
            marks.append(point[ok])
            i += 1
        slot, when, mark = np.concatenate(slots), np.concatenate(times), np.concatenate(marks)
        np.minimum.at(best, slot, when)
        win = when == best[slot]
        ids[slot[win]] = mark[win]
        filled = np.isfinite(best).reshape(n_texts, size).all(1) & todo
        out[filled] = ids.reshape(n_texts, size)[filled]
        todo &= ~filled
        limit *= 2
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cut = signature.reshape(len(signature), bands, rows)
    hashed = mix(np.arange(1, bands + 1, dtype=_U))[None, :] * np.ones((len(cut), 1), _U)
    for r in range(rows):
        hashed = mix(hashed ^ (cut[:, :, r] + _U(r)))
    return hashed


def _normal(text: str | None) -> bytes:
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split()) if text else b""


def sketch(bands: int, rows: int):
    """Batches of (doc_id, text) to (doc_id, copy: digest of the words, bands: hashes or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in slices(whole, size=SLICE_BYTES)):
            texts = batch["text"].to_pylist()
            words = words_of(texts, lower=True)
            hashed = band_hashes(signatures(*multisets(words), len(texts), bands * rows), bands, rows)
            empty = np.diff(words.offsets) == 0
            flat = pa.array(hashed.view(np.int64).ravel())
            offsets = pa.array(np.append(np.arange(len(texts)) * bands, len(texts) * bands).astype(np.int32),
                               mask=np.append(empty, False))
            yield pa.record_batch({
                "doc_id": batch["doc_id"],
                "text_hash": batch["text_hash"],
                "copy": pa.array([None if e else hashlib.blake2b(_normal(t), digest_size=16).digest()
                                  for t, e in zip(texts, empty, strict=True)], pa.binary()),
                "bands": pa.ListArray.from_arrays(offsets, flat),
            })

    return run


def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [packer.compress(_normal(t)) for t in batch["text"].to_pylist()]
        yield pa.record_batch({"node": batch["node"], "packed": pa.array(packed, pa.binary())})


def _overlaps(threshold: float):
    """Batches of (a, b, ta, tb) to the pairs whose multisets' weighted Jaccard reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n = part.num_rows
                # A text that many pairs share is unpacked and hashed once.
                place: dict[bytes, int] = {}
                left, right = ([place.setdefault(t, len(place)) for t in part[c].to_pylist()] for c in ("ta", "tb"))
                texts = [unpack(t).decode("utf-8", "surrogatepass") for t in place]
                text, shingle, count = multisets(words_of(texts))
                cuts = np.searchsorted(text, np.arange(len(texts) + 1))
                totals = np.bincount(text, count, len(texts))
                linked = np.zeros(n, bool)
                for i, (x, y) in enumerate(zip(left, right, strict=True)):
                    a, b = slice(cuts[x], cuts[x + 1]), slice(cuts[y], cuts[y + 1])
                    least, most = sorted((totals[x], totals[y]))
                    if least < threshold * most:
                        continue
                    _, ia, ib = np.intersect1d(shingle[a], shingle[b], assume_unique=True, return_indices=True)
                    shared = np.minimum(count[a][ia], count[b][ib]).sum()
                    linked[i] = shared >= threshold * (totals[x] + totals[y] - shared)
                yield pa.record_batch({"a": part["a"], "b": part["b"]}).filter(pa.array(linked))

    return run


def compare_blocks(threshold: float):
    """For the nodes of one block, or of two, of a bucket: links that join what is similar enough.

    Overlaps come from products of 0/1 matrices over the shingles that at least two texts have, a
    repeated shingle counting as so many different ones. All pairs are compared, but only a tree of
    each component is given back.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        node, own = table["node"].to_numpy(), table["own"].to_numpy()
        texts = [zstandard.decompress(t).decode("utf-8", "surrogatepass") for t in table["packed"].to_pylist()]
        n = len(node)
        text, shingle, count = multisets(words_of(texts))
        total = np.bincount(text, count, n)
        row = np.repeat(text, count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        _, column, size = np.unique(mix(np.repeat(shingle, count) + nth.astype(_U)), return_inverse=True, return_counts=True)
        common = size >= 2
        place = np.cumsum(common) - 1
        inside = common[column]
        row, column = row[inside], place[column[inside]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        shared = np.zeros((n, n), np.float32)
        for at in range(0, int(common.sum()), COLUMNS):
            a, b = np.searchsorted(column, [at, at + COLUMNS])
            part = np.zeros((n, COLUMNS), np.float32)
            part[row[a:b], column[a:b] - at] = 1
            shared += part @ part.T
        linked = shared >= threshold * (total[:, None] + total[None, :] - shared)
        if key[1].as_py() != key[2].as_py():
            linked &= own[:, None] != own[None, :]
        np.fill_diagonal(linked, True)
        label, before = np.arange(n), None
        while before is None or (label != before).any():
            before = label
            label = np.where(linked, label[None, :], n).min(1)
        joined = np.flatnonzero(label != np.arange(n))
        return pa.table({"a": node[label[joined]], "b": node[joined]})

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: doc_id, class_id (smallest doc_id of its class), kept, text_hash.

    Of each class one row is kept, the first by doc_id (null last), text_hash and place in the input; texts
    without a word are in no class and kept.
    """
    pin(docs.sparkSession)
    docs = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    sketched = written(
        docs.mapInArrow(sketch(bands, rows), "doc_id long, text_hash long, copy binary, bands array<long>")
        .withColumn("row", F.monotonically_increasing_id()), "sketches"
    )
    copies = sketched.filter("copy is not null").groupBy("copy").agg(
        F.min(F.struct("doc_id", "text_hash", "row")).alias("first"), F.first("bands").alias("bands")
    )
    nodes = written(
        copies.select(F.monotonically_increasing_id().alias("node"), "copy", "first.doc_id", "first.text_hash", "first.row", "bands"), "nodes"
    )

    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = written(spread.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "shared")
    members = written(spread.join(shared, "bucket"), "members")
    wanted = written(members.select("node").distinct().join(nodes.select("node", "doc_id", "text_hash"), "node"), "wanted")
    chosen = docs.join(small(wanted, 4 * wanted.count()), ["doc_id", "text_hash"])
    packed = written(
        chosen.select("node", "text").mapInArrow(squeeze, "node long, packed binary").dropDuplicates(["node"]), "texts"
    )

    # First every bucket's smallest node against its others: most buckets are one component then.
    heads = written(members.groupBy("bucket").agg(F.min("node").alias("head")), "heads")
    pairs = written(
        members.join(heads, "bucket").filter("node > head")
        .select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "pairs",
    )
    links = written(
        pairs.join(packed.select(F.col("node").alias("a"), F.col("packed").alias("ta")), "a")
        .join(packed.select(F.col("node").alias("b"), F.col("packed").alias("tb")), "b")
        .select("a", "b", "ta", "tb").mapInArrow(_overlaps(threshold), "a long, b long"), "links",
    )
    labels = components(links)

    # Then all that is left in buckets of several components, in pairs of blocks.
    placed = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = written(
        placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"))
        .filter("lo <> hi").select("bucket", F.ceil((F.col("n") - 1) / BLOCK).alias("blocks")), "mixed",
    )
    used = heads.select("bucket", F.col("head").alias("node"))
    left = members.join(used, ["bucket", "node"], "left_anti").join(mixed, "bucket").withColumn(
        "own", F.pmod(F.xxhash64("node"), F.col("blocks"))
    )
    dealt = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node"
    )
    more = dealt.join(packed, "node").groupBy("bucket", "p", "q").applyInArrow(compare_blocks(threshold), "a long, b long")
    labels = components(written(links.unionByName(more), "all-links"))

    of_node = nodes.select("node", "copy", "doc_id", "text_hash", "row").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = written(of_node.groupBy("label").agg(F.min(F.struct("doc_id", "text_hash", "row")).alias("least")), "classes")
    classes = written(of_node.join(least, "label").select(
        "copy", F.col("least.doc_id").alias("class_id"), F.col("least.row").alias("kept_row")
    ), "class-of-copy")
    found = sketched.select("doc_id", "text_hash", "copy", "row").join(classes, "copy", "left")
    found = found.withColumn("class_id", F.coalesce("class_id", "doc_id"))
    return found.select(
        F.nullif("doc_id", F.lit(LAST_ID)).alias("doc_id"), F.nullif("class_id", F.lit(LAST_ID)).alias("class_id"),
        (F.col("row") == F.coalesce("kept_row", "row")).alias("kept"), "text_hash",
    )
