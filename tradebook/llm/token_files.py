"""Token ids in Arrow files of equal-length sequences, read without copying.

Documents are dealt to shards by ranges of their id, each shard is encoded and written by one task,
and a shard is an Arrow file whose record batches hold fixed-size lists: `ids` (16 bits where the
vocabulary fits, else 32) and `mask` (true where there is a token; only a shard's last sequence is
padded). Beside it lies an Arrow file with the documents' ids, starts and lengths within the shard.
Sequence i of a shard is row i mod `BATCH` of batch i div `BATCH`, so any sequence, and any document,
is found by arithmetic in a memory-mapped file.

Texts are encoded piece by piece: a blank before a visible character always begins a new piece of
this byte-level vocabulary's splitting pattern, so equal pieces need encoding only once per worker,
and new pieces are encoded many at a time in one text. A worker that remembers too many pieces keeps
those that it met again.

Rules: a null text is empty and has the end id only; rows with equal ids stay separate documents,
ordered by the hash of their text; a null id sorts first; further columns are ignored; no documents
give no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_dir
from .common import pin, written
from .words import slices

END_ID = 2
# Fixed value: how byte-level vocabularies write a blank.
BLANK = "\u0120"
SEQUENCE = 2048
BATCH = 256
# Pieces a worker remembers, and of these the most it keeps when there are more.
REMEMBERED = 450_000
KEPT = 250_000
# Pieces encoded as one text.
JOINED = 200
# Text per shard, in bytes.
SHARD_BYTES = 16_000_000


def open_place(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder given as a URI or a plain path."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def publish(fs: pafs.FileSystem, path: str, write) -> None:
    """`write(stream)` into a file of this attempt, then the final name: a task run again replaces it."""
    part = f"{path}.{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(part) as out:
        write(out)
    fs.move(part, path)


class PieceEncoder:
    """Encodes texts by the tokenizers library, each distinct piece once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith(BLANK)]] = True
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.starts, self.sizes, self.used = (np.zeros(0, np.int64) for _ in range(3))

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces not seen before and append their ids."""
        plain, rest = [], []
        for piece in pieces:
            (plain if piece.startswith(" ") and piece.count(" ") == 1 else rest).append(piece)
        sizes, flat = [], []
        groups = [plain[a : a + JOINED] for a in range(0, len(plain), JOINED)]
        texts = ["".join(group) for group in groups]
        for group, text, ids in zip(groups, texts, self._encoded(texts), strict=True):
            ids = np.array(ids, np.uint32)
            begins = np.flatnonzero(self.opens[ids])
            if len(begins) == len(group) and begins[0] == 0 and not any(s in text for s in self.special):
                sizes.append(np.diff(begins, append=len(ids)))
                flat.append(ids)
            else:
                self._single(group, sizes, flat)
        self._single(rest, sizes, flat)
        pieces = plain + rest
        sizes, flat = np.concatenate(sizes), np.concatenate(flat)
        at = len(self.known)
        self.known.update(zip(pieces, range(at, at + len(pieces)), strict=True))
        self.used = np.concatenate([self.used, np.zeros(len(pieces), np.int64)])
        self.starts = np.concatenate([self.starts, np.cumsum(sizes) - sizes + len(self.ids)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, flat])

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _single(self, pieces: list[str], sizes: list[np.ndarray], flat: list[np.ndarray]) -> None:
        ids = self._encoded(pieces)
        sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
        flat.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes[-1].sum())))

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Rows of the pieces among those known; learns what is new."""
        at = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        unknown = np.flatnonzero(at < 0).tolist()
        if unknown:
            new = list(dict.fromkeys(map(pieces.__getitem__, unknown)))
            if len(self.known) + len(new) > REMEMBERED:
                self._forget()
                unknown = range(len(pieces))
                new = list(dict.fromkeys(p for p in pieces if p not in self.known))
            if new:
                self._learn(new)
            at[unknown] = np.fromiter(map(self.known.__getitem__, map(pieces.__getitem__, unknown)), np.int64, len(unknown))
        self.used[at] += 1
        return at

    def _forget(self) -> None:
        """Keep the pieces met more than once, the most used first."""
        kept = np.argsort(-self.used, kind="stable")[:KEPT]
        kept = np.sort(kept[self.used[kept] > 1])
        names = list(self.known)
        self.known = {names[i]: n for n, i in enumerate(kept.tolist())}
        sizes = self.sizes[kept]
        ends = np.cumsum(sizes)
        self.ids = self.ids[np.repeat(self.starts[kept] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        self.starts, self.sizes, self.used = ends - sizes, sizes, np.ones(len(kept), np.int64)

    def _pieces(self, text: str) -> list[str]:
        """Parts of the text that encode on their own."""
        if any(s in text for s in self.special):
            return [text]
        words = text.split(" ")
        pieces = [words[0]]
        for w in words[1:]:
            if not w or w[0].isspace():
                pieces[-1] += " " + w
            else:
                pieces.append(" " + w)
        return pieces

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end id after each text, and the number of ids of each text."""
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        code = np.asarray(coded.indices)
        offsets = np.asarray(lists.offsets).astype(np.int64)
        offsets -= offsets[0]
        odd = pc.or_(pc.equal(words, ""), pc.utf8_is_space(pc.utf8_slice_codeunits(words, 0, 1)))
        for special in self.special:
            odd = pc.or_(odd, pc.match_substring(words, special))
        odd = odd.to_numpy(zero_copy_only=False)
        odd_texts = np.unique(np.searchsorted(offsets, np.flatnonzero(odd[code]), side="right") - 1).tolist()
        own = [self._pieces(texts[i].as_py() or "") for i in odd_texts]
        blank = pc.binary_join_element_wise("", words, " ").to_pylist()
        every = [*blank, *words.take(coded.indices.take(pa.array(offsets[:-1]))).to_pylist(), *chain.from_iterable(own)]
        place = self._places(every)
        at = place[code]
        at[offsets[:-1]] = place[len(words) : len(words) + len(texts)]
        counts = np.diff(offsets)
        if odd_texts:
            parts, before, used = [], 0, len(words) + len(texts)
            for i, pieces in zip(odd_texts, own, strict=True):
                parts += [at[before : offsets[i]], place[used : used + len(pieces)]]
                before, used, counts[i] = offsets[i + 1], used + len(pieces), len(pieces)
            at = np.concatenate([*parts, at[before:]])
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(total)]
        until = np.concatenate(([0], ends))[np.cumsum(counts)]
        return np.insert(flat, until, END_ID), np.diff(until, prepend=0) + 1


@lru_cache(maxsize=1)
def encoder_of(path: str) -> PieceEncoder:
    """A worker's encoder, kept over its tasks. Tasks are the unit of parallel work, so the library gets one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PieceEncoder(path)


class SequenceWriter:
    """Cuts a stream of ids into full sequences and writes them in batches."""

    def __init__(self, out, dtype: np.dtype, length: int):
        self.length, self.dtype = length, dtype
        self.value = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(self.value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = ipc.new_file(out, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids.astype(self.dtype))
        self.held += len(ids)
        size = BATCH * self.length
        if self.held >= size:
            held = np.concatenate(self.waiting)
            for a in range(0, self.held - size + 1, size):
                self._write(held[a : a + size], size)
            rest = held[self.held - self.held % size :]
            self.waiting, self.held = [rest], len(rest)

    def _write(self, ids: np.ndarray, tokens: int) -> None:
        lists = pa.FixedSizeListArray.from_arrays(pa.array(ids), type=self.schema.field("ids").type)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(ids)) < tokens), type=self.schema.field("mask").type)
        self.writer.write_batch(pa.record_batch([lists, mask], schema=self.schema))

    def close(self) -> None:
        if self.held:
            padded = np.zeros(-(-self.held // self.length) * self.length, self.dtype)
            padded[: self.held] = np.concatenate(self.waiting)
            self._write(padded, self.held)
        self.writer.close()


class Shard:
    """Random access to a shard's sequences and documents; memory-mapped where the store is local."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        local = isinstance(fs, pafs.LocalFileSystem)
        self.reader = ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))
        self.length = self.reader.schema.field("ids").type.list_size

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (no copy) and mask of sequence i."""
        batch = self.reader.get_batch(i // BATCH)
        row = i % BATCH
        ids = batch["ids"].flatten().to_numpy()[row * self.length : (row + 1) * self.length]
        return ids, batch["mask"].flatten().slice(row * self.length, self.length).to_numpy(zero_copy_only=False)

    def batches(self) -> Iterator[np.ndarray]:
        """The stream of ids, a batch at a time, without padding."""
        for b in range(self.reader.num_record_batches):
            batch = self.reader.get_batch(b)
            mask = batch["mask"].flatten()
            yield batch["ids"].flatten().to_numpy()[: pc.sum(mask).as_py() or 0]


def write_shards(docs: DataFrame, folder: str, tokenizer: str, order: list[str] | None = None,
                 length: int = SEQUENCE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode (doc_id, text) in ascending doc_id order (or by `order`) into shards under `folder`.

    Returns one row per shard: shard, n_docs, n_tokens.
    """
    spark = pin(docs.sparkSession)
    order = order or ["doc_id"]
    text_bytes = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(spark.sparkContext.defaultParallelism, -(-text_bytes // shard_bytes))
    dealt = (
        docs.select("doc_id", "text", *[c for c in order if c != "doc_id"], F.xxhash64("text").alias("_tie"))
        .repartitionByRange(int(n), *order, "_tie").sortWithinPartitions(*order, "_tie").select("doc_id", "text")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        shard = TaskContext.get().partitionId()
        fs, base = open_place(folder)
        fs.create_dir(base, recursive=True)
        encoder = encoder_of(tokenizer)
        dtype = np.dtype(np.uint16 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        ids_of, sizes = [], []

        def write(out) -> None:
            writer = SequenceWriter(out, dtype, length)
            for batch in (b for whole in chain([first], batches) for b in slices(whole, size=4_000_000)):
                ids, counts = encoder.encode(batch["text"])
                writer.add(ids)
                ids_of.append(batch["doc_id"])
                sizes.append(counts)
            writer.close()

        publish(fs, f"{base}/shard-{shard:06d}.arrow", write)
        counts = np.concatenate(sizes)
        index = pa.record_batch({
            "doc_id": pa.concat_arrays(ids_of), "start": np.cumsum(counts) - counts, "n_tokens": counts,
        })
        publish(fs, f"{base}/shard-{shard:06d}.docs.arrow", lambda out: _write_index(out, index))
        yield pa.record_batch({"shard": [shard], "n_docs": [len(counts)], "n_tokens": [int(counts.sum())]})

    return written(dealt.mapInArrow(encode, "shard long, n_docs long, n_tokens long"), "shards")


def _write_index(out, index: pa.RecordBatch) -> None:
    with ipc.new_file(out, index.schema) as writer:
        writer.write_batch(index)


def read_documents(shards: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start over all shards, n_tokens, ids_crc32."""
    spark = shards.sparkSession
    rows = sorted(shards.collect(), key=lambda r: r["shard"])  # one row per shard
    starts, before = [], 0
    for r in rows:
        starts.append((r["shard"], before))
        before += r["n_tokens"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not starts:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_place(folder)
        for batch in batches:
            for shard, start in zip(batch["shard"].to_pylist(), batch["start"].to_pylist(), strict=True):
                name = f"{base}/shard-{shard:06d}"
                with fs.open_input_file(f"{name}.docs.arrow") as f:
                    index = ipc.open_file(f).read_all()
                sizes = index["n_tokens"].to_numpy()
                crcs = np.fromiter(_checksums(Shard(fs, f"{name}.arrow"), sizes), np.int64, len(sizes))
                yield pa.record_batch({
                    "doc_id": index["doc_id"].combine_chunks(), "start": index["start"].to_numpy() + start,
                    "n_tokens": sizes, "ids_crc32": crcs,
                })

    given = spark.createDataFrame(starts, "shard long, start long").repartition(len(starts), "shard")
    return given.mapInArrow(read, schema)


def _checksums(shard: Shard, sizes: np.ndarray) -> Iterator[int]:
    """Checksum of each document's ids, over batches that documents may cross."""
    batches = shard.batches()
    held = np.zeros(0, "<u4")
    for n in sizes.tolist():
        crc = 0
        while n > len(held):
            crc = zlib.crc32(held.tobytes(), crc)
            n -= len(held)
            held = next(batches).astype("<u4")
        crc = zlib.crc32(held[:n].tobytes(), crc)
        held = held[n:]
        yield crc


def tokenise(docs: DataFrame, tokenizer: str, order: list[str] | None = None) -> DataFrame:
    """Write the documents' token files to a new folder and report what they hold."""
    folder = scratch_dir(docs.sparkSession, "tokens")
    return read_documents(write_shards(docs, folder, tokenizer, order), folder)
