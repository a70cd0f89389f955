"""Toxicity by non-negative positive-unlabelled learning, on confirmed toxic examples and all other text.

The classifiers see which words and beginnings of words a text has, once or at least twice, each divided
by the root of how many it has; the most telling ones are those whose share among the confirmed examples
differs most from their share among all documents. They are logistic, and minimise the class-prior-corrected risk

    prior * E_toxic[loss(z, 1)] + (E_all[loss(z, 0)] - prior * E_toxic[loss(z, 0)])

by Newton steps, whose sums over all documents are added up on the executors, documents with equal
features taken together. The part in brackets is the risk on clean text, which cannot be negative: a
point where its estimate is below zero, for the toxic examples being learnt by heart, is not accepted, and
the step there is taken back by halves. There are `CLASSIFIERS` of them, each trained without another
share of the examples; on that share its scores are calibrated to probabilities, by the same risk over a
slope and a shift. A document's score is the mean of the probabilities.

The examples are the `EXAMPLES` confirmed toxic labels with the least hash of their id, one document of
an id each. Unlabelled text is all documents. The prior is the share of toxic ones among all labels that
may be learnt from, or given.

Rules: a null or empty text has no words and gets the base score; of labels that repeat a doc_id each
counts; null labels and ids without a document count for nothing; without toxic examples all scores are 0,
with toxic labels alone all are 1; rows that repeat are scored alike; further columns are ignored; no
documents give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import pin, written
from .word_ids import Ids, blocks, byte_map, summed, texts

EXAMPLES = 6000
CLASSIFIERS = 3
THRESHOLD = 0.3
# Beginnings of words, in bytes.
BEGINNINGS = (4, 5, 6, 7, 8)
# Features looked at in all documents, by their share among the examples, and those the classifiers see.
LOOKED_AT = 20_000
TELLING = 128
# A feature must be in so many examples, and in this share of them.
LEAST, LEAST_SHARE = 4, 0.004
RIDGE = 0.3
# Steps of the training and of the calibration, and the change of a coefficient at which they end.
STEPS, CALIBRATION_STEPS = 20, 12
STILL = 0.01
# So many tasks' sums are added up in one place, and so on in as many levels as it takes.
FAN_IN = 16
PARTS = "part int, sums binary"
# Bytes of text that a task takes at once.
SLICE_BYTES = 8_000_000

_MAP = byte_map(bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)))


def features(word: bytes) -> list[bytes]:
    """The word itself, marked by an end, and its beginnings."""
    return [word + b" ", *(word[:n] for n in BEGINNINGS if n <= len(word))]


class Marks:
    """Which of the given features texts have, once or at least twice: number 2 * feature, and 2 * feature + 1."""

    def __init__(self, known: list[bytes] | None = None):
        """With no features given, every feature met is one."""
        self.features = Ids() if known is None else None
        self.known = {f: i for i, f in enumerate(known or [])}

    def _of_words(self, words: Ids) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of each word's features, and how many each has."""
        if self.features is not None:
            lists = [self.features.numbers(features(w)).tolist() if w else [] for w in words.of]
        else:
            get = self.known.get
            lists = [[i for i in map(get, features(w)) if i is not None] if w else [] for w in words.of]
        n = np.array([len(x) for x in lists], np.int64)
        return np.array([i for x in lists for i in x], np.int64), n

    def __call__(self, given: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, mark) of all texts, in order."""
        words, parts, texts_ = Ids((b"",)), [], []
        for i, raw in enumerate(given):
            for block in blocks(raw.translate(_MAP)):
                numbers = words.numbers(block)
                parts.append(numbers[numbers > 0])
                texts_.append(np.full(len(parts[-1]), i))
        word = np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
        text = np.concatenate([np.zeros(0, np.int64), *texts_]).astype(np.int64)
        pairs, times = summed((text << 32) | word, np.ones(len(word), np.int64))
        of, n = self._of_words(words)
        starts = np.cumsum(n) - n
        text, word = pairs >> 32, pairs & 0xFFFFFFFF
        many = n[word]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[word], many)
        pairs, times = summed((np.repeat(text, many) << 32) | of[at] if len(at) else np.zeros(0, np.int64), np.repeat(times, many))
        text, feature = pairs >> 32, pairs & 0xFFFFFFFF
        twice = times >= 2
        text, mark = np.append(text, text[twice]), np.append(2 * feature, 2 * feature[twice] + 1)
        order = np.lexsort((mark, text))
        return text[order], mark[order]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches of about SLICE_BYTES of text."""
    for batch in batches:
        given = texts(batch)
        part = np.cumsum([len(t) for t in given]) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(given)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a), given[a:b]


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are not learnt from; a null id is not one."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def examples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The confirmed toxic documents that are learnt from: (doc_id, text), written."""
    spark = docs.sparkSession
    toxic = labels.filter("toxic = 1 and doc_id is not null").select("doc_id").distinct()
    ids = toxic.orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES).collect()
    ids = F.broadcast(spark.createDataFrame([tuple(r) for r in ids], "doc_id long"))  # at most EXAMPLES
    mine = docs.select("doc_id", "text").join(ids, "doc_id")
    least = mine.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("least"))
    rows = mine.join(F.broadcast(least), "doc_id").filter(F.xxhash64("text") == F.col("least"))
    return written(rows.dropDuplicates(["doc_id"]).select("doc_id", "text"), "examples")


def _looked_at(found: DataFrame, n: int) -> list[bytes]:
    """The features that enough examples have, most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, given in _slices(batches):
            marks = Marks()
            _, mark = marks(given)
            of, times = summed(mark, np.ones(len(mark), np.int64))
            once = of % 2 == 0
            yield pa.record_batch({
                "feature": pa.array(marks.features.of, pa.binary()).take(pa.array(of[once] // 2)), "n": pa.array(times[once]),
            })

    counts = found.mapInArrow(run, "feature binary, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    rows = counts.filter(F.col("n") >= max(LEAST, LEAST_SHARE * n)).orderBy(F.desc("n"), "feature").limit(LOOKED_AT).collect()
    return [bytes(r.feature) for r in rows]


def _shares(rows: DataFrame, known: list[bytes]) -> np.ndarray:
    """How many of the rows have each mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, total = Marks(known), np.zeros(2 * len(known), np.int64)
        for _, given in _slices(batches):
            total += np.bincount(marks(given)[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch({"mark": pa.array(at), "n": pa.array(total[at])})

    out = np.zeros(2 * len(known))
    for mark, n in rows.select("text").mapInArrow(run, "mark long, n long").groupBy("mark").agg(F.sum("n")).collect():  # 2 * LOOKED_AT
        out[mark] = n
    return out


def telling(toxic: np.ndarray, everywhere: np.ndarray, n_toxic: int, n: int) -> np.ndarray:
    """The marks whose share differs most, by chi-square; of marks with equal counts the first."""
    p, q = toxic / n_toxic, everywhere / n
    chi = np.where(toxic >= LEAST, (p - q) ** 2 / np.maximum(q * (1 - q), 1 / n), 0)
    _, first = np.unique(np.stack([toxic, everywhere]), axis=1, return_index=True)
    chosen = first[np.argsort(-chi[first], kind="stable")]
    return np.sort(chosen[chi[chosen] > 0][:TELLING])


def _packed(marks: Marks, column: np.ndarray, width: int, given: list[bytes]) -> list[bytes]:
    """The chosen marks of each text as bits."""
    text, mark = marks(given)
    use = column[mark] >= 0
    bits = np.zeros((len(given), width), bool)
    bits[text[use], column[mark[use]]] = True
    return [row.tobytes() for row in np.packbits(bits, axis=1)]


def _unpacked(packed: list[bytes], width: int) -> np.ndarray:
    """The features of each text, and a last one of 1."""
    raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
    bits = np.unpackbits(raw, axis=1)[:, :width] if width else np.zeros((len(packed), 0))
    return np.hstack([bits / np.sqrt(1 + bits.sum(1, keepdims=True, dtype=float)), np.ones((len(packed), 1))])


def _p(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _loss(z: np.ndarray) -> np.ndarray:
    """Logistic loss of a margin for the class of clean text; for toxic text it is that of -z."""
    return np.logaddexp(0, z)


def sums(x: np.ndarray, weight: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Over weighted rows, in one array: the loss as clean text, its gradient, and the upper half of its Hessian."""
    z = x @ beta
    p = _p(z)
    hessian = (x * (weight * np.maximum(p * (1 - p), 1e-7))[:, None]).T @ x
    return np.concatenate([[weight @ _loss(z)], x.T @ (weight * p), hessian[np.triu_indices(len(beta))]])


def n_sums(k: int) -> int:
    """The length of `sums` for k coefficients."""
    return 1 + k + k * (k + 1) // 2


def clean_risk(added: np.ndarray, n: int, x: np.ndarray, beta: np.ndarray, prior: float) -> float:
    """The corrected risk on clean text: that of all documents less the toxic share of it."""
    return added[0] / n - prior * _loss(x @ beta).mean()


def newton(added: np.ndarray, n: int, x: np.ndarray, beta: np.ndarray, prior: float, penalty: np.ndarray) -> np.ndarray:
    """The step of the whole risk; as loss(z, 1) - loss(z, 0) is -z, it is convex, and the examples add their mean."""
    k = len(beta)
    hessian = np.zeros((k, k))
    hessian[np.triu_indices(k)] = added[1 + k :]
    hessian += np.triu(hessian, 1).T
    gradient = added[1 : 1 + k] / n - prior * x.mean(0) + penalty * beta
    return np.linalg.solve(hessian / n + np.diag(penalty), -gradient)


def all_sums(pool: DataFrame, width: int, points: list[np.ndarray], margins: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """`sums` over all documents at each point; with `margins`, of the margins by these coefficients and 1 in place of the features."""
    sizes = [n_sums(len(b)) for b in points]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(size) for size in sizes]
        for batch in batches:
            x = _unpacked(batch["x"].to_pylist(), width)
            weight = batch["n"].to_numpy(zero_copy_only=False).astype(float)
            for i, (own, beta) in enumerate(zip(total, points, strict=True)):
                own += sums(x if margins is None else _margins(x, margins[i]), weight, beta)
        part = TaskContext.get().partitionId()
        yield pa.record_batch({"part": pa.array([part], pa.int32()), "sums": pa.array([np.concatenate(total).tobytes()])})

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        return pa.table({"part": pa.array([table["part"][0].as_py() // FAN_IN], pa.int32()), "sums": pa.array([_added(table["sums"].to_pylist(), sizes).tobytes()])})

    rows, n_parts = pool.mapInArrow(run, PARTS), pool.rdd.getNumPartitions()
    while n_parts > FAN_IN:
        rows, n_parts = rows.groupBy((F.col("part") / FAN_IN).cast("int")).applyInArrow(add, PARTS), -(-n_parts // FAN_IN)
    added = _added([r.sums for r in sorted(rows.collect())], sizes)  # at most FAN_IN
    return np.split(added, np.cumsum(sizes)[:-1])


def _added(rows: list[bytes], sizes: list[int]) -> np.ndarray:
    total = np.zeros(sum(sizes))
    for raw in rows:
        total += np.frombuffer(raw, np.float64)
    return total


def _margins(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return np.stack([x @ beta, np.ones(len(x))], 1)


def descend(sums_at: Callable, n: int, examples_: list[np.ndarray], starts: list[np.ndarray], penalties: list[np.ndarray],
            prior: float, steps: int) -> list[np.ndarray]:
    """The last accepted point of each classifier; `sums_at` gives the sums over all documents of some at their points."""
    points, accepted = list(starts), list(starts)
    moving = list(range(len(points)))
    for _ in range(steps):
        for c, added in zip(list(moving), sums_at(moving, [points[c] for c in moving]), strict=True):
            x, at = examples_[c], points[c]
            if clean_risk(added, n, x, at, prior) >= 0:
                accepted[c] = at
                step = newton(added, n, x, at, prior, penalties[c])
            else:
                step = (accepted[c] - at) / 2
            points[c] = at + step
            if np.abs(step).max() < STILL:
                moving.remove(c)
        if not moving:
            break
    return accepted


def fit(pool: DataFrame, n: int, examples_: list[np.ndarray], prior: float) -> list[np.ndarray]:
    """One classifier on each array of examples: coefficients of the features, and last the intercept."""
    width = examples_[0].shape[1] - 1
    penalties = [np.append(np.full(width, RIDGE * prior / len(x)), 1e-9) for x in examples_]
    starts = [np.append(np.zeros(width), np.log(prior / (1 - prior)))] * len(examples_)
    return descend(lambda _, points: all_sums(pool, width, points), n, examples_, starts, penalties, prior, STEPS)


def calibrate(pool: DataFrame, n: int, betas: list[np.ndarray], left_out: list[np.ndarray], prior: float) -> list[np.ndarray]:
    """Slope and shift of each classifier's margins; a classifier whose slope is not above zero keeps its own."""
    width, own = len(betas[0]) - 1, np.array([1.0, 0.0])
    margins = [_margins(x, b) for x, b in zip(left_out, betas, strict=True)]
    lines = descend(
        lambda which, points: all_sums(pool, width, points, [betas[c] for c in which]),
        n, margins, [own] * len(betas), [np.full(2, 1e-6)] * len(betas), prior, CALIBRATION_STEPS,
    )
    return [line if line[0] > 0 else own for line in lines]


def probabilities(betas: list[np.ndarray], lines: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """The classifiers' mean probability."""
    return np.mean([_p(_margins(x, b) @ line) for b, line in zip(betas, lines, strict=True)], axis=0)


def score(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """Per document: doc_id, held_out, score (probability to be toxic), predicted (score of THRESHOLD or more)."""
    pin(docs.sparkSession)
    mine = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(~held_out() & F.col("toxic").isNotNull())
    share = mine.agg(F.avg("toxic")).first()[0] or 0.0
    prior = share if prior is None else prior
    found = examples(docs, mine)
    n, n_toxic = docs.count(), found.count()
    constant = (1.0 if share == 1 else 0.0) if n_toxic == 0 or prior in (0.0, 1.0) else None
    out = ["doc_id", held_out().alias("held_out")]
    if constant is not None:
        scored = docs.select(*out, F.lit(constant).alias("score"))
        return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

    known = _looked_at(found, n_toxic)
    chosen = telling(_shares(found, known), _shares(docs, known), n_toxic, n)
    width = len(chosen)
    names = sorted({int(m) // 2 for m in chosen})
    place = {m: i for i, m in enumerate(names)}
    # Only the chosen features are looked up from here on.
    kept = [known[m] for m in names]
    column = np.full(2 * len(kept), -1)
    for i, m in enumerate(chosen):
        column[2 * place[int(m) // 2] + int(m) % 2] = i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(kept)
        for batch, given in _slices(batches):
            yield pa.record_batch({"doc_id": batch["doc_id"], "x": pa.array(_packed(marks, column, width, given), pa.binary())})

    marked = written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x binary"), "marks")
    pool = written(marked.groupBy("x").agg(F.count("*").alias("n")), "pool")
    rows = found.mapInArrow(run, "doc_id long, x binary").orderBy("doc_id").collect()  # at most EXAMPLES, TELLING bits each
    x = _unpacked([bytes(r.x) for r in rows], width)
    fold = np.arange(len(rows)) % CLASSIFIERS
    folds = [fold == c if len(set(fold)) == CLASSIFIERS else np.zeros(len(rows), bool) for c in range(CLASSIFIERS)]
    betas = fit(pool, n, [x[~f] for f in folds], prior)
    lines = calibrate(pool, n, betas, [x[f] if f.any() else x for f in folds], prior)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"doc_id": batch["doc_id"], "score": pa.array(probabilities(betas, lines, _unpacked(batch["x"].to_pylist(), width)))})

    scored = marked.mapInArrow(apply, "doc_id long, score double")
    return scored.select(*out, "score").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
