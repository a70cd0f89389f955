"""Quality and toxicity by co-training a text view and a page-metadata view.

The text view sees which words a document has (hashed; the most telling ones are chosen from the
labelled sample) and what its bytes look like; the metadata view sees source, language and length.
Both are ridge logistic regressions. In each round each view labels the unlabelled documents it is
sure of, and these join the other view's training rows at half weight. At the end a logistic
regression on a held-out part of the labels turns both views' scores into one calibrated probability.

The labelled sample is bounded: the `LABELLED` labels with the least hash of their id. All documents
without a label of a target take part in its rounds: their features are written once, and every Newton
step adds up their gradients and Hessians on the executors. All documents are scored.

Rules: a null or empty text has no words and zero byte shares; null metadata is a value of its own;
of labels that repeat a doc_id each counts, and of its documents one; null labels count for nothing; without both classes among
the labels a target's probability is their share (0 without labels); further columns are ignored; no
documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import pin, small, written
from .words import mix, slices, words_of

LABELLED = 6000
ROUNDS = 3
# Newton steps at most, and the change at which they end.
STEPS = 12
STILL = 1e-5
SURE = 0.99
# Partial sums of a Newton step that come to the driver.
PACKS = 32
TELLING = 80
BUCKETS = 1 << 18
SOURCES = 64
LANGS = 16

# Letters in lower case, all other ASCII as white space, other bytes as they are.
_FOLD = bytes((b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32) for b in range(256))
_CLASSES = np.zeros(256, np.int64)
_CLASSES[65:91], _CLASSES[97:123], _CLASSES[48:58] = 1, 2, 3
_CLASSES[[ord(c) for c in " \t\r\n.,;:'\"()-?"]] = 4
_CLASSES[10] = 5
_CLASSES[128:] = 6
N_SHAPE = 12


def shapes(texts: list[str | None], counts: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Shares of byte classes and a few ratios, one row per text."""
    out = np.zeros((len(texts), N_SHAPE))
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode("utf-8", "surrogatepass")
        share = np.bincount(_CLASSES[np.frombuffer(raw, np.uint8)], minlength=7) / len(raw)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        out[i] = [*share, np.log1p(counts[i]) / 10, distinct[i] / max(counts[i], 1), len(set(lines)) / max(len(lines), 1),
                  share[1] / max(share[1] + share[2], 1e-9), min(len(raw) / max(counts[i], 1) / 10, 3)]
    return out


def text_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed words as (text, bucket) in order of text, and the shapes."""
    words = words_of(texts, table=_FOLD)
    counts = np.diff(words.offsets)
    text = np.repeat(np.arange(len(texts)), counts)
    pairs = np.unique(text * BUCKETS + (words.hashes % np.uint64(BUCKETS)).astype(np.int64))
    text, bucket = pairs // BUCKETS, pairs % BUCKETS
    return text, bucket, shapes(texts, counts, np.bincount(text, minlength=len(texts)))


def metadata_features(batch: pa.RecordBatch) -> np.ndarray:
    """Hashed source and language, and the length."""
    n = batch.num_rows
    out = np.zeros((n, SOURCES + LANGS + 2))
    for column, width, at in (("source", SOURCES, 0), ("lang", LANGS, SOURCES)):
        hashed = words_of([None if v is None else "x" + "".join(str(v).split()) for v in batch[column].to_pylist()])
        place = np.zeros(n, np.int64)
        full = np.diff(hashed.offsets) > 0
        place[full] = (hashed.hashes % np.uint64(width)).astype(np.int64)
        out[np.arange(n), at + place] = 1
    chars = np.array([-1 if c is None else max(float(c), 0) for c in batch["n_chars"].to_pylist()])
    out[:, -2], out[:, -1] = np.log1p(np.maximum(chars, 0)) / 10, chars < 0
    return out


def sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Hessian and, as its last row, gradient of weighted rows at `beta`, without the penalty."""
    x = np.hstack([x, np.ones((len(x), 1))])
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
    return np.vstack([(x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x, x.T @ (weight * (y - p))])


def newton(added: np.ndarray, beta: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """The step of a ridge logistic regression from all rows' sums."""
    penalty = np.full(len(beta), ridge)
    penalty[-1] = 1e-6
    return np.linalg.solve(added[:-1] + np.diag(penalty), added[-1] - penalty * beta)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the intercept."""
    beta = np.zeros(x.shape[1] + 1)
    for _ in range(STEPS):
        step = newton(sums(x, y, weight, beta), beta, ridge)
        beta += step
        if np.abs(step).max() < STILL:
            break
    return beta


def margin(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return np.clip(x @ beta[:-1] + beta[-1], -30, 30)


def _p(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


@dataclass
class Model:
    """One target: chosen word buckets, both views' coefficients and how they are combined."""

    chosen: np.ndarray
    text: np.ndarray
    metadata: np.ndarray
    combine: np.ndarray
    constant: float | None = None

    def words(self, text: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        """Sum of the coefficients of each text's chosen words."""
        weights = np.zeros(BUCKETS)
        weights[self.chosen] = self.text[N_SHAPE:-1]
        return np.bincount(text, weights[bucket], n)

    def views(self, text, bucket, shape, meta) -> tuple[np.ndarray, np.ndarray]:
        a = shape @ self.text[:N_SHAPE] + self.words(text, bucket, len(shape)) + self.text[-1]
        return np.clip(a, -30, 30), margin(meta, self.metadata)

    def probability(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(a), self.constant)
        return _p(margin(np.stack([a, b], 1), self.combine))


def telling_words(text: np.ndarray, bucket: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The buckets whose presence differs most between the classes, by chi-square."""
    inside = np.bincount(bucket, minlength=BUCKETS).astype(float)
    hit = np.bincount(bucket, y[text], BUCKETS)
    n, share = len(y), y.mean()
    expected = inside * share
    spread = np.maximum(expected * (1 - share) * (1 - inside / n), 1e-9)
    chi = np.where(inside >= 5, (hit - expected) ** 2 / spread, 0)
    return np.sort(np.argsort(-chi, kind="stable")[:TELLING])


@dataclass
class Seed:
    """One target's labelled sample: chosen word buckets, both views' features, classes, rows to train on and held out."""

    chosen: np.ndarray
    views: list[np.ndarray]
    y: np.ndarray
    train: np.ndarray
    held: np.ndarray


def seed(rows: pd.DataFrame, target: str) -> Seed | Model:
    """From the sample's columns words (arrays), shape, meta and the target (NaN: unlabelled); a constant without both classes."""
    rows = rows[rows[target].notna()].reset_index(drop=True)
    y = rows[target].to_numpy(float)
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(0, np.int64), np.zeros(N_SHAPE + 1), np.zeros(SOURCES + LANGS + 3), np.zeros(3), constant=share)
    size = rows.words.map(len).to_numpy()
    text = np.repeat(np.arange(len(rows)), size)
    bucket = np.concatenate([*rows.words, np.zeros(0, np.int64)]).astype(np.int64)
    shape, meta = np.stack(rows["shape"].to_list()), np.stack(rows["meta"].to_list())
    held = np.arange(len(rows)) % 5 == 0
    train = ~held
    if min(np.bincount(y[train].astype(int), minlength=2).min(), np.bincount(y[held].astype(int), minlength=2).min()) == 0:
        held = train = np.ones(len(rows), bool)
    of_train = np.cumsum(train) - 1
    use = train[text]
    chosen = telling_words(of_train[text[use]], bucket[use], y[train])
    return Seed(chosen, [np.hstack([shape, presence(text, bucket, chosen, len(rows))]), meta], y, train, held)


def presence(text: np.ndarray, bucket: np.ndarray, chosen: np.ndarray, n: int) -> np.ndarray:
    """Which of the chosen buckets each text has, as 0 and 1."""
    column = np.full(BUCKETS, -1)
    column[chosen] = np.arange(len(chosen))
    out = np.zeros((n, len(chosen)))
    inside = column[bucket] >= 0
    out[text[inside], column[bucket[inside]]] = 1
    return out


def pseudo(views: list[np.ndarray], history: list[list[np.ndarray]], v: int) -> np.ndarray:
    """Labels that view v has from the other view: of the first round in which that was sure (NaN: none)."""
    label = np.full(len(views[0]), np.nan)
    for betas in history:
        p = _p(margin(views[1 - v], betas[1 - v]))
        label = np.where(~np.isnan(label), label, np.where(p >= SURE, 1.0, np.where(1 - p >= SURE, 0.0, np.nan)))
    return label


def _pool(docs: DataFrame, labels: DataFrame, seeds: dict[str, Seed]) -> DataFrame:
    """Features x of all documents without a label of some target, and free_<target>."""
    has = labels.filter("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.col(t).isNotNull()).alias(f"has_{t}") for t in seeds])
    has = written(has, "labelled")
    # Tasks get the chosen words alone, not the sample's features.
    chosen = {t: s.chosen for t, s in seeds.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in slices(whole)):
            text, bucket, shape = text_features(batch["text"].to_pylist())
            meta = metadata_features(batch)
            places = np.stack([meta[:, :SOURCES].argmax(1), meta[:, SOURCES:-2].argmax(1)], 1).astype(np.uint8)
            bits = [np.packbits(presence(text, bucket, c, batch.num_rows).astype(bool), axis=1) for c in chosen.values()]
            numbers = np.ascontiguousarray(np.hstack([shape, meta[:, -2:]]))
            x = np.hstack([numbers.view(np.uint8).reshape(batch.num_rows, -1), places, *bits])
            yield pa.record_batch({"doc_id": batch["doc_id"], "x": pa.array([r.tobytes() for r in x], pa.binary())})

    rows = docs.select("doc_id", "text", "source", "lang", "n_chars").mapInArrow(run, "doc_id long, x binary")
    rows = rows.join(small(has, has.count()), "doc_id", "left")
    free = {f"free_{t}": ~F.coalesce(f"has_{t}", F.lit(False)) for t in seeds}
    rows = rows.select("x", *[c.alias(name) for name, c in free.items()])
    return written(rows.filter(" or ".join(free)), "unlabelled")


def unpacked(column: pa.Array, chosen: dict[str, int]) -> dict[str, list[np.ndarray]]:
    """Both views of each target from the pool's x and the number of words chosen for it."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    at = 8 * (N_SHAPE + 2)
    numbers = np.ascontiguousarray(raw[:, :at]).view(np.float64)
    meta = np.zeros((len(raw), SOURCES + LANGS + 2))
    meta[np.arange(len(raw)), raw[:, at]] = 1
    meta[np.arange(len(raw)), SOURCES + raw[:, at + 1].astype(int)] = 1
    meta[:, -2:] = numbers[:, N_SHAPE:]
    at += 2
    out = {}
    for target, n in chosen.items():
        width = -(-n // 8)
        out[target] = [np.hstack([numbers[:, :N_SHAPE], np.unpackbits(raw[:, at : at + width], axis=1)[:, :n]]), meta]
        at += width
    return out


def pool_sums(pool: DataFrame, seeds: dict[str, Seed], history: dict[str, list], betas: dict[tuple[str, int], np.ndarray]) -> dict:
    """For each target and view of `betas`, the sums of all pseudo-labelled documents at half weight."""
    sizes = [(len(b) + 1) * len(b) for b in betas.values()]
    # The sample's features stay on the driver: a closure is sent anew for every step.
    chosen = {t: len(s.chosen) for t, s in seeds.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b) + 1, len(b))) for b in betas.values()]
        for batch in batches:
            views = unpacked(batch["x"], chosen)
            for (target, v), beta, own in zip(betas, betas.values(), total, strict=True):
                label = pseudo(views[target], history[target], v)
                has = ~np.isnan(label) & batch[f"free_{target}"].to_numpy(zero_copy_only=False)
                if has.any():
                    own += sums(views[target][v][has], label[has], np.full(has.sum(), 0.5), beta)
        part = TaskContext.get().partitionId()
        flat = np.concatenate([t.ravel() for t in total])
        yield pa.record_batch({"pack": pa.array([part % PACKS], pa.int32()), "part": pa.array([part], pa.int32()), "sums": pa.array([flat.tobytes()])})

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        flat = np.zeros(sum(sizes))
        for raw in table["sums"]:
            flat += np.frombuffer(raw.as_buffer(), np.float64)
        return pa.table({"pack": table["pack"][:1], "sums": pa.array([flat.tobytes()])})

    parts = pool.mapInArrow(run, "pack int, part int, sums binary")
    rows = sorted(parts.groupBy("pack").applyInArrow(add, "pack int, sums binary").collect())  # at most PACKS
    flat = np.sum([np.frombuffer(r.sums, np.float64) for r in rows], axis=0) if rows else np.zeros(sum(sizes))
    cuts = np.split(flat, np.cumsum(sizes)[:-1])
    return {at: c.reshape(-1, len(b)) for (at, b), c in zip(betas.items(), cuts, strict=True)}


def cotrain(seeds: dict[str, Seed], pool: DataFrame) -> dict[str, Model]:
    """Fit all targets: in each round both views on the seed and on what the other view is sure of in the whole pool."""
    history: dict[str, list] = {t: [[fit(x[s.train], s.y[s.train], np.ones(s.train.sum())) for x in s.views]] for t, s in seeds.items()}
    for _ in range(0 if pool.isEmpty() else ROUNDS):
        betas = {(t, v): b.copy() for t in seeds for v, b in enumerate(history[t][-1])}
        moving = dict(betas)
        for _ in range(STEPS):
            added = pool_sums(pool, seeds, history, moving)
            for t, v in list(moving):
                s = seeds[t]
                own = sums(s.views[v][s.train], s.y[s.train], np.ones(s.train.sum()), betas[t, v])
                step = newton(own + added[t, v], betas[t, v])
                betas[t, v] += step
                if np.abs(step).max() < STILL:
                    del moving[t, v]
            if not moving:
                break
        for t in seeds:
            history[t].append([betas[t, 0], betas[t, 1]])
    models = {}
    for t, s in seeds.items():
        last = history[t][-1]
        margins = [margin(x[s.held], b) for x, b in zip(s.views, last, strict=True)]
        models[t] = Model(s.chosen, *last, combined(margins, s.y[s.held]))
    return models


def combined(margins: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Each view calibrated by itself, then their evidence added: slopes, and an intercept.

    A view that does not help on the held-out labels gets no say.
    """
    prior = np.log(y.mean() / (1 - y.mean()))
    slopes, intercept = [], prior
    for m in margins:
        slope, shift = fit(m[:, None], y, np.ones(len(y)), ridge=1e-2)
        p = np.clip(_p(slope * m + shift), 1e-6, 1 - 1e-6)
        gain = np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) - (y.mean() * np.log(y.mean()) + (1 - y.mean()) * np.log(1 - y.mean()))
        if slope <= 0 or gain <= 2 / len(y):
            slope, shift = 0.0, prior
        slopes.append(slope)
        intercept += shift - prior
    return np.array([*slopes, intercept])


def _sample(docs: DataFrame, labels: DataFrame, targets: list[str]) -> pd.DataFrame:
    """Features of the bounded labelled sample, brought to the driver."""
    by = [F.xxhash64("doc_id"), F.col("doc_id")]
    given = labels.filter("doc_id is not null").orderBy(*by, *targets).limit(LABELLED).select("doc_id", *targets).toPandas()
    ids = docs.sparkSession.createDataFrame([(int(d),) for d in given.doc_id.unique()], "doc_id long")  # at most LABELLED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in slices(whole)):
            text, bucket, shape = text_features(batch["text"].to_pylist())
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.record_batch({
                "doc_id": batch["doc_id"],
                "words": pa.ListArray.from_arrays(cuts, pa.array(bucket.astype(np.int32))),
                "shape": pa.array(list(shape), pa.list_(pa.float64())),
                "meta": pa.array(list(metadata_features(batch)), pa.list_(pa.float64())),
            })

    # Of rows that repeat a doc_id, one: that with the least hash of what the views see.
    mine = docs.select("doc_id", "text", "source", "lang", "n_chars").join(F.broadcast(ids), "doc_id")
    own = F.xxhash64("text", "source", "lang", "n_chars")
    least = mine.groupBy("doc_id").agg(F.min(own).alias("least"))
    rows = mine.join(F.broadcast(least), "doc_id").filter(own == F.col("least")).drop("least").mapInArrow(
        run, "doc_id long, words array<int>, shape array<double>, meta array<double>"
    ).dropDuplicates(["doc_id"]).toPandas().merge(given, on="doc_id")
    order = mix(rows.doc_id.to_numpy(np.int64).view(np.uint64))
    return rows.iloc[np.lexsort((*[rows[t].fillna(-1) for t in targets], rows.doc_id, order))].reset_index(drop=True)


class Scorer:
    """Probabilities and margins of the rows of a batch."""

    def __init__(self, models: dict[str, Model]):
        self.models = models

    def __call__(self, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        text, bucket, shape = text_features(batch["text"].to_pylist())
        meta = metadata_features(batch)
        out = {}
        for name, model in self.models.items():
            a, b = model.views(text, bucket, shape, meta)
            out |= {f"p_{name}": model.probability(a, b), f"text_{name}": a, f"metadata_{name}": b}
        return out


def train(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...] = ("quality", "toxic")) -> Scorer:
    """Fit every target on the labelled sample and all other documents."""
    pin(docs.sparkSession)
    labels = labels.select("doc_id", *[F.col(t).cast("int") for t in targets])
    sample = _sample(docs, labels, list(targets))
    found = {t: seed(sample, t) for t in targets}
    seeds = {t: s for t, s in found.items() if isinstance(s, Seed)}
    return Scorer(found | (cotrain(seeds, _pool(docs, labels, seeds)) if seeds else {}))


def score(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...] = ("quality", "toxic")) -> DataFrame:
    """Per document, for each target, the calibrated probability p_<target> and both views' margins."""
    scorer = train(docs, labels, targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in slices(whole)):
            yield pa.record_batch({"doc_id": batch["doc_id"], **scorer(batch)})

    fields = ", ".join(f"p_{t} double, text_{t} double, metadata_{t} double" for t in targets)
    return docs.select("doc_id", "text", "source", "lang", "n_chars").mapInArrow(run, f"doc_id long, {fields}")


def accepted(quality, toxic, least_quality: float = 0.5, most_toxic: float = 0.5):
    """Good enough and not toxic; for arrays and for columns."""
    return (quality >= least_quality) & (toxic <= most_toxic)


def keep_accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The accepted documents with all their columns, filtered in one pass without a join."""
    scorer = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in slices(whole)):
            scores = scorer(batch)
            yield batch.filter(pa.array(accepted(scores["p_quality"], scores["p_toxic"])))

    return docs.mapInArrow(run, docs.schema)
