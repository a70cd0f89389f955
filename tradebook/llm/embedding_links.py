"""Near-duplicate embeddings by a neighbour graph that is refined round by round (NN-descent).

Vectors are compared within their label by cosine in double precision. Equal vectors are one node with a
count. A node's list holds its `K` best neighbours so far; the first come from buckets of vectors on
the same sides of a few random planes. In a round every node's neighbours, in both directions, meet
with it and are compared by a matrix product, and what is better than a list's last entry enters it;
rounds go on until few entries change. As many sets of planes are used as it takes for a pair at the
threshold to share a bucket but with probability `MISS`, and buckets of any size are compared whole.

Links are kept beside the lists: of all pairs at or above the threshold that any comparison meets, as
many as connect what they connect. A list that holds nothing but links is saturated and may have missed
further ones, within its component and out of it. So buckets of new planes that hold a node with such a
list are searched for links between components until none is found, and all nodes that links connect
are compared in blocks, which counts every link without ever making rows of them.

Then recall is audited by brute force on up to `AUDITED` nodes of every size of component; while it is
too low in any class of degrees, lists are doubled, new planes are drawn and the rounds go on. Where the
audited nodes have no link, nothing was audited, and new planes have to find nothing either.

Rules: null, zero or non-finite vectors, vectors with a null label and rows with a null vec_id link with
nothing; only vectors of one length are compared; rows with equal vec_id are separate vectors that share
the id; further columns are ignored; no vectors give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import acos, ceil, log, log1p, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import components, pin, written

THRESHOLD = 0.93
K = 10
# Probability that a pair at the threshold shares no bucket of a search.
MISS = 1e-4
# Nodes per bucket of a table, on average, and per block of a component.
NEAR = 12
BLOCK = 256
# Rounds end when fewer than this share of the entries change; audited nodes a stratum, and recall to reach.
STILL = 0.01
AUDITED = 500
RECALL = 0.98
PAIRS = "a long, b long, cos double"


def matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, label, size, v, copies) of the vectors that can link, and (vec_id, row, node)."""
    rows = vectors.select("vec_id", "label", F.col("embedding").alias("v"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & ~F.coalesce(
        F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)
    ) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    rows = written(rows.withColumn("key", F.when(sound, F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("v").cast("array<string>")), 256))), "vectors")
    nodes = rows.filter("key is not null").groupBy("key").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.first("label").alias("label"), F.first("v").alias("v")
    )
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "key", "first", "copies", "label", "v",
                                 F.size("v").alias("size")), "nodes")
    return nodes, rows.select("vec_id", "key")


def tables(bits: int, threshold: float) -> int:
    """Sets of `bits` planes for which a pair at the threshold shares a bucket but with probability MISS."""
    shared = (1 - acos(min(max(threshold, -1.0), 1.0)) / pi) ** bits
    return 1 if shared >= 1 - MISS else ceil(log(MISS) / log1p(-max(shared, 1e-4)))


def _buckets(threshold: float, turn: int):
    """For each table, the sides of random planes that a vector lies on, as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bits = batch["size"].to_numpy(), batch["bits"].to_numpy()
            for size, n_bits in sorted({*zip(sizes.tolist(), bits.tolist(), strict=True)}):
                at = np.flatnonzero((sizes == size) & (bits == n_bits))
                n = tables(n_bits, threshold)
                planes = np.random.default_rng([size, turn]).standard_normal((size, n * n_bits))
                side = (matrix(batch["v"].take(pa.array(at))) @ planes > 0).reshape(len(at), n, n_bits)
                rows = batch.select(["node", "label", "size"]).take(pa.array(np.repeat(at, n)))
                sides = (side * (1 << np.arange(n_bits))).sum(2).astype(np.int64)
                yield pa.record_batch({
                    **{c: rows[c] for c in rows.schema.names}, "nth": np.tile(np.arange(n), len(at)), "sides": sides.ravel(),
                })

    return run


def first_groups(nodes: DataFrame, threshold: float = THRESHOLD, turn: int = 0) -> DataFrame:
    """(grp, sub, node, parts): buckets of about NEAR nodes; larger ones are in parts."""
    counts = written(nodes.groupBy("label", "size").agg(F.count("*").alias("n")), "label-counts")
    bits = F.least(F.greatest(F.ceil(F.log2(F.col("n") / NEAR)), F.lit(0)), F.lit(40)).cast("long")
    given = nodes.join(counts.withColumn("bits", bits), ["label", "size"]).select("node", "label", "size", "bits", "v")
    fields = f"node long, label {nodes.schema['label'].dataType.simpleString()}, size int, nth long, sides long"
    placed = given.mapInArrow(_buckets(threshold, turn), fields).select(F.xxhash64("label", "size", "nth", "sides").alias("grp"), "node")
    placed = written(placed, "buckets")
    sizes = written(placed.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).alias("parts")), "bucket-sizes")
    return placed.join(sizes, "grp").select("grp", F.pmod(F.xxhash64("node", "grp"), F.col("parts")).alias("sub"), "node", "parts")


def _best_of(node: np.ndarray, cos: np.ndarray, each: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows, columns) among each row's best others."""
    np.fill_diagonal(cos, -2.0)
    each = min(each, len(cos) - 1)
    best = np.argpartition(-cos, each - 1, axis=1)[:, :each] if each else np.zeros((len(cos), 0), np.int64)
    a, b = np.repeat(np.arange(len(cos)), each), best.ravel()
    swap = node[a] > node[b]
    return np.where(swap, b, a), np.where(swap, a, b)


def _forest(linked: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs (rows, columns) that connect all that a symmetric matrix connects."""
    seen = ~linked.any(1)
    a, b = [], []
    for root in np.flatnonzero(~seen).tolist():
        front = [] if seen[root] else [root]
        seen[root] = True
        while front:
            at = front.pop()
            new = np.flatnonzero(linked[at] & ~seen).tolist()
            seen[new] = True
            a += [at] * len(new)
            b += new
            front += new
    return a, b


def _meet(each: int, threshold: float):
    """Many small groups in one table: compare within each and give back pairs that connect what links
    connect, and every member's best others. With components given, only links between them count."""

    def run(table: pa.Table) -> pa.Table:
        grp, sub, node = (table[c].to_numpy() for c in ("grp", "sub", "node"))
        order = np.lexsort((node, sub, grp))
        grp, sub, node = grp[order], sub[order], node[order]
        component = table["component"].to_numpy()[order] if "component" in table.schema.names else None
        v = matrix(table["v"].take(pa.array(order)))
        cuts = np.flatnonzero(np.r_[True, (grp[1:] != grp[:-1]) | (sub[1:] != sub[:-1]), True])
        a, b, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if y - x > 1:
                own, cos = node[x:y], v[x:y] @ v[x:y].T
                linked = cos >= threshold
                linked &= own[:, None] != own[None, :] if component is None else component[x:y, None] != component[None, x:y]
                found = [_forest(linked)] if linked.any() else []
                if component is None:
                    found.append(_best_of(own, cos, each))
                for i, j in found:
                    a.append(np.minimum(own[i], own[j]))
                    b.append(np.maximum(own[i], own[j]))
                    c.append(cos[i, j])
        pairs = {"a": np.concatenate(a), "b": np.concatenate(b), "cos": np.concatenate(c)}
        _, first = np.unique(np.stack([pairs["a"], pairs["b"]]), axis=1, return_index=True)
        return pa.table({k: x[first] for k, x in pairs.items()})

    return run


def compare(groups: DataFrame, nodes: DataFrame, packs: int, each: int, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b, cos) from groups (grp, sub, node); vectors of one size at a time."""
    dealt = groups.withColumn("pack", F.pmod(F.xxhash64("grp", "sub"), F.lit(packs)))
    return dealt.join(nodes.select("node", "size", "v"), "node").groupBy("pack", "size").applyInArrow(_meet(each, threshold), PAIRS)


def links_of(pairs: DataFrame, threshold: float) -> DataFrame:
    return pairs.filter(F.col("cos") >= threshold).select("a", "b")


def across(groups: DataFrame, labels: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between components in groups (grp, node) of any size.

    All nodes but those of a group's largest component are compared with all nodes, in pairs of blocks.
    """
    placed = groups.select("grp", "node").join(labels, "node", "left").select(
        "grp", "node", F.coalesce("label", "node").alias("component")
    )
    sizes = placed.groupBy("grp", "component").agg(F.count("*").alias("n")).groupBy("grp").agg(
        F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n")
    )
    sizes = written(sizes.filter("n > main.n").select(
        "grp", F.col("main.component").alias("main"), F.ceil((F.col("n") - F.col("main.n")) / BLOCK).alias("rows"),
        F.ceil(F.col("n") / BLOCK).alias("columns"),
    ), "mixed-buckets")
    left = placed.join(sizes, "grp")
    block = F.xxhash64("node", "grp")
    whole = left.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("column", F.pmod(block, "columns"))
    others = left.filter("component <> main and columns > 1").withColumn("row", F.pmod(block, "rows")).withColumn(
        "column", F.explode(F.sequence(F.lit(0), F.col("columns") - 1))
    )
    fields = ["grp", (F.col("row") * F.col("columns") + F.col("column")).alias("sub"), "node", "component"]
    dealt = written(whole.select(*fields).union(others.select(*fields)), "mixed-blocks")
    return compare(dealt, nodes, dealt.count() // 512 + 1, 0, threshold).select("a", "b")


def search(labels: DataFrame, nodes: DataFrame, threshold: float, turn: int, wanted: DataFrame | None = None) -> DataFrame:
    """Links between components in buckets of new planes, of those that hold a node of `wanted` if given."""
    groups = first_groups(nodes, threshold, turn)
    if wanted is not None:
        groups = groups.join(groups.join(wanted, "node", "left_semi").select("grp").distinct(), "grp")
    return written(across(groups, labels, nodes, threshold), "found-links")


def best_lists(pairs: DataFrame, k: int) -> DataFrame:
    """Lists (node, other, cos, nth) of the k best neighbours known."""
    pairs = pairs.groupBy("a", "b").agg(F.max("cos").alias("cos"))
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "cos").union(pairs.select("b", "a", "cos"))
    rank = Window.partitionBy("node").orderBy(F.col("cos").desc(), "other")
    return ends.withColumn("nth", F.row_number().over(rank)).filter(F.col("nth") <= k)


def as_pairs(lists: DataFrame) -> DataFrame:
    return lists.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "cos")


def descend(lists: DataFrame, nodes: DataFrame, n: int, k: int, threshold: float = THRESHOLD) -> tuple[DataFrame, list[DataFrame]]:
    """Rounds of neighbours meeting neighbours until few entries change; the lists, and links met."""
    links = []
    while True:
        back = Window.partitionBy("other").orderBy(F.col("cos").desc(), "node")
        reverse = lists.withColumn("r", F.row_number().over(back)).filter(F.col("r") <= k)
        groups = (
            lists.select(F.col("node").alias("grp"), F.col("other").alias("node"))
            .union(reverse.select("other", "node")).union(nodes.select("node", "node")).distinct().withColumn("sub", F.lit(0))
        )
        met = written(compare(groups, nodes, max(1, n // 64), max(2, k // 4), threshold), "met")
        links.append(links_of(met, threshold))
        better = written(best_lists(as_pairs(lists).union(met), k), "lists")
        changed = better.join(lists.select("node", "other"), ["node", "other"], "left_anti").count()
        lists = better
        if changed <= STILL * n * k:
            return lists, links


def _counts(threshold: float):
    """Links within the components of a pack, or between two blocks of one: degrees with and without copies."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        node, label, own, copies = (table[c].to_numpy() for c in ("node", "component", "own", "copies"))
        v = matrix(table["v"])
        linked = (v @ v.T >= threshold) & (label[:, None] == label[None, :])
        if key[1].as_py() != key[2].as_py():
            linked &= own[:, None] != own[None, :]
        np.fill_diagonal(linked, False)
        return pa.table({"node": node, "n": (linked @ copies).astype(np.int64), "others": linked.sum(1).astype(np.int64)})

    return run


def degrees(labels: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, n, others): vectors of other nodes of the component that link with a node's, and such nodes."""
    sizes = written(labels.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "component-sizes")
    packs = labels.count() // BLOCK + 1
    placed = labels.join(sizes, "label").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    pack = F.when(F.col("blocks") > 1, F.col("label")).otherwise(-1 - F.pmod(F.xxhash64("label"), F.lit(packs)))
    dealt = placed.select(
        pack.alias("pack"), F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
        "own", "node", F.col("label").alias("component"),
    ).join(nodes.select("node", "copies", "size", "v"), "node")
    return dealt.groupBy("pack", "p", "q", "size").applyInArrow(_counts(threshold), "node long, n long, others long").groupBy("node").agg(
        F.sum("n").alias("n"), F.sum("others").alias("others")
    )


def audit(found: DataFrame, labels: DataFrame, nodes: DataFrame, threshold: float) -> float | None:
    """Least recall of `found` (node, others) in any class of true degrees; None if no audited node has a link.

    Up to AUDITED nodes of every size of component, by powers of two, are compared with all nodes. A
    class's recall is the mean over its nodes, each weighted by the nodes it stands for.
    """
    of_size = labels.groupBy("label").agg(F.count("*").alias("members"))
    strata = nodes.select("node", "first").join(labels.join(of_size, "label").select("node", "members"), "node", "left").withColumn(
        "stratum", F.floor(F.log2(F.coalesce("members", F.lit(1))))
    )
    strata = written(strata.select("node", "first", "stratum"), "strata")
    rank = Window.partitionBy("stratum").orderBy(F.xxhash64("first"), "node")
    drawn = strata.withColumn("nth", F.row_number().over(rank)).filter(F.col("nth") <= AUDITED)
    asked = drawn.select("node", "stratum").join(nodes.select("node", "label", "v"), "node").toPandas()  # AUDITED vectors a stratum
    if asked.empty:
        return None
    stands = strata.groupBy("stratum").count().toPandas().set_index("stratum")["count"] / asked.stratum.value_counts()
    want, label = asked.node.to_numpy(), asked.label.to_numpy()
    sizes = np.array([len(v) for v in asked.v])
    units = [matrix(pa.array([v], pa.list_(pa.float64())))[0] for v in asked.v]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(want), np.int64)
        for batch in batches:
            of, node, size = (batch[c].to_numpy(zero_copy_only=False) for c in ("label", "node", "size"))
            for s in np.unique(size):
                at, q = np.flatnonzero(size == s), np.flatnonzero(sizes == s)
                if len(q):
                    cos = np.stack([units[i] for i in q]) @ matrix(batch["v"].take(pa.array(at))).T
                    hit = (cos >= threshold) & (label[q][:, None] == of[at][None, :]) & (want[q][:, None] != node[at][None, :])
                    total[q] += hit.sum(1)
        yield pa.record_batch({"node": want, "truth": total})

    true = nodes.select("node", "label", "size", "v").mapInArrow(run, "node long, truth long").groupBy("node").agg(F.sum("truth").alias("truth"))
    rows = true.filter("truth > 0").join(found.select("node", "others"), "node", "left").toPandas()
    if rows.empty:
        return None
    rows = rows.merge(asked[["node", "stratum"]], on="node")
    weight = rows.stratum.map(stands).to_numpy(float)
    recall = np.minimum(rows.others.fillna(0) / rows.truth, 1).to_numpy(float)
    degree = np.floor(np.log2(rows.truth.to_numpy())).astype(int)
    return float((np.bincount(degree, weight * recall)[np.unique(degree)] / np.bincount(degree, weight)[np.unique(degree)]).min())


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD, k: int = K) -> DataFrame:
    """Per vector: vec_id, n_links, component_id (smallest vec_id reachable) and kept."""
    pin(vectors.sparkSession)
    nodes, rows = nodes_of(vectors)
    n = nodes.count()
    groups = written(first_groups(nodes, threshold), "first-groups")
    met = written(compare(groups.drop("parts"), nodes, groups.count() // 512 + 1, max(2, k // 4), threshold), "first-met")
    lists = written(best_lists(met, k), "first-lists")
    links = written(links_of(met, threshold), "links")
    oversize = groups.filter("parts > 1")
    if not oversize.isEmpty():
        links = written(links.union(across(oversize, components(links), nodes, threshold)), "links")
    turn = 0
    while True:
        lists, more = descend(lists, nodes, n, k, threshold)
        links = written(reduce(DataFrame.union, more, links).distinct(), "links")
        labels = components(links)
        saturated = written(lists.groupBy("node").agg(F.count("*").alias("n"), F.min("cos").alias("least")).filter(
            (F.col("n") >= k) & (F.col("least") >= threshold)
        ).select("node"), "saturated")
        while not saturated.isEmpty():
            turn += 1
            found = search(labels, nodes, threshold, turn, saturated)
            if found.isEmpty():
                break
            links = written(links.union(found), "links")
            labels = components(links)
        counted = written(degrees(labels, nodes, threshold), "degrees")
        recall = audit(counted, labels, nodes, threshold)
        if k >= max(n, K) or (recall is not None and recall >= RECALL):
            break
        turn += 1
        found = search(labels, nodes, threshold, turn)
        if recall is None and found.isEmpty():
            break
        links = written(links.union(found), "links")
        k = k if recall is None else k * 2
    known = nodes.select("node", "key", "first", "copies").join(labels, "node", "left").join(counted, "node", "left")
    known = known.withColumn("label", F.coalesce("label", "node"))
    least = written(known.groupBy("label").agg(F.min("first").alias("component_id")), "component-ids")
    classes = written(known.join(least, "label").select(
        "key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"
    ), "classes")
    return rows.join(classes, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"),
    )
