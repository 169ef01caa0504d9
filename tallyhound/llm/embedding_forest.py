"""Near-duplicate embeddings by a forest of random-projection trees with spill."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.llm.common import written
from tallyhound.llm.graph import components

COSINE = 0.93
TREES = 8
LEAF = 2048  # vectors that a leaf should hold
SPILL = 0.06  # of a node's vectors on either side of its median go to both children
SAMPLE = 40_000  # vectors, chosen by hash, to which the trees are fitted; every vector is routed
BLOCK = 1024
_KEPT_PAIRS = 1 << 26  # pairs of a leaf whose comparisons are kept rather than made again

Tree = tuple[np.ndarray | None, float, float, int, int, int]  # direction, low, high, left, right, leaf


def _unit(rows: pa.Array) -> np.ndarray:
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Forest:
    """Trees per key (label and dimension). A node sends vectors up to ``high`` left and from ``low`` on right."""

    def __init__(self, trees: int, leaf: int, spill: float, seed: int):
        self.trees, self.leaf, self.spill, self.seed = trees, leaf, spill, seed
        self.roots: dict[int, list[list[Tree]]] = {}
        self.leaves = 0

    def fit(self, key: int, x: np.ndarray, per_row: float) -> None:
        """Fit to a sample of which every row stands for ``per_row`` vectors; small keys stay one leaf."""
        if len(x) * per_row <= self.leaf:
            return
        grown = []
        for t in range(self.trees):
            draw = np.random.Generator(np.random.PCG64([self.seed, t, key & 0xFFFFFFFF]))
            nodes: list[Tree] = []
            todo = [(np.arange(len(x)), 0)]
            nodes.append((None, 0.0, 0.0, -1, -1, -1))
            while todo:
                rows, at = todo.pop()
                direction = draw.standard_normal(x.shape[1])
                seen = x[rows] @ direction
                low, high = np.quantile(seen, [0.5 - self.spill, 0.5 + self.spill])
                left, right = rows[seen <= high], rows[seen >= low]
                if len(rows) * per_row <= self.leaf or len(rows) < 32 or max(len(left), len(right)) > 0.9 * len(rows):
                    nodes[at] = (None, 0.0, 0.0, -1, -1, self.leaves)
                    self.leaves += 1
                    continue
                nodes[at] = (direction, float(low), float(high), len(nodes), len(nodes) + 1, -1)
                todo += [(left, len(nodes)), (right, len(nodes) + 1)]
                nodes += [(None, 0.0, 0.0, -1, -1, -1)] * 2
            grown.append(nodes)
        self.roots[key] = grown

    def route(self, key: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves that the vectors fall into."""
        if key not in self.roots:
            return np.arange(len(x)), np.full(len(x), -1 - (abs(key) >> 1), np.int64)
        rows_out, leaves_out = [], []
        for nodes in self.roots[key]:
            todo = [(np.arange(len(x)), 0)]
            while todo:
                rows, at = todo.pop()
                direction, low, high, left, right, leaf = nodes[at]
                if direction is None:
                    rows_out.append(rows)
                    leaves_out.append(np.full(len(rows), leaf, np.int64))
                elif len(rows):
                    seen = x[rows] @ direction
                    todo += [(rows[seen <= high], left), (rows[seen >= low], right)]
        return np.concatenate(rows_out), np.concatenate(leaves_out)


def _route(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: Forest = shared.value
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for key in np.unique(keys):
                at = np.flatnonzero(keys == key)
                for i in range(0, len(at), 2048):
                    rows = batch.take(pa.array(at[i : i + 2048]))
                    row, leaf = forest.route(int(key), _unit(rows.column("vector")))
                    order = np.lexsort((leaf, row))
                    row, leaf = row[order], leaf[order]
                    cut = np.searchsorted(row, np.arange(rows.num_rows + 1))
                    all_leaves = pa.array([leaf[cut[r] : cut[r + 1]] for r in range(rows.num_rows)], pa.list_(pa.int64()))
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(leaf), *[rows.column(c).take(take) for c in ("class", "copies", "vector")], all_leaves.take(take)], ["leaf", "class", "copies", "vector", "leaves"])

    return run


def _compare(cosine: float):
    def run(group: pa.Table) -> pa.Table:
        leaf = group.column("leaf")[0].as_py()
        x = _unit(group.column("vector").combine_chunks())
        classes, copies = group.column("class").to_numpy(), group.column("copies").to_numpy()
        order = np.argsort(classes)
        x, classes, copies = x[order], classes[order], copies[order]
        m = len(x)
        lists = group.column("leaves").combine_chunks().take(pa.array(order))
        flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(m), lists.value_lengths().to_numpy())
        earlier = flat < leaf  # a pair that meets in an earlier leaf is counted there
        names, column = np.unique(flat[earlier], return_inverse=True)
        inside = np.zeros((m, len(names)), np.float32)
        inside[owner[earlier], column] = 1
        kept: dict[int, np.ndarray] = {}

        def near(i: int) -> np.ndarray:
            if i not in kept:
                found = x[i : i + BLOCK] @ x.T >= cosine
                found[np.arange(len(found)), np.arange(i, i + len(found))] = True
                if m * m > _KEPT_PAIRS:
                    return found
                kept[i] = found
            return kept[i]

        links = np.zeros(m, np.int64)
        for i in range(0, m, BLOCK):
            new = near(i)
            if len(names):
                new = new & (inside[i : i + BLOCK] @ inside.T == 0)
            new = new.copy()
            new[np.arange(len(new)), np.arange(i, i + len(new))] = False
            links[i : i + BLOCK] = new @ copies
        label = np.arange(m)
        while True:
            least = np.concatenate([np.where(near(i), label, m).min(axis=1) for i in range(0, m, BLOCK)])
            least = least[least]
            if (least == label).all():
                break
            label = least
        return pa.table({"class": pa.array(classes), "links": pa.array(links), "root": pa.array(classes[label])})

    return run


def near_duplicate_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE,
                           trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE, seed: int = 5) -> DataFrame:
    """Per vector: key, ``n_links``, ``component_id`` and ``kept``.

    Vectors with equal, non-null labels and equal lengths are compared if a tree puts them in one leaf; they link
    when their cosine in double precision is at least ``cosine``. A vector that is null, empty, zero or holds a
    null or non-finite component, or has no label, links with nothing and is its own component. Equal vectors of
    a label are one row with a count, so copies of any number are compared once. A pair that meets in several
    leaves is counted in the first. Repeated keys give a row each; a null key is never a component's smallest.
    Trees are fitted to at most ``sample`` vectors chosen by hash; all vectors are routed through them.
    """
    spark = vectors.sparkSession
    ok = F.expr(f"`{label}` is not null and size(`{embedding}`) > 0 and forall(`{embedding}`, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(`{embedding}`, x -> x <> 0)")
    marked = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(embedding).alias("vector"), F.coalesce(ok, F.lit(False)).alias("ok"))
    valid = marked.filter("ok").withColumn("print", F.xxhash64("label", "vector"))
    classes = valid.groupBy("label", "print", "vector").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()).withColumn("key", F.xxhash64("label", F.size("vector"))))
    total = classes.count()
    part = min(1.0, sample / max(1, total))
    drawn = classes.filter(F.pmod(F.xxhash64("vector", F.lit(seed)), F.lit(1_000_000)) < int(part * 1_000_000)).select("key", "vector").limit(2 * sample).toArrow()
    forest = Forest(trees, leaf, spill, seed)
    keys = drawn.column("key").to_numpy()
    for one in np.unique(keys):
        forest.fit(int(one), _unit(drawn.column("vector").filter(pa.array(keys == one)).combine_chunks()), 1 / max(part, 1e-12))
    shared = spark.sparkContext.broadcast(forest)
    element = classes.schema["vector"].dataType.simpleString()
    routed = classes.select("key", "class", "copies", "vector").mapInArrow(_route(shared), f"leaf long, class long, copies long, vector {element}, leaves array<long>")
    found = written(routed.groupBy("leaf").applyInArrow(_compare(cosine), "class long, links long, root long"))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(found.filter("class <> root").select(F.col("class").alias("a"), F.col("root").alias("b")).distinct())
    rooted = classes.join(roots, F.col("class") == F.col("node"), "left").join(links, "class").select("class", "label", "print", "vector", "least", "copies", "links", F.coalesce("root", "class").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    told = rooted.join(smallest, "root").select(F.col("label").alias("l"), F.col("print").alias("p"), F.col("vector").alias("v"), (F.col("links") + F.col("copies") - 1).alias("links"), "component")
    joined = valid.join(told, F.expr("label = l and print = p and vector = v")).select("id", "links", "component")
    out = joined.unionByName(marked.filter("not ok").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component")))
    return out.select(F.col("id").alias(key), F.col("links").alias("n_links"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
