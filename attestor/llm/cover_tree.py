"""Exact cosine near-duplicates of vectors by a cover tree's dual traversal.

On unit vectors a cosine of at least c is a distance of at most sqrt(2 - 2c), so the triangle inequality prunes. The
upper levels of the tree are nested: a farthest-first order of a bounded sample gives centres whose prefixes cover the
sample within radii 2, 1, 1/2, ... A centre's parent is the nearest centre of the level above; every vector of the
table descends to its nearest centre at the lowest level, and each node's covering radius is measured over all vectors
below it, so bounds hold for the whole table whatever the sample. The traversal pairs the root with itself and goes
down both sides at once, dropping pairs of nodes farther apart than their radii and the threshold allow. The pairs of
leaves that remain are dealt out as tasks of bounded size (a large leaf is cut by a hash), where all products are taken.

A task returns, for each of its vectors, how many vectors of the other side it links with and one member of its linked set, never a list of pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, components

#: Bytes of the sample of vectors that the centres come from, and of the centres.
SAMPLE_BYTES, CENTRE_BYTES = 32 << 20, 8 << 20
STRIP = 512


class Tree:
    """Centres in farthest-first order; levels[k] of them make up level k, the last level holds the leaves."""

    def __init__(self, sample: np.ndarray, leaves: int):
        order, far, owner = [0], np.linalg.norm(sample - sample[0], axis=1), []
        radii = [far.max()]
        while len(order) < min(leaves, len(sample)) and far.max() > 1e-9:
            order.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(sample - sample[order[-1]], axis=1))
            radii.append(far.max())
        self.centres = sample[order]
        radii = np.array(radii)
        self.levels = sorted({*(int(np.argmax(radii <= r)) + 1 for r in (2.0 * 0.5**k for k in range(8)) if (radii <= r).any()), 1, len(order)})
        self.up = []
        for upper, lower in zip(self.levels, self.levels[1:], strict=False):
            owner = (self.centres[:lower] @ self.centres[:upper].T).argmax(1)
            owner[:upper] = np.arange(upper)
            self.up.append(owner)

    def descend(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each vector, and its distance to the node above it at each level."""
        leaf = node = (x @ self.centres.T).argmax(1)
        far = [np.linalg.norm(x - self.centres[node], axis=1)]
        for owner in reversed(self.up):
            node = owner[node]
            far.append(np.linalg.norm(x - self.centres[node], axis=1))
        return leaf, np.stack(far[::-1], 1)

    def pairs(self, radii: np.ndarray, near: float) -> np.ndarray:
        """Leaf pairs (i <= j) that the dual traversal doesn't prune. radii: leaves by levels, of the vectors below each leaf."""
        found = np.array([[0, 0]])
        node_at = [np.arange(self.levels[-1])]
        for owner in reversed(self.up):
            node_at.append(owner[node_at[-1]])
        node_at = node_at[::-1]
        for k, count in enumerate(self.levels):
            if k:
                owner = self.up[k - 1]
                child = pd.DataFrame({"p": owner, "c": np.arange(count)})
                both = pd.DataFrame(found, columns=["i", "j"]).merge(child, left_on="i", right_on="p").merge(child, left_on="j", right_on="p", suffixes=("", "_"))
                found = np.sort(both[["c", "c_"]].to_numpy(), 1)
                found = np.unique(found, axis=0)
            r = np.full(count, -np.inf)
            np.maximum.at(r, node_at[k], radii[:, k])
            i, j = found.T
            gap = np.linalg.norm(self.centres[i] - self.centres[j], axis=1)
            found = found[(gap <= r[i] + r[j] + near + 1e-9) & (r[i] >= 0) & (r[j] >= 0)]
        return found


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _raw(kind: str):
    """Vectors as bytes. A vector of another direction never has equal bytes; a zero's sign is dropped."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind) + np.zeros((), kind)
            width = len(flat) // max(len(column), 1) * flat.itemsize
            data = flat.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([data[k * width : (k + 1) * width] for k in range(len(column))], pa.binary())], ["id", "raw"])

    return run


def _descended(tree: Tree, kind: str):
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            leaf, far = tree.descend(_units(batch.column(1).to_pylist(), kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(leaf.astype(np.int32)), pa.array(list(far))], ["id", "raw", "c", "leaf", "far"])

    return run


def linked(x: np.ndarray, y: np.ndarray, cut: float) -> np.ndarray:
    """Which products of rows of x and y are at least cut, in double precision; single precision sorts out the rest."""
    rough = x.astype(np.float32) @ y.astype(np.float32).T >= np.float32(cut - 1e-4)
    i, j = np.nonzero(rough)
    if len(i) > 20_000:
        return x @ y.T >= cut
    rough[i, j] = np.einsum("ij,ij->i", x[i], y[j]) >= cut
    return rough


def _task(kind: str, cut: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "id"], kind="stable")
        left, right = rows[rows.side == 0], rows[rows.side == 1]
        same = not len(right)
        right = left if same else right
        x, y = _units(left.raw.tolist(), kind), _units(right.raw.tolist(), kind)
        ids = left.id.to_numpy() if same else np.concatenate([left.id.to_numpy(), right.id.to_numpy()])
        counts, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        cx, cy = left.c.to_numpy(), right.c.to_numpy()
        shift = 0 if same else len(left)
        for top in range(0, len(x), STRIP):
            hit = linked(x[top : top + STRIP], y, cut)
            if same:
                k = np.arange(len(hit))
                hit[k, top + k] = False
            if not hit.any():
                continue
            counts[top : top + len(hit)] += hit @ cy
            if not same:
                counts[shift:] += cx[top : top + len(hit)] @ hit
            for k in np.flatnonzero(hit.any(1)):
                joined = np.unique(label[np.append(np.flatnonzero(hit[k]) + shift, top + k)])
                if len(joined) > 1:
                    label[np.isin(label, joined)] = joined[0]
        full = np.flatnonzero(counts)
        return pd.DataFrame({"id": ids[full], "n": counts[full], "rep": ids[label[full]]})

    return run


def _of_size(work: Workspace, nodes: DataFrame, size: int, kind: str, cut: float, leaf: int, name: str) -> DataFrame:
    """(id, n, rep): links of vectors of one dimension. nodes: id, raw, c (number of equal vectors)."""
    count = nodes.count()
    most = max(16, min(8192, SAMPLE_BYTES // (8 * size)))
    sample = [bytes(r.raw) for r in nodes.orderBy(F.xxhash64("id"), "id").limit(most).select("raw").collect()]
    tree = Tree(_units(sample, kind), max(1, min(-(-count // leaf), CENTRE_BYTES // (8 * size))))
    below = work.keep(nodes.mapInArrow(_descended(tree, kind), "id long, raw binary, c long, leaf int, far array<double>"), f"{name}-below")
    # One row for each leaf, of which there are at most CENTRE_BYTES / (8 * size).
    facts = below.groupBy("leaf").agg(F.count("*").alias("n"), *(F.max(F.col("far")[k]).alias(f"r{k}") for k in range(len(tree.levels)))).toPandas()
    radii, held = np.full((tree.levels[-1], len(tree.levels)), -np.inf), np.zeros(tree.levels[-1], np.int64)
    radii[facts.leaf], held[facts.leaf] = facts[[f"r{k}" for k in range(len(tree.levels))]].to_numpy(), facts.n
    parts = -(-held // leaf)
    found = tree.pairs(radii, float(np.sqrt(max(0.0, 2 - 2 * cut))))
    spark = nodes.sparkSession
    leaves = spark.createDataFrame(pd.DataFrame({"leaf": np.arange(len(parts)), "parts": parts}), "leaf int, parts int")
    pairs = spark.createDataFrame(pd.DataFrame({"i": found[:, 0], "j": found[:, 1]}), "i int, j int")
    pairs = pairs.join(leaves.select(F.col("leaf").alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("pi")), "i")
    pairs = pairs.join(leaves.select(F.col("leaf").alias("j"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("pj")), "j").where("i < j or pi <= pj")
    pairs = pairs.withColumn("pair", F.concat_ws("-", "i", "pi", "j", "pj"))
    left = pairs.select("pair", F.col("i").alias("leaf"), F.col("pi").alias("part"), F.lit(0).alias("side"))
    sides = left.unionByName(pairs.where("i < j or pi < pj").select("pair", F.col("j").alias("leaf"), F.col("pj").alias("part"), F.lit(1).alias("side")))
    placed = below.join(leaves, "leaf").select("id", "raw", "c", "leaf", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    dealt = placed.join(sides, ["leaf", "part"]).select("pair", "side", "id", "raw", "c")
    return work.keep(dealt.groupBy("pair").applyInPandas(_task(kind, cut), "id long, n long, rep long"), f"{name}-links")


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", cut: float = 0.9, leaf: int = 4096) -> DataFrame:
    """Returns a row for each row of vectors: vec_id, n_links (other vectors with a cosine of at least cut), component_id, kept.

    component_id is the smallest id reachable by links; kept is vec_id = component_id. Vectors that are null, empty or zero, or
    hold a null or non-finite component, link with nothing, and so do vectors of different dimensions. Ids should be unique and not
    null: rows with a null id are left out, rows that repeat an id count as linked vectors of that id. Other columns are ignored.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "cover-tree")
    kind = "float32" if dict(vectors.dtypes)[vector_column] == "array<float>" else "float64"
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<float>" if kind == "float32" else "array<double>").alias("v")).where("id is not null")
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    sizes = [r[0] for r in rows.where(sound).select(F.size("v").alias("size")).distinct().orderBy("size").collect()]
    out = []
    for size in sizes:
        raw = work.keep(rows.where(sound & (F.size("v") == size)).select("id", "v").mapInArrow(_raw(kind), "id long, raw binary"), f"raw{size}")
        nodes = work.keep(raw.groupBy("raw").agg(F.min("id").alias("id"), F.count("*").alias("c")).select("id", "raw", "c"), f"nodes{size}")
        links = _of_size(work, nodes, size, kind, cut, leaf, f"size{size}")
        linked_sets = components(work, links.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")), f"size{size}-cc")
        found = nodes.select("raw", F.col("id").alias("node"), "c").join(links.groupBy(F.col("id").alias("node")).agg(F.sum("n").alias("n")), "node", "left").join(linked_sets.withColumnRenamed("id", "node"), "node", "left")
        out.append(raw.join(found, "raw").select("id", (F.coalesce("n", F.lit(0)) + F.col("c") - 1).cast("long").alias("n"), F.coalesce("component", "node").alias("component")))
    if not out:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    whole = whole.unionByName(rows.where(~F.coalesce(sound, F.lit(False))).select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component")))
    return whole.select(F.col("id").alias("vec_id"), F.col("n").alias("n_links"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
