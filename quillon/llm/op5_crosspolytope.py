"""Embedding near-dedup by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is the axis
it then lies nearest to, with the sign. A table's bucket is several such axes; each vector is also put into
the buckets with one of the axes second-best (multiprobe). Vectors that share a bucket are candidates;
their cosine is taken in double precision.

The number of axes grows with the logarithm of the largest label's vectors, so that unlike vectors seldom meet
whatever the size; the number of tables follows from how often pairs just at the threshold share none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import keep_columns, materialise, small_batches, table
from quillon.llm.components import block_pairs, components, pivot_groups

#: Share of pairs just at the threshold that may share no bucket.
MISSED = 1e-5
#: Unlike vectors that a vector may meet in a table by chance, on average.
STRANGERS = 0.125
#: Pairs of vectors that the chance of a shared bucket is measured on.
_TRIALS = 2000
BLOCK = 512
_ROUNDS = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast transform along the last axis, whose length is a power of two."""
    n = x.shape[-1]
    x = x.copy()
    step = 1
    while step < n:
        pairs = x.reshape(*x.shape[:-1], n // (2 * step), 2, step)
        a, b = pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]
        pairs[..., 0, :], pairs[..., 1, :] = a, b
        step *= 2
    return x / np.sqrt(n)


def codes(x: np.ndarray, tables: int, functions: int) -> np.ndarray:
    """Buckets of unit vectors (rows): shape (rows, tables, probes), the vector's own bucket first."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    wide = np.zeros((n, size))
    wide[:, :d] = x
    out = np.zeros((n, tables, 1 + functions), np.int64)
    for t in range(tables):
        best, second = [], []
        for f in range(functions):
            rng = np.random.default_rng([size, t, f])
            y = wide
            for _ in range(_ROUNDS):
                y = hadamard(y * rng.choice([-1.0, 1.0], size))
            order = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :2]
            sign = np.take_along_axis(y, order, axis=1) < 0
            axis = order * 2 + sign
            best.append(axis[:, 0])
            second.append(axis[:, 1])
        probes = [best] + [[second[g] if g == f else best[g] for g in range(functions)] for f in range(functions)]
        for p, axes in enumerate(probes):
            code = np.zeros(n, np.int64)
            for axis in axes:
                code = code * (2 * size) + axis
            out[:, t, p] = code
    return out


def layout(count: int, dim: int, least: float, missed: float = MISSED) -> tuple[int, int]:
    """Functions and tables for labels of up to `count` vectors of up to `dim` components."""
    size = 1 << max(1, (dim - 1).bit_length())
    functions = 2
    while count * (1 + functions) ** 2 > STRANGERS * (2 * size) ** functions and (2 * size) ** (functions + 1) < 1 << 62:
        functions += 1
    rng = np.random.default_rng(20240817)
    x, y = rng.standard_normal((2, _TRIALS, size))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.sqrt((y * y).sum(axis=1, keepdims=True))
    near = least * x + np.sqrt(max(0.0, 1 - least * least)) * y
    a, b = codes(x, 1, functions)[:, 0], codes(near, 1, functions)[:, 0]
    met = (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean()
    met = min(max(met, 1 / _TRIALS), 1 - 1 / _TRIALS)
    return functions, max(2, int(np.ceil(np.log(missed) / np.log(1 - met))))


def cosines(x: np.ndarray, least: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (first below second; of different `own` if given) with cosine at least `least`. A matrix
    product finds them; what it says is near the threshold or above is summed again, in an order that does not depend on the block."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    hit = np.triu(x @ x.T >= (least - 1e-9) * norm[:, None] * norm[None, :], 1)
    if own is not None:
        hit &= own[:, None] != own[None, :]
    a, b = np.nonzero(hit)
    keep = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 14):
        i, j = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
        keep[at : at + (1 << 14)] = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= least
    return a[keep], b[keep]


def compare(x: np.ndarray, own: np.ndarray, pivots: list[np.ndarray], pivot: int, weight: np.ndarray, least: float, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: weight of the rows linked to it whose smallest common pivot is this one, and the smallest
    row it is connected with here."""
    n = len(x)
    a, b = cosines(x, least, own if cross else None)
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    width = max(map(len, pivots))
    wide = np.zeros((n, width), np.int64)
    held = np.arange(width) < np.array([len(p) for p in pivots])[:, None]  # a pivot may be any number
    for i, p in enumerate(pivots):
        wide[i, : len(p)] = p
    count = np.zeros(n, np.int64)
    for at in range(0, len(a), 1 << 14):
        i, j = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
        common = ((wide[i][:, :, None] == wide[j][:, None, :]) & held[j][:, None, :]).any(axis=2) & held[i]
        least_pivot = np.where(common, wide[i], np.iinfo(np.int64).max).min(axis=1)
        i, j = i[least_pivot == pivot], j[least_pivot == pivot]
        np.add.at(count, i, weight[j])
        np.add.at(count, j, weight[i])
    return count, label


def near_duplicates(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", missed: float = MISSED, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) of every row. Only vectors of one non-null label are compared. A vector
    that is null, zero, or holds null or non-finite components has no links; so has a row whose id is null.
    Equal vectors of a label are one node that counts as often as it occurs. Vectors of different lengths aren't
    compared. Empty table: empty. Only the three columns named are read."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = keep_columns(vectors, id_col, vector_col, label_col).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("v", lambda x: x != 0), F.lit(False))
    keyed = rows.withColumn("good", sound).withColumn("k1", F.when(F.col("good"), F.xxhash64("label", "v"))).withColumn("k2", F.when(F.col("good"), F.xxhash64("v", "label")))
    nodes = keyed.filter("good").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = materialise(nodes, "nodes")
    sizes = nodes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).agg(F.max("n").alias("n"), F.max("d").alias("d")).first()
    functions, tables = layout(sizes["n"] or 1, sizes["d"] or 1, least, missed)

    def hash_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["v"].map(len)):
                x = np.array(part["v"].tolist(), np.float64)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                made = codes(x / np.sqrt((x * x).sum(axis=1, keepdims=True)), tables, functions)
                number = np.broadcast_to(np.arange(tables)[None, :, None], made.shape)
                each = made.shape[1] * made.shape[2]
                out = pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), each), "label": np.repeat(part["label"].to_numpy(), each), "number": number.ravel(), "code": made.ravel()})
                out["dim"] = dim
                yield out

    buckets = nodes.select("id", "label", "v").mapInPandas(hash_, "id bigint, label string, number int, code bigint, dim int")
    groups = materialise(pivot_groups(buckets, ["label", "dim", "number", "code"]), "groups")
    lists = groups.groupBy("id").agg(F.sort_array(F.collect_list("pivot")).alias("pivots"))  # at most one for each probe
    full = nodes.select("id", "copies", "v").join(lists, "id")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["v"].tolist(), np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        cross = bool((pdf["left"] != pdf["right"]).iloc[0])
        ids = pdf["id"].to_numpy()
        count, label = compare(x, pdf["own"].to_numpy(), [np.asarray(p) for p in pdf["pivots"]], int(pdf["pivot"].iloc[0]), pdf["copies"].to_numpy(), least, cross)
        out = pd.DataFrame({"a": ids, "b": ids[label], "links": count})
        return out[(out["links"] > 0) | (out["a"] != out["b"])]

    found = block_pairs(groups, block).join(full, "id").groupBy("pivot", "left", "right").applyInPandas(link, "a bigint, b bigint, links bigint")
    found = materialise(found, "links")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = components(found.select("a", "b"))
    per_node = nodes.select("k1", "k2", F.col("id").alias("node"), "copies").join(counts, "node", "left").join(classes, "node", "left")
    per_node = per_node.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = keyed.select("id", "k1", "k2").join(per_node, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: The same by comparing all pairs of a label.
ORACLE = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) AND list_bool_or(list_transform(embedding, lambda x: coalesce(x <> 0, false)))
),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
classes AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN classes c ON c.a = e.vec_id LEFT JOIN counts k ON k.a = e.vec_id
"""
