"""MinHash near-dedup with b-bit signatures.

Each text's three-word shingles are hashed; of 128 permutations the minima are kept while its bands are
hashed, then only the low two bits of each, packed into bit planes. Bands give candidates. Their
similarity is first estimated by bit counts, corrected for the quarter of positions that agree by chance;
those near or above the threshold are verified on the full sets, most similar first, and pairs that are
connected already are skipped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import keep_columns, materialise, small_batches, table
from quillon.llm.components import block_pairs, components, pivot_groups
from quillon.llm.wordhash import combine, shingles, word_hashes

PERMUTATIONS = 128
#: Share of pairs just at the threshold that may have no band in common.
MISSED = 5e-5
BITS = 2
#: Estimates this many deviations below the threshold are still verified.
SLACK = 4.5
#: Members of a group that are compared in one task with as many others.
BLOCK = 512
_RNG = np.random.default_rng(20240607)
_A = (_RNG.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)


def minima(found: np.ndarray) -> np.ndarray:
    """The permutations' minima over a set of 64-bit hashes."""
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(found), 4096):
        part = (found[at : at + 4096] >> np.uint64(32)).astype(np.uint32)
        np.minimum(low, (part[None, :] * _A[:, None] + _B[:, None]).min(axis=1), out=low)
    return low


def layout(percent: int) -> tuple[int, int]:
    """Number of bands and minima in each: the longest bands that miss few enough pairs (21 of 6 at 85)."""
    for rows in range(PERMUTATIONS, 1, -1):
        if (1 - (percent / 100) ** rows) ** (PERMUTATIONS // rows) <= MISSED:
            return PERMUTATIONS // rows, rows
    return PERMUTATIONS, 1


def bands(low: np.ndarray, count: int, rows: int) -> np.ndarray:
    key = np.arange(1, count + 1, dtype=np.uint64)
    for k in range(rows):
        key = combine(key, low[: count * rows].reshape(count, rows)[:, k].astype(np.uint64))
    return key.view(np.int64)


def pack(low: np.ndarray) -> bytes:
    """The low bits of the (mixed) minima, one plane of 128 bits for each."""
    x = (low ^ (low >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(12)
    return b"".join(np.packbits((x >> np.uint32(b) & np.uint32(1)).astype(bool)).tobytes() for b in range(BITS))


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Corrected similarity of a signature (BITS x 2 words of 64 bits) to each of many."""
    differ = np.bitwise_or.reduce(one[None, :, :] ^ many, axis=1)
    agree = 1 - np.bitwise_count(differ).sum(axis=1) / PERMUTATIONS
    chance = 0.5**BITS
    return (agree - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    j, chance = percent / 100, 0.5**BITS
    agree = j + (1 - j) * chance
    return j - SLACK * (agree * (1 - agree) / PERMUTATIONS) ** 0.5 / (1 - chance)


def link_group(ids: np.ndarray, own: np.ndarray, sets: list[np.ndarray], signatures: np.ndarray, cross: bool, percent: int) -> list[tuple[int, int]]:
    """Verified links that connect what is connected; cross: only pairs of different blocks."""
    size = np.array([len(s) for s in sets])
    least = least_estimate(percent)
    first, second, guess = [], [], []
    for i in range(len(ids) - 1):
        rest = np.arange(i + 1, len(ids))
        fit = 100 * np.minimum(size[i], size[rest]) >= percent * np.maximum(size[i], size[rest])
        if cross:
            fit &= own[rest] != own[i]
        rest = rest[fit]
        if len(rest):
            g = estimate(signatures[i], signatures[rest])
            keep = g >= least
            first.append(np.full(int(keep.sum()), i))
            second.append(rest[keep])
            guess.append(g[keep])
    if not first:
        return []
    a, b = np.concatenate(first), np.concatenate(second)
    order = np.argsort(-np.concatenate(guess), kind="stable")
    root = list(range(len(ids)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
        x, y = top(i), top(j)
        if x == y:
            continue
        both = np.sort(np.concatenate([sets[i], sets[j]]))
        shared = int((both[1:] == both[:-1]).sum())
        if 100 * shared >= percent * (size[i] + size[j] - shared):
            root[max(x, y)] = min(x, y)
            links.append((int(ids[i]), int(ids[j])))
    return links


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: linked are documents with 100 * intersection at least
    percent * union. Sets that are equal are one node. A null text, or one without words, has no shingle and
    no link; a null id has no links and is kept. Rows are told apart even if they repeat an id: one row of each
    component is kept, of its smallest id."""
    return decisions(docs, words, percent, id_col, text_col, block).select(id_col, "n_shingles", "component_id", "kept")


def remove(docs: DataFrame, words: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are kept, with all columns. Of rows that repeat id and text, the least by its columns stays."""
    found = decisions(docs, words, percent, id_col, text_col).filter("NOT kept")
    gone = materialise(found.select(F.col(id_col).alias("gone_id"), F.col("r1").alias("gone_r1"), F.col("r2").alias("gone_r2"), "twin").distinct(), "gone")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), *_digests(text))
    same = (F.col("id") == F.col("gone_id")) & (F.col("r1") == F.col("gone_r1")) & (F.col("r2") == F.col("gone_r2"))
    left = rows.join(gone, same, "left_anti").select("row.*")
    twins = gone.filter("twin")
    if twins.isEmpty():
        return left
    return left.unionByName(rows.join(twins, same, "left_semi").groupBy("id", "r1", "r2").agg(F.min("row").alias("row")).select("row.*"))


def _digests(text: Column) -> tuple[Column, Column]:
    """r1, r2: 128 bits that tell texts of one id apart."""
    return F.xxhash64(text).alias("r1"), F.xxhash64(text, F.lit(1)).alias("r2")


def decisions(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, block: int = BLOCK) -> DataFrame:
    """(id, r1, r2, n_shingles, component_id, kept, twin) of every row; r1, r2: digests of its text; twin: another
    row of the same id and text is kept instead. Nodes are numbers of sets, not ids, which rows may repeat."""
    spark = docs.sparkSession
    small_batches(spark)
    shape = layout(percent)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, r1, r2, found in zip(pdf["id"], pdf["r1"], pdf["r2"], word_hashes(pdf["text"].tolist()), strict=True):
                made = shingles(found, words)
                digest = np.frombuffer(hashlib.blake2b(made.tobytes(), digest_size=16).digest(), np.int64)
                low = minima(made)
                rows.append((i, r1, r2, len(made), int(digest[0]), int(digest[1]), bands(low, *shape).tolist() if len(made) else [], pack(low)))
            out = pd.DataFrame(rows, columns=["id", "r1", "r2", "n", "k1", "k2", "bands", "signature"])
            yield out.astype({"id": "Int64"})

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [shingles(x, words) for x in word_hashes(pdf["text"].tolist())]
            yield pd.DataFrame({"node": pdf["node"], "shingles": [m.tobytes() for m in made]})

    rows = keep_columns(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", *_digests(F.col("text")), "text")
    signed = rows.mapInPandas(sign, "id bigint, r1 bigint, r2 bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>, signature binary")
    signed = materialise(signed.withColumn("at", F.monotonically_increasing_id()), "signatures")
    row = F.struct("id", "r1", "r2", "at")
    sets = signed.filter("n > 0 AND id IS NOT NULL").groupBy("k1", "k2").agg(F.min(row).alias("first"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    sets = materialise(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    buckets = sets.select(F.col("node").alias("id"), F.posexplode("bands").alias("band", "value"))
    groups = materialise(pivot_groups(buckets, ["band", "value"]), "groups")
    members = sets.join(groups.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("node", "first.id", "first.r1", "first.r2", "signature")
    texts = rows.join(members.drop("signature"), ["id", "r1", "r2"]).select("node", "text").mapInPandas(expand, "node bigint, shingles binary")
    full = texts.join(members.select("node", "signature"), "node").groupBy(F.col("node").alias("id")).agg(F.first("shingles").alias("shingles"), F.first("signature").alias("signature"))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        made = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        signature = np.frombuffer(b"".join(pdf["signature"]), np.uint64).reshape(len(pdf), BITS, -1)
        cross = bool((pdf["left"] != pdf["right"]).iloc[0])
        return pd.DataFrame(link_group(pdf["id"].to_numpy(), pdf["own"].to_numpy(), made, signature, cross, percent), columns=["a", "b"])

    links = block_pairs(groups, block).join(full, "id").groupBy("pivot", "left", "right").applyInPandas(link, "a bigint, b bigint")
    # Each component goes by the least of its rows: id first, then digests.
    found = components(materialise(links, "links")).join(sets.select("node", "first"), "node")
    heads = found.groupBy("component").agg(F.min("first").alias("head"))
    heads = found.join(heads, "component").select("node", "head")
    named = sets.select("k1", "k2", "node", "first").join(heads, "node", "left").select("k1", "k2", F.coalesce("head", "first").alias("head"))
    out = signed.select("id", "r1", "r2", "at", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    head = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("head"))
    out = out.withColumn("head", head).withColumn("kept", F.coalesce(F.col("at") == F.col("head.at"), F.lit(True)))
    twin = ~F.col("kept") & (F.col("id") == F.col("head.id")) & (F.col("r1") == F.col("head.r1")) & (F.col("r2") == F.col("head.r2"))
    return out.select(F.col("id").alias(id_col), "r1", "r2", F.col("n").alias("n_shingles"), F.coalesce("head.id", "id").alias("component_id"), "kept", F.coalesce(twin, F.lit(False)).alias("twin"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The same by counting the shared shingles of all pairs that share one.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM words
),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS m, b.n, count(*) AS c FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 85 * (m + n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
classes AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN classes ON a = doc_id
"""
