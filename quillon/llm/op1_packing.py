"""Packing by cutting-stock column generation.

Documents longer than a sequence give whole sequences first; what is left of each is an item of 1 to
capacity-1 tokens. A linear program over the histogram of item lengths chooses patterns (multisets of
lengths that fit one sequence); a knapsack dynamic program prices new ones. Patterns are used the whole
number of times the program says. Documents are ranked within their length, and arithmetic on the rank
gives pattern, copy and slot, so no document's place is ever held on the driver. The few items beyond the
rounded patterns form one stream that fills the patterns' gaps and then further sequences, cut where those
end; the last of it goes to sequences whose length is a power of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.bpe import text_blocks
from quillon.llm.common import keep_columns, materialise, small_batches, table

CAPACITY = 1024
#: The program stops when its bound shows it within this share of the optimum.
GAP = 0.0001
#: Columns priced between two fresh inversions of the basis, so that rounding can't pile up.
REFRESH = 100
#: Gaps of fewer tokens stay padding.
LEAST_GAP = 16


class _Knapsack:
    """Greatest value of items of at most c tokens in all, for every c up to the capacity.

    In blocks from b to under 1.5 b, each by whole-array operations on views made once. Items of c tokens in all are
    there either one of b or more and others of c - b < b / 2 at most, or all shorter than b; these fall into two
    sides shorter than b: one item longer than c - b by itself, or shorter ones added up until they pass c - b, which
    ends below 2 (c - b) < b."""

    def __init__(self, capacity: int):
        self.best, self.blocks, b = np.zeros(capacity + 1), [], 2
        while b <= capacity:
            end = min(capacity + 1, b + (b + 1) // 2)
            n, half = end - b, (b + 1) // 2
            # Row c - b: best[c - a] for a from half to b - 1.
            other = sliding_window_view(self.best[: end - half][::-1], b - half)[:n][::-1]
            # Row c - b: worth[c - j] for j from n - 1 to 0; below b there is no long item.
            long = np.full(2 * n - 1, -np.inf)
            self.blocks.append((b, end, other, self.best[half:b], long[n - 1 :], sliding_window_view(long, n), self.best[:n][::-1]))
            b = end

    def fill(self, worth: np.ndarray) -> np.ndarray:
        """worth: of an item of each length, none negative. The result holds until the next call."""
        self.best[:2] = worth[:2]
        for b, end, other, one, long, longs, rest in self.blocks:
            long[:] = worth[b:end]
            np.maximum((other + one).max(axis=1), (longs + rest).max(axis=1), out=self.best[b:end])
        return self.best


def price(lengths: np.ndarray, duals: np.ndarray, capacity: int, knapsack: _Knapsack | None = None) -> tuple[float, np.ndarray]:
    """The pattern of greatest value: unbounded knapsack by dynamic programming over the filled length."""
    worth = np.zeros(capacity + 1)
    worth[lengths] = np.maximum(duals, 0)
    best = (knapsack or _Knapsack(capacity)).fill(worth)
    counts = np.zeros(len(lengths), np.int64)
    c = capacity
    while n := int(np.searchsorted(lengths, c, side="right")):
        value = best[c - lengths[:n]] + duals[:n]
        k = int(value.argmax())
        if value[k] <= 1e-12:
            break
        # As many of that length as lose nothing.
        times = np.arange(1, c // lengths[k] + 1)
        same = best[c - times * lengths[k]] + times * duals[k] >= value[k] - 1e-12
        counts[k] += times[same][-1]
        c -= int(times[same][-1] * lengths[k])
    return float(best[capacity]), counts


def starting_basis(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a column) of a feasible start and the matrix's inverse: the longest length left, filled up
    with the longest that fit, used until one of its lengths runs out. That length is in no later column, so
    the matrix is triangular in this order and its inverse takes a few row operations a column."""
    m = len(lengths)
    left = demand.astype(float)
    basis, alive, order = np.zeros((m, m)), np.ones(m, bool), []
    for column in range(m):
        room, pattern = capacity, np.zeros(m)
        at = m
        open_ = np.flatnonzero(alive)
        while room and (n := np.searchsorted(lengths[open_], room, side="right")):
            k = int(open_[min(n, at) - 1]) if min(n, at) else -1
            if k < 0:
                break
            pattern[k] = room // lengths[k]
            room -= int(pattern[k] * lengths[k])
            at = int(np.searchsorted(open_, k))
        inside = np.flatnonzero(pattern)
        share = left[inside] / pattern[inside]
        gone = int(inside[share.argmin()])
        left -= share.min() * pattern
        left[gone] = 0
        left = np.maximum(left, 0)
        basis[:, column] = pattern
        alive[gone] = False
        order.append(gone)
    inverse = np.zeros((m, m))
    for t, gone in enumerate(order):
        inverse[t, gone] = 1.0
        for c in np.flatnonzero(basis[gone, :t]):
            inverse[t] -= basis[gone, c] * inverse[c]
        inverse[t] /= basis[gone, t]
    return basis, inverse


def generate_columns(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP, steps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a row) and how often each is used, in fractions: the cutting-stock linear program by
    revised simplex with columns priced by a knapsack. It ends at `gap` from the better of two lower bounds
    (tokens over capacity; the duals' bound), where no column is worth its price, or after `steps` columns if that is given."""
    m = len(lengths)
    stalled, knapsack = 0, _Knapsack(capacity)
    basis, inverse = starting_basis(lengths, demand, capacity)
    used = np.maximum((inverse * demand).sum(axis=1), 0)
    duals = inverse.sum(axis=0)
    bound = float((lengths * demand).sum()) / capacity
    done = 0
    while steps is None or done < steps:
        done += 1
        if done % REFRESH == 0:
            inverse = np.linalg.inv(basis)
            used = np.maximum((inverse * demand).sum(axis=1), 0)
            duals = inverse.sum(axis=0)
        total = float(used.sum())
        if total - bound <= gap * total:
            break
        value, column = price(lengths, duals, capacity, knapsack)
        bound = max(bound, float((duals * demand).sum()) / max(value, 1.0))
        if value <= 1 + 1e-7 or total - bound <= gap * total:
            break
        inside = np.flatnonzero(column)
        direction = (inverse[:, inside] * column[inside]).sum(axis=1)
        ok = direction > 1e-9
        if not ok.any():
            break
        ratio = np.full(m, np.inf)
        ratio[ok] = used[ok] / direction[ok]
        leave = int(ratio.argmin())
        theta = ratio[leave]
        # Steps that change nothing may go round in a circle; so many in a row end the search at this basis, which packs all items.
        stalled = stalled + 1 if theta <= 1e-9 else 0
        if stalled > 2 * m:
            break
        used = np.maximum(used - theta * direction, 0)
        used[leave] = theta
        row = inverse[leave] / direction[leave]
        # Most columns of the basis have no part in the new one: their rows and the duals change by nothing else.
        touched = np.flatnonzero(np.abs(direction) > 1e-12)
        inverse[touched] -= direction[touched, None] * row
        inverse[leave] = row
        duals = duals + (1 - float(duals @ column)) * row
        basis[:, leave] = column
    used = np.maximum(np.linalg.solve(basis, demand.astype(float)), 0)
    return basis.T.astype(np.int64), used


@dataclass
class Plan:
    """Where the k-th item of each length goes; a few thousand numbers whatever the corpus holds."""

    capacity: int
    #: By length: ends of the rank ranges, then for each range the pattern's items, first sequence and offset.
    ends: dict[int, np.ndarray] = field(default_factory=dict)
    each: dict[int, np.ndarray] = field(default_factory=dict)
    first: dict[int, np.ndarray] = field(default_factory=dict)
    offset: dict[int, np.ndarray] = field(default_factory=dict)
    #: By length: where its items beyond the patterns begin in the stream.
    stream: dict[int, int] = field(default_factory=dict)
    #: Bins of the stream: start in the stream, size, first sequence, offset there.
    bin_start: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    bin_size: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    bin_first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    bin_offset: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sequences: int = 0

    def place(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(tokens, sequence, offset) of each piece of the item."""
        ends = self.ends.get(length)
        total = int(ends[-1]) if ends is not None else 0
        if rank < total:
            j = int(np.searchsorted(ends, rank, side="right"))
            k = rank - (int(ends[j - 1]) if j else 0)
            copy, slot = divmod(k, int(self.each[length][j]))
            return [(length, int(self.first[length][j]) + copy, int(self.offset[length][j]) + slot * length)]
        at, out, left = self.stream[length] + (rank - total) * length, [], length
        while left:
            j = int(np.searchsorted(self.bin_start, at, side="right")) - 1
            copy, inside = divmod(at - int(self.bin_start[j]), int(self.bin_size[j]))
            n = min(left, int(self.bin_size[j]) - inside)
            out.append((n, int(self.bin_first[j]) + copy, int(self.bin_offset[j]) + inside))
            at, left = at + n, left - n
        return out


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The packing of items by length; histogram: items of each length, 1 to capacity-1."""
    plan = Plan(capacity)
    lengths = np.array(sorted(k for k, v in histogram.items() if v), np.int64)
    demand = np.array([histogram[int(k)] for k in lengths], np.int64)
    slots: dict[int, list[tuple[int, int, int, int]]] = {int(k): [] for k in lengths}
    bins: list[tuple[int, int, int, int]] = []  # size, copies, first sequence, offset
    if len(lengths):
        patterns, used = generate_columns(lengths, demand, capacity)
        copies = np.floor(used + 1e-6).astype(np.int64)
        left = demand.copy()
        for pattern, n in zip(patterns, copies, strict=True):
            inside = pattern > 0
            n = int(min(n, (left[inside] // pattern[inside]).min())) if inside.any() else 0
            if n <= 0:
                continue
            left -= n * pattern
            at = 0
            for k in np.flatnonzero(inside)[::-1]:
                slots[int(lengths[k])].append((n, int(pattern[k]), plan.sequences, at))
                at += int(pattern[k] * lengths[k])
            if capacity - at >= LEAST_GAP and at & (at - 1):
                bins.append((capacity - at, n, plan.sequences, at))
            plan.sequences += n
        start = 0
        for k, n in zip(lengths[::-1], left[::-1], strict=True):
            plan.stream[int(k)] = start
            start += int(k * n)
        for k, found in slots.items():
            if found:
                plan.ends[k] = np.cumsum([n * a for n, a, _, _ in found])
                plan.each[k], plan.first[k], plan.offset[k] = (np.array([f[i] for f in found], np.int64) for i in (1, 2, 3))
        todo, at, rows = start, 0, []
        for size, n, first, offset in bins:
            rows.append((at, size, first, offset))
            at += size * min(n, -(-max(todo - at, 0) // size))
            if at >= todo:
                break
        if at < todo:
            rows.append((at, capacity, plan.sequences, 0))
            full = (todo - at) // capacity
            at += full * capacity
            plan.sequences += full
            size = capacity
            while at < todo:
                size //= 2
                if todo - at >= size:
                    rows.append((at, size, plan.sequences, 0))
                    at += size
                    plan.sequences += 1
        if rows:
            plan.bin_start, plan.bin_size, plan.bin_first, plan.bin_offset = (np.array([r[i] for r in rows], np.int64) for i in range(4))
    return plan


class _Ids:
    """Ids of a tokenizer file; the rank file of the same vocabulary encodes plain text several times faster
    and to the same ids, the library itself takes texts with special tokens or characters past U+024F."""

    def __init__(self, tokenizer: str, ranks: str | None):
        import base64
        import re

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer)
        self.fast = None
        self.rare = re.compile("[^\0-ɏ]|<\\|")
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table_ = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        """Ids of a text; a very long one is encoded block by block."""
        if self.fast is not None and not self.rare.search(text):
            return np.concatenate([np.array(self.fast.encode_ordinary(part), dtype="<u4") for part in text_blocks(text)])
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")


_IDS: dict[tuple, _Ids] = {}


def _ids(tokenizer: str, ranks: str | None) -> _Ids:
    if (tokenizer, ranks) not in _IDS:
        _IDS[tokenizer, ranks] = _Ids(tokenizer, ranks)
    return _IDS[tokenizer, ranks]


def tokenise(docs: DataFrame, tokenizer: str, ranks: str | None = None, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, doc_tokens, ids binary, part, tail, rank, whole): little-endian ids with the end id; the task that
    made the row, tokens beyond full sequences, rank among the task's rows of that tail, full sequences before."""
    small_batches(docs.sparkSession, 500)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _ids(tokenizer, ranks)
        part, whole, seen = TaskContext.get().partitionId(), 0, np.zeros(capacity, np.int64)
        for pdf in batches:
            rows = []
            for i, text in zip(pdf[id_col], pdf[text_col], strict=True):
                ids = np.append(encode(text) if isinstance(text, str) and text else np.zeros(0, "<u4"), np.array([end_id], "<u4"))
                full, tail = divmod(len(ids), capacity)
                rows.append((i, len(ids), ids.astype("<u4").tobytes(), part, tail, int(seen[tail]), whole))
                seen[tail] += 1
                whole += full
            yield pd.DataFrame(rows, columns=[id_col, "doc_tokens", "ids", "part", "tail", "rank", "whole"])

    kind = docs.schema[id_col].dataType.simpleString()
    return keep_columns(docs, id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, doc_tokens bigint, ids binary, part int, tail int, rank bigint, whole bigint")


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids binary).

    Null text: as empty, a document of the end id alone. Repeated rows are packed each. An empty table
    gives no pieces. Only the two columns named are read. A length that a third of all documents share is one row of the histogram; its ranks
    are counts of each task added up, so no task gathers them.
    """
    spark = docs.sparkSession
    made = materialise(tokenise(docs, tokenizer, ranks, end_id, capacity, id_col, text_col), "tokens")
    counts = materialise(
        made.groupBy("part", "tail").agg(F.count("*").alias("n"), F.sum(F.floor((F.col("doc_tokens") - F.col("tail")) / capacity)).cast("long").alias("full")), "counts"
    )
    histogram = {r["tail"]: r["n"] for r in counts.filter("tail > 0").groupBy("tail").agg(F.sum("n").alias("n")).collect()}  # under `capacity` rows
    plan = spark.sparkContext.broadcast(make_plan(histogram, capacity))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("part").agg(F.sum("full").alias("full")).select("part", F.coalesce(F.sum("full").over(earlier), F.lit(0)).alias("whole_base"))
    same = Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "tail", F.coalesce(F.sum("n").over(same), F.lit(0)).alias("rank_base")).join(parts, "part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = plan.value
        for pdf in batches:
            rows = []
            for i, raw, tail, rank, whole in zip(pdf[id_col], pdf["ids"], pdf["tail"], pdf["rank"] + pdf["rank_base"], pdf["whole"] + pdf["whole_base"], strict=True):
                size = len(raw) // 4
                places = [(capacity, p.sequences + whole + k, 0) for k in range(size // capacity)]
                if tail:
                    places += p.place(int(tail), int(rank))
                at = 0
                for n, sequence, offset in places:
                    piece = raw[4 * at : 4 * (at + n)]
                    rows.append((i, at, n, zlib.crc32(piece), size, sequence, offset, piece))
                    at += n
            yield pd.DataFrame(rows, columns=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    placed = made.select(id_col, "ids", "part", "tail", "rank", "whole").join(bases, ["part", "tail"]).select(id_col, "ids", "tail", "rank", "rank_base", "whole", "whole_base")
    return placed.mapInPandas(run, f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")).drop("ids")
