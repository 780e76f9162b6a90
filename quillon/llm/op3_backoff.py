"""Language-model scores by a weighted backoff automaton over word trigrams.

States are contexts: the empty one, a word, and a pair of words seen in training at least twice. An arc reads
a word and carries the log10 probability of an n-gram seen in training; a state without an arc for the
word has a failure arc, whose weight is the share that the state leaves to the shorter context, and the word is
read from there; the empty context has an arc for every word. With the mixing weight m(h) = M c(h) / (c(h) + B)

    p(w)     = (c(w) + 1) / (N + V + 1)
    p(w|v)   = m(v) c(vw) / c(v) + (1 - m(v)) p(w)
    p(w|uv)  = m(uv) c(uvw) / c(uv) + (1 - m(uv)) p(w|v)

and a failure arc of h has the weight 1 - m(h). Of trigrams, those count whose two pairs were both seen twice:
a trigram seen twice is never left out, and the others' mass goes to no word. A document is read once from left to
right: each arc's end is the longest context that is a state, so the state carried is a function of the last
two words, and a block's arcs are looked up for all of its positions at once.

The model is never in one place. Documents are dealt into blocks; each block sends the distinct keys of
its n-grams with their training counts to hash ranges, where all blocks' counts are added up, and gets the
corpus's counts of its own keys back: its part of the automaton. Words and pairs go first, trigrams then.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import keep_columns, materialise, materialise_alone, table
from quillon.llm.wordhash import combine, mix, word_hashes

#: Characters of a block.
BLOCK_CHARS = 12 << 20
#: Hash ranges for each block, and at most: beyond that a range holds more keys rather than there being more ranges.
RANGES, MOST_RANGES = 4, 20_000
#: M and B of the smoothing, for words and for pairs.
MIXING, BACKOFF = 0.3, 5.0
#: Least count of a pair that is a state.
STATE_COUNT = 2
_END = mix(np.array([0xE0D], np.uint64))[0]


def planes(keys: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as the planes of bytes of their differences: those that are zero pack to nothing."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def from_planes(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data), dtype=np.uint64)


class Block:
    """The words of some documents, each document closed by an end token, which is the start's context, too."""

    def __init__(self, texts: list[str]):
        docs = word_hashes(texts)
        self.sizes = np.array([len(d) + 1 for d in docs], np.int64)
        words = np.concatenate([np.append(d, _END) for d in docs]) if docs else np.zeros(0, np.uint64)
        self.first = np.cumsum(self.sizes) - self.sizes
        before = np.concatenate([[_END], words[:-1]]) if len(words) else words
        self.words, self.word = np.unique(words, return_inverse=True)
        pair = combine(before, words)
        pairs, self.pair = np.unique(pair, return_inverse=True)
        # Even keys are words, odd ones pairs.
        one = np.uint64(1)
        self.keys = np.concatenate([self.words & ~one, pairs | one])
        self.order = np.argsort(self.keys, kind="stable")
        self._triple_hash = combine(np.concatenate([[np.uint64(0)], pair[:-1]]) if len(pair) else pair, words)

    def counts(self, train: np.ndarray) -> np.ndarray:
        """Occurrences of each key, in key order, in the documents of the mask."""
        use = np.repeat(train, self.sizes)
        found = np.concatenate([np.bincount(self.word[use], minlength=len(self.words)), np.bincount(self.pair[use], minlength=len(self.keys) - len(self.words))])
        return found[self.order]

    def learn(self, counts: np.ndarray) -> None:
        """Take the corpus's counts of words and pairs, in key order; tells which positions read a trigram."""
        own = np.empty(len(self.keys))
        own[self.order] = counts
        self.c_word, self.c_pair = own[: len(self.words)], own[len(self.words) :]
        often = self.c_pair[self.pair] >= STATE_COUNT
        #: Is the context a state of two words? Not so at a document's first word.
        self.deep = np.concatenate([[False], often[:-1]]) if len(often) else often
        self.deep[self.first] = False
        self.open = np.flatnonzero(self.deep & often)
        self.triples, self.triple = np.unique(self._triple_hash[self.open], return_inverse=True)

    def triple_counts(self, train: np.ndarray) -> np.ndarray:
        use = np.repeat(train, self.sizes)[self.open]
        return np.bincount(self.triple[use], minlength=len(self.triples))

    def score(self, triples: np.ndarray, n: int, v: int, mixing: float = MIXING, backoff: float = BACKOFF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each document: known tokens, base score, score; triples: the corpus's counts of trigrams."""
        c_word, c_pair = self.c_word, self.c_pair
        # Arcs of the empty context, and the failure arcs into it.
        root = (c_word + 1) / (n + v + 1)
        leave_word = 1 - mixing * c_word / (c_word + backoff)
        state = np.concatenate([[np.searchsorted(self.words, _END)], self.word[:-1]])
        left, c_state, arc = leave_word[state], c_word[state], c_pair[self.pair]
        p = left * root[self.word]
        p += np.where(arc > 0, (1 - left) * arc / np.maximum(c_state, 1), 0)
        # States of two words: their arcs are trigrams; all else fails to the state of one word.
        where = np.flatnonzero(self.deep)
        c_deep = c_pair[self.pair[where - 1]]
        leave_pair = 1 - mixing * c_deep / (c_deep + backoff)
        p[where] *= leave_pair
        if len(self.open):
            c_open = c_pair[self.pair[self.open - 1]]
            p[self.open] += mixing * c_open / (c_open + backoff) * triples[self.triple] / c_open
        add = lambda x: np.add.reduceat(x, self.first)
        return add((c_word[self.word] > 0).astype(np.int64)), add(np.log10(root)[self.word]), add(np.log10(p))


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


_SENT = "block int, range int, keys binary, counts binary"
_BACK = "block int, range int, level int, counts binary, n bigint, v bigint"


def _send(block: int, keys: np.ndarray, counts: np.ndarray, ranges: int) -> pd.DataFrame:
    """Ascending keys and their counts, a row for each range that holds any."""
    cuts = np.searchsorted(_range_of(keys, ranges), np.arange(ranges + 1))
    part = [(block, r, planes(keys[a:b]), counts[a:b].astype("<u4").tobytes()) for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
    return pd.DataFrame(part, columns=["block", "range", "keys", "counts"])


def _add_up(sent: DataFrame, level: int, tag: str) -> DataFrame:
    """The corpus's counts of each block's keys, and (block -1) how many words there are in all and apart."""

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [from_planes(x) for x in pdf["keys"]]
        keys, at = np.unique(np.concatenate(each), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, at, np.frombuffer(b"".join(pdf["counts"]), "<u4").astype(np.int64))
        words = (keys & np.uint64(1)) == 0
        back = np.split(total.astype("<u8")[at], np.cumsum([len(x) for x in each])[:-1])
        number = int(pdf["range"].iloc[0])
        out = [(int(b), number, level, np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), 0, 0) for b, x in zip(pdf["block"], back, strict=True)]
        out.append((-1, number, level, b"", int(total[words].sum()), int((total[words] > 0).sum())))
        return pd.DataFrame(out, columns=["block", "range", "level", "counts", "n", "v"])

    return materialise_alone(lambda: materialise(sent, tag).groupBy("range").applyInPandas(answer, _BACK), sent.sparkSession, f"{tag}-counts")


def _counts(part: pd.DataFrame, level: int) -> np.ndarray:
    found = part[part["level"] == level].sort_values("range")["counts"]
    return np.concatenate([_numbers(x) for x in found]).astype(np.float64) if len(found) else np.zeros(0)


def score_documents(docs: DataFrame, held_out: F.Column, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, mixing: float = MIXING, backoff: float = BACKOFF) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Null text: as empty, its end token alone. A null held_out counts as false. Repeated rows count each.
    An empty table gives no rows. A text of any length is read whole, in one block. Only the two columns named
    are read. No key's rows meet in one task beyond one for each block.
    """
    rows = keep_columns(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("held", F.coalesce(held_out, F.lit(False)))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(chars // block_chars) + 1
    ranges = min(MOST_RANGES, RANGES * blocks)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        block = Block(pdf["text"].tolist())
        return _send(int(pdf["block"].iloc[0]), block.keys[block.order], block.counts(~pdf["held"].to_numpy(bool)), ranges)

    def count_triples(texts: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(texts):
            return pd.DataFrame(columns=["block", "range", "keys", "counts"])
        block = Block(texts["text"].tolist())
        block.learn(_counts(part, 1))
        return _send(int(texts["block"].iloc[0]), block.triples, block.triple_counts(~texts["held"].to_numpy(bool)), ranges)

    def score(texts: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(texts):
            return pd.DataFrame(columns=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        block = Block(texts["text"].tolist())
        block.learn(_counts(part, 1))
        known, base, total = block.score(_counts(part, 2), n, v, mixing, backoff)
        return pd.DataFrame({"id": texts["id"], "held_out": texts["held"], "n_tokens": block.sizes, "n_known": known, "train_tokens": n, "base_score": base, "score": total})

    small = _add_up(rows.groupBy("block").applyInPandas(count, _SENT), 1, "grams")
    sums = small.filter("block = -1").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = sums["n"] or 0, sums["v"] or 0
    small = small.filter("block >= 0").drop("n", "v")
    large = _add_up(rows.groupBy("block").cogroup(small.groupBy("block")).applyInPandas(count_triples, _SENT), 2, "triples")
    model = small.unionByName(large.filter("block >= 0").drop("n", "v"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.groupBy("block").cogroup(model.groupBy("block")).applyInPandas(score, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("id").cast("string").cast("binary")) % 7 == 2
    return score_documents(table(spark, sf_dir, "documents"), held)
