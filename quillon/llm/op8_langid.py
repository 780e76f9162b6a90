"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased and all else becomes one space; runs of 1 to 3 characters that hold a letter are
hashed into a fixed number of buckets. The matrix of log-probabilities (languages x buckets, float32) is
broadcast if there are no more than MOST_LANGUAGES. Texts are scored in batches: the sparse matrix of a batch's
n-grams (texts x buckets) times that of the log-probabilities, in numpy.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import keep_columns, small_batches, table

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Labelled documents of each language that are learned from, about; chosen by the hash of the id.
PER_LANGUAGE = 5000
SMOOTHING = 0.5
#: Over the root of a text's number of n-grams: what its mean log-probability may lie low by chance, in nats.
CHANCE = 10.0
UNKNOWN = "und"
#: More languages than this (a matrix of 134 MB) are refused: it would be no small broadcast.
MOST_LANGUAGES = 512
#: Characters worked on at once.
_SPAN = 1 << 20
#: Numbers gathered at once in scoring.
_CELLS = 1 << 24
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """By code point: the lower-case letter, or 32 for all else."""
    if not _FOLD:
        out = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
            elif c > 127 and unicodedata.category(ch)[0] == "M":
                out[c] = c  # marks belong to the letters before them
        _FOLD.append(out)
    return _FOLD[0]


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The n-grams of a batch of texts as a sparse matrix, in parts: (rows, columns), that is (numbers of texts,
    ascending, and buckets), repeats included. About _SPAN characters are in work at once; longer texts are cut,
    and the n-grams across a cut are those of the part after it."""
    part: list[tuple[int, int, str]] = []
    size = 0
    for k, text in enumerate(texts):
        for at in range(0, len(text), _SPAN):
            cut = text[max(0, at - 2) : at + _SPAN]
            part.append((k, min(2, at), cut))
            size += len(cut)
            if size >= _SPAN:
                yield from _part_grams(part)
                part, size = [], 0
    if part:
        yield from _part_grams(part)


def _part_grams(part: list[tuple[int, int, str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    raw = np.frombuffer("\0".join(cut for _, _, cut in part).encode("utf-32-le", "replace"), np.uint32)
    length = np.array([len(cut) for _, _, cut in part], np.int64)
    first = np.cumsum(length + 1) - length - 1
    c = _fold()[raw].astype(np.uint64)
    letter = c != 32
    own = np.repeat(np.arange(len(part)), length + 1)[: len(c)]
    number, fresh = np.array([k for k, _, _ in part]), np.array([f for _, f, _ in part])
    place = np.arange(len(c)) - first[own]
    for n in ORDERS:
        count = len(c) - n + 1
        if count <= 0:
            continue
        h, any_letter = np.full(count, np.uint64(n)), np.zeros(count, bool)
        for k in range(n):
            h = (h + c[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
            any_letter |= letter[k : k + count]
        o, at = own[:count], place[:count]
        # Inside one text, and not counted by the part before.
        use = any_letter & (at + n <= length[o]) & (at >= np.maximum(0, fresh[o] - n + 1))
        yield number[o[use]], (h >> np.uint64(48)).astype(np.int64)[use]


def buckets(text: str) -> np.ndarray:
    """Bucket of every n-gram of the text, repeats included; empty if it has no letter."""
    found = [column for _, column in grams([text])]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities (one column more: the prior) from rows with a language.

    At most about per_language documents of each are read; the prior comes from all of them. Counts are
    added up on the executors; what comes back is at most languages x buckets rows.
    """
    spark = rows.sparkSession
    small_batches(spark)
    rows = keep_columns(rows, id_col, text_col, lang_col).filter(F.col(lang_col).isNotNull())
    labelled = {r[0]: r[1] for r in rows.groupBy(lang_col).count().limit(MOST_LANGUAGES + 1).collect()}
    if len(labelled) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(labelled)
    if not languages:
        return [], np.zeros((0, BUCKETS + 1), np.float32)
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / labelled[k])))])
    chosen = rows.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < share[F.col(lang_col)] * (1 << 20))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {k: np.zeros(BUCKETS, np.int64) for k in languages}
        for pdf in batches:
            number = {k: i for i, k in enumerate(languages)}
            langs = np.array([number[k] for k in pdf[lang_col]], np.int64)
            for rows_, columns in grams(pdf[text_col].fillna("").tolist()):
                for i in np.unique(langs[rows_]):
                    total[languages[i]] += np.bincount(columns[langs[rows_] == i], minlength=BUCKETS)
        for k, x in total.items():
            hit = np.flatnonzero(x)
            if len(hit):
                yield pd.DataFrame({"lang": k, "bucket": hit, "n": x[hit]})

    counts = chosen.select(text_col, lang_col).mapInPandas(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    matrix = np.full((len(languages), BUCKETS), SMOOTHING)
    matrix[counts["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy(int), counts["bucket"].to_numpy(int)] += counts["n"].to_numpy(float)
    prior = np.array([labelled[k] for k in languages], float)
    logs = np.log(matrix / matrix.sum(axis=1, keepdims=True))
    return languages, np.hstack([logs, np.log(prior / prior.sum())[:, None]]).astype(np.float32)


def usual(model: tuple[list[str], np.ndarray]) -> np.ndarray:
    """By language, the mean log-probability of an n-gram over the text it was learned from."""
    logs = model[1][:, :BUCKETS].astype(np.float64)
    learned = np.exp(logs) - np.exp(logs.min(axis=1, keepdims=True))  # counts alone, without the smoothing
    total = learned.sum(axis=1)
    return np.where(total > 0, (learned * logs).sum(axis=1) / np.where(total > 0, total, 1), logs.mean(axis=1))


def score_batch(texts: list[str], logs_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: its log-likelihood by language (without the prior) and its number of n-grams. The sparse
    matrix of the batch times logs_of (a row for each bucket): rows are gathered and added up text by text,
    _CELLS numbers at a time."""
    total, hits = np.zeros((len(texts), logs_of.shape[1])), np.zeros(len(texts), np.int64)
    step = max(1, _CELLS // max(1, logs_of.shape[1]))
    for rows, columns in grams(texts):
        hits += np.bincount(rows, minlength=len(texts))
        for at in range(0, len(rows), step):
            r = rows[at : at + step]
            edge = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            total[r[edge]] += np.add.reduceat(logs_of[columns[at : at + step]], edge, axis=0, dtype=np.float64)
    return total, hits


def judge_batch(texts: list, languages: list[str], logs_of: np.ndarray) -> list[tuple[str, float, int | None, float | None]]:
    """Of each text: the likeliest language, its posterior, its number (none without a model) and the mean
    log-probability of an n-gram with the allowance for chance (none without a letter, 0 without a model)."""
    logs, hits = score_batch([t if isinstance(t, str) else "" for t in texts], logs_of[:BUCKETS])
    if not languages:
        return [(UNKNOWN, 0.0, None, 0.0 if n else None) for n in hits]
    both = logs + logs_of[BUCKETS]
    best = both.argmax(axis=1)
    top = both[np.arange(len(both)), best]
    sure = 1 / np.exp(both - top[:, None]).sum(axis=1)
    own = logs[np.arange(len(both)), best]
    return [(languages[k], float(p), int(k), float(x / n + CHANCE / n**0.5)) if n else (UNKNOWN, 0.0, None, None) for k, p, x, n in zip(best, sure, own, hits, strict=True)]


def classify(text: object, languages: list[str], logs_of: np.ndarray) -> tuple[str, float]:
    """The likeliest language of one text and its posterior; logs_of: a row for each bucket, the prior last."""
    return judge_batch([text], languages, logs_of)[0][:2]


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): the likeliest language and its posterior; `und` and 0 for a null text, one
    without a letter, or an empty model. Equal likelihoods: the first by name. Rows keep no order. Texts of any
    length are scored whole, part by part; rows that repeat have the same result; an empty table gives no rows;
    other columns aren't read."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model[0], np.ascontiguousarray(model[1].T)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            guess = judge_batch(pdf[text_col].tolist(), *shared.value)
            yield pd.DataFrame({id_col: pdf[id_col], "lang_pred": [g[0] for g in guess], "score": [g[1] for g in guess]})

    kind = docs.schema[id_col].dataType.simpleString()
    return keep_columns(docs, id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, lang_pred string, score double")


def label(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", fit_col: str | None = None) -> DataFrame:
    """The documents with all their columns (one named lang_pred or lang_score is replaced) and lang_pred, lang_score.

    fit_col, if named: the mean log-probability of the text's n-grams in that language, less what the text the
    language was learned from has, plus an allowance for short texts. It does not grow with the text, so it tells text of no learned language,
    whose posterior is near 1 all the same. Null without a letter, 0 if the model is empty."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model[0], np.ascontiguousarray(model[1].T), usual(model)))
    more = {"lang_pred": T.StringType(), "lang_score": T.DoubleType()} | ({fit_col: T.DoubleType()} if fit_col else {})
    columns = [c for c in docs.columns if c not in more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, logs_of, level = shared.value
        for batch in batches:
            guess = judge_batch(batch.column(columns.index(text_col)).to_pylist(), languages, logs_of)
            made = [pa.array([g[0] for g in guess], pa.string()), pa.array([g[1] for g in guess], pa.float64())]
            if fit_col:
                made.append(pa.array([g[3] if g[2] is None else g[3] - float(level[g[2]]) for g in guess], pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*columns, *more])

    schema = T.StructType([*(docs.schema[c] for c in columns), *(T.StructField(c, kind) for c, kind in more.items())])
    return keep_columns(docs, *columns).mapInArrow(run, schema)


def held_out(col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out() & F.col("doc_id").isNotNull()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
