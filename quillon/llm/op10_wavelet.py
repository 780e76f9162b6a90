"""Token files as wavelet matrices: one compressed file for each shard of documents in ascending id order.

A shard holds its ids as bit planes. Plane by plane, from the high bit, ids with a 0 go stably before
those with a 1; ranks on the planes then give access, counts and places of an id without decoding.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.bpe import encoder
from quillon.llm.common import keep_columns, materialise, small_batches, table, work_path

MAGIC = b"WMX1"
#: Tokens after which a shard ends; documents are never split.
SHARD_TOKENS = 1 << 21
#: Bytes of input (by Spark's estimate) for each task beyond the session's partitions, and tasks at most.
PART_BYTES, MOST_PARTS = 1 << 27, 100_000
_WORD = 512


class WaveletMatrix:
    """Planes with rank directories. Places count from 0; rank(token, i) counts before place i."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros
        self._ones: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        level = np.asarray(ids, np.uint32)
        if len(level) and int(level.max()) >> bits:
            raise ValueError("an id needs more bits")
        if bits <= 16:
            level = level.astype(np.uint16)
        planes, zeros = [], []
        for k in range(bits - 1, -1, -1):
            bit = (level >> k & 1).astype(bool)
            planes.append(np.packbits(bit))
            low = level[~bit]
            zeros.append(len(low))
            level = np.concatenate([low, level[bit]])
        return cls(len(level), planes, zeros)

    def decode(self) -> np.ndarray:
        """All ids: the levels are undone from the last plane to the first."""
        out = np.zeros(self.n, np.uint32)
        for k, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bit = np.unpackbits(plane, count=self.n).astype(bool)
            level = np.empty(self.n, np.uint32)
            level[~bit] = out[:zeros]
            level[bit] = out[zeros:] | np.uint32(1 << k)
            out = level
        return out

    def _directory(self) -> list[np.ndarray]:
        if self._ones is None:
            self._ones = []
            for plane in self.planes:
                pad = np.zeros(-(-max(len(plane), 1) // (_WORD // 8)) * (_WORD // 8), np.uint8)
                pad[: len(plane)] = plane
                count = np.bitwise_count(pad).reshape(-1, _WORD // 8).sum(axis=1)
                self._ones.append(np.concatenate([[0], np.cumsum(count)]).astype(np.int64))
        return self._ones

    def _rank1(self, k: int, i: int) -> int:
        """Ones in plane k before place i: the directory's count, then at most 512 bits."""
        block = i // _WORD
        got = int(self._directory()[k][block])
        tail = self.planes[k][block * (_WORD // 8) : -(-i // 8)]
        if len(tail):
            count = np.bitwise_count(tail)
            got += int(count.sum())
            if i % 8:
                got -= int(np.bitwise_count(np.uint8(tail[-1] & (0xFF >> i % 8))))
        return got

    def access(self, i: int) -> int:
        value = 0
        for k, plane in enumerate(self.planes):
            bit = plane[i >> 3] >> (7 - (i & 7)) & 1
            ones = self._rank1(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | int(bit)
        return value

    def _range(self, token: int, stop: int) -> tuple[int, int]:
        low, high = 0, stop
        for k in range(len(self.planes)):
            a, b = self._rank1(k, low), self._rank1(k, high)
            if token >> (len(self.planes) - 1 - k) & 1:
                low, high = self.zeros[k] + a, self.zeros[k] + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, token: int, stop: int) -> int:
        low, high = self._range(token, stop) if not token >> len(self.planes) else (0, 0)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, nth: int) -> int:
        """Place of the nth occurrence, from 0: ranks are undone plane by plane with a binary search."""
        if nth < 0 or nth >= self.count(token):
            raise IndexError("no such occurrence")
        at = self._range(token, self.n)[0] + nth
        for k in range(len(self.planes) - 1, -1, -1):
            one = token >> (len(self.planes) - 1 - k) & 1
            want = at - self.zeros[k] if one else at
            low, high = 0, self.n
            while low < high:
                mid = (low + high) // 2
                ones = self._rank1(k, mid + 1)
                if (ones if one else mid + 1 - ones) > want:
                    high = mid
                else:
                    low = mid + 1
            at = low
        return at


def write_shard(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, bits: int) -> bytes:
    """The file: magic, header length, JSON header, then zstd blocks: document ids, sizes, planes."""
    wm = WaveletMatrix.build(ids, bits)
    press = zstandard.ZstdCompressor(level=1).compress
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    missing = np.packbits(np.array([d is None for d in doc_ids], bool))
    blocks = [press(b.tobytes()) for b in (known, missing, np.array(sizes, "<i8"), *wm.planes)]
    head = json.dumps({"n": wm.n, "bits": bits, "docs": len(doc_ids), "zeros": wm.zeros, "blocks": [len(b) for b in blocks]}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(blocks)


def read_shard(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, their sizes and the matrix of a shard file."""
    if data[:4] != MAGIC:
        raise ValueError("not a shard file")
    (size,) = struct.unpack_from("<I", data, 4)
    head = json.loads(data[8 : 8 + size])
    at, blocks = 8 + size, []
    for n in head["blocks"]:
        blocks.append(zstandard.ZstdDecompressor().decompress(data[at : at + n]))
        at += n
    missing = np.unpackbits(np.frombuffer(blocks[1], np.uint8), count=head["docs"]).astype(bool)
    docs = [None if m else int(d) for d, m in zip(np.frombuffer(blocks[0], "<i8"), missing, strict=True)]
    planes = [np.frombuffer(b, np.uint8) for b in blocks[3:]]
    return docs, np.frombuffer(blocks[2], "<i8"), WaveletMatrix(head["n"], planes, head["zeros"])


class WordIds:
    """Ids of a word-end tokenizer file. In texts of ASCII and Latin letters the ends of pieces are found in
    numpy and marked by a control byte, which stands for the vocabulary's word end; a rank encoder over the same
    vocabulary then gives the library's ids several times faster. Contractions, special tokens, other
    characters and control bytes go the exact way (bpe.py)."""

    MARK = 0x1F
    _OTHER = re.compile("[^\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]")
    _CONTRACTION = re.compile("'(?:s|t|re|ve|m|ll|d)", re.I)

    def __init__(self, tokenizer: str):
        import tiktoken

        self.exact = encoder(tokenizer)
        table_ = self.exact.table
        if not table_.suffix:
            raise ValueError("the tokenizer has no word ends")
        self.size = table_.size
        mark = bytes([self.MARK])
        ranks = {bytes(ord(c) & 255 for c in s) + (mark if ord(s[-1]) > 255 else b""): i for s, i in table_.vocab.items()}
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\x1f\t-\r ]+\x1f", mergeable_ranks=ranks, special_tokens={})
        #: Class of a byte: 0 white space, 1 letter or part of one, 2 digit, 3 other.
        self.kind = np.full(256, 3, np.uint8)
        self.kind[[9, 10, 11, 12, 13, 32]] = 0
        self.kind[[*range(97, 123), *range(128, 256)]] = 1
        self.kind[48:58] = 2

    def mark(self, low: str) -> str:
        a = np.frombuffer(low.encode(), np.uint8)
        kind = self.kind[a]
        end = (kind != 0) & ((kind == 2) | (np.append(kind[1:], 0) != kind))
        at = np.arange(len(a)) + np.cumsum(end) - end
        out = np.full(len(a) + int(end.sum()), self.MARK, np.uint8)
        out[at] = a
        return out.tobytes().decode()

    def __call__(self, text: str) -> np.ndarray:
        return np.concatenate([self._one(part) for part in self.exact.blocks(text)])

    def _one(self, text: str) -> np.ndarray:
        if self._OTHER.search(text) or "<|" in text or ("'" in text and self._CONTRACTION.search(text)):
            return np.array(next(self.exact.stream([text])), np.uint32)
        return self.fast.encode_to_numpy(self.mark(text.lower())) if text else np.zeros(0, np.uint32)


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(tokenizer: str) -> WordIds:
    if tokenizer not in _WORD_IDS:
        _WORD_IDS[tokenizer] = WordIds(tokenizer)
    return _WORD_IDS[tokenizer]


def _put(path: str, data: bytes) -> None:
    """Write a file of the shared folder; under its own name only when whole, so a task may run twice."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        store, where = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    else:
        store, where = fs.LocalFileSystem(), path
    store.create_dir(where.rsplit("/", 1)[0], recursive=True)
    part = f"{where}.{TaskContext.get().taskAttemptId()}.part"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, where)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes shards of documents in ascending id order below path; returns (shard, tokens, first) of each,
    first being the ids before the shard. Null ids come first; rows of one id stay together, in any order.
    Null text: as empty, a document of the end id alone. An empty table gives no shards. A very long text is encoded
    block by block and lies in one shard. Rows of one id, null ids included, are dealt by their texts, so many of
    them are many tasks' work. Only the two columns named are read."""
    spark = docs.sparkSession
    small_batches(spark, 500)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = word_ids(tokenizer)
        bits = max(1, int(encode.size - 1).bit_length())
        part, number = TaskContext.get().partitionId(), 0
        held_docs: list = []
        held: list[np.ndarray] = []
        total = 0

        def flush() -> pd.DataFrame:
            nonlocal held_docs, held, total, number
            name = f"shard-{part:06d}-{number:06d}.wmx"
            _put(f"{path}/{name}", write_shard(held_docs, [len(x) for x in held], np.concatenate(held), bits))
            row = pd.DataFrame([(name, part, number, total)], columns=["shard", "part", "number", "tokens"])
            held_docs, held, total, number = [], [], 0, number + 1
            return row

        for pdf in batches:
            ids = [None if pd.isna(x) else int(x) for x in pdf[id_col]]
            for i, text in zip(ids, pdf[text_col].fillna(""), strict=True):
                held_docs.append(i)
                held.append(np.append(encode(text), end_id).astype(np.uint16 if bits <= 16 else np.uint32))
                total += len(held[-1])
                if total >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    rows = keep_columns(docs, id_col, text_col)
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, size // PART_BYTES))
    place = F.col(id_col), F.xxhash64(text_col)
    ordered = rows.repartitionByRange(parts, *place).sortWithinPartitions(*place)
    shards = materialise(ordered.mapInPandas(run, "shard string, part int, number int, tokens bigint"), "shards")
    # Two prefix sums: over tasks (one row each), then over the shards of a task.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.groupBy("part").agg(F.sum("tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return shards.join(bases, "part").select("shard", "tokens", (F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("first"))


def read_token_files(spark: SparkSession, path: str, shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards, decoded from the files."""
    small_batches(spark, 500)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                docs, sizes, wm = read_shard(data)
                ids = wm.decode().astype("<u4")
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends, sizes, strict=True)]
                yield pd.DataFrame({"shard": name.rsplit("/", 1)[1], "doc_id": pd.array(docs, dtype="Int64"), "local": ends - sizes, "n_tokens": sizes, "ids_crc32": crc})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wmx").load(path).select("path", "content")
    rows = files.mapInPandas(run, "shard string, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(shards, "shard").select("doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = work_path(spark, "wavelet")
    shards = write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    if not shards.take(1):
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return read_token_files(spark, path, shards)
