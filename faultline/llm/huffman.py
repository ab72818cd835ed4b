"""Token ids as files of canonical, length-limited Huffman codes.

A file set is a folder of three tables. ``blocks`` holds runs of documents in ascending order of their
ids; each block is decoded on its own: bits, the bit offset of every ``STEP``-th symbol, document ids and
lengths. ``lengths`` holds the code length of every id that occurs; canonical codes follow from it.
``index`` holds the position of each block's first id among all ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.bytebpe import char_ranges, encode_slices, word_cache
from faultline.llm.store import stored
from faultline.llm.textscan import text_buffer
from faultline.operators.scale import global_index, global_running_sum
from faultline.session import run_dir

#: longest code in bits; 2 ** MAX_BITS is the size of the decoding table
MAX_BITS = 18
#: symbols between two bit-offset checkpoints
STEP = 256
#: stands for a missing document id, which comes first
NO_ID = -(1 << 63)


# ---------------------------------------------------------------- code


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Best code lengths of at most ``limit`` bits for positive counts (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    levels, row = [], leaves
    is_leaf = np.ones(n, bool)
    for _ in range(limit - 1):
        levels.append(is_leaf)
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((leaves, pairs))
        order = np.argsort(both, kind="stable")
        row, is_leaf = both[order], order < n
    levels.append(is_leaf)
    lengths, take = np.zeros(n, np.uint8), 2 * n - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[used] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id), each the one before plus one, shifted to its length."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[used].astype(np.int64)
    top = int(size.max(initial=1))
    whole = np.cumsum(np.int64(1) << (top - size)) - (np.int64(1) << (top - size))
    codes = np.zeros(len(lengths), np.uint64)
    codes[used] = (whole >> (top - size)).astype(np.uint64)
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of all ids, and the bit offset of every STEP-th one."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    words = np.zeros((int(ends[-1]) + 31) // 32 + 1 if len(ids) else 0, np.uint64)
    if len(ids):
        at = starts >> 5
        value = codes[ids] << (64 - (starts & 31) - size).astype(np.uint64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        total = np.bitwise_or.reduceat(value, first)
        words[at[first]] |= total >> np.uint64(32)
        words[at[first] + 1] |= total & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes(), starts[::STEP].astype(np.uint32)


class Decoder:
    """Looks up MAX_BITS bits at a time; all checkpoints of a block advance together."""

    def __init__(self, lengths: np.ndarray):
        self.bits = int(lengths.max(initial=1))
        used = np.flatnonzero(lengths)
        used = used[np.argsort(lengths[used], kind="stable")]
        spans = 1 << (self.bits - lengths[used].astype(np.int64))
        self.symbol = np.zeros(1 << self.bits, np.uint32)
        self.size = np.ones(1 << self.bits, np.int64)
        filled = int(spans.sum())
        self.symbol[:filled] = np.repeat(used.astype(np.uint32), spans)
        self.size[:filled] = np.repeat(lengths[used].astype(np.int64), spans)

    def unpack(self, data: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        words = np.frombuffer(data, ">u4").astype(np.uint64)
        words = np.concatenate((words, np.zeros(STEP * self.bits // 32 + 2, np.uint64)))
        at = checkpoints.astype(np.int64)
        out = np.empty((STEP, len(at)), np.uint32)
        mask = np.uint64((1 << self.bits) - 1)
        for i in range(min(STEP, n)):
            word = at >> 5
            window = (words[word] << np.uint64(32)) | words[word + 1]
            window = (window >> (64 - self.bits - (at & 31)).astype(np.uint64)) & mask
            out[i] = self.symbol[window]
            at += self.size[window]
        return out.T.reshape(-1)[:n]


# ---------------------------------------------------------------- Spark


def _ordered_runs(docs: DataFrame) -> bool:
    """Whether the table's splits, each ascending, do not overlap: then no row has to move."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            where = batch.column(1).dictionary_encode().indices.to_numpy(), batch.column(2).to_numpy()
            cut = np.flatnonzero((ids[1:] < ids[:-1]) | (where[0][1:] != where[0][:-1]) | (where[1][1:] != where[1][:-1])) + 1
            first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(ids)])) - 1
            yield pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.array(ids[last])], ["first", "last"])

    found = docs.select("id", "file", "place").mapInArrow(runs, "first long, last long")
    found = global_index(found, ["first", "last"])
    after = found.select((F.col("idx") - 1).alias("idx"), F.col("first").alias("after"))
    return found.join(after, "idx").filter(F.col("last") > F.col("after")).isEmpty()


def _token_blocks(path: str, end_id: int):
    ranges = char_ranges()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, number = word_cache(path, ranges), TaskContext.get().partitionId() << 33
        small = cache.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            where = batch.column(2).dictionary_encode().indices.to_numpy(), batch.column(3).to_numpy()
            cut = np.flatnonzero((keys[1:] < keys[:-1]) | (where[0][1:] != where[0][:-1]) | (where[1][1:] != where[1][:-1])) + 1
            bounds = np.concatenate(([0], cut, [len(keys)]))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                data, offsets = text_buffer(batch.column(1).slice(a, b - a))
                for lo, hi, ids, counts in encode_slices(cache, data, offsets):
                    ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
                    own = keys[a + lo : a + hi]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "block": [number], "first": [int(own[0])], "last": [int(own[-1])], "n": [len(ids)],
                            "doc_ids": [own.tobytes()], "doc_sizes": [(counts + 1).astype(np.int64).tobytes()],
                            "wide": [not small], "ids": [ids.astype(np.uint16 if small else np.uint32).tobytes()],
                        }
                    )
                    number += 1

    return run


def _ids_of(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return np.frombuffer(batch["ids"][i].as_buffer(), np.uint32 if batch["wide"][i].as_py() else np.uint16)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1, np.int64)
    for batch in batches:
        for i in range(batch.num_rows):
            own = np.bincount(_ids_of(batch, i))
            if len(own) > len(total):
                own, total = total, own
            total[: len(own)] += own
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "count"])


def _packed(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = sent.value
        codes = canonical_codes(lengths)
        for batch in batches:
            done = [pack(_ids_of(batch, i), codes, lengths) for i in range(batch.num_rows)]
            cols = [batch[c] for c in ("block", "first", "last", "n", "doc_ids", "doc_sizes")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array([b for b, _ in done], pa.binary()), pa.array([c.tobytes() for _, c in done], pa.binary())],
                ["block", "first", "last", "n", "doc_ids", "doc_sizes", "bits", "checkpoints"],
            )

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Encode every text, end each document with ``end_id`` and write the file set into ``folder``.

    A null text is empty; a null id comes first; rows of equal id follow one another; extra columns are
    ignored; an empty table writes empty files. A table whose files are already in ascending order is
    not shuffled, any other is range partitioned by id first. Ids are kept once in the shared folder
    between counting and coding; counts are one row per id of the vocabulary on the driver.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    docs = docs.select(
        key.alias("id"), F.col(text_col).cast("string").alias("text"), F.input_file_name().alias("file"), F.input_file_block_start().alias("place")
    )
    if not _ordered_runs(docs):
        docs = docs.withColumns({"file": F.lit(""), "place": F.lit(0).cast("long")}).repartitionByRange("id").sortWithinPartitions("id", "text")
    blocks = stored(
        docs.mapInArrow(
            _token_blocks(tokenizer, end_id),
            "block long, first long, last long, n long, doc_ids binary, doc_sizes binary, wide boolean, ids binary",
        ),
        "ids",
        compression="zstd",
    )
    counts = blocks.select("wide", "ids").mapInArrow(_counts, "id long, count long").groupBy("id").agg(F.sum("count").alias("count")).toPandas()
    total = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.int64)
    total[counts["id"].to_numpy(np.int64)] = counts["count"].to_numpy(np.int64)
    lengths = code_lengths(total)
    used = np.flatnonzero(lengths)
    table = [(int(i), int(lengths[i])) for i in used]
    spark.createDataFrame(table, "id long, length int").coalesce(1).write.parquet(f"{folder}/lengths")
    packed = blocks.mapInArrow(
        _packed(spark.sparkContext.broadcast(lengths)),
        "block long, first long, last long, n long, doc_ids binary, doc_sizes binary, bits binary, checkpoints binary",
    )
    packed.write.parquet(f"{folder}/blocks", compression="zstd")
    order = spark.read.parquet(f"{folder}/blocks").select("block", "first", "last", "n")
    global_running_sum(order, ["first", "last", "block"], "n", "start").select("block", "start").write.parquet(f"{folder}/index")


def _unpacked(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value)
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch["n"][i].as_py()
                ids = decoder.unpack(batch["bits"][i].as_py(), np.frombuffer(batch["checkpoints"][i].as_py(), np.uint32), n)
                sizes = np.frombuffer(batch["doc_sizes"][i].as_py(), np.int64)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(sizes), batch["block"][i].as_py())),
                        pa.array(np.frombuffer(batch["doc_ids"][i].as_py(), np.int64)),
                        pa.array(ends - sizes),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.astype(np.int64))),
                    ],
                    ["block", "id", "at", "n_tokens", "ids"],
                )

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = batch["ids"].flatten().to_numpy().astype("<u4").tobytes()
        ends = np.concatenate(([0], np.cumsum(batch["n_tokens"].to_numpy()))) * 4
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*[batch[c] for c in ("block", "id", "at", "n_tokens")], pa.array(crc, pa.int64())], ["block", "id", "at", "n_tokens", "ids_crc32"]
        )


def read_tokens(spark: SparkSession, folder: str, digests: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) per document of a file set; with ``digests`` the crc32 of the ids
    as little-endian 32-bit integers stands in their place, and the ids never leave the Python worker."""
    found = spark.read.parquet(f"{folder}/lengths").toPandas()  # one row per id of the vocabulary
    lengths = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.uint8)
    lengths[found["id"].to_numpy(np.int64)] = found["length"].to_numpy(np.uint8)
    decode = _unpacked(spark.sparkContext.broadcast(lengths))
    blocks = spark.read.parquet(f"{folder}/blocks").select("block", "n", "doc_ids", "doc_sizes", "bits", "checkpoints")
    if digests:
        docs = blocks.mapInArrow(lambda b: _digests(decode(b)), "block long, id long, at long, n_tokens long, ids_crc32 long")
    else:
        docs = blocks.mapInArrow(decode, "block long, id long, at long, n_tokens long, ids array<long>")
    docs = docs.join(spark.read.parquet(f"{folder}/index"), "block")
    doc_id: Column = F.when(F.col("id") != NO_ID, F.col("id"))
    last = "ids_crc32" if digests else "ids"
    return docs.select(doc_id.alias("doc_id"), (F.col("start") + F.col("at")).alias("start"), "n_tokens", last)


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the file set of docs into the shared folder and read its digests back."""
    folder = run_dir(docs.sparkSession, "huffman")
    write_tokens(docs, folder, tokenizer, end_id=end_id)
    return read_tokens(docs.sparkSession, folder, digests=True)
