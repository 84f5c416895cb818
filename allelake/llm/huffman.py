"""Token ids as canonical, length-limited Huffman codes in independent blocks.

A data set is a folder of ``.huf`` files and one ``codebook``. Code lengths come from the counts of all ids of the corpus
(package-merge, at most ``MAX_LENGTH`` bits), codes are canonical, so the lengths alone are the codebook. A file holds the
ids of documents in order, cut into blocks of ``BLOCK_IDS`` ids that can be decoded by themselves; a block lists the bit
offset of every ``CHECKPOINT``-th id, so a reader can start at any of them, and decoding runs from all checkpoints at once
with one table lookup for each id.

File: ``ALKHUF1\\n``, blocks, the document table and block index (zlib), then the two parts' places and sizes. A block: four
little-endian unsigned 32-bit integers (ids, checkpoint distance, checkpoints, payload bytes), the checkpoints, the payload.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelake.llm.common import filesystem, mapped, stage, work_dir
from allelake.llm.tokens import encoded

#: Longest code, ids of a block, ids between checkpoints, partitions whose counts are added at once.
MAX_LENGTH, BLOCK_IDS, CHECKPOINT, MERGE = 20, 65_536, 128, 32
MAGIC = b"ALKHUF1\n"


def code_lengths(counts: np.ndarray, most: int = MAX_LENGTH) -> np.ndarray:
    """Length of each symbol's code (0: never seen), at most ``most``, with the smallest total by package-merge."""
    lengths = np.zeros(len(counts), np.uint8)
    seen = np.flatnonzero(counts)
    if len(seen) <= 1:
        lengths[seen] = 1
        return lengths
    if len(seen) > 1 << most:
        raise ValueError(f"{len(seen)} symbols don't fit in codes of {most} bits")
    order = seen[np.argsort(counts[seen], kind="stable")]
    weights = counts[order].astype(np.float64)
    level, leaf = weights, [np.ones(len(order), bool)]
    for _ in range(most - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        leaf.append(rank < len(weights))
    take = 2 * len(order) - 2
    for is_leaf in reversed(leaf):
        leaves = int(is_leaf[:take].sum())
        lengths[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        code <<= n - last
        last = n
        here = np.flatnonzero(lengths == n)
        codes[here] = code + np.arange(len(here))
        code += len(here)
    return codes


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    """One block, header included."""
    n = lengths[ids].astype(np.int64)
    end = np.cumsum(n)
    start = end - n
    bits = int(end[-1]) if len(ids) else 0
    words = np.zeros(bits // 32 + 2, np.uint64)
    placed = codes[ids] << (64 - n - (start & 31)).astype(np.uint64)
    np.add.at(words, start >> 5, placed >> np.uint64(32))
    np.add.at(words, (start >> 5) + 1, placed & np.uint64(0xFFFFFFFF))
    payload = words.astype(">u4").tobytes()[: (bits + 7) // 8]
    marks = start[::CHECKPOINT].astype("<u4")
    return struct.pack("<4I", len(ids), CHECKPOINT, len(marks), len(payload)) + marks.tobytes() + payload


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For every value of the next ``width`` bits: symbol * 32 + length."""
    width = max(1, int(lengths.max(initial=0)))
    codes = canonical_codes(lengths)
    table = np.zeros(1 << width, np.int64)
    order = np.flatnonzero(lengths)
    order = order[np.lexsort((order, lengths[order]))]
    spans = 1 << (width - lengths[order].astype(np.int64))
    firsts = codes[order].astype(np.int64) << (width - lengths[order].astype(np.int64))
    if len(order):
        filled = np.repeat(order * 32 + lengths[order], spans)
        table[firsts[0] : firsts[0] + len(filled)] = filled
    return table, width


def decode_block(data: memoryview | bytes, table: np.ndarray, width: int, first: int = 0) -> np.ndarray:
    """Ids of a block from checkpoint ``first`` on."""
    n, every, n_marks, size = struct.unpack_from("<4I", data, 0)
    if not n:
        return np.zeros(0, np.int64)
    marks = np.frombuffer(data, "<u4", n_marks, 16)[first:].astype(np.int64)
    raw = np.zeros(size + 8, np.int64)
    raw[:size] = np.frombuffer(data, np.uint8, size, 16 + 4 * n_marks)
    window = (raw[:-4] << 32) | (raw[1:-3] << 24) | (raw[2:-2] << 16) | (raw[3:-1] << 8) | raw[4:]
    out = np.zeros((every, len(marks)), np.int64)
    at, mask, lanes = marks, (1 << width) - 1, len(marks)
    rest = n - (first + lanes - 1) * every
    for step in range(every):
        if step == rest:  # the last lane is shorter
            at = at[:-1]
            lanes -= 1
            if not lanes:
                break
        entry = table[(window[at >> 3] >> (40 - width - (at & 7))) & mask]
        out[step, :lanes] = entry >> 5
        at = at + (entry & 31)
    return out.T.ravel()[: n - first * every]


MANIFEST = "part int, path string, n_docs long, n_tokens long, ids array<int>, counts array<long>"


def _write_raw(tokenizer: str, end_id: int, folder: str):
    """Ids of a partition's documents in a staged file of zstd chunks, and how often each id occurs."""

    def run(batches):
        fs, root = filesystem(folder)
        part = TaskContext.get().partitionId()
        path = f"{root}/{part:06d}-{uuid.uuid4().hex}.ids"
        counts, n_docs, n_tokens, codec = np.zeros(1, np.int64), 0, 0, pa.Codec("zstd", 1)
        out = None
        for batch in batches:
            for lo, hi, ids, bounds in encoded(batch.column("text"), tokenizer, end_id):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(path)
                ids = ids.astype("<u4")
                docs = pa.array(batch.column("doc_id").slice(lo, hi - lo))
                known, names = docs.is_valid().to_numpy(zero_copy_only=False), docs.fill_null(0).to_numpy()
                low = ids.astype("<u2") if not len(ids) or ids.max() < 65_536 else ids
                body = low.tobytes() + names.astype("<i8").tobytes() + known.astype(np.uint8).tobytes() + np.diff(bounds).astype("<i8").tobytes()
                packed = codec.compress(body, asbytes=True)
                out.write(struct.pack("<4I", len(ids), low.itemsize, len(names), len(packed)) + packed)
                here = np.bincount(ids)
                if len(here) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(here) - len(counts), np.int64)])
                counts[: len(here)] += here
                n_docs, n_tokens = n_docs + len(names), n_tokens + len(ids)
        if out is None:
            return
        out.close()
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([path]), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64()), pa.array([used.astype(np.int32)], pa.list_(pa.int32())), pa.array([counts[used]], pa.list_(pa.int64()))],
            ["part", "path", "n_docs", "n_tokens", "ids", "counts"],
        )

    return run


def _sum_counts(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of counts from many, added up as they come."""
    total = np.zeros(1, np.int64)
    for batch in batches:
        for ids, counts in zip(batch.column("ids"), batch.column("counts"), strict=True):
            total = _added(total, ids.values.to_numpy(), counts.values.to_numpy())
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([used.astype(np.int32)], pa.list_(pa.int32())), pa.array([total[used]], pa.list_(pa.int64()))], ["part", "ids", "counts"])


def _added(total: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if len(ids) and ids[-1] >= len(total):
        total = np.concatenate([total, np.zeros(int(ids[-1]) + 1 - len(total), np.int64)])
    total[ids] += counts
    return total


def _total_counts(parts: DataFrame) -> np.ndarray:
    """Count of every id: partitions' counts are added in groups of ``MERGE``, level by level, the last ``MERGE`` here."""
    rows, n = parts.select("part", "ids", "counts"), parts.count()
    while n > MERGE:
        n = -(-n // MERGE)
        rows = rows.withColumn("part", F.pmod("part", F.lit(n))).groupBy("part").applyInArrow(_sum_counts, "part int, ids array<int>, counts array<long>")
    total = np.zeros(1, np.int64)
    for batch in rows.toArrow().to_batches():
        for ids, counts in zip(batch.column("ids"), batch.column("counts"), strict=True):
            total = _added(total, ids.values.to_numpy(), counts.values.to_numpy())
    return total


def _read_raw(fs, path: str):
    codec = pa.Codec("zstd")
    with fs.open_input_stream(path) as f:
        while head := f.read(16):
            n, width, docs, size = struct.unpack("<4I", head)
            body = codec.decompress(f.read(size), decompressed_size=n * width + 17 * docs, asbytes=True)
            ids = np.frombuffer(body, f"<u{width}", n).astype(np.int64)
            at = n * width
            yield ids, np.frombuffer(body, "<i8", docs, at), np.frombuffer(body, np.uint8, docs, at + 8 * docs), np.frombuffer(body, "<i8", docs, at + 9 * docs)


def _write_coded(folder: str, lengths: np.ndarray):
    def run(batches):
        fs, root = filesystem(folder)
        codes = canonical_codes(lengths)
        for batch in batches:
            for raw, begin in zip(batch.column("path").to_pylist(), batch.column("begin").to_pylist(), strict=True):
                path = f"{root}/{uuid.uuid4().hex}.huf"
                fs.create_dir(root, recursive=True)
                left, blocks, tables, at = np.zeros(0, np.int64), [], [], len(MAGIC)
                with fs.open_output_stream(path) as out:
                    out.write(MAGIC)
                    for ids, *docs in _read_raw(fs, raw):
                        tables.append([np.asarray(x) for x in docs])
                        left = np.concatenate([left, ids])
                        while len(left) >= BLOCK_IDS:
                            block = encode_block(left[:BLOCK_IDS], lengths, codes)
                            out.write(block)
                            blocks.append(at)
                            at, left = at + len(block), left[BLOCK_IDS:]
                    if len(left):
                        block = encode_block(left, lengths, codes)
                        out.write(block)
                        blocks.append(at)
                        at += len(block)
                    names, known, sizes = (np.concatenate(x) for x in zip(*tables, strict=True))
                    table = zlib.compress(names.tobytes() + known.tobytes() + sizes.tobytes(), 1)
                    index = zlib.compress(np.array([*blocks, at], "<i8").tobytes(), 1)
                    out.write(table + index + struct.pack("<6q", len(names), len(blocks), begin, at, len(table), len(index)))
                    size = at + len(table) + len(index) + 48
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([begin], pa.int64()), pa.array([size], pa.int64())], ["path", "begin", "bytes"])

    return run


def _read_coded(folder: str):
    """Documents of whole files, block by block: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        fs, root = filesystem(folder)
        with fs.open_input_stream(f"{root}/codebook") as f:
            lengths = np.frombuffer(zlib.decompress(f.read()), np.uint8)
        table, width = decoding_table(lengths)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with fs.open_input_file(path) as f:
                    end = f.size()
                    f.seek(end - 48)
                    n_docs, n_blocks, begin, at, table_size, index_size = struct.unpack("<6q", f.read(48))
                    f.seek(at)
                    body, index = zlib.decompress(f.read(table_size)), np.frombuffer(zlib.decompress(f.read(index_size)), "<i8")
                    names, known, sizes = np.frombuffer(body, "<i8", n_docs), np.frombuffer(body, np.uint8, n_docs, 8 * n_docs), np.frombuffer(body, "<i8", n_docs, 9 * n_docs)
                    ends = np.cumsum(sizes)
                    crc, done, have, doc = np.zeros(n_docs, np.int64), 0, 0, 0
                    for a, b in zip(index[:-1].tolist(), index[1:].tolist(), strict=True):
                        f.seek(a)
                        ids = decode_block(f.read(b - a), table, width).astype("<u4")
                        have = done + len(ids)
                        at_id = done
                        while doc < n_docs and at_id < have:
                            stop = min(int(ends[doc]), have)
                            crc[doc] = zlib.crc32(ids[at_id - done : stop - done], int(crc[doc]))
                            at_id = stop
                            if stop == ends[doc]:
                                doc += 1
                        done = have
                    if done != (ends[-1] if n_docs else 0):
                        raise ValueError(f"{path}: {done} ids, {ends[-1]} expected")
                yield pa.RecordBatch.from_arrays([pa.array(names, mask=known == 0), pa.array(begin + ends - sizes), pa.array(sizes), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, max_length: int = MAX_LENGTH) -> DataFrame:
    """Write ``docs`` (doc_id, text) as a data set in ``folder``; gives its files (path, begin, bytes).

    Documents are in ascending doc_id order over all files (null first, repeated ids by text), each followed by ``end_id``;
    a null text is empty. To the driver go at most ``MERGE`` rows of counts (no longer than the vocabulary) and one row per partition.
    """
    spark = docs.sparkSession
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    raw = stage(ordered.transform(mapped(_write_raw(tokenizer, end_id, f"{folder}/raw"), MANIFEST, owner="tokens")), f"{folder}/parts")
    lengths = code_lengths(_total_counts(raw), max_length)
    _put(spark, f"{folder}/codebook", zlib.compress(lengths.tobytes()))
    parts, begin, rows = raw.select("part", "path", "n_tokens").orderBy("part").collect(), 0, []
    for r in parts:
        rows.append((r["path"], begin))
        begin += r["n_tokens"]
    todo = _spread(spark, rows, "path string, begin long")
    book = spark.sparkContext.broadcast(lengths)  # one byte for each id of the vocabulary
    return stage(todo.transform(mapped(lambda batches: _write_coded(folder, book.value)(batches), "path string, begin long, bytes long")), f"{folder}/files")


def _spread(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A few rows, one to a partition."""
    kinds = T._parse_datatype_string(schema) if hasattr(T, "_parse_datatype_string") else schema
    if not rows:
        return spark.createDataFrame([], kinds)
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), kinds)


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file from the driver with Hadoop's file system, which knows every store that Spark knows."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(data))
    out.close()


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """Decode a data set: doc_id, start (ids before it), n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids)."""
    spread = files.select("path").repartition(max(1, files.count()), "path")
    return spread.transform(mapped(_read_coded(folder), "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, name: str = "tokens") -> DataFrame:
    """Write ``docs`` as token files, read them back: one row per row of ``docs``.

    A null doc_id comes first in the order and stays null; repeated doc_ids stay separate rows. Other columns are ignored;
    an empty table gives no rows.
    """
    folder = work_dir(docs.sparkSession, name)
    return read_token_files(write_token_files(docs, tokenizer, folder, end_id), folder)
