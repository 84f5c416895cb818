"""Vector best-fit packing of tokenised documents into sequences.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared piece lengths, which is what
attention within documents costs). Pieces are placed longest first; of the open sequences in which a piece fits under every
capacity, the one is taken that leaves the smallest weighted norm of the residual vector (rule ``norm``), or that has the
largest weighted dot product of the piece with the share of each capacity in use (rule ``dot``).

Pieces are dealt at random (by a hash) to shards of about ``SHARD_PIECES``, packed in parallel; a shard can leave one
sequence more than needed half full, and its work and memory don't depend on the size of the corpus.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelake.llm.common import mapped, stage, work_dir
from allelake.llm.tokens import encoded

SHARD_PIECES = 32_768
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(tokenizer: str, end_id: int, most: int, with_ids: bool):
    def run(batches):
        for batch in batches:
            for lo, _, ids, bounds in encoded(batch.column("text"), tokenizer, end_id):
                ids = ids.astype("<u4")
                sizes = np.diff(bounds)
                n = -(-sizes // most)
                row = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * most
                length = np.minimum(sizes[row] - start, most)
                a = bounds[row] + start
                crc = [zlib.crc32(ids[i : i + m]) for i, m in zip(a.tolist(), length.tolist(), strict=True)]
                columns = [batch.column("doc_id").take(pa.array(lo + row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array([ids[i : i + m] for i, m in zip(a, length, strict=True)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return run


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; ``lengths`` must be in the order of placing. Every capacity holds in every bin."""
    cap = np.array(capacity, np.float64)
    w = np.array(weights)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    least = np.minimum.accumulate(lengths[::-1])[::-1] if len(lengths) else lengths
    room = np.zeros((3, 1024))  # residual capacities of the open bins
    number, n_open, n_bins = np.zeros(1024, np.int64), 0, 0
    for i, m in enumerate(lengths.tolist()):
        need = np.array([m, 1.0, float(m) * m])
        r = room[:, :n_open]
        fits = np.flatnonzero((r[0] >= need[0]) & (r[1] >= need[1]) & (r[2] >= need[2]))
        if len(fits):
            if rule == "norm":
                score = -(((r[:, fits] - need[:, None]) / cap[:, None]) ** 2 * w[:, None]).sum(0)
            else:
                score = ((1 - r[:, fits] / cap[:, None]) * (need / cap * w)[:, None]).sum(0)
            at = fits[np.argmax(score)]
        else:
            if n_open == room.shape[1]:
                room, number = np.concatenate([room, np.zeros_like(room)], 1), np.concatenate([number, np.zeros_like(number)])
            at, n_open = n_open, n_open + 1
            room[:, at], number[at] = cap, n_bins
            n_bins += 1
        bins[i], offsets[i] = number[at], capacity[0] - room[0, at]
        room[:, at] -= need
        if room[0, at] < least[i] or room[1, at] < 1:  # nothing to come fits: closed
            n_open -= 1
            room[:, at], number[at] = room[:, n_open], number[n_open]
    return bins, offsets


def _pack_shard(capacity, weights, rule):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.drop_columns("shard").sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = best_fit(table.column("length").to_numpy(), capacity, weights, rule)
        return table.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 1, max_tokens: int = 4096, max_documents: int | None = None, max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm", with_ids: bool = False, shard_pieces: int = SHARD_PIECES, name: str = "packing",
) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document's ids end with ``end_id``; only documents longer than ``max_tokens`` are cut, into pieces of that size and a
    rest. ``max_documents`` and ``max_attention`` default to values that never bind before the tokens do; every capacity
    holds in every sequence. A piece whose squared length alone is over ``max_attention`` can't be placed: a ValueError, as
    are capacities below 1. A null text is an empty one, whose only id is ``end_id``. Rows with a null or repeated doc_id are
    packed like any other (a row that repeats any number of times is dealt to all shards); other columns are ignored; an
    empty table gives no rows. Within a shard, ties are broken by doc_id, piece and ids.
    """
    capacity = tuple(value if x is None else x for x, value in ((max_tokens, 0), (max_documents, max_tokens), (max_attention, max_tokens**2)))
    if min(capacity) < 1:
        raise ValueError("capacities must be 1 at least")
    path = work_dir(docs.sparkSession, name)
    schema = PIECE + (", ids array<long>" if with_ids else "")
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(mapped(_pieces(tokenizer, end_id, max_tokens, with_ids), schema, owner="tokens"))
    pieces = stage(pieces, f"{path}/pieces")
    count, longest = pieces.agg(F.count("*"), F.max("length")).first()
    if (longest or 0) ** 2 > capacity[2]:
        raise ValueError(f"a piece of {longest} tokens doesn't fit in an empty sequence of attention cost {capacity[2]}")
    shards = max(1, -(-count // shard_pieces))
    # The row's number spreads rows that repeat; it is that of the staged table, so a task that runs again deals alike.
    place = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    dealt = pieces.withColumn("shard", F.pmod(place, F.lit(shards)).cast("int"))
    light = dealt.drop("ids")
    packed = light.groupBy("shard").applyInArrow(_pack_shard(capacity, weights, rule), PIECE + ", sequence_id long, offset long")
    if not with_ids:
        return packed
    ids = pieces.select(F.col("doc_id").alias("_doc"), F.col("piece").alias("_piece"), F.col("ids_crc32").alias("_crc"), "ids").dropDuplicates(["_doc", "_piece", "_crc"])
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("piece") == F.col("_piece")) & (F.col("ids_crc32") == F.col("_crc"))
    return packed.join(ids, same).drop("_doc", "_piece", "_crc")
