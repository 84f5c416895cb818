"""N-gram Jaccard join by parity sketches.

Every text becomes the set of its distinct word shingles (hashed to 64 bits). Shingles are dealt to the segments of a
sketch and XORed there: a shingle that only one of two sets holds changes one segment (and one bit of a plain bit
sketch), so the number of segments (or bits) that differ bounds the symmetric difference from below. Sets that link have
a symmetric difference of at most d, a number fixed by the largest size of their band; with more than d segments at least one is
equal (pigeonhole), so equal segments are joined, size band by size band: the segments find candidates, the plain bit
sketch only filters them by Hamming distance, and what is left is verified on the whole sets. The result is exact, apart
from collisions of 64-bit hashes.

An empty segment says nothing, so it is no key: bands have so many segments that it is rare for a set to have as many empty
ones as must equal a partner's. Small sets can't have that, so they are dealt several times, by other hashes; a set joins
by empty segments only if all its segmentations fail it.

No bucket is expanded into its pairs. Equal sets form one class first. Then each bucket links its members with its
smallest one only, and verified links are contracted to components. Buckets that still hold several components are compared
between components, in blocks of a bounded size; of the candidates between two components only the likeliest are verified,
and more of them in another round if those don't link.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelake.llm import hashing as H
from allelake.llm.common import chunks, discard, mapped, stage, work_dir
from allelake.llm.components import connected_components

U = np.uint64
#: Ratio of the largest to the smallest set size of a band.
BAND_RATIO = 1.6
#: Members of a bucket that one task compares with each other at once.
BLOCK = 512
#: Candidate ids up to this many bytes are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Segments and segmentations of a band are so many that a set joins by empty segments with at most this chance.
EMPTY_CHANCE = 1e-6
#: Candidates that a block gives for two components in the first round, and by how much more in each round that follows.
FIRST_CANDIDATES, MORE_CANDIDATES = 1, 4_096


def bands(most: int) -> np.ndarray:
    """Smallest set size of each band, up to sizes of ``most`` and one band more."""
    lows = [1]
    while lows[-1] <= most:
        lows.append(max(lows[-1], math.floor(lows[-1] * BAND_RATIO)) + 1)
    return np.array(lows, np.int64)


def difference(n: np.ndarray | int, percent: int):
    """The largest symmetric difference that a set of n shingles has with any set it links with."""
    return (100 - percent) * (n + 100 * n // percent) // (100 + percent)


def _log_chance(n: int, parts: int, differ: int) -> float:
    """Logarithm of a bound of the chance that n shingles use no more than ``differ`` of the segments."""
    if not differ:
        return -math.inf
    union = math.lgamma(parts + 1) - math.lgamma(differ + 1) - math.lgamma(parts - differ + 1) + n * math.log(differ / parts)
    empty, least = parts * math.exp(-n / parts), parts - differ
    return min(0.0, union, -empty + least * (1 + math.log(empty / least)) if 0 < empty < least else -math.inf if not empty else 0.0)


def _worst(low: int, high: int, parts: int, percent: int) -> float:
    sizes = range(low, high + 1) if high < 100 else np.linspace(low, high, 9).astype(np.int64).tolist()
    return max(_log_chance(n, parts, difference(n, percent)) for n in sizes)


@functools.lru_cache(maxsize=8)
def _plan(lows: tuple[int, ...], percent: int) -> tuple[list[int], list[int], list[int]]:
    differ, parts, deals, wanted = [], [], [], math.log(EMPTY_CHANCE)
    for low, high in zip(lows[:-1], (x - 1 for x in lows[1:]), strict=True):
        d = difference(high, percent)
        p, extra = d + 1, 0
        while d and extra < 64 + d // 4 and _worst(low, high, p, percent) > wanted:  # more segments: more may be equal
            extra = max(extra + 1, extra * 9 // 8)
            p = d + 1 + extra
        if d and _worst(low, high, p, percent) > wanted or extra > 8 + d // 4:  # a small set leaves too many empty
            p = 2 * d + 2
        worst = _worst(low, high, p, percent) if d else -math.inf
        differ.append(d)
        parts.append(p)
        deals.append(1 if worst <= wanted else min(8, math.ceil(wanted / min(worst, -1.0))))
    return differ, parts, deals


def segments(lows: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each band: the largest symmetric difference of two sets that link, the number of segments, and that of
    segmentations. They are so many that a set whose equal segments may all be empty, in every segmentation, is rarer
    than ``EMPTY_CHANCE``."""
    return tuple(np.array(x, np.int64) for x in _plan(tuple(lows.tolist()), percent))


def sketch_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the plain parity sketch of a set of n shingles: a power of two, at least 2 n and 64."""
    return 1 << np.ceil(np.log2(np.maximum(2 * n, 64))).astype(np.int64)


def _sets(batch: pa.RecordBatch, k: int):
    """(first row, row after, shingles, bounds) of runs of the batch's texts."""
    values = H.byte_values(lower=True)
    for lo, hi, raw, off in chunks(batch.column("text")):
        starts, ends, first = H.spans(raw, off, H.PLAIN_WORDS)
        tokens, bounds = H.shingle_sets(H.word_hashes(raw, starts, ends, values), first, k)
        yield lo, hi, tokens, bounds


def _per_text(ufunc, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bounds) - 1, values.dtype)
    full = bounds[:-1] < bounds[1:]
    if full.any():
        out[full] = ufunc.reduceat(values, bounds[:-1][full])
    return out


def _marks(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    return _per_text(np.add, H.mix(tokens, 21), bounds).view(np.int64), _per_text(np.bitwise_xor, H.mix(tokens, 22), bounds).view(np.int64)


def _fingerprint_batches(k: int):
    def run(batches):
        for batch in batches:
            for lo, hi, tokens, bounds in _sets(batch, k):
                sizes = np.diff(bounds)
                f1, f2 = _marks(tokens, bounds)
                bits = sketch_bits(sizes)
                at = np.concatenate([[0], np.cumsum(bits)])
                which = (H.mix(tokens, 23) & np.repeat((bits - 1).astype(U), sizes)).astype(np.int64) + np.repeat(at[:-1], sizes)
                flat = np.packbits((np.bincount(which, minlength=at[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
                sketches = [flat[a // 8 : b // 8] if n else b"" for a, b, n in zip(at[:-1], at[1:], sizes, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(f1), pa.array(f2), pa.array(sketches, pa.binary())],
                    ["doc_id", "n", "f1", "f2", "sketch"],
                )

    return run


def _key_batches(k: int, percent: int):
    def run(batches):
        seen: set[tuple[int, int]] = set()
        lows = bands(1 << 40)
        _, parts, deals = segments(lows, percent)
        highs = lows[1:] - 1
        for batch in batches:
            for lo, _, tokens, bounds in _sets(batch, k):
                f1, f2 = _marks(tokens, bounds)
                fresh = []
                for i, (n, a, b) in enumerate(zip(np.diff(bounds), f1.tolist(), f2.tolist(), strict=True)):
                    if n and (a, b) not in seen:  # copies met before in this task share all keys
                        seen.add((a, b))
                        fresh.append(i)
                if len(seen) > 200_000:
                    seen.clear()
                if not fresh:
                    continue
                sizes = np.diff(bounds)[fresh]
                own = np.searchsorted(lows, sizes, "right") - 1
                below = np.maximum(own - 1, 0)
                also = (own > 0) & (100 * highs[below] >= percent * sizes)  # some smaller partner is in the band below
                doc = np.concatenate([np.array(fresh), np.array(fresh)[also]])
                band = np.concatenate([own, below[also]])
                ids = batch.column("doc_id").slice(lo).to_numpy(zero_copy_only=False)
                step = max(1, int((1 << 19) // max(1, int(np.diff(bounds).mean()))))
                for s in range(0, len(doc), step):
                    yield from _keys_of(tokens, bounds, doc[s : s + step], band[s : s + step], percent, parts, deals, ids)

    return run


def _keys_of(tokens, bounds, doc, band, percent, parts, deals, ids):
    """Keys of the documents (some in two bands); a band's later segmentations are for sets that may need them and their partners."""
    empty_so_far = np.ones(len(doc), bool)  # whether all equal segments may be empty, in every segmentation so far
    for deal in range(int(deals[band].max(initial=0))):
        here = np.flatnonzero(deals[band] > deal)
        last = deals[band[here]] == deal + 1
        batch, may = _keys_of_deal(tokens, bounds, doc[here], band[here], percent, parts, ids, deal, last & empty_so_far[here])
        empty_so_far[here] &= may
        yield batch


def _keys_of_deal(tokens, bounds, doc, band, percent, parts, ids, deal: int, empty_keys: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
    sizes, n_parts = (bounds[1:] - bounds[:-1])[doc], parts[band]
    which = np.repeat(np.arange(len(doc)), sizes)
    within = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    t = tokens[bounds[doc][which] + within]
    at = np.concatenate([[0], np.cumsum(n_parts)])
    part = ((H.mix(t, 31 + 100 * deal) >> U(32)) * n_parts[which].astype(U) >> U(32)).astype(np.int64) + at[which]
    xor = np.zeros(at[-1], U)
    np.bitwise_xor.at(xor, part, H.mix(t, 32))
    used = np.bincount(part, minlength=at[-1]) > 0
    row = np.repeat(np.arange(len(doc)), n_parts)
    # At least n_parts - difference segments equal a partner's: where a set has as many empty ones, those may be all of them.
    may = np.bincount(row, weights=~used, minlength=len(doc)) >= n_parts - difference(sizes, percent)
    emit = used | (may & empty_keys)[row]
    number = np.arange(at[-1]) - at[:-1][row]
    key = H.mix(xor ^ H.mix((band[row].astype(U) << U(40)) + U(deal << 32) + number.astype(U), 33), 34)[emit]
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[doc[row[emit]]], pa.int64())], ["key", "doc_id"]), may


def _bucket_batches(batches):
    """From rows sorted by key and doc_id: (key, the bucket's first doc_id, doc_id) of all but the first of each bucket."""
    last, pivot, prior = None, None, None
    for batch in batches:
        key, doc = batch.column("key").to_numpy(), batch.column("doc_id").to_numpy()
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        new[0] = last is None or key[0] != last
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        head = np.where(first >= 0, doc[first], pivot if pivot is not None else 0)
        repeat = np.zeros(len(key), bool)
        repeat[1:] = (doc[1:] == doc[:-1]) & ~new[1:]
        repeat[0] = not new[0] and doc[0] == prior
        keep = ~new & ~repeat & (doc != head)
        last, pivot, prior = key[-1], head[-1], doc[-1]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(head[keep]), pa.array(doc[keep])], ["key", "pivot", "doc_id"])


def _set_batches(k: int):
    def run(batches):
        for batch in batches:
            for lo, hi, tokens, bounds in _sets(batch, k):
                f1, f2 = _marks(tokens, bounds)
                raw = tokens.tobytes()
                sets = [raw[8 * a : 8 * b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(f1), pa.array(f2), pa.array(sets, pa.binary())], ["node", "f1", "f2", "tokens"])

    return run


def _differing_bits(a: bytes, b: bytes) -> int:
    """Hamming distance of two parity sketches; the longer one is folded to the shorter one's length."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    if len(y) < len(x):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _may_link(n: int, m: int, sketch_n: bytes, sketch_m: bytes, percent: int) -> bool:
    return _differing_bits(sketch_n, sketch_m) <= (100 - percent) * (n + m) // (100 + percent)


def _sketch_test(percent: int):
    def run(batches):
        for batch in batches:
            c = [batch.column(x).to_pylist() for x in ("na", "nb", "sa", "sb")]
            keep = pa.array([_may_link(*x, percent) for x in zip(*c, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True):
                x, y = np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, longer ones folded to the shortest: what differs there differs unfolded."""
    words = min(len(x) for x in sketches) // 8
    out = np.empty((len(sketches), words), U)
    for i, x in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(x, U).reshape(-1, words), axis=0)
    return out


def _likeliest(a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray, share: np.ndarray, most: int) -> pa.Table:
    """Of the candidates between two components the ``most`` nearest ones, and whether there are more of them."""
    low, high = np.minimum(ca, cb), np.maximum(ca, cb)
    order = np.lexsort((b, a, share, high, low))
    low, high = low[order], high[order]
    new = np.ones(len(order), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(order)))
    keep = np.arange(len(order)) - np.repeat(head, size) < most
    return pa.table({"a": a[order][keep], "b": b[order][keep], "more": (np.repeat(size, size) > most)[keep]})


def _compare_block(percent: int, most: int):
    """Pairs of one block (or of two blocks of one bucket) that lie in different components and pass the Hamming test."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("node").to_numpy(), kind="stable")
        node, comp, n, block = (table.column(x).to_numpy()[order] for x in ("node", "component", "n", "block"))
        within = table.column("left")[0].as_py() == table.column("right")[0].as_py()
        sketch = _folded(table.column("sketch").to_pylist())[order]
        found, share = [np.zeros((2, 0), np.int64)], [np.zeros(0)]
        for i in range(len(node) - 1):
            j = slice(i + 1, None)
            near = (comp[j] != comp[i]) & (node[j] != node[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))
            if not within:
                near &= block[j] != block[i]
            near = i + 1 + np.flatnonzero(near)
            if len(near):
                bits = np.bitwise_count(sketch[near] ^ sketch[i]).sum(1, dtype=np.int64)
                good = bits <= (100 - percent) * (n[near] + n[i]) // (100 + percent)
                found.append(np.stack([np.full(good.sum(), i), near[good]]))
                share.append(bits[good] / (n[near[good]] + n[i]))
        i, j = np.concatenate(found, 1)
        return _likeliest(node[i], node[j], comp[i], comp[j], np.concatenate(share), most)

    return run


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, name: str = "jaccard") -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, in_class.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; the set of a text holds its distinct ``k``-word
    shingles, or its whole sequence if it has fewer words. Two texts link when 100 * intersection >= ``percent`` * union;
    component_id is the smallest doc_id reachable, and in_class the smallest doc_id with an equal set.

    Null or empty texts have an empty set (n_shingles 0), link with nothing and are their own component. A row whose
    doc_id is null keeps its n_shingles, links with nothing and has a null component_id. Rows that repeat a doc_id count as
    one document that has the links of all its texts. Other columns are ignored; an empty table gives no rows.
    """
    spark, path = docs.sparkSession, work_dir(docs.sparkSession, name)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = stage(docs.transform(mapped(_fingerprint_batches(k), "doc_id long, n long, f1 long, f2 long, sketch binary")), f"{path}/prints")
    known = prints.where("doc_id is not null and n > 0")
    # Classes are staged: a join with a plain table lets Spark split a class that holds a large share of all rows.
    classes = stage(known.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("node")), f"{path}/classes")
    members = stage(known.select("doc_id", "n", "f1", "f2").join(classes, ["n", "f1", "f2"]).select("doc_id", "node"), f"{path}/members")
    first_of = classes.withColumnRenamed("node", "doc_id")
    heads = known.join(first_of, ["doc_id", "n", "f1", "f2"]).dropDuplicates(["doc_id", "f1", "f2"]).select(F.col("doc_id").alias("node"), "n", "f1", "f2", "sketch")
    heads = stage(heads, f"{path}/heads")
    twice = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("a", "b")

    # Buckets: one shuffle of the segment keys; buckets of one document never leave their task.
    whole = docs.where("doc_id is not null")
    keys = whole.transform(mapped(_key_batches(k, percent), "key long, doc_id long"))
    buckets = keys.repartition("key").sortWithinPartitions("key", "doc_id").transform(mapped(_bucket_batches, "key long, pivot long, doc_id long"))
    buckets = stage(buckets, f"{path}/raw_buckets")
    node_of = members.select("doc_id", "node").distinct()
    named = (
        buckets.join(node_of, "doc_id").withColumnRenamed("node", "b").drop("doc_id")
        .join(node_of.withColumnRenamed("doc_id", "pivot").withColumnRenamed("node", "a"), "pivot").select("key", "a", "b").where("a <> b")
    )
    named = stage(named, f"{path}/buckets")
    discard(spark, f"{path}/raw_buckets")

    tested = stage(_links(named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), heads, docs, k, percent, f"{path}/stars"), f"{path}/star_links")
    links = tested.union(twice)
    found = stage(connected_components(links, f"{path}/first"), f"{path}/components")
    asked, still, most, step = None, None, FIRST_CANDIDATES, 0
    while True:
        step += 1
        own = f"{path}/round{step}"
        given = stage(_unresolved(named, found, still, heads, percent, most, own), f"{own}/given")
        discard(spark, f"{own}/labelled")
        fresh = given.select("a", "b") if asked is None else given.select("a", "b").join(asked, ["a", "b"], "left_anti")
        more = stage(_links(fresh, heads, docs, k, percent, own), f"{own}/links")
        if not more.isEmpty():
            links = links.union(more)
            found = stage(connected_components(links, f"{own}/steps"), f"{own}/components")
        apart = _apart(given.where("more"), found)
        still = stage(apart.select(F.col("ca").alias("cb")).union(apart.select("cb")).distinct(), f"{own}/still")
        if still.isEmpty():
            break
        asked = given.select("a", "b") if asked is None else asked.union(given.select("a", "b"))
        most *= MORE_CANDIDATES
    rows = prints.select("doc_id", "n", "f1", "f2").join(classes.withColumnRenamed("node", "in_class"), ["n", "f1", "f2"], "left").join(found.withColumnRenamed("node", "in_class"), "in_class", "left")
    own = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.otherwise(F.coalesce("component", "in_class")).alias("component_id"), own.otherwise(F.col("in_class")).alias("in_class"))


def _links(pairs: DataFrame, heads: DataFrame, docs: DataFrame, k: int, percent: int, path: str) -> DataFrame:
    """Those of the candidate ``pairs`` (a < b) that link: sizes, then Hamming distances of sketches, then whole sets."""
    side = lambda x: heads.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    near = stage(near.transform(mapped(_sketch_test(percent), "a long, b long")).distinct(), f"{path}/near")
    wanted = stage(near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct(), f"{path}/wanted")
    small = wanted.count() * 8 <= BROADCAST_BYTES
    texts = docs.join(F.broadcast(wanted) if small else wanted, "doc_id", "left_semi")
    sets = texts.transform(mapped(_set_batches(k), "node long, f1 long, f2 long, tokens binary"))
    sets = stage(sets.join(heads.select("node", "f1", "f2"), ["node", "f1", "f2"]).dropDuplicates(["node", "f1", "f2"]).select("node", "tokens"), f"{path}/sets")
    both = near.join(sets.withColumnRenamed("node", "b").withColumnRenamed("tokens", "tb"), "b").join(sets.withColumnRenamed("node", "a").withColumnRenamed("tokens", "ta"), "a")
    return both.transform(mapped(_verify(percent), "a long, b long")).distinct()


def _labelled(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """``pairs`` with the components ``ca`` and ``cb`` of a and b."""
    label = lambda x: components.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    return pairs.join(label("a"), "a", "left").join(label("b"), "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})


def _apart(pairs: DataFrame, components: DataFrame) -> DataFrame:
    return _labelled(pairs, components).where("ca <> cb")


def _unresolved(named: DataFrame, components: DataFrame, still: DataFrame | None, heads: DataFrame, percent: int, most: int, path: str) -> DataFrame:
    """Candidates between the components that still share a bucket (a bucket's smallest member is compared already): a, b,
    and whether a block had more than the ``most`` given for these two components. ``still`` are the components to compare
    (default: all)."""
    full = _labelled(named.distinct(), components).select("key", "b", "cb")
    full = stage(full if still is None else full.join(still, "cb", "left_semi").select("key", "b", "cb"), f"{path}/labelled")
    open_keys = full.groupBy("key").agg(F.count("*").alias("m"), F.min("cb").alias("low"), F.max("cb").alias("high")).where("m >= 2 and low <> high")
    rows = full.join(open_keys, "key").select("key", F.col("b").alias("node"), F.col("cb").alias("component"), "m")
    n_blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), n_blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    rows = rows.select("key", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "node", "component")
    rows = rows.join(heads.select("node", "n", "sketch"), "node").select("key", "left", "right", "block", "node", "component", "n", "sketch")
    pairs = rows.groupBy("key", "left", "right").applyInArrow(_compare_block(percent, most), "a long, b long, more boolean")
    return pairs.groupBy("a", "b").agg(F.max("more").alias("more"))
