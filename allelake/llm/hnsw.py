"""Nearest neighbours by largest inner product: a hierarchical navigable small-world graph for each shard.

Equal vectors are one node that keeps its smallest ids (as many as a result can show). Nodes are dealt to shards by a hash;
a shard is built by one task and stored as one file of flat arrays: vectors, the levels' members, and for each level the
neighbours as rows of fixed width. Vectors get one more component, sqrt(m^2 - |x|^2) with m the largest norm, which turns
the largest inner product into the nearest point. Levels are built from the top; nodes are inserted in batches, by a search
of the graph as it is, links are chosen among what the search finds by the usual rule (a candidate nearer to a chosen one
than to the node is left out), and made mutual. What tight clusters cut off from the rest is bridged. Queries go through
all shards in blocks, many queries at a time; results are scored in double precision on the original vectors and merged.
"""

from __future__ import annotations

import functools
import io
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from allelake.llm import hashing as H
from allelake.llm.common import filesystem, kept, stage, work_dir

#: Nodes of a shard, links of a node, places for bridges, candidates for links, nodes kept during a search, queries of a
#: block, blocks that a task searches in one shard.
SHARD_NODES, LINKS, BRIDGES, CANDIDATES, BEAM, QUERY_BLOCK, TASK_BLOCKS = 16_384, 20, 4, 64, 256, 256, 8


def _levels(names: np.ndarray) -> np.ndarray:
    u = (H.mix(names.astype(np.int64).view(np.uint64), 91) >> np.uint64(11)).astype(np.float64) / 2**53
    return np.floor(-np.log(np.maximum(u, 1e-18)) / math.log(LINKS)).astype(np.int64)


def _choose(x: np.ndarray, cand: np.ndarray, sim: np.ndarray, most: int, fill: int) -> np.ndarray:
    """Of each row's candidates (-1: none) up to ``most`` by the diversity rule, nearest first, then the nearest of the others
    up to ``fill`` in all; -1 where there are fewer."""
    order = np.argsort(-np.where(cand < 0, -np.inf, sim), axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    v = x[np.maximum(cand, 0)]
    between = v @ v.transpose(0, 2, 1)
    chosen = np.zeros(cand.shape, bool)
    for j in range(cand.shape[1]):
        blocked = (chosen & (between[:, j] > sim[:, j : j + 1])).any(1)
        chosen[:, j] = ~blocked & (chosen.sum(1) < most) & (cand[:, j] >= 0)
    for j in range(cand.shape[1]):
        chosen[:, j] |= (chosen.sum(1) < fill) & (cand[:, j] >= 0)
    first = np.argsort(~chosen, axis=1, kind="stable")[:, :most]
    return np.where(np.take_along_axis(chosen, first, 1), np.take_along_axis(cand, first, 1), -1)


def _once(cand: np.ndarray) -> np.ndarray:
    """Rows in ascending order without repeats (-1 in their place)."""
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    return cand


def _similar(x: np.ndarray, rows: np.ndarray, cand: np.ndarray) -> np.ndarray:
    return np.einsum("ad,ard->ar", x[rows], x[np.maximum(cand, 0)])


def _links(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Neighbours of each row of ``x`` (all of one norm), -1 where there are fewer: 2 * LINKS places and ``BRIDGES`` more.

    Rows are inserted in order, a batch at a time: each searches the graph of those before it, from its ``entry`` nodes
    (-1 or later ones: none) and the first row; it is also compared with its batch. Links go both ways, and a node with too
    many keeps a diverse choice of them. At last, what can't be reached from the first row is bridged to its nearest
    nodes that can.
    """
    n = len(x)
    out = np.full((n, 2 * LINKS + BRIDGES), -1, np.int32)
    graph = {"points": x, "links0": out, "where0": np.arange(n, dtype=np.int32)}
    done = 0
    while done < n:
        rows = np.arange(done, min(n, done + max(1, min(QUERY_BLOCK, done // 2))))
        cand = np.full((len(rows), 0), -1, np.int64)
        if done:
            start = np.where(entry[rows] < done, entry[rows], -1)
            cand = _beam(graph, 0, x[rows], np.concatenate([start, np.zeros((len(rows), 1), np.int64)], 1), CANDIDATES)
        if len(rows) > 1:  # of its own batch, the nearest ones
            own = x[rows] @ x[rows].T
            np.fill_diagonal(own, -np.inf)
            near = np.argsort(-own, axis=1, kind="stable")[:, : min(LINKS, len(rows) - 1)]
            cand = np.concatenate([cand, rows[near]], 1)
        done = int(rows[-1]) + 1
        if not cand.shape[1]:
            continue
        links = _choose(x, cand, _similar(x, rows, cand), LINKS, LINKS)
        out[rows, : links.shape[1]] = links
        source, target = np.repeat(rows, links.shape[1])[links.ravel() >= 0], links.ravel()[links.ravel() >= 0]
        _add_back(x, out, target, source)
    _bridge(x, out, graph)
    return out


def _add_back(x: np.ndarray, out: np.ndarray, target: np.ndarray, source: np.ndarray) -> None:
    """Links from ``target`` back to ``source``; nodes with more than 2 * LINKS choose anew."""
    order = np.lexsort((source, target))
    target, source = target[order], source[order]
    nodes, begin, count = np.unique(target, return_index=True, return_counts=True)
    for lo in range(0, len(nodes), QUERY_BLOCK):
        some, m = nodes[lo : lo + QUERY_BLOCK], count[lo : lo + QUERY_BLOCK]
        fresh = np.full((len(some), int(m.max())), -1, np.int64)
        at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        fresh[np.repeat(np.arange(len(some)), m), at] = source[begin[lo] : begin[lo] + m.sum()]
        cand = _once(np.concatenate([out[some, : 2 * LINKS].astype(np.int64), fresh], 1))
        sim = _similar(x, some, cand)
        if cand.shape[1] > 4 * LINKS:  # a hub is met by many at once: the nearest ones are enough to choose from
            best = np.argsort(-np.where(cand < 0, -np.inf, sim), axis=1, kind="stable")[:, : 4 * LINKS]
            cand, sim = np.take_along_axis(cand, best, 1), np.take_along_axis(sim, best, 1)
        full = (cand >= 0).sum(1) > 2 * LINKS
        kept = np.full((len(some), 2 * LINKS), -1, np.int64)
        if full.any():
            picked = _choose(x, cand[full], sim[full], 2 * LINKS, 2 * LINKS)
            kept[np.flatnonzero(full)[:, None], np.arange(picked.shape[1])] = picked
        few = np.flatnonzero(~full)
        first = np.argsort(cand[few] < 0, axis=1, kind="stable")[:, : 2 * LINKS]
        kept[few[:, None], np.arange(first.shape[1])] = np.take_along_axis(cand[few], first, 1)
        out[some, : 2 * LINKS] = kept


def _reach(out: np.ndarray, seen: np.ndarray, front: np.ndarray) -> None:
    while len(front):
        seen[front] = True
        after = np.unique(out[front])
        after = after[after >= 0]
        front = after[~seen[after]]


def _bridge(x: np.ndarray, out: np.ndarray, graph: dict) -> None:
    """Links to and from what can't be reached from the first row, in places kept for that."""
    seen = np.zeros(len(x), bool)
    _reach(out, seen, np.arange(min(1, len(x))))
    while not seen.all():
        u = int(np.flatnonzero(~seen)[0])
        near = _beam(graph, 0, x[u : u + 1], np.zeros((1, 1), np.int64), CANDIDATES)[0]
        near = near[near >= 0]
        free = near[(out[near, 2 * LINKS :] < 0).any(1)][:4]
        if not len(free):  # all bridges near are taken
            free = np.flatnonzero(seen & (out[:, 2 * LINKS :] < 0).any(1))[:1]
        for v in free.tolist():
            out[v, 2 * LINKS + int(np.argmax(out[v, 2 * LINKS :] < 0))] = u
        back = np.flatnonzero(out[u, 2 * LINKS :] < 0)
        if len(back):
            out[u, 2 * LINKS + back[0]] = free[0]
        _reach(out, seen, np.array([u]))


def build(vectors: np.ndarray, names: np.ndarray, norm: float) -> dict[str, np.ndarray]:
    """Flat arrays of a shard's graph; the same rows give the same graph."""
    x = vectors.astype(np.float64)
    rest = np.sqrt(np.maximum(0, norm**2 - (x * x).sum(1)))
    x = np.concatenate([x, rest[:, None]], 1).astype(np.float32)
    level = _levels(names)
    top = int(level.max(initial=0))
    out = {"vectors": vectors, "points": x, "levels": np.array([top])}
    order = np.lexsort((H.mix(names.astype(np.int64).view(np.uint64), 92), -level))  # nodes of higher levels come first
    for i in range(top, -1, -1):
        members = order[: int((level >= i).sum())]
        where = np.full(len(x) + 1, -1, np.int32)
        where[members] = np.arange(len(members))
        entry = np.full((len(members), 0), -1, np.int64)
        if i < top:  # the finished levels above lead to where the search of this level begins
            found = [_descend(out, x[members[lo : lo + QUERY_BLOCK]], i, 8)[:, :4] for lo in range(0, len(members), QUERY_BLOCK)]
            entry = where[np.concatenate(found)].astype(np.int64)
        own = _links(x[members], entry)
        out[f"members{i}"], out[f"where{i}"] = members.astype(np.int32), where[:-1]
        out[f"links{i}"] = np.where(own >= 0, members[own], -1).astype(np.int32)
    return out


def _descend(graph: dict, q: np.ndarray, level: int, width: int) -> np.ndarray:
    """Nodes nearest to each query on the level above ``level``, from the first node of the top."""
    top = int(graph["levels"][0])
    entry = np.broadcast_to(graph[f"members{top}"][:1].astype(np.int64), (len(q), 1))
    for i in range(top, level, -1):
        entry = _beam(graph, i, q, entry, width)
    return entry


def _beam(graph: dict, level: int, q: np.ndarray, entry: np.ndarray, width: int) -> np.ndarray:
    """The best ``width`` nodes found on a level for each query, best first (-1 where there are fewer)."""
    x, links, where = graph["points"], graph[f"links{level}"], graph[f"where{level}"]
    n, rows = len(x), np.arange(len(q))[:, None]
    seen = np.zeros((len(q), n + 1), bool)  # the last column stands for no node
    seen[:, n] = True
    pool = np.full((len(q), width), n, np.int64)
    sim = np.full((len(q), width), -np.inf, np.float32)
    done = np.ones((len(q), width), bool)
    fresh, first = np.where(entry < 0, n, entry), True
    some = np.arange(len(q))
    while True:
        fresh = np.sort(fresh, axis=1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = n
        fresh[seen[some[:, None], fresh]] = n
        seen[some[:, None], fresh] = True
        s = np.einsum("ad,ard->ar", q[some], x[np.minimum(fresh, n - 1)])
        s[fresh == n] = -np.inf
        all_nodes, all_sim = np.concatenate([pool[some], fresh], 1), np.concatenate([sim[some], s], 1)
        all_done = np.concatenate([done[some], fresh == n], 1)
        best = np.argpartition(-all_sim, width - 1, axis=1)[:, :width]
        pool[some], sim[some], done[some] = (np.take_along_axis(v, best, 1) for v in (all_nodes, all_sim, all_done))
        some = np.flatnonzero(~done.all(1))
        if not len(some):
            break
        open_sim = np.where(done[some], -np.inf, sim[some])
        step = np.argpartition(-open_sim, min(4, width - 1) - 1 if width > 1 else 0, axis=1)[:, :4]
        chosen = np.take_along_axis(pool[some], step, 1)
        chosen[np.take_along_axis(done[some], step, 1)] = n
        done[some[:, None], step] = True
        at = where[np.minimum(chosen, n - 1)]
        next_nodes = links[at]
        next_nodes = np.where((chosen[:, :, None] == n) | (next_nodes < 0), n, next_nodes)
        fresh = next_nodes.reshape(len(some), -1)
    order = np.argsort(-sim, axis=1, kind="stable")
    pool = np.take_along_axis(pool, order, 1)
    return np.where(pool == n, -1, pool)


def find(graph: dict, queries: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """The k nodes of largest inner product found for each query (-1 where there are fewer), and the products in double precision."""
    q = np.concatenate([queries, np.zeros((len(queries), 1))], 1).astype(np.float32)
    entry = _descend(graph, q, 0, 24)
    nodes = _beam(graph, 0, q, entry, max(beam, 2 * k))
    x = graph["vectors"].astype(np.float64)
    score = np.einsum("ad,ard->ar", queries.astype(np.float64), x[np.maximum(nodes, 0)])
    score[nodes < 0] = -np.inf
    order = np.lexsort((nodes, -score), axis=1)[:, :k]
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(score, order, 1)


def _matrix(column, kind=None) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if kind is None else values.reshape(len(flat), -1).astype(kind)


def _write_shard(folder: str):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        size, shard = (x.as_py() for x in key)
        table = table.sort_by("name")
        graph = build(_matrix(table.column("embedding")), table.column("name").to_numpy(), table.column("norm")[0].as_py())
        ids = table.column("ids").combine_chunks()
        graph |= {"ids": ids.flatten().to_numpy(), "ids_first": np.concatenate([[0], np.cumsum([len(x) for x in ids])])}
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        path = f"{root}/{uuid.uuid4().hex}.hnsw"
        body = io.BytesIO()
        np.savez(body, **graph)
        with fs.open_output_stream(path) as f:
            f.write(body.getvalue())
        return pa.table({"size": pa.array([size], pa.int32()), "shard": pa.array([shard], pa.int32()), "path": [path], "nodes": pa.array([len(table)], pa.int64())})

    return run


@functools.lru_cache(maxsize=1)
def _load(folder: str, path: str) -> dict[str, np.ndarray]:
    fs, _ = filesystem(folder)
    with fs.open_input_file(path) as f, np.load(io.BytesIO(f.read())) as arrays:
        return {k: arrays[k] for k in arrays.files}


kept("graph", _load.cache_clear)


def _search(folder: str, k: int):
    def run(table: pa.Table) -> pa.Table:
        graph = _load(folder, table.column("path")[0].as_py())
        names = table.column("name").to_numpy()
        nodes, scores = find(graph, _matrix(table.column("embedding"), np.float64), k)
        row, col = np.nonzero(nodes >= 0)
        node, first = nodes[row, col], graph["ids_first"]
        n = first[node + 1] - first[node]
        at = np.repeat(first[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out = np.repeat(row, n)
        ids, score = graph["ids"][at], np.repeat(scores[row, col], n)
        order = np.lexsort((ids, -score, out))  # no more than k of a shard can be in the result
        out, ids, score = out[order], ids[order], score[order]
        keep = np.arange(len(out)) - np.searchsorted(out, out) < k
        return pa.table({"name": names[out[keep]], "vec_id": ids[keep], "score": score[keep]})

    return run


def _usable(table: DataFrame) -> DataFrame:
    x = F.col("embedding")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), x).where(F.col("vec_id").isNotNull() & x.isNotNull()).where(whole & F.exists(x, lambda v: v != 0))


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20, shard_nodes: int = SHARD_NODES, name: str = "hnsw") -> DataFrame:
    """The ``k`` nearest vectors found for each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score.

    ``embeddings`` (vec_id, embedding: array of float or double). Nearness is the inner product, in double precision on the
    original vectors; ties go to the smaller vec_id; a query's own vec_id is no candidate. Null vectors, zero vectors,
    vectors with a null or non-finite component and rows with a null vec_id take no part; vectors are compared with those
    of the same length only. A vec_id that repeats with the same vector counts once; with fewer than ``k`` candidates all
    are given; other columns are ignored; an empty table gives no rows.
    """
    spark, folder = embeddings.sparkSession, work_dir(embeddings.sparkSession, name)
    rows = _usable(embeddings).groupBy("embedding", "vec_id").agg(F.lit(1).alias("one")).drop("one")
    few = rows.withColumn("r", F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    nodes = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k + 1 ids at most
    nodes = nodes.select(F.xxhash64("embedding").alias("hash"), F.col("ids")[0].alias("name"), "ids", "embedding", F.size("embedding").alias("size"))
    nodes = stage(nodes, f"{folder}/nodes")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    sizes = nodes.groupBy("size").agg(F.count("*").alias("n"), F.sqrt(F.max(square)).alias("norm")).select("size", "norm", F.ceil(F.col("n") / shard_nodes).cast("int").alias("shards"))
    sizes = F.broadcast(stage(sizes, f"{folder}/sizes"))  # a row for each length of vectors
    dealt = nodes.join(sizes, "size").withColumn("shard", F.pmod("hash", F.col("shards")).cast("int"))
    # Numbers of their own for both exchanges: adaptive execution goes by bytes, which say little about graphs and searches.
    shards = sizes.agg(F.sum("shards")).first()[0] or 1
    dealt = dealt.select("size", "shard", "norm", "name", "ids", "embedding").repartition(shards, "size", "shard")
    graphs = dealt.groupBy("size", "shard").applyInArrow(_write_shard(f"{folder}/shards"), "size int, shard int, path string, nodes long")
    graphs = stage(graphs, f"{folder}/graphs")

    wanted = rows.where(F.col("vec_id") % every == 0)
    # A query is known by its vector's node.
    asked = stage(wanted.withColumnRenamed("vec_id", "query_id").join(nodes.select("embedding", "name", "size"), "embedding").select("query_id", "name", "size", "embedding"), f"{folder}/asked")
    vectors = asked.groupBy("name", "size").agg(F.first("embedding").alias("embedding"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    sent = vectors.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int")).join(graphs, "size").select("block", "shard", "size", "path", "name", "embedding")
    # A task keeps one shard's graph and searches many blocks; a shard may be in several tasks.
    sent = sent.withColumn("part", F.pmod("block", F.lit(-(-blocks // TASK_BLOCKS)))).repartition(shards * -(-blocks // TASK_BLOCKS), "size", "shard", "part")
    found = sent.groupBy("size", "shard", "part", "block").applyInArrow(_search(f"{folder}/shards", k + 1), "name long, vec_id long, score double")
    best = W.partitionBy("name").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    pairs = asked.select("query_id", "name").join(found, "name").where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
