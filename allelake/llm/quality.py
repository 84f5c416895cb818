"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``WORDS`` words. Each passage is encoded by the shares of byte classes, of repeated
words and of hashed byte pairs and triples. Gated attention (Ilse, Tomczak and Welling 2018) weighs the passages, a_k ~ exp(w . (tanh(V h_k) *
sigmoid(U h_k))), and the weighted passage representation is scored by a logistic unit. All weights are learned together
from document labels alone, by Adam on a bounded sample of labelled documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelake.llm import hashing as H
from allelake.llm.common import chunks, mapped, remainder_of_crc32

WORDS, HASHED, HIDDEN = 64, 128, 16
#: The fit takes a bounded sample of labelled documents, in order of a hash of doc_id: at most this many, and of texts whose
#: bytes together are at most these (one that no longer fits is left out). This bounds what goes to the driver (85 MB).
SAMPLE, SAMPLE_BYTES = 4_000, 32 << 20
#: First byte of each byte class - controls, space, signs, digits, signs, capitals, signs, small letters, signs, other characters.
CLASS_STARTS = [0, 32, 33, 48, 58, 65, 91, 97, 123, 128]
_CLASS = np.searchsorted(CLASS_STARTS, np.arange(256), "right") - 1
DIM = len(CLASS_STARTS) + 4 + 2 * HASHED


def passages(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encoded passages of all texts, end to end, and the first passage of each; a text without words has one."""
    starts, ends, first = H.spans(raw, offsets, H.PLAIN_WORDS)
    n = np.maximum(1, -(-np.diff(first) // WORDS))
    bounds = np.concatenate([[0], np.cumsum(n)])
    total = int(bounds[-1])
    edge = np.zeros(len(raw) + 1, np.int64)  # passages start with the text or with every WORDS-th word
    within = np.arange(len(starts)) - np.repeat(first[:-1], np.diff(first))
    edge[starts[(within % WORDS == 0) & (within > 0)]] = 1
    at = np.cumsum(edge[: len(raw)])
    text = np.repeat(np.arange(len(n)), np.diff(offsets))
    own = np.concatenate([[0], np.cumsum(n - 1)])
    passage = bounds[text] + at - own[text] if len(raw) else np.zeros(0, np.int64)
    size = np.maximum(1, np.bincount(passage, minlength=total))[:, None]
    count = lambda p, c, k: np.bincount(p * k + c, minlength=total * k).reshape(total, k)
    words = np.bincount(passage[starts], minlength=total)[:, None]
    parts = [count(passage, _CLASS[raw], len(CLASS_STARTS)) / size, np.log1p(words), np.minimum(size / (8.0 * np.maximum(words, 1)), 4)]
    word, own_passage = H.word_hashes(raw, starts, ends, H.byte_values(lower=True)), passage[starts]
    again = np.zeros(len(word), bool)  # the word before it, or any earlier one of its passage
    again[1:] = (word[1:] == word[:-1]) & (own_passage[1:] == own_passage[:-1])
    order = np.lexsort((word, own_passage))
    known = np.zeros(len(word), bool)
    known[1:] = (word[order][1:] == word[order][:-1]) & (own_passage[order][1:] == own_passage[order][:-1])
    parts += [np.bincount(own_passage[x], minlength=total)[:, None] / np.maximum(1, words) for x in (again, order[known])]
    x = raw.astype(np.uint32)
    for k in (2, 3):
        m = max(0, len(x) - k + 1)
        code = x[:m] * np.uint32(65_537)
        for j in range(1, k):
            code = code * np.uint32(257) + x[j : j + m]
        same = passage[:m] == passage[k - 1 :]
        bucket = ((code * np.uint32(2654435761)) >> np.uint32(25)).astype(np.int64)
        parts.append(np.sqrt(count(passage[:m][same], bucket[same], HASHED) / size))
    return np.concatenate(parts, 1).astype(np.float32), bounds


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def forward(p: dict[str, np.ndarray], h: np.ndarray, bounds: np.ndarray):
    """Scores of the bags (of standardised passages), and what the backward step needs."""
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (t * g) @ p["w"]
    n, lo = np.diff(bounds), bounds[:-1]
    a = np.exp(e - np.repeat(np.maximum.reduceat(e, lo), n))
    a /= np.repeat(np.add.reduceat(a, lo), n)
    z = np.add.reduceat(a[:, None] * h, lo)
    return _sigmoid(z @ p["c"] + p["b"]), (h, t, g, a, z)


def gradient(p: dict[str, np.ndarray], h: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the bags' mean cross-entropy."""
    score, (x, t, g, a, z) = forward(p, h, bounds)
    n, d = np.diff(bounds), (score - y) / len(y)
    da = (x @ p["c"]) * np.repeat(d, n)
    de = a * (da - np.repeat(np.add.reduceat(a * da, bounds[:-1]), n))
    dt, dg = np.outer(de, p["w"]) * g * (1 - t * t), np.outer(de, p["w"]) * t * g * (1 - g)
    return {"V": x.T @ dt, "U": x.T @ dg, "w": (t * g).T @ de, "c": z.T @ d, "b": np.array([d.sum()])}


def _scored(p: dict[str, np.ndarray], h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return forward(p, (h - p["mean"]) * p["scale"], bounds)[0]


def fit(h: np.ndarray, bounds: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 0.01, decay: float = 1e-4) -> dict[str, np.ndarray]:
    """Adam on the cross-entropy of the bags' labels; the same data give the same weights."""
    rng = np.random.default_rng(7)
    mean, scale = h.mean(0), 1 / (h.std(0) + 1e-3)
    h = (h - mean) * scale
    p = {"V": rng.normal(0, 0.05, (DIM, HIDDEN)), "U": rng.normal(0, 0.05, (DIM, HIDDEN)), "w": rng.normal(0, 0.05, HIDDEN), "c": np.zeros(DIM), "b": np.zeros(1)}
    p = {k: x.astype(np.float32) for k, x in p.items()}
    learned = ["V", "U", "w", "c", "b"]
    m, v, step = {k: np.zeros_like(p[k]) for k in learned}, {k: np.zeros_like(p[k]) for k in learned}, 0
    n = np.diff(bounds)
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            some = order[lo : lo + batch]
            rows = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in some])
            own = np.concatenate([[0], np.cumsum(n[some])])
            grad = gradient(p, h[rows], own, y[some])
            step += 1
            for k in learned:
                q = grad[k] + decay * p[k] * (k != "b")
                m[k], v[k] = 0.9 * m[k] + 0.1 * q, 0.999 * v[k] + 0.001 * q * q
                p[k] = p[k] - rate * 0.9**epoch * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p | {"mean": mean, "scale": scale}


def _encode(batches):
    for batch in batches:
        for lo, hi, raw, off in chunks(batch.column("text")):
            h, bounds = passages(raw, off)
            yield pa.RecordBatch.from_arrays(
                [batch.column("y").slice(lo, hi - lo), pa.array([h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["y", "h"]
            )


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out_fold: int = 0, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> dict[str, np.ndarray] | None:
    """Weights learned from labels of rows outside the held-out fold; None without any label.

    The fit takes at most ``sample`` labelled documents of at most ``sample_bytes`` bytes of text together, whole ones. Of
    several texts with one doc_id the shortest counts (of equal lengths, the one of the smallest hash).
    """
    known = labels.where("doc_id is not null and quality is not null").where(remainder_of_crc32("doc_id", folds) != held_out_fold).select("doc_id", F.col("quality").alias("y"))
    known = known.groupBy("doc_id").agg(F.avg("y").alias("y"))
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.struct(F.octet_length("text").alias("n"), F.xxhash64("text").alias("h")).alias("mark"))
    marks = texts.groupBy("doc_id").agg(F.min("mark").alias("mark")).join(known, "doc_id")
    some = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()  # at most ``sample`` rows of four numbers
    chosen, room = [], sample_bytes
    for r in some:
        if r["mark"]["n"] <= room:
            room -= r["mark"]["n"]
            chosen.append((r["doc_id"], r["mark"], r["y"]))
    chosen = docs.sparkSession.createDataFrame(chosen, marks.select("doc_id", "mark", "y").schema)
    texts = texts.join(F.broadcast(chosen), ["doc_id", "mark"]).dropDuplicates(["doc_id"])
    got = texts.select("y", "text").transform(mapped(_encode, "y double, h binary")).toArrow()
    if not got.num_rows:
        return None
    bags = [np.frombuffer(x, np.float32).reshape(-1, DIM) for x in got.column("h").to_pylist()]
    y = got.column("y").to_numpy()
    order = sorted(range(len(y)), key=lambda i: (y[i], bags[i].tobytes()[:4096]))  # whatever the order of rows
    bags = [bags[i] for i in order]
    return fit(np.concatenate(bags), np.concatenate([[0], np.cumsum([len(x) for x in bags])]), y[order])


def scores(weights: dict[str, np.ndarray] | None, text: pa.Array) -> np.ndarray:
    """Score of each text."""
    out = [np.zeros(0)]
    for _, _, raw, off in chunks(text):
        out.append(np.full(len(off) - 1, 0.5) if weights is None else _scored(weights, *passages(raw, off)).astype(np.float64))
    return np.clip(np.concatenate(out), 0, 1)


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out_fold: int = 0, threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Learns from ``labels`` (doc_id, quality) outside the fold crc32(doc_id as text) modulo ``folds`` = ``held_out_fold``,
    and scores whole texts alone. A null or empty text is one passage without words; without any label every score is
    0.5. Several labels of a document are averaged, null ones skipped; labels of unknown documents don't count. A null
    doc_id is not held out and never learned from; repeated rows are scored each; other columns are ignored; an empty table
    gives no rows.
    """
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds, held_out_fold))  # a fixed number of weights

    def run(batches):
        for batch in batches:
            s = scores(weights.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    fold = F.coalesce(remainder_of_crc32("doc_id", folds) == held_out_fold, F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", fold.alias("held_out"), "text").transform(mapped(run, f"doc_id {kind}, held_out boolean, score double, predicted int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs`` that score at least ``threshold``, with all their columns."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores(weights.value, batch.column("text")) >= threshold, pa.bool_()))

    return docs.transform(mapped(run, docs.schema))
