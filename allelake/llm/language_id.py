"""Language identification as a mixture: every document may hold several languages.

Learning counts the byte n-grams (within words, with their borders) of all labelled documents for each language. Predicting
takes, for each word, the likelihood of its n-grams under each language, and fits the document's language proportions by
expectation-maximisation over its words. Among the sets of its k largest languages, k = 1, 2, ..., the one with the best
penalised likelihood (half the logarithm of the number of words for each language) is its language set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelake.llm import hashing as H
from allelake.llm.common import chunks, mapped, remainder_of_crc32

ORDERS, BUCKETS = (2, 3, 4), 1 << 16
#: Numbers kept for each language: this bounds what goes to the driver and back (2.4 MB a language in memory).
CELLS = len(ORDERS) * BUCKETS
ROUNDS = 25
#: Bytes of text counted, and predicted, at once (fewer for more than 8 languages).
COUNT_BYTES, RUN_BYTES = 1 << 19, 1 << 17
UNKNOWN = "und"
_LETTERS = H.separators([b for b in range(128) if not chr(b).isalpha()])


def _normal(raw: np.ndarray) -> np.ndarray:
    """Lower case (ASCII and Latin-1 letters), anything else than letters as spaces."""
    x = np.where(_LETTERS[raw], raw, 32).astype(np.uint8)
    x[(raw >= 65) & (raw <= 90)] += 32
    after = np.flatnonzero(raw[:-1] == 0xC3) + 1
    low = after[(raw[after] >= 0x80) & (raw[after] <= 0x9E) & (raw[after] != 0x97)]
    x[low] += 32
    return x


def _grams(raw: np.ndarray, offsets: np.ndarray):
    """For each order: position of each n-gram's first byte and its cell. N-grams lie in a word or on its border."""
    x = _normal(raw).astype(np.uint32)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for o, n in enumerate(ORDERS):
        m = len(x) - n + 1
        if m <= 0:
            continue
        code, whole = x[:m].copy(), np.ones(m, bool)
        for j in range(1, n):
            code = (code << np.uint32(8)) | x[j : j + m]
            if j < n - 1:
                whole &= x[j : j + m] != 32
        whole &= (text[:m] == text[n - 1 :]) & ((x[:m] != 32) | (x[n - 1 :] != 32))
        at = np.flatnonzero(whole)
        yield at, ((code[at] * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) + o * BUCKETS


def _count(batches):
    tables: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lo, hi, raw, off in chunks(batch.column("text"), COUNT_BYTES):
            names = sorted(set(langs[lo:hi]))
            of_text = np.array([names.index(v) for v in langs[lo:hi]])
            text = np.repeat(of_text, np.diff(off))
            for at, cell in _grams(raw, off):
                here = np.bincount(text[at] * CELLS + cell, minlength=len(names) * CELLS).reshape(len(names), CELLS)
                for i, v in enumerate(names):
                    tables[v] = tables[v] + here[i] if v in tables else here[i]
    for v, counts in tables.items():
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([v]), pa.array([used.astype(np.int32)], pa.list_(pa.int32())), pa.array([counts[used]], pa.list_(pa.int64()))], ["lang", "cells", "counts"])


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their n-gram log-likelihoods (cells x languages), counted over all of ``docs`` (text, lang)."""
    rows = docs.where("lang is not null and text is not null").select("lang", "text").transform(mapped(_count, "lang string, cells array<int>, counts array<long>"))
    sums = rows.select("lang", F.explode(F.arrays_zip("cells", "counts")).alias("x")).groupBy("lang", F.col("x.cells").alias("cell")).agg(F.sum("x.counts").alias("n"))
    got = sums.toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((CELLS, len(langs)))
    where = np.searchsorted(langs, got.column("lang").to_pylist()) if langs else np.zeros(0, np.int64)
    counts[got.column("cell").to_numpy(), where] = got.column("n").to_numpy()
    logs = np.zeros_like(counts)
    for o in range(len(ORDERS)):
        part = slice(o * BUCKETS, (o + 1) * BUCKETS)
        used = max(1, int((counts[part].sum(1) > 0).sum()))
        logs[part] = np.log((counts[part] + 0.5) / (counts[part].sum(0) + 0.5 * used))
    return langs, (logs / len(ORDERS)).astype(np.float32)


def _em(like: np.ndarray, first: np.ndarray, text: np.ndarray, share: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each text and its log-likelihood (up to each word's own constant); every text has a word."""
    n = np.diff(first)[:, None]
    for _ in range(rounds):
        r = like * share[text]
        r /= r.sum(1, keepdims=True)
        new = np.add.reduceat(r, first[:-1]) / n
        done = np.abs(new - share).max() < 1e-5
        share = new
        if done:
            break
    return share, np.add.reduceat(np.log((like * share[text]).sum(1)), first[:-1])


def infer(raw: np.ndarray, offsets: np.ndarray, logs: np.ndarray) -> list[list[tuple[int, float]]]:
    """For each text its languages and proportions, largest first; none for a text without letters."""
    out: list[list[tuple[int, float]]] = [[] for _ in range(len(offsets) - 1)]
    starts, ends, first = H.spans(raw, offsets, _LETTERS)
    if not len(starts) or not logs.shape[1]:
        return out
    score = np.zeros((len(starts), logs.shape[1]))
    word_at = np.zeros(len(raw) + 1, np.int64)  # number of the word at a byte, or of the next one
    word_at[starts] = 1
    word_at = np.cumsum(word_at) - 1
    inside = _LETTERS[raw]
    for at, cell in _grams(raw, offsets):
        if not len(at):
            continue
        word = np.where(inside[at], word_at[at], word_at[at] + 1)  # a border n-gram belongs to the word it leads to
        begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        score[word[begins]] += np.add.reduceat(logs[cell], begins, axis=0)
    like = np.exp(score - score.max(1, keepdims=True)) + 1e-12
    full = np.flatnonzero(np.diff(first))
    bounds = np.concatenate([first[full], [len(starts)]])
    text = np.repeat(np.arange(len(full)), np.diff(bounds))
    share, best = _em(like, bounds, text, np.full((len(full), logs.shape[1]), 1.0 / logs.shape[1]))
    order = np.argsort(-share, axis=1, kind="stable")
    single = np.add.reduceat(np.log(like[np.arange(len(like)), order[text, 0]]), bounds[:-1])
    penalty = 0.5 * np.log(np.maximum(np.diff(bounds), 2))
    for i, t in enumerate(full.tolist()):
        out[t] = [(int(order[i, 0]), 1.0)]
        if best[i] - single[i] <= penalty[i]:  # no larger set can be worth its penalty
            continue
        own, top = like[bounds[i] : bounds[i + 1]], single[i] - penalty[i]
        for k in range(2, logs.shape[1] + 1):
            if best[i] - k * penalty[i] <= top:
                break
            chosen = order[i, :k]
            s, value = _em(own[:, chosen], np.array([0, len(own)]), np.zeros(len(own), np.int64), np.full((1, k), 1.0 / k))
            if value[0] - k * penalty[i] > top:
                top = value[0] - k * penalty[i]
                out[t] = sorted(((int(c), float(p)) for c, p in zip(chosen, s[0], strict=True)), key=lambda x: (-x[1], x[0]))
    return out


def _has_letter(raw: np.ndarray) -> bool:
    return any(c.isalpha() for c in raw.tobytes().decode())


def _predict(langs: list[str], logs: Broadcast):
    def run(batches):
        table = logs.value
        most = max(1 << 15, RUN_BYTES * 8 // max(8, len(langs)))
        for batch in batches:
            for lo, hi, raw, off in chunks(batch.column("text"), most):
                found = infer(raw, off, table)
                for i, x in enumerate(found):
                    if x and not ((raw[off[i] : off[i + 1]] | 32) - 97 < 26).any() and not _has_letter(raw[off[i] : off[i + 1]]):
                        found[i] = []  # only signs beyond ASCII
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(lo, hi - lo) for c in batch.schema.names if c != "text"),
                        pa.array([langs[x[0][0]] if x else UNKNOWN for x in found], pa.string()),
                        pa.array([min(1.0, x[0][1]) if x else 0.0 for x in found], pa.float64()),
                        pa.array([[langs[c] for c, _ in x] for x in found], pa.list_(pa.string())),
                        pa.array([[p for _, p in x] for x in found], pa.list_(pa.float64())),
                    ],
                    [*(c for c in batch.schema.names if c != "text"), "lang_pred", "score", "languages", "proportions"],
                )

    return run


def identify_languages(docs: DataFrame, folds: int = 4, held_out_fold: int = 2) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score, languages, proportions.

    Learns from the text and lang of rows whose crc32(doc_id as text) modulo ``folds`` is not ``held_out_fold`` and whose
    lang and text aren't null; predicts from text alone. score is the proportion of lang_pred, the largest; equal ones go
    to the language first in the alphabet. Texts that are null, empty or without letters give ``und``, score 0 and no
    languages; so does everything if no row can be learned from. A null doc_id is never learned from and not held out;
    repeated rows count each; other columns are ignored; an empty table gives no rows.
    """
    fold = remainder_of_crc32("doc_id", folds)
    langs, logs = train(docs.where(fold != held_out_fold).select("text", "lang"))
    table = docs.sparkSession.sparkContext.broadcast(logs)  # CELLS float32 values for each language
    rows = docs.select("doc_id", F.coalesce(fold == held_out_fold, F.lit(False)).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.transform(mapped(_predict(langs, table), f"doc_id {kind}, held_out boolean, lang_pred string, score double, languages array<string>, proportions array<double>"))


def keep_known(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose language can be told, with all their columns; rows keep their own lang.

    If no language can be learned (no row outside the held-out fold has a lang and a text), all texts with a letter stay.
    """
    fold = remainder_of_crc32("doc_id", 4)
    langs, logs = train(docs.where(fold != 2).select("text", "lang"))
    table = docs.sparkSession.sparkContext.broadcast(logs)

    def keep(batches):
        for batch in batches:
            if not langs:
                yield batch.filter(pa.array([_has_letter(raw[a:b]) for _, _, raw, off in chunks(batch.column("text")) for a, b in zip(off[:-1], off[1:], strict=True)], pa.bool_()))
                continue
            found = [x for out in _predict(langs, table)([batch.select(["text"])]) for x in out.column("lang_pred").to_pylist()]
            yield batch.filter(pa.array([x != UNKNOWN for x in found], pa.bool_()))

    return docs.transform(mapped(keep, docs.schema))
