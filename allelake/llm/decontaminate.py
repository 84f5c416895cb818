"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

All word trigrams of a benchmark item are its seeds: any of them may be the only one that an edited copy keeps. Documents
that hold a seed are aligned with the item around it, word by word, and report the item if the alignment's score is a given
share of the best possible one: copies, and copies with words replaced, dropped or added. Seeds that are common in the
corpus cost little: a window that holds too few of the item's words to reach the score isn't aligned, nor is one that holds
the item as it is. Windows are aligned many at a time, as many as fit in a bounded number of cells; a single alignment takes
memory in proportion to its window, and time to window times item.

The benchmark is taken in blocks of a bounded size; a block is broadcast, and documents are scanned where they are, so
nothing of the corpus is shuffled.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelake.llm import hashing as H
from allelake.llm.common import chunks, mapped

U = np.uint64
GRAM = 3
#: Bytes of item texts in one block.
BLOCK_BYTES = 16 << 20
MATCH, MISMATCH, GAP = 2, 1, 1
#: Pairs of a seed in a text and one in an item that are worked on at once.
PAIRS = 1 << 20
#: Words of all windows (the longest one's length times their number) that are aligned at once, unless one alone has more.
CELLS, WINDOWS = 1 << 19, 256
_FILTER_BITS = 22
#: Scripts written without spaces (Thai, Lao, Myanmar, Khmer, kana, bopomofo, Han, Yi and extensions).
NO_SPACES = [(0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x323AF)]
BREAK, PART, ALONE = 0, 1, 2


@functools.lru_cache(maxsize=1)
def _roles() -> np.ndarray:
    """Whether each character cuts words, is part of one, or is one by itself; the last entry is for those beyond."""
    size = 0x32400
    role = np.full(size + 1, PART, np.uint8)
    for lo, hi in NO_SPACES:
        role[lo : hi + 1] = ALONE
    for i in range(128, size):
        kind = unicodedata.category(chr(i))
        if kind[0] in "ZP" or kind == "Cc":
            role[i] = BREAK
    role[[0x200B, 0xFEFF]] = BREAK  # spaces of no width
    return role


def _spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``H.spans`` of words cut at Unicode white space and punctuation; a character of a script without spaces is a word."""
    heads = np.flatnonzero(raw >= 0xC2)
    if not len(heads):
        return H.spans(raw, off, H.ALNUM_WORDS)
    more = np.append(raw, np.zeros(3, np.uint8))
    a, b, c, d = (more[heads + i].astype(np.int64) & (0x3F if i else 0xFF) for i in range(4))
    n = 2 + (a >= 0xE0) + (a >= 0xF0)
    code = np.select([n == 2, n == 3], [(a & 0x1F) << 6 | b, (a & 0xF) << 12 | b << 6 | c], (a & 7) << 18 | b << 12 | c << 6 | d)
    role = _roles()[np.minimum(code, len(_roles()) - 1)]
    inside = H.ALNUM_WORDS[raw]
    for i in range(4):
        gone = heads[(role == BREAK) & (i < n)] + i
        inside[gone[gone < len(raw)]] = False
    cut = np.zeros(len(raw) + 1, bool)  # no word goes on across these
    cut[off] = True
    single = role == ALONE
    cut[heads[single]] = True
    cut[np.minimum((heads + n)[single], len(raw))] = True
    starts = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (cut[1:] | ~np.append(inside[1:], False))) + 1
    return starts, ends, np.searchsorted(starts, off)


@dataclass
class Block:
    """Items of a block: word hashes end to end, and trigrams sorted by hash (equal ones adjacent).

    ``short`` has, by number of words, sorted hashes of the items that are found as whole word sequences alone, and the items.
    """

    items: list
    words: np.ndarray
    first: np.ndarray
    gram: np.ndarray
    item: np.ndarray
    place: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    def index(self) -> None:
        self.unique, self.begin = np.unique(self.gram, return_index=True)
        self.begin = np.append(self.begin, len(self.gram))
        self.whole = H.hashes_between(H.running(self.words), self.first[:-1], self.first[1:])
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.unique >> U(64 - _FILTER_BITS)).astype(np.int64)] = True

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``grams`` of those in the block, and which of ``unique`` they are."""
        at = np.flatnonzero(self.filter[(grams >> U(64 - _FILTER_BITS)).astype(np.int64)])
        if not len(at) or not len(self.unique):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which = np.minimum(np.searchsorted(self.unique, grams[at]), len(self.unique) - 1)
        hit = self.unique[which] == grams[at]
        return at[hit], which[hit]


def _text_words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = _spans(raw, off)
    return H.word_hashes(raw, starts, ends, H.byte_values(lower=True)), first


def _text_grams(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the trigram at each word, and the text it is in (-1 where it would cross texts)."""
    grams = H.sequence_hashes(words, GRAM)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    same = text[: len(grams)] == text[GRAM - 1 :] if len(grams) else np.zeros(0, bool)
    return grams, np.where(same, text[: len(grams)], -1)


def _block(rows: list, min_words: int) -> Block:
    """A block of (item_id, text) rows; items of fewer than ``min_words`` words are in ``short``."""
    rows = sorted((r for r in rows if r[1]), key=lambda r: (str(r[0]), r[1]))
    items, words, lengths = [], [], []
    for name, text in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        w, _ = _text_words(raw, np.array([0, len(raw)]))
        if len(w):
            items.append(name)
            words.append(w)
            lengths.append(len(w))
    first = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    flat = np.concatenate([np.zeros(0, U), *words])
    grams, item = _text_grams(flat, first)
    sizes, short = np.diff(first), {}
    least = max(GRAM, min_words)
    for n in np.unique(sizes[sizes < least]).tolist():
        which = np.flatnonzero(sizes == n)
        hashes = np.array([H.sequence_hashes(flat[first[i] : first[i] + n], n)[0] for i in which], U)
        order = np.argsort(hashes, kind="stable")
        short[n] = hashes[order], which[order]
    here = np.flatnonzero(item >= 0)
    here = here[sizes[item[here]] >= least]
    here = here[np.argsort(grams[here], kind="stable")]
    block = Block(items, flat, first, grams[here], item[here], here - first[item[here]], short)
    block.index()
    return block


def align(item: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of rows of words (padded with values that match nothing), and where in the window they end."""
    wide = np.arange(window.shape[1] + 1, dtype=np.int32) * GAP
    last = np.zeros((len(item), window.shape[1] + 1), np.int32)
    best, end = np.zeros(len(item), np.int32), np.zeros(len(item), np.int64)
    for i in range(item.shape[1]):
        now = np.zeros_like(last)
        np.maximum(last[:, :-1] + np.where(item[:, i : i + 1] == window, MATCH, -MISMATCH).astype(np.int32), last[:, 1:] - GAP, out=now[:, 1:])
        np.maximum(now, 0, out=now)
        last = np.maximum.accumulate(now + wide, axis=1) - wide
        top = last.argmax(1)
        value = last[np.arange(len(item)), top]
        better = value > best
        best, end = np.where(better, value, best), np.where(better, top, end)
    return best, end


def _padded(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, pad: int, reverse: bool = False) -> np.ndarray:
    most = int((hi - lo).max())
    at = (hi[:, None] - 1 - np.arange(most)) if reverse else lo[:, None] + np.arange(most)
    inside = (at >= lo[:, None]) & (at < hi[:, None])
    return np.where(inside, words[np.clip(at, 0, len(words) - 1)], U(pad))


def _slack(size: np.ndarray) -> np.ndarray:
    return size // 4 + 2


def _places(block: Block, at: np.ndarray, which: np.ndarray, text: np.ndarray, first: np.ndarray):
    """(text, item, lowest, highest place where the item would begin) of seeds in a text that lie alike."""
    n = block.begin[which + 1] - block.begin[which]
    total = np.concatenate([[0], np.cumsum(n)])
    parts, lo = [], 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, "right")) - 1)
        m = n[lo:hi]
        entry = np.repeat(block.begin[which[lo:hi]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        where = np.repeat(at[lo:hi], m)
        t, item = text[where], block.item[entry]
        shift = where - first[t] - block.place[entry]
        parts.append(_merged(t, item, np.floor_divide(shift, _slack(np.diff(block.first)[item])), shift, shift))
        lo = hi
    t, item, _, low, high = _merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    return t, item, low, high


def _merged(t: np.ndarray, item: np.ndarray, band: np.ndarray, low: np.ndarray, high: np.ndarray):
    order = np.lexsort((band, item, t))
    t, item, band, low, high = (x[order] for x in (t, item, band, low, high))
    head = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])]))
    return t[head], item[head], band[head], np.minimum.reduceat(low, head), np.maximum.reduceat(high, head)


def _may_reach(block: Block, words: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: float) -> np.ndarray:
    """Whether so many of the item's words are in the window that the score can be reached: no match is lost by it."""

    def keys(source, a, b):
        n = b - a
        row = np.repeat(np.arange(len(n)), n)
        return row, source[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())] + H.mix(row.astype(U), 5)

    size = block.first[item + 1] - block.first[item]
    row, wanted = keys(block.words, block.first[item], block.first[item + 1])
    held = np.bincount(row[np.isin(wanted, keys(words, lo, hi)[1])], minlength=len(item))
    return held >= least * size


def _matches(block: Block, words: np.ndarray, first: np.ndarray, least: float):
    """(text, item, score, first word, last word) of the items found in each text, the best place of each."""
    return sorted(_short_matches(block, words, first) + _long_matches(block, words, first, least))


def _short_matches(block: Block, words: np.ndarray, first: np.ndarray) -> list:
    """Items of few words that are in a text as they are, the first place of each."""
    text, out = np.repeat(np.arange(len(first) - 1), np.diff(first)), []
    for n, (hashes, items) in block.short.items():
        h = H.sequence_hashes(words, n)
        low = np.searchsorted(hashes, h)
        at = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == h)
        at = at[text[at] == text[at + n - 1]]
        _, head = np.unique(text[at].astype(np.int64) * len(hashes) + low[at], return_index=True)
        for i in at[head].tolist():
            t, high = int(text[i]), int(np.searchsorted(hashes, h[i], "right"))
            out += [(t, j, 1.0, int(i - first[t]), int(i - first[t]) + n - 1) for j in items[low[i] : high].tolist()]
    return out


def _long_matches(block: Block, words: np.ndarray, first: np.ndarray, least: float) -> list:
    grams, text = _text_grams(words, first)
    at, which = block.find(grams)
    at, which = at[text[at] >= 0], which[text[at] >= 0]
    if not len(at):
        return []
    t, item, low, high = _places(block, at, which, text, first)
    size = np.diff(block.first)[item]
    slack = _slack(size)
    lo = np.maximum(first[t], first[t] + low - slack)
    hi = np.minimum(first[t + 1], first[t] + high + size + slack)
    found = {}
    order, running, s = np.lexsort((hi - lo, size)), H.running(words), 0
    while s < len(order):
        wide = np.maximum.accumulate((hi - lo)[order[s : s + WINDOWS]])
        n = max(1, int(np.searchsorted(wide * np.arange(1, len(wide) + 1), CELLS, "right")))
        some, s = order[s : s + n], s + n
        some = some[_may_reach(block, words, item[some], lo[some], hi[some], least)]
        exact = {}
        for i in some.tolist():
            at = np.arange(lo[i], hi[i] - size[i] + 1)
            hit = np.flatnonzero(H.hashes_between(running, at, at + size[i]) == block.whole[item[i]])
            if len(hit):
                begin = int(at[hit[0]] - first[t[i]])
                exact[i] = -1.0, begin, begin + int(size[i]) - 1
        for i, value in exact.items():
            key = int(t[i]), int(item[i])
            found[key] = min(value, found.get(key, value))
        some = some[[i not in exact for i in some.tolist()]] if exact else some
        if not len(some):
            continue
        a, b = block.first[item[some]], block.first[item[some] + 1]
        score, end = align(_padded(block.words, a, b, 0), _padded(words, lo[some], hi[some], 1))
        good = score >= least * MATCH * size[some]
        if not good.any():
            continue
        some, score, end, a, b = some[good], score[good], end[good], a[good], b[good]
        back, length = align(_padded(block.words, a, b, 0, True), _padded(words, lo[some], lo[some] + end, 1, True))
        for i, v, e, m in zip(some.tolist(), score.tolist(), end.tolist(), length.tolist(), strict=True):
            last = int(lo[i] + e - 1 - first[t[i]])
            key, value = (int(t[i]), int(item[i])), (-v / (MATCH * int(size[i])), int(last - m + 1), last)
            if key not in found or value < found[key]:
                found[key] = value
    return [(*k, -v[0], v[1], v[2]) for k, v in sorted(found.items())]


def _blocks(docs: DataFrame, benchmark: DataFrame, min_words: int):
    """Each block of the benchmark, as broadcasts."""
    sc = docs.sparkSession.sparkContext
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for i in range(n):
        block = _block([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()], min_words)
        if block.items:
            yield sc.broadcast(block)


def find_contamination(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, min_words: int = 8) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, score, first_word, last_word.

    ``docs`` (doc_id, text), ``benchmark`` (item_id, text). Words are runs of ASCII letters and digits and of any other
    characters beyond ASCII but white space and punctuation, in lower case (A-Z); in scripts without spaces each character
    is one. score is the alignment's score (2 a match, -1 a mismatch or gap) over
    twice the item's number of words, ``least`` at least; first_word and last_word are its place in the document, the best
    one, the first of equal ones. A copy must keep three words of the item in sequence somewhere. Items of
    fewer than ``min_words`` words are found as whole word sequences alone, without any edit; those without words or with
    null text are never found; null or empty
    texts hold none. A null doc_id or item_id is reported as null, repeated rows are reported each; other columns are
    ignored; an empty table on either side gives no rows.
    """
    doc_kind, item_kind = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = f"doc_id {doc_kind.simpleString()}, item_id {item_kind.simpleString()}, score double, first_word long, last_word long"
    out = docs.sparkSession.createDataFrame([], schema)

    def run(block):
        def batches_of(batches):
            for batch in batches:
                for lo, _, raw, off in chunks(batch.column("text")):
                    rows = _matches(block.value, *_text_words(raw, off), least)
                    if rows:
                        t, item, score, a, b = zip(*rows, strict=True)
                        names = pa.array([block.value.items[i] for i in item])
                        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([lo + i for i in t])), names, pa.array(score), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["doc_id", "item_id", "score", "first_word", "last_word"])

        return batches_of

    for block in _blocks(docs, benchmark, min_words):
        out = out.union(docs.select("doc_id", "text").transform(mapped(run(block), schema)))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, min_words: int = 8) -> DataFrame:
    """Rows of ``docs`` that hold no item of ``benchmark``, with all their columns."""
    out = docs

    def run(block):
        def batches_of(batches):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for lo, _, raw, off in chunks(batch.column("text")):
                    for row in _matches(block.value, *_text_words(raw, off), least):
                        clean[lo + row[0]] = False
                yield batch.filter(pa.array(clean))

        return batches_of

    for block in _blocks(docs, benchmark, min_words):
        out = out.transform(mapped(run(block), docs.schema))
    return out
