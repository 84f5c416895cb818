"""Tokenising whole texts with the tokenizers library, each different piece of text once.

The byte-level BPE models used here cut a text into pieces by a fixed pattern and encode every piece by itself. The cut is
made with numpy over a whole run of texts, pieces are looked up in a table, and only pieces not met before go to the
library's model. Texts with characters outside the table or with the string of an added token such as
``<|endoftext|>``, and tokenizers of any other make, go to the library as they are.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from allelake.llm import hashing as H
from allelake.llm.common import chunks, kept

U = np.uint64
SPACE, LETTER, NUMBER, OTHER, UNSAFE = range(5)
#: Characters with the Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe to make a piece with it.
SUFFIXES = ["s", "t", "re", "ve", "m", "ll", "d"]
#: The two kinds of tokenizer whose pieces are cut here.
KINDS = ("space before the word", "words only, lower case")
#: Bounds of what an encoder keeps between runs of texts: pieces and ids of pieces (44 MB with the table that finds them).
_MOST_PIECES, _MOST_IDS = 1 << 20, 1 << 22


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next free character from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return {b: chr(b if b in plain else next(free)) for b in range(256)}


def _room(x: np.ndarray, size: int) -> np.ndarray:
    """``x``, made longer if it has fewer than ``size`` places."""
    return x if size <= len(x) else np.concatenate([x, np.zeros(max(size, len(x) * 3 // 2) - len(x), x.dtype)])


def _kind(spec: dict) -> str | None:
    pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec["model"]
    if model.get("type") != "BPE" or spec.get("post_processor") and spec["post_processor"].get("type") == "TemplateProcessing":
        return None
    if norm is not None and any(x["normalized"] for x in spec.get("added_tokens") or []):
        return None  # they are looked for in the normalised text
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return KINDS[0]
    steps = [x.get("type") for x in (norm or {}).get("normalizers", [])]
    cut = [x.get("type") for x in pre.get("pretokenizers", [])]
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    if steps == ["NFC", "Replace", "Lowercase"] and cut == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["pattern"].get("Regex") == pattern:
        return KINDS[1]
    return None


class Encoder:
    """Token ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)`` of the tokenizer as its file loads."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind, self.added = _kind(spec), [x["content"].encode() for x in spec.get("added_tokens") or [] if x["content"]]
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self._tables()
        self._clear()

    def _tables(self) -> None:
        size = 0x2100
        self.classes, self.lower = np.full(size + 1, UNSAFE, np.uint8), np.arange(size + 1, dtype=np.uint32)
        for i in range(size):
            c = chr(i)
            kind = unicodedata.category(c)
            if kind in ("Cn", "Cs", "Co"):
                continue
            if self.kind == KINDS[1]:
                low = c.lower()
                if kind[0] == "M" or unicodedata.normalize("NFC", c) != c or len(low) != 1 or 0x370 <= i < 0x2000:
                    continue
                self.lower[i] = ord(low)
            self.classes[i] = SPACE if i in WHITE_SPACE else {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)
        self.values = H.mix(np.arange(1, size + 2, dtype=U), 55)

    def _clear(self) -> None:
        self.begin, self.pieces = np.zeros(1 << 12, np.int32), 0  # piece i has the ids from begin[i] to begin[i + 1]
        self.flat, self.used = np.zeros(1 << 14, np.uint32), 0
        self.slot_key, self.slot_piece = np.zeros(1 << 14, U), np.zeros(1 << 14, np.int32)  # open addressing; key 0: free

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Number of the piece of each key, -1 for one not met."""
        out, mask = np.full(len(keys), -1, np.int64), len(self.slot_key) - 1
        slot, todo = (keys & U(mask)).astype(np.int64), np.arange(len(keys))
        while len(todo):
            held = self.slot_key[slot[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.slot_piece[slot[todo[hit]]]
            todo = todo[~hit & (held != 0)]
            slot[todo] = (slot[todo] + 1) & mask
        return out

    def _place(self, keys: np.ndarray, pieces: np.ndarray) -> None:
        """Enter keys that are different and not in the table."""
        mask = len(self.slot_key) - 1
        slot, todo = (keys & U(mask)).astype(np.int64), np.arange(len(keys))
        while len(todo):
            free = todo[self.slot_key[slot[todo]] == 0]
            at, first = np.unique(slot[free], return_index=True)
            self.slot_key[at], self.slot_piece[at] = keys[free[first]], pieces[free[first]]
            todo = todo[self.slot_key[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & mask

    def _add(self, keys: np.ndarray, pieces: list[str]) -> np.ndarray:
        """Encode new pieces by the library's model; gives their numbers."""
        ids = [[t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.letters))] for p in pieces]
        ends = self.used + np.cumsum([len(x) for x in ids])
        flat = [i for x in ids for i in x]
        numbers = np.arange(self.pieces, self.pieces + len(ids))
        self.flat = _room(self.flat, self.used + len(flat))
        self.begin = _room(self.begin, self.pieces + len(ids) + 1)
        self.flat[self.used : self.used + len(flat)] = flat
        self.begin[numbers + 1] = ends
        self.used, self.pieces = self.used + len(flat), self.pieces + len(ids)
        if 2 * self.pieces > len(self.slot_key):
            old_keys, old = self.slot_key[self.slot_key != 0], self.slot_piece[self.slot_key != 0]
            size = 1 << (3 * self.pieces).bit_length()
            self.slot_key, self.slot_piece = np.zeros(size, U), np.zeros(size, np.int32)
            self._place(old_keys, old)
        self._place(keys, numbers)
        return numbers

    def _cut(self, x: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of the characters ``x``; texts begin at ``first``."""
        n = len(x)
        begin = np.ones(n + 1, bool)
        begin[1:n] = kinds[1:] != kinds[:-1]
        text_start = np.zeros(n + 1, bool)
        text_start[first] = True
        text_start[n] = True
        begin |= text_start
        run = begin.copy()
        words = np.flatnonzero(begin[:n] & (kinds != SPACE) & ~text_start[:n])
        after_space = words[kinds[words - 1] == SPACE]
        if self.kind == KINDS[0]:
            begin[after_space - 1] = True
            begin[after_space[x[after_space - 1] == 32]] = False
        else:
            begin[:n] |= kinds == NUMBER
        marks = np.flatnonzero((x == 39) & begin[:n] & run[:n] & run[1:])
        marks = marks[marks + 1 < n]
        for i in marks[~text_start[marks + 1] & (kinds[marks + 1] == LETTER)].tolist():
            for suffix in SUFFIXES:
                m = len(suffix)
                if i + 1 + m <= n and "".join(map(chr, x[i + 1 : i + 1 + m])) == suffix and not text_start[i + 1 : i + 1 + m].any():
                    begin[i + 1] = False
                    begin[i + 1 + m] = True
                    break
        at = np.flatnonzero(begin)
        starts, ends = at[:-1], at[1:]
        if self.kind == KINDS[1]:
            keep = kinds[starts] != SPACE
            starts, ends = starts[keep], ends[keep]
        return starts, ends

    def _safe(self, text: str, x: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their boundaries for texts all of whose characters are in the table."""
        if not len(x):
            return np.zeros(0, np.uint32), np.zeros(len(first), np.int64)
        if self.kind == KINDS[1]:
            x = self.lower[x]
            text = x.astype("<u4").tobytes().decode("utf-32-le")
        starts, ends = self._cut(x, kinds, first[:-1][first[:-1] < len(x)])
        h = np.maximum(H.word_hashes(x, starts, ends, self.values), U(1))
        piece = self._find(h)
        miss = np.flatnonzero(piece < 0)
        if len(miss):
            different, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
            if self.pieces and (self.pieces + len(different) > _MOST_PIECES or self.used > _MOST_IDS):
                self._clear()  # a cleared table costs time alone
                return self._safe(text, x, kinds, first)
            at = miss[where]
            new = [text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            piece[miss] = self._add(different, new)[back]
        begin = self.begin[piece].astype(np.int64)
        lengths = self.begin[piece + 1] - begin
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.repeat(begin - total[:-1], lengths) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, first)]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in ``raw`` (UTF-8, cut at ``offsets``), end to end, and their boundaries."""
        data = raw.tobytes()
        if self.kind is None:
            return self._library([data[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        text = data.decode()
        x = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        first = heads[offsets]
        kinds = self.classes[np.minimum(x, len(self.classes) - 1)]
        bad = np.flatnonzero(kinds == UNSAFE)
        odd = np.union1d(np.searchsorted(first, bad, "right") - 1, np.searchsorted(offsets, self._added_at(data), "right") - 1).astype(np.int64)
        if not len(odd):
            return self._safe(text, x, kinds, first)
        parts, bounds, at = [], [np.zeros(1, np.int64)], 0
        edges = [0, *sorted({*odd.tolist(), *(odd + 1).tolist()}), len(first) - 1]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo == hi:
                continue
            a, b = first[lo], first[hi]
            ids, own = self._library([text[a:b]]) if lo in odd and hi == lo + 1 else self._safe(text[a:b], x[a:b], kinds[a:b], first[lo : hi + 1] - a)
            parts.append(ids)
            bounds.append(own[1:] + at)
            at += len(ids)
        return np.concatenate(parts), np.concatenate(bounds)

    def _added_at(self, data: bytes) -> list[int]:
        """Where strings of added tokens are (some may cross texts: those texts are then encoded whole to no harm)."""
        found = []
        for x in self.added:
            at = data.find(x)
            while at >= 0:
                found.append(at)
                at = data.find(x, at + 1)
        return found

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.array([i for x in lists for i in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, kept between tasks that tokenise (owner ``tokens``)."""
    return Encoder(path)


kept("tokens", encoder.cache_clear)


def encoded(text: pa.Array, path: str, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after, ids, boundaries) of runs of texts, ``end_id`` after each text; null counts as empty."""
    e = encoder(path)
    for lo, hi, raw, off in chunks(text):
        ids, bounds = e.encode(raw, off)
        out = np.insert(ids, bounds[1:], np.uint32(end_id))
        yield lo, hi, out, bounds + np.arange(len(bounds))
