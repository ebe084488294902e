"""Fast ids of a word-level BPE tokenizer: each distinct word is merged once, many words at a time; the rest are lookups.

The tokenizer file's normalisers, word pattern and the flags of its added tokens are checked first, so that a file with
others is refused rather than tokenised wrongly.  An added token that stands in a text is its own id, and what is on
either side of it is tokenised apart, as the tokenizer does unless it is told to take such tokens for ordinary text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

#: The word pattern and normalisers of the tokenizer file.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISERS = ["NFC", "Replace", "Lowercase"]
END = "</w>"

#: What str.split() takes for white space and the word pattern doesn't.
_ODD = "\x1c\x1d\x1e\x1f"
_NONE = np.int64(1) << 40


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it can be seen, else one from
    U+0100 on, in order."""
    seen = [33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)]
    hidden = np.cumsum(~np.array(seen)) - 1
    return [chr(b) if seen[b] else chr(256 + int(hidden[b])) for b in range(256)]


class Numbered(dict):
    """Numbers keys in the order in which they are first asked for; ``fresh`` has those not yet learnt."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self.fresh.append(key)
        self[key] = n = len(self)
        return n


class WordBpe:
    """``encode(texts)``: (ids of all texts in a row, number of ids of each text), added tokens included.

    Memory: at most ``limit`` stretches between white space are kept; when more come, they start afresh.
    """

    def __init__(self, path: str, limit: int = 700_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        model = spec["model"]
        if kinds != NORMALISERS or split != WORDS or model["end_of_word_suffix"] != END or model["type"] != "BPE":
            raise ValueError(f"{path}: not a tokenizer with the normalisers and words that this class knows")
        ids = model["vocab"]
        self.inner = np.array([ids[c] for c in byte_symbols()], dtype=np.int64)
        self.last = np.array([ids[c + END] for c in byte_symbols()], dtype=np.int64)
        self.size = max(ids.values()) + 1
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        self.find = regex.compile(WORDS).findall
        added = spec["added_tokens"]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path}: added tokens that are not matched as they stand")
        self.added = {t["content"]: t["id"] for t in added}
        self.apart = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.stretches = Numbered()
        self.ids, self.at, self.used = np.empty(1 << 16, "<u4"), np.zeros(1, np.int64), 0

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        if not any(map(self.apart.search, texts)):
            return self._plain(texts)
        # Plain parts and added tokens take turns, with a plain part at either end.
        parts: list[str] = []
        marks: list[int | None] = []
        for text in texts:
            at = 0
            for m in self.apart.finditer(text):
                parts.append(text[at : m.start()])
                marks.append(self.added[m[0]])
                at = m.end()
            parts.append(text[at:])
            marks.append(None)
        ids, counts = self._plain(parts)
        ends = np.cumsum(counts)
        marked = np.array([m is not None for m in marks])
        out = np.insert(ids, ends[marked], [m for m in marks if m is not None])
        last = np.flatnonzero(~marked)
        totals = np.cumsum(counts + marked)[last]
        return out, np.diff(np.concatenate([[0], totals]))

    def _plain(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        # Characters are lower-cased one by one, so a final sigma is like any other.
        low = [unicodedata.normalize("NFC", x).replace("Σ", "σ").lower() for x in texts]
        split = [self.find(x) if any(c in x for c in _ODD) else x.split() for x in low]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        if len(self.stretches) > self.limit:
            self._clear()
        look = self.stretches.__getitem__
        place = np.fromiter(map(look, chain.from_iterable(split)), np.int64, int(counts.sum()))
        fresh, self.stretches.fresh = self.stretches.fresh, []
        self._learn(fresh)
        at = self.at
        start, length = at[place], at[place + 1] - at[place]
        total = np.concatenate([[0], np.cumsum(length)])
        ids = self.ids[np.repeat(start - total[:-1], length) + np.arange(total[-1])]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, total[ends[1:]] - total[ends[:-1]]

    def _learn(self, fresh: list[str]) -> None:
        if not fresh:
            return
        parts = [[x] if x.isalpha() else self.find(x) for x in fresh]
        number: dict[str, int] = {}
        each = [number.setdefault(w, len(number)) for p in parts for w in p]
        ids, lengths = self.merge(list(number))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        each_at = np.asarray(each, np.int64)
        size = lengths[each_at]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = ids[np.repeat(ends[each_at] - total[:-1], size) + np.arange(total[-1])]
        words = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(self.used + 2 * len(flat), "<u4")])
        self.ids[self.used : self.used + len(flat)] = flat
        self.at = np.concatenate([self.at, self.used + total[words[1:]]])
        self.used += len(flat)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word): in every word at once, its pair of lowest rank is merged, from the left,
        until no pair of it has a rank."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym, word = self.inner[data], np.repeat(np.arange(len(raw)), lengths)
        sym[np.cumsum(lengths) - 1] = self.last[data[np.cumsum(lengths) - 1]]
        done_sym, done_word = [], []
        rank = np.full(len(sym), _NONE)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self._rank(sym[inside], sym[inside + 1])
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.concatenate([starts, [len(sym)]]))
            going = np.repeat(low < _NONE, sizes)
            if not going.all():
                done_sym.append(sym[~going])
                done_word.append(word[~going])
                sym, word, rank = sym[going], word[going], rank[going]
                low, sizes = low[low < _NONE], sizes[low < _NONE]
                if not len(sym):
                    break
            hit = rank == np.repeat(low, sizes)
            # In a run of overlapping hits (equal symbols in a row), every second one counts.
            at = np.flatnonzero(hit)
            if len(at) > 1:
                new_run = np.concatenate([[True], np.diff(at) != 1])
                begin = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            at = moved[at]
            sym, word, rank = sym[keep], word[keep], rank[keep]
            rank[at] = _NONE
            for left in (at, at[at > 0] - 1):
                left = left[left + 1 < len(sym)]
                same = word[left] == word[left + 1]
                rank[left] = np.where(same, self._rank(sym[left], sym[left + 1]), _NONE)
        sym, word = np.concatenate([*done_sym, np.empty(0, np.int64)]), np.concatenate([*done_word, np.empty(0, np.int64)])
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(raw))


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One tokenizer for a Python worker, which keeps what it has learnt from task to task."""
    return WordBpe(path)
