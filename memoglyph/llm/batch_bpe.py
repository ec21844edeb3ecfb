"""BPE over batches: the distinct words of a piece are merged at once, in arrays, in place of one word after the other."""

from __future__ import annotations

import json
import re
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from memoglyph.llm.bpe import WordBpe, byte_symbols
from memoglyph.llm.common import string_buffers

_NONE = np.int32(2**31 - 1)
#: Longer words go through the encoder's prefix programme one by one: merging takes a pass for each merge of the longest.
LONGEST = 48
#: Chunks of these characters (visible ASCII, Latin letters) are cut into words by Arrow; others by the tokenizer's own pattern.
_PLAIN = "^[!-~\u00c0-\u024f]+$"
#: Ids and texts of chunks that are remembered, in bytes.
REMEMBERED_BYTES = 64 << 20


class Merges:
    """Ranks and results of pairs, in an open table that arrays are looked up in."""

    def __init__(self, model: dict):
        vocab, mark = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in range(2))
        self.result = np.array([vocab[(a[: -len(mark)] if mark and a.endswith(mark) else a) + b] for a, b in pairs], np.int32)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 4))))
        self.keys = np.full((1 << self.bits) + 4096, -1, np.int64)
        self.rank = np.full(len(self.keys), _NONE, np.int32)
        key, rank = left << 32 | right, np.arange(len(pairs), dtype=np.int32)
        key, first = np.unique(key, return_index=True)
        rank, at, self.probes = rank[first], self._slot(key), 0
        while len(key):  # each round takes the free slots that it meets, and the rest goes on by one
            self.probes += 1
            free = np.flatnonzero(self.keys[at] == -1)
            _, one = np.unique(at[free], return_index=True)
            free = free[one]
            self.keys[at[free]], self.rank[at[free]] = key[free], rank[free]
            rest = np.ones(len(key), bool)
            rest[free] = False
            key, rank, at = key[rest], rank[rest], at[rest] + 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = self._slot(key)
        held = self.keys[at]
        found = np.where(held == key, self.rank[at], _NONE)
        open_ = np.flatnonzero((held != key) & (held != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] += 1
            held = self.keys[at[open_]]
            hit = held == key[open_]
            found[open_[hit]] = self.rank[at[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return found


class BatchBpe:
    """Token ids of many texts at once; equal to WordBpe, with a memory of chunks that is bounded in bytes."""

    normal = WordBpe.normal  # the same rules

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, mark = model["vocab"], model.get("end_of_word_suffix") or ""
        self.spec, self._bpe, self.merges = spec, None, Merges(model)
        self.inner, self.last = (np.array([vocab[c + end] for c in byte_symbols()], np.int32) for end in ("", mark))
        kinds = {n["type"] for n in spec["normalizer"]["normalizers"]}
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        self.pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.added = re.compile("|".join(re.escape(a["content"]) for a in spec["added_tokens"]) or "(?!)")
        self._forget()

    def __reduce__(self):
        """Travels without what it remembers."""
        return _restored, ({k: v for k, v in self.__dict__.items() if k not in ("_bpe", "known", "ids", "starts", "used", "bytes", "find", "spec")} | {"packed": zlib.compress(json.dumps(self.spec).encode(), 1)},)

    @property
    def bpe(self) -> WordBpe:
        """The encoder of single words and texts, made when one is met that the arrays don't take."""
        if self._bpe is None:
            self._bpe = WordBpe(self.spec if self.spec is not None else json.loads(zlib.decompress(self.packed)))
        return self._bpe

    def _forget(self):
        self.known: dict[str, int] = {}
        self.find = regex.compile(self.pattern).findall
        self.ids, self.starts, self.used, self.bytes = np.empty(1 << 16, np.int32), np.zeros(1 << 12, np.int64), 0, 0

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words (none empty), one after the other, and how many each has."""
        raw, offsets = string_buffers(words)
        size = np.diff(offsets)
        symbols = self.inner[raw]
        symbols[offsets[1:] - 1] = self.last[raw[offsets[1:] - 1]]
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        long = size > LONGEST
        done_ids, done_word = [], []
        if long.any():
            for w in np.flatnonzero(long).tolist():
                found = self.bpe.word(words[w].as_py())
                done_ids.append(np.array(found, np.int32))
                done_word.append(np.full(len(found), w, np.int32))
            keep = ~long[word]
            symbols, word = symbols[keep], word[keep]
        if len(symbols):
            same = np.concatenate([word[1:] == word[:-1], [False]])
            rank = np.full(len(symbols), _NONE, np.int32)
            i = np.flatnonzero(same)
            rank[i] = self.merges.ranks(symbols[i], symbols[i + 1])
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            length = np.diff(np.append(first, len(word)))
            least = np.minimum.reduceat(rank, first)
            open_ = least != _NONE
            if not open_.all():
                going = np.repeat(open_, length)
                done_ids.append(symbols[~going])
                done_word.append(word[~going])
                symbols, word, rank = symbols[going], word[going], rank[going]
                least, length = least[open_], length[open_]
                if not len(symbols):
                    break
            here = np.flatnonzero(rank == np.repeat(least, length))
            # of overlapping equal pairs, as in aaa, the leftmost merges: every second one of a run
            run = np.concatenate([[True], np.diff(here) != 1])
            begin = np.maximum.accumulate(np.where(run, np.arange(len(here)), 0))
            here = here[(np.arange(len(here)) - begin) % 2 == 0]
            symbols[here] = self.merges.result[rank[here]]
            keep = np.ones(len(symbols), bool)
            keep[here + 1] = False
            moved = here - np.arange(len(here))
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            touched = np.zeros(len(symbols) + 1, bool)
            touched[moved] = touched[moved - 1] = True  # the last one takes what is before the first
            changed = np.flatnonzero(touched[:-1])
            follows = changed + 1 < len(symbols)
            inside = np.zeros(len(changed), bool)
            inside[follows] = word[changed[follows] + 1] == word[changed[follows]]
            rank[changed] = _NONE
            i = changed[inside]
            rank[i] = self.merges.ranks(symbols[i], symbols[i + 1])
        ids, of = np.concatenate([*done_ids, np.zeros(0, np.int32)]), np.concatenate([*done_word, np.zeros(0, np.int32)])
        order = np.argsort(of, kind="stable")
        return ids[order], np.bincount(of, minlength=len(words))

    def _cut(self, chunks: pa.Array) -> pa.ListArray:
        """The words of each chunk."""
        plain = pc.match_substring_regex(chunks, _PLAIN).to_numpy(zero_copy_only=False)
        alone = plain & pc.utf8_is_alpha(chunks).to_numpy(zero_copy_only=False)
        one, some, odd = (np.flatnonzero(x) for x in (alone, plain & ~alone, ~plain))
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(chunks.take(pa.array(some)), "(" + self.pattern.replace(r"\s", r"\s\x0b") + ")", r"\1 "))
        counts, words = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64), cut.flatten()
        kept = pc.not_equal(words, "")  # what follows the last space
        found = [self.find(c) for c in chunks.take(pa.array(odd)).to_pylist()]
        flat = pa.concat_arrays([chunks.take(pa.array(one)), words.filter(kept), pa.array([w for ws in found for w in ws], chunks.type)])
        of = np.concatenate([one, np.repeat(some, counts)[kept.to_numpy(zero_copy_only=False)], np.repeat(odd, [len(ws) for ws in found])])
        order = np.argsort(of, kind="stable")
        flat, of = flat.take(pa.array(order)), of[order]
        return pa.LargeListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(chunks) + 1))), flat)

    def _learn(self, chunks: pa.Array, texts: list[str]):
        """Takes the ids of new chunks of normal text into memory."""
        cut = self._cut(chunks)
        coded = cut.values.dictionary_encode()
        of, per_chunk = coded.indices.to_numpy(), np.diff(cut.offsets.to_numpy())
        ids, size = self.words(coded.dictionary)
        starts = np.cumsum(size) - size
        flat = ids[ranges(starts[of], size[of])]
        sums = np.concatenate([[0], np.cumsum(size[of])])
        ends = sums[np.cumsum(per_chunk)]
        base = len(self.known)
        self.ids = _grown(self.ids, self.used + len(flat))
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts = _grown(self.starts, base + len(texts) + 1)
        self.starts[base + 1 : base + len(texts) + 1] = ends + self.used
        self.known.update(zip(texts, range(base, base + len(texts))))
        self.used += len(flat)
        self.bytes += 4 * len(flat) + sum(map(len, texts)) + 150 * len(texts)  # a text, its entry and two numbers

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has; null is empty."""
        normal = [None if self.added.search(t) else self.normal(t) for t in (t or "" for t in texts)]
        cut = pc.ascii_split_whitespace(pa.array(normal, pa.large_string()).fill_null(""))
        coded = cut.flatten().dictionary_encode()
        chunks = _strings(coded.dictionary)
        if self.bytes > REMEMBERED_BYTES:
            self._forget()
        at = np.array(list(map(self.known.get, chunks, repeat(-1))), np.int64)
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            at[fresh] = len(self.known) + np.arange(len(fresh))
            self._learn(coded.dictionary.take(pa.array(fresh)), [chunks[i] for i in fresh.tolist()])
        starts = self.starts
        codes = coded.indices.to_numpy()
        begin, size = starts[at][codes], (starts[at + 1] - starts[at])[codes]
        ids = self.ids[ranges(begin, size)]
        edges = np.concatenate([[0], np.cumsum(size)])
        offsets = cut.offsets.to_numpy()
        count = np.diff(edges[offsets - offsets[0]])
        if None in normal:  # a text with added tokens is encoded by itself
            parts, ends = [], np.cumsum(count)
            for i, t in enumerate(normal):
                own = ids[ends[i] - count[i] : ends[i]] if t is not None else np.array(self.bpe.encode(texts[i]), np.int32)
                parts.append(own)
            ids, count = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, count


def _restored(state: dict) -> BatchBpe:
    made = BatchBpe.__new__(BatchBpe)
    made.__dict__.update(state | {"_bpe": None, "spec": None})
    made._forget()
    return made


def _strings(array: pa.Array) -> list[str]:
    """The strings of an array of texts without spaces."""
    return string_buffers(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array), pa.scalar(" ", array.type)))[0].tobytes().decode().split(" ") if len(array) else []


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    return array if size <= len(array) else np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
