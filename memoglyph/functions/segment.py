"""Words of texts that are written without spaces: the likeliest path over a dictionary's word graph.

The dictionary is a table of words and how often each occurs. A run of CJK characters is cut so that the product of its words'
shares is largest; a character that no word covers counts as if it occurred once. Of equally likely cuts, the one with the
longer first word is taken, then the longer second one, and so on. Runs are cut one by one and each distinct run of a batch once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from memoglyph.functions.text import search_tokens
from memoglyph.operators.lifecycle import checkpointed

# fixed values: the characters that runs are made of, as in search tokens
RUN = "一-鿿"
#: A dictionary is sent to all executors: this many words at most, the most frequent ones (ties by code point), of this length.
MOST_WORDS, LONGEST_WORD = 200_000, 8
#: Texts of so many characters are cut at once, of a longer one so many characters.
PIECE = 1_000_000
#: Shares are compared as logarithms in steps of this, so that equal products tie whatever order they are added in.
STEP = 1e-9
#: The cost of what is no word.
NONE = 1 << 60
_RUNS = re.compile(f"[{RUN}]+")


def counted_words(df: DataFrame, words: str = "words", longest: int = LONGEST_WORD) -> DataFrame:
    """word, n: how often each word of two characters or more stands in the arrays of a column, among runs of CJK characters.

    Null arrays and words count nothing. Repeats within an array are added up before anything is shuffled.
    """
    first, last = RUN.split("-")
    # words are told by their first character before they are counted, by all of them after
    # explode() would look at the arrays in a filter first, which makes them twice
    each = df.select(F.explode_outer(words).alias("word")).where((F.col("word") >= first) & (F.col("word") < chr(ord(last) + 1)))
    return each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("word").rlike(f"^[{RUN}]{{2,{longest}}}$"))


def found_words(df: DataFrame, text: str = "text", longest: int = 4, least: int = 5, cohesion: float = 8.0) -> DataFrame:
    """word, n: sequences of 2 to `longest` CJK characters of a corpus without a dictionary that hold together.

    A sequence is a word where it occurs `least` times or more and, for each place that it could be cut in two, at least
    `cohesion` times as often as its two parts would meet by chance. All texts are counted, as wholes.
    """
    runs = df.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"([{RUN}]+)"), 1)).alias("run"))
    starts = runs.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at"))
    pieces = starts.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - F.col("at") + 1)), lambda k: F.substring(F.col("run"), F.col("at"), k))).alias("word"))
    counts = checkpointed(pieces.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= least) | (F.length("word") == 1)))
    total = counts.where(F.length("word") == 1).agg(F.sum("n")).first()[0] or 0
    cuts = counts.where(F.length("word") > 1).select("*", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k"))
    a = counts.select(F.col("word").alias("left"), F.col("n").alias("a"))
    b = counts.select(F.col("word").alias("right"), F.col("n").alias("b"))
    halves = cuts.withColumns({"left": F.substring(F.col("word"), F.lit(1), F.col("k")), "right": F.substring(F.col("word"), F.col("k") + 1, F.length("word"))})
    bound = halves.join(a, "left").join(b, "right").withColumn("lift", F.col("n") * F.lit(float(total)) / (F.col("a").cast("double") * F.col("b")))
    return bound.groupBy("word").agg(F.first("n").alias("n"), F.min("lift").alias("lift")).where(F.col("lift") >= cohesion).select("word", "n")


class Dictionary:
    """Words' costs: whole numbers of STEP, the negative logarithm of a share of all counts."""

    def __init__(self, counts: dict[str, int]):
        total = math.log(max(sum(counts.values()), 1))
        self.unknown = round(total / STEP)
        self.costs = {w: round((total - math.log(n)) / STEP) for w, n in counts.items() if n > 0}
        self.longest = max(map(len, self.costs), default=1)

    def cut(self, run: str) -> list[str]:
        """The words of a run, whose concatenation it is. Time and memory grow with the run's length alone."""
        n = len(run)
        cost, step = [0] * (n + 1), [1] * n
        costs, longest = self.costs, self.longest
        for i in range(n - 1, -1, -1):
            best, size = costs.get(run[i], self.unknown) + cost[i + 1], 1
            for k in range(2, min(longest, n - i) + 1):
                c = costs.get(run[i : i + k])
                if c is not None and c + cost[i + k] <= best:
                    best, size = c + cost[i + k], k
            cost[i], step[i] = best, size
        out, i = [], 0
        while i < n:
            out.append(run[i : i + step[i]])
            i += step[i]
        return out


def dictionary(words: DataFrame, most: int = MOST_WORDS) -> Dictionary:
    """The `most` most frequent words of (word, n); rows of a word are added up, null words and counts under one left out."""
    summed = words.where("word IS NOT NULL AND word <> '' AND n > 0").groupBy("word").agg(F.sum("n").alias("n"))
    kept = summed.orderBy(F.desc("n"), "word").limit(most)
    return Dictionary({r["word"]: r["n"] for r in kept.toLocalIterator()})


class Cutter:
    """Dictionary.cut() of many runs at once, in arrays.

    Words that begin at a place are found by a trie, level by level. The likeliest path is taken from the right, in chunks side by
    side: each begins some characters further right, with costs that aren't known there. What it finds holds if the costs at its
    end differ among each other as those of the chunk right of it, which is looked at; else it is taken again from these.
    """

    CHUNK, BEGIN = 512, 64

    def __init__(self, words: Dictionary):
        self.longest = words.longest
        letters = sorted({ch for w in words.costs for ch in w})
        # 0 stands between runs, 1 for all other characters
        self.code = np.ones(1 << 16, np.int64)
        self.code[[ord(ch) for ch in letters if ord(ch) < 1 << 16]] = [i + 2 for i, ch in enumerate(letters) if ord(ch) < 1 << 16]
        self.code[0], self.size = 0, len(letters) + 2
        of = {ch: i + 2 for i, ch in enumerate(letters)}
        self.single = np.full(self.size, words.unknown, np.int64)
        self.single[0] = 0
        steps, cost = {}, [NONE] * self.size  # a node for each code, then one for each longer beginning of a word
        for word, c in words.costs.items():
            node = of[word[0]]
            for ch in word[1:]:
                node = steps.setdefault(node * self.size + of[ch], len(cost))
                if node == len(cost):
                    cost.append(NONE)
            if len(word) > 1:
                cost[node] = c
            else:
                self.single[node] = c
        self.cost = np.array(cost, np.int64)
        self.bits = max(4, (4 * len(steps)).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        keys, to = np.array(list(steps), np.int64), np.array(list(steps.values()), np.int64)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.to[at[put]] = keys[put], to[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, to, at = keys[left], to[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, keys: np.ndarray) -> np.ndarray:
        """The node that each key leads to; 0: none."""
        out, at, left = np.zeros(len(keys), np.int64), self._slot(keys), np.arange(len(keys))
        while len(left):
            held = self.keys[at]
            hit = held == keys[left]
            out[left[hit]] = self.to[at[hit]]
            on = ~hit & (held >= 0)
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def _costs(self, codes: np.ndarray, n: int) -> np.ndarray:
        """The cost of each word that begins at each of the first n places, the longest first."""
        out = np.full((n, self.longest), NONE, np.int64)
        out[:, -1] = self.single[codes[:n]]
        at = np.flatnonzero(codes[:n] > 1)
        node = codes[at]
        for k in range(2, self.longest + 1):
            node = self._next(node * self.size + codes[at + k - 1])
            at, node = at[node > 0], node[node > 0]
            out[at, self.longest - k] = self.cost[node]
        return out

    def steps(self, codes: np.ndarray) -> np.ndarray:
        """The length of the word that begins at each place of runs with a 0 after each, if one does."""
        n, k = len(codes), self.longest
        codes = np.concatenate([codes, np.zeros(self.BEGIN + k + self.CHUNK, np.int64)])
        out = np.ones(n, np.int64)
        state = np.zeros(k, np.int64)  # costs of the k places right of what is left
        for b in range(n, 0, -PIECE):
            a = max(0, b - PIECE)
            costs = self._costs(codes[a:], b - a + self.BEGIN)
            ends = np.arange(b - a, 0, -self.CHUNK)
            held, chosen = np.zeros((self.CHUNK + self.BEGIN + k, len(ends)), np.int64), np.zeros((self.CHUNK, len(ends)), np.int8)
            for t in range(self.CHUNK + self.BEGIN):
                at = np.maximum(ends + (self.BEGIN - 1 - t), 0)
                sums = costs[at] + held[t : t + k].T
                best = sums.argmin(axis=1)  # of equal sums the first, which is the longest word's
                held[t + k] = sums[np.arange(len(ends)), best]
                if t >= self.BEGIN:
                    chosen[t - self.BEGIN] = k - best
            for j, end in enumerate(ends):
                guess, m = held[self.BEGIN : self.BEGIN + k, j], min(self.CHUNK, end)
                if (guess - guess[-1] == state - state[-1]).all():
                    out[a + end - m : a + end] = chosen[:m, j][::-1]
                    state = held[self.BEGIN + m : self.BEGIN + m + k, j]
                else:
                    for at in range(end - 1, end - m - 1, -1):
                        sums = costs[at] + state
                        best = int(sums.argmin())
                        out[a + at] = k - best
                        state = np.append(state[1:], sums[best])
                state = state - state[-1]
        return out

    def words(self, texts: list[str | None]) -> pa.ListArray:
        """The words of the runs of each text."""
        runs = [_RUNS.findall(t or "") for t in texts]
        joined = "".join(run + "\0" for of in runs for run in of)
        codes = self.code[np.frombuffer(joined.encode("utf-16-le"), np.uint16)]
        steps, starts, at = self.steps(codes).tolist(), [], 0
        while at < len(steps):
            starts.append(at)
            at += steps[at]
        starts = np.array(starts, np.int64)
        gaps = np.cumsum(codes == 0)
        starts = starts[codes[starts] != 0]
        # all characters of runs have three bytes, and the words are all of them
        offsets = np.append(3 * (starts - gaps[starts]), 3 * (len(codes) - (gaps[-1] if len(gaps) else 0))).astype(np.int32)
        data = joined.replace("\0", "").encode()
        values = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))
        ends = np.cumsum([0, *(sum(len(run) + 1 for run in of) for of in runs)])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, ends).astype(np.int32)), values)


def segmented(df: DataFrame, words: Dictionary, text: str = "text", out: str = "words") -> DataFrame:
    """df with the words of its texts, in their order and with repeats: CJK runs cut, everything else left out; null: no words.

    The dictionary is of bounded size and goes to the executors once. Rows aren't shuffled.
    """
    sent = df.sparkSession.sparkContext.broadcast(Cutter(words))

    @F.arrow_udf("array<string>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = sent.value
        for batch in batches:
            done, texts, size = [], [], 0
            for t in batch:
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if size >= PIECE:
                    done.append(held.words(texts))
                    texts, size = [], 0
            yield pa.concat_arrays([*done, held.words(texts)])

    return df.withColumn(out, cut(F.col(text)))


def segmented_tokens(text: Column, words: Column) -> Column:
    """Distinct search tokens of a text with its words (those of two characters or more) before them, in order."""
    return F.array_distinct(F.concat(F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.length(w) > 1), search_tokens(text)))
