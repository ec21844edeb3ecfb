"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer turns the words of a clause into symbols: insults and threats with the weights that labelled texts
give them, second persons (targets), negations, marks of reported speech, of intent, and quotation marks. Five small
transducers are composed over these symbols: reported speech, negation, target, threat and support. The best path of the
composition reads each clause; what it puts out (an insult at a target, a threat, a chain of insults, a negated or reported
one, an insult without support) has a learnt factor. An insult that stands alone in its clause, without a target, counts
only next to other matched clauses of the text, so a lone word scores nothing.
"""

from __future__ import annotations

import re
from functools import cache, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from memoglyph.llm.common import arrow_columns, fitting, is_held_out, labelled_sample, logistic, mixed, pieces, sigmoid, string_buffers, table, word_hashes, word_spans
from memoglyph.llm.near_dedup import registers

#: Labelled documents of each class that a model is fitted on, at most.
PER_CLASS = 1200
#: Bytes of the shortest and the longest word beginning that can be learnt.
STEMS = (4, 12)
#: Fitting parts: the factors of a part's clauses come from a lexicon of the other parts.
FOLDS = 5
#: Bytes of the sample's texts that are hashed at once on the driver; each array made of them takes eight times as much.
SAMPLE_BYTES = 1 << 18
TARGETS = {"you", "your", "yours", "yourself", "ur", "u", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "toi", "te", "ton", "ta", "vous", "votre", "tú", "ti", "usted", "ustedes", "vosotros"}
NEGATIONS = {"not", "no", "never", "cannot", "nicht", "kein", "keine", "keinen", "nie", "pas", "jamais", "ne", "nunca", "ni"}
REPORTS = {"said", "says", "say", "wrote", "writes", "called", "claimed", "reported", "according", "quote", "quoted", "sagte", "sagt", "schrieb", "nannte", "dit", "écrit", "selon", "dijo", "dice", "escribió", "según"}
INTENTS = {"will", "i'll", "we'll", "gonna", "going", "shall", "werde", "werden", "wird", "vais", "vas", "va", "allons", "voy", "vamos"}
#: Seeds of the insult and threat transducers; labels give the weights, and these only a start where labels lack.
INSULTS = {"idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "dumb", "imbecile", "dummkopf", "trottel", "crétin", "imbécile", "estúpido", "idiota"}
THREATS = {"kill", "destroy", "hurt", "beat", "töten", "umbringen", "tuer", "frapper", "matar", "golpear"}
SEED_WEIGHT = 1.0
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”„«»,]")
_CLAUSE_END = re.compile(r"[.!?;:\n]")
_NO_LETTERS = re.compile(r"[\W\d_]+")
#: Words before an insult in which a negation turns it; a comma ends its reach.
REACH = 3
#: What the composition puts out, in the order of the features: an insult at a target, a threat, one of several insults of a
#: clause, one insult without support, a negated one, a reported one.
READINGS = ("target", "threat", "chain", "plain", "negated", "reported")
#: What each reading adds where labels don't show it, and the text's length.
PRIOR = (1.0, 1.0, 1.0, 0.3, 0.0, 0.0, 0.0)
SYMBOLS = "IHTNRVQCO"  # insult, threat, target, negation, report, intent, quotation mark, comma after a negation, other word


class Transducer:
    """arcs: (state, symbol) -> [(output, weight, next state)]; final: state -> weight. Letter to letter, in (max, +)."""

    def __init__(self, start, arcs: dict, final: dict):
        self.start, self.arcs, self.final = start, arcs, final

    def __matmul__(self, other: Transducer) -> Transducer:
        """The composition: other reads what this one puts out."""
        start = (self.start, other.start)
        arcs, final, todo, seen = {}, {}, [start], {start}
        symbols = {s for _, s in self.arcs}
        while todo:
            at = todo.pop()
            if at[0] in self.final and at[1] in other.final:
                final[at] = self.final[at[0]] + other.final[at[1]]
            for symbol in symbols:
                for out, w, p in self.arcs.get((at[0], symbol), ()):
                    for out2, w2, q in other.arcs.get((at[1], out), ()):
                        arcs.setdefault((at, symbol), []).append((out2, w + w2, (p, q)))
                        if (p, q) not in seen:
                            seen.add((p, q))
                            todo.append((p, q))
        return Transducer(start, arcs, final)

    def numbered(self) -> Transducer:
        """The same with whole numbers as states."""
        states: dict = {}
        of = lambda s: states.setdefault(s, len(states))
        start = of(self.start)
        arcs = {(of(s), x): [(o, w, of(n)) for o, w, n in a] for (s, x), a in self.arcs.items()}
        return Transducer(start, arcs, {of(s): w for s, w in self.final.items()})

    def best(self, symbols) -> tuple[float, list]:
        """The weight and the outputs of the best path; of equally good ones the first found."""
        paths: dict = {self.start: (0.0, None)}
        for symbol in symbols:
            after: dict = {}
            for state, (weight, trail) in paths.items():
                for out, w, to in self.arcs.get((state, symbol), ()):
                    known = after.get(to)
                    if known is None or weight + w > known[0]:
                        after[to] = (weight + w, (out, trail))
            paths = after
        ends = [(w + self.final[s], trail) for s, (w, trail) in paths.items() if s in self.final]
        if not ends:
            return float("-inf"), []
        weight, trail = max(ends, key=lambda e: e[0])
        outs = []
        while trail is not None:
            outs.append(trail[0])
            trail = trail[1]
        return weight, outs[::-1]


def _machine(start, symbols: str, states, special: dict, final: dict) -> Transducer:
    """A transducer that passes symbols on in every state but where `special` says otherwise."""
    arcs = {(s, x): [(x, 0.0, s)] for s in states for x in symbols}
    return Transducer(start, arcs | special, final)


@cache
def parts() -> tuple[Transducer, ...]:
    """The transducers of the grammar, in the order of their composition.

    Between them travel: I, H insult and threat; i reported, n negated; a and A an insult without and with a target, h and
    H a threat without and with one; - a quotation mark; T, N, V, C, O as in SYMBOLS.
    """
    # reported speech: after a reporting word, or inside quotation marks, insults and threats are someone else's
    told = {}
    for s, after_r, after_q in (("direct", "said", "quoted"), ("said", "said", "said"), ("quoted", "quoted", "direct")):
        told |= {(s, "R"): [("O", 0.0, after_r)], (s, "Q"): [("-", 0.0, after_q)]}
        if s != "direct":
            told |= {(s, x): [("i", 0.0, s)] for x in "IH"}
    report = _machine("direct", "IHTNVCO", ("direct", "said", "quoted"), told, {"direct": 0.0, "said": 0.0, "quoted": 0.0})
    # negation: it turns what follows within REACH words, up to a comma
    turned = {}
    for left in range(REACH + 1):
        down = max(0, left - 1)
        turned |= {(left, x): [("n" if left and x in "IH" else x, 0.0, down)] for x in "IHiTVO"}
        turned |= {(left, "N"): [("O", 0.0, REACH)], (left, "-"): [("-", 0.0, left)], (left, "C"): [("-", 0.0, 0)]}
    negation = Transducer(0, turned, dict.fromkeys(range(REACH + 1), 0.0))
    # target: the path either claims one, which has to come in this clause, before or after the insult, or it doesn't
    aimed = {}
    for s, to in (("none", "none"), ("wait", "seen"), ("seen", "seen")):
        insult, threat, gain = ("a", "h", 0.5) if s == "none" else ("A", "H", 1.0)
        aimed |= {(s, x): [(x, 0.0, s)] for x in "inVO-"} | {(s, "T"): [("O", 0.0, to)], (s, "I"): [(insult, gain, s)], (s, "H"): [(threat, gain, s)]}
    begin = {("begin", x): aimed["none", x] + aimed["wait", x] for x in "IHinTVO-"}
    target = Transducer("begin", aimed | begin, {"begin": 0.0, "none": 0.0, "seen": 0.0})
    # threat: a threat at a target, or after a word of intent; and what a target is told after one
    meant = {}
    for s in ("open", "meant"):
        meant |= {(s, x): [(x, 0.0, s)] for x in "aHinO-"} | {(s, "V"): [("O", 0.0, "meant")]}
        meant |= {(s, x): [("H" if s == "meant" else out, 0.0, s)] for x, out in (("A", "A"), ("h", "a"))}
    threat = Transducer("open", meant, {"open": 0.0, "meant": 0.0})
    # support: insults without a target are a chain if the clause has several
    words = {"A": "target", "H": "threat", "i": "reported", "n": "negated", "O": "", "-": ""}
    arcs = {(s, x): [(out, 0.0, s)] for s in ("no", "one", "want 2", "want 1", "chain") for x, out in words.items()}
    arcs |= {("no", "a"): [("plain", 0.0, "one"), ("chain", 0.1, "want 1")], ("want 1", "a"): [("chain", 0.1, "chain")], ("chain", "a"): [("chain", 0.1, "chain")]}
    support = Transducer("no", arcs, {"no": 0.0, "one": 0.0, "chain": 0.0})
    return report, negation, target, threat, support


@cache
def composed() -> Transducer:
    return reduce(Transducer.__matmul__, parts()).numbered()


class Grammar:
    """lexicon: word -> weight; stems: word beginning -> weight; threats: those of both that are threats; weights: of the features, the bias last."""

    def __init__(self, lexicon: dict[str, float], stems: dict[str, float], weights: np.ndarray | None = None, threats: set[str] = frozenset(THREATS)):
        self.lexicon, self.stems, self.weights, self.threats = lexicon, stems, weights, threats

    def opened(self) -> Grammar:
        """With the automaton that finds all insults and threats of a text in one pass."""
        self.automaton = ahocorasick.Automaton()
        for word, weight in self.lexicon.items():
            self.automaton.add_word(word, (len(word), weight, word in self.threats, False))
        for stem, weight in self.stems.items():
            if stem not in self.lexicon:
                self.automaton.add_word(stem, (len(stem), weight, stem in self.threats, True))
        if len(self.automaton):
            self.automaton.make_automaton()
        return self

    def matches(self, text: str):
        """(start, end, weight, is a threat) of each insult or threat: a whole word, or a word with a known beginning."""
        if not len(self.automaton):
            return
        seen = -1
        for last, (size, weight, is_threat, is_stem) in self.automaton.iter(text):
            start, end = last - size + 1, last + 1
            if start <= seen or (start and text[start - 1].isalpha()):
                continue
            goes_on = end < len(text) and text[end].isalpha()
            if goes_on and not is_stem:
                continue
            while end < len(text) and text[end].isalpha():
                end += 1
            if is_stem and text[start:end] in self.lexicon:
                weight, is_threat = self.lexicon[text[start:end]], text[start:end] in self.threats
            seen = start
            yield start, end, weight, is_threat

    def clauses(self, text: str) -> dict[tuple[int, int], list[tuple[str, float, str]]]:
        """Each clause with an insult or threat, as (start, end) -> [(reading, weight, matched text)]; linear in the text."""
        text = text.lower()
        read = {}
        ends = _CLAUSE_END.finditer(text)
        a, stop = 0, next(ends, None)
        own: list[tuple[int, int, float, bool]] = []
        for match in self.matches(text):
            while stop is not None and stop.start() < match[0]:
                if own:
                    read[a, stop.start()] = self._read(text, a, stop.start(), own)
                    own = []
                a, stop = stop.end(), next(ends, None)
            own.append(match)
        if own:
            b = len(text) if stop is None else stop.start()
            read[a, b] = self._read(text, a, b, own)
        return read

    @staticmethod
    def _read(text: str, a: int, b: int, matches: list):
        """The best reading of one clause. Runs of other words are as good as REACH of them."""
        symbols: list[str] = []
        at = run = 0
        for token in _TOKEN.finditer(text, a, b):
            word = token[0]
            if at < len(matches) and token.start() <= matches[at][0] < token.end():
                while at < len(matches) and matches[at][0] < token.end():
                    symbols.append("H" if matches[at][3] else "I")
                    at += 1
                run = 0
                continue
            if word == ",":
                # others don't change the reading
                if "N" in symbols[-REACH - 1 :]:
                    symbols.append("C")
                continue
            if not word[0].isalpha():
                symbol = "Q"
            elif word in NEGATIONS or word.endswith(("n't", "n’t")):
                symbol = "N"
            elif word in TARGETS:
                symbol = "T"
            elif word in REPORTS:
                symbol = "R"
            elif word in INTENTS or word.endswith(("'ll", "’ll")):
                symbol = "V"
            else:
                symbol = "O"
            run = run + 1 if symbol == "O" else 0
            if run <= REACH:
                symbols.append(symbol)
        _, outs = composed().best(symbols)
        read = [o for o, s in zip(outs, symbols, strict=True) if s in "IH"]
        return [(r, m[2], text[m[0] : m[1]]) for r, m in zip(read, matches, strict=True)]

    def features(self, text: str | None) -> list[float]:
        """Of each reading, the saturated sum over the matched clauses; then the text's length.

        The strongest insult without support counts only with other matched clauses, so a lone word gives none.
        """
        sums = dict.fromkeys(READINGS, 0.0)
        lone, n = 0.0, 0
        for found in self.clauses(text or "").values():
            n += 1
            for reading, weight, _ in found:
                sums[reading] += weight
                if reading == "plain":
                    lone = max(lone, weight)
        if n == 1:
            sums["plain"] -= lone
        return [*(np.log1p(max(0.0, sums[r])) for r in READINGS), np.log1p(len(text or "")) / 10]


def families(texts: list[str], alike: float = 0.5) -> np.ndarray:
    """Indices of texts of which no earlier one shares about half of its words, so that copies count once."""
    whole = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    marks = np.zeros((len(texts), 32), np.uint16)
    done = 0
    for piece in pieces(whole, SAMPLE_BYTES):
        hashes, at = word_hashes(*string_buffers(piece.column(0)))
        marks[done : done + piece.num_rows] = registers([np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], 32)
        done += piece.num_rows
    first: list[int] = []
    for i in range(len(texts)):
        if not first or (marks[first] == marks[i]).mean(axis=1).max() < alike:
            first.append(i)
    return np.array(first, dtype=np.int64)


def _entries(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(hashes, starts, ends, bytes) of a text's distinct words in lower case and of all their beginnings.

    The words come first, marked by a hash of their own; beginnings end between characters.
    """
    data = _NO_LETTERS.sub(" ", text.lower()).encode()
    raw = np.frombuffer(data, np.uint8)
    hashes, starts, ends, prefix = word_spans(raw)
    _, at = np.unique(hashes, return_index=True)
    starts, ends = starts[at], ends[at]
    out = [(mixed(hashes[at] ^ np.uint64(1)), starts, ends)]
    padded = np.concatenate([raw, np.full(STEMS[1] + 1, 32, np.uint8)])
    for k in range(STEMS[0], STEMS[1] + 1):
        fits = (ends - starts >= k) & ((padded[starts + k] & 0xC0) != 0x80)
        out.append((prefix(starts[fits], k), starts[fits], starts[fits] + k))
    return *(np.concatenate(x) for x in zip(*out, strict=True)), data


class _Counts:
    """The entries of the sample's texts, counted once; a lexicon of any part of them comes from it."""

    def __init__(self, texts: list[str], y: np.ndarray):
        self.texts, self.y, self.first = texts, y, families(texts)
        self.entries = {int(i): _entries(texts[i])[0] for i in self.first}

    def grammar(self, which: np.ndarray) -> Grammar:
        """A grammar without weights, of the words and word beginnings that toxic texts hold more often than chance and four times as often as clean ones.

        Entries count once for each distinct word of a text. Of all entries, chance would let less than one pass (a
        likelihood-ratio test); an entry stands in two toxic texts at least. Of entries that begin alike the strongest stays.
        """
        own = [int(i) for i in self.first if which[i]]
        of = lambda k: np.concatenate([np.zeros(0, np.uint64), *(self.entries[i] for i in own if self.y[i] == k)])
        (toxic, n1), (clean, n0) = (np.unique(of(k), return_counts=True) for k in (1, 0))
        lexicon, stems, threats = dict.fromkeys(INSULTS | THREATS, SEED_WEIGHT), {}, set(THREATS)
        if not len(toxic) or not len(clean):
            return Grammar(lexicon, stems, None, threats).opened()
        at = np.minimum(np.searchsorted(clean, toxic), len(clean) - 1)
        n0 = np.where(clean[at] == toxic, n0[at], 0).astype(float)
        n1 = n1.astype(float)
        all1, all0 = n1.sum(), float(sum(len(self.entries[i]) for i in own if self.y[i] == 0))
        share = all1 / (all1 + all0)
        gain = n1 * np.log(n1 / ((n1 + n0) * share)) + np.where(n0 > 0, n0 * np.log(np.maximum(n0, 1) / ((n1 + n0) * (1 - share))), 0)
        odds = np.log((n1 + 0.5) / (all1 + 1)) - np.log((n0 + 0.5) / (all0 + 1))
        keep = (odds > np.log(4)) & (gain > np.log(len(toxic) + len(clean)))
        told = dict(zip(toxic[keep].tolist(), zip(gain[keep].tolist(), odds[keep].tolist(), strict=True), strict=True))
        names: dict[int, tuple[str, bool]] = {}
        texts_with: dict[int, int] = {}
        for i in own:
            if self.y[i] != 1:
                continue
            hashes, starts, ends, data = _entries(self.texts[i])
            n_words = len(np.unique(starts))  # the distinct words come first
            hit = np.flatnonzero(np.isin(hashes, toxic[keep]))
            for h in set(hashes[hit].tolist()):
                texts_with[h] = texts_with.get(h, 0) + 1
            for j in hit.tolist():
                names.setdefault(int(hashes[j]), (data[starts[j] : ends[j]].decode(), j < n_words))
        strongest = sorted((h for h in names if texts_with[h] >= 2), key=lambda h: (-told[h][0], not names[h][1], names[h][0]))
        kept: set[str] = set()
        begun: set[str] = set()
        for h in strongest:
            name, is_whole = names[h]
            begins = [name[:k] for k in range(1, len(name) + 1)]
            if name in begun or not kept.isdisjoint(begins):
                continue
            kept.add(name)
            begun.update(begins)
            (lexicon if is_whole else stems)[name] = told[h][1]
            # an inflected threat is one
            if any(name.startswith(t) or t.startswith(name) for t in THREATS):
                threats.add(name)
        return Grammar(lexicon, stems, None, threats).opened()


@fitting
def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Grammar:
    """A grammar for labels.toxic, from at most per_class documents of each class outside the held-out quarter.

    The lexicon comes from the whole sample; the factors of the readings from features of each part under a lexicon of
    the others, so that they hold for unseen texts. One class alone gives a constant. Null and empty texts, repeated rows,
    ties and further columns of docs don't matter: only doc_id and text are read, and copies count once.
    """
    texts, y, weight = labelled_sample(docs, labels, "toxic", per_class)
    counts = _Counts(texts, y)
    part = np.arange(len(y)) % FOLDS
    features = np.zeros((len(y), len(READINGS) + 1))
    for k in range(FOLDS):
        other = counts.grammar(part != k)
        for i in np.flatnonzero(part == k):
            features[i] = other.features(texts[i])
    out = counts.grammar(part >= 0)
    out.weights = logistic(features, y, weight, l2=1e-4, prior=PRIOR)
    return out


def score(docs: DataFrame, grammar: Grammar, keep: list[str] | None = None, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score of 0 to 1 for each whole text, higher if toxic is likelier; null and empty texts have no clauses.

    One pass without a shuffle; the grammar (words learnt from the bounded sample) is broadcast. A column named `out` is
    replaced; others, whatever their names, stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast((grammar.lexicon, grammar.stems, grammar.weights, grammar.threats))

    def make():
        own = Grammar(*shared.value).opened()

        def step(texts: pa.Array):
            x = np.array([own.features(t.as_py()) for t in texts]).reshape(len(texts), len(READINGS) + 1)
            return [pa.array(sigmoid(x @ own.weights[:-1] + own.weights[-1]))]

        return step

    return arrow_columns(docs, [text], [T.StructField(out, T.DoubleType())], make, keep)


#: A text of this score or more counts as toxic.
TOXIC_FROM = 0.3


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole text of documents: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    grammar = fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = score(docs, grammar, keep=["doc_id"])
    return scored.select("doc_id", is_held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))
