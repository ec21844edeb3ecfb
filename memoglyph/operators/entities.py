"""Names, their types, relations and pronouns in running text.

Candidates and relations are expressions over the text, so they stay in the JVM; types and pronouns need all names of a
text at once and run as passes over its rows, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from memoglyph.functions.text import normalize_spaces

# fixed values: words that are no names, in lower case
ENGLISH = (
    "the a an and or but in on at to for of with by as is was are were be been being have has had do does did will would could should may might must shall can this that these those it its they them their "
    "we our you your i my me he she his her who what when where why how which if then so not no yes ok okay just really very also already still even only here there now too up out about like true false none "
    "new old all any some every each more less next last first second hey hi hello thanks thank right"
).split()
PROGRAMMING = (
    "return print def class import function const let var async await try catch throw finally switch case break continue while for else elif yield raise pass global nonlocal lambda static public private "
    "protected final abstract extends implements void null undefined typeof instanceof self cls kwargs arg str int bool dict"
).split()
PROSE = (
    "step usage run check find add set list args path file name note example option result error warning info returns raises item key value type system agent agents tool tools memory model models network networks "
    "training inference data content thing things way ways time times day days part parts point points idea ideas fact facts sense question answer reason number version people person something nothing everything "
    "anything someone everyone stack layer mode test stop start copy move source target output outputs input inputs records record entry entries use get got make made take put come go see know think"
).split()
CHINESE = list("的是在有我你他她它了和与及或不这那也还又就但而则因所以为于上下中后前里外之其并觉得能会可要想说看来去用把被让给向往") + ["prefer", "prefers"]
STOPWORDS = list(dict.fromkeys([*ENGLISH, *PROGRAMMING, *PROSE, *CHINESE]))
# fixed values: characters that no Chinese personal name has
NO_NAME = "这那的了在和与或有为之乎者也就都而且但把被让从到对于上下中内外前后里呢啊吧呀吗么"

# fixed values: what stands around a person's and a project's name, letter case ignored
PERSON = [
    "{name} said", "{name} told", "{name} asked", "{name} replied", "{name} wrote", "{name} thinks", "{name} believes", "{name} wants", "{name} knows", "{name} decided", "{name} prefers", "{name} told me",
    "hey {name}", "hi {name}", "dear {name}", "thanks {name}", "{name} works on", "{name} working on", "{name} is working", "{name} helped", "{name} uses", "{name} built", "{name} created", "{name} with {name}", r"\bwith\s+{name}",
]
PROJECT = [
    "building {name}", "built {name}", "ship {name}", "shipped {name}", "deploy {name}", "deployed {name}", "install {name}", "installed {name}", "the {name} architecture", "the {name} system", "the {name} pipeline",
    "{name} v", "{name} v1", "{name} v2", "the {name} repo", "{name}.py", "{name}.js", "{name}.ts", "{name}.go", "{name}-core", "{name}-local", "{name}-server", "pip install {name}", "npm install {name}",
]
CHINESE_PERSON = [
    "{name}说", "{name}告诉", "{name}问", "{name}回答", "{name}写道", "{name}觉得", "{name}相信", "{name}想", "{name}知道", "{name}决定", "{name}喜欢", "喂{name}", "嗨{name}", "你好{name}", "{name}正在", "{name}在用", "{name}用的是",
    "{name}在", "{name}在", "{name}做了", "{name}做的", "{name}也是", "{name}也很", "{name}也帮",
]
CHINESE_PROJECT = ["用{name}", "使用{name}", "{name}项目", "{name}系统", "{name}架构", "{name}版本", "{name} v", "{name}.py", "{name}.js", "装了{name}", "安装了{name}", "部署{name}"]
#: Those that name a project by themselves.
CHINESE_PROJECT_NAMES = ["版本", " v", ".py", ".js"]
# fixed values: relations; a predicate is the subject, the word in the middle and, where it has one, the second group
_END = r"([^\s,，；;]+)"
_WHOLE = r"(?<![^\s,，；;])([^\s,，；;]++)"
RELATIONS = [
    (rf"{_END}\s+(?:is|are)\s+(?:the\s+)?([A-Za-z0-9_]+)\s+of\s+([^\n]+)", "is", "_of"),
    (rf"{_END}\s+(?:is|are)\s+(?:a|an)\s+{_END}", "is", ""),
    (rf"{_END}\s+(?:uses|using|used)\s+{_END}", "uses", ""),
    (rf"{_END}\s+(?:built|building|creates?)\s+{_END}", "builds", ""),
    (rf"{_END}\s+(?:owns?|owning)\s+{_END}", "owns", ""),
    (rf"{_END}\s+(?:works? on|working on)\s+{_END}", "works_on", ""),
    (rf"{_END}\s+(?:depends? on|depends on)\s+{_END}", "depends_on", ""),
    (rf"{_END}\s+(?:calls? |calls)\s+{_END}", "calls", ""),
    (rf"{_END}\s+(?:store(?:s(?: data in)?)?)\s+{_END}", "stores_in", ""),
    (rf"{_END}\s+(?:integrate(?:s(?: with)?)?)\s+{_END}", "integrates_with", ""),
    (rf"{_END}\s+(?:run(?:s|ning on)?)\s+{_END}", "runs_on", ""),
    (rf"{_END}\s+(?:provide(?:s(?: with)?)?)\s+{_END}", "provides", ""),
    (rf"{_END}\s+(?:told)\s+{_END}", "told", ""),
]
PRONOUNS = ["she", "her", "hers", "he", "him", "his", "they", "them", "it", "this"]

#: One capitalised word, and two to five of them; word boundaries of ASCII in every engine.
SINGLE = r"(?<![A-Za-z0-9_])([A-Z][a-zA-Z0-9]{1,24})(?![A-Za-z0-9_])"
PHRASE = r"(?<![A-Za-z0-9_])([A-Z][a-zA-Z0-9]+(?:\s+[A-Z][a-zA-Z0-9]+){1,4})(?![A-Za-z0-9_])"
_LATIN_OR_HAN = r"([一-鿿]{1,4}|[A-Za-z0-9_.-]{1,20})"
LEAST_TEXT = 10


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "[.,;!?。，；]+$", "")


def _all_where(there: Column, text: Column, pattern: str) -> Column:
    """The first groups of all matches in a text that has what a match needs; others aren't searched."""
    return F.when(there, F.regexp_extract_all(text, F.lit(pattern), 1)).otherwise(F.array().cast("array<string>"))


def _names_at_anchors(text: Column) -> tuple[Column, Column]:
    """Distinct Chinese names of persons, and names of projects, that stand at a pattern; they needn't be capitalised."""
    persons = []
    for p in CHINESE_PERSON:
        before, after = p.split("{name}")
        if after:
            persons.append(_all_where(text.contains(after), text, f"{before}([一-鿿]{{2,3}}){after}"))
    fine = lambda n: (F.size(F.array_distinct(F.filter(F.split(n, ""), lambda c: c != ""))) > 1) & ~n.rlike(f"[{NO_NAME}]")
    projects = [_all_where(text.contains(after), text, _LATIN_OR_HAN + re.escape(after)) for after in CHINESE_PROJECT_NAMES]
    return F.filter(F.array_distinct(F.concat(*persons)), fine), F.filter(F.array_distinct(F.concat(*projects)), lambda n: F.length(n) >= 2)


def candidates(df: DataFrame, text: str = "content", least: int = 1) -> DataFrame:
    """id, name, frequency: capitalised words and phrases without stop words, and names that stand at a pattern.

    Words and phrases are counted apart; a name at patterns counts once. Texts of less than LEAST_TEXT characters have none.
    """
    body = normalize_spaces(text)
    stop = F.array(*(F.lit(w) for w in STOPWORDS))
    persons, projects = _names_at_anchors(F.col("t"))
    single = F.filter(F.regexp_extract_all("t", F.lit(SINGLE), 1), lambda w: ~F.lower(w).isin(STOPWORDS))
    phrase = F.filter(F.regexp_extract_all("t", F.lit(PHRASE), 1), lambda w: ~F.arrays_overlap(stop, F.split(F.lower(w), r"\s+")))
    rows = df.select("id", F.when(F.length(body) >= LEAST_TEXT, body).otherwise("").alias("t"))
    return rows.select("id", F.explode(F.concat(single, phrase, persons, projects)).alias("name")).groupBy("id", "name").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least)


def relations(df: DataFrame, text: str = "content") -> DataFrame:
    """id, subject, predicate, object, confidence (0.7) of each match of RELATIONS; ends of three characters or more that aren't stop words."""

    def found(pattern: str, middle: str, end: str):
        last = 3 if end else 2
        # the pattern without its ends shows quickly that a text has no match
        guard = F.col("t").rlike("(?i)" + pattern.removeprefix(_END).removesuffix("([^\\n]+)").removesuffix(_END))
        # a subject is a whole run of its characters, as a match ends with such a run: other places and shorter runs needn't be tried
        pattern = "(?i)" + _WHOLE + pattern.removeprefix(_END)
        name = lambda s, p: F.concat(F.regexp_replace(F.lower(s), r"\s+", "_"), F.lit(f"_{middle}_"), F.regexp_replace(F.regexp_replace(F.lower(p), "[.,;!?。，；]+$", ""), r"\s+", "_"), F.lit(end))

        def parts(m: Column) -> Column:
            s, p, o = (F.regexp_extract(m, pattern, g) for g in (1, 2, last))
            return F.struct(_trimmed(s).alias("subject"), name(_trimmed(s), p).alias("predicate"), _trimmed(o).alias("object"))

        matches = F.when(guard, F.regexp_extract_all(F.col("t"), F.lit(pattern), 0)).otherwise(F.array().cast("array<string>"))
        return F.transform(matches, parts)

    rows = df.select("id", normalize_spaces(text).alias("t")).where(F.length("t") >= LEAST_TEXT)
    ends = rows.select("id", F.inline(F.flatten(F.array(*(found(*r) for r in RELATIONS)))))
    fine = (F.length("subject") >= 3) & (F.length("object") >= 3) & ~F.lower("subject").isin(STOPWORDS) & ~F.lower("object").isin(STOPWORDS)
    return ends.where(fine).withColumn("confidence", F.lit(0.7))


_SINGLE, _PHRASE, _STOP = re.compile(SINGLE), re.compile(PHRASE), frozenset(STOPWORDS)
#: The longest name at a pattern of projects; (what stands after a name, pattern) of projects, (before, after, pattern) of persons.
_LONGEST_AT = 20
#: Names up to which each is counted by itself.
FEW = 100
_PROJECT_NAMES = [(after, re.compile(_LATIN_OR_HAN + re.escape(after))) for after in CHINESE_PROJECT_NAMES]
_PERSON_NAMES = [(b, a, re.compile(f"{b}([一-鿿]{{2,3}}){a}")) for b, a in (p.split("{name}") for p in CHINESE_PERSON) if a]


def _places(text: str, part: str) -> Iterator[int]:
    """All places of a part in a text, also those that overlap."""
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def _before(text: str, after: str) -> Iterator[str]:
    """The stretches of a text in which a name at a pattern can stand before `after`; those that touch are one."""
    start = end = 0
    for at in _places(text, after):
        if end and at - _LONGEST_AT > end:
            yield text[start:end]
            end = 0
        if not end:
            start = max(0, at - _LONGEST_AT)
        end = at + len(after)
    if end:
        yield text[start:end]


def names_of(text: str) -> dict[str, int]:
    """candidates() of one normalised text, in the order in which they are found."""
    out: dict[str, int] = {}
    found = [w for w in _SINGLE.findall(text) if w.lower() not in _STOP]
    found += [p for p in _PHRASE.findall(text) if _STOP.isdisjoint(p.lower().split())]
    found += dict.fromkeys(n for b, a, p in _PERSON_NAMES if a in text and b in text for n in p.findall(text) if len(set(n)) > 1 and not set(n) & set(NO_NAME))
    found += dict.fromkeys(n for a, p in _PROJECT_NAMES for part in _before(text, a) for n in p.findall(part) if len(n) >= 2)
    for name in found:
        out[name] = out.get(name, 0) + 1
    return out


class Spelled:
    """Names in lower case, of two characters or more, by what they begin and end with."""

    def __init__(self, names: Iterable[str]):
        self.names = set(names)
        starts: dict[str, set[int]] = {}
        ends: dict[str, set[int]] = {}
        for n in self.names:
            starts.setdefault(n[:2], set()).add(len(n))
            ends.setdefault(n[-2:], set()).add(len(n))
        self.starts, self.ends = ({k: sorted(v) for k, v in x.items()} for x in (starts, ends))

    def ending(self, text: str, at: int) -> list[str]:
        """The names that end before a place of a text."""
        if at < 2 or (lengths := self.ends.get(text[at - 2 : at])) is None:
            return []
        return [n for k in lengths if k <= at and (n := text[at - k : at]) in self.names]

    def starting(self, text: str, at: int) -> list[str]:
        """The names that begin at a place of a text."""
        if (lengths := self.starts.get(text[at : at + 2])) is None:
            return []
        return [n for k in lengths if (n := text[at : at + k]) in self.names]

    def counts(self, text: str) -> dict[str, int]:
        """How often each name stands in a text, as str.count() has it; many names take one pass over the text together."""
        if len(self.names) <= FEW:
            return {n: k for n in self.names if (k := text.count(n))}
        return _apart((n, at, at + len(n)) for at in range(len(text) - 1) if text[at : at + 2] in self.starts for n in self.starting(text, at))


def _apart(spans: Iterable[tuple[str, int, int]]) -> dict[str, int]:
    """How many of each name's spans (name, start, end), in the order of their starts, don't overlap when taken from the left."""
    out: dict[str, int] = {}
    last: dict[str, int] = {}
    for name, start, end in spans:
        if start >= last.get(name, 0):
            out[name] = out.get(name, 0) + 1
            last[name] = end
    return out


def _literal(patterns: list[str]) -> list[tuple[str, str]]:
    """(before, after) of patterns that are plain text around one name, in lower case."""
    return [tuple(p.lower().split("{name}")) for p in patterns if p.count("{name}") == 1 and "\\" not in p and "." not in p]


_PERSONS, _PROJECTS = _literal([*PERSON, *CHINESE_PERSON]), _literal([*PROJECT, *CHINESE_PROJECT])
_FILES = [p.split("{name}")[1] for p in [*PROJECT, *CHINESE_PROJECT] if "." in p]


# what stands before or behind a name in the rules that aren't plain text; each place where one begins is met
_WITH, _GREETED, _LISTED = (re.compile(p, re.A) for p in (r"\bwith\s+", r"\b(?:hey|hi|hello|dear|thanks)\s+", r"[-*]\s*"))
_QUOTED = re.compile(r"(?=([\"']\s*,?\s*(?:said|told|asked|replied|whispered)))", re.A)
_FILE = re.compile(r"\.(?:py|js|ts|go|rs|java|cpp|c|h|css|html|json|yaml|yml|toml|sh|md)\b", re.A)
_DEFINED = re.compile(r"(?=(\s+(?:is\s+(?:a|an|the)\s+\w+|means|refers\s+to|describes|represents|defines?)\b))", re.A)
_MARKED, _WORD = re.compile(r"[-v](?=\w)", re.A), re.compile(r"\w+", re.A)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Evidence:
    """What a text says about the types of its names (by default all of names_of): (person, project, concept) of each.

    A rule is a name with something before or behind it. Each rule looks for that something and then for names beside it, so the
    time grows with the text, however many names it has.
    """

    def __init__(self, text: str, names: Iterable[str] | None = None):
        self.text, self.low = text, text.lower()
        # patterns ignore the case of ASCII letters alone, plain text that of all
        self.ascii = self.low if text.isascii() else text.translate(_LOWER)
        self.known = Spelled(n.lower() for n in (names_of(text) if names is None else names))
        self.scores = {n: [0, 0, 0] for n in self.known.names}
        if not self.scores:
            return
        for kind, pairs in enumerate((_PERSONS, _PROJECTS)):
            for (a, b), times in Counter(pairs).items():
                self._add(kind, 2 * times, self._plain(a, b))
        t, edge = self.ascii, self._edge
        self._add(0, 2, self._behind(_WITH))
        self._add(0, 2, self._ahead((at, at + 12) for at in _places(t, " with {name}")))
        self._add(0, 3, (x for x in self._behind(_GREETED) if edge(x[2])))
        self._add(0, 2, ((n, a - 1, b) for n, a, b in self._ahead((m.start(), m.end(1)) for m in _QUOTED.finditer(t)) if a and t[a - 1] in "\"'"))
        for f, times in Counter(_FILES).items():  # the dot of these patterns is any character
            self._add(1, 2 * times, self._ahead((at - 1, at + len(f) - 1) for at in _places(t, f[1:]) if at and t[at - 1] != "\n"))
        self._add(1, 3, (x for x in self._ahead(self._marked()) if edge(x[1])))
        self._add(1, 3, (x for x in self._ahead((m.start(), m.end()) for m in _FILE.finditer(t)) if edge(x[1])))
        self._add(2, 4, (x for x in self._ahead((m.start(), m.end(1)) for m in _DEFINED.finditer(t)) if edge(x[1])))
        self._add(2, 1, (x for x in self._behind(_LISTED) if edge(x[2])), least=2)

    def of(self, name: str) -> tuple[int, int, int]:
        low = name.lower()
        return tuple(self.scores[low] if low in self.scores else Evidence(self.text, [name]).scores[low])

    def _add(self, kind: int, weight: int, spans: Iterable[tuple[str, int, int]], least: int = 1) -> None:
        for name, n in _apart(spans).items():
            if n >= least:
                self.scores[name][kind] += weight * n

    def _edge(self, at: int) -> bool:
        """Whether a word of ASCII begins or ends at a place."""
        word = lambda c: c == "_" or c.isascii() and c.isalnum()
        return (at > 0 and word(self.ascii[at - 1])) != (at < len(self.ascii) and word(self.ascii[at]))

    def _plain(self, a: str, b: str) -> Iterator[tuple[str, int, int]]:
        if not b:
            yield from ((n, at, at + len(a) + len(n)) for at in _places(self.low, a) for n in self.known.starting(self.low, at + len(a)))
            return
        for at in _places(self.low, b):
            for n in self.known.ending(self.low, at):
                start = at - len(n) - len(a)
                if start >= 0 and self.low.startswith(a, start):
                    yield n, start, at + len(b)

    def _behind(self, pattern: re.Pattern) -> Iterator[tuple[str, int, int]]:
        """Names right behind what a pattern matches."""
        return ((n, m.start(), m.end() + len(n)) for m in pattern.finditer(self.ascii) for n in self.known.starting(self.ascii, m.end()))

    def _ahead(self, places: Iterable[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
        """Names right before places (start, end)."""
        return ((n, start - len(n), end) for start, end in places for n in self.known.ending(self.ascii, start))

    def _marked(self) -> Iterator[tuple[int, int]]:
        end = 0
        for m in _MARKED.finditer(self.ascii):
            if m.end() >= end:
                end = _WORD.match(self.ascii, m.end()).end()
            yield m.start(), end


def type_of(frequency: int, person: int, project: int, concept: int) -> tuple[str, float]:
    """(type, confidence): the strongest evidence of two or more, persons before projects before concepts; else uncertain."""
    best = max(person, project, concept)
    if not best:
        return "uncertain", min(0.4, frequency / 30)
    if best < 2:
        return "uncertain", 0.3
    return ("person" if person == best else "project" if project == best else "concept"), 0.85


def typed_names(text: str) -> list[tuple[str, str, float, int]]:
    """(name, type, confidence, frequency) of a normalised text's names, frequent ones first, then in the order found."""
    names = names_of(text)
    evidence = Evidence(text, names)
    return [(n, *type_of(k, *evidence.of(n)), k) for n, k in sorted(names.items(), key=lambda x: -x[1])]


def antecedents(text: str, names: dict[str, int]) -> dict[str, str]:
    """For each pronoun in a normalised text, the name that two sentences before to two after hold most often.

    Its last occurrence with a name around it decides; of equally frequent names the one found first.
    """
    if not names:
        return {}
    sentences = [s.lower() for s in re.split("[.。!！?]", text) if len(s.strip()) > 5]
    ends = [m.start() for m in re.finditer("[.。!！?]", text)]
    known: dict[int, str | None] = {}
    spelled = Spelled(n.lower() for n in names)

    def around(k: int) -> str | None:
        if k not in known:
            window = " ".join(sentences[max(0, k - 2) : min(len(sentences) - 1, k + 2) + 1])
            counts = spelled.counts(window)
            best = max(names, key=lambda n: counts.get(n.lower(), 0))
            known[k] = best if counts else None
        return known[k]

    out = {}
    for pronoun in PRONOUNS:
        at = [m.start() for m in re.finditer(pronoun, text)]
        k = len(ends)
        for pos in reversed(at):
            while k and ends[k - 1] >= pos:
                k -= 1
            if (name := around(k)) is not None:
                out[pronoun] = name
                break
    return out


def _texts(rows: pd.DataFrame, text: str) -> Iterator[tuple[object, str]]:
    for id_, body in zip(rows["id"], rows[text], strict=True):
        body = re.sub(r"\s+", " ", body or "").strip()
        if len(body) >= LEAST_TEXT:
            yield id_, body


def _kind(df: DataFrame) -> str:
    return df.schema["id"].dataType.simpleString()


def score_types(df: DataFrame, text: str = "content") -> DataFrame:
    """id, name, type, confidence, frequency of each candidate name of a text, by what stands around it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([(id_, *x) for id_, body in _texts(rows, text) for x in typed_names(body)], columns=["id", "name", "type", "confidence", "frequency"])

    return df.select("id", text).mapInPandas(run, f"id {_kind(df)}, name string, type string, confidence double, frequency long")


def resolve_pronouns(df: DataFrame, text: str = "content") -> DataFrame:
    """id, pronoun, name: what each pronoun of a text is taken for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([(id_, *x) for id_, body in _texts(rows, text) for x in antecedents(body, names_of(body)).items()], columns=["id", "pronoun", "name"])

    return df.select("id", text).mapInPandas(run, f"id {_kind(df)}, pronoun string, name string")


def extract(df: DataFrame, text: str = "content", most_facts: int = 10, most_concepts: int = 5) -> DataFrame:
    """id, facts, concepts: of each record the first facts (typed names, then relations) and concepts, each value once.

    A name of type person, project or concept gives a fact; a concept, or an uncertain name of three occurrences or more
    and a confidence of 0.25, is a concept, under the name that it stands for where it is a pronoun.
    """
    triples = relations(df, text).select("id", F.concat_ws(" → ", "subject", "predicate", "object").alias("v")).groupBy("id").agg(F.collect_list("v").alias("triples"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for id_, body in _texts(rows, text):
                typed = typed_names(body)
                meant = antecedents(body, {n: k for n, _, _, k in typed})
                facts = [f"{n} is a {t}" for n, t, sure, _ in typed if sure >= 0.6 and t != "uncertain"]
                concepts = [meant.get(n, n) for n, t, sure, k in typed if t == "concept" or t == "uncertain" and sure >= 0.25 and k >= 3]
                out.append((id_, facts, list(dict.fromkeys(concepts))[:most_concepts]))
            yield pd.DataFrame(out, columns=["id", "named", "concepts"])

    named = df.select("id", text).mapInPandas(run, f"id {_kind(df)}, named array<string>, concepts array<string>")
    empty = F.array().cast("array<string>")
    both = df.select("id").join(named, "id", "left").join(triples, "id", "left")
    facts = F.slice(F.array_distinct(F.concat(F.coalesce("named", empty), F.coalesce("triples", empty))), 1, most_facts)
    return both.select("id", F.when(F.col("named").isNull() & F.col("triples").isNull(), empty).otherwise(facts).alias("facts"), F.coalesce("concepts", empty).alias("concepts"))


def backfill(df: DataFrame, text: str = "content", done: str = "extracted") -> DataFrame:
    """Records with facts and concepts filled where they weren't extracted yet; `done` marks those that gave any.

    df: id, text, facts, concepts and done. Rows that are marked stay as they are and aren't read again.
    """
    marked = F.coalesce(F.col(done), F.lit(False))
    fresh = df.where(~marked)
    made = extract(fresh, text).withColumnsRenamed({"facts": "_f", "concepts": "_c"})
    some = F.coalesce((F.size("_f") > 0) | (F.size("_c") > 0), F.lit(False))
    filled = fresh.join(made, "id", "left")
    return df.where(marked).unionByName(filled.select(*(
        F.when(some, F.col({"facts": "_f", "concepts": "_c"}[c])).otherwise(F.col(c)).alias(c) if c in ("facts", "concepts") else some.alias(c) if c == done else F.col(c) for c in df.columns
    )))
