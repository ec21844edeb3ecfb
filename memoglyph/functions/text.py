"""Text functions over columns; all but fnv1a32_each stay in the JVM."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

_CJK = r"\x{4e00}-\x{9fff}"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use) -> Column:
    """use(value), with value computed once even where lambdas use it again and again."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalize_spaces(x: Column | str) -> Column:
    """White space runs as one space, trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"\s+", " "))


def strip_bom(x: Column | str) -> Column:
    """normalize_spaces without byte order marks."""
    return normalize_spaces(F.regexp_replace(F.coalesce(_c(x), F.lit("")), "﻿", ""))


# fixed values: what marks a text as noise
NOISE = [r"Sender\s*\(", "System:", "Subagent Context", r"\[Subagent Context\]", "Exec completed", "Exec failed", "A new session was started", r"\[(Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s", "Run your Session Startup"]


#: Characters of a normalised text that tell noise; the longest mark has 25.
NOISE_HEAD = 64


def head(x: Column | str, most: int) -> Column:
    """The first `most` characters of normalize_spaces(x), exactly; a text is read to its end only if white space fills its beginning."""
    enough = most + most // 4 + 64
    cut = lambda text: F.substring(normalize_spaces(text), 1, most)
    of = lambda text: let(cut(F.substring(text, 1, enough)), lambda h: F.when((F.length(h) >= most) | (F.length(text) <= enough), h).otherwise(cut(text)))
    return let(F.coalesce(_c(x), F.lit("")), of)


def is_noise(x: Column | str) -> Column:
    """Shorter than 5 characters, or a text that begins as machine output does."""
    return let(head(x, NOISE_HEAD), lambda text: (F.length(text) < 5) | text.rlike("(?i)^(" + "|".join(NOISE) + ")"))


def search_tokens(x: Column | str) -> Column:
    """Distinct tokens in order: ASCII words of two characters or more (with _ - . / :), then CJK runs of two or more."""
    words = lambda low: F.regexp_extract_all(low, F.lit(r"([a-z0-9][a-z0-9_\-./:]+)"), 1)
    runs = lambda low: F.regexp_extract_all(low, F.lit(f"([{_CJK}]{{2,}})"), 1)
    # a text of bytes for characters has no CJK runs
    of = lambda low: let(words(low), lambda w: F.array_distinct(F.when(F.octet_length(low) == F.length(low), w).otherwise(F.concat(w, runs(low)))))
    return let(F.lower(F.coalesce(_c(x), F.lit(""))), of)


def ranking_tokens(x: Column | str) -> Column:
    """Tokens with repeats: ASCII words of two characters or more, then CJK characters each followed by its pair."""
    text = F.coalesce(_c(x), F.lit(""))
    latin = F.regexp_replace(F.lower(text), r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}]", " ")
    words = F.filter(F.split(latin, r"[\s\W]+"), lambda w: F.length(w) >= 2)
    cjk = F.regexp_extract_all(text, F.lit(r"([\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}])"), 1)
    pairs = F.flatten(F.transform(cjk, lambda c, i: F.when(i + 1 < F.size(cjk), F.array(c, F.concat(c, F.element_at(cjk, i + 2)))).otherwise(F.array(c))))
    return F.when(F.size(cjk) > 0, F.concat(words, pairs)).otherwise(words)


_FINGERPRINT_SPLIT = r"""[\s\-_.,;:!?()\[\]{}'"#@$%^&*+=|\\~`]+"""


#: Characters for each wanted token that are read first.
TOKEN_ROOM = 40


def fingerprint_tokens(x: Column | str, most: int = 18) -> Column:
    """The first `most` tokens of three characters or more between spaces and punctuation, repeats kept.

    Only the beginning of a text is read where it holds them all: its last piece may go on and is left out, and a sigma is lowered
    by what follows, so a beginning with one doesn't tell.
    """
    enough = TOKEN_ROOM * most
    long = lambda pieces: F.filter(pieces, lambda w: F.length(w) >= 3)
    pieces = lambda text: F.split(F.lower(text), _FINGERPRINT_SPLIT)
    first = lambda tokens: F.slice(tokens, 1, most)

    def of(text):
        cut = F.substring(text, 1, enough)
        begun = let(pieces(cut), lambda p: long(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0)))))
        tells = lambda tokens: (F.length(text) > enough) & (F.size(tokens) >= most) & ~F.contains(cut, F.lit("Σ"))
        return let(begun, lambda tokens: F.when(tells(tokens), first(tokens)).otherwise(first(long(pieces(text)))))

    return let(F.coalesce(_c(x), F.lit("")), of)


def coercion_tokens(x: Column | str) -> Column:
    """Runs of two or more of a-z 0-9 _ . / : - and CJK characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit(f"([a-z0-9_./:{_CJK}-]{{2,}})"), 1)


def similarity_key(project, scope, text, most: int = 18) -> Column:
    """SHA-1 of project, scope and the first tokens of letters and digits."""
    clean = normalize_spaces(F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), r"[^\p{L}\p{Nd}]+", " "))
    tokens = F.slice(F.filter(F.split(clean, " "), lambda w: F.length(w) >= 3), 1, most)
    return F.sha1(F.concat_ws("|", F.lower(normalize_spaces(project)), F.lower(normalize_spaces(scope)), F.array_join(tokens, " ")))


def promotion_key(durable, project, text, fallback) -> Column:
    """SHA-1 of target scope, project, two empty salts and the first 18 tokens of three characters (or the fallback)."""
    tokens = F.slice(F.filter(coercion_tokens(normalize_spaces(text)), lambda w: F.length(w) >= 3), 1, 18)
    fingerprint = F.when(F.size(tokens) > 0, F.array_join(tokens, " ")).otherwise(F.lower(normalize_spaces(fallback)))
    key = F.sha1(F.concat(F.lower(normalize_spaces(durable)), F.lit("|"), F.lower(normalize_spaces(project)), F.lit("|||"), fingerprint))
    return F.when(fingerprint == "", "").otherwise(key)


def clamp_text(x: Column | str, most: int, mark: str = "...") -> Column:
    """At most `most` characters, a longer text ending in the mark."""
    return F.when(F.length(_c(x)) > most, F.concat(F.rtrim(F.substring(_c(x), 1, most - len(mark))), F.lit(mark))).otherwise(_c(x))


def safe_filename(x: Column | str, most: int = 80) -> Column:
    """Characters that file systems refuse become _, spaces -, at most `most`; empty is untitled."""
    name = F.substring(F.regexp_replace(F.regexp_replace(normalize_spaces(x), r'[<>:"/\\|?*\x00-\x1f]', "_"), r"\s+", "-"), 1, most)
    return F.when(name == "", "untitled").otherwise(name)


def entity_id(x: Column | str) -> Column:
    """Graph id of a name: ASCII lower case, other characters than kept scripts as _, one edge _ stripped, 64 characters."""
    low = F.translate(F.coalesce(_c(x), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    kept = r"[^a-z0-9\x{c0}-\x{24f}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{400}-\x{4ff}\x{600}-\x{6ff}\x{590}-\x{5ff}\x{ac00}-\x{d7af}]+"
    name = F.substring(F.regexp_replace(F.regexp_replace(low, kept, "_"), "^_|_$", ""), 1, 64)
    return F.when(name == "", "_unknown_").otherwise(name)


def predicate(x: Column | str, cut: bool = True) -> Column:
    """A relation's name: lower case, white space as _, 64 characters where a triple is written."""
    name = F.regexp_replace(F.lower(_c(x)), r"\s+", "_")
    return F.substring(name, 1, 64) if cut else name


def strip_markdown(x: Column | str) -> Column:
    return normalize_spaces(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"[#*`_~\[\]]", ""))


# fixed values: endings of files that a text may refer to
FILE_ENDINGS = ["py", "js", "ts", "tsx", "jsx", "md", "json", "yaml", "yml", "sh", "ps1", "go", "rs", "java", "cpp", "c", "h", "toml"]


def file_refs(x: Column | str, most: int = 5) -> Column:
    """The first `most` file names in a text."""
    return F.slice(F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(r"([\w./\\-]+\.(?:" + "|".join(FILE_ENDINGS) + r"))\b"), 1), 1, most)


# fixed values: what is redacted in stored text, in this order
REDACTIONS = [
    ("URL_AUTH", r"https?://[\w-]+:[\w-]+@"),
    ("URL_QUERY_KEY", r"(?i)[?&](?:api[_-]?key|key|access_token|sig)=[A-Za-z0-9_\-.%]{8,}"),
    ("BEARER_TOKEN", r"(?i)Bearer\s+[A-Za-z0-9_\-.]{16,}"),
    ("CREDIT_CARD", r"\b\d{4}[-.\s]?\d{4}[-.\s]?\d{4}[-.\s]?\d{4}\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("API_KEY", r"(?i)(?:api[\s_-]?key|token|secret|password)\s*[:=]\s*[\"']?[\w-]{8,}[\"']?"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("PHONE", r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b"),
]
# fixed values: what is redacted in text that leaves the system
OUTBOUND = [
    (r"\bsk-[A-Za-z0-9_-]{16,}\b", "[REDACTED]"),
    (r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", "[REDACTED]"),
    (r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b", "[REDACTED]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{10,}", "Bearer [REDACTED]"),
    (r"""(?i)\b(api[_-]?key|access[_-]?token|auth[_-]?token|secret|password|passwd)\s*[:=]\s*(["']?)[^\s"',;]{6,}\2""", "$1=[REDACTED]"),
    (r"(?i)([?&](?:api[_-]?key|access[_-]?token|token|secret|password)=)[^&#\s]+", "$1[REDACTED]"),
    (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[REDACTED_EMAIL]"),
    (r"(?i)\b(https?:)//[^\s/@:]+:[^\s/@]+@", "$1//[REDACTED]@"),
]
MOST_CUSTOM = 200


def custom_pattern_is_safe(pattern: str) -> bool:
    """Whether a configured pattern is short, valid and without a quantified group that ends in a quantifier."""
    if not pattern or len(pattern) > MOST_CUSTOM or re.search(r"\([^()]*[*+?][^()]*\)[+*]", pattern):
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


# fixed values: what a text must have for patterns to match at all, found faster than they are
_DIGITS = lambda t: t.rlike(r"\d{3}")
_NEEDS = [
    (("URL_AUTH",), lambda t: F.contains(t, F.lit("://")) & F.contains(t, F.lit("@"))),
    (("URL_QUERY_KEY",), lambda t: F.contains(t, F.lit("="))),
    (("BEARER_TOKEN",), lambda t: F.lit(True)),
    (("CREDIT_CARD", "SSN"), _DIGITS),
    (("API_KEY",), lambda t: F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))),
    (("EMAIL",), lambda t: F.contains(t, F.lit("@"))),
    (("PHONE",), _DIGITS),
]


def redact(x: Column | str, mode: str = "tools", custom: list[tuple[str, str]] = ()) -> Column:
    """Secrets and personal data replaced, by a typed placeholder or, in strict mode, by [REDACTED].

    Patterns are tried in their order, those that a text can't match are passed over; each step's text is made once.
    """
    mark = lambda name: "[REDACTED]" if mode == "strict" else f"[REDACTED_{name}]"
    patterns = dict(REDACTIONS)

    def step(names, needs):
        def of(text):
            made = text
            for name in names:
                made = F.regexp_replace(made, patterns[name], mark(name))
            return F.when(needs(text), made).otherwise(text)

        return of

    out = _c(x)
    for names, needs in _NEEDS:
        out = let(out, step(names, needs))
    for name, pattern in custom:
        if custom_pattern_is_safe(pattern):
            out = F.regexp_replace(out, pattern, mark(name))
    return out


def redact_spaced(x: Column | str) -> Column:
    """x with single spaces, redacted, and with single spaces again where that changed it."""
    return let(normalize_spaces(x), lambda t: let(redact(t), lambda r: F.when(r == t, t).otherwise(normalize_spaces(r))))


def redact_outbound(x: Column | str) -> Column:
    out = _c(x)
    for pattern, mark in OUTBOUND:
        out = F.regexp_replace(out, pattern, mark)
    return out


def redact_record(df, columns=("title", "content", "description"), arrays=("facts", "concepts"), mode: str = "tools"):
    """A record's text columns and text arrays redacted; columns that df lacks are passed over."""
    for c in columns:
        if c in df.columns:
            df = df.withColumn(c, redact(c, mode))
    for c in arrays:
        if c in df.columns:
            df = df.withColumn(c, F.transform(c, lambda v: redact(v, mode)))
    return df


def token_estimate(x: Column | str) -> Column:
    """Tokens by character: two for a CJK character, a quarter for others, rounded up."""
    cjk = F.regexp_count(_c(x), F.lit(f"[{_CJK}]"))
    return F.ceil(cjk * 2 + (F.length(_c(x)) - cjk) * 0.25).cast("long")


def _code_point(ch: Column) -> Column:
    """The code point of one character, from its UTF-8 bytes."""
    n = F.conv(F.hex(F.encode(ch, "UTF-8")), 16, 10).cast("long")
    part = lambda shift, bits: F.shiftright(n, shift).bitwiseAND(F.lit((1 << bits) - 1))
    two = part(8, 5) * 64 + part(0, 6)
    three = part(16, 4) * 4096 + part(8, 6) * 64 + part(0, 6)
    four = part(24, 3) * 262144 + part(16, 6) * 4096 + part(8, 6) * 64 + part(0, 6)
    return F.when(n < 0x80, n).when(n < 0x10000, two).when(n < 0x1000000, three).otherwise(four)


def fnv1a32(x: Column | str) -> Column:
    """FNV-1a of 32 bits over code points."""
    points = F.filter(F.split(_c(x), ""), lambda ch: ch != "")
    return F.aggregate(points, F.lit(0x811C9DC5).cast("long"), lambda h, ch: h.bitwiseXOR(_code_point(ch)) * 0x01000193 % (1 << 32))


def fnv1a32_each(lists: pa.ListArray) -> pa.ListArray:
    """fnv1a32 of each text in Arrow lists, null texts and lists left out: distinct texts are hashed once, all at a time."""
    held = pc.is_valid(lists.flatten())
    texts, row = lists.flatten().filter(held).dictionary_encode(), pc.list_parent_indices(lists).filter(held).to_numpy()
    words = sorted(((w, i) for i, w in enumerate(texts.dictionary.to_pylist())), key=lambda w: -len(w[0]))
    sizes = np.array([len(w) for w, _ in words], np.int64)
    points = np.frombuffer("".join(w for w, _ in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    h = np.full(len(words), 0x811C9DC5, np.uint64)
    for at in range(int(sizes[0]) if len(words) else 0):
        n = int(np.searchsorted(-sizes, -at, "left"))  # texts of more than `at` characters come first
        h[:n] = (h[:n] ^ points[starts[:n] + at]) * np.uint64(0x01000193) & np.uint64(0xFFFFFFFF)
    of = np.zeros(len(words), np.int64)
    of[[i for _, i in words]] = h.astype(np.int64)
    offsets = np.append(0, np.cumsum(np.bincount(row, minlength=len(lists)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(of).take(texts.indices))


def _grams(prefix: str, chunk: Column, n: int, most: int = 1 << 20) -> Column:
    """The first `most` runs of n characters of a text, each after the prefix."""
    count = F.least(F.length(chunk) - (n - 1), F.lit(most))
    made = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.concat(F.lit(prefix), F.substring(chunk, i, F.lit(n))))
    return F.when(count > 0, made).otherwise(F.array().cast("array<string>"))


def _feature_words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"([a-z0-9][a-z0-9_\-./:]+)"), 1), lambda w: F.concat(F.lit("w:"), w))


def hash_features(x: Column | str) -> Column:
    """Features of the hashed embedding: words, CJK runs with their pairs and triples, then at most 400 character triples."""

    def of(text, compact):
        runs = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"([{_CJK}]{{2,}})"), 1), lambda c: F.concat(F.array(F.concat(F.lit("c:"), c)), _grams("c2:", c, 2), _grams("c3:", c, 3))))
        found = F.concat(_feature_words(text), runs, _grams("g3:", compact, 3, 400))
        return let(found, lambda f: F.when((F.size(f) == 0) & (compact != ""), F.array(F.concat(F.lit("raw:"), compact))).otherwise(f))

    return let(F.lower(normalize_spaces(x)), lambda text: let(F.substring(F.regexp_replace(text, r"\s+", ""), 1, 402), lambda compact: of(text, compact)))


#: Characters that SQL's trim takes off the ends of a text.
_SEPARATORS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def plain_features(x: Column | str) -> Column:
    """The words and character triples alone of hash_features(), as DuckDB's functions make them of a text.

    A vertical tab is no white space there, space separators are taken off the ends, and letters are lowered one by one.
    """
    spaced = F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"[\t\n\f\r ]+", " "), F.lit(_SEPARATORS))
    compact = lambda text: F.substring(F.replace(text, F.lit(" "), F.lit("")), 1, 402)
    return let(F.lower(F.translate(spaced, "Σİ", "σi")), lambda text: let(compact(text), lambda k: F.concat(_feature_words(text), _grams("g3:", k, 3, 400))))


def record_id(tool, t, title, content) -> Column:
    """The id of a record that has none: 16 hex digits of a SHA-1."""
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(_c(x), F.lit("")) for x in (tool, t, title, content)))), 1, 16)


def project_of(explicit, cwd) -> Column:
    """The given project, else the last part of the working folder, else default."""
    base = F.regexp_extract(F.coalesce(_c(cwd), F.lit("")), r"([^/\\]+)[/\\]*$", 1)
    return F.coalesce(F.nullif(normalize_spaces(explicit), F.lit("")), F.nullif(base, F.lit("")), F.lit("default"))


def strip_signal(x: Column | str) -> Column:
    """A signal line without list marks, time stamps and emphasis."""
    text = F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"^\s*(?:[-*]\s+|\d+\.\s+)", "")
    return normalize_spaces(F.regexp_replace(F.regexp_replace(text, r"^\[[^\]]*\]\s*", ""), r"[*`_]", ""))
