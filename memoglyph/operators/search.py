"""Retrieval: BM25, dense scoring, fusion, re-ranking, diversity, snippets, evaluation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from memoglyph.functions.classify import intent_of, query_type, route_weight
from memoglyph.functions.numeric import cosine, decay
from memoglyph.functions.text import file_refs, is_noise, let, normalize_spaces, redact, redact_spaced, search_tokens
from memoglyph.operators.lifecycle import checkpointed, positions

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60


@dataclass(frozen=True)
class SearchRequest:
    """A query with its defaults and limits."""

    query: str
    mode: str = "hybrid"
    route: str = "auto"
    limit: int = 10
    filters: dict = field(default_factory=dict)
    half_life_days: float | None = None
    fusion: str = "weighted"
    diversity: float | None = None
    prefer_summaries: bool = False

    @staticmethod
    def of(query: str, **given) -> SearchRequest:
        """A request from loose arguments: unknown modes, routes and fusions fall back, numbers are clamped."""
        clean = lambda k, values, default: (v if (v := str(given.get(k) or "").strip().lower()) in values else default)
        diversity = given.get("diversity")
        return SearchRequest(
            query=re.sub(r"\s+", " ", query or "").strip(),
            mode=clean("mode", ("bm25", "dense", "hybrid"), "hybrid"),
            route=clean("route", ("mixed", "durable", "task", "recent", "reference"), "auto"),
            limit=max(1, min(int(given.get("limit") or 10), 100)),
            filters={k: v for k in ("tool", "project", "scope", "source_kind", "workspace", "task_state") if (v := str(given.get(k) or "").strip().lower())},
            half_life_days=float(given["half_life_days"]) if given.get("half_life_days") else None,
            fusion=clean("fusion", ("rrf", "weighted"), "weighted"),
            diversity=None if diversity is None else max(0.0, min(1.0, float(diversity))),
            prefer_summaries=bool(given.get("prefer_summaries")),
        )


def filtered(entries: DataFrame, filters: dict) -> DataFrame:
    """Entries that match all filters: project and workspace as a part of the value, others as the whole; case ignored."""
    for name, value in filters.items():
        if value and name in entries.columns:
            low = F.lower(F.coalesce(F.col(name), F.lit("")))
            entries = entries.where(low.contains(value.lower()) if name in ("project", "workspace") else low == value.lower())
    return entries


def _query_counts(query_tokens: list[str], repeats: bool) -> dict[str, int]:
    found: dict[str, int] = {}
    for t in query_tokens:
        found[t] = found.get(t, 0) + 1 if repeats else 1
    return found


def _times(tokens, word: str):
    """How often a word stands in a token array."""
    return F.size(tokens) - F.size(F.array_remove(tokens, word))


def _frequencies(entries: DataFrame, wanted: list[str]) -> tuple[DataFrame, DataFrame]:
    """entries (id, tokens) with n_tokens and the count of each wanted token; and corpus figures in one row.

    One pass: the counts are expressions over the token array, so no token leaves its row and nothing is exploded.
    """
    # one struct of all counts, so that an entry's tokens are made once for all terms
    def counts(t):
        return F.struct(F.size(t).alias("n_tokens"), *(_times(t, word).alias(f"tf{i}") for i, word in enumerate(wanted)))

    # a few numbers for each entry are kept, so that its tokens are made once
    counted = checkpointed(entries.select("id", let(F.col("tokens"), counts).alias("c")).select("id", "c.*"))
    figures = counted.agg(F.count("*").alias("n"), F.avg("n_tokens").alias("mean"), *(F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(wanted))))
    return counted, figures


def bm25(entries: DataFrame, query_tokens: list[str]) -> DataFrame:
    """id, score of entries (id, tokens) with a positive score: idf ln((n - df + .5) / (df + .5) + 1), repeated query terms add up.

    Corpus figures come from one aggregate over all entries, joined back as one broadcast row.
    """
    wanted = _query_counts(query_tokens, True)
    if not wanted:
        return entries.select("id", F.lit(0.0).alias("score")).where("false")
    counted, figures = _frequencies(entries, list(wanted))
    both = counted.crossJoin(F.broadcast(figures))
    score = F.lit(0.0)
    for i, times in enumerate(wanted.values()):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        part = idf * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean"))))
        score = score + F.when(tf > 0, times * part).otherwise(0.0)
    return both.select("id", score.alias("score")).where("score > 0")


def bm25_okapi(entries: DataFrame, query_tokens: list[str]) -> DataFrame:
    """id, score by the Okapi form: idf ln(n - df + .5) - ln(df + .5), a negative one replaced by a quarter of the mean idf.

    The mean is over all terms of the corpus, so document frequencies of all terms are counted (partially in each task).
    Entries without tokens count as one of length 1.
    """
    filled = entries.select("id", F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("_empty_"))).alias("tokens"))
    wanted = _query_counts(query_tokens, True)
    if not wanted:
        return entries.select("id", F.lit(0.0).alias("score")).where("false")
    counted, figures = _frequencies(filled, list(wanted))
    df_all = filled.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf_of = lambda n, df: F.log(n - df + 0.5) - F.log(df + 0.5)
    mean_idf = df_all.crossJoin(F.broadcast(figures.select("n"))).agg(F.avg(idf_of(F.col("n"), F.col("df"))).alias("mean_idf"))
    both = counted.crossJoin(F.broadcast(figures.crossJoin(mean_idf)))
    score = F.lit(0.0)
    for i, times in enumerate(wanted.values()):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        raw = idf_of(F.col("n"), df)
        idf = F.when(df == 0, 0.0).when(raw < 0, EPSILON * F.col("mean_idf")).otherwise(raw)
        score = score + times * idf * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean"))))
    return both.select("id", score.alias("score")).where("score > 0")


def keyword_overlap(entries: DataFrame, query_tokens: list[str]) -> DataFrame:
    """id, score: how many of an entry's tokens are in the query."""
    wanted = F.array(*(F.lit(t) for t in dict.fromkeys(query_tokens))) if query_tokens else F.array().cast("array<string>")
    return entries.select("id", F.size(F.filter("tokens", lambda t: F.array_contains(wanted, t))).cast("double").alias("score")).where("score > 0")


def dense(rows: DataFrame, query: list[float], id_: str = "record_id") -> DataFrame:
    """id, entry_id, score: the best positive cosine of a record's embedding rows (record_id, entry_id, embedding)."""
    q = F.array(*(F.lit(float(v)) for v in query))
    scored = rows.select(F.col(id_).alias("id"), "entry_id", cosine(F.col("embedding"), q).alias("score")).where("score > 0")
    best = scored.groupBy("id").agg(F.max(F.struct("score", F.negate(F.hash("entry_id")).alias("_tie"), "entry_id")).alias("b"))
    return best.select("id", "b.entry_id", "b.score")


def normalized(scores: DataFrame) -> DataFrame:
    """Positive scores over the largest one."""
    top = scores.agg(F.max("score").alias("_top"))
    return scores.crossJoin(F.broadcast(top)).where("score > 0").select("id", (F.col("score") / F.col("_top")).alias("score"))


def rank_map(scores: DataFrame) -> DataFrame:
    """id, rank of all positive scores, ties by id."""
    return positions(scores.where("score > 0").select("id", "score"), F.desc("score"), F.asc("id"), out="rank").select("id", "rank")


def fuse_weighted(sparse: DataFrame, dense_: DataFrame, sparse_weight: float, dense_weight: float) -> DataFrame:
    """id, bm25, dense, score: the weighted sum of normalised scores, a missing one counting 0."""
    both = normalized(sparse).withColumnRenamed("score", "bm25").join(normalized(dense_).withColumnRenamed("score", "dense"), "id", "full_outer")
    both = both.select("id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.coalesce("dense", F.lit(0.0)).alias("dense"))
    return both.withColumn("score", sparse_weight * F.col("bm25") + dense_weight * F.col("dense"))


def fuse_rrf(sparse: DataFrame, dense_: DataFrame, k: int = RRF_K) -> DataFrame:
    """id, score: reciprocal ranks of all positive scores over both rankings, a missing one counting 0."""
    k = k if k > 0 else RRF_K
    both = rank_map(sparse).withColumnRenamed("rank", "a").join(rank_map(dense_).withColumnRenamed("rank", "b"), "id", "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return both.select("id", (part("a") + part("b")).alias("score"))


def field_bonus(query: str, title, description, field_) -> object:
    """Factor for query terms in title (1.3) and description (1.2), and for facts (1.1) and concepts (1.15)."""
    terms = sorted(set(query.lower().split()))
    bonus = F.lit(1.0)
    if len(terms) >= 2:
        array = F.array(*(F.lit(t) for t in terms))
        for text, factor in ((title, 1.3), (description, 1.2)):
            overlap = F.size(F.array_intersect(F.split(F.lower(normalize_spaces(text)), r"\s+"), array))
            bonus = bonus * F.when(overlap >= 2, factor).otherwise(1.0)
    return bonus * F.when(F.lit(field_) == "fact" if isinstance(field_, str) else field_ == "fact", 1.1).when(F.lit(field_) == "concept" if isinstance(field_, str) else field_ == "concept", 1.15).otherwise(1.0)


def indexed(entries: DataFrame) -> DataFrame:
    """Entries with their tokens in place of what only they are made of: what searches read. Write it once, search it often."""
    unread = [c for c in ("content", "excerpt", "text", "facts", "concepts") if c in entries.columns]
    return entries.withColumn("tokens", search_tokens("text")).drop(*unread)


def search(entries: DataFrame, request: SearchRequest, embeddings: DataFrame | None = None, query_vector: list[float] | None = None, index=None, neighbours=None) -> DataFrame:
    """The best entries of a request, one for each record: id, record_id, field, score, bm25, dense, rank.

    entries: id, title, description, layer, scope, source_kind, freshness, task_state, age_days and, as entries_of() makes
    them, record_id, field and text (by default the id, content, and title with content). Corpus figures are those of the
    filtered entries. BM25 and dense scores are blended by the query's type or by reciprocal ranks, weighted by route,
    decayed, raised by matching fields; then the best entry of each record counts. With a diversity the first hundred
    records are chosen again by marginal relevance. Without embeddings, or where they give nothing, a dense or hybrid
    request is answered by BM25. Entries that indexed() gave tokens aren't tokenised again.

    index: an InvertedIndex (filled) of these entries; a request without filters reads its postings, with filters corpus figures
    are those of the filtered entries, so these are counted. neighbours: a function from (vector, k) to the nearest
    (record_id, entry_id, embedding), as a Neighbours index has; then only these are scored.
    """
    for name, made in (("record_id", F.col("id")), ("field", F.lit("content"))):
        if name not in entries.columns:
            entries = entries.withColumn(name, made)
    if not {"text", "tokens"} & set(entries.columns):
        entries = entries.withColumn("text", F.concat_ws(" ", "title", "content"))
    if "tokens" not in entries.columns:
        entries = checkpointed(indexed(entries))
    kept = filtered(entries, request.filters)
    tokens = [t for t in re.findall(r"[a-z0-9][a-z0-9_\-./:]+|[一-鿿]{2,}", request.query.lower())]
    terms = list(dict.fromkeys(tokens))
    sparse = checkpointed(index.scores(terms, okapi=True) if index is not None and not request.filters else bm25_okapi(kept.select("id", "tokens"), terms))
    mode, found = request.mode, None
    if mode != "bm25" and neighbours is not None and query_vector is not None:
        embeddings = neighbours(query_vector, request.limit)
    if mode != "bm25" and embeddings is not None and query_vector is not None:
        mine = kept.where(F.col("field") == "content").select(F.col("record_id").alias("_of"), F.col("id").alias("_id"))
        known = embeddings.join(mine, F.col("record_id") == F.col("_of")).select(F.col("_id").alias("record_id"), "entry_id", "embedding")
        found = checkpointed(dense(known, query_vector).select("id", "score"))
    if found is None or found.isEmpty():
        mode = "bm25"
    if mode == "bm25":
        scored = normalized(sparse).select("id", F.col("score").alias("bm25"), F.lit(0.0).alias("dense"), "score")
    elif mode == "dense":
        scored = normalized(found).select("id", F.lit(0.0).alias("bm25"), F.col("score").alias("dense"), "score")
    else:
        kind = query_type(F.lit(request.query))
        scored = fuse_weighted(sparse, found, kind["bm25_weight"], kind["dense_weight"])
        if request.fusion == "rrf":
            scored = scored.drop("score").join(fuse_rrf(sparse, found), "id")
    intent = intent_of(request.query, route=request.route, **request.filters)
    joined = scored.where("score > 0").join(kept, "id")
    both = F.when((F.col("bm25") > 0) & (F.col("dense") > 0), 1.04).otherwise(1.0) if mode == "hybrid" else F.lit(1.0)
    score = F.col("score") * route_weight(intent, F.col("layer"), F.col("scope"), F.col("source_kind"), F.col("freshness"), F.col("task_state"), request.prefer_summaries) * both
    if request.half_life_days:
        score = score * decay(F.col("age_days"), request.half_life_days)
    score = score * field_bonus(request.query, F.col("title"), F.col("description"), F.col("field"))
    ranked = joined.select("id", "record_id", "field", score.alias("score"), "bm25", "dense")
    one = ranked.groupBy("record_id").agg(F.min(F.struct(F.negate("score").alias("_s"), "id", "field", "score", "bm25", "dense")).alias("b")).select("record_id", "b.id", "b.field", "b.score", "b.bm25", "b.dense")
    order = (F.desc("score"), F.col("id"))
    if request.diversity is not None and embeddings is not None:
        near = one.orderBy(*order).limit(max(100, request.limit)).join(embeddings.groupBy("record_id").agg(F.min_by("embedding", "entry_id").alias("embedding")), "record_id", "left")
        chosen = mmr(near.withColumn("query", F.lit("q")), request.diversity, request.limit).select("id", "rank")
        return one.join(F.broadcast(chosen), "id").select("id", "record_id", "field", "score", "bm25", "dense", "rank")
    top = one.orderBy(*order).limit(request.limit)
    return top.select("id", "record_id", "field", "score", "bm25", "dense").withColumn("rank", F.row_number().over(W.orderBy(*order)))


def mmr(candidates: DataFrame, weight: float = 0.7, limit: int = 10) -> DataFrame:
    """query, id, mmr, rank: candidates (query, id, score, embedding) of each query chosen for relevance and difference.

    Greedy: the next is the one with the largest weight * relevance - (1 - weight) * closest cosine to those chosen.
    Candidates are those of a top-k, so a group is small; a missing vector is like no other. Ties go to the smaller id.
    """
    weight = max(0.0, min(1.0, weight))

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        top = group["score"].max()
        relevance = group["score"].to_numpy() / top if top > 0 else np.zeros(len(group))
        size = max((len(v) for v in group["embedding"] if v is not None), default=1)
        x = np.array([np.zeros(size) if v is None or len(v) != size else np.asarray(v, float) for v in group["embedding"]])
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        near, left, out = np.zeros(len(group)), list(range(len(group))), []
        while left and len(out) < limit:
            value = weight * relevance[left] - (1 - weight) * near[left]
            i = left.pop(int(np.argmax(value)))
            out.append((group["query"][0], group["id"][i], float(weight * relevance[i] - (1 - weight) * near[i]), len(out) + 1))
            near = np.maximum(near, x @ x[i])
        return pd.DataFrame(out, columns=["query", "id", "mmr", "rank"])

    kind = candidates.schema["id"].dataType.simpleString()
    return candidates.select("query", "id", "score", "embedding").groupBy("query").applyInPandas(pick, f"query string, id {kind}, mmr double, rank int")


def snippet_terms(query: str, most: int = 16) -> list[str]:
    """The query and its tokens of two characters or more, longest first, then by letter."""
    found = {query.strip().lower(), *re.findall(r"[a-z0-9][a-z0-9_\-./:]+|[一-鿿]{2,}", query.lower())}
    return sorted((t for t in found if len(t) >= 2), key=lambda t: (-len(t), t))[:most]


def window_of(text: str, start: int, end: int, window: int) -> tuple[str, int, int]:
    """(snippet, start, end): about `window` characters around text[start:end], 24 on each side at least.

    What one end of the text lacks is given to the other; an ellipsis marks where text was cut.
    """
    wanted = max(window, end - start)
    around = max(24, (wanted - (end - start)) // 2)
    a, b = max(0, start - around), min(len(text), end + around)
    lacking = wanted - (b - a)
    if lacking > 0:
        left = min(a, -(-lacking // 2))
        right = min(len(text) - b, lacking - left)
        a, b = a - left, b + right
        a = max(0, a - max(0, wanted - (b - a)))
        b = min(len(text), b + max(0, wanted - (b - a)))
    cut = text[a:b].strip()
    return ("…" if a and cut else "") + cut + ("…" if b < len(text) and cut else ""), a, b


def snippets_of(fields: list[tuple[str, str]], terms: list[str], window: int, most: int) -> list[dict]:
    """Up to `most` windows around matches of the terms, letter case ignored, in the order of the fields, none overlapping."""
    out: list[dict] = []
    seen = set()
    for name, text in fields:
        text = re.sub(r"\s+", " ", text or "").strip()
        if not text or (name, text) in seen:
            continue
        seen.add((name, text))
        found = (m for term in terms for m in re.finditer(re.escape(term), text, re.I))
        # the longest terms first; of the first matches those that begin first
        spans = sorted(((m.start(), m.end()) for m in islice(found, 6 * most)), key=lambda x: (x[0], x[0] - x[1]))
        for start, end in spans:
            if any(o["field"] == name and not (end <= o["start"] or start >= o["end"]) for o in out):
                continue
            cut, a, b = window_of(text, start, end, window)
            out.append({"field": name, "match": text[start:end], "start": a, "end": b, "text": cut})
            if len(out) >= most:
                return out
    return out


def snippets(df: DataFrame, query: str, fields: list[str], window: int = 220, most: int = 1) -> DataFrame:
    """id, snippets: up to `most` windows (1 to 5; of 80 to 600 characters) of the fields around what the query names.

    The texts are redacted first, as a search shows them.
    """
    terms, window, most = snippet_terms(query), max(80, min(600, window)), max(1, min(5, most))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [snippets_of([(f, getattr(row, f)) for f in fields], terms, window, most) for row in rows.itertuples(index=False)]
            yield pd.DataFrame({"id": rows["id"], "snippets": found})

    kind = df.schema["id"].dataType.simpleString()
    return df.select("id", *(redact(f).alias(f) for f in fields)).mapInPandas(run, f"id {kind}, snippets array<struct<field:string,match:string,start:int,end:int,text:string>>")


# fixed values: words that make an old record's date matter, and types that are summaries
DATED, SUMMARIES = ["deadline", "freeze", "release", "deploy", "launch"], ["summary", "session-summary", "daily-summary"]


def drift(df: DataFrame, files: DataFrame) -> DataFrame:
    """id, risk, signals, missing: whether records (id, title, content, freshness, type) may point to what is gone.

    Signals: a cold record with a date and a word of DATED; referenced files that `files` (file) lacks; a summary that
    isn't hot. No signal is a low risk, one a medium one. Of a text's first five file names those in the workspace count.
    """
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    low = F.lower(text)
    dated = (F.col("freshness") == "cold") & text.rlike("(20[2-9][0-9]|201[0-9])-[0-9]{2}-[0-9]{2}") & low.rlike("|".join(DATED))
    stale = F.col("type").isin(SUMMARIES) & F.col("freshness").isin("cold", "warm")
    named = df.select("id", F.explode(file_refs(text)).alias("file")).where(~F.col("file").startswith(".") & ~F.col("file").startswith("/"))
    gone = named.join(files.select("file").distinct(), "file", "left_anti").groupBy("id").agg(F.count("*").alias("missing"))
    rows = df.select("id", F.coalesce(dated, F.lit(False)).alias("dated"), F.coalesce(stale, F.lit(False)).alias("stale")).join(gone, "id", "left").withColumn("missing", F.coalesce("missing", F.lit(0)))
    signals = F.array_compact(F.array(
        F.when(F.col("dated"), "cold-record-with-time-sensitive-content"), F.when(F.col("missing") > 0, F.concat(F.lit("referenced-files-missing:"), F.col("missing").cast("string"))), F.when(F.col("stale"), "summary-record-cold-staleness")
    ))
    return rows.withColumn("signals", signals).select("id", F.when(F.size("signals") >= 2, "high").when(F.size("signals") == 1, "medium").otherwise("low").alias("risk"), "signals", "missing")


#: Characters of an entry's text that are searched, and of its excerpt.
LONGEST_TEXT, LONGEST_EXCERPT = 6000, 240


def entries_of(records: DataFrame) -> DataFrame:
    """Search entries of records: entry_id, record_id, field, pos, text, excerpt and the record's other columns.

    A record that isn't noise gives a parent (its title and content, redacted, with agent, project, type and tool) and an
    entry for each fact and concept that isn't noise. A record without an id has one of its tool, time, title and content.
    The search text of an entry ends at LONGEST_TEXT characters, which is the index's format.
    """
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in records.columns else F.lit("")
    blank = lambda c: F.when(c != "", c)
    rows = records.where(~is_noise(F.concat_ws(" ", of("title"), of("content"))))
    # texts are made once, before they are used again and again
    rows = rows.withColumns({"_title": redact_spaced(of("title")), "_content": redact_spaced(of("content"))})
    title, content = F.col("_title"), F.col("_content")
    seed = F.concat_ws("|", F.trim(of("tool")), F.trim(of("t")), title, content)
    rows = rows.withColumn("record_id", F.when(F.trim(of("id")) != "", F.trim(of("id"))).otherwise(F.substring(F.sha1(seed), 1, 16)))
    # parts with single spaces, none of them blank, so the whole has single spaces
    whole = F.concat_ws(" ", blank(title), blank(content), *(blank(normalize_spaces(of(c))) for c in ("agent", "project", "type", "tool")))
    none = F.array().cast("array<string>")

    def part(name: str, column: str):
        items = F.coalesce(F.col(column), none) if column in records.columns else none
        made = F.transform(items, lambda v, i: F.struct(F.concat(F.col("record_id"), F.lit(f"__{name}_"), i.cast("string")).alias("entry_id"), F.lit(name).alias("field"), i.cast("int").alias("pos"), normalize_spaces(v).alias("text")))
        return F.filter(made, lambda e: ~is_noise(e["text"]))

    parent = F.array(F.struct(F.col("record_id").alias("entry_id"), F.lit("content").alias("field"), F.lit(0).alias("pos"), whole.alias("text")))
    others = [c for c in records.columns if c not in ("id", "record_id", "entry_id", "field", "pos", "text", "excerpt", "facts", "concepts")]
    out = rows.select("record_id", *others, F.inline(F.concat(parent, part("fact", "facts"), part("concept", "concepts"))))
    return out.withColumn("text", F.substring("text", 1, LONGEST_TEXT)).withColumn("excerpt", F.substring("text", 1, LONGEST_EXCERPT)).select("entry_id", "record_id", "field", "pos", "text", "excerpt", *others)


def ranking_quality(results: DataFrame, k: int) -> DataFrame:
    """query, dcg, ndcg, mrr, recall of results (query, rank, grade, n_relevant) within the first k.

    The ideal ranking is the retrieved grades in falling order; recall divides by the smaller of k and the relevant ones.
    """
    top = results.where(F.col("rank") <= k)
    ideal = F.row_number().over(W.partitionBy("query").orderBy(F.desc("grade"), "rank"))
    gain = lambda place: (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col(place) + 1.0)
    return (
        top.withColumn("ideal", ideal).groupBy("query")
        .agg(
            F.sum(gain("rank")).alias("dcg"), F.sum(gain("ideal")).alias("best"),
            F.coalesce(F.max(F.when(F.col("grade") > 0, 1.0 / F.col("rank"))), F.lit(0.0)).alias("mrr"),
            F.sum((F.col("grade") > 0).cast("int")).alias("hits"), F.max("n_relevant").alias("n_relevant"),
        )
        .select("query", "dcg", F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0).alias("ndcg"), "mrr", F.when(F.col("n_relevant") > 0, F.col("hits") / F.least("n_relevant", F.lit(k))).otherwise(0.0).alias("recall"))
    )
