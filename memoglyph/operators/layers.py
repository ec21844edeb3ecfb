"""Layers of records, each made of sources and of other layers, and made anew only where what it is made of has changed.

A layer's key is a digest of its rule's version and of its inputs' contents. A build makes the layers whose key isn't the stored
one, in the order of their inputs, each in one commit, so a build that dies goes on where it stopped. A layer that was made anew and
came out as before leaves its dependants as they are. Readers see the layers of the last build that ended.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from memoglyph.functions.text import normalize_spaces
from memoglyph.operators.entities import extract
from memoglyph.operators.lifecycle import contract_errors, one_per_key
from memoglyph.operators.reports import layer_summary
from memoglyph.sources.commits import Store

#: The note of a layer in its store: its key and its content.
NOTE = "layer:{}"
# fixed value: an inbox entry is a repeat of a stored record of equal content that is at most this old
RECENT_MS = 30_000


@dataclass(frozen=True)
class Source:
    """Rows that a build reads, and a digest that changes when they do."""

    rows: DataFrame
    content: str


@dataclass(frozen=True)
class Layer:
    """make(rows of each input, in their order); version changes when make's rule does."""

    make: Callable[..., DataFrame]
    inputs: tuple[str, ...]
    version: str = "1"


def _measures(df: DataFrame) -> list[Column]:
    """Aggregates that tell tables of other rows apart, whatever the order of rows; none grows with the table."""
    plain = [F.to_json(F.struct(c)) if _holds_map(df.schema[c].dataType) else F.col(c) for c in df.columns]
    # a null and its absence would hash alike, so whether there is a value counts too
    h = F.xxhash64(*plain, *(F.isnull(c) for c in df.columns)) if plain else F.lit(0).cast("long")
    low = F.shiftright(F.shiftleft(h, 32), 32)
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(F.shiftright(h, 32)), F.lit(0)).alias("a"), F.coalesce(F.sum(low), F.lit(0)).alias("b")]


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _holds_map(kind.elementType))


def _digest(df: DataFrame, found: dict) -> str:
    # where the optimizer finds that there are no rows, nothing is measured
    return hashlib.sha1(json.dumps([df.schema.simpleString(), *(found.get(k) or 0 for k in ("n", "x", "a", "b"))]).encode()).hexdigest()


def source(df: DataFrame) -> Source:
    """A source whose content is that of its rows, read once for it."""
    return Source(df, _digest(df, df.agg(*_measures(df)).first().asDict()))


def files(spark: SparkSession, path: str | list[str], read: Callable[[str | list[str]], DataFrame], schema: str) -> Source:
    """Files as a source; their paths, lengths and times of change stand for the content, so unchanged files aren't read.

    Without any file there it is empty, with the columns of `schema`.
    """
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
        state = _digest(found, found.agg(*_measures(found)).first().asDict())
        return Source(read(path), state)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return Source(spark.createDataFrame([], schema), "none")


def build(store: Store, sources: dict[str, Source], layers: dict[str, Layer]) -> dict[str, str]:
    """Makes the store hold all layers of these sources; of each layer "kept", "same" (made anew, as it was before) or "built".

    A build in which all are kept writes nothing. Layers that aren't asked for stay as they are. ValueError for an input that is
    neither a source nor a layer, a name that is both, or layers in a circle (graphlib's CycleError).
    """
    if both := set(sources) & set(layers):
        raise ValueError(f"both a source and a layer: {sorted(both)}")
    if unknown := {i for l in layers.values() for i in l.inputs} - set(sources) - set(layers):
        raise ValueError(f"neither a source nor a layer: {sorted(unknown)}")
    order = [n for n in TopologicalSorter({n: l.inputs for n, l in layers.items()}).static_order() if n in layers]
    notes, done = store.manifest()["notes"], {}
    content = {n: s.content for n, s in sources.items()}
    for name in order:
        layer, held = layers[name], notes.get(NOTE.format(name), {})
        key = hashlib.sha1(json.dumps([layer.version, [content[i] for i in layer.inputs]]).encode()).hexdigest()
        if held.get("key") == key:
            content[name], done[name] = held["content"], "kept"
            continue
        rows = layer.make(*(sources[i].rows if i in sources else store.read(i) for i in layer.inputs))
        seen = Observation()
        measured = rows.observe(seen, *_measures(rows))
        made: dict = {}

        def note(_, rows=rows, seen=seen, name=name, key=key, made=made) -> dict:
            made["content"] = _digest(rows, seen.get)
            return {NOTE.format(name): {"key": key, "content": made["content"]}}

        store.commit({name: measured}, replace=True, notes=note)
        content[name] = made["content"]
        done[name] = "same" if held.get("content") == made["content"] else "built"
    now = store.manifest()
    contents = {n: v["content"] for n, v in sorted(now["notes"].items()) if n.startswith(NOTE.format(""))}
    if set(done.values()) - {"kept"} or now["notes"].get("layers_ended", {}).get("contents") != contents:
        store.commit({}, notes={"layers_ended": {"version": now["version"] + 1, "contents": contents}}, expect=now["version"])
    return done


def read(store: Store, name: str) -> DataFrame:
    """A layer as of the last build that ended; KeyError before the first. After a build that died, vacuum() has to wait for one that ends."""
    ended = store.manifest()["notes"].get("layers_ended")
    if ended is None:
        raise KeyError(name)
    return store.read(name, ended["version"])


def shared_inbox(entries: DataFrame, dreams: DataFrame, stored: DataFrame, as_of_ms: int) -> DataFrame:
    """Inbox entries, an id once (the last of its rows by t_ms, then by content), then written-back records whose id isn't among them.

    All: id, content, content_hash and t_ms, of which the hash may be missing (that of the content then). An entry is left out where the
    newest stored or written-back record of its hash is at most 30 s older than as_of_ms. Rows without an id don't count.
    `collides` marks entries whose hash another entry has under another id.
    """
    hash_ = F.coalesce(F.nullif("content_hash", F.lit("")), F.sha2(F.coalesce("content", F.lit("")), 256))
    given = lambda df: df.where(normalize_spaces("id") != "").withColumn("content_hash", hash_)
    fresh, back = given(entries), given(dreams)
    known = given(stored).select("content_hash", "t_ms").unionByName(back.select("content_hash", "t_ms"))
    recent = known.groupBy("content_hash").agg(F.max("t_ms").alias("_t")).where(F.lit(as_of_ms) - F.col("_t") <= RECENT_MS)
    kept = one_per_key(fresh.join(recent, "content_hash", "left_anti"), ["id"], F.desc_nulls_last("t_ms"), F.desc_nulls_last("content"))
    ids = kept.groupBy("content_hash").agg((F.min("id") != F.max("id")).alias("collides"))
    out = kept.join(ids, "content_hash")
    others = one_per_key(back.join(kept.select("id"), "id", "left_anti"), ["id"], F.asc_nulls_last("t_ms"), F.asc_nulls_last("content"))
    return out.unionByName(others.withColumn("collides", F.lit(False)), allowMissingColumns=True)


def session_layer(stored: DataFrame, sessions: DataFrame, projects: DataFrame) -> DataFrame:
    """Stored and new session records, then projects' records that have content and whose id isn't stored; these as project records of sessions."""
    new = projects.where(F.coalesce("content", F.lit("")) != "").join(stored.select("id").where("id IS NOT NULL").distinct(), "id", "left_anti")
    marked = new.withColumns({"source": F.lit("projects"), "memory_level": F.lit("session"), "scope": F.lit("project")})
    return stored.unionByName(sessions, allowMissingColumns=True).unionByName(marked, allowMissingColumns=True)


def all_records(**parts: DataFrame) -> DataFrame:
    """The rows of layers as one table, with the layer's name."""
    named = [df.withColumn("layer", F.lit(name)) for name, df in parts.items()]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def memory_layers(as_of_ms: int) -> dict[str, Layer]:
    """The standard layers over the sources inbox, dreams, stored, sessions_stored, sessions, projects, events and tasks.

    shared, session, event and task are layers of records; facts are the facts and concepts that their texts give, an id of a layer
    once; summary has the figures of each layer. At another time shared is made anew; the others only if it comes out otherwise.
    """
    union = lambda a, b, c, d: all_records(shared=a, session=b, event=c, task=d)

    def facts(records: DataFrame) -> DataFrame:
        once = one_per_key(records.where("id IS NOT NULL"), ["layer", "id"], F.desc_nulls_last("t_ms"), F.asc_nulls_last("content"))
        keyed = once.select(F.to_json(F.struct("layer", "id")).alias("id"), "content")
        of = lambda f: F.get_json_object("id", f"$.{f}")
        return extract(keyed).select(of("layer").alias("layer"), of("id").alias("id"), "facts", "concepts").where("size(facts) + size(concepts) > 0")

    return {
        # the version names the time, for what counts as recent depends on it
        "shared": Layer(lambda i, d, s: shared_inbox(i, d, s, as_of_ms), ("inbox", "dreams", "stored"), f"1:{as_of_ms}"),
        "session": Layer(session_layer, ("sessions_stored", "sessions", "projects")),
        "event": Layer(lambda df: df, ("events",)),
        "task": Layer(lambda df: df, ("tasks",)),
        "records": Layer(union, ("shared", "session", "event", "task")),
        "facts": Layer(facts, ("records",)),
        "summary": Layer(lambda df: layer_summary(contract_errors(df)), ("records",)),
    }
