"""Other programs' stores of observations as a Spark source, read in batches and as a stream, and their coercion to records.

A store gives its items in pages, oldest first, and only ever adds to its end. Two kinds are read:

* a folder (any file system pyarrow opens): numbered subfolders that hold a _SUCCESS mark, each with files of JSON lines, see write_pages();
* an HTTP address that answers ?offset=&limit= (and project=, type=) with {"items": [...], "total": n}.

    register(spark)
    rows = spark.read.format("observations").option("path", folder).load().where("project = 'p1'")
    structured(rows, tool="notes").write...

Rows are page, id, project, type, created_at and the whole item as JSON. Equality and IN filters on page, id, project and type are
pushed: those on page leave pages out of the plan, the others leave rows out where they are read. A stream's offset is the place up to
which it has read, so it resumes where it stopped. Lines that aren't JSON objects are left out.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, IsNotNull

from memoglyph.functions.text import normalize_spaces

FORMAT = "observations"
SCHEMA = "page string, id string, project string, type string, created_at string, item string"
#: Columns, first in SCHEMA, whose filters are pushed.
PUSHED = [("page",), ("id",), ("project",), ("type",)]
#: Bytes of files that one task reads, at least a file; items of a page over HTTP.
TASK_BYTES, PAGE_ITEMS = 32_000_000, 500
#: Times a page is asked for over HTTP, seconds to the first repeat (doubled each time) and to the end of one request.
TRIES, WAIT, TIMEOUT = 4, 0.5, 30.0

# fixed values: what an imported observation is
IMPORTED = {"schemaVersion": 2, "visibility": "shared", "source_kind": "session", "memory_level": "session", "task_state": "", "freshness": "hot", "confidence": 0.72}
# fixed values: types whose observations are feedback
FEEDBACK = "preference|decision|workflow|rule"


class Pages(InputPartition):
    """What one task reads: names of files, or first and last place of an HTTP store."""

    def __init__(self, names: list[str] | None = None, start: int = 0, end: int = 0):
        self.names, self.start, self.end = names or [], start, end


def _text(value) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _row(page: str | None, item: dict) -> tuple:
    return (page, *(_text(item.get(k)) for k in ("id", "project", "type", "created_at")), json.dumps(item, ensure_ascii=False))


class Folder:
    """A store of files; a place is the name of a file, as folder/file."""

    start = ""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _open(self):
        from pyarrow import fs

        uri = self.path.replace("file:/", "file:///", 1) if self.path.startswith("file:/") and not self.path.startswith("file://") else self.path
        return fs.FileSystem.from_uri(uri)

    def end(self) -> str:
        return max((n for n, _ in self._files()), default="")

    def _files(self) -> list[tuple[str, int]]:
        """Names and sizes of all files of finished subfolders, in order."""
        from pyarrow import fs

        system, base = self._open()
        known: dict[str, list[tuple[str, int]]] = {}
        done = set()
        for info in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
            folder, _, name = info.path[len(base.rstrip("/")) + 1 :].rpartition("/")
            if name == "_SUCCESS":
                done.add(folder)
            elif info.type == fs.FileType.File and folder and "/" not in folder and not name.startswith(("_", ".")):
                known.setdefault(folder, []).append((f"{folder}/{name}", info.size))
        return sorted(f for folder in done for f in known.get(folder, []))

    def between(self, start: str, end: str, wanted: dict[str, set]) -> list[Pages]:
        tasks: list[Pages] = []
        held = 0
        for name, size in self._files():
            if not start < name <= end or ("page" in wanted and name not in wanted["page"]):
                continue
            if not tasks or held + size > TASK_BYTES:
                tasks.append(Pages([]))
                held = 0
            tasks[-1].names.append(name)
            held += size
        return tasks

    def items(self, part: Pages, wanted: dict[str, set]) -> Iterator[tuple[str | None, dict]]:
        system, base = self._open()
        for name in part.names:
            with system.open_input_stream(f"{base}/{name}") as raw:
                left = b""
                while chunk := raw.read(1 << 20):
                    *lines, left = (left + chunk).split(b"\n")
                    yield from ((name, item) for line in lines if (item := _object(line)) is not None)
                if (item := _object(left)) is not None:
                    yield name, item


class Web:
    """A store behind an address; a place is a number of items. Its rows have no page: their places change with what is asked for."""

    start = 0

    def __init__(self, path: str, items: int = PAGE_ITEMS):
        self.path, self.size = path, items

    def _ask(self, offset: int, limit: int, wanted: dict[str, set]) -> dict:
        asked = {"offset": offset, "limit": limit} | {k: next(iter(v)) for k, v in wanted.items() if k in ("project", "type") and len(v) == 1}
        url = f"{self.path}{'&' if '?' in self.path else '?'}{urllib.parse.urlencode(asked)}"
        for n in range(TRIES):
            try:
                with urllib.request.urlopen(url, timeout=TIMEOUT) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if e.code < 500 and e.code != 429 or n == TRIES - 1:
                    raise
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if n == TRIES - 1:
                    raise
            time.sleep(WAIT * 2**n)
        raise AssertionError("not reached")

    def end(self, wanted: dict[str, set] | None = None) -> int:
        return int(self._ask(0, 0, wanted or {})["total"])

    def between(self, start: int, end: int, wanted: dict[str, set]) -> list[Pages]:
        cuts = [*range(start, end, self.size), end]
        return [Pages(start=a, end=b) for a, b in zip(cuts, cuts[1:])]

    def items(self, part: Pages, wanted: dict[str, set]) -> Iterator[tuple[str | None, dict]]:
        at = part.start
        while at < part.end:
            found = self._ask(at, part.end - at, wanted)["items"]
            if not found:
                raise OSError(f"{self.path} ends at {at}, before the {part.end} items that it told of")
            yield from ((None, item) for item in found[: part.end - at] if isinstance(item, dict))
            at += len(found)


def _object(line: bytes) -> dict | None:
    try:
        item = json.loads(line)
    except ValueError:
        return None
    return item if isinstance(item, dict) else None


def _store(options) -> Folder | Web:
    path = options.get("path")
    if not path:
        raise ValueError("give the store's path")
    return Web(path, int(options.get("items", PAGE_ITEMS))) if path.startswith(("http://", "https://")) else Folder(path)


def _rows(store: Folder | Web, part: Pages, wanted: dict[str, set]) -> Iterator[tuple]:
    for page, item in store.items(part, wanted):
        row = _row(page, item)
        if all(v in wanted[k] for (k,), v in zip(PUSHED, row) if k in wanted):
            yield row


class Reader(DataSourceReader):
    def __init__(self, options):
        self.store, self.wanted = _store(options), {}

    def pushFilters(self, filters):
        left = []
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in PUSHED:
                left.append(f)
            else:
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
        # a value that is wanted isn't null
        return [f for f in left if not (isinstance(f, IsNotNull) and f.attribute[0] in self.wanted)]

    def partitions(self):
        # a web store counts what it was asked for, so the filters it answers to are part of its end
        end = self.store.end(self.wanted) if isinstance(self.store, Web) else self.store.end()
        return self.store.between(self.store.start, end, self.wanted) or [Pages()]

    def read(self, partition):
        return _rows(self.store, partition, self.wanted)


class Stream(DataSourceStreamReader):
    def __init__(self, options):
        self.store = _store(options)

    def initialOffset(self):
        return {"place": self.store.start}

    def latestOffset(self):
        return {"place": self.store.end()}

    def partitions(self, start, end):
        return self.store.between(start["place"], end["place"], {})

    def read(self, partition):
        return _rows(self.store, partition, {})

    def commit(self, end):
        """Nothing: a store keeps its items."""


class Observations(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)

    def streamReader(self, schema):
        return Stream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with pushed filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Observations)


def write_pages(items: DataFrame, path: str, number: int, rows: int = 500) -> None:
    """Adds a batch of items (any columns) to a folder store as subfolder `number`, in files of at most `rows` lines.

    The subfolder is seen once its _SUCCESS mark is there. A batch that is written again replaces itself.
    """
    items.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", rows).text(f"{path}/{number:012d}")


def as_list(text: Column) -> Column:
    """A field that may be a list, the JSON text of one, or a single value, as list of texts.

    Blank gives none; text that is no JSON list is one element, trimmed, a quoted text without its quotes. Nulls in a list are left out.
    """
    value = F.trim(text)
    kind = F.schema_of_variant(F.try_parse_json(value))
    return (
        F.when(value.isNull() | (value == ""), F.array().cast("array<string>"))
        .when(kind.startswith("ARRAY"), F.array_compact(F.from_json(value, "array<string>")))
        .when(kind == "STRING", F.array(F.try_variant_get(F.try_parse_json(value), "$", "string")))
        .otherwise(F.array(value))
    )


def scope_of(project: Column, kind: Column, home: str = "") -> Column:
    """feedback by type, project where there is one that isn't the user's home, else summary."""
    named = normalize_spaces(project)
    return F.when(F.lower(F.coalesce(kind, F.lit(""))).rlike(FEEDBACK), "feedback").when((named != "") & (F.coalesce(project, F.lit("")) != home), "project").otherwise("summary")


def structured(rows: DataFrame, tool: str, source: str = "import", home: str = "") -> DataFrame:
    """Rows of the source as records; those without an id are left out. All in the JVM, without a shuffle.

    Content falls back to the narrative, then the title; the title to the content, then the id; times and sessions to their second names.
    """
    of = lambda name: F.get_json_object("item", f"$.{name}")
    clean = lambda name: normalize_spaces(of(name))
    first = lambda *columns: F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))
    base = rows.where(normalize_spaces("id") != "").select(
        "id", "item", clean("title").alias("_title"), clean("narrative").alias("_narrative"), clean("content").alias("_content"), normalize_spaces("project").alias("project"), F.col("project").alias("_project"), F.col("type").alias("_type")
    )
    with_content = base.withColumn("content", first(F.col("_content"), F.col("_narrative"), F.col("_title")))
    constant = lambda name: F.lit(IMPORTED[name]).alias(name)
    return with_content.select(
        constant("schemaVersion"), "id", first(clean("created_at"), clean("t")).alias("t"), F.lit(tool).alias("tool"), first(clean("memory_session_id"), clean("session")).alias("session"),
        first(normalize_spaces("_type"), F.lit("memory")).alias("type"), "project", first(F.col("_title"), F.col("content"), F.col("id")).alias("title"), "content",
        *(as_list(of(name)).alias(name) for name in ("facts", "concepts", "files_read", "files_modified")),
        F.lit(source).alias("source"), scope_of(F.col("_project"), F.col("_type"), home).alias("scope"), constant("visibility"), constant("source_kind"), constant("memory_level"),
        first(F.col("project"), F.lit(source)).alias("workspace"), constant("task_state"), constant("freshness"), constant("confidence"), F.sha2("content", 256).alias("content_hash"),
        F.struct(clean("subtitle").alias("subtitle"), F.col("_narrative").alias("narrative")).alias("metadata"),
    )
