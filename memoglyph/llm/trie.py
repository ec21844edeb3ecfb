"""Conversation prefix trie by preorder intervals.

Every distinct prefix of a conversation is a node. Nodes are ranked lexicographically (preorder, turns of a node's children by
their digest): a node's rank is the sum, over its path, of one and of the sizes of the subtrees of smaller siblings. A
subtree is then the interval from a node's rank to its stored end, and its leaves and savings are differences of prefix sums
over the ranks. All sums run over sorted ranges, so neither a long conversation, nor a node of many members or children,
is one task's; a node is known by its depth and sums of hashes of (turn, depth), so no prefix is ever held as a whole.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memoglyph.llm.common import checkpointed, giving_back, joined_hot, table
from memoglyph.llm.prefix import running

WORDS = r"[^\x20\x09-\x0D]+"
#: Conversations of a block of this many ids begin as its first one does, by up to HEADS - 1 turns.
BLOCK, HEADS = 20, 4
#: Ids of a node's ended conversations that travel as one string.
ENDS = 4096
_LOW = 0xFFFFFFFF
_NOTHING = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (1, 2, ...), digest, words of each turn: by turn, null first, ties by SHA-256 of length of role, role and text.

    Null role or text is empty; rows without a conv_id belong to no conversation and go; repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    own = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"), F.monotonically_increasing_id().alias("_tie"))
    return running(checkpointed(own), ["conv_id"], ["turn", "digest", "_tie"], {"at": None}).select("conv_id", "at", "digest", "words")


def shared_heads(found: DataFrame) -> DataFrame:
    """The turns of turns() rebuilt: each conversation begins with the first h turns of its block's first one, h = crc32(id) % HEADS.

    A row at = 0 without a digest stands for the beginning of every conversation, however few turns are left of it.
    """
    h = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % HEADS
    convs = found.where("at = 1").select("conv_id")
    heads = found.where((F.col("conv_id") % BLOCK == 0) & (F.col("at") < HEADS)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "digest", "words"))).alias("head"))  # HEADS - 1 turns at most
    begun = convs.join(heads.withColumnRenamed("conv_id", "_first"), F.col("conv_id") - F.col("conv_id") % BLOCK == F.col("_first"))
    begun = begun.select("conv_id", F.explode("head").alias("t")).where(F.col("t.at") <= h("conv_id")).select("conv_id", F.lit(1).alias("part"), "t.*")
    root = convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    rest = found.where(F.col("at") > h("conv_id")).select("conv_id", F.lit(2).alias("part"), "at", "digest", "words")
    return root.unionByName(begun).unionByName(rest)


def with_roots(found: DataFrame) -> DataFrame:
    """The turns of turns() as they are, each conversation with a row at = 0 for its beginning."""
    root = found.where("at = 1").select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    return root.unionByName(found.select("conv_id", F.lit(1).alias("part"), "at", "digest", "words"))


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *(s.cast("string") for s in sums)).cast("binary")))


def _paths(rows: DataFrame) -> DataFrame:
    """conv_id, depth, digest, words, node and parent (keys of 16 bytes; the root's parent is null) for each turn."""
    placed = running(checkpointed(rows), ["conv_id"], ["part", "at"], {"_n": None}).withColumn("depth", F.col("_n") - 1)
    hashes = F.xxhash64("digest", "depth"), F.xxhash64(F.lit("second"), "depth", "digest")
    halves = [x for v in hashes for x in (F.shiftrightunsigned(v, 32), v.bitwiseAND(F.lit(_LOW)))]
    halved = placed.select("conv_id", "depth", "digest", "words", *(F.when(F.col("digest").isNull(), F.lit(0)).otherwise(x).cast("long").alias(f"_h{i}") for i, x in enumerate(halves)))
    summed = running(halved, ["conv_id"], ["depth"], {f"_s{i}": f"_h{i}" for i in range(4)}, ranged=True)
    above = F.when(F.col("depth") > 0, _key(F.col("depth") - 1, [F.col(f"_s{i}") - F.col(f"_h{i}") for i in range(4)]))
    return checkpointed(summed.select("conv_id", "depth", "digest", "words", _key(F.col("depth"), [F.col(f"_s{i}") for i in range(4)]).alias("node"), above.alias("parent")))


def ended(ends: DataFrame) -> DataFrame:
    """node and ends_sha256: of the conv_ids that end there, ascending and comma-joined.

    A digest is read in order, so a node's ids pass through one task, but as a stream of strings of up to ENDS ids that
    sorted ranges have made; no more than one of them is held.
    """
    ranged = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")

    def joined(batches):
        node, ids = None, []
        for batch in batches:
            out = []
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (k != node or len(ids) == ENDS):
                    out.append((node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = k
                ids.append(c)
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.string()))], names=["node", "first", "ids"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())], names=["node", "first", "ids"])

    strings = ranged.mapInArrow(giving_back(joined), "node binary, first long, ids string")

    def digested(batches):
        node, sha = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column(0), batch.column(2)):
                k = k.as_py()
                if sha is not None and k == node:
                    sha.update(b",")
                else:
                    if sha is not None:
                        out.append((node, sha.hexdigest()))
                    node, sha = k, hashlib.sha256()
                sha.update(ids.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], names=["node", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    return strings.repartition("node").sortWithinPartitions("node", "first").mapInArrow(giving_back(digested), "node binary, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """A row for each node of the trie of the conversations in rows (of shared_heads() or with_roots()).

    node, parent (keys), conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, preorder (0 is the root),
    end (the last rank of its subtree), n_leaves, saved_tokens, ends_sha256. An empty table has no nodes, not even a root.
    """
    paths = _paths(rows)
    nodes = checkpointed(paths.groupBy("node").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("first"), F.min("depth").alias("depth"), F.min("digest").alias("digest"), F.min("words").alias("words"), F.min("parent").alias("parent")))
    # a node is its smallest member's own; the nodes that a conversation has of its own at or below a depth count for its node there
    owned = joined_hot(paths.select("conv_id", "depth", "node"), nodes.select("node", "first"), "node").withColumn("_own", (F.col("first") == F.col("conv_id")).cast("long"))
    below = running(checkpointed(owned), ["conv_id"], [F.col("depth").desc()], {"_below": "_own", "_back": None})
    sizes = below.groupBy("node").agg(F.sum("_below").alias("size"))
    sized = checkpointed(nodes.join(sizes, "node"))
    siblings = running(sized, ["parent"], ["digest"], {"_upto": "size"})
    steps = siblings.select("node", F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.col("_upto") - F.col("size") + 1).alias("_step"))
    stepped = joined_hot(below.select("conv_id", "depth", "node", "_own"), checkpointed(steps), "node")
    ranks = running(checkpointed(stepped), ["conv_id"], ["depth"], {"preorder": "_step"}).where("_own = 1").select("node", "preorder")
    end = F.col("preorder") + F.col("size") - 1
    saving = (F.col("n_convs") - 1) * F.col("words")
    placed = sized.join(ranks, "node").withColumns({"end": end, "_leaf": (F.col("size") == 1).cast("long"), "_saving": saving})
    summed = running(checkpointed(placed), [], ["preorder"], {"_leaves": "_leaf", "_saved": "_saving"})
    at_end = summed.select(F.col("preorder").alias("end"), F.col("_leaves").alias("_leaves_end"), F.col("_saved").alias("_saved_end"))
    spans = joined_hot(summed, at_end, "end")
    told = spans.select("node", "parent", F.col("first").alias("conv_id"), "depth", "n_convs", "preorder", "end", (F.col("_leaves_end") - F.col("_leaves") + F.col("_leaf")).alias("n_leaves"), (F.col("_saved_end") - F.col("_saved") + F.col("_saving")).alias("saved_tokens"))
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    told = told.join(children, "node", "left").join(ended(below.where("_back = 1").select("node", "conv_id")), "node", "left")
    told = checkpointed(told.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "ends_sha256": F.coalesce("ends_sha256", F.lit(_NOTHING))}))
    above = nodes.select(F.col("node").alias("parent"), F.col("first").alias("parent_conv_id"))
    lower = joined_hot(told.where("parent IS NOT NULL"), above, "parent")
    return lower.unionByName(told.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt so that blocks share their beginnings; a row a node."""
    found = turns(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return trie(shared_heads(found)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


_TABLE_STEP = "list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"
#: CRC-32 of the decimal text of conv_id, bit by bit.
_CRC = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda p, q: " + _TABLE_STEP.replace("[x,", "[xor(p, q),") + "))"

ORACLE_SQL = f"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(role), ':', role, text))) AS pos FROM t),
c AS (SELECT conv_id, ({_CRC}) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 1 AS part, o.pos, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, 2, o.pos, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM r),
turned AS (SELECT conv_id, depth, sha256(concat(length(role), ':', role, text)) AS digest, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM n),
p AS (
  SELECT conv_id, depth, words, sha256(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM turned
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
q AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, max(depth) OVER (PARTITION BY conv_id) AS len FROM p),
nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = len), '')) AS ends_sha256
  FROM q GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n FROM nodes GROUP BY parent),
sub AS (
  SELECT q.node, sum((w.n_convs - 1) * w.words) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
  FROM nodes w LEFT JOIN kids k ON k.node = w.node JOIN q ON q.conv_id = w.conv_id AND q.depth <= w.depth GROUP BY q.node)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n, 0) AS n_children,
  sub.leaves AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM nodes v JOIN sub ON sub.node = v.node LEFT JOIN kids k ON k.node = v.node LEFT JOIN nodes u ON u.node = v.parent
"""
