"""An inverted index that is written once, added to by commits, and read by many queries.

A commit's entries are inverted where they lie: a task sorts the postings (term, block, id, tf, length) of SHEET blocks at a time by
term, so nothing is shuffled, and a query's filter on its terms reaches the scan and passes over the other pages of a file. A block is
BLOCK entries that follow each other; the first posting of each term in a block has their number, the largest count and the smallest
length, which bound what an entry there can score. A top-k query scores the blocks with the highest bounds first and then only those
whose bound reaches the k-th score found. Corpus figures (entries, tokens, mean idf) are notes of the index's manifest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from memoglyph.operators.lifecycle import checkpointed, staged
from memoglyph.sources.commits import Store

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Entries of a block, and blocks that a top-k query scores first.
BLOCK, FIRST = 4096, 8
EMPTY = "_empty_"
#: Bytes of tokens that are counted at once.
PIECE = 4 << 20
#: Blocks, and bytes of their tokens, whose postings are sorted together.
SHEET, SHEET_BYTES = 8, 32 << 20


def counted(entries: DataFrame) -> DataFrame:
    """id, term, length, tf of the tokens t of each row, and a row with tf 0 for each row of entries; nothing is shuffled."""
    names = ["id", "term", "length", "tf"]
    schema = T.StructType([T.StructField("id", entries.schema["id"].dataType), T.StructField("term", T.StringType()), T.StructField("length", T.IntegerType()), T.StructField("tf", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * PIECE // max(PIECE, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                ids, lists = (batch.slice(at, step).column(n) for n in ("id", "t"))
                lengths = pc.list_value_length(lists).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([ids, pa.nulls(len(ids), pa.string()), lengths, pa.array(np.zeros(len(ids), np.int32))], names=names)
                terms = lists.flatten().dictionary_encode(null_encoding="encode")
                if not len(terms):
                    continue
                size = len(terms.dictionary)
                keys, tf = np.unique(pc.list_parent_indices(lists).to_numpy().astype(np.int64) * size + terms.indices.to_numpy(), return_counts=True)
                row = pa.array(keys // size)
                yield pa.RecordBatch.from_arrays([ids.take(row), terms.dictionary.take(pa.array(keys % size)), lengths.take(row), pa.array(tf.astype(np.int32))], names=names)

    return entries.select("id", "t").mapInArrow(run, schema)


def _sheet(ids: pa.Array, lengths: pa.Array, lists: pa.Array, first: int, most_rows: int) -> tuple[pa.RecordBatch, int]:
    """The postings of entries by term, block and entry, blocks of most_rows numbered from `first`; and the number of blocks.

    Rows of one id that follow each other are in one block.
    """
    n = len(ids)
    new = np.flatnonzero(np.append(pc.fill_null(pc.not_equal(ids.slice(1), ids.slice(0, max(0, n - 1))), True).to_numpy(zero_copy_only=False), True)) + 1
    ends = np.unique(new[np.minimum(np.searchsorted(new, np.arange(most_rows, n + most_rows, most_rows)), len(new) - 1)])
    terms = lists.flatten().dictionary_encode(null_encoding="encode")
    place = np.empty(len(terms.dictionary), np.int64)
    order = pc.sort_indices(terms.dictionary).to_numpy()
    place[order] = np.arange(len(order))
    # rows are in the order of their blocks, so postings by term and row are by term and block
    keys, tf = np.unique(place[terms.indices.to_numpy()] * n + pc.list_parent_indices(lists).to_numpy(), return_counts=True)
    term, row = keys // max(1, n), keys % max(1, n)
    block, tf = np.searchsorted(ends, row, "right"), tf.astype(np.int32)
    length = lengths.to_numpy()[row]
    starts = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))[: len(term)])
    count, most, least = np.zeros(len(term), np.int64), np.zeros(len(term), np.int32), np.zeros(len(term), np.int32)
    if len(starts):
        count[starts] = np.diff(np.append(starts, len(term)))
        most[starts], least[starts] = np.maximum.reduceat(tf, starts), np.minimum.reduceat(length, starts)
    rest = count == 0
    return pa.RecordBatch.from_arrays([
        ids.take(pa.array(row)), terms.dictionary.take(pa.array(order[term])), pa.array(length), pa.array(tf), pa.array(block + first),
        pa.array(count, mask=rest), pa.array(most, mask=rest), pa.array(least, mask=rest),
    ], names=["id", "term", "length", "tf", "block", "n", "most", "least"]), len(ends)


def inverted(entries: DataFrame, base: int) -> DataFrame:
    """The postings of rows (id, length, t), blocks numbered from base; n, most, least on the first of each term in a block, else null."""
    kinds = {"id": entries.schema["id"].dataType, "term": T.StringType(), "length": T.IntegerType(), "tf": T.IntegerType(), "block": T.LongType(), "n": T.LongType(), "most": T.IntegerType(), "least": T.IntegerType()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = base + (TaskContext.get().partitionId() << 16)

        def sheet(rows: pa.Table):
            nonlocal at
            whole = rows.combine_chunks()
            made, blocks = _sheet(*(whole[c].chunk(0) for c in ("id", "length", "t")), at, BLOCK)
            at += blocks
            yield from (made.slice(i, 50_000) for i in range(0, made.num_rows, 50_000))

        held: list[pa.RecordBatch] = []
        size = rows = 0
        for batch in batches:
            step = max(1, min(SHEET * BLOCK, batch.num_rows * PIECE // max(PIECE, batch.nbytes)))
            for piece in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                # a sheet ends where the id changes
                if held and (rows >= SHEET * BLOCK or size >= SHEET_BYTES) and held[-1]["id"][-1] != piece["id"][0]:
                    yield from sheet(pa.Table.from_batches(held))
                    held, size, rows = [], 0, 0
                held.append(piece)
                size, rows = size + piece.nbytes, rows + piece.num_rows
        if held:
            yield from sheet(pa.Table.from_batches(held))

    return entries.select("id", "length", "t").mapInArrow(run, T.StructType([T.StructField(k, v) for k, v in kinds.items()]))


class InvertedIndex:
    """BM25 over entries (id, tokens) from a store; filled: entries without tokens count as one of a token that none asks for."""

    def __init__(self, spark: SparkSession, path: str, filled: bool = False):
        self.store, self.filled = Store(spark, path), filled

    def add(self, entries: DataFrame, beside: dict[str, DataFrame] | None = None, once: str | None = None, written: bool = False) -> int:
        """Adds entries (ids that the index has are added again, so pass new ones) and, in the same commit, rows of the tables beside.

        once: a name under which entries are added a single time, whoever else adds them. Other writers at the same time
        get a Conflict, as the figures are made from the version before. written: the entries are in files, so they may be
        read twice; others are staged.
        """
        tokens = F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit(EMPTY)) if self.filled else F.array().cast("array<string>"))
        rows = entries.select("id", F.coalesce(tokens, F.array().cast("array<string>")).alias("t"))
        with nullcontext(rows) if written else staged(rows) as rows:
            return self._add(rows.select("id", F.size("t").alias("length"), "t"), beside, once)

    def _add(self, rows: DataFrame, beside: dict[str, DataFrame] | None, once: str | None) -> int:
        each = rows.groupBy("id").agg(F.count("*").alias("n"), F.sum("length").alias("tokens"))
        own = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.max("n").alias("most")).first()
        version, before = self.store.manifest()["version"], self.figures()
        if (own["most"] or 0) > 1:  # rows of an id and a length are one, and those of an id together
            rows = rows.groupBy("id", "length").agg(F.flatten(F.collect_list("t")).alias("t")).repartition("id").sortWithinPartitions("id")
        n, total = own["n"] + before["n"], own["tokens"] + before["tokens"]

        def figures(made: dict[str, DataFrame]) -> dict:
            new = self._bounds(made["postings"])
            both = new.select("term", "n").unionByName(self._bounds(self.store.read("postings")).select("term", "n")) if before["n"] else new
            idf = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
            mean_idf = both.groupBy("term").agg(F.sum("n").alias("df")).agg(F.avg(idf).alias("m")).first()["m"] or 0.0
            return {"n": n, "tokens": total, "mean_idf": mean_idf, "blocks": before["blocks"] + max(1, -(-own["n"] // BLOCK))}

        # blocks of one commit have numbers of their own
        return self.store.commit({"postings": inverted(rows, (version + 1) << 32), **(beside or {})}, notes=figures, expect=version, **({"stream": once, "batch": 0} if once else {}))

    @staticmethod
    def _bounds(postings: DataFrame) -> DataFrame:
        """term, block, n, tf, length: how many entries of a block have a term, its largest count and the smallest length there."""
        return postings.where("n IS NOT NULL").select("term", "block", "n", F.col("most").alias("tf"), F.col("least").alias("length"))

    def figures(self) -> dict:
        """n, tokens, mean_idf and blocks of all entries."""
        return {"n": 0, "tokens": 0, "mean_idf": 0.0, "blocks": 0} | self.store.manifest()["notes"]

    def frequencies(self, terms: list[str]) -> DataFrame:
        """term, df of those of the terms that the index has."""
        return self._bounds(self.store.read("postings").where(F.col("term").isin(terms))).groupBy("term").agg(F.sum("n").alias("df"))

    def weights(self, query_tokens: list[str], okapi: bool) -> tuple[dict[str, float], float, int]:
        """The weight of each query term that the index has (its idf, as often as it is asked for), the mean length, the number of blocks."""
        asked: dict[str, int] = {}
        for t in query_tokens:
            asked[t] = asked.get(t, 0) + 1
        figures = self.figures()
        n, mean = figures["n"], figures["tokens"] / figures["n"] if figures["n"] else 0.0
        out = {}
        for r in self.frequencies(list(asked)).collect() if asked else []:
            idf = math.log(n - r["df"] + 0.5) - math.log(r["df"] + 0.5) if okapi else math.log((n - r["df"] + 0.5) / (r["df"] + 0.5) + 1)
            out[r["term"]] = asked[r["term"]] * (EPSILON * figures["mean_idf"] if okapi and idf < 0 else idf)
        return out, mean, figures["blocks"]

    @staticmethod
    def _part(weights: dict[str, float], mean: float, least: float | None = None):
        weight = F.create_map(*(x for t, w in weights.items() for x in (F.lit(t), F.lit(w if least is None else max(w, least)))))[F.col("term")]
        return weight * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean))))

    def _scored(self, weights: dict[str, float], mean: float) -> DataFrame:
        hits = self.store.read("postings").where(F.col("term").isin(list(weights)))
        return hits.select("id", "block", self._part(weights, mean).alias("part"))

    def _nothing(self) -> DataFrame:
        return self.store.read("postings").select("id", F.lit(0.0).alias("score")).limit(0)

    def scores(self, query_tokens: list[str], okapi: bool = False) -> DataFrame:
        """id, score of all entries with a positive score; reads the query's postings alone."""
        weights, mean, blocks = self.weights(query_tokens, okapi)
        if not weights:
            return self._nothing()
        return self._scored(weights, mean).groupBy("id").agg(F.sum("part").alias("score")).where("score > 0")

    def top(self, query_tokens: list[str], k: int, okapi: bool = False, digits: int = 6) -> DataFrame:
        """id, score (rounded) of the k best, ties to the smaller id; blocks whose bound stays below the k-th score aren't read."""
        weights, mean, blocks = self.weights(query_tokens, okapi)
        if not weights:
            return self._nothing()
        best = lambda rows: rows.groupBy("id").agg(F.round(F.sum("part"), digits).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)
        rows = self._scored(weights, mean)
        if blocks <= FIRST:
            return best(rows)
        bounds = checkpointed(self._bounds(self.store.read("postings").where(F.col("term").isin(list(weights)))).groupBy("block").agg(F.sum(self._part(weights, mean, 0.0)).alias("bound")))
        first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST).collect()]
        found = checkpointed(best(rows.where(F.col("block").isin(first))))
        least = found.agg(F.count("*").alias("n"), F.min("score").alias("s")).first()
        reach = least["s"] if least["n"] == k else 0.0
        others = bounds.where((F.col("bound") >= reach - 10.0**-digits) & ~F.col("block").isin(first)).select("block")
        rest = best(rows.join(others, "block", "left_semi"))
        return found.unionByName(rest).orderBy(F.desc("score"), "id").limit(k)
