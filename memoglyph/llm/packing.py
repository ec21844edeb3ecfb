"""Best-fit packing of documents into sequences, after Martello and Toth's dominance reduction.

Only the numbers of pieces of each length matter to a packing, a histogram of as many entries as a sequence has tokens,
however many documents there are. The driver reduces and packs this histogram: sets that dominate every other set with the
same piece are fixed for as many copies at once as there are, the instance shrinks, and what is left is packed best-fit, longest
first, also by copies at once. The plan is a short list of slots (a length, how many of it, from which sequence and place on). A piece
takes the slot of its rank among pieces of its length, which a prefix sum over sorted ranges gives.
"""

from __future__ import annotations

import bisect
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from memoglyph.llm.batch_bpe import BatchBpe, ranges
from memoglyph.llm.bpe import load
from memoglyph.llm.common import checkpointed, give_back, pieces as pieces_of, table
from memoglyph.llm.prefix import running

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 4096, 1
#: Text that a task encodes at once, in bytes; a longer document is encoded by itself.
AT_ONCE = 6 << 20


def document_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document: its ids, then `end`, cut only beyond capacity.

    Null texts are empty, so their one piece has the end alone. Repeated rows are documents of their own. No shuffle; the
    tokenizer's tables are broadcast (a few MB, whatever the data).
    """
    encoder = docs.sparkSession.sparkContext.broadcast(BatchBpe(json.loads(load(path))))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("piece", "start", "length", "ids_crc32"))])

    def run(batches):
        bpe = encoder.value
        for batch in batches:
            for some in pieces_of(batch, AT_ONCE):
                ids, count = bpe.encode(some.column(1).to_pylist())
                whole = np.insert(ids, np.cumsum(count), end).astype("<u4")
                size = count + 1
                n = -(-size // capacity)
                at = np.repeat(np.cumsum(size) - size, n)
                piece = ranges(np.zeros(len(n), np.int64), n)
                start = piece * capacity
                length = np.minimum(np.repeat(size, n) - start, capacity)
                data = memoryview(whole.view(np.uint8))
                crc = [zlib.crc32(data[4 * i : 4 * (i + k)]) for i, k in zip((at + start).tolist(), length.tolist())]
                own = some.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
                yield pa.RecordBatch.from_arrays([own, pa.array(piece), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=schema.names)
        bpe._forget()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Plan:
    """Slots of a packing: pieces first, first + 1, ... of a length, `each` of them side by side in a sequence from `offset` on."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences, self.slots, self.used = capacity, 0, [], {}

    def open(self, copies: int) -> int:
        """The first of so many new sequences."""
        self.sequences += copies
        return self.sequences - copies

    def put(self, length: int, each: int, sequence: int, copies: int, offset: int) -> None:
        first = self.used.get(length, 0)
        self.slots.append((length, first, each, sequence, offset))
        self.used[length] = first + each * copies

    def fixed(self, lengths: list[int], copies: int) -> None:
        sequence, offset = self.open(copies), 0
        for length in lengths:
            self.put(length, 1, sequence, copies, offset)
            offset += length


def dominating(length: int, counts: dict[int, int], lengths: list[int], capacity: int) -> list[int] | None:
    """Other lengths that, with `length`, dominate every feasible set with it, if at most two do; lengths are sorted and present.

    A set dominates another if its pieces can take the place of the other's, each that of one or several with no larger sum: what
    an optimal packing puts beside the piece can then be exchanged without a further sequence.
    """
    room = capacity - length
    left = lambda k: counts[k] - (k == length)
    least: list[int] = []
    for k in lengths:
        least += [k] * min(3 - len(least), left(k))
        if len(least) == 3:
            break
    if not least or least[0] > room:
        return []
    if counts.get(room, 0) - (room == length) > 0:
        return [room]
    at = bisect.bisect_right(lengths, room) - 1
    while not left(lengths[at]):
        at -= 1
    largest = lengths[at]
    if len(least) < 2 or least[0] + least[1] > room:
        return [largest]
    if len(least) == 3 and sum(least) <= room:
        return None
    # one or two pieces fit beside it: the pairs with the largest sum and with the largest smaller piece
    fits = [k for k in lengths[: at + 1] if left(k)]
    most = lower = 0
    i, j = 0, len(fits) - 1
    while i <= j:
        if fits[i] + fits[j] > room or i == j and left(fits[i]) < 2:
            j -= 1
            continue
        most, lower = max(most, fits[i] + fits[j]), max(lower, fits[i])
        i += 1
    if most <= largest:
        return [largest]
    beside = [k for k in fits if k + largest <= room and left(k) - (k == largest) > 0]
    if beside and beside[-1] >= lower:
        return [largest, beside[-1]]
    return None


def reduced(counts: dict[int, int], plan: Plan) -> dict[int, int]:
    """What is left of counts (length -> number) after all dominating sets are fixed in plan."""
    counts = {k: n for k, n in counts.items() if n}
    capacity = plan.capacity
    for k in sorted(counts, reverse=True):  # pairs that fill a sequence dominate for any piece
        other = capacity - k
        if 2 * k > capacity and other in counts and k in counts:
            copies = min(counts[k], counts[other])
        elif 2 * k == capacity:
            copies = counts[k] // 2
        else:
            continue
        if copies:
            plan.fixed([k, other], copies)
            _take(counts, [k, other], copies)
    lengths, found = sorted(counts), True
    while found:
        found = False
        for k in sorted(counts, reverse=True):
            while k in counts:
                beside = dominating(k, counts, lengths, capacity)
                if beside is None:
                    break
                found = True
                together = [k, *beside]
                # while the same pieces are there the same set dominates; the last copies, where fewer pieces may fit, are looked at anew
                copies = min(counts[x] // together.count(x) for x in together)
                plan.fixed(together, copies)
                _take(counts, together, copies)
                lengths = [x for x in lengths if x in counts]
    return counts


def _take(counts: dict[int, int], together: list[int], copies: int) -> None:
    for x in together:
        counts[x] -= copies
        if not counts[x]:
            del counts[x]


def best_fit(counts: dict[int, int], plan: Plan) -> None:
    """Packs the rest longest first, each piece where the least room is left, many copies at once."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, copies)

    def add(room: int, sequence: int, copies: int) -> None:
        if room and copies:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((sequence, copies))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                sequence, copies = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room = plan.capacity
                each = room // length
                copies = -(-left // each)
                sequence = plan.open(copies)
            each, offset = room // length, plan.capacity - room
            full = min(copies, left // each)  # one that a piece went to has the least room for the next
            if full:
                plan.put(length, each, sequence, full, offset)
                add(room - each * length, sequence, full)
                left -= full * each
            if full < copies:
                some = min(each, left)
                if some:
                    plan.put(length, some, sequence + full, 1, offset)
                    add(room - some * length, sequence + full, 1)
                    left -= some
                    full += 1
                add(room, sequence + full, copies - full)


def packed(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """A plan for the pieces of a histogram."""
    plan = Plan(capacity)
    best_fit(reduced(counts, plan), plan)
    return plan


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (of document_pieces()) with their sequence_id and offset.

    A row a length goes to the driver (capacity rows at most), and the plan's slots, whose number depends on lengths and not
    on documents, are broadcast. Ties among pieces of a length go by doc_id, piece and digest. No documents, no rows.
    """
    found = checkpointed(found)
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    plan = packed(counts, capacity)
    slots = np.array(sorted(plan.slots), np.int64).reshape(-1, 5)
    held = found.sparkSession.sparkContext.broadcast(slots)
    ranked = running(found, ["length"], ["doc_id", "piece", "start", "ids_crc32"], {"_rank": None})
    schema = T.StructType([*found.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    own = len(found.columns)

    def run(batches):
        slots = held.value
        keys = slots[:, 0] << 48 | slots[:, 1]
        for batch in batches:
            length = batch.column(batch.schema.names.index("length")).to_numpy()
            rank = batch.column(own).to_numpy() - 1
            s = slots[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            over = rank - s[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], pa.array(s[:, 3] + over // s[:, 2]), pa.array(s[:, 4] + over % s[:, 2] * length)], names=schema.names)

    return ranked.select(*found.columns, "_rank").mapInArrow(run, schema)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(document_pieces(table(spark, sf_dir, "documents", "doc_id", "text")))
