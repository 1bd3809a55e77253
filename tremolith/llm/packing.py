"""Best-fit packing of token sequences, planned on the histogram of lengths.

One pass encodes the texts and cuts documents longer than ``room`` into pieces (the first may be shorter, all others are
full).  A task numbers its pieces and counts along how many of each length it has met before, so a piece's rank within its
length is that count plus the pieces of earlier tasks: no sort and no task holds the pieces of a common length.  Best fit
falling then runs on counts, at most ``room`` numbers on the driver: all pieces of a length go to bins of the least
sufficient rest, which are runs of sequence numbers, so a step takes or splits whole runs and the plan has a few rows a
length however many documents there are.  Pieces take the planned slots by a join on length and rank.

A null text is empty; every document, also an empty one, ends with ``end_id``.  Null and repeated ids are kept, each row
is a document of its own.  No documents give empty tables.  Only the id and text columns are read, so further columns may
have any name.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import text as T
from .stage import stage
from .token_output import encoder

#: Ids of the rows of one Arrow batch.
BATCH_IDS = 1 << 20
PIECES = "part int, place long, doc_id {id}, piece int, start long, length int, before long, ids binary"


@dataclass
class Packed:
    """``pieces`` (part, place, doc_id, piece, start, length, ids as little-endian unsigned 32-bit) and, by (part, place),
    ``slots`` (sequence_id, offset)."""
    pieces: DataFrame
    slots: DataFrame


def cut(counts: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, number in it and length of each piece."""
    pieces = -(-counts // room)
    doc = np.repeat(np.arange(len(counts)), pieces)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = counts - (pieces - 1) * room
    return doc, piece, np.where(piece == 0, first[doc], room)


def _cutter(path: str, end_id: int, room: int, schema: pa.Schema):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, place, met = encoder(path), TaskContext.get().partitionId(), 0, np.zeros(room + 1, np.int64)
        for batch in batches:
            at = 0
            for texts in T.slices(batch.column(1)):
                ids, counts = encode(texts)
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                doc, piece, length = cut(counts + 1, room)
                ends = np.cumsum(length)
                start = ends - length - (np.cumsum(counts + 1) - counts - 1)[doc]
                order = np.argsort(length, kind="stable")
                firsts = np.flatnonzero(np.diff(length[order], prepend=-1))
                run = np.empty(len(length), np.int64)
                run[order] = np.arange(len(length)) - np.repeat(firsts, np.diff(np.append(firsts, len(length))))
                before = met[length] + run
                met += np.bincount(length, minlength=room + 1)
                names = batch.column(0).slice(at, len(texts)).take(pa.array(doc))
                done = 0
                while done < len(length):
                    stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + BATCH_IDS, side="right")))
                    own, first = slice(done, stop), ends[done - 1] if done else 0
                    raw = pa.py_buffer(ids[first:ends[stop - 1]].tobytes())
                    offsets = np.concatenate([[0], 4 * (ends[own] - first)]).astype(np.int32)
                    binary = pa.Array.from_buffers(pa.binary(), stop - done, [None, pa.py_buffer(offsets.tobytes()), raw])
                    columns = [np.full(stop - done, part), np.arange(place + done, place + stop), names.slice(done, stop - done), piece[own], start[own], length[own], before[own], binary]
                    yield pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(f.type) for c, f in zip(columns, schema)], schema=schema)
                    done = stop
                place += len(length)
                at += len(texts)
            T.release()
    return task


def plan(counts: dict[int, int], room: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, lengths falling: rows (length, first rank, end rank, first sequence, pieces a sequence, offset).

    The pieces of a row fill sequences one after another from the first on, the last one perhaps not to the end.
    """
    rests: list[int] = []  # rests of open bins, rising
    runs: dict[int, list[tuple[int, int]]] = {}  # of each rest: first sequence and number of bins
    fresh, rows = 0, []

    def keep(rest: int, first: int, n: int) -> None:
        if rest and n:
            if rest not in runs:
                insort(rests, rest)
                runs[rest] = []
            runs[rest].append((first, n))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect_left(rests, length)
            if k < len(rests):
                rest = rests[k]
                first, n = runs[rest].pop()
                if not runs[rest]:
                    del runs[rest]
                    rests.pop(k)
            else:
                rest, first, n = room, fresh, -(-left // (room // length))
                fresh += n
            each = rest // length  # a bin that took one stays the best fit while it has room
            took = min(left, n * each)
            full, more = divmod(took, each)
            rows.append((length, rank, rank + took, first, each, room - rest))
            keep(rest - each * length, first, full)
            if more:
                keep(rest - more * length, first + full, 1)
            keep(rest, first + full + bool(more), n - full - bool(more))
            left, rank = left - took, rank + took
    return rows


def pack(docs: DataFrame, tokenizer: str, room: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> Packed:
    """Pieces of all documents, and their places in as few sequences of ``room`` ids as best fit needs."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    ddl = PIECES.format(id=dict(rows.dtypes)["d"])
    kind = spark.createDataFrame([], ddl).toArrow().schema.field("doc_id").type
    types = [pa.int32(), pa.int64(), kind, pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip([c.split()[0] for c in ddl.split(", ")], types)))
    pieces = stage(rows.mapInArrow(_cutter(tokenizer, end_id, room, schema), ddl), "packing-pieces")
    # at most `room` lengths, each with one row a task
    each = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    ahead = each.withColumn("ahead", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    counts = {r.length: r.n for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(plan(counts, room), "length int, low long, high long, first long, each long, place_at long")
    ranked = pieces.select("part", "place", "length", "before").join(ahead, ["length", "part"]).withColumn("rank", F.col("before") + F.col("ahead"))
    taken = ranked.join(F.broadcast(slots), "length").where("rank >= low and rank < high")  # a few rows a length, `room` lengths
    back = F.col("rank") - F.col("low")
    found = taken.select("part", "place", (F.col("first") + F.floor(back / F.col("each"))).cast("long").alias("sequence_id"),
                         (F.col("place_at") + F.pmod(back, F.col("each")) * F.col("length")).cast("long").alias("offset"))
    return Packed(pieces.drop("before"), stage(found, "packing-slots"))


def sequences(packed: Packed) -> DataFrame:
    """The packed sequences: ``sequence_id``, their ids, and for each piece in order doc_id, piece, start, offset and length."""
    both = packed.pieces.join(packed.slots, ["part", "place"])
    item = F.struct("offset", "doc_id", "piece", "start", "length", "ids")
    made = both.groupBy("sequence_id").agg(F.array_sort(F.collect_list(item), lambda a, b: (a["offset"] - b["offset"]).cast("int")).alias("p"))  # at most `room` ids
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    return made.select("sequence_id", joined.alias("ids"), F.transform("p", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["start"].alias("start"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("pieces"))
