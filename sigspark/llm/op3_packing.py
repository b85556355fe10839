"""Best-fit packing by a plan over the length histogram.

Pieces of at most `limit` tokens are counted by length. Best-fit decreasing runs over these counts: bins that look the
same are one group with a multiplicity, so the plan's size depends on the limit alone (at most `limit` lengths), never
on the number of documents. Pieces then take planned slots by their rank within their length.

Defined results: a null or empty text is one piece of one token (the end id); repeated rows are packed each on their
own; ties in length are ordered by partition and row; an empty table gives no rows; extra columns are ignored. Very long
texts are cut into whole pieces of `limit` tokens, the last one shorter.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, text_of, texts_as_bytes, written
from .encode import encoder

END = 1
#: Ranks are a row a task and length, so a file holds those of PARTS tasks (at most PARTS * limit rows on average), and no
#: more files than FILES are written for fewer tasks, whatever the session's number of shuffle partitions.
PARTS, FILES = 16, 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
SLOTS = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def plan(counts: dict[int, int], limit: int) -> dict[int, list[tuple[int, int, int]]]:
    """For each length its slots as runs (first rank, first sequence, offset): rank r of the run lies in sequence
    first sequence + r - first rank. Lengths fall; each goes to the fullest bins that still hold it."""
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> bins as (first sequence, number)
    free: list[int] = []  # the keys of room, ascending
    n_sequences = 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if not room[left]:
                bisect.insort(free, left)
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            at = bisect.bisect_left(free, length)
            if at < len(free):
                left = free[at]
                first, n = room[left].pop()
                if not room[left]:
                    del free[at]
            else:
                left, first, n = limit, n_sequences, -(-todo // (limit // length))
                n_sequences += n
            fits = left // length
            whole = min(n, todo // fits)
            for k in range(fits if whole else 0):
                slots[length].append((rank, first, limit - left + k * length))
                rank += whole
            put(left - fits * length, first, whole)
            todo -= whole * fits
            if whole < n and todo:  # one bin takes the last few
                few = min(todo, fits)
                for k in range(few):
                    slots[length].append((rank, first + whole, limit - left + k * length))
                    rank += 1
                todo -= few
                put(left - few * length, first + whole, 1)
                whole += 1
            put(left, first + whole, n - whole)
    return dict(slots)


def pieces(docs: DataFrame, limit: int, vocabulary: str | None) -> DataFrame:
    """Encoded pieces with their task and their rank among the task's pieces of the same length."""

    def kernel(batches):
        enc, part, seen = encoder(vocabulary), TaskContext.get().partitionId(), Counter()
        end = END.to_bytes(4, "little")
        for batch in small_batches(batches):
            docs_of, nth = [], []
            piece, start, length, crc = (array("q") for _ in range(4))
            for row, packed in enumerate(enc.encode(texts_as_bytes(batch.column(1)))):
                packed += end
                for k, at in enumerate(range(0, len(packed), 4 * limit)):
                    own = packed[at : at + 4 * limit]
                    n = len(own) // 4
                    docs_of.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(own))
                    nth.append(seen[n])
                    seen[n] += 1
            own = lambda x: pa.array(np.frombuffer(x, np.int64) if len(x) else np.empty(0, np.int64))
            columns = [batch.column(0).take(pa.array(docs_of, pa.int64())), own(piece).cast(pa.int32()), own(start), own(length), own(crc), pa.array(np.full(len(docs_of), part, np.int32)), pa.array(nth, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(kernel, PIECES)


def pack(docs: DataFrame, limit: int = 4096, vocabulary: str | None = None) -> DataFrame:
    """Packs documents (doc_id, text) into sequences of at most `limit` tokens. See the module's text for edge cases."""
    cut = written(pieces(docs, limit, vocabulary), "pieces")
    by_part = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    few = max(FILES, len(cut.inputFiles()) // PARTS)  # each task has written one file of pieces
    before = written(before.select("part", "length", F.coalesce("before", F.lit(0)).alias("before"), "n").coalesce(few), "ranks")
    # At most `limit` rows come to the driver, whatever the number of documents.
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    packed = {k: np.array(sorted(v), dtype=np.int64).T.copy() for k, v in plan(counts, limit).items()}
    slots = docs.sparkSession.sparkContext.broadcast(packed)  # bounded by the limit, as the plan is

    def place(batches):
        table = slots.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, sequence, offset = table[int(length[own[0]])]
                run = np.searchsorted(first, rank[own], "right") - 1
                seq[own], off[own] = sequence[run] + rank[own] - first[run], offset[run]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(before.drop("n"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, SLOTS)
