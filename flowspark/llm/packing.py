"""Best-fit packing of documents into sequences of a fixed length.

Bulk-synchronous best fit over classes: all pieces of one length are a class,
and all sequences with one gap are a class.  Lengths and gaps are held sorted.
In one superstep the longest class left sweeps over its successor gaps (the
smallest that fit, then the next), all its pieces at once; pieces that compete
for the same gap class are served by rank, the gaps are updated, and what finds
no gap opens sequences.  Since there are at most ``size`` classes of lengths,
whatever the number of documents, the sweeps need only their counts, a table
with a proven bound; the outcome is a list of rank intervals, and every piece
finds its place by its length and its rank within it.  Ranks come from a
distributed count in two levels, so a hot length is in no single task.

Defined results: a null or empty text has just the end id; pieces longer than
``size`` do not occur; full pieces have sequences of their own; repeated rows
are packed each for itself; null ids are kept; an empty table gives an empty
result; input columns other than id and text are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_sum, settle, spread
from .tokens import encoder, with_end
from .words import chunks, text_buffer


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Intervals (length, rank from, rank to, first sequence, offset) by best fit: the piece of rank r goes to sequence first + r - from."""
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs (first sequence, how many)
    order: list[int] = []
    opened = 0

    def give(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(order, length)
            if at < len(order):
                gap = order[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            else:
                gap, first = size, opened
                n = -(-left // (size // length))
                opened += n
            each = gap // length
            full = min(n, left // each)  # sequences that take as many as fit
            for j in range(each if full else 0):
                out.append((length, rank, rank + full, first, size - gap + j * length))
                rank += full
            left -= full * each
            give(gap - each * length, first, full)
            if full < n:
                if left:  # fewer than ``each`` are left: one sequence takes them
                    for j in range(left):
                        out.append((length, rank, rank + 1, first + full, size - gap + j * length))
                        rank += 1
                    give(gap - left * length, first + full, 1)
                    full, left = full + 1, 0
                give(gap, first + full, n - full)
    return out


def token_pieces(docs: DataFrame, path: str, end_id: int = 0, size: int = 2048, cut: str = "word", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (id, piece, start, length, ids_crc32, and a salt) of all texts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut_up(batches):
        coder = encoder(path, cut)
        for b in chunks(batches, keep=True):
            ids, counts = with_end(*coder.encode(*text_buffer(b.column(1))), end_id)
            raw = memoryview(ids.astype("<u4").tobytes())
            pieces = -(-counts // size)
            row = np.repeat(np.arange(len(counts)), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = number * size
            length = np.minimum(size, counts[row] - start)
            place = (np.cumsum(counts) - counts)[row] + start
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(place.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.arange(len(row)) % 1024)], ["id", "piece", "start", "length", "ids_crc32", "salt"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut_up, f"id {kind}, piece int, start long, length long, ids_crc32 long, salt long")


def pack(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """``pieces`` (a settled table with ``length``, 1 to ``size``, and ``salt``, which spreads equal pieces) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset", "salt")]
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``size`` rows
    places = plan(counts, size)
    table = spark.createDataFrame(places or [(0, 0, 0, 0, 0)], "_len long, _from long, _to long, _first long, offset long")
    n = spread(sum(counts.values()), 20_000, 16)
    rows = pieces.withColumn("_b", F.pmod(F.xxhash64(*keep, "salt"), F.lit(n)).cast("long"))
    ranked = running_sum(rows.withColumn("_one", F.lit(1)), ["length"], "_b", keep, "_one", "_rank").withColumn("_rank", F.col("_rank") - 1)
    table = F.broadcast(table)  # some intervals for each pair of a length and a gap: at most size x size, whatever the input
    fits = (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    return ranked.join(table, fits).select(*keep, (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, size: int = 2048, id_col: str = "doc_id", **options) -> DataFrame:
    return pack(settle(token_pieces(docs, path, size=size, id_col=id_col, **options)), size).withColumnRenamed("id", id_col)
