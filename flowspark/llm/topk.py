"""Exact top-k by inner product, through distributed histogram selection.

Vectors are packed into blocks; every block of queries meets every block of
candidates through an equi-join on the query block (a broadcast where the
queries are small, a shuffle otherwise).  Each round scores everything again
with one matrix product a pair of blocks, and counts, for each query, all
scores by their next ``RADIX`` bits within the bin that is still open.  Summed
over all blocks, the counts tell the bin of the k-th value; after the last
round it is known exactly.  A final pass keeps what reaches it and breaks ties
by id.

Vectors whose components are so large that 64-bit products could overflow are
in blocks of their own, which are scored with unbounded integers.

Defined results: vectors that are null, or hold a null or a non-finite
component, and rows with a null id, take no part; only vectors of one length
are compared, and the product of empty ones is 0; a row is no candidate of its
own, but rows with its id are; queries with fewer than k candidates get all;
equal rows each count; an empty table gives an empty result; other columns are
ignored.  A score of the result beyond 64 bits raises ``OverflowError``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

RADIX = 12
#: Components from here on make a vector a large one.
LARGE = float(1 << 26)
#: Marks no score: scores are clipped to one more than this.
LEAST = np.iinfo(np.int64).min
_BLOCKS = "block long, dim int, n int, large boolean, most double, ids binary, own binary, rows binary"


def _block(number: int, dim: int, large: bool, ids: np.ndarray, own: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """``own``: block and place of each vector among the candidates, in 16 bytes."""
    return pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "dim": pa.array([dim], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "large": [large], "most": pa.array([float(np.abs(v).max(initial=0))]), "ids": [ids.astype("<i8").tobytes()], "own": [own.astype("<i8").tobytes()], "rows": [v.astype("<f8" if large else "<i4").tobytes()]})


def _unpacked(b: pa.RecordBatch, r: int, prefix: str = "") -> dict:
    row = {n: b.column(k)[r].as_py() for k, n in enumerate(b.schema.names) if n.startswith(prefix)}
    row = {n.removeprefix(prefix): v for n, v in row.items()}
    row["ids"], row["own"] = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["own"], "<i8").reshape(-1, 2)
    row["rows"] = np.frombuffer(row["rows"], "<f8" if row["large"] else "<i4").reshape(len(row["ids"]), row["dim"])
    return row


def _flushed(held: dict, number: int, each: int, dim: int, large: bool, fresh: bool):
    """Full blocks of what is held; ``fresh``: they are candidates, which get their places here."""
    parts = held.pop((dim, large))
    ids, own, x = (np.concatenate([p[k] for p in parts]) for k in range(3))
    for k in range(0, len(ids), each):
        i = ids[k : k + each]
        place = np.stack([np.full(len(i), number), np.arange(len(i))], axis=1) if fresh else own[k : k + each]
        yield _block(number, dim, large, i, place, x[k : k + each])
        number += 1


def _packed(df: DataFrame, id_col: str, vec_col: str, scale: int, each: int) -> DataFrame:
    """Blocks of at most ``each`` vectors of integers, of one length."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("id is not null and v is not null")

    def pack(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[tuple, list] = {}
        for b in batches:
            ids, v = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            flat = v.flatten().to_numpy(zero_copy_only=False)  # a null becomes nan
            start = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                given = flat[start[at][:, None] + np.arange(dim)] if dim else np.zeros((len(at), 0))
                whole = np.isfinite(given).all(axis=1)
                with np.errstate(over="ignore"):
                    x = np.floor(scale * given)
                top = np.abs(x).max(axis=1, initial=0)
                if np.isinf(top[whole]).any():
                    raise OverflowError(f"a component times {scale} is beyond what a double holds")
                for large, some in ((False, whole & (top < LARGE)), (True, whole & (top >= LARGE))):
                    if some.any():
                        held.setdefault((dim, large), []).append((ids[at[some]], np.zeros((int(some.sum()), 2)), x[some]))
                        if sum(len(p[0]) for p in held[dim, large]) >= each:
                            for out in _flushed(held, number, each, dim, large, True):
                                number += 1
                                yield out
        for dim, large in list(held):
            for out in _flushed(held, number, each, dim, large, True):
                number += 1
                yield out

    return rows.mapInArrow(pack, _BLOCKS)


def _queries(blocks: DataFrame, every: int, each: int) -> DataFrame:
    """The vectors of ``blocks`` with an id divisible by ``every``, in blocks of their own."""

    def pick(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[tuple, list] = {}
        for b in batches:
            for r in range(b.num_rows):
                c = _unpacked(b, r)
                some = c["ids"] % every == 0
                if some.any():
                    key = c["dim"], c["large"]
                    held.setdefault(key, []).append((c["ids"][some], c["own"][some], c["rows"][some]))
                    if sum(len(p[0]) for p in held[key]) >= each:
                        for out in _flushed(held, number, each, *key, False):
                            number += 1
                            yield out
        for key in list(held):
            for out in _flushed(held, number, each, *key, False):
                number += 1
                yield out

    return blocks.mapInArrow(pick, _BLOCKS)


def _scores(q: dict, c: dict) -> np.ndarray:
    """Inner products as integers, within 64 bits; a row's with itself is ``LEAST``."""
    bound = max(q["dim"], 1) * q["most"] * c["most"]
    if bound < 1 << 53:
        s = (q["rows"].astype(float) @ c["rows"].astype(float).T).astype(np.int64)
    elif bound < 1 << 62:
        s = q["rows"].astype(np.int64) @ c["rows"].astype(np.int64).T
    else:
        s = np.array([[min(max(sum(int(x) * int(y) for x, y in zip(a, b)), LEAST + 1), -LEAST - 1) for b in c["rows"]] for a in q["rows"]], np.int64).reshape(len(q["ids"]), len(c["ids"]))
    mine = np.flatnonzero(q["own"][:, 0] == c["own"][0, 0])
    s[mine, q["own"][mine, 1]] = LEAST
    return s


_SENT = ["block", "dim", "large", "most", "ids", "own", "rows"]


def _pairs(b: pa.RecordBatch):
    for r in range(b.num_rows):
        q = _unpacked(b, r, "q_")
        q |= {n: np.frombuffer(b.column(n)[r].as_py(), "<i8") for n in ("bin", "need") if n in b.schema.names}
        yield q, _unpacked(b, r, "c_")


def _counted(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often each pair of row and key occurs."""
    low = int(key.min())
    span = int(key.max()) - low + 1
    if span * (int(row.max()) + 1) <= 1 << 21:
        n = np.bincount(row * span + (key - low))
        at = np.flatnonzero(n)
        return at // span, at % span + low, n[at]
    pairs, n = np.unique(np.stack([row, key]), axis=1, return_counts=True)
    return pairs[0], pairs[1], n


def top_k(df: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = 512, block: int = 2048) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` for the queries, the rows with an id divisible by ``every``."""
    cand = settle(_packed(df, id_col, vec_col, scale, block))
    quer = settle(_queries(cand, every, query_block))
    wide = quer.groupBy("dim").agg(F.collect_list("block").alias("queries"))  # 8 bytes for ``query_block`` queries
    c = cand.select(*[F.col(n).alias("c_" + n) for n in _SENT]).join(wide, F.col("c_dim") == F.col("dim")).drop("dim").withColumn("q_block_of", F.explode("queries")).drop("queries")
    q = quer.select(*[F.col(n).alias("q_" + n) for n in _SENT])
    top = cand.agg(F.max(F.greatest(F.col("dim"), F.lit(1)) * F.col("most") * F.col("most"))).first()[0] or 0.0
    bits = 64 if top >= 2.0**62 else int(top).bit_length() + 1
    shifts = list(range(max(0, bits - RADIX), 0, -RADIX)) + [0]
    state = None

    def count(shift: int, last: int | None):
        def run(batches):
            for b in batches:
                for qr, ca in _pairs(b):
                    s = _scores(qr, ca)
                    seen = s > LEAST
                    if last is not None:
                        seen &= (s >> last == qr["bin"][:, None]) & (qr["need"] > 0)[:, None]
                    at, col = np.nonzero(seen)
                    if len(at):
                        pos, key, n = _counted(at, s[at, col] >> shift)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), qr["block"])), pa.array(pos, pa.int32()), pa.array(key), pa.array(n)], ["block", "pos", "bin", "n"])

        return run

    def met(state):
        from_q = q if state is None else q.join(state, F.col("q_block") == F.col("s_block")).drop("s_block")
        return c.join(from_q, F.col("q_block_of") == F.col("q_block")).drop("q_block_of")

    last = None
    for shift in shifts:
        seen = met(state).mapInArrow(count(shift, last), "block long, pos int, bin long, n long")
        seen = seen.groupBy("block", "pos", "bin").agg(F.sum("n").alias("n"))
        high = Window.partitionBy("block", "pos").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        seen = seen.withColumn("above", F.coalesce(F.sum("n").over(high), F.lit(0)))
        seen = seen.join(needs, ["block", "pos"]) if state is not None else seen.withColumn("need", F.lit(k).cast("long"))
        # The bin with the k-th value: the lowest that starts before the need is met.
        open_ = seen.filter("above < need").groupBy("block", "pos").agg(F.min(F.struct("bin", (F.col("need") - F.col("above")).alias("need"))).alias("s"))
        needs = settle(open_.select("block", "pos", "s.bin", "s.need"))
        packed = needs.groupBy("block").agg(F.collect_list(F.struct("pos", "bin", "need")).alias("s")).join(quer.select("block", "n"), "block")  # a block's queries
        state = packed.mapInArrow(_laid_out, "s_block long, bin binary, need binary")
        needs = needs.select("block", "pos", "need")
        last = shift

    def keep(batches):
        for b in batches:
            for qr, ca in _pairs(b):
                s, ids, own = _scores(qr, ca), ca["ids"], qr["ids"]
                at, col = np.nonzero((s >= qr["bin"][:, None]) & (s > LEAST) & (qr["need"] > 0)[:, None])
                if not len(at):
                    continue
                score = s[at, col]
                order = np.lexsort((ids[col], -score, at))
                at, col, score = at[order], col[order], score[order]
                first = np.searchsorted(at, at)
                few = np.arange(len(at)) - first < k  # no block holds more than k of the result
                at, col, score = at[few], col[few], score[few]
                if (np.abs(score.astype(float)) >= 2.0**63).any() or (score == LEAST + 1).any() or (score == -LEAST - 1).any():
                    raise OverflowError("a score of the result does not fit 64 bits")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), qr["block"])), pa.array(at, pa.int32()), pa.array(own[at]), pa.array(ids[col]), pa.array(score)], ["block", "pos", "query_id", "vec_id", "score"])

    got = met(state).mapInArrow(keep, "block long, pos int, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("block", "pos").orderBy(F.desc("score"), "vec_id"))
    return got.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _laid_out(batches):
    for b in batches:
        for block, s, n in zip(*(c.to_pylist() for c in b.columns)):
            lowest, need = np.full(n, LEAST), np.zeros(n, np.int64)
            for x in s:
                lowest[x["pos"]], need[x["pos"]] = x["bin"], x["need"]
            yield pa.RecordBatch.from_pydict({"s_block": pa.array([block], pa.int64()), "bin": [lowest.astype("<i8").tobytes()], "need": [need.astype("<i8").tobytes()]})
