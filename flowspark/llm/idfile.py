"""Token ids in files: an adaptive context-mixing range coder over blocks.

A segment is one file image::

    b"FTOK" version:u8 | body crc32:u32 | sizes:7*u32 | directory | model | blocks

The directory (deflated) has each document's id and number of ids.  The model
holds the order-0 counts of the segment, scaled to 2^16 in all.  Each block has
its number of ids, of 16-bit digits, the crc32 of its ids, and its digits.

Every block starts from a reset state, so blocks are coded and decoded in
lockstep, one numpy lane for each.  For each id a block mixes three
predictions: the id last seen after the two ids before (order 2), the one last
seen after the id before (order 1), and the order-0 counts.  The shares of the
code range that orders 2 and 1 get adapt to how often they were right so far
at their present confidence; an id that neither foresaw is coded by order 0.
Order 0 holds up to 2^16 distinct ids.  In a segment with more it holds the
most frequent 2^15 and an escape, after which an id follows as two plain digits.

The segments are rows of a Parquet table, so that any store Spark can write
holds them, and Spark's commit protocol covers lost executors.

Defined results: a null or empty text has only the end id; documents come in
ascending id order, nulls first, equal ids by text hash; an empty table gives
an empty folder of segments and an empty result; input columns other than id
and text are ignored.  A damaged segment raises ``ValueError``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import spread
from .tokens import Encoder, encoder, with_end
from .words import chunks, text_buffer

MAGIC = b"FTOK\x02"
BLOCK = 512
SLOTS_LOG = 8
SLOTS = 1 << SLOTS_LOG
TOP = 1 << 16
#: Ends the symbols of a model that does not hold all ids of its segment; no id.
ESCAPE = (1 << 32) - 1
_SHIFT = np.uint32(32 - SLOTS_LOG)
_U = np.uint64
_16, _32, _48 = _U(16), _U(32), _U(48)
_SMALL, _LAST = _U(1 << 48), _U((1 << 32) - 1)


class _Model:
    """State of all lanes: predicted ids with their confidence by context, and the shares of orders 2 and 1 at each pair of confidences."""

    def __init__(self, lanes: int):
        self.base = np.arange(lanes, dtype=np.int64) * SLOTS
        self.t1, self.t2 = np.zeros(lanes * SLOTS, np.uint32), np.zeros(lanes * SLOTS, np.uint32)  # id << 2 | confidence
        self.side = np.arange(lanes, dtype=np.int64) * 16
        self.q2, self.q1 = np.full(lanes * 16, 8192, np.int32), np.full(lanes * 16, 4096, np.int32)
        self.a = self.b = np.zeros(lanes, np.uint32)

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids that orders 2 and 1 foresee, and their shares of 2^16."""
        self.i1 = (self.a >> _SHIFT) + self.base
        self.i2 = (((self.a ^ self.b) * _K2) >> _SHIFT) + self.base
        self.e1, self.e2 = self.t1.take(self.i1), self.t2.take(self.i2)
        self.c1, self.c2 = self.e1 & _C, self.e2 & _C
        self.c = (self.c2 << _C2) + self.c1 + self.side
        self.s2, self.s1 = self.q2.take(self.c), self.q1.take(self.c)
        return self.e2 >> _C2, self.e1 >> _C2, self.s2, self.s1

    def update(self, ids: np.ndarray, right2: np.ndarray, right1: np.ndarray, good1: np.ndarray) -> None:
        """``good1``: order 1 was right, whether or not order 2 was, too."""
        self.q2[self.c] = self.s2 + ((np.where(right2, _MOST, _LEAST) - self.s2) >> 5)
        self.q1[self.c] = self.s1 + ((np.where(right1, _MOST, _LEAST) - self.s1) >> 5)
        own = ids << _C2
        for t, i, e, c, good in ((self.t1, self.i1, self.e1, self.c1, good1), (self.t2, self.i2, self.e2, self.c2, right2)):
            k = c << _C2
            k += good.view(np.uint8) * _C2
            v = np.where(k, e, own)  # an id stays unless it was wrong at confidence 0
            v &= ~_C
            np.right_shift(_NEXT, k, out=k)
            k &= _C
            v |= k
            t[i] = v
        self.b = (self.a >> np.uint32(5)) * _K3
        self.a = ids * _K1


#: The next confidence in two bits each, by confidence (0 to 3), doubled, plus whether the id was right.
_NEXT = np.uint32(sum(n << 2 * k for k, n in enumerate((0, 1, 0, 2, 1, 3, 2, 3))))
_C, _C2 = np.uint32(3), np.uint32(2)
_K1, _K2, _K3 = np.uint32(0x9E3779B1), np.uint32(0xC2B2AE35), np.uint32(0x85EBCA6B)
#: Between these the shares stay, so that order 0 always has one.
_MOST, _LEAST = np.int32(TOP - 512), np.int32(64)
_TOP = np.uint64(TOP)


def _scaled(counts: np.ndarray) -> np.ndarray:
    """At most 2^16 counts scaled to 2^16 in all, 1 at least where there are any."""
    f = np.maximum(counts * TOP // counts.sum(), 1)
    over = int(f.sum()) - TOP
    order = np.argsort(-f, kind="stable")
    for i in order if over > 0 else ():
        take = min(over, int(f[i]) - 1)
        f[i] -= take
        over -= take
        if not over:
            break
    f[order[0]] -= min(over, 0)
    return f


class _Coder:
    """64-bit range coder of shares of 2^32, in lanes; carries are added to the digits and settled at the end."""

    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
        self.rows = np.arange(lanes)
        self.out, self.at = np.zeros((lanes, steps * 2 + 6), np.uint32), np.ones(lanes, np.int64)  # digit 0 takes a last carry
        self.flat, self.first = self.out.reshape(-1), self.rows * self.out.shape[1]

    def put(self, n: int, start: np.ndarray, width: np.ndarray) -> None:
        """One step of the first ``n`` lanes."""
        low, rng = self.low[:n], self.range[:n]  # views
        rng >>= _32
        start *= rng
        low += start
        rng *= width
        self._settle(self.rows[:n], low, rng, low < start)

    def put_some(self, rows: np.ndarray, start: np.ndarray, width: np.ndarray) -> None:
        low, rng = self.low.take(rows), self.range.take(rows)
        rng >>= _32
        start = start * rng
        low += start
        rng *= width
        self._settle(rows, low, rng, low < start)
        self.low[rows], self.range[rows] = low, rng

    def _settle(self, rows: np.ndarray, low: np.ndarray, rng: np.ndarray, over: np.ndarray) -> None:
        if len(r := rows[over]):
            self.flat[self.first[r] + self.at[r] - 1] += np.uint32(1)
        small = np.flatnonzero(rng < _SMALL)
        while len(small):  # twice at most
            s, x = rows.take(small), low.take(small)
            at = self.at.take(s)
            self.flat[self.first.take(s) + at] = x >> _48
            self.at[s] = at + 1
            low[small] = x << _16
            r = rng.take(small) << _16
            rng[small] = r
            small = small[r < _SMALL]

    def finish(self) -> list[bytes]:
        lanes = np.arange(len(self.low))
        for k in (48, 32, 16, 0):
            self.out[lanes, self.at] = ((self.low >> _U(k)) & _U(0xFFFF)).astype(np.uint32)
            self.at += 1
        out = self.out[:, : int(self.at.max(initial=1))]  # about half: a step rarely fills the two digits that it may
        while (c := out[:, 1:] >> np.uint32(16)).any():
            out[:, :-1] += c
            out[:, 1:] &= np.uint32(0xFFFF)
        digits = out.astype("<u2")
        return [digits[k, 1:n].tobytes() for k, n in enumerate(self.at.tolist())]


def _order0(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending symbols and their scaled counts."""
    symbols, tally = np.unique(ids, return_counts=True)
    if len(symbols) > TOP:
        often = np.sort(np.argsort(-tally, kind="stable")[: TOP // 2])
        symbols, tally = np.append(symbols[often], np.uint32(ESCAPE)), np.append(tally[often], len(ids) - tally[often].sum())
    return symbols, _scaled(tally) if len(symbols) else tally


def _blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids as lanes of ``BLOCK`` (the last padded), and the number in each."""
    n = -(-len(ids) // BLOCK)
    size = np.full(n, BLOCK)
    if n:
        size[-1] = len(ids) - BLOCK * (n - 1)
    lanes = np.zeros(n * BLOCK, np.uint32)
    lanes[: len(ids)] = ids
    return lanes.reshape(n, BLOCK), size


def encode_segment(ids: np.ndarray, counts: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """The file image of documents' ids (joined; ``counts`` for each document)."""
    known = np.fromiter((d is not None for d in doc_ids), bool, len(doc_ids))
    names = np.fromiter((d or 0 for d in doc_ids), "<i8", len(doc_ids))
    directory = zlib.compress(known.tobytes() + np.diff(names, prepend=0).astype("<i8").tobytes() + counts.astype("<u4").tobytes(), 6)
    symbols, freq = _order0(ids)
    escape = len(symbols) - 1 if len(symbols) and symbols[-1] == ESCAPE else -1
    known_ids = symbols[:escape] if escape >= 0 else symbols
    model = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    lanes, size = _blocks(ids)
    table = np.full(int(ids.max(initial=0)) + 1, max(escape, 0), np.int32)
    table[known_ids] = np.arange(len(known_ids))
    cum = (np.cumsum(freq) - freq).astype(np.uint64)
    freq = freq.astype(np.uint64)
    m, coder, steps = _Model(len(lanes)), _Coder(len(lanes), BLOCK * 2 if escape >= 0 else BLOCK), np.ascontiguousarray(lanes.T)
    for t in range(int(size.max()) if len(size) else 0):
        x = steps[t]
        k = table.take(x)
        p2, p1, s2, s1 = m.predict()
        right2, good1 = p2 == x, p1 == x
        right1 = good1 & ~right2
        both = (s2 + s1).astype(np.uint64)
        left = _TOP - both
        start, width = cum.take(k), freq.take(k)
        start *= left
        both <<= _16
        start += both
        width *= left
        for right, before, own in ((right1, s2, s1), (right2, None, s2)):
            hit = np.flatnonzero(right)
            start[hit] = before.take(hit).astype(np.uint64) << _16 if before is not None else _U(0)
            width[hit] = own.take(hit).astype(np.uint64) << _16
        n = len(size) - (t >= size[-1])
        coder.put(n, start[:n], width[:n])
        if escape >= 0 and len(rare := np.flatnonzero((k == escape)[:n] & ~(right2 | right1)[:n])):
            plain = x.take(rare).astype(np.uint64)
            for digit in (plain >> _16, plain & _U(TOP - 1)):
                coder.put_some(rare, digit << _16, np.full(len(rare), TOP, np.uint64))
        m.update(x, right2, right1, good1)
    bodies = coder.finish() if len(lanes) else []
    head = np.array([(n, len(b) // 2, zlib.crc32(lane[:n].astype("<u4").tobytes())) for n, b, lane in zip(size.tolist(), bodies, lanes)], "<u4").tobytes()
    body = struct.pack("<7I", len(doc_ids), len(ids), len(lanes), len(directory), len(symbols), len(model), BLOCK) + directory + model + head + b"".join(bodies)
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


def decode_segment(image: bytes) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
    """Ids, counts and document ids of a file image."""
    body = image[9:]
    if image[:5] != MAGIC or len(image) < 37 or struct.unpack("<I", image[5:9])[0] != zlib.crc32(body):
        raise ValueError("not a token file, or a damaged one")
    docs, total, n, len_dir, kinds, len_model, block = struct.unpack("<7I", body[:28])
    at = 28
    raw = zlib.decompress(body[at : at + len_dir])
    known, names, counts = np.frombuffer(raw, bool, docs), np.cumsum(np.frombuffer(raw, "<i8", docs, docs)), np.frombuffer(raw, "<u4", docs, 9 * docs).astype(np.int64)
    at += len_dir
    raw = zlib.decompress(body[at : at + len_model])
    symbols, freq = np.cumsum(np.frombuffer(raw, "<u4", kinds)).astype(np.uint32), np.frombuffer(raw, "<u4", kinds, 4 * kinds).astype(np.uint64)
    at += len_model
    head = np.frombuffer(body, "<u4", 3 * n, at).reshape(n, 3).astype(np.int64)
    at += 12 * n
    digits = np.zeros((n, int(head[:, 1].max(initial=0)) + 6), np.uint16)
    for k in range(n):
        digits[k, : head[k, 1]] = np.frombuffer(body, "<u2", head[k, 1], at)
        at += 2 * int(head[k, 1])
    cum = np.cumsum(freq) - freq
    escape = kinds - 1 if kinds and symbols[-1] == ESCAPE else -1
    by_slot = np.repeat(np.arange(kinds, dtype=np.int32), freq.astype(np.int64))
    size = head[:, 0]
    code, rng = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
    for k in range(4):
        code = (code << _16) | digits[:, k]
    flat, pos = digits.reshape(-1), np.arange(n) * digits.shape[1] + 4
    m, out = _Model(n), np.zeros((block, n), np.uint32)

    def refill(c, w, rows=None):
        small = np.flatnonzero(w < _SMALL)
        while len(small):
            s = small if rows is None else rows.take(small)
            p = pos.take(s)
            c[small] = (c.take(small) << _16) | flat.take(p)
            pos[s] = p + 1
            r = w.take(small) << _16
            w[small] = r
            small = small[r < _SMALL]

    for t in range(int(size.max(initial=0))):
        p2, p1, s2, s1 = m.predict()
        live = n - (t >= size[-1])
        c, r = code[:live], rng[:live]  # views
        r >>= _32
        v = np.minimum(c // r, _LAST)
        both = (s2 + s1)[:live].astype(np.uint64)
        left = _TOP - both
        both <<= _16
        k = by_slot.take(((np.maximum(v, both) - both) // left).astype(np.int64))
        start, width, x = cum.take(k), freq.take(k), np.zeros(n, np.uint32)
        start *= left
        start += both
        width *= left
        x[:live] = symbols.take(k)
        a2 = s2[:live].astype(np.uint64) << _16
        right2 = np.zeros(n, bool)
        right1 = np.zeros(n, bool)
        np.less(v, a2, out=right2[:live])
        np.less(v, both, out=right1[:live])
        right1 ^= right2
        if live < n:  # the last lane is padded with 0
            right2[-1], right1[-1] = p2[-1] == 0, p2[-1] != 0 and p1[-1] == 0
        for right, before, own, p in ((right1[:live], a2, s1, p1), (right2[:live], None, s2, p2)):
            hit = np.flatnonzero(right)
            start[hit] = before.take(hit) if before is not None else _U(0)
            width[hit] = own.take(hit).astype(np.uint64) << _16
            x[hit] = p.take(hit)
        start *= r
        c -= start
        r *= width
        refill(c, r)
        if escape >= 0 and len(rare := np.flatnonzero((k == escape) & ~(right2 | right1)[:live])):
            cr, rr, plain = c.take(rare), r.take(rare), np.zeros(len(rare), np.uint64)
            for _ in range(2):
                rr >>= _32
                digit = np.minimum(cr // rr, _LAST) >> _16
                cr -= rr * (digit << _16)
                rr <<= _16
                refill(cr, rr, rare)
                plain = (plain << _16) | digit
            c[rare], r[rare], x[rare] = cr, rr, plain
        out[t] = x
        m.update(x, right2, right1, p1 == x)
    lanes = np.ascontiguousarray(out.T).astype("<u4", copy=False)
    for k in range(n):
        if zlib.crc32(lanes[k, : size[k]]) != head[k, 2]:
            raise ValueError(f"block {k} is damaged")
    return lanes.reshape(-1)[:total] if n else np.zeros(0, np.uint32), counts, [int(d) if ok else None for ok, d in zip(known, names)]


def _segments(coder: Encoder, end_id: int, batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    ids, counts, names, held = [], [], [], 0
    for b in chunks(batches, keep=True):
        i, c = with_end(*coder.encode(*text_buffer(b.column(1))), end_id)
        ids.append(i.astype(np.uint32))
        counts.append(c)
        names += b.column(0).to_pylist()
        held += len(i)
        if held >= most:
            yield np.concatenate(ids), np.concatenate(counts), names
            ids, counts, names, held = [], [], [], 0
    if names:
        yield np.concatenate(ids), np.concatenate(counts), names


#: Parts of a set of files at most; beyond that each holds more segments.
MOST_PARTS = 10_000


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, cut: str = "byte", docs_per_part: int = 6_000, most: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts, in ascending id order, as segments of about ``most`` ids under ``path``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = min(spread(docs.count(), docs_per_part), MOST_PARTS)
    by = ["id", F.xxhash64("text")]
    apart = F.pmod(F.monotonically_increasing_id(), F.lit(1024))  # rows alike in id and text may go to several parts
    rows = rows.repartitionByRange(parts, *by, apart).sortWithinPartitions(*by) if parts > 1 else rows.coalesce(1).sortWithinPartitions(*by)

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, (ids, counts, names) in enumerate(_segments(encoder(tokenizer, cut), end_id, batches, most)):
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([k], pa.int32()), "n_docs": pa.array([len(names)], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "image": pa.array([encode_segment(ids, counts, names)], pa.binary())})

    rows.mapInArrow(write, "part int, number int, n_docs long, n_ids long, image binary").write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files under ``path``: ``doc_id``, ``start`` (ids before it), ``n_tokens``, ``ids_crc32``, and on request ``ids``."""
    schema = "part int, number int, n_docs long, n_ids long, image binary"
    files = spark.read.schema(schema).parquet(path)
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select(F.col("part").alias("_p"), F.col("number").alias("_n"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("base"))  # a row for millions of ids

    def read(batches):
        for b in batches:
            for image, at in zip(b.column(0), b.column(1).to_pylist()):
                ids, counts, names = decode_segment(image.as_py())
                end = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(end.tolist(), counts.tolist())]
                got = [pa.array(names, pa.int64()), pa.array(at + end - counts), pa.array(counts), pa.array(crc, pa.int64())]
                if with_ids:
                    got.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(got, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(got)])

    both = files.join(base, (F.col("part") == F.col("_p")) & (F.col("number") == F.col("_n")))
    return both.select("image", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
