"""BPE encoding and decoding by a table of distinct words.

Words are units of text that no token, merge or pattern of the tokenizer can
cross (:mod:`flowspark.llm.tokens`).  Encoding takes three steps:

1. Units are split off in Spark and counted; every distinct unit is encoded
   once, which gives the word table (unit, count, ids).
2. The table is joined back by position in the two ways of a skewed join: its
   frequent part, at most ``most_hot`` units of at most 15 bytes whatever the
   input, is broadcast and looked up where the texts are; a unit outside it is
   so rare that no join key is hot, and is joined with the rest of the table by
   a shuffle on the unit.
3. What a text asked for comes to it by the text's 128-bit digest and fills the
   gaps that the first lookup left.

Units are compared whole in both ways, so the ids are the tokenizer's own.
Decoding joins ids with the table of pieces, which the tokenizer bounds, and
joins the pieces' bytes; bytes that are not UTF-8 become U+FFFD.

Defined results: a null or empty text has no ids and decodes to an empty text;
special tokens' strings in a text are the special tokens; rows with null or
equal ids or equal texts are rows of their own; an empty table gives an empty
result; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle_lean
from .tokens import UnitTable, byte_letters, encoder
from .words import KEPT, chunks, mix, text_buffer

#: Units of at most so many bytes fit in a key of two 64-bit numbers, with their length.
SHORT = 15
_U = np.uint64


def unit_keys(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The units of at most ``SHORT`` bytes (their places), their bytes and length as two numbers, and a hash that is never 0."""
    size = end - start
    at = np.flatnonzero(size <= SHORT)
    size, first = size[at], start[at]
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    view = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    kept = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
    lo = view.take(first) & kept.take(np.minimum(size, 8))
    hi = view.take(first + 8) & kept.take(np.maximum(size - 8, 0))
    hi |= size.astype(np.uint64) << _U(56)
    return at, lo, hi, mix(lo ^ mix(hi)) | _U(1)


def _counted(names: list[bytes], n: np.ndarray, rest: Counter) -> pa.RecordBatch:
    units = pa.array([*names, *rest], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([units, pa.array([*n.tolist(), *rest.values()], pa.int64())], ["unit", "n"])


def _count(path: str, cut: str, batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Units of a task's texts with their counts; a unit comes once as long as there are no more than ``most``."""
    coder = encoder(path, cut)

    def fresh():
        return UnitTable(), [], np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), Counter()

    table, names, los, his, n, rest = fresh()
    for b in chunks(batches, keep=True):
        buf, offs = text_buffer(b.column(0))
        start, end = coder.units(buf, offs)
        if not len(start):
            continue
        raw = buf.tobytes()
        at, lo, hi, h = unit_keys(buf, start, end)
        odd = np.ones(len(start), bool)
        if len(at):
            new = np.flatnonzero(table.find(h) < 0)
            key, first = np.unique(h[new], return_index=True)
            first = new[first]
            table.add(key, np.arange(len(names), len(names) + len(key), dtype=np.int32), np.zeros(len(key), np.int32))
            names += [raw[a:z] for a, z in zip(start[at[first]].tolist(), end[at[first]].tolist())]
            los, his = np.concatenate([los, lo[first]]), np.concatenate([his, hi[first]])
            place = table.place.take(table.find(h))
            same = (los.take(place) == lo) & (his.take(place) == hi)  # else two units have one hash
            n = np.bincount(place[same], minlength=len(names)) + np.pad(n, (0, len(names) - len(n)))
            odd[at[same]] = False
        odd = np.flatnonzero(odd)
        rest.update(raw[a:z] for a, z in zip(start[odd].tolist(), end[odd].tolist()))
        if len(names) + len(rest) > most:
            yield _counted(names, n, rest)
            table, names, los, his, n, rest = fresh()
    if names or rest:
        yield _counted(names, n, rest)


def word_table(docs: DataFrame, path: str, cut: str = "byte", text_col: str = "text") -> DataFrame:
    """``unit``, its count ``n`` in all texts, and ``ids`` (little-endian unsigned 32-bit), one row for each distinct unit; settled."""
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(lambda batches: _count(path, cut, batches), "unit string, n long")

    def encode(batches):
        coder = encoder(path, cut)
        for b in chunks(batches, "unit", keep=True):
            ids = [np.array(x, "<u4").tobytes() for x in coder.ids_of(b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], ["unit", "n", "ids"])

    return settle_lean(rows.groupBy("unit").agg(F.sum("n").alias("n")).mapInArrow(encode, "unit string, n long, ids binary"))


class Hot:
    """The frequent units, as flat arrays; the lookup table is built by the worker that uses it.

    Their ids are held as ranks by frequency, most of which fit in a byte.
    """

    def __init__(self, units: pa.Array, ids: pa.Array, n: np.ndarray):
        order = pc.sort_indices(units)  # like units stand together, which packs well
        got = [np.frombuffer(x, "<u4") for x in ids.take(order).to_pylist()]
        size = np.fromiter(map(len, got), np.uint8, len(got))
        pool = np.concatenate([np.zeros(0, np.uint32), *got]).astype(np.int64)
        often = np.bincount(pool, weights=np.repeat(n[order.to_numpy()], size))
        self.tag, self.id_of = uuid.uuid4().hex, np.argsort(-often, kind="stable").astype(np.uint32)
        rank = np.empty(len(often), np.uint32)
        rank[self.id_of] = np.arange(len(often))
        self._set(*text_buffer(units.take(order)), size, rank[pool])

    def _set(self, buf: np.ndarray, offs: np.ndarray, size: np.ndarray, pool: np.ndarray) -> None:
        self.units, self.size, self.pool = (buf, offs), size.astype(np.int32), pool
        _, self.lo, self.hi, self.h = unit_keys(buf, offs[:-1], offs[1:])

    def __getstate__(self):
        buf, offs = self.units
        columns = [buf, np.diff(offs).astype(np.uint8), self.size.astype(np.uint8), self.pool, self.id_of]
        return self.tag, [(zlib.compress(c.tobytes()), c.dtype.str) for c in columns]

    def __setstate__(self, state):
        self.tag, columns = state
        buf, lengths, size, pool, self.id_of = (np.frombuffer(zlib.decompress(raw), kind) for raw, kind in columns)
        self._set(buf, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), size, pool)

    def table(self) -> UnitTable:
        t, first = UnitTable(), np.unique(self.h, return_index=True)[1]  # of two units with one hash, the second counts as not frequent
        t.add(self.h[first], first.astype(np.int32), self.size[first])
        return t


def pack_ranks(ranks: np.ndarray) -> bytes:
    """A byte for each rank, 255 for those of 255 and more, whose rests follow byte by byte."""
    rest = ranks[ranks >= 255] - np.uint32(255)
    return np.minimum(ranks, 255).astype(np.uint8).tobytes() + np.ascontiguousarray(rest.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack_ranks(raw: bytes, n: int) -> np.ndarray:
    ranks = np.frombuffer(raw, np.uint8, n).astype(np.uint32)
    rest = np.frombuffer(raw, np.uint8, len(raw) - n, n).reshape(4, -1).T
    ranks[ranks == 255] += np.ascontiguousarray(rest).view("<u4").reshape(-1)
    return ranks


def hot_units(table: DataFrame, most: int) -> tuple[Hot, DataFrame]:
    """The most frequent units, as many classes of like counts, from the top, as hold at most ``most`` units together; and the rest of the table."""
    class_ = F.floor(F.log2("n") * 16)
    fits = (F.octet_length("unit") <= SHORT) & (F.col("n") > 1) & (F.octet_length("ids") <= 4 * SHORT)
    sizes = table.filter(fits).groupBy(class_.alias("class")).agg(F.count(F.lit(1)).alias("units")).collect()  # at most 16 for each bit of a count
    least, total = 1 << 20, 0
    for r in sorted(sizes, key=lambda r: -r["class"]):
        total += r["units"]
        if total > most:
            break
        least = r["class"]
    often = fits & (class_ >= least)
    got = table.filter(often).select("unit", "ids", "n").toArrow()  # at most ``most`` rows of at most 75 bytes
    return Hot(got.column("unit").combine_chunks(), got.column("ids").combine_chunks(), got.column("n").to_numpy()), table.filter(~often)


def _looked_up(hot, path: str, cut: str, batches: Iterator[pa.RecordBatch]):
    """For each chunk with a ``text``: the batch, its bytes, the units' bounds, the bounds of units by row, and for each unit its place in ``hot`` or -1."""
    coder, known = encoder(path, cut), hot.value
    if KEPT.get("hot", ("",))[0] != known.tag:
        KEPT["hot"] = (known.tag, known.table())
    table = KEPT["hot"][1]
    for b in chunks(batches, keep=True):
        buf, offs = text_buffer(b.column(b.schema.get_field_index("text")))
        start, end = coder.units(buf, offs)
        place = np.full(len(start), -1, np.int64)
        if len(start):
            at, lo, hi, h = unit_keys(buf, start, end)
            slot = table.find(h)
            found = np.flatnonzero(slot >= 0)
            p = table.place.take(slot[found])
            same = (known.lo.take(p) == lo[found]) & (known.hi.take(p) == hi[found])
            place[at[found[same]]] = p[same]
        yield b, buf, start, end, offs, np.searchsorted(start, offs), place


def _key(raw: memoryview, salt: bytes = b"") -> bytes:
    return hashlib.blake2b(raw, digest_size=16, salt=salt).digest()


def _gaps(cuts: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The units that are not in the table, their rows, and their numbers within their rows."""
    rare = np.flatnonzero(place < 0)
    bounds = np.searchsorted(rare, cuts)
    size = np.diff(bounds)
    return rare, np.repeat(np.arange(len(size)), size), np.arange(len(rare)) - np.repeat(bounds[:-1], size)


def _asked(hot, path: str, cut: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key of the text, number of the gap, unit) for the units that are not in ``hot``."""
    for _, buf, start, end, offs, cuts, place in _looked_up(hot, path, cut, batches):
        raw = memoryview(buf.tobytes())
        rare, row, number = _gaps(cuts, place)
        keys = {k: _key(raw[offs[k] : offs[k + 1]]) for k in np.unique(row).tolist()}
        units = pa.array([bytes(raw[a:z]) for a, z in zip(start[rare].tolist(), end[rare].tolist())], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in row.tolist()], pa.binary()), pa.array(number, pa.int32()), units], ["key", "number", "unit"])


def _partly(hot, path: str, cut: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row: the ranks of its ids but for gaps (packed), their count, and after how many ids each gap is.  The key of a row without gaps is its own, so that no key is hot."""
    known, codec, rows = hot.value, pa.Codec("zstd", 3), 0
    begins = np.append(np.cumsum(known.size) - known.size, 0)
    sizes = np.append(known.size, 0).astype(np.int64)
    for b, buf, start, end, offs, cuts, place in _looked_up(hot, path, cut, batches):
        raw = memoryview(buf.tobytes())
        size = sizes.take(place)  # a gap, at the end of ``sizes``, is empty
        upto = np.concatenate([[0], np.cumsum(size)])
        ranks = known.pool[np.repeat(begins.take(place) - upto[:-1], size) + np.arange(upto[-1])]
        ends = upto[cuts]
        rare, row, _ = _gaps(cuts, place)
        gaps, bounds = (upto[rare] - ends[row]).astype("<u4"), np.searchsorted(row, np.arange(b.num_rows + 1))
        out = [], [], [], []
        for k in range(b.num_rows):
            rows += 1
            own, gap = ranks[ends[k] : ends[k + 1]], gaps[bounds[k] : bounds[k + 1]]
            packed = pack_ranks(own)
            salt = b"" if len(gap) else rows.to_bytes(16, "little")
            for column, x in zip(out, (_key(raw[offs[k] : offs[k + 1]], salt), codec.compress(packed, asbytes=True), (len(own), len(packed)), gap.tobytes())):
                column.append(x)
        keys, packed, n, gap = out
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(packed, pa.binary()), pa.array([x for x, _ in n], pa.int64()), pa.array([x for _, x in n], pa.int64()), pa.array(gap, pa.binary())], ["id", "key", "packed", "n", "bytes", "gaps"])


def _filled(hot, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec, id_of = pa.Codec("zstd", 3), hot.value.id_of
    for b in batches:
        out = []
        for packed, n, size, gaps, got in zip(*[b.column(k) for k in range(1, 6)]):
            ids = id_of[unpack_ranks(codec.decompress(packed.as_buffer(), size.as_py(), asbytes=True), n.as_py())]
            gaps = np.frombuffer(gaps.as_buffer(), "<u4").astype(np.int64)
            if len(gaps):
                told = dict(zip(got.values.field(0).to_pylist(), got.values.field(1).to_pylist()))
                parts = [np.frombuffer(told[k], "<u4") for k in range(len(gaps))]
                ids = np.insert(ids, np.repeat(gaps, [len(p) for p in parts]), np.concatenate(parts))
            out.append(ids.astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "ids"])


def bpe_encode(docs: DataFrame, path: str, cut: str = "byte", most_hot: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id and ``ids``, the text's token ids as little-endian unsigned 32-bit integers."""
    table = word_table(docs, path, cut, text_col)
    often, rest = hot_units(table, most_hot)
    hot = docs.sparkSession.sparkContext.broadcast(often)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    asked = rows.select("text").mapInArrow(lambda batches: _asked(hot, path, cut, batches), "key binary, number int, unit string")
    told = asked.join(rest.select("unit", "ids"), "unit").select(F.col("key").alias("asker"), "number", "ids").repartition("asker").groupBy("asker").agg(F.collect_set(F.struct("number", "ids")).alias("got"))
    partly = rows.mapInArrow(lambda batches: _partly(hot, path, cut, batches), f"id {kind}, key binary, packed binary, n long, bytes long, gaps binary")
    both = partly.join(told, F.col("key") == F.col("asker"), "left").select("id", "packed", "n", "bytes", "gaps", "got")
    return both.mapInArrow(lambda batches: _filled(hot, batches), f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all pieces, joined, and their bounds by id; ids without a piece have none."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    bytes_of = {c: b for b, c in byte_letters().items()}
    vocab = t.get_vocab(with_added_tokens=True)
    rows = [b""] * (max(vocab.values(), default=-1) + 1)
    for piece, k in vocab.items():
        rows[k] = bytes(bytes_of[c] for c in piece) if all(c in bytes_of for c in piece) else piece.encode()
    return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``encoded`` (id, ``ids`` as :func:`bpe_encode` gives them) with ``text``, for a tokenizer with byte-level pieces."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def decode(batches):
        key = ("pieces", path)
        if key not in KEPT:
            KEPT[key] = pieces(path)
        pool, bounds = KEPT[key]
        for b in batches:
            texts = []
            for x in b.column(1):
                ids = np.frombuffer(x.as_buffer(), "<u4").astype(np.int64)
                ids = ids[ids < len(bounds) - 1]
                size = bounds.take(ids + 1) - bounds.take(ids)
                upto = np.cumsum(size)
                raw = pool.take(np.repeat(bounds.take(ids) - (upto - size), size) + np.arange(size.sum()))
                texts.append(raw.tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["id", "ids", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), "ids")
    return rows.mapInArrow(decode, f"id {kind}, ids binary, text string").withColumnRenamed("id", id_col)
