"""Phrase collocations by dynamic itemset counting.

Documents are dealt into ``shards`` tables of like size, which are scanned in a
cycle.  Words are counted from the first step on; a phrase starts to be counted
at the step after both its subphrases (all but its last and all but its first
word) have been found ``least`` times, and is done after one full cycle, that
is, when every shard has been scanned once since.  So lengths are counted side
by side, and a phrase with a rare part is never counted.

A step is one Spark job: tasks split and hash the texts of a shard, look up
which phrases are active, and send distinct phrases with their counts to one
aggregation, which adds what earlier steps found.  What is active comes from a
table of ``cells`` bytes, a fixed size whatever the input: for each hash of
phrases the first stop at which one of them had reached ``least``.  Two phrases
of one cell can start a longer one early, which costs work but changes no
count, as every phrase is counted for one whole cycle from its own start.

Phrases are compared by 64-bit hashes of language and words; among 10^10
distinct phrases some three pairs may share one.

Defined results: a null text has no words; a null language is ``und``; repeated
rows count each for itself, whatever their ids; an empty table gives an empty
result; columns other than language and text are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, settle, settle_lean, shared_dir
from .tokens import UnitTable
from .words import KEPT, chunks, mix, span_hash, text_buffer

_CUT = np.zeros(256, bool)
_CUT[[*map(ord, ".,;:!?"), 10, 11, 12, 13]] = True
_GAP = _CUT.copy()
_GAP[[32, 9]] = True
_M = np.uint64(0x9E3779B97F4A7C15)
#: A cell of which no phrase has reached the threshold.
_NEVER = 255
_CHUNK = 4 << 20


class Grams:
    """Words of a chunk with their languages' hashes, and the hashes of phrases by length: ``h[n]``, ``ok[n]`` by first word."""

    def __init__(self, batch: pa.RecordBatch, longest: int):
        self.buf, offs = text_buffer(batch.column(1))
        n = len(self.buf)
        solid = np.zeros(n + 2, bool)
        np.logical_not(_GAP[self.buf], out=solid[1:-1])
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        self.start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
        self.end = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
        self.row = np.repeat(np.arange(batch.num_rows), np.diff(np.searchsorted(self.start, offs)))
        lbuf, loffs = text_buffer(batch.column(0))
        self.lang = mix(span_hash(lbuf, loffs[:-1], loffs[1:]) + _M) | np.uint64(1)
        marks = np.concatenate([np.flatnonzero(_CUT[self.buf]), offs])
        marks.sort(kind="stable")
        piece = np.searchsorted(marks, self.start, "right")
        joined = np.append(piece[1:] == piece[:-1], False) if len(piece) else np.zeros(0, bool)
        word = mix(span_hash(self.buf, self.start, self.end, lower=True) ^ (self.lang[self.row] * _M))
        word[word == 0] = 1  # 0 marks a free slot
        self.h, self.ok = {1: word}, {1: np.ones(len(word), bool)}
        for k in range(2, longest + 1):
            self.ok[k] = self.ok[k - 1] & np.roll(joined, 2 - k)
            if len(word):
                self.ok[k][max(0, len(word) - k + 1) :] = False
            self.h[k] = mix(self.h[k - 1] * _M + np.roll(word, 1 - k) + np.uint64(k))
            self.h[k][self.h[k] == 0] = 1


def _cell(h: np.ndarray, cells: int) -> np.ndarray:
    return (h & np.uint64(cells - 1)).astype(np.int64)


def _scan(reached, step: int, shards: int, longest: int, batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """(hash, length, begin, n): the phrases of a shard that are active in ``step``, each once for about ``most`` occurrences; length 0 for the words of a language."""
    since = _unpacked(reached)
    held: dict[tuple[int, int], list[np.ndarray]] = {}
    words: dict[int, int] = {}
    size = 0

    def counted():
        for (k, s), parts in held.items():
            h, n = _distinct(np.concatenate(parts))
            yield h, k, s, n
        if words:
            yield np.array(list(words), np.uint64), 0, 0, np.array(list(words.values()))

    def sent():
        for h, k, s, n in counted():
            for at in range(0, len(h), 100_000):
                part = slice(at, at + 100_000)
                m = len(h[part])
                yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), pa.array(np.full(m, k, np.int8)), pa.array(np.full(m, s, np.int16)), pa.array(n[part].astype(np.int64))], ["h", "length", "begin", "n"])
        held.clear()
        words.clear()

    for b in chunks(batches, limit=_CHUNK, keep=True):
        g = Grams(b, longest)
        if step < shards:
            langs, of = np.unique(g.lang, return_inverse=True)
            for lang, n in zip(langs.tolist(), np.bincount(of[g.row], minlength=len(langs)).tolist()):
                words[lang] = words.get(lang, 0) + n
            held.setdefault((1, 0), []).append(g.h[1])
            size += len(g.h[1])
        for k in range(2, longest + 1):
            if not k - 1 <= step < k * shards:
                continue
            at = np.flatnonzero(g.ok[k])
            part = g.h[k - 1]
            first, second = since.take(_cell(part.take(at), len(since))), since.take(_cell(part.take(at + 1), len(since)))
            begin = np.maximum(np.maximum(first, second).astype(np.int64) + 1, k - 1)  # a cell shared with shorter phrases may be reached sooner
            for s in range(max(k - 1, step - shards + 1), step + 1):
                mine = at[begin == s]
                if len(mine):
                    held.setdefault((k, s), []).append(g.h[k].take(mine))
                    size += len(mine)
        if size >= most:
            yield from sent()
            size = 0
    yield from sent()


def _packed(cells: np.ndarray) -> tuple[str, bytes, str, tuple]:
    """For a broadcast: most cells are alike, so little is sent."""
    return uuid.uuid4().hex, zlib.compress(cells.tobytes(), 1), cells.dtype.str, cells.shape


def _unpacked(sent) -> np.ndarray:
    """The cells, which a worker unpacks once for all its tasks."""
    tag, raw, kind, shape = sent.value
    if KEPT.get("cells", ("",))[0] != tag:
        KEPT["cells"] = (tag, np.frombuffer(zlib.decompress(raw), kind).reshape(shape))
    return KEPT["cells"][1]


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.sort(h)
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.diff(first, append=len(h))


def _bits(found: DataFrame, cells: int) -> np.ndarray:
    """For each cell, whether a hash ``h`` of ``found`` falls into it: one bitmap for each 32,768 cells, so of a fixed size."""
    cell = (F.col("h").bitwiseAND(F.lit(cells - 1)) + 1).alias("cell")
    rows = found.select(cell).groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    out = np.zeros(cells, bool)
    for r in rows.collect():
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
        at = (r["bucket"] - 1) * 32_768
        out[at : at + 32_768] = bits[: max(0, cells - at)]
    return out


def _dealt(docs: DataFrame, shards: int, lang_col: str, text_col: str) -> DataFrame:
    """Language and text, written as ``shards`` tables that can be read one by one."""
    path = f"{shared_dir(docs.sparkSession)}/flowspark/{uuid.uuid4().hex}"
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"))
    rows.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def frequent_phrases(dealt: DataFrame, least: int, longest: int, shards: int, cells: int) -> DataFrame:
    """``h``, ``length`` and ``n`` of all words and phrases with ``n`` of at least ``least``, and the words of each language (length 0)."""
    sc = dealt.sparkSession.sparkContext
    since = np.full(cells, _NEVER, np.uint8)
    before, open_, done = None, None, []
    for step in range(longest * shards):
        reached = sc.broadcast(_packed(since))
        rows = dealt.filter(F.col("shard") == step % shards).select("lang", "text")
        found = rows.mapInArrow(lambda batches, r=reached, s=step: _scan(r, s, shards, longest, batches), "h long, length byte, begin short, n long")
        if open_ is not None:
            found = found.unionByName(open_)
        found = settle_lean(found.groupBy("h", "length", "begin").agg(F.sum("n").alias("n")))
        if before is not None:
            forget(before)
        over = F.col("begin") + shards - 1 <= step
        done.append(settle(found.filter(over & ((F.col("n") >= least) | (F.col("length") == 0))).select("h", "length", "n")))
        before, open_ = found, found.filter(~over)
        if step + 1 < longest * shards:
            hit = _bits(found.filter((F.col("n") >= least) & F.col("length").between(1, longest - 1)), cells)
            since = np.where(hit & (since == _NEVER), np.uint8(step), since)
        reached.unpersist()
    forget(before)
    return settle(reduce(DataFrame.unionByName, done))


def _name(wanted, longest: int, batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Names (hash, language, words) of the phrases whose cells are in ``wanted``, and of the languages, once a task (or once for each ``most`` of them)."""
    cells = _unpacked(wanted)
    seen = UnitTable()
    for b in chunks(batches, limit=_CHUNK, keep=True):
        g = Grams(b, longest)
        langs, raw = b.column(0).to_pylist(), g.buf.tobytes()
        for k in range(1, longest + 1):
            if k == 1:  # the languages themselves
                h, at = np.unique(g.lang, return_index=True)
            else:
                at = np.flatnonzero(g.ok[k])
                for part in range(2):
                    at = at[cells[part].take(_cell(g.h[k].take(at) >> np.uint64(32 * part), cells.shape[1]))]
                h, first = np.unique(g.h[k].take(at), return_index=True)
                at = at[first]
            new = seen.find(h) < 0
            h, at = h[new], at[new]
            if not len(h):
                continue
            if seen.n + len(h) > most:
                seen = UnitTable()
            seen.add(h, np.zeros(len(h), np.int32), np.zeros(len(h), np.int32))
            if k == 1:
                lang, phrase = [langs[a] for a in at.tolist()], [None] * len(h)
            else:
                lang = [langs[r] for r in g.row.take(at).tolist()]
                words = [[raw[a:z].lower() for a, z in zip(g.start.take(at + j).tolist(), g.end.take(at + j).tolist())] for j in range(k)]
                phrase = list(map(b" ".join, zip(*words)))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(lang, pa.string()), pa.array(phrase, pa.binary()).cast(pa.string())], ["h", "lang", "phrase"])


def _parts(longest: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each phrase the hashes of the two parts of every cut, and of all shorter phrases inside it."""
    for b in batches:
        g = Grams(pa.RecordBatch.from_arrays([b.column(1), b.column(2)], ["lang", "text"]), longest)
        at = np.searchsorted(g.row, np.arange(b.num_rows))
        size = np.diff(np.append(at, len(g.row)))
        out: list[list] = [[[] for _ in range(b.num_rows)] for _ in range(3)]
        for k in range(2, longest + 1):
            rows = np.flatnonzero(size == k)
            first = at[rows]
            cuts = [[g.h[j].take(first) for j in range(1, k)], [g.h[k - j].take(first + j) for j in range(1, k)], [g.h[j].take(first + i) for j in range(2, k) for i in range(k - j + 1)]]
            for column, parts in zip(out, cuts):
                for r, x in zip(rows.tolist(), np.stack(parts, 1).view(np.int64).tolist() if parts and len(rows) else [[]] * len(rows)):
                    column[r] = x
        yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x, pa.list_(pa.int64())) for x in out]], [*b.schema.names, "left", "right", "inner"])


def _names(dealt: DataFrame, known: DataFrame, longest: int, shards: int, cells: int) -> DataFrame:
    """``known`` with language and words.  Each shard names what those before it have not, so nearly all come from the first."""
    sc, left, named = dealt.sparkSession.sparkContext, known.filter("length <> 1"), []
    for shard in range(shards):
        bits = [_bits(left.filter("length > 1").select(F.shiftright("h", 32 * part).alias("h")), cells) for part in range(2)]
        wanted = sc.broadcast(_packed(np.stack(bits)))
        rows = dealt.filter(F.col("shard") == shard).select("lang", "text").mapInArrow(lambda batches, w=wanted: _name(w, longest, batches), "h long, lang string, phrase string")
        named.append(settle_lean(rows.distinct().join(left, "h")))
        left = settle(left.join(named[-1].select("h"), "h", "left_anti"))
        wanted.unpersist()
    return reduce(DataFrame.unionByName, named)


def phrases(docs: DataFrame, least: int = 10, longest: int = 3, top: int = 2000, shards: int = 2, cells: int = 1 << 25, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each language.

    ``a``: occurrences of the phrase; ``l`` and ``r``: those of its two parts at
    its weakest cut; ``score``: floor(10^6 a a / (l r)) there; ``n``: words of the
    language.  A phrase goes if a longer one that has it inside is found at
    least half as often.
    """
    if not 2 <= longest or longest * shards >= _NEVER or cells & (cells - 1) or cells < 32_768:
        raise ValueError("longest, shards or cells")
    dealt = _dealt(docs, shards, lang_col, text_col)
    known = frequent_phrases(dealt, least, longest, shards, cells)
    named = _names(dealt, known, longest, shards, cells)
    parted = named.filter("length > 1").select("h", "lang", "phrase", "n")
    found = settle(parted.mapInArrow(lambda batches: _parts(longest, batches), "h long, lang string, phrase string, n long, left array<long>, right array<long>, inner array<long>"))
    # Cuts: both parts occur as often as the phrase at least, so they are known.
    part = known.filter("length > 0").select(F.col("h").alias("of"), F.col("n").alias("f"))
    cut = found.select("h", F.col("n").alias("a"), F.posexplode(F.arrays_zip("left", "right")).alias("k", "cut")).select("h", "a", "k", "cut.left", "cut.right")
    cut = cut.join(part, F.col("left") == F.col("of")).select("h", "a", "k", "right", F.col("f").alias("l"))
    cut = cut.join(part, F.col("right") == F.col("of")).select("h", "a", "k", "l", F.col("f").alias("r"))
    square, product = "cast(a as decimal(15,0)) * cast(a as decimal(15,0))", "cast(l as decimal(15,0)) * cast(r as decimal(15,0))"
    score = F.expr(f"(cast(1000000 as decimal(7,0)) * ({square})) div ({product})")  # exact
    worst = cut.withColumn("score", score).groupBy("h").agg(F.min(F.struct("score", "k", "l", "r")).alias("worst")).select(F.col("h").alias("of"), "worst.*")
    # Phrases inside longer ones.
    longer = found.select(F.explode("inner").alias("of"), F.col("n").alias("f")).groupBy("of").agg(F.max("f").alias("longer"))
    found = found.select("h", "lang", "phrase", F.col("n").alias("a")).join(longer, F.col("h") == F.col("of"), "left").drop("of")
    found = found.filter("longer is null or 100 * longer < 50 * a").drop("longer").join(worst, F.col("h") == F.col("of")).drop("of")
    # Ranks in two steps, so that a language is in one task with its best rows only.
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy(*best)
    found = found.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    words = named.filter("length = 0").select(F.col("lang").alias("_of"), F.col("n"))
    return found.join(words, F.col("lang") == F.col("_of")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
