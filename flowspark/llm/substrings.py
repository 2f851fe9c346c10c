"""Substring dedup: words covered by a repeat that an earlier document has.

Seed: of the ``n - k + 1`` grams of ``k`` words in each window of ``n`` words,
the least hash is its anchor (winnowing), so equal windows have equal anchors,
and about one word in five is one.  Anchors are dealt out by hash range and
joined there across documents.  Extend: an anchor carries prints of the
windows that reach from it to both sides; where they agree with those of a
smaller id, the repeat goes on, and runs of agreeing windows are the maximal
repeats of ``n`` words or more.  A last pass joins the runs with their texts.

Windows are equal if both their anchors (64 bits) and their prints (56 bits)
are; no pairs of documents are formed.

Before the shuffle each block of texts keeps, of windows that several of its
documents share, only those of the smallest id, and marks the others itself; a
passage in a third of all documents thus costs one entry a block.  A phrase
that very many documents continue each in its own way is a hot anchor: its
windows are dealt out by their prints, too, so that no task gets them all.
Which anchors are hot is counted on the documents of one in ``every`` id
hashes; at most ``most_hot`` are.  That decides only where windows meet, never
which do.

Defined results: a null or empty text has no words; null ids count as larger
than all others and as equal to each other; equal ids do not remove each
other's words; an empty table gives an empty result; input columns other than
id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, settle, spread
from .words import WS, Words, chunks, mix, release, text_buffer

#: Shuffle partitions at most; beyond it a partition holds several ranges, one after the other.
MOST_PARTS = 10_000
_U = np.uint64
_Q = _U(0xD6E8FEB86659FD93)


def windows(w: Words, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of ``n`` words: first word, place and hash of the anchor, and hash."""
    m = len(w.h) - n + 1
    if m <= 0:
        e = np.zeros(0, np.int64)
        return e, e, e.astype(np.uint64), e.astype(np.uint64)
    gram, whole = w.h[: len(w.h) - k + 1].copy(), None
    for j in range(1, n):
        if j == k:
            whole = gram[:m].copy()
        if j < k:
            gram *= _Q
            gram += w.h[j : j + len(gram)]
        else:
            whole *= _Q
            whole += w.h[j : j + m]
    gram = mix(gram)
    least, at = gram[:m].copy(), np.zeros(m, np.int64)
    for j in range(1, n - k + 1):
        less = gram[j : j + m] < least
        least[less] = gram[j : j + m][less]
        at[less] = j
    first = np.flatnonzero(np.arange(m) + n <= np.repeat(w.hi, w.counts)[:m])
    return first, first + at[first], least[first], mix(whole[first])


def _runs(doc: np.ndarray, at: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of consecutive ``at`` in one document begin, and their sizes; all are sorted."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    for s in same:
        new[1:] |= s[1:] != s[:-1]
    start = np.flatnonzero(new)
    return start, np.diff(start, append=len(at))


def _range(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


#: Bytes of a print that are sent.
PRINT = 7


def _narrow(x: np.ndarray) -> tuple[bytes, bytes]:
    """Non-negative numbers in the fewest bytes that hold them all (none for zeros), and a byte that tells how many."""
    if not x.any():
        return b"0", b""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(x) or int(x.max()) <= np.iinfo(k).max)
    return kind[2].encode(), x.astype(kind).tobytes()


def _load(ids, sub, at, size, anchor=None, prints=None) -> bytes:
    """Columns one after the other; ids as steps from one to the next where they ascend."""
    up = len(ids) > 0 and int(ids[0]) >= 0 and bool((ids[1:] >= ids[:-1]).all())
    cols = [_narrow(np.append(0, np.diff(ids))) if up else (b"r", ids.astype("<i8").tobytes()), _narrow(sub[:, 0]), _narrow(sub[:, 1]), _narrow(at), _narrow(size)]
    rest = () if anchor is None else (anchor.tobytes(), np.ascontiguousarray(prints.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PRINT]).tobytes())
    return b"".join((int(ids[0] if len(ids) else 0).to_bytes(8, "little", signed=True), *(k for k, _ in cols), *(c for _, c in cols), *rest))


def _unload(raw: bytes, n: int, wide: bool):
    """Ids, subs, starts and sizes of ``n`` runs, and without ``wide`` their anchors and the prints of their windows."""
    first, kinds, at = int.from_bytes(raw[:8], "little", signed=True), raw[8:13].decode(), 13

    def take(kind, m):
        nonlocal at
        if kind == "<u0":
            return np.zeros(m, np.uint8)
        got = np.frombuffer(raw, kind, m, at)
        at += got.nbytes
        return got

    ids = take("<i8", n) if kinds[0] == "r" else first + np.cumsum(take("<u" + kinds[0], n).astype(np.int64))
    sub = np.stack([take("<u" + kinds[k], n).astype(np.uint64) for k in (1, 2)], 1)
    start, size = take("<u" + kinds[3], n).astype(np.int64), take("<u" + kinds[4], n).astype(np.int64)
    if wide:
        return ids, sub, start, size
    anchor = take("<u8", n)
    prints = np.zeros((int(size.sum()), 8), np.uint8)
    prints[:, :PRINT] = take(np.uint8, PRINT * len(prints)).reshape(-1, PRINT)
    return ids, sub, start, size, anchor, prints.view("<u8").reshape(-1)


def _marked(w: Words, ids: np.ndarray, n: int, k: int):
    """Windows of a block (row, first word, anchor's place, anchor, print), and which of them a smaller id of the block has."""
    first, place, anchor, h = windows(w, n, k)
    row = w.doc_of()[first]
    order = np.argsort(h, kind="stable")
    hs, ds = h[order], ids[row[order]]
    group = np.flatnonzero(np.append(True, hs[1:] != hs[:-1])) if len(h) else np.zeros(0, np.int64)
    least = np.repeat(np.minimum.reduceat(ds, group), np.diff(group, append=len(hs))) if len(h) else ds
    repeat = np.zeros(len(h), bool)
    repeat[order] = ds > least
    return row, first, place, anchor, h, repeat


def _seeds(buckets: int, n: int, k: int, subs: bool, hot: np.ndarray):
    def run(batches):
        for b in chunks(batches, limit=4 << 20):  # the larger a block, the more of its repeats stay in it
            buf, offs = text_buffer(b.column(1))
            w = Words(buf, offs)
            ids = b.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            row, first, place, anchor, h, repeat = _marked(w, ids, n, k)
            if not len(first):
                continue
            sub = np.stack([b.column(k).to_numpy().view(np.uint64) for k in (2, 3)], 1) if subs else np.zeros((len(ids), 2), np.uint64)
            # Of windows with one hash, those of the smallest id go out; the rest are known to be repeats.
            out = []
            start, size = _runs(row[repeat], first[repeat])
            r, f = row[repeat][start], first[repeat][start]
            if len(start):
                out.append((int(h[0] % _U(buckets)), 1, _load(ids[r], sub[r], f - w.lo[r], size), len(start)))
            keep = ~repeat
            row, first, place, anchor, h = row[keep], first[keep], place[keep], anchor[keep], h[keep]
            spread_out = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor if len(hot) else np.zeros(len(anchor), bool)
            start, size = _runs(row, first, place, np.where(spread_out, np.arange(len(place)), -1))
            # Anchors are least hashes and crowd near 0: hashed again before they are dealt out.
            bucket = _range(mix(np.where(spread_out[start], anchor[start] ^ h[start], anchor[start]) + _Q), buckets)
            order = np.lexsort((ids[row[start]], bucket))
            start, size, bucket = start[order], size[order], bucket[order]
            total = np.cumsum(size) - size
            prints = h[np.repeat(start - total, size) + np.arange(int(size.sum()))]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
            ends = np.append(total, len(prints))
            for x, y in zip(cuts, np.append(cuts[1:], len(bucket)) if len(bucket) else []):
                s = start[x:y]
                r = row[s]
                out.append((int(bucket[x]), 0, _load(ids[r], sub[r], first[s] - w.lo[r], size[x:y], anchor[s], prints[ends[x] : ends[y]]), y - x))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], ["bucket", "kind", "n", "load"])

    return run


def _spans(ids, sub, start, size) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NULL_ID), *[pa.array(np.ascontiguousarray(sub[:, k]).view(np.int64)) for k in (0, 1)], pa.array(start, pa.int32()), pa.array(size, pa.int32())], ["id", "sub1", "sub2", "start", "size"])


def _grouped(anchor: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which windows with equal anchors and prints stand together, and where each such group begins."""
    key = mix(anchor ^ (prints * _Q))
    order = np.argsort(key)
    a, p = anchor[order], prints[order]
    other = (a[1:] != a[:-1]) | (p[1:] != p[:-1])
    if (other & (key[order[1:]] == key[order[:-1]])).any():  # two groups with one key
        order = np.lexsort((prints, anchor))
        a, p = anchor[order], prints[order]
        other = (a[1:] != a[:-1]) | (p[1:] != p[:-1])
    return order, np.flatnonzero(np.append(True, other))


def _joined(held: list) -> pa.RecordBatch | None:
    """Of the windows of one hash range, runs of those that an id smaller than their own has."""
    ids, sub, start, size, anchor, prints = (np.concatenate(x) for x in zip(*(_unload(load, n, False) for n, load in held)))
    held.clear()
    run = np.repeat(np.arange(len(ids), dtype=np.int32), size)
    order, group = _grouped(anchor[run], prints)
    doc = ids[run[order]]
    least = np.repeat(np.minimum.reduceat(doc, group), np.diff(group, append=len(doc)))
    hit = np.sort(order[doc > least])
    if not len(hit):
        return None
    r = run[hit]
    at = start[r] + hit - (np.cumsum(size) - size)[r]
    first, n = _runs(r, at)
    return _spans(ids[r[first]], sub[r[first]], at[first], n)


def _extend(batches):
    """Hash range after hash range: which windows an id smaller than their own has."""
    release()
    held: list = []
    now = None
    for b in batches:
        for bucket, kind, n, load in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3)):
            if kind:
                yield _spans(*_unload(load.as_py(), n, True))
                continue
            if bucket != now and held and (got := _joined(held)) is not None:
                yield got
            now = bucket
            held.append((n, load.as_py()))
    if held and (got := _joined(held)) is not None:
        yield got


def hot_anchors(docs: DataFrame, n: int, k: int, every: int = 64, least: int = 16, most_hot: int = 100_000) -> np.ndarray:
    """Anchors with at least ``least`` runs, and the ``most_hot``-th part of all runs, in the documents of one in ``every`` id hashes; ascending."""

    def count(batches):
        for b in chunks(batches):
            w = Words(*text_buffer(b.column(1)))
            row, first, place, anchor, _, repeat = _marked(w, b.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False), n, k)
            keep = ~repeat
            start, _ = _runs(row[keep], first[keep], place[keep])
            a, c = np.unique(anchor[keep][start], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c)], ["anchor", "n"])

    rows = docs.select("id", "text").filter(F.pmod(F.xxhash64(F.lit("hot"), "id"), F.lit(every)) == 0)
    seen = settle(rows.mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")))
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = seen.filter((F.col("n") >= least) & (F.col("n") * most_hot >= total)).select("anchor").collect()  # at most ``most_hot`` rows
    return np.sort(np.array([r.anchor for r in hot], np.int64).view(np.uint64))


def repeats(docs: DataFrame, n: int = 13, k: int = 5, docs_per_bucket: int = 1_000, hot_every: int = 64) -> DataFrame:
    """Runs (id, sub1, sub2, start, size) of windows, by their first words, that a smaller id has, too; ``docs`` has id (long), text, sub1 and sub2."""
    count, names = docs.count(), docs.filter("id is not null").select("id").distinct().count()
    buckets = spread(count, docs_per_bucket, 8)
    seeds = docs.select("id", "text", *(["sub1", "sub2"] if names < count else [])).mapInArrow(_seeds(buckets, n, k, names < count, hot_anchors(docs, n, k, hot_every)), "bucket int, kind int, n int, load binary")
    seeds = seeds.repartition(min(spread(buckets, 2, 4), MOST_PARTS), "bucket").sortWithinPartitions("bucket")
    return seeds.mapInArrow(_extend, "id long, sub1 long, sub2 long, start int, size int")


def substring_dedup(docs: DataFrame, n: int = 13, k: int = 5, id_col: str = "doc_id", text_col: str = "text", docs_per_bucket: int = 1_000, hot_every: int = 64) -> DataFrame:
    """Id, ``n_words``, ``n_removed`` and the ``text`` of the words that are kept, joined by one space."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    unique = rows.count() == rows.filter("id is not null").select("id").distinct().count()
    # Rows with one id are told apart by 128 bits of their texts; those with one text, too, have the same runs, which count once.
    zero = F.lit(0).cast("long")
    rows = rows.withColumns({"sub1": zero if unique else F.xxhash64("text"), "sub2": zero if unique else F.xxhash64(F.lit("row"), "text")})
    runs = (F.collect_list if unique else F.collect_set)(F.struct("start", "size"))
    found = repeats(rows, n, k, docs_per_bucket, hot_every).groupBy("id", "sub1", "sub2").agg(runs.alias("runs"))
    found = found.select(F.col("id").alias("_i"), F.col("sub1").alias("_s1"), F.col("sub2").alias("_s2"), "runs").hint("shuffle_hash")
    same = F.col("id").eqNullSafe(F.col("_i")) if not unique else F.col("id") == F.col("_i")
    both = rows.join(found, same & (F.col("sub1") == F.col("_s1")) & (F.col("sub2") == F.col("_s2")), "left").select("id", "text", "runs.start", "runs.size")

    def cut(batches):
        for b in chunks(batches):
            buf, offs = text_buffer(b.column(1))
            w = Words(buf, offs, hashed=False)
            step = np.zeros(len(w.start) + 1, np.int64)
            starts, sizes = b.column(2), b.column(3)
            of = np.repeat(np.arange(b.num_rows), starts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            at = w.lo[of] + starts.flatten().to_numpy(zero_copy_only=False)
            np.add.at(step, at, 1)
            np.add.at(step, at + sizes.flatten().to_numpy(zero_copy_only=False) - 1 + n, -1)
            gone = np.cumsum(step)[:-1] > 0
            total = np.append(0, np.cumsum(gone))
            # Bytes of the kept words, each with the byte after it as its space; none after a text's last byte.
            closes = np.zeros(len(buf) + 1, bool)
            closes[offs] = True
            edge = np.zeros(len(buf) + 2, np.int8)
            np.add.at(edge, w.start[~gone], 1)
            np.add.at(edge, np.where(closes[w.end], w.end, w.end + 1)[~gone], -1)
            keep = np.cumsum(edge, dtype=np.int8)[: len(buf)] > 0
            raw = np.where(WS[buf], np.uint8(32), buf)[keep].tobytes()
            tail = np.append(0, np.cumsum(keep))[offs].tolist()
            texts = [raw[x:y].rstrip(b" ").decode("utf-8", "replace") for x, y in zip(tail[:-1], tail[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w.counts, pa.int64()), pa.array(total[w.hi] - total[w.lo], pa.int64()), pa.array(texts, pa.string())], ["id", "n_words", "n_removed", "text"])

    return both.mapInArrow(cut, "id long, n_words long, n_removed long, text string").withColumnRenamed("id", id_col)
