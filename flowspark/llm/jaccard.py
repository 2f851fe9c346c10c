"""N-gram Jaccard join by vertical partitioning.

The global order of n-gram hashes is cut into fragments.  A document's set of
n-grams falls into one segment a fragment; in each fragment all segments meet,
the document frequencies of its n-grams are counted exactly, and n-grams that
no other set has are dropped.  What is left of a set, gathered again, tells
whether it can reach the similarity at all; if so, it offers its rarest n-grams
(as many as any similar partner must share one of).

Sets that offer one n-gram are a group.  A group of up to ``few`` sets proposes
all its pairs; a larger one only the pairs with its centre, the set with the
fewest n-grams of its own, so proposals grow with the offers.  Pairs whose
sizes, or numbers of n-grams that others have, rule a link out are dropped.
The rest are verified by fragments: each fragment counts the partial overlap of
a pair for itself, and the counts are summed for each pair.

A larger group whose sets the links so found all join has nothing left to find.
The others, joined where they share sets, are blocks: in a block every set that
is not of its main component meets all others, in tiles of bounded bytes, each
pair of tiles a task of its own that returns links of a spanning forest only.

Equal sets are one set from the start.  An n-gram that many documents of one
input block share is not sent document by document: its fragment gets one
count, and it ranks as the most frequent kind everywhere.

Sets and n-grams are known by 64-bit hashes.  Defined results: texts without
words have an empty set, link with nothing and are components of their own;
null ids are never a component's name unless all its ids are null; repeated
rows link; an empty table gives an empty result; input columns other than id
and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, spread
from .components import components
from .words import Words, chunks, gram_hash, mix, release, text_buffer

_U = np.uint64
_K = _U(0xA0761D6478BD642F)
HOT = 0xFFFF
FRAGMENT, SETS, ROWS = 0, 1, 2
#: Shuffle partitions at most; beyond it a partition holds several fragments, one after the other.
MOST_PARTS = 10_000
#: Fragments in which the overlaps of proposed pairs are counted.
PIECES = 4


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text (joined, ascending for each), the bounds, and the sets' hashes; a text of fewer than ``n`` words has all of them as one."""
    w = Words(buf, offs, lower=True)
    at, g = w.grams(n)
    doc = w.doc_of()[at]
    for short in range(1, n):
        few = np.flatnonzero(w.counts == short)
        if len(few):
            f, x = gram_hash(w.h, w.lo, w.hi, short)
            hit = np.searchsorted(f, w.lo[few])
            doc, g = np.concatenate([doc, few]), np.concatenate([g, x[hit]])
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    keep = np.append(True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])) if len(g) else np.zeros(0, bool)
    doc, g = doc[keep], g[keep]
    bounds = np.searchsorted(doc, np.arange(len(offs)))
    total = np.append(_U(0), np.cumsum(mix(g ^ _K)))
    return g, bounds, mix(total[bounds[1:]] - total[bounds[:-1]] + (np.diff(bounds).astype(np.uint64) * _K))


def _load(handles, sizes, counts, grams, extra=None) -> bytes:
    head = np.array([len(handles), len(grams)], "<u4")
    return b"".join(x.tobytes() for x in (head, handles, sizes.astype("<u4"), counts.astype("<u4"), grams, *(() if extra is None else (extra,))))


def _unload(raw: bytes, extra: bool = False):
    s, m = np.frombuffer(raw, "<u4", 2).tolist()
    at = 8
    handles = np.frombuffer(raw, "<u8", s, at)
    sizes, counts = np.frombuffer(raw, "<u4", s, at + 8 * s).astype(np.int64), np.frombuffer(raw, "<u4", s, at + 12 * s).astype(np.int64)
    grams = np.frombuffer(raw, "<u8", m, at + 16 * s)
    rest = at + 16 * s + 8 * m
    return (handles, sizes, counts, grams, np.frombuffer(raw, "<u2", m, rest)) if extra else (handles, sizes, counts, grams, np.frombuffer(raw, "<u8", offset=rest))


_FLOW = "kind int, bucket int, load binary, id long, n long, handle long"


def _flow(kind, bucket, load, ids=None, n=None, handles=None) -> pa.RecordBatch:
    m = len(bucket)
    none = pa.nulls(m, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind), pa.int32()), pa.array(bucket, pa.int32()), pa.array(load, pa.binary()), none if ids is None else ids, none if n is None else pa.array(n, pa.int64()), none if handles is None else pa.array(handles.view(np.int64))], ["kind", "bucket", "load", "id", "n", "handle"])


def _grouped(bucket: np.ndarray):
    """An order by bucket, and for each bucket its number and its slice of the order."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
    return [(int(b[x]), order[x:y]) for x, y in zip(cuts, np.append(cuts[1:], len(b)))]


def _segments_of(row: np.ndarray, g: np.ndarray, handle: np.ndarray, size: np.ndarray, extra=None, more=None) -> bytes:
    """A load of the n-grams ``g`` of sets ``row`` (ascending)."""
    start = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    sets = row[start]
    return _load(handle[sets], size[sets], np.diff(start, append=len(row)), g, extra if extra is not None else more)


def _cut(n: int, fragments: int, set_buckets: int):
    """Texts to segments by fragment, rows of documents, and hot n-grams by set."""

    def run(batches):
        for b in chunks(batches):
            buf, offs = text_buffer(b.column(1))
            g, bounds, handle = shingle_sets(buf, offs, n)
            size = np.diff(bounds)
            yield _flow(ROWS, np.arange(len(size)) % fragments, [None] * len(size), b.column(0), size, handle)
            _, first = np.unique(handle, return_index=True)  # equal sets go out once
            first = first[size[first] > 0]
            mine = np.zeros(len(size), bool)
            mine[first] = True
            row = np.repeat(np.arange(len(size)), size)
            keep = mine[row]
            row, g = row[keep], g[keep]
            if not len(g):
                continue
            u, back, df = np.unique(g, return_inverse=True, return_counts=True)
            hot = df >= max(16, len(first) // 16)
            is_hot = hot[back]
            notes = dict((f, u[hot][at]) for f, at in _grouped(_bucket(u[hot], fragments)))
            row_c, g_c = row[~is_hot], g[~is_hot]
            out, where = [], []
            seen = set()
            for f, at in _grouped(_bucket(g_c, fragments)):
                seen.add(f)
                where.append(f)
                out.append(_segments_of(row_c[at], g_c[at], handle, size, more=notes.get(f, np.zeros(0, np.uint64))))
            for f in notes.keys() - seen:
                where.append(f)
                out.append(_load(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), np.zeros(0, np.uint64), notes[f]))
            yield _flow(FRAGMENT, np.array(where), out)
            row_h, g_h = row[is_hot], g[is_hot]
            parts = _grouped(_bucket(handle[row_h], set_buckets))
            if parts:
                # They ride with a fragment, spread evenly, and pass through it.
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), SETS), pa.int32()), pa.array([p % fragments for p, _ in parts], pa.int32()), pa.array([_segments_of(row_h[at], g_h[at], handle, size, np.full(len(at), HOT, "<u2")) for _, at in parts], pa.binary()), pa.nulls(len(parts), pa.int64()), pa.array([p for p, _ in parts], pa.int64()), pa.nulls(len(parts), pa.int64())], ["kind", "bucket", "load", "id", "n", "handle"])

    return run


def _joined(loads: list, extra: bool = False):
    """Loads as one: set hashes, sizes, and for each n-gram its set's index, itself and the extra."""
    parts = [_unload(x, extra) for x in loads]
    handle, size, count, g, more = (np.concatenate(x) for x in zip(*parts))
    return handle, size, np.repeat(np.arange(len(handle)), count), g, more


def _in_turn(batches, pick=None):
    """The loads of each bucket (columns load, bucket; sorted by bucket), one bucket at a time; ``pick`` takes a batch first and may keep rows to itself."""
    held, now = [], None
    for b in batches:
        if pick is not None:
            rest, b = pick(b)
            if rest.num_rows:
                yield None, rest
        for load, bucket in zip(b.column(0), b.column(1).to_pylist()):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append(load.as_py())
    if held:
        yield now, held


def _count(set_buckets: int, slices: int = 4):
    """Fragment after fragment: exact frequencies; segments without the n-grams of one set only, by set bucket (in ``n``)."""

    def pick(b):
        kind = b.column(0).to_numpy(zero_copy_only=False)
        return b.take(pa.array(np.flatnonzero(kind != FRAGMENT))), b.take(pa.array(np.flatnonzero(kind == FRAGMENT))).select(["load", "bucket"])

    def run(batches):
        release()
        for f, loads in _in_turn(batches, pick):
            if f is None:
                yield loads
                continue
            handle, size, row, g, notes = _joined(loads)
            loads.clear()
            _, first = np.unique(handle, return_index=True)
            mine = np.zeros(len(handle), bool)
            mine[first] = True
            row = row.astype(np.int32)
            part = (g & _U(slices - 1)).astype(np.uint8)
            for k in range(slices):  # a slice of the fragment at a time, for less memory
                at = np.flatnonzero((part == k) & mine[row])
                if not len(at):
                    continue
                r, x = row[at], g[at]
                u, back, df = np.unique(x, return_inverse=True, return_counts=True)
                df = np.minimum(df, HOT - 1)
                df[np.isin(u, notes)] = HOT
                df = df.astype("<u2")[back]
                del u, back, at
                keep = df > 1
                r, x, df = r[keep], x[keep], df[keep]
                parts = _grouped(_bucket(handle[r], set_buckets))
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), SETS), pa.int32()), pa.array(np.full(len(parts), f), pa.int32()), pa.array([_segments_of(r[at], x[at], handle, size, df[at]) for _, at in parts], pa.binary()), pa.nulls(len(parts), pa.int64()), pa.array([p for p, _ in parts], pa.int64()), pa.nulls(len(parts), pa.int64())], ["kind", "bucket", "load", "id", "n", "handle"])
            release()

    return run


def _gather(num: int, den: int):
    """One bucket of sets after the other: those that can reach the similarity, with the n-grams they offer and all their shared n-grams, by fragment."""

    def run(batches):
        release()
        for _, loads in _in_turn(batches):
            handle, size, row, g, df = _joined(loads, True)
            loads.clear()
            key, of = np.unique(handle, return_inverse=True)
            size_of = np.zeros(len(key), np.int64)
            size_of[of] = size
            row = of[row]
            order = np.lexsort((-df.astype(np.int64), g, row))
            row, g, df = row[order], g[order], df[order]
            keep = np.append(True, (g[1:] != g[:-1]) | (row[1:] != row[:-1]))
            row, g, df = row[keep], g[keep], df[keep]
            bounds = np.searchsorted(row, np.arange(len(key) + 1))
            shared = np.diff(bounds)
            must = -(-num * size_of // den)  # of its own n-grams any partner must have
            live = np.flatnonzero(shared >= must)
            rank = np.lexsort((g, df, row))
            lead = [g[rank[bounds[i] : bounds[i] + shared[i] - must[i] + 1]] for i in live.tolist()]
            for a in range(0, len(live), 500):
                part = live[a : a + 500]
                cuts = [(bounds[i] + np.searchsorted(g[bounds[i] : bounds[i + 1]], _EDGES)).tolist() for i in part.tolist()]
                grams = [[g[x:y].tobytes() for x, y in zip([bounds[i], *c], [*c, bounds[i + 1]])] for i, c in zip(part.tolist(), cuts)]
                yield pa.RecordBatch.from_arrays([pa.array(key[part].view(np.int64)), pa.array(size_of[part]), pa.array(shared[part]), pa.array([x.view(np.int64) for x in lead[a : a + 500]], pa.list_(pa.int64())), pa.array(grams, pa.list_(pa.binary()))], ["handle", "n", "shared", "lead", "grams"])

    return run


#: Where the fragments of proposed pairs end.
_EDGES = np.array([k * (1 << 64) // PIECES for k in range(1, PIECES)], np.uint64)


def _partial(batches):
    """Overlaps of the pairs of one centre within one fragment: rows (v, salt, piece, role, u, n, grams), the centre's first."""
    key, centre = None, None
    for b in batches:
        keys = list(zip(*(b.column(k).to_pylist() for k in range(3))))
        role, u = b.column(3).to_pylist(), b.column(4).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(keys):
            to = at + 1
            while to < len(keys) and keys[to] == keys[at]:
                to += 1
            if keys[at] != key:
                key, centre = keys[at], np.frombuffer(b.column(5)[at].as_py(), "<u8")
                at += 1
                assert role[at - 1] == 0
            loads = [x.as_py() for x in b.column(5).slice(at, to - at)]
            if loads and len(centre):
                g = np.frombuffer(b"".join(loads), "<u8")
                hit = np.append(0, np.cumsum(centre[np.minimum(np.searchsorted(centre, g), len(centre) - 1)] == g))
                ends = np.cumsum([len(x) // 8 for x in loads])
                both = np.diff(hit[np.append(0, ends)])
                some = np.flatnonzero(both)
                yield pa.RecordBatch.from_arrays([pa.array(u[at:to][some]), pa.array(np.full(len(some), key[0])), pa.array(both[some])], ["u", "v", "both"])
            at = to


def overlaps(sets: list[np.ndarray], fragment: int = 4096) -> np.ndarray:
    """Sizes of all intersections: partial counts for each fragment of columns, summed."""
    m = len(sets)
    u, back, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    col = np.cumsum(df > 1) - 1
    keep = (df > 1)[back]
    row, col = row[keep], col[back[keep]]
    total = np.zeros((m, m), np.float32 if len(u) < 1 << 24 else np.float64)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for k in range(0, int((df > 1).sum()), fragment):
        x, y = np.searchsorted(col, [k, k + fragment])
        part = np.zeros((m, fragment), total.dtype)
        part[row[x:y], col[x:y] - k] = 1
        total += part @ part.T
    return total.astype(np.int64)


def linked(sets: list[np.ndarray], size: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least index that links reach from each set."""
    both = overlaps(sets)
    link = den * both >= num * (size[:, None] + size[None, :] - both)
    root, m = np.arange(len(sets)), len(sets)
    while True:
        new = np.minimum(root, np.where(link, root[None, :], m).min(1))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(num: int, den: int):
    def run(batches):
        key, handles, sizes, sets = None, [], [], []

        def done():
            if len(sets) > 1:
                h = np.array(handles, np.int64)
                order = np.argsort(h)
                root = linked([sets[i] for i in order], np.array(sizes)[order], num, den)
                off = np.flatnonzero(root != np.arange(len(root)))
                if len(off):
                    yield pa.RecordBatch.from_arrays([pa.array(h[order][off]), pa.array(h[order][root[off]])], ["u", "v"])

        for b in batches:
            for k0, k1, k2, h, n, g in zip(*(b.column(i).to_pylist() for i in range(5)), b.column(5)):
                if (k0, k1, k2) != key:
                    yield from done()
                    key, handles, sizes, sets = (k0, k1, k2), [], [], []
                handles.append(h)
                sizes.append(n)
                sets.append(np.frombuffer(g.as_py(), "<u8"))
        yield from done()

    return run


def _verified(active: DataFrame, pairs: DataFrame, num: int, den: int, each: int = 256) -> DataFrame:
    """Of the proposed ``pairs`` (u, v) those that reach the similarity."""
    parts = int(active.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    often = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / each).cast("int").alias("k"))
    sets = active.select("handle", F.posexplode("grams").alias("piece", "grams"))
    salt = F.pmod(F.xxhash64("u"), F.col("k")).cast("int").alias("salt")
    partners = pairs.join(often, "v").select("v", salt, "u").join(sets, F.col("u") == F.col("handle")).select("v", "salt", "piece", F.lit(1).alias("role"), "u", "grams")
    centres = often.join(sets, F.col("v") == F.col("handle")).select("v", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"), "piece", F.lit(0).alias("role"), F.col("v").alias("u"), "grams")
    rows = centres.union(partners).repartition(parts, "v", "salt", "piece").sortWithinPartitions("v", "salt", "piece", "role")
    both = rows.mapInArrow(_partial, "u long, v long, both long").groupBy("u", "v").agg(F.sum("both").alias("both"))
    size = active.select("handle", "n")
    sized = both.join(size.select(F.col("handle").alias("u"), F.col("n").alias("n_u")), "u").join(size.select(F.col("handle").alias("v"), F.col("n").alias("n_v")), "v")
    return sized.filter(den * F.col("both") >= num * (F.col("n_u") + F.col("n_v") - F.col("both"))).select("u", "v")


def _within(rows: DataFrame, num: int, den: int, tile: int, tile_grams: int) -> DataFrame:
    """Links in blocks, from (block, comp, handle, n, grams): of a block's main component with all its other sets, and of those among themselves."""
    spark = rows.sparkSession
    comps = rows.groupBy("block", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("grams_in"))
    main = comps.groupBy("block").agg(F.max(F.struct("c", "comp"))["comp"].alias("main"))
    tiles = F.greatest(F.ceil(F.sum("c") / tile), F.ceil(F.sum("grams_in") / tile_grams)).cast("int")
    sides = comps.join(main, "block").groupBy("block", "main", (F.col("comp") == F.col("main")).alias("is_main")).agg(tiles.alias("t"))
    counts = sides.groupBy(F.col("block").alias("_b"), "main").agg(F.sum(F.when(F.col("is_main"), F.col("t"))).cast("int").alias("t_main"), F.sum(F.when(~F.col("is_main"), F.col("t"))).cast("int").alias("t_rest"))
    rows = rows.join(counts, F.col("block") == F.col("_b")).withColumn("is_main", F.col("comp") == F.col("main"))
    own = F.when(F.col("is_main"), F.col("t_rest") + F.pmod(F.xxhash64("handle"), F.col("t_main"))).otherwise(F.pmod(F.xxhash64("handle"), F.col("t_rest"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("is_main"), F.col("t_rest") - 1).otherwise(F.col("t_rest") + F.col("t_main") - 1))
    rows = rows.select("block", own.alias("own"), F.explode(others).alias("other"), "handle", "n", "grams").filter("own <> other")
    rows = rows.select("block", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "handle", "n", "grams")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "block", "a", "b").sortWithinPartitions("block", "a", "b").mapInArrow(_verify(num, den), "u long, v long")


def similar_sets(active: DataFrame, num: int, den: int, tile: int = 384, tile_grams: int = 200_000, few: int = 4) -> DataFrame:
    """``(node, root)`` of linked sets, from (handle, n, shared, lead, grams)."""
    offers = active.select("handle", "n", "shared", F.explode("lead").alias("g")).withColumn("x", F.struct((F.col("n") - F.col("shared")).alias("own"), "handle", "n", "shared"))
    groups = offers.groupBy(F.col("g").alias("_g")).agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("v")).filter("c > 1")
    groups = settle(offers.join(groups, F.col("g") == F.col("_g")).select("g", "c", F.col("x").alias("u"), "v"))
    star = groups.filter((F.col("c") > few) & (F.col("u.handle") != F.col("v.handle"))).select("u", "v")
    small = groups.filter(F.col("c") <= few).groupBy("g").agg(F.sort_array(F.collect_list("u")).alias("m"))  # at most ``few``
    each = F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.lit(few)), lambda y: F.struct(y.alias("u"), x.alias("v"))))
    small = small.select(F.explode(F.flatten(each)).alias("p")).select("p.u", "p.v")
    sum_n = F.col("u.n") + F.col("v.n")
    can = ((den + num) * F.least("u.shared", "v.shared") >= num * sum_n) & (den * F.least("u.n", "v.n") >= num * F.greatest("u.n", "v.n"))
    pairs = settle(star.union(small).filter(can).select(F.col("u.handle").alias("u"), F.col("v.handle").alias("v")).distinct())
    links = settle(_verified(active, pairs, num, den))
    root = settle(components(links))
    # Larger groups that these links do not join.
    large = groups.filter(F.col("c") > few).select("g", F.col("u.handle").alias("handle"), F.col("v.handle").alias("centre"))
    large = large.join(root, F.col("handle") == F.col("node"), "left").select("g", "handle", "centre", F.coalesce("root", "handle").alias("comp"))
    open_ = large.groupBy(F.col("g").alias("_g")).agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b").select("_g")
    rest = settle(large.join(open_, F.col("g") == F.col("_g"), "left_semi").select("handle", "centre", "comp").distinct())
    if rest.isEmpty():
        return root
    blocks = components(rest.select(F.col("handle").alias("u"), F.col("centre").alias("v"))).select(F.col("node").alias("_n"), F.col("root").alias("block"))
    rows = rest.select("handle", "comp").distinct().join(blocks, F.col("handle") == F.col("_n")).select("block", "comp", "handle")
    whole = active.select(F.col("handle").alias("_h"), "n", F.aggregate("grams", F.lit(b""), lambda a, x: F.concat(a, x)).alias("grams"))
    more = _within(rows.join(whole, F.col("handle") == F.col("_h")).drop("_h"), num, den, tile, tile_grams)
    return components(links.union(more))


def jaccard_join(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", docs_per_fragment: int = 6_000) -> DataFrame:
    """Per row of ``docs``: the id, ``n_shingles``, ``set_hash`` and ``component_id``, the least id that links reach."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    fragments = spread(rows.count(), docs_per_fragment, 6)
    parts = min(fragments, MOST_PARTS)
    cut = rows.mapInArrow(_cut(words, fragments, fragments), _FLOW)
    seen = settle(cut.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_count(fragments), _FLOW))
    sets = seen.filter(F.col("kind") == SETS).select("load", "n").repartition(parts, "n").sortWithinPartitions("n")
    active = settle(sets.mapInArrow(_gather(num, den), "handle long, n long, shared long, lead array<long>, grams array<binary>"))
    root = similar_sets(active, num, den)
    of = seen.filter(F.col("kind") == ROWS).select("id", "n", "handle")
    of = of.join(root, F.col("handle") == F.col("node"), "left").withColumn("root", F.coalesce("root", "handle")).drop("node")
    of = settle(of)
    names = of.filter("n > 0").groupBy(F.col("root").alias("r")).agg(F.min("id").alias("least"))
    out = of.join(names, (F.col("root") == F.col("r")) & (F.col("n") > 0), "left")
    name = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), name.alias("component_id"), F.col("handle").alias("set_hash"))
