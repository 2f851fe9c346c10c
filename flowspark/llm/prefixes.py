"""A trie of conversations by their turns, from double arrays over prefix shards.

Conversations are cut into bands of ``band`` turns, and each band of each
conversation is a sequence below the node at which it starts.  Sequences are
dealt into shards by that node and their first turn; a prefix with very many
sequences is dealt over several shards.  A shard packs the trie of its
sequences into BASE and CHECK arrays over the dense numbers of its turns and
walks all sequences through them, which gives the nodes with what their members
add up to.  Nodes that several shards have, the upper ones above all, are
merged by key; the key of a node is the sum of two 64-bit hashes (depth and
turn) over its path, so it needs no pass from band to band.

Sums over subtrees take a second walk.  The smallest member of a node owns it,
so a conversation owns an unbroken end of its path.  A subtree has in it the
whole owned ends of all members but the owner, and the owner's from that depth
on: sum what the members own in all, and take off what the owner owns above.

No step needs a conversation, a node's members or a level in one place: turns
are numbered and summed by ranges, and the ids that end at a node are joined in
pieces and hashed as a stream.

Defined results: rows with a null conversation take no part; null turns come
first, and turns with one number are in the order of hashes of role and text,
repeated rows each for itself; null roles and texts are empty; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_sum, settle, spread

_WIDE = "decimal(38,0)"
_KEY = ["k1", "k2", "depth"]


def numbered(rows: DataFrame, keys: list[str], order: list[str], each: int = 50_000) -> DataFrame:
    """``rows`` with ``pos``, from 1 by ``keys`` in ``order`` (nulls first); settled, and no key is in one task."""
    rows = settle(rows).withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    n = spread(rows.count(), each)
    by = [*keys, *order, "_tie"]
    place = F.monotonically_increasing_id()
    placed = settle(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_part", F.shiftright(place, 33)).withColumn("_place", place).withColumn("_one", F.lit(1)))
    return settle(running_sum(placed, keys, "_part", ["_place"], "_one", "pos").drop("_tie", "_part", "_place", "_one"))


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv``, ``pos`` (from 1), two hashes of role and text, and the text's ``bytes``."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = conversations.filter(F.col(conv_col).isNotNull())
    rows = rows.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(text, F.lit(2), role).alias("t2"), F.octet_length(text).cast("long").alias("bytes"))
    return numbered(rows, ["conv"], ["turn", "t1", "t2"]).drop("turn")


def shared_heads(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations and their turns: the head of conversation c is that of c - c % ``every``, as long as a hash of c tells.

    Gives (``conv``, ``total`` turns) and (``conv``, ``d``, ``t1``, ``t2``, ``bytes``).
    """
    convs = turns.groupBy("conv").agg(F.max("pos").alias("len"))
    convs = convs.withColumn("head", F.crc32(F.col("conv").cast("string").cast("binary")) % most).withColumn("of", F.col("conv") - F.col("conv") % every)
    lengths = convs.select(F.col("conv").alias("_of"), F.col("len").alias("have"))
    convs = convs.join(lengths, F.col("of") == F.col("_of"), "left").withColumn("lead", F.least("head", F.coalesce("have", F.lit(0)).cast("long")))
    convs = settle(convs.select("conv", "head", "of", "lead", (F.col("lead") + F.greatest(F.col("len") - F.col("head"), F.lit(0))).alias("total")))
    own = turns.join(convs.select(F.col("conv").alias("_c"), "head", "lead"), F.col("conv") == F.col("_c")).filter("pos > head")
    own = own.select("conv", (F.col("lead") + F.col("pos") - F.col("head")).alias("d"), "t1", "t2", "bytes")
    first = turns.filter(F.col("pos") < most).withColumnRenamed("conv", "_of")  # fewer than ``most`` rows a conversation
    head = first.join(convs.select("conv", "head", "of"), F.col("_of") == F.col("of")).filter("pos <= head").select("conv", F.col("pos").alias("d"), "t1", "t2", "bytes")
    return convs.select("conv", "total"), settle(own.unionByName(head))


def _wrapped(x: Column) -> Column:
    """A whole number modulo 2^64, as the signed 64-bit number that numpy's sums give."""
    whole = F.pmod(x.cast(_WIDE), F.lit(str(1 << 64)).cast(_WIDE))
    return F.when(whole >= F.lit(str(1 << 63)).cast(_WIDE), whole - F.lit(str(1 << 64)).cast(_WIDE)).otherwise(whole).cast("long")


def sequences(turns: DataFrame, band: int) -> DataFrame:
    """A row for each band of each conversation: the key of the node at which it starts, its turns in order, and the key at its end; settled."""
    turn = F.struct("d", "t1", "t2", F.xxhash64("d", "t1", "t2").alias("g1"), F.xxhash64("t2", "d", "t1").alias("g2"), "bytes")
    rows = turns.groupBy("conv", F.expr(f"(d - 1) div {band}").alias("band")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))  # at most ``band`` turns
    for k in ("1", "2"):
        rows = rows.withColumn(f"s{k}", F.aggregate(F.transform("turns", lambda t: t[f"g{k}"].cast(_WIDE)), F.lit(0).cast(_WIDE), lambda x, g: (x + g).cast(_WIDE)))  # noqa: B023
    sums = settle(rows).withColumn("_range", F.expr("band div 256"))
    for k in ("1", "2"):
        sums = running_sum(sums, ["conv"], "_range", ["band"], f"s{k}", f"e{k}", kind=_WIDE)
    keys = [_wrapped(F.col(f"e{k}") - F.col(f"s{k}")).alias(f"k{k}") for k in "12"] + [_wrapped(F.col(f"e{k}")).alias(f"end{k}") for k in "12"]
    return settle(sums.select("conv", "band", *keys, F.element_at("turns", -1)["d"].alias("end_depth"), "turns"))


def sharded(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` with ``shard``: by start and first turn; a prefix with more than ``limit`` rows is dealt over as many shards as it needs."""
    prefix = F.xxhash64("band", "k1", "k2", F.element_at("turns", 1)["t1"])
    rows = rows.withColumn("prefix", prefix)
    hot = rows.groupBy(F.col("prefix").alias("_of")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("_of", F.ceil(F.col("n") / limit).alias("ways"))
    rows = rows.join(hot, F.col("prefix") == F.col("_of"), "left")
    way = F.pmod(F.xxhash64("conv"), F.coalesce("ways", F.lit(1)))
    shard = F.pmod(F.xxhash64("prefix", way), F.lit(spread(rows.count(), limit)))
    return settle(rows.withColumn("shard", shard).drop("_of", "ways", "prefix"))


class DoubleArray:
    """A trie of sequences of codes (from 1), all children of a slot s at BASE[s] + code, with CHECK of s there."""

    def __init__(self, codes: np.ndarray, size: np.ndarray):
        """``codes``: a row for each sequence, of which the first ``size`` count."""
        self.base, self.check = np.zeros(1, np.int64), np.zeros(1, np.int64)
        at = np.zeros(len(size), np.int64)
        for j in range(codes.shape[1]):
            live = np.flatnonzero(size > j)
            if not len(live):
                break
            code = codes[live, j]
            pairs = np.unique(np.stack([at[live], code], 1), axis=0)
            parent, first, many = np.unique(pairs[:, 0], return_index=True, return_counts=True)
            order = np.argsort(-many, kind="stable")  # wide nodes first, while there is room
            wide = order[many[order] > 1]
            for p in wide.tolist():
                self._put(int(parent[p]), pairs[first[p] : first[p] + many[p], 1])
            single = order[len(wide) :]
            slots = self._free(len(single))
            self.base[parent[single]] = slots - pairs[first[single], 1]
            self.check[slots] = parent[single]
            at[live] = self.base[at[live]] + code

    def _grow(self, upto: int) -> None:
        if upto >= len(self.check):
            more = max(upto + 1, 2 * len(self.check)) - len(self.check)
            self.base, self.check = np.pad(self.base, (0, more)), np.pad(self.check, (0, more), constant_values=-1)

    def _free(self, n: int) -> np.ndarray:
        free = np.flatnonzero(self.check < 0)
        if len(free) < n:
            self._grow(len(self.check) + n)
            free = np.flatnonzero(self.check < 0)
        return free[:n]

    def _put(self, parent: int, codes: np.ndarray) -> None:
        """The first place where all children find their slots free; the end of the arrays is one."""
        span = codes - codes[0]
        for slot in np.flatnonzero(self.check < 0).tolist():
            inside = slot + span[slot + span < len(self.check)]
            if (self.check[inside] < 0).all():
                break
        else:
            slot = len(self.check)
        self._grow(slot + int(span[-1]))
        self.base[parent] = slot - codes[0]
        self.check[slot + span] = parent

    def step(self, at: np.ndarray, code: np.ndarray) -> np.ndarray:
        to = self.base[at] + code
        if len(to) and (to.min() < 0 or to.max() >= len(self.check) or (self.check[to] != at).any()):
            raise KeyError("no such sequence")
        return to


NODE = "k1 long, k2 long, depth long, p1 long, p2 long, bytes long, least long"


def _nodes(rows: pa.Table, values: list[str]) -> pa.Table:
    """The nodes of a shard's trie, with the sums of ``values`` and the least conversation over the sequences through them."""
    rows = rows.combine_chunks()
    lists = rows.column("turns").chunk(0)
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    turn = {f: flat.field(f).to_numpy() for f in ("d", "t1", "t2", "g1", "g2", "bytes")}
    col = {c: rows.column(c).to_numpy() for c in ("conv", "k1", "k2", "band", *values)}
    # Dense numbers, frequent turns first; the node at which a sequence starts is a turn of its own, before the others.
    _, dense, often = np.unique(np.stack([turn["t1"], turn["t2"]], 1), axis=0, return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(-often, kind="stable")] = np.arange(1, len(often) + 1)
    starts = np.unique(np.stack([col["band"], col["k1"], col["k2"]], 1), axis=0, return_inverse=True)[1].reshape(-1)
    codes = np.zeros((len(size), int(size.max()) + 1), np.int64)
    codes[:, 0] = len(often) + 1 + starts
    row, begin = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    codes[row, 1 + np.arange(len(row)) - begin[row]] = rank[dense.reshape(-1)]
    trie = DoubleArray(codes, size + 1)
    n = len(trie.check)
    sums, least = {v: np.zeros(n, np.int64) for v in values}, np.full(n, np.iinfo(np.int64).max)
    of = {c: np.zeros(n, np.int64) for c in ("k1", "k2", "depth", "p1", "p2", "bytes")}
    at = trie.step(np.zeros(len(size), np.int64), codes[:, 0])
    k1, k2, nodes = col["k1"].copy(), col["k2"].copy(), []
    for j in range(codes.shape[1] - 1):
        live = np.flatnonzero(size > j)
        item = begin[live] + j
        to = trie.step(at[live], codes[live, j + 1])
        of["p1"][to], of["p2"][to] = k1[live], k2[live]
        k1[live] += turn["g1"][item]  # modulo 2^64
        k2[live] += turn["g2"][item]
        of["k1"][to], of["k2"][to], of["depth"][to], of["bytes"][to] = k1[live], k2[live], turn["d"][item], turn["bytes"][item]
        for v in values:
            np.add.at(sums[v], to, col[v][live])
        np.minimum.at(least, to, col["conv"][live])
        at[live] = to
        nodes.append(np.unique(to))
    nodes = np.concatenate(nodes)
    out = {c: pa.array(x[nodes]) for c, x in (of | {"least": least} | sums).items()}
    return pa.table(out)


def walked(shards: DataFrame, values: list[str]) -> DataFrame:
    """The nodes of all shards' tries, merged by key; settled."""
    schema = NODE + "".join(f", {v} long" for v in values)
    rows = shards.groupBy("shard").applyInArrow(lambda t: _nodes(t, values), schema)
    return settle(rows.groupBy(*_KEY).agg(*[F.min(c).alias(c) for c in ("p1", "p2", "bytes", "least")], *[F.sum(v).alias(v) for v in values]))


def _joined_ids(batches: Iterator[pa.RecordBatch], most: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Sorted rows of (node, conv) to pieces of the comma-joined ids of a node."""
    for b in batches:
        node = np.stack([b.column(k).to_numpy() for k in range(3)], 1)
        conv = b.column(3).to_numpy()
        new = np.append(True, (node[1:] != node[:-1]).any(1)) if len(conv) else np.zeros(0, bool)
        first = np.flatnonzero(new | (np.arange(len(conv)) % most == 0))
        text = [",".join(map(str, conv[a:z].tolist())) for a, z in zip(first.tolist(), [*first[1:].tolist(), len(conv)])]
        yield pa.RecordBatch.from_arrays([*[pa.array(node[first, k]) for k in range(3)], pa.array(conv[first]), pa.array(text, pa.string())], [*_KEY, "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one digest a node; what is held is one digest's state."""
    now, state = None, None

    def batch(done):
        return pa.RecordBatch.from_arrays([*[pa.array([node[k] for node, _ in done], pa.int64()) for k in range(3)], pa.array([x.hexdigest() for _, x in done], pa.string())], [*_KEY, "ends"])

    for b in batches:
        done = []
        for *node, _, ids in zip(*[c.to_pylist() for c in b.columns]):
            if node == now:
                state.update(b"," + ids.encode())
            else:
                if now is not None:
                    done.append((now, state))
                now, state = node, hashlib.sha256(ids.encode())
        yield batch(done)
    if now is not None:
        yield batch([(now, state)])


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node, ascending and joined by commas."""
    order = [*_KEY, "conv"]
    pieces = ends.repartitionByRange(spread(ends.count(), 200_000), *order).sortWithinPartitions(*order).mapInArrow(_joined_ids, "k1 long, k2 long, depth long, first long, ids string")
    return pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_hashed, "k1 long, k2 long, depth long, ends string")


def prefix_trie(convs: DataFrame, turns: DataFrame, band: int = 64, limit: int = 4096) -> DataFrame:
    """The nodes of the trie of ``convs`` (``conv``, ``total``) by their ``turns`` (``conv``, ``d`` from 1, ``t1``, ``t2``, ``bytes``)."""
    seqs = sequences(turns, band)
    shards = sharded(seqs.select("conv", "band", "k1", "k2", "turns"), limit)
    root = convs.agg(F.min("conv").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 0")
    zero, none = [F.lit(0).cast("long").alias(c) for c in _KEY], [F.lit(None).cast("long").alias(c) for c in ("p1", "p2")]
    nodes = walked(shards.withColumn("n", F.lit(1).cast("long")), ["n"])
    nodes = nodes.unionByName(root.select(*zero, *none, F.lit(0).cast("long").alias("bytes"), "least", "n"))
    children = nodes.filter("depth > 0").groupBy(F.col("p1").alias("c1"), F.col("p2").alias("c2"), (F.col("depth") - 1).alias("c3")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("depth") == F.col("c3")), "left").drop("c1", "c2", "c3")
    nodes = settle(nodes.fillna(0, ["n_children"]).withColumn("saved", (F.col("n") - 1) * F.col("bytes")).withColumn("leaf", (F.col("n_children") == 0).cast("long")))
    # What a conversation owns, summed over the members of each node.
    owned = nodes.groupBy(F.col("least").alias("_c")).agg(F.sum("saved").alias("all_saved"), F.sum("leaf").alias("all_leaves"))
    owned = settle(owned)
    below = walked(shards.join(owned, F.col("conv") == F.col("_c")).drop("_c"), ["all_saved", "all_leaves"])
    every = owned.agg(F.sum("all_saved").alias("all_saved"), F.sum("all_leaves").alias("all_leaves")).filter("all_leaves is not null")
    below = below.select(*_KEY, "all_saved", "all_leaves").unionByName(every.select(*zero, "all_saved", "all_leaves"))
    above = nodes.withColumn("_range", F.expr("depth div 4096"))
    for v in ("saved", "leaf"):
        above = running_sum(above, ["least"], "_range", ["depth"], v, f"upto_{v}")
    out = above.drop("_range").join(below, _KEY)
    parent = nodes.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), (F.col("depth") + 1).alias("c3"), F.col("least").alias("parent"))
    out = out.join(parent, (F.col("p1") == F.col("c1")) & (F.col("p2") == F.col("c2")) & (F.col("depth") == F.col("c3")), "left")
    last = seqs.groupBy("conv").agg(F.max(F.struct("band", "end1", "end2", "end_depth")).alias("last")).select("conv", "last.*")
    ends = last.select(F.col("end1").alias("k1"), F.col("end2").alias("k2"), F.col("end_depth").alias("depth"), "conv").unionByName(convs.filter("total = 0").select(*zero, "conv"))
    out = out.join(end_digests(settle(ends)), _KEY, "left")
    less = lambda total, v: (F.col(total) - F.col(f"upto_{v}") + F.col(v)).alias
    return out.select(F.col("least").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", less("all_leaves", "leaf")("n_leaves"), less("all_saved", "saved")("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
