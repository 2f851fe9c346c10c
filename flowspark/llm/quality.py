"""Quality rules: an isolation forest over statistics of simple text rules.

One Arrow pass turns each whole text into a dozen numbers.  The forest and its
threshold are learned on the driver from at most ``sample`` labelled rows (the
smallest id hashes), a bounded set, of which those that fail the base rule are
left out; every document is then scored in place, so no text is shuffled.
Features are ranked among labelled texts of about the same length, and the
threshold is chosen on the scores of good and bad rows.

Defined results: null or empty texts have zero statistics and fail the base
rule (fewer than 50 words); rows with a null id are scored like any other;
repeated rows give repeated results; without labels of both kinds among the
rows that pass the base rule the method rejects nothing; an empty table gives an empty result.  Input columns other
than the id and the text are ignored.  Equality of lines and windows is that
of 64-bit hashes within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import WS, Words, chunks, mix, span_hash, text_buffer

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_distinct_words", "n_upper", "n_digits", "n_marks"]
_SOLID = ~WS
_HEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)]) & _SOLID
#: Symbols that count, a fixed set.
SYMBOLS = b"#*$%&|<>"
_SYM = np.isin(np.arange(256), list(SYMBOLS))
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_DIGIT = np.isin(np.arange(256), list(range(48, 58)))
_MARK = np.isin(np.arange(256), list(b"!?;:=@~^{}[]()\\\"/_+-"))
_K = np.uint64(0xA24BAED4963EE407)


def _per_doc(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def text_stats(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Rule statistics of each text of a chunk."""
    n, w = len(offs) - 1, Words(buf, offs)
    doc = w.doc_of()
    out = {"n_words": w.counts, "word_chars": _per_doc(_HEAD[buf], offs), "n_symbols": _per_doc(_SYM[buf], offs)}
    breaks = np.flatnonzero(buf == 10)
    start, end = np.sort(np.concatenate([offs[:-1], breaks + 1])), np.sort(np.concatenate([breaks, offs[1:]]))
    line_doc = np.repeat(np.arange(n), 1 + np.searchsorted(breaks, offs[1:]) - np.searchsorted(breaks, offs[:-1]))
    solid = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_SOLID[buf], out=solid[1:])
    has = solid[end] > solid[start]
    start, end, line_doc = start[has], end[has], line_doc[has]
    lines = np.bincount(line_doc, minlength=n)
    key = mix(span_hash(buf, start, end) + line_doc.astype(np.uint64) * _K)
    _, at = np.unique(key, return_index=True)
    out["n_dup_lines"] = lines - np.bincount(line_doc[at], minlength=n)
    first, g = w.grams(3)
    _, back, count = np.unique(mix(g + doc[first].astype(np.uint64) * _K), return_inverse=True, return_counts=True)
    again = first[count[back] > 1]
    covered = np.zeros(len(w.start) + 3, bool)
    for j in range(3):
        covered[again + j] = True
    out["n_repeat_words"] = np.bincount(doc, weights=covered[: len(doc)], minlength=n).astype(np.int64)
    _, at = np.unique(mix(w.h + doc.astype(np.uint64) * _K), return_index=True)
    out |= {"n_lines": lines, "n_distinct_words": np.bincount(doc[at], minlength=n), "n_upper": _per_doc(_UPPER[buf], offs), "n_digits": _per_doc(_DIGIT[buf], offs), "n_marks": _per_doc(_MARK[buf], offs)}
    return out


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    f = {k: np.asarray(v, float) for k, v in s.items()}
    words, chars, lines = np.maximum(f["n_words"], 1), np.maximum(f["word_chars"], 1), np.maximum(f["n_lines"], 1)
    return np.stack([f["n_symbols"] / words, f["n_dup_lines"] / lines, f["n_repeat_words"] / words, f["word_chars"] / words, f["n_distinct_words"] / words ** 0.9, f["n_upper"] / chars, f["n_digits"] / chars, f["n_marks"] / words], axis=1)


def _rank(ordered: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Middle ranks of ``x`` in an ascending array, from 0 to 1."""
    return (np.searchsorted(ordered, x, "left") + np.searchsorted(ordered, x, "right")) / (2 * max(len(ordered), 1))


@dataclass
class Ranks:
    """Features as the mean of their ranks among good and among bad rows of one band of lengths, both classes weighing the same."""

    edges: np.ndarray
    good: list[np.ndarray]
    bad: list[np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, good: np.ndarray, length: np.ndarray, bands: int = 4, least: int = 50) -> "Ranks":
        """At most ``bands`` bands, of about ``least`` rows of each class or more."""
        bands = int(np.clip(min(good.sum(), (~good).sum()) // least, 1, bands))
        edges = np.quantile(length[good], np.arange(1, bands) / bands)
        band = np.searchsorted(edges, length, "right")
        return cls(edges, *([np.sort(x[side & (band == b)], axis=0) for b in range(bands)] for side in (good, ~good)))

    def of(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        out, band = np.zeros(x.shape), np.searchsorted(self.edges, length, "right")
        for b, (good, bad) in enumerate(zip(self.good, self.bad)):
            at = np.flatnonzero(band == b)
            for k in range(x.shape[1]):
                out[at, k] = (_rank(good[:, k], x[at, k]) + _rank(bad[:, k], x[at, k])) / 2
        return out


@dataclass
class IsolationForest:
    """Trees as flat arrays: ``feature`` (-1: leaf), ``cut``, ``left``, and at leaves the path length in ``cut``.

    Trees grow on good rows, but cuts fall anywhere in the box that holds both
    classes, so that a feature that is constant among good rows still splits;
    features are drawn by how far the two classes differ in them.
    """

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    roots: np.ndarray
    norm: float
    threshold: float = 2.0
    ranks: Ranks | None = None

    @staticmethod
    def _c(n: int) -> float:
        return 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    @classmethod
    def fit(cls, x: np.ndarray, low: np.ndarray, high: np.ndarray, weight: np.ndarray, trees: int, size: int, seed: int) -> "IsolationForest":
        rng, size = np.random.default_rng(seed), min(size, len(x))
        depth = int(np.ceil(np.log2(max(size, 2))))
        feature, cut, left, roots = [], [], [], []

        def grow(rows: np.ndarray, level: int, at: int, lo: np.ndarray, hi: np.ndarray) -> None:
            wide = np.flatnonzero((hi > lo) & (weight > 0))
            if level >= depth or len(rows) <= 1 or not len(wide):
                feature[at], cut[at] = -1, level + cls._c(len(rows))
                return
            k = rng.choice(wide, p=weight[wide] / weight[wide].sum())
            c = rng.uniform(lo[k], hi[k])
            below = rows[:, k] <= c
            feature[at], cut[at], left[at] = k, c, len(feature)
            for v in (feature, cut, left):
                v.extend([0, 0])
            inner, outer = hi.copy(), lo.copy()
            inner[k] = outer[k] = c
            grow(rows[below], level + 1, left[at], lo, inner)
            grow(rows[~below], level + 1, left[at] + 1, outer, hi)

        for _ in range(trees):
            roots.append(len(feature))
            for v in (feature, cut, left):
                v.append(0)
            grow(x[rng.choice(len(x), size, replace=False)], 0, roots[-1], low, high)
        return cls(np.array(feature, np.int16), np.array(cut, float), np.array(left, np.int32), np.array(roots, np.int32), max(cls._c(size), 1e-9))

    def score(self, x: np.ndarray, length: np.ndarray | None = None) -> np.ndarray:
        """0 to 1; near 1: isolated after few splits."""
        if self.ranks is not None:
            x = self.ranks.of(x, np.zeros(len(x)) if length is None else length)
        total = np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                go = np.flatnonzero(f >= 0)
                if not len(go):
                    break
                node = at[go]
                at[go] = self.left[node] + (x[go, f[go]] > self.cut[node])
            total += self.cut[at]
        return 2.0 ** (-total / len(self.roots) / self.norm)


def _apart(a: np.ndarray, b: np.ndarray) -> float:
    """The largest distance of two distributions (Kolmogorov-Smirnov)."""
    v = np.unique(np.concatenate([a, b]))
    return float(np.abs(np.searchsorted(np.sort(a), v, "right") / len(a) - np.searchsorted(np.sort(b), v, "right") / len(b)).max())


def _threshold(good: np.ndarray, bad: np.ndarray, lost: float) -> float:
    """Of the cuts that at most the share ``lost`` of the good scores exceeds, the one with the largest share of bad scores above less that of good ones, midway to the next score; 2 (none) where no cut gains."""
    v = np.unique(np.concatenate([good, bad]))
    above_good, above_bad = (1 - np.searchsorted(np.sort(s), v, "right") / len(s) for s in (good, bad))
    gain = np.where(above_good <= lost, above_bad - above_good, -1.0)
    k = int(gain.argmax())
    return float(v[k] + v[k + 1]) / 2 if gain[k] > 0 else 2.0


def fit_forest(x: np.ndarray, good: np.ndarray, trees: int = 100, size: int = 256, seed: int = 7, lost: float = 0.002, length: np.ndarray | None = None) -> IsolationForest:
    """A forest over labelled rows; its threshold is chosen on the labels of both classes, and at most the share ``lost`` of the good rows exceeds it."""
    if not good.any() or good.all():
        return IsolationForest(np.array([-1]), np.zeros(1), np.zeros(1, int), np.zeros(1, int), 1.0)
    length = np.zeros(len(x)) if length is None else length
    ranks = Ranks.fit(x, good, length)
    u = ranks.of(x, length)
    weight = np.array([_apart(u[good, k], u[~good, k]) ** 2 for k in range(u.shape[1])])
    forest = IsolationForest.fit(u[good], u.min(0), u.max(0), weight, trees, size, seed)
    s = forest.score(u)
    forest.ranks, forest.threshold = ranks, _threshold(s[good], s[~good], lost)
    return forest


def base_failed(s: dict[str, np.ndarray], min_words: int, max_repeat: int) -> np.ndarray:
    return (s["n_words"] < min_words) | (100 * s["n_repeat_words"] > max_repeat * s["n_words"])


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """Statistics, anomaly score and verdict of each row of ``docs``.

    ``labels`` has the id and ``quality`` (1: good).  At most ``sample``
    labelled rows are read; those that pass the base rule are fitted on.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = BASE + MORE

    def stats(batches):
        for b in chunks(batches):
            s = text_stats(*text_buffer(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(s[k], pa.int64()) for k in names)], ["id", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("good")).filter("id is not null and good is not null").groupBy("id").agg(F.max("good").alias("good")).orderBy(F.xxhash64("id"), "id").limit(sample)
    got = rows.join(F.broadcast(chosen), "id").select("id", "text", "good")  # at most ``sample`` rows are broadcast

    def labelled(batches):
        for b in chunks(batches):
            s = text_stats(*text_buffer(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(s[k], pa.int64()) for k in names)], ["id", "good", *names])

    fit = got.mapInArrow(labelled, f"id {kind}, good int, " + ", ".join(f"{k} long" for k in names))
    fit = fit.groupBy("id").agg(F.min(F.struct(*names, "good")).alias("s")).select("id", "s.*").toPandas().sort_values("id")  # one row an id
    fit = {k: fit[k].to_numpy() for k in ["good", *names]}
    passed = ~base_failed(fit, min_words, max_repeat)
    fit = {k: v[passed] for k, v in fit.items()}
    forest = fit_forest(features({k: fit[k] for k in names}), fit["good"] > 0, length=fit["n_words"])

    def judged(batches):
        for b in chunks(batches):
            s = text_stats(*text_buffer(b.column(1)))
            score = forest.score(features(s), s["n_words"])
            failed = base_failed(s, min_words, max_repeat)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(s[k], pa.int64()) for k in names), pa.array(failed), pa.array(score), pa.array(~failed & (score <= forest.threshold))], ["id", *names, "base_failed", "anomaly", "kept"])

    out = rows.mapInArrow(judged, f"id {kind}, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, anomaly double, kept boolean")
    return out.withColumnRenamed("id", id_col)
