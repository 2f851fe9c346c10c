"""Toxicity: Levenshtein automata over a lexicon trie, and context windows.

The lexicon (whole words, and stems that take any ending) is learned from
labelled rows: what occurs in toxic rows and next to never in others.  Words
within one edit of a lexicon word are found by running the union of the
words' Levenshtein automata, intersected with the trie, as one lazily built
automaton.  Words of four letters allow fewer edits: two neighbours changed
places, or one character changed (the first only to a non-letter).  Near words
that clean labelled rows use are ordinary words and are left out.  A hit counts as quoted when quote marks or words of reporting stand
in its context window.  Counts of plain, near and quoted hits, and their rate,
feed a logistic regression, fitted on the same rows.

Only the text is scored.  The fit reads at most ``sample`` labelled rows (the
smallest id hashes), a documented bound, which bounds the lexicon and the list of
ordinary words as well; every text is then scored in place.

Defined results: null or empty texts have the score of a text without hits;
null ids are scored, never learned from; of rows with one id one is learned
from; repeated rows have repeated results;
without labels of both kinds every score is the share of toxic labels (0 when
there are none); an empty table gives an empty result; other columns of
``docs`` are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, settle
from .words import Words, chunks, text_buffer

#: Characters cut off both ends of a word.
EDGE = ".,!?;:\"'()[]{}<>|*&%$#«»“”„‘’-_"
#: Marks and words of reporting that make a context a quotation: fixed sets.
QUOTES = '"«»“”„‘’'
REPORTS = frozenset(("said", "says", "quote", "quoted", "quotes", "word", "words", "term", "called"))
STEM_SIZES = range(4, 9)


class Lexicon:
    """A trie of words and stems, run as an automaton that allows one edit on words of five letters or more.

    ``guarded``: words of four letters allow some edits, too.
    """

    def __init__(self, words: list[str], stems: list[str], ordinary: set[str] = frozenset(), guarded: bool = False):
        self.ordinary, self.stems = ordinary, frozenset(stems)
        four = [t for t in words if guarded and len(t) == 4]
        self.swapped = {t[:k] + t[k + 1] + t[k] + t[k + 2 :] for t in four for k in range(3)}
        self.changed = {(t[:k], t[k + 1 :]) for t in four for k in range(4)}
        self.child: list[dict[str, int]] = [{}]
        self.word: set[int] = set()
        self.stem: set[int] = set()
        self.loose: set[int] = {0}
        for terms, ends in ((words, self.word), (stems, self.stem)):
            for t in terms:
                at = 0
                for c in t:
                    if c not in self.child[at]:
                        self.child[at][c] = len(self.child)
                        self.child.append({})
                    at = self.child[at][c]
                    if ends is self.word and len(t) >= 5:
                        self.loose.add(at)
                ends.add(at)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.stemmed: list[bool] = []  # by state: a stem has been read
        self.ending: list[int] = []  # by state: what a word that ends here is, but for ordinary words
        self.start = self._state({(0, 0)})

    def _state(self, items: set[tuple[int, int]]) -> int:
        items = items | {(n, 1) for at, e in items if not e for n in self.child[at].values() if n in self.loose}  # a letter left out
        key = frozenset(items)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.step.append({})
            self.stemmed.append(any(not e and at in self.stem for at, e in key))
            ends = [(at, e) for at, e in key if at in self.word]
            self.ending.append(1 if any(not e for _, e in ends) else 2 if any(at in self.loose for at, _ in ends) else 0)
        return self.states[key]

    def _next(self, s: int, c: str) -> int:
        out = set()
        for at, e in self.sets[s]:
            n = self.child[at].get(c)
            if n is not None and (not e or n in self.loose):
                out.add((n, e))
            if not e:
                out |= {(n, 1) for n in self.child[at].values() if n in self.loose}  # another letter
                if at in self.loose:
                    out.add((at, 1))  # a letter too many
        got = self.step[s][c] = self._state(out) if out else -1
        return got

    def match(self, word: str) -> int:
        """0: none, 1: a lexicon word or one with a lexicon stem, 2: within one edit of a lexicon word."""
        return self._match(word) or (2 if self.changed and len(word) == 4 and word not in self.ordinary and self._guarded(word) else 0)

    def _guarded(self, word: str) -> bool:
        return word in self.swapped or any((word[:k], word[k + 1 :]) in self.changed for k in range(4) if k or not word[0].isalpha())

    def _match(self, word: str) -> int:
        if len(self.sets) > 10_000:
            self.states, self.sets, self.step, self.stemmed, self.ending = {}, [], [], [], []
            self.start = self._state({(0, 0)})
        s = self.start
        for c in word:
            n = self.step[s].get(c)
            s = self._next(s, c) if n is None else n
            if s < 0:
                return 0
            if self.stemmed[s]:
                return 1
        end = self.ending[s]
        return 0 if end == 2 and word in self.ordinary else end


def plain(word: str) -> str:
    return word.strip(EDGE).lower()


def hits(lex: Lexicon, buf: np.ndarray, offs: np.ndarray, context: int = 6) -> np.ndarray:
    """Per text: plain hits, near hits, quoted hits, words."""
    w = Words(buf, offs)
    out = np.zeros((len(offs) - 1, 4))
    out[:, 3] = w.counts
    if not len(w.start):
        return out
    _, first, back = np.unique(w.h, return_index=True, return_inverse=True)
    raw = buf.tobytes()
    kind = np.fromiter((lex.match(plain(raw[a:b].decode("utf-8", "replace"))) for a, b in zip(w.start[first].tolist(), w.end[first].tolist())), np.int8, len(first))[back]
    doc = w.doc_of()
    for i in np.flatnonzero(kind).tolist():
        d = doc[i]
        lo, hi = max(w.lo[d], i - context), min(w.hi[d], i + context + 1)
        before = raw[w.start[lo] : w.start[i]].decode("utf-8", "replace")
        near = raw[w.start[lo] : w.end[hi - 1]].decode("utf-8", "replace")
        own = raw[w.start[i] : w.end[i]].decode("utf-8", "replace")
        quoted = any(q in own for q in QUOTES) or sum(before.count(q) for q in QUOTES) % 2 == 1 or bool(REPORTS & set(map(plain, near.split())))
        out[d, 2 if quoted else kind[i] - 1] += 1
    return out


def signals(h: np.ndarray) -> np.ndarray:
    """What the score weighs.  The rate is that of open hits: quoted ones have a weight of their own, 0 unless labelled rows quote."""
    total = h[:, :2].sum(1)
    return np.column_stack([np.ones(len(h)), np.log1p(h[:, 0]), np.log1p(h[:, 1]), np.log1p(h[:, 2]), np.minimum(100 * total / np.maximum(h[:, 3], 1), 10)])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _terms(text: str) -> set[str]:
    words = {plain(t) for t in text.split()}
    return {"=" + x for x in words if len(x) >= 3} | {x[:k] + "*" for x in words for k in STEM_SIZES if len(x) >= k and x[:k].isalpha()}


class Toxicity:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray | None, share: float):
        self.lexicon, self.weights, self.share = lexicon, weights, share

    def score(self, h: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(h), self.share)
        return 1 / (1 + np.exp(-np.clip(signals(h) @ self.weights, -30, 30)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 20_000, least: int = 6, terms: int | None = None, id_col: str = "doc_id", text_col: str = "text", held_out: bool = True) -> Toxicity:
    """Learn from at most ``sample`` rows that ``labels`` (id, ``toxic``) marks.

    ``terms``: keep so many entries of the lexicon (a word may have six), the most frequent; all by default.

    ``held_out``: leave out rows whose crc32 of the id as text is divisible by 5.
    """
    y = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull())
    if held_out:
        y = y.filter(crc32_of_id(id_col) % 5 != 0)
    y = y.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(y), "id")  # at most ``sample`` rows are broadcast
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "y")).alias("s")
    rows = settle(rows.groupBy("id").agg(first).select("s.text", "s.y"))  # one row an id: that with the least text hash

    def count(batches):
        yes, no = Counter(), Counter()
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                (yes if y else no).update(_terms(text or ""))
        keys = list(yes.keys() | no.keys())
        yield pa.RecordBatch.from_pydict({"term": pa.array(keys, pa.string()), "yes": pa.array([yes[k] for k in keys], pa.int64()), "no": pa.array([no[k] for k in keys], pa.int64())})

    by_term = rows.mapInArrow(count, "term string, yes long, no long").groupBy("term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    found = by_term.filter((F.col("yes") >= least) & (F.col("no") * 50 <= F.col("yes"))).orderBy(F.desc("yes"), "term")
    found = (found if terms is None else found.limit(terms)).collect()
    words = [r.term[1:] for r in found if r.term[0] == "="]
    stems: list[str] = []
    for s in sorted((r.term[:-1] for r in found if r.term[-1] == "*" and r.term[0] != "="), key=lambda s: (len(s), s)):
        if not any(s.startswith(x) for x in stems):
            stems.append(s)
    lexicon = Lexicon(words, stems, guarded=True)

    def measure(batches):
        ordinary: Counter = Counter()
        for b in chunks(batches):
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                if not y:
                    ordinary.update(w for w in {plain(t) for t in (text or "").split()} if lexicon.match(w) == 2)
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(ordinary), pa.string())})

    lexicon.ordinary = {r.word for r in rows.mapInArrow(measure, "word string").distinct().collect()}

    def look(batches):
        for b in chunks(batches):
            h = hits(lexicon, *text_buffer(b.column(b.schema.get_field_index("text"))))
            yield pa.RecordBatch.from_arrays([*(pa.array(h[:, k]) for k in range(4)), b.column(b.schema.get_field_index("y"))], ["a", "b", "c", "n", "y"])

    seen = rows.mapInArrow(look, "a double, b double, c double, n double, y int").toPandas().sort_values(["a", "b", "c", "n", "y"])
    h, y = seen[["a", "b", "c", "n"]].to_numpy(float), (seen["y"].to_numpy() > 0).astype(float)
    share = float(y.mean()) if len(y) else 0.0
    return Toxicity(lexicon, fit_logistic(signals(h), y) if 0 < share < 1 else None, share)


def score_toxicity(docs: DataFrame, model: Toxicity, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and the counts of hits, which take the place of columns of those names; the model is bounded by its lexicon."""
    from pyspark.sql import types as T

    names = ["score", "n_plain", "n_near", "n_quoted"]
    docs = docs.drop(*names)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), *(T.StructField(n, T.LongType()) for n in names[1:])])

    def score(batches):
        for b in chunks(batches, text_col):
            h = hits(model.lexicon, *text_buffer(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(h)), *(pa.array(h[:, k], pa.int64()) for k in range(3))], [*b.schema.names, *names])

    return docs.mapInArrow(score, schema)
