"""Secret scans: rules as regexes, found through a trigram index.

From each rule's regex a Boolean query over trigrams is derived (literal runs
give AND, alternatives give OR).  Every block of texts gets an inverted index
of the trigrams that any rule asks for; intersecting and uniting its postings
leaves the candidates, on which the regex itself runs.  A rule without a
mandatory trigram (a run of hex digits) scans every text.  The index lives and
dies with its block, so nothing is shuffled and a lost task is simply redone.

Defined results: a null or empty text has no spans; ids may be null or
repeated; other input columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import chunks, text_buffer


@dataclass(frozen=True)
class Rule:
    """``least``: characters that ``group`` must have; shorter matches are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Fixed rules; their order breaks ties between spans with one start.
BASE_RULES = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: A line break, also as an escape.
_BREAK = r"(?:\s|\\[nr])+"
#: Published token shapes, beyond the base.  A private key goes to its END line, or without one to the end of its base64 lines.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END (?:[A-Z]+ )*PRIVATE KEY-----|" rf"(?:{_BREAK}(?:Proc-Type|DEK-Info): [^\n]*)*(?:{_BREAK}[A-Za-z0-9+/=]{{20,}})*(?:{_BREAK}[A-Za-z0-9+/]{{1,19}}={{1,2}})?)"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("login_url", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]+:[^\s/:@]+@[A-Za-z0-9.-]+"),
)
#: A finite set of strings larger than this counts as unknown.
SETS = 24
ANY = ("any",)


def _both(parts: list) -> tuple:
    parts = [p for p in parts if p != ANY]
    return ANY if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _either(parts: list) -> tuple:
    parts = list(dict.fromkeys(parts))
    return ANY if not parts or ANY in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _grams(strings: set[bytes]) -> tuple:
    return _either([_both([("gram", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _low(char: int, flags: int) -> set[bytes] | None:
    c = chr(char)
    if flags & re.IGNORECASE and not flags & re.ASCII and (char >= 128 or c.lower() in "ks"):
        return None  # these have other forms outside ASCII
    return {c.encode("utf-8", "surrogatepass").translate(_LOWER)}


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _item(op, arg, flags: int) -> tuple[set[bytes] | None, tuple]:
    """The strings that an item can match, if they are few, and a query that holds for each text with a match."""
    if op is C.LITERAL:
        s = _low(arg, flags)
        return s, ANY
    if op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
        return {b""}, ANY
    if op is C.IN:
        chars: set[bytes] = set()
        for kind, x in arg:
            span = [x] if kind is C.LITERAL else range(x[0], x[1] + 1) if kind is C.RANGE and x[1] - x[0] < 64 else None
            for c in span if span is not None else ():
                if (s := _low(c, flags)) is None:
                    return None, ANY
                chars |= s
            if span is None:
                return None, ANY
        return (chars, ANY) if len(chars) <= SETS else (None, ANY)
    if op is C.SUBPATTERN:
        return _sequence(arg[3], (flags | arg[1]) & ~arg[2])
    if op is C.BRANCH:
        got = [_sequence(x, flags) for x in arg[1]]
        if all(s is not None for s, _ in got) and len(u := set().union(*(s for s, _ in got))) <= SETS:
            return u, ANY
        return None, _either([_both([q, _grams(s)]) if s is not None else q for s, q in got])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        lo, hi, body = arg
        s, q = _sequence(body, flags)
        if s is not None and hi == 1:
            return (s | {b""} if lo == 0 else s), q if lo else ANY
        if s is not None and lo == hi and len(s) ** lo <= SETS:
            out = {b""}
            for _ in range(lo):
                out = {a + b for a in out for b in s}
            return out, q
        return None, (_both([q, _grams(s)]) if s is not None else q) if lo else ANY
    return None, ANY


def _sequence(items, flags: int) -> tuple[set[bytes] | None, tuple]:
    run, parts, whole = {b""}, [], True
    for op, arg in items:
        s, q = _item(op, arg, flags)
        parts.append(q)
        if s is None or len(run) * len(s) > SETS:
            parts.append(_grams(run))
            run, whole = s or {b""}, False
        else:
            run = {a + b for a in run for b in s}
    if whole:
        return run, _both(parts)
    return None, _both([*parts, _grams(run)])


def trigram_query(pattern: str, flags: int = 0) -> tuple:
    """A query over lower-case trigrams that every text with a match fulfils: ``("gram", t)``, ``("and", ...)``, ``("or", ...)`` or ``("any",)``."""
    parsed = _parser.parse(pattern, flags)
    s, q = _sequence(parsed, parsed.state.flags)
    return _both([q, _grams(s)]) if s is not None else q


def grams_of(query: tuple) -> set[bytes]:
    return {query[1]} if query[0] == "gram" else set() if query == ANY else set().union(*map(grams_of, query[1]))


class Index:
    """Postings of the wanted trigrams over one block of texts."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, wanted: dict[bytes, int], ids: np.ndarray):
        self.n, self.wanted = len(offs) - 1, wanted
        self.posts: list[np.ndarray] = [np.zeros(0, np.int64)] * len(wanted)
        if len(buf) < 3 or not wanted:
            return
        low = np.frombuffer(_LOWER, np.uint8)[buf].astype(np.int32)
        code = low[:-2] << 16
        code |= low[1:-1] << 8
        code |= low[2:]
        got = ids[code]
        at = np.flatnonzero(got)
        doc = np.searchsorted(offs, at, "right") - 1
        inside = at + 3 <= offs[doc + 1]
        got, doc = got[at[inside]].astype(np.int64) - 1, doc[inside]
        pairs = np.unique(got * self.n + doc)
        cuts = np.searchsorted(pairs // self.n, np.arange(len(wanted) + 1))
        self.posts = [pairs[a:b] % self.n for a, b in zip(cuts[:-1], cuts[1:])]

    def find(self, query: tuple) -> np.ndarray:
        """Texts that fulfil ``query``, ascending."""
        if query[0] == "gram":
            return self.posts[self.wanted[query[1]]]
        if query == ANY:
            return np.arange(self.n)
        got = sorted((self.find(q) for q in query[1]), key=len)
        for g in got[1:]:
            got[0] = np.intersect1d(got[0], g, True) if query[0] == "and" else np.union1d(got[0], g)
        return got[0]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(k, r, re.compile(r.pattern), trigram_query(r.pattern)) for k, r in enumerate(rules)]
        self.wanted = {g: i for i, g in enumerate(sorted(set().union(*(grams_of(q) for *_, q in self.rules))))}
        self.ids = np.zeros(1 << 24, np.uint16)
        for g, i in self.wanted.items():
            self.ids[int.from_bytes(g)] = i + 1

    def scan(self, col: pa.Array) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, rule, end), in order."""
        buf, offs = text_buffer(col)
        index, found, texts = Index(buf, offs, self.wanted, self.ids), [[] for _ in range(len(col))], {}
        for k, rule, regex, query in self.rules:
            for i in index.find(query).tolist():
                text = texts.get(i)
                if text is None:
                    text = texts[i] = buf[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")
                for m in regex.finditer(text):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        for f in found:
            f.sort()
        return found


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``spans``: an array of (kind, start, end), code points, by start and then by the rules' order."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [r.kind for r in rules]

    def scan(batches):
        scanner = Scanner(rules)
        item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for b in chunks(batches):
            spans = [[{"kind": names[k], "start": s, "end": e} for s, k, e in f] for f in scanner.scan(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(item))], ["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, f"id {kind}, spans array<struct<kind string, start bigint, end bigint>>").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each found span, overlapping ones as one, replaced by ``mark``; all columns stay, null texts too."""
    from pyspark.sql.types import StructType

    schema: StructType = docs.schema
    at = docs.columns.index(text_col)

    def clean(batches):
        scanner = Scanner(rules)
        for b in chunks(batches, text_col):
            texts = b.column(at).to_pylist()
            for i, spans in enumerate(scanner.scan(b.column(at))):
                if spans:
                    out, done = [], 0
                    for s, _, e in spans:
                        if s >= done:
                            out += [texts[i][done:s], mark]
                        done = max(done, e)
                    texts[i] = "".join([*out, texts[i][done:]])
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(texts, pa.string()), *b.columns[at + 1 :]], b.schema.names)

    return docs.mapInArrow(clean, schema)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
