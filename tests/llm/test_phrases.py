"""Collocations by dynamic itemset counting, against counting everything."""

import random
import re
from collections import Counter, defaultdict

import pytest

from flowspark.llm.phrases import frequent_phrases, phrases, _dealt

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def counts(rows, longest):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f, n


def brute(rows, least, longest, top):
    out = []
    for lang, f in (found := counts(rows, longest))[0].items():
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rank = []
        for p, a in some.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in some.items()):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rank.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, found[1][lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rank)[:top], 1)]
    return sorted(out)


def sentences(rng, n, vocabulary):
    return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "; "]) for _ in range(n))


@pytest.mark.parametrize("shards,longest,cells", [(1, 3, 1 << 25), (3, 3, 1 << 25), (4, 4, 1 << 15), (2, 2, 1 << 15)])
def test_phrases(spark, shards, longest, cells):
    """Also with more shards, longer phrases, and so few cells that many phrases share one."""
    rng = random.Random(shards)
    vocabulary = ["New", "new", "york", "York", "city", "éte", "日本", "a", "b", "c", "d"] * 3 + [f"w{k}" for k in range(30)]
    rows = [(rng.choice(["en", "en", "en", "de", None, "und"]), sentences(rng, rng.randint(0, 60), vocabulary) + rng.choice(["new york city ", ""]) * rng.randint(0, 4)) for _ in range(300)]
    rows += [("en", None), ("fr", ""), (None, ". , ;"), ("xx", "one. two. three. four"), ("hot", "same words over again")] + [("hot", "same words over again")] * 200
    df = spark.createDataFrame([(x, t, k, "h") for k, (x, t) in enumerate(rows)], "lang string, text string, n int, h string").repartition(5)
    got = sorted(map(tuple, phrases(df, longest=longest, shards=shards, cells=cells, top=100).collect()))
    assert got == brute(rows, 10, longest, 100)


def test_counts_are_whole(spark):
    """Phrases that reach the threshold in the last shard only, and parts that do so late, still get one full cycle."""
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = [("en", sentences(rng, 40, vocabulary)) for _ in range(150)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    known = Counter((r.length, r.n) for r in frequent_phrases(_dealt(df, 4, "lang", "text"), 10, 3, 4, 1 << 25).collect() if r.length)
    f = counts(rows, 3)[0]["en"]
    assert known == Counter((len(p), a) for p, a in f.items() if a >= 10)


def test_cells_shared_with_words(spark):
    """A phrase whose cell a frequent word has reached first is still counted inside longer ones."""
    rows = [("en", f"w{k} w{k} w{k}. " * 11) for k in range(600)]
    got = sorted(map(tuple, phrases(spark.createDataFrame(rows, "lang string, text string"), cells=1 << 15).collect()))
    assert got == brute(rows, 10, 3, 2000) and len(got) == 600


def test_large_counts_and_edges(spark, empty):
    assert phrases(empty).count() == 0
    long = "x y z " * 40_000  # one very long text
    got = {r.phrase: r for r in phrases(spark.createDataFrame([("en", long)], "lang string, text string"), shards=2).collect()}
    assert got["x y z"].a == 40_000 and got["x y z"].score == 10**6 and got["z x y"].a == 39_999
    with pytest.raises(ValueError):
        phrases(empty, longest=1)
