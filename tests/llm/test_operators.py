"""Each operator against a brute-force version, on rows with every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowspark.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TOP = 1 << 63


def words(t):
    return WORD.findall(t or "")


# -- 1 ----------------------------------------------------------------------


def shares(sizes, weights, repeats):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left, rest = total - sum(repeats * sizes[s] for s in full), sum(w[s] for s in names if s not in full)
        new = {s for s in names if s not in full and left * w[s] / rest > repeats * sizes[s]}
        if not new:
            return {s: repeats * sizes[s] if s in full else left * w[s] / rest for s in names}
        full |= new


def test_mixing(spark, odd, odd_rows, empty):
    from flowspark.llm.mixing import mix_sources, mixed

    got = mix_sources(odd).collect()
    assert len(got) == len(odd_rows)
    sizes = Counter()
    for _, t, s in odd_rows:
        sizes[s] += len(words(t))
    goal = shares(sizes, (1, 2, 3), 3)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    largest = max(len(words(t)) for _, t, _ in odd_rows)
    assert sum(taken.values()) <= sum(sizes.values())
    assert sum(sizes.values()) - sum(taken.values()) <= largest * len(sizes)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, mix_sources(odd.repartition(5)).collect()))  # reruns agree
    out = mixed(odd)
    assert out.columns == odd.columns and out.count() == sum(r.copies for r in got if r.size)
    assert mix_sources(empty).count() == 0 and mixed(empty).count() == 0


def test_alike_rows_and_clashing_names(spark):
    """A third of the rows alike, and columns with the names that operators use inside: whole rows come back."""
    from flowspark.llm.mixing import mix_sources, mixed

    names = ["doc_id", "text", "source", "id", "key", "hash", "of", "n", "rows", "twin", "salt", "copy", "_key", "_id", "_n", "c0", "size", "taken"]
    rows = [(None, "same words here", "hot", *(f"{c}-{k % 3}" for c in names[3:])) for k in range(120)] + [(k, f"own words {k}", f"s{k % 3}", *(f"{c}-{k}" for c in names[3:])) for k in range(240)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in names)).repartition(4)
    got, plan = Counter(map(tuple, mixed(df).collect())), mix_sources(df).collect()
    assert set(got) <= set(rows) and sum(got.values()) == sum(r.copies for r in plan)
    hot = sorted(n for r, n in got.items() if r[2] == "hot")
    assert sum(hot) == sum(r.copies for r in plan if r.source == "hot") and hot[-1] - hot[0] <= 40
    assert sorted(map(str, plan)) == sorted(map(str, mix_sources(df.repartition(7)).collect()))


def test_mixing_levels(spark):
    from flowspark.llm.mixing import targets

    rng = random.Random(3)
    for _ in range(4):
        sizes = {f"s{k:02d}": rng.choice([0, 1, 10, 1000, 5000]) for k in range(rng.randint(1, 9))} | {None: 7}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        goal = shares(sizes, (1, 2, 3), 3)
        for r in targets(df, (1, 2, 3), 3).collect():
            assert abs(r.target - goal[r.source]) < 1e-6 * (1 + goal[r.source])


# -- 2 ----------------------------------------------------------------------


def brute_repeats(rows, n):
    least = {}
    for i, t, _ in rows:
        w, k = words(t), TOP if i is None else i
        for j in range(len(w) - n + 1):
            g = tuple(w[j : j + n])
            least[g] = min(least.get(g, TOP), k)
    out = []
    for i, t, _ in rows:
        w, k, gone = words(t), TOP if i is None else i, set()
        for j in range(len(w) - n + 1):
            if least[tuple(w[j : j + n])] < k:
                gone |= set(range(j, j + n))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("unique", [True, False])
def test_substrings(spark, odd, odd_rows, empty, unique):
    from flowspark.llm.substrings import substring_dedup

    rows, df = odd_rows, odd
    if unique:
        rows, df = [r for r in odd_rows if r[0] not in (None, 70)], odd.filter("doc_id is not null and doc_id <> 70")
    got = [tuple(r) for r in substring_dedup(df, docs_per_bucket=5).collect()]
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(got, key=key) == sorted(brute_repeats(rows, 13), key=key)
    assert substring_dedup(empty).count() == 0


def test_rows_of_one_id_with_one_crc32(spark):
    """Two null-id rows whose texts differ and have one crc32: only the row that repeats a document loses words."""
    import zlib

    from flowspark.llm.substrings import substring_dedup

    shared, own = " ".join(f"w{k}" for k in range(13)), " ".join(f"v{k}" for k in range(13))
    rng, seen, twin = random.Random(1), {}, None
    for _ in range(300_000):
        t = f"{shared} {rng.getrandbits(80):x}"
        seen[zlib.crc32(t.encode())] = t
    while not twin:
        other = f"{own} {rng.getrandbits(80):x}"
        twin = seen.get(zlib.crc32(other.encode()))
    rows = [(1, shared, "s"), (None, twin, "s"), (None, other, "s")] + [(None, f"{shared} again", "s")] * 20
    got = [tuple(r) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()]
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(got, key=key) == sorted(brute_repeats(rows, 13), key=key)


def test_a_phrase_in_every_document_is_no_repeat(spark):
    """60,000 documents share five words only; all windows over them differ."""
    from pyspark.sql import functions as F

    from flowspark.llm.substrings import substring_dedup

    own = lambda a, b: F.array_join(F.transform(F.sequence(F.lit(a), F.lit(b)), lambda k: F.concat(F.lit("u"), "doc_id", F.lit("-"), k)), " ")
    df = spark.range(60_000).withColumnRenamed("id", "doc_id").withColumn("text", F.concat_ws(" ", own(1, 9), F.lit("the same five words here"), own(10, 18)))
    got = substring_dedup(df).agg(F.sum("n_words"), F.sum("n_removed")).first()
    assert tuple(got) == (60_000 * 23, 0)


def test_hot_anchors_change_nothing(spark):
    from flowspark.llm import substrings

    rng = random.Random(3)
    rows = []
    for i in range(300):
        tail = [f"t{rng.randint(0, 20)}"] * 9  # some tails are shared, so some windows are repeats
        rows.append((i, " ".join([f"u{i}-{k}" for k in range(9)] + "the same five words here".split() + tail), "s"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    ids = df.selectExpr("doc_id as id", "text")
    assert len(substrings.hot_anchors(ids, 13, 5, every=1)) and not len(substrings.hot_anchors(ids, 13, 5, every=1, least=10**6))
    got = substrings.substring_dedup(df, docs_per_bucket=20, hot_every=1).collect()
    assert sorted(map(tuple, got)) == sorted(brute_repeats(rows, 13)) and sum(r.n_removed for r in got) > 0


# -- 3 ----------------------------------------------------------------------


def test_secrets(spark, odd, odd_rows, empty):
    from flowspark.llm.secrets import BASE_RULES, MORE_RULES, find_secrets, redact

    rules = BASE_RULES + MORE_RULES
    more = [(900, 'Token: "aB3+/=_.-xyz" secret: token: abcdefghijk ſecret=abcdefghij PASSWD=\'12345678', "s"), (901, "ghp_" + "a1B2" * 10 + " postgres://me:pw@host/db eyJhbGciOiJIUz.eyJzdWIiOiIx.abcdefghij -----BEGIN RSA PRIVATE KEY-----", "s"), (902, "é" * 50 + " api_key=abcdefgh apikey : abcdefgh0 AKIA AKIAAKIAAKIAAKIA1", "s")]
    df = odd.select("doc_id", "text").union(spark.createDataFrame([(i, t) for i, t, _ in more], "doc_id long, text string"))
    got = {}
    for r in find_secrets(df).collect():
        got.setdefault((r.doc_id, len(r.spans)), []).append([(s.kind, s.start, s.end) for s in r.spans])
    for i, t, _ in odd_rows + more:
        want = []
        for k, rule in enumerate(rules):
            for m in re.finditer("[0-9a-f]+" if rule.kind == "hex" else rule.pattern, t or ""):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    want.append((m.start(), k, m.end()))
        want = [(rules[k].kind, s, e) for s, k, e in sorted(want)]
        assert want in got[i, len(want)]
    assert find_secrets(empty).count() == 0
    clean = {r.doc_id: r.text for r in redact(df).collect()}
    assert clean[1] is None and "abcDEF123456" not in clean[62] and clean[62].startswith("x = 1\n[SECRET]")
    assert redact(odd).columns == odd.columns


def test_whole_keys_and_long_logins_go(spark):
    from flowspark.llm.secrets import redact

    body = "\n".join("MIIE" + c * 60 for c in "abC9") + "\nQUJD+/=="
    head, tail = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    user, word = "u" * 90, "p" * 200
    texts = {
        1: (f"a {head}\n{body}\n{tail} z", "a [SECRET] z"),
        2: (f"a {head}\nProc-Type: 4,ENCRYPTED\n\n{body}\n\nthe rest stays", "a [SECRET]\n\nthe rest stays"),
        3: ("a " + f"{head}\n{body}\n{tail}".replace("\n", "\\n") + " z", "a [SECRET] z"),
        4: (f"a {head} alone, {head}\n{body}\n{tail} z", "a [SECRET] alone, [SECRET] z"),
        5: (f"to db://{user}:{word}@host.example now", "to [SECRET] now"),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    assert {r.doc_id: r.text for r in redact(df).collect()} == {i: w for i, (_, w) in texts.items()}


def test_trigram_queries_never_lose_a_match():
    from flowspark.llm.secrets import Index, grams_of, trigram_query
    from flowspark.llm.words import text_buffer

    rng = random.Random(1)
    texts = ["".join(rng.choice("abcAB12_ k") for _ in range(rng.randint(0, 30))) for _ in range(800)] + ["", "abc", "ABC"]
    buf, offs = text_buffer(pa.array(texts))
    for p in ("abc", "(?i:abc)", "a[bc]1|b2+c", "(ab|ba){2}", "(?:abc)?1_", "a.c", "^ab", "[^a]bc1", "(?i)kab", "ab{1,2}c", "(a|bc|)b1", r"\bab"):
        q = trigram_query(p)
        wanted = {g: i for i, g in enumerate(sorted(grams_of(q)))}
        ids = np.zeros(1 << 24, np.uint16)
        for g, i in wanted.items():
            ids[int.from_bytes(g)] = i + 1
        found = set(Index(buf, offs, wanted, ids).find(q).tolist())
        assert {i for i, t in enumerate(texts) if re.search(p, t)} <= found


# -- 4 ----------------------------------------------------------------------


def test_token_file_round_trip_and_damage():
    from flowspark.llm import idfile

    rng = np.random.default_rng(0)
    for n in (0, 1, 2047, 2048, 2049, 9000):
        for kinds in (1, 3, 40, 20_000):
            ids = np.minimum(rng.geometric(0.01, n), kinds).astype(np.uint32) * 3 if kinds < 20_000 else rng.integers(0, kinds, n).astype(np.uint32)
            counts = np.array([n // 2, n - n // 2])
            image = idfile.encode_segment(ids, counts, [None, -5])
            back, c, names = idfile.decode_segment(image)
            assert (back == ids).all() and len(back) == n and (c == counts).all() and names == [None, -5]
    for at in (0, 7, 30, len(image) // 2, len(image) - 1):
        bad = bytearray(image)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            idfile.decode_segment(bytes(bad))


@pytest.mark.parametrize("kinds", [32_769, 40_000, 65_536, 65_537, 70_000, 100_000])
def test_token_file_with_many_kinds(kinds):
    from flowspark.llm import idfile

    rng = np.random.default_rng(kinds)
    ids = np.concatenate([rng.permutation(kinds) * 7, rng.geometric(0.05, 20_001), np.zeros(300)]).astype(np.uint32)
    back, c, names = idfile.decode_segment(idfile.encode_segment(ids, np.array([len(ids)]), [4]))
    assert (back == ids).all() and c.tolist() == [len(ids)] and names == [4]


def test_token_files(spark, odd, odd_rows, empty, tmp_path):
    from tokenizers import Tokenizer

    from flowspark.llm.idfile import read_ids, write_ids

    path = tokenizer_path("byte_bpe_50k.json")
    write_ids(odd, str(tmp_path / "ids"), path, 2, docs_per_part=15, most=3_000)
    got = sorted(read_ids(spark, str(tmp_path / "ids"), with_ids=True).collect(), key=lambda r: r.start)
    t, at = Tokenizer.from_file(path), 0
    want = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids + [2])) for i, x, _ in odd_rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert [r.doc_id for r in got] == sorted((r[0] for r in odd_rows), key=lambda i: -TOP if i is None else i)
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    write_ids(empty, str(tmp_path / "none"), path, 2)
    assert read_ids(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("name,cut", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_units_give_the_ids_of_whole_texts(name, cut):
    from tokenizers import Tokenizer

    from flowspark.llm.tokens import Encoder
    from flowspark.llm.words import text_buffer

    rng = random.Random(2)
    parts = list("ab 'sl\n\t\r  　é́ΣςσİK1９!<|.\x1c\x85\x0b") + ["<|endoftext|>", "don't", "  ", "  ", "日本", " 's", "Straße", " Größe", "ŉ", "İi", "ǅ", "ªº", " ÀÉ", "Å", "I'LL"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["", None]
    ids, counts = Encoder(tokenizer_path(name), cut).encode(*text_buffer(pa.array(texts, pa.string())))
    want = [e.ids for e in Tokenizer.from_file(tokenizer_path(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


# -- 5 ----------------------------------------------------------------------


def test_sharding(spark, odd, odd_rows, empty):
    from flowspark.llm.sharding import lookup_table, place

    names = [f"n{k}" for k in range(7)]
    table = lookup_table(names, 1009)
    counts = Counter(table)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = lookup_table(names[:-1], 1009)
    moved = sum(names[a] != names[b] for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.1 * 1009
    got = place(odd, names, 1009).collect()
    assert len(got) == len(odd_rows) and all(r.shard == names[table[r.slot]] for r in got)
    assert place(empty, names).count() == 0
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            lookup_table(bad)
    with pytest.raises(ValueError):
        lookup_table(names, 1000)


# -- 6 ----------------------------------------------------------------------


def shingles(t):
    w = words((t or "").translate(LOW))
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            ids[find(k)].append(i)
    return [(rows[k][0], len(s), (min(ids[find(k)], default=None) if s else rows[k][0])) for k, s in enumerate(sets)]


@pytest.mark.parametrize("tile", [384, 3])
def test_jaccard(spark, odd, odd_rows, empty, tile, monkeypatch):
    from flowspark.llm import jaccard

    whole = jaccard.similar_sets
    monkeypatch.setattr(jaccard, "similar_sets", lambda active, num, den: whole(active, num, den, tile, few=4 if tile > 3 else 1))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(odd, docs_per_fragment=20).collect())
    assert got == Counter(brute_components(odd_rows))
    if tile == 384:
        assert jaccard.jaccard_join(empty).count() == 0


def test_jaccard_with_hot_grams(spark):
    """Near copies around the threshold, and a passage in most documents."""
    from flowspark.llm.jaccard import jaccard_join

    rng = random.Random(8)
    passage, base = [f"p{k}" for k in range(30)], [f"b{k}" for k in range(100)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(100), rng.randint(0, 4)):
            w[k] = f"x{rng.randint(0, 5)}"
        rows.append((i, " ".join(w), ""))
    rows += [(100 + i, " ".join(passage + [f"u{rng.randint(0, 99)}" for _ in range(rng.randint(0, 40))]), "") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, s string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(df).collect())
    assert got == Counter(brute_components(rows))


@pytest.mark.parametrize("few", [4, 1])
def test_jaccard_of_chains_and_families(spark, few, monkeypatch):
    """Texts that share half with the next one; families with a centre and without; texts that share a frame only."""
    from flowspark.llm import jaccard

    rng = random.Random(18)
    rows = [(k, " ".join(f"c{j}" for j in range(20 * k, 20 * k + 40)), "") for k in range(120)]
    for f in range(4):
        base = [f"f{f}-{j}" for j in range(120)]
        rows += [(1000 + 100 * f, " ".join(base), "")] if f % 2 else []
        for i in range(25):
            w = list(base)
            for j in rng.sample(range(120), rng.randint(1, 4)):
                w[j] = f"x{rng.randint(0, 9)}"
            rows.append((1001 + 100 * f + i, " ".join(w), ""))
    frame = [f"m{j}" for j in range(60)]
    rows += [(5000 + i, " ".join(frame + [f"own{i}-{j}" for j in range(9)]), "") for i in range(40)]
    whole = jaccard.similar_sets
    monkeypatch.setattr(jaccard, "similar_sets", lambda active, num, den: whole(active, num, den, 8, few=few))
    df = spark.createDataFrame(rows, "doc_id long, text string, s string").repartition(5)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(df, docs_per_fragment=60).collect())
    assert got == Counter(brute_components(rows))


def test_components(spark):
    from flowspark.llm.components import components

    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(300, 300)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.root for r in got.collect()} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# -- 7 ----------------------------------------------------------------------


def within_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:j] + b[j + 1 :] == a for j in range(len(b)))


def test_lexicon_automaton():
    from flowspark.llm.toxicity import Lexicon

    rng = random.Random(6)
    terms = ["idiot", "clown", "scum", "clowns", "trash", "abcab", "ababa"]
    lex = Lexicon(terms, ["zqx"], {"idiom"})
    tried = set(terms) | {"idiom", "zqxx", "zq", "", "clow", "cloown", "xclown", "scun", "zqx"}
    for t in terms:
        for _ in range(200):
            w = list(t)
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b", "c", "z"])
            tried.add("".join(w))
    for w in tried:
        want = 1 if w in terms or w.startswith("zqx") else 2 if w != "idiom" and any(len(t) >= 5 and within_one(t, w) for t in terms) else 0
        assert lex.match(w) == want, w


def test_quotation_and_scores(spark, odd, odd_rows, empty):
    from flowspark.llm.toxicity import Lexicon, fit_toxicity, hits, score_toxicity
    from flowspark.llm.words import text_buffer

    lex = Lexicon(["idiot"], [])
    h = hits(lex, *text_buffer(pa.array(["you Idiot!", "she said \"idiot\" again", "an idi0t here", "", None, "fine"])))
    assert h[:, :3].tolist() == [[1, 0, 0], [0, 0, 1], [0, 1, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0]]
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice(["tree", "house", "river", "stone", "cloud"]) for _ in range(30)) + (" moron you scumbag" if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    got = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    for i, _, y in rows:
        if zlib.crc32(str(i).encode()) % 5 == 0:
            assert (got[i].score >= 0.5) == bool(y)
    out = score_toxicity(odd, model)
    assert out.count() == len(odd_rows) and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert score_toxicity(empty, model).count() == 0
    none = fit_toxicity(empty, labels.limit(0))
    assert {r.score for r in score_toxicity(odd, none).collect()} == {0.0}


def test_quotation_is_no_abuse(spark):
    """The same words, in the open and reported, by a model of the labels of sf0.1, none of which quote."""
    from flowspark.llm.toxicity import fit_toxicity, score_toxicity

    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(docs.select("doc_id", "text"), labels)
    a, b = sorted(w for w, n in ((w, model.lexicon.match(w)) for r in docs.join(labels.filter("toxic = 1"), "doc_id").limit(50).collect() for w in r.text.lower().split()) if n == 1 and w.isalpha())[:2]
    prose = "They went along the river and spoke of the weather until the evening came. " * 3
    rows = [(1, prose), (2, f'{prose}He said "you {a} and {b}" and left.'), (3, f"{prose}You {a} and {b} all the way {a}."), (4, f'{prose}The word "{a}" is old. {prose}You {a} and {b} all the way {a}.')]
    got = {r.doc_id: r for r in score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[2].n_quoted == 2 and got[2].n_plain == 0 and got[2].score == pytest.approx(got[1].score) and got[2].score < 0.5
    assert got[3].score > 0.5 and got[4].score > 0.5


def test_short_lexicon_words_and_many_ordinary_ones(spark):
    from flowspark.llm.toxicity import Lexicon, fit_toxicity

    lex = Lexicon(["scum", "oaf"], [], {"slum"}, guarded=True)
    want = {"scum": 1, "scun": 2, "sucm": 2, "5cum": 2, "s*um": 2, "slum": 0, "tcum": 0, "scu": 0, "scums": 0, "oat": 0, "": 0}
    assert {w: lex.match(w) for w in want} == want
    # All ordinary near words count, also past the lexicon's bound and late in the alphabet.
    near = [f"{a}umbug" for a in "abcdefgijklmnopqrstvwxyz"]
    clean = ["tree house river stone cloud"] * 76 + [f"tree house {w} stone" for w in near]
    rows = [(2 * k, x, 0) for k, x in enumerate(clean)] + [(2 * k + 1, f"you humbug tree house {k}", 1) for k in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels, held_out=False, terms=10)
    assert model.lexicon.match("humbug") == 1 and [w for w in near if model.lexicon.match(w)] == []


# -- 8 ----------------------------------------------------------------------


def best_fit(lengths, size):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            g = min(fits)
            gaps.remove(g)
        else:
            g = size
        gaps.append(g - n)
    return len(gaps)


def test_packing_plan():
    from flowspark.llm.packing import plan

    rng = random.Random(7)
    for size in (1, 7, 64, 100):
        for _ in range(40):
            lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 200))]
            counts, places, used = Counter(lengths), plan(Counter(lengths), size), defaultdict(list)
            for n in counts:
                ranks = sorted((a, b) for m, a, b, _, _ in places if m == n)
                assert ranks[0][0] == 0 and ranks[-1][1] == counts[n] and all(x[1] == y[0] for x, y in zip(ranks, ranks[1:]))
            for n, a, b, first, offset in places:
                for r in range(a, b):
                    used[first + r - a].append((offset, n))
            for spans in used.values():
                at = 0
                for offset, n in sorted(spans):
                    assert offset == at
                    at += n
                assert at <= size
            assert len(used) == best_fit(lengths, size)


def test_packing(spark, odd, odd_rows, empty):
    from tokenizers import Tokenizer

    from flowspark.llm.packing import pack_documents

    path = tokenizer_path("word_bpe_49k.json")
    t, size = Tokenizer.from_file(path), 256
    want = Counter()
    for i, x, _ in odd_rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        for p in range(0, len(ids), size):
            piece = ids[p : p + size]
            want[i, p // size, p, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    got = pack_documents(odd, path, size).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for spans in used.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= size
    assert len(used) == best_fit([k[3] for k, n in want.items() for _ in range(n)], size)
    assert pack_documents(empty, path).count() == 0


# -- 9 ----------------------------------------------------------------------


def test_top_k(spark):
    from flowspark.llm.topk import top_k

    rng = random.Random(12)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(6)], "x", 1) for k in range(160)]
    rows += [(200 + k, rows[3][1], "x", 1) for k in range(30)] + [(150, [0.5] * 6, "tie", 1), (400, None, "", 1), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0], "", 1), (402, [float("nan")] * 6, "", 1), (403, [float("inf")] * 6, "", 1), (None, [1.0] * 6, "", 1), (450, [1.0, 2.0], "", 1), (451, [2.0, 2.0], "", 1), (500, [], "", 1), (501, [], "", 1), (600, [600_000.0, -1.0, 0.5, 0.25, 3.0, 0.0], "", 1), (601, [3e7, 1.0, 0.0, 0.0, 0.0, -7.0], "", 1), (700, [5e5, -5e5, 0.0, 0.0, 1.0, 1.0], "", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, rank int").repartition(3)
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    for at, (i, q) in enumerate(ok):
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for n, (j, v) in enumerate(ok) if n != at and len(v) == len(q))[:5]
            want.update((i, n + 1, j, -s) for n, (s, j) in enumerate(best))
    for block, query_block in ((2048, 512), (7, 2)):
        got = top_k(df, block=block, query_block=query_block)
        assert Counter(tuple(r) for r in got.collect()) == want
    assert top_k(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="does not fit 64 bits"):
        top_k(spark.createDataFrame([(0, [1e14]), (1, [1e14])], "vec_id long, embedding array<double>")).collect()


# -- 10 ---------------------------------------------------------------------


def brute_rules(t):
    t = t or ""
    w, lines = words(t), [x for x in t.split("\n") if words(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
    again = {j + k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(again)


def test_quality(spark, odd, odd_rows, empty):
    from flowspark.llm.quality import quality_rules

    labels = spark.createDataFrame([(i, int(k % 5 > 0)) for k, (i, _, _) in enumerate(odd_rows)], "doc_id long, quality int")
    got = quality_rules(odd, labels).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((i, *brute_rules(t)) for i, t, _ in odd_rows)
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
    assert quality_rules(empty, labels).count() == 0
    assert all(r.kept != r.base_failed for r in quality_rules(odd, labels.limit(0)).collect())


def test_forest_finds_outliers():
    from flowspark.llm.quality import fit_forest

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (2000, 4)), rng.normal(9, 1, (40, 4))])
    good = np.arange(len(x)) < 2000
    forest = fit_forest(x, good)
    rejected = forest.score(x) > forest.threshold
    assert rejected[good].mean() <= 0.003 and rejected[~good].mean() > 0.9


def test_quality_rejects_junk_that_passes_the_base_rule(spark):
    """Held-out junk of several densities goes, held-out clean texts of all lengths stay."""
    from flowspark.llm.quality import quality_rules

    rng = random.Random(13)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    rows = []
    for i in range(1200):
        w = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(int(60 * 20 ** rng.random()))]
        kind = i % 12
        if kind == 0:
            w = [x + rng.choice(["%%%", "&&&", "***"]) if rng.random() < 0.6 else x for x in w]
        elif kind == 1:
            w = [y for k, x in enumerate(w) for y in ([x, "|"] if k % 3 == 0 else [x])]
        rows.append((i, " ".join(w), int(kind > 1)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if zlib.crc32(str(r[0]).encode()) % 5], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality_rules(docs, labels).collect() if not r.base_failed}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[0] in kept]
    bad, good = [kept[i] for i, _, q in held if not q], [kept[i] for i, _, q in held if q]
    assert len(bad) > 20 and len(good) > 100
    assert sum(bad) <= 0.05 * len(bad) and sum(good) >= 0.98 * len(good)


def test_fits_read_one_row_an_id(spark, monkeypatch):
    """Repeats of a labelled id neither reach the driver nor weigh on the fits."""
    from pyspark.sql import DataFrame

    from flowspark.llm.quality import quality_rules
    from flowspark.llm.toxicity import fit_toxicity

    rows = [(k, f"tree house river {k} " + "moron you " * (k % 4 == 0)) for k in range(80)]
    once = spark.createDataFrame(rows, "doc_id long, text string")
    often = spark.createDataFrame(rows + [rows[3]] * 500 + [rows[4]] * 300, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, int(k % 4 == 0), int(k % 4 > 0)) for k in range(80)], "doc_id long, toxic int, quality int")
    sizes, whole = [], type(once).toPandas

    def counted(self):
        out = whole(self)
        sizes.append(len(out))
        return out

    monkeypatch.setattr(type(once), "toPandas", counted)
    assert isinstance(once, DataFrame)
    a, b = (fit_toxicity(x, labels, held_out=False) for x in (once, often))
    assert a.share == b.share and np.array_equal(a.weights, b.weights) and a.lexicon.stems == b.lexicon.stems
    quality_rules(often, labels)
    assert sizes == [80, 80, 80]


# -- queries ----------------------------------------------------------------


@pytest.mark.parametrize("name", ["op2_substrings", "op6_jaccard", "op9_top_k"])
def test_query_equals_sql(spark, name):
    import oracle

    from flowspark.llm.queries import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.001"
    oracle.same(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)


def test_digest_query(spark):
    from flowspark.llm.queries import QUERIES
    from flowspark.llm.secrets import BASE_RULES, digest

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op3_secrets"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        spans = sorted((m.start(), k, m.end()) for k, rule in enumerate(BASE_RULES) for m in re.finditer(rule.pattern, r.text or "") if m.end(rule.group) - m.start(rule.group) >= rule.least)
        assert got[r.doc_id].base_sha256 == digest([(BASE_RULES[k].kind, s, e) for s, k, e in spans])


def test_pipeline_stages(spark, odd, empty, tmp_path):
    import corpus_pipeline

    sf, docs = "/root/testdata/sf0.001", None
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_copies", "secrets", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == docs.columns
        if name == "near_copies":
            rows = [(r.doc_id, r.text, "") for r in docs.collect()]
            keep = {c for _, _, c in brute_components(rows)}
            assert {r.doc_id for r in out.collect()} == keep
        if name == "secrets":
            assert out.count() == docs.count()
        docs = out
    assert docs.count() > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty.select("doc_id", "text", "lang", "source", "n_chars"), sf).count() == 0
        stage(spark, odd, sf).count()
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


def test_near_copies_keeps_one_row_a_group(spark, odd, odd_rows):
    """Null and repeated ids are judged row by row."""
    import corpus_pipeline

    rng = random.Random(21)
    a, b, c, d, e, f = (" ".join(f"{p}{rng.randint(0, 999)}" for _ in range(40)) for p in "abcdef")
    rows = [(5, a), (9, a), (None, a), (None, b), (None, c), (None, c), (None, d), (None, d + " end"), (7, e), (7, e), (7, e), (7, f), (8, f), (7, b + " else " + c), (3, f), (None, None), (None, None), (2, ""), (2, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _n long").repartition(3)
    near = dict(corpus_pipeline.STAGES)["near_copies"]
    out = near(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(out.collect(), key=lambda r: r._n)
    want = [(5, a), (None, b), (None, c), (7, e), (7, b + " else " + c), (3, f), (None, None), (None, None), (2, ""), (2, "")]
    rest = [(r.doc_id, r.text) for r in got if r.text not in (d, d + " end")]
    assert Counter(rest) == Counter(want) and len(got) == len(want) + 1  # one of the null ids of d
    assert [r._n for r in got if r.text in (c, e)] == [4, 8]  # the least of equal rows

    # The odd rows, against components of rows by brute force.
    sets, root = [shingles(t) for _, t, _ in odd_rows], list(range(len(odd_rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            i = len(sets[x] & sets[y])
            if i and 100 * i >= 80 * (len(sets[x]) + len(sets[y]) - i):
                root[find(x)] = find(y)
    groups = defaultdict(list)
    for k, (i, t, _) in enumerate(odd_rows):
        groups[find(k)].append((i is None, i or 0, t))
    assert Counter((r.doc_id, r.text) for r in near(spark, odd, "").collect()) == Counter((None if x else i, t) for x, i, t in map(min, groups.values()))


def test_stages_keep_columns_of_any_name(spark):
    """Whole rows come back from the near-copies stage, whatever the columns are called."""
    import corpus_pipeline

    rng = random.Random(8)
    names = ["key", "of", "id", "rows", "group", "first", "stays", "_key", "_id", "_of", "c0", "component_id", "n_shingles"]
    text = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(40))
    base = text()
    texts = [base, base, base + " more"] + [text() for _ in range(6)] + [None, ""]
    rows = [(k, t, *(f"{n}{k}" for n in names)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)).repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, df, "")
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [r for r in rows if r[0] not in (1, 2)]
