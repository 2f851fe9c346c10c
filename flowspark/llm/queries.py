"""The thin queries over the driver's tables: one for each operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, shared_dir, table


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_path(name: str) -> str:
    """A file of the public tokenizers that are installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import substring_dedup

    kept = substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import BASE_RULES, find_secrets

    found = find_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in BASE_RULES]

    def of(kind):
        return F.filter("spans", lambda s: s["kind"] == kind)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    only_base = F.filter("spans", lambda s: s["kind"].isin(base))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(only_base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .idfile import read_ids, write_ids

    path = f"{shared_dir(spark)}/flowspark/{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return read_ids(spark, path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import place

    docs = table(spark, sf_dir, "documents").select("doc_id")
    return place(docs, [f"shard-{k:03d}" for k in range(128)])


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    held_out = (crc32_of_id("doc_id") % 5 == 0).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_plain", "n_near", "n_quoted")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import phrases

    return phrases(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefixes import prefix_trie, shared_heads, turns_of

    return prefix_trie(*shared_heads(turns_of(table(spark, sf_dir, "conversations"))))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_decode, bpe_encode

    path = tokenizer_path("byte_bpe_50k.json")
    both = bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), path), path)
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return both.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_substrings, op3_secrets, op4_token_files, op5_sharding, op6_jaccard, op7_toxicity, op8_packing, op9_top_k, op10_quality_rules, op11_phrases, op12_prefix_trie, op13_bpe)}
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_substrings": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
        x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
        m AS (SELECT g, min(doc_id) AS least FROM x GROUP BY g),
        hit AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS i FROM x JOIN m USING (g) WHERE doc_id > least),
        t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
        k AS (SELECT t.doc_id, count(hit.i) AS gone, string_agg(word, ' ' ORDER BY t.i) FILTER (WHERE hit.i IS NULL) AS kept
              FROM t LEFT JOIN hit ON t.doc_id = hit.doc_id AND t.i = hit.i GROUP BY t.doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op6_jaccard": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
        r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id
        FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""",
    "op9_top_k": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score, q.r
            FROM v q JOIN v c ON q.r <> c.r AND q.vec_id % 50 = 0 AND len(q.e) = len(c.e)
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_phrases": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
                          unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
        g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS w FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) AS v(k) WHERE len(w) >= k)),
        f AS MATERIALIZED (SELECT lang, k, w, count(*) AS f FROM g GROUP BY ALL),
        t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT *, string_split(w, ' ') AS words FROM f WHERE k > 1 AND f >= 10),
        cut AS (SELECT lang, w, f, cut_at, array_to_string(words[:cut_at], ' ') AS x, array_to_string(words[cut_at + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS cut_at FROM c)),
        s AS (SELECT cut.lang, cut.w, cut.f AS a, cut_at, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * cut.f * cut.f // (x.f::HUGEINT * y.f) AS BIGINT) AS score
              FROM cut JOIN f x ON x.lang = cut.lang AND x.w = cut.x JOIN f y ON y.lang = cut.lang AND y.w = cut.y),
        low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, cut_at) = 1),
        inside AS (SELECT lang, array_to_string(words[:2], ' ') AS w, f FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(words[2:], ' ') AS w, f FROM c WHERE k = 3),
        longer AS (SELECT lang, w, max(f) AS most FROM inside GROUP BY ALL),
        o AS (SELECT low.lang, low.w AS phrase, a, l, r, n, score FROM low JOIN t USING (lang) LEFT JOIN longer ON longer.lang = low.lang AND longer.w = low.w
              WHERE most IS NULL OR 100 * most < 50 * a)
        SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o) WHERE rank <= 2000""",
    "op12_prefix_trie": """
        WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS turn
                   FROM conversations WHERE conv_id IS NOT NULL),
        b AS (SELECT DISTINCT conv_id, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS steps FROM t),
        h AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295], steps), lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END), 4294967295) % 9 AS h FROM b),
        r AS (SELECT h.conv_id, 0 AS own, pos, turn FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 5 AND pos <= h
              UNION ALL SELECT h.conv_id, 1, pos, turn FROM h JOIN t ON t.conv_id = h.conv_id AND pos > h),
        s AS (SELECT h.conv_id, coalesce(list(turn ORDER BY own, pos) FILTER (WHERE pos IS NOT NULL), []) AS seq FROM h LEFT JOIN r USING (conv_id) GROUP BY h.conv_id),
        m AS (SELECT conv_id, d, seq[:d] AS key, len(seq) = d AS ends FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM s)),
        n AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends FROM m GROUP BY key, d),
        k AS (SELECT key[:d - 1] AS key, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
        v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n - 1) * octet_length(encode(n.key[-1].text)) END AS saved FROM n LEFT JOIN k ON k.key = n.key AND k.d = n.d),
        u AS (SELECT key[:upto] AS key, upto AS d, sum(saved) AS saved, sum(CAST(n_children = 0 AS INT)) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS upto FROM v) GROUP BY ALL)
        SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n AS n_convs, CAST(v.n_children AS BIGINT) AS n_children, CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
        FROM v JOIN u ON u.key = v.key AND u.d = v.d LEFT JOIN n p ON v.d > 0 AND p.d = v.d - 1 AND p.key = v.key[:v.d - 1]""",
}
