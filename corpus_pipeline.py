"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next stage's ``docs``.  All but the last return
the columns that they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm.common import settle, small_batches, table
from flowspark.llm.jaccard import jaccard_join
from flowspark.llm.mixing import mixed
from flowspark.llm.packing import pack_documents
from flowspark.llm.queries import tokenizer_path
from flowspark.llm.secrets import redact
from flowspark.llm.toxicity import fit_toxicity, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; null and empty texts and null ids are judged like all others.

    Columns keep their values whatever their names (``score``, say).
    """
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    held = docs.toDF(*[f"_{k}" for k in range(len(docs.columns))])
    scored = score_toxicity(held, model, text_col=f"_{docs.columns.index('text')}").filter("score < 0.5")
    return scored.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that with the least id, nulls last.

    Rows are judged one by one, by id and a 64-bit hash of id and text, not by
    the id alone: a row with a null or repeated id goes only if it is itself in
    a group.  Rows with one id and one text are a group, of which one stays
    (the least by its other columns); rows without words are in no group.
    """
    small_batches(spark)
    own = [f"c{k}" for k in range(len(docs.columns))]
    id_, text = (own[docs.columns.index(c)] for c in ("doc_id", "text"))
    keyed = docs.toDF(*own).withColumn("key", F.xxhash64(id_, text))
    rows = keyed.groupBy(F.col(id_).alias("id"), F.col("key").alias("of")).agg(F.count(F.lit(1)).alias("rows"))
    found = jaccard_join(keyed, id_col="key", text_col=text).filter("n_shingles > 0").select("key", "component_id").distinct()
    found = settle(found.join(rows, F.col("key") == F.col("of")).drop("key"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "of")).alias("first")
    groups = found.groupBy(F.col("component_id").alias("group")).agg(first, F.sum("rows").alias("all")).filter("all > 1").select("group", "first.id", "first.of")
    stays = F.col("f.id").eqNullSafe(F.col("g.id")) & (F.col("f.of") == F.col("g.of"))
    fate = found.alias("f").join(groups.alias("g"), F.col("component_id") == F.col("group")).select("f.id", "f.of", "rows", stays.alias("stays"))
    fate = settle(fate.filter("not stays or rows > 1"))
    same = (F.col("key") == F.col("of")) & F.col(id_).eqNullSafe(F.col("id"))
    kept = keyed.join(fate, same, "left_anti").select(*own)
    often = keyed.join(fate.filter("stays"), same, "left_semi")
    once = often.groupBy(id_, "key").agg(F.min(F.struct(*own)).alias("row")).select("row.*")
    return kept.unionByName(once).toDF(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of secrets give way to a mark; ``n_chars`` follows the text.  Every row stays, those with null or empty texts as they are."""
    small_batches(spark)
    clean = redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; a row comes as often as the mix takes it, up to three times.

    Rows without words go, as their size is 0; null sources are one source;
    rows alike in id, text and source are rows of their own.
    """
    small_batches(spark)
    return mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2048; a null or empty text has its end id only, and equal rows each their own pieces."""
    small_batches(spark)
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix),
    ("packing", pack),
]
#: The toxicity model and the tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
