"""Embeddings, vector search, lookups and dimension joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacewise.functions.money import exact_sum
from pacewise.functions.vectors import mean_pool, normalize
from pacewise.operators.joins import join_dimension, salted_join
from pacewise.operators.search import best_matches, compare_hits, search_upserted, top1, upsert
from pacewise.operators.text import (DIMENSIONS, TRIPLE_FACTORS, TRIPLE_MODULUS, embed_different,
                                     from_udf, fuse, pooled)
from pacewise.plans.registry import TXN, event_rows, query, table

WIDTH = 64

_a, _b, _c = TRIPLE_FACTORS


def embedding_sql(source: str, column: str, name: str = "emb") -> str:
    """CTE ``<name>(text, dim, x)``: unit vectors of hashed character triples."""
    return f"""{name}_t AS (SELECT DISTINCT coalesce({column}, '') AS text FROM {source}),
{name}_p AS (SELECT text, ' ' || lower(text) || ' ' AS p FROM {name}_t),
{name}_g AS (SELECT text, ((unicode(substr(p, i, 1)) * {_a} + unicode(substr(p, i + 1, 1)) * {_b}
   + unicode(substr(p, i + 2, 1)) * {_c}) % {TRIPLE_MODULUS}) % {DIMENSIONS} AS dim
  FROM (SELECT text, p, unnest(range(1, length(p) - 1)) AS i FROM {name}_p)),
{name}_n AS (SELECT text, dim, count(*) AS n FROM {name}_g GROUP BY text, dim),
{name} AS (SELECT text, dim, n / sqrt(sum(n * n) OVER (PARTITION BY text)) AS x FROM {name}_n)"""


def _sparse(embedded: DataFrame) -> DataFrame:
    entries = embedded.select("text", F.posexplode("embedding").alias("dim", "x")).where("x <> 0")
    return entries.select("text", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


_SPARSE = "text, CAST(dim AS BIGINT) AS dim, round(x, 6) AS x"


@query("embed_event_types", f"WITH {embedding_sql('events', 'event_type')} SELECT {_SPARSE} FROM emb")
def embed_event_types(spark: SparkSession, sf: str) -> DataFrame:
    return _sparse(embed_different(table(spark, sf, "events"), "event_type"))


@query("embed_part_names", f"WITH {embedding_sql('part', 'p_name')} SELECT {_SPARSE} FROM emb")
def embed_part_names(spark: SparkSession, sf: str) -> DataFrame:
    return _sparse(embed_different(table(spark, sf, "part"), "p_name"))


@query("embed_benchmark_texts", f"WITH {embedding_sql('benchmark', 'text')} SELECT {_SPARSE} FROM emb")
def embed_benchmark_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _sparse(embed_different(table(spark, sf, "benchmark"), "text"))


@query("embed_documents", f"""WITH {embedding_sql('documents', 'text')}
SELECT CAST(dim AS BIGINT) AS dim, count(*) AS texts, round(sum(x), 4) AS weight FROM emb GROUP BY 1""")
def embed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents, embedded once per different text, summed up per dimension."""
    entries = embed_different(table(spark, sf, "documents"), "text").select(
        F.posexplode("embedding").alias("dim", "x")).where("x <> 0")
    return entries.groupBy(F.col("dim").cast("long").alias("dim")).agg(
        F.count(F.lit(1)).alias("texts"), F.round(F.sum("x"), 4).alias("weight"))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _length_and_words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [float(len(t)), float(len(t.split()))])


@query("embed_with_given_udf", """SELECT DISTINCT p_name AS text, CAST(length(p_name) AS DOUBLE) AS x0,
  CAST(len(string_split(p_name, ' ')) AS DOUBLE) AS x1 FROM part""")
def embed_with_given_udf(spark: SparkSession, sf: str) -> DataFrame:
    """The embedder as an argument; here a vectorized Python function."""
    found = embed_different(table(spark, sf, "part"), "p_name", from_udf(_length_and_words))
    return found.select("text", F.col("embedding")[0].cast("double").alias("x0"),
                        F.col("embedding")[1].cast("double").alias("x1"))


# --- vectors --------------------------------------------------------------------

_CENTROID = """cen AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x
  FROM embeddings, range(1, 65) AS r(i) GROUP BY label, i)"""


def _centroids(spark: SparkSession, sf: str) -> DataFrame:
    return pooled(table(spark, sf, "embeddings"), "label")


def _as_references(centroids: DataFrame) -> DataFrame:
    return centroids.select(F.col("label").cast("string").alias("id"), "vector",
                            F.col("label").cast("long").alias("ord"))


@query("centroids", f"WITH {_CENTROID} SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(x, 6) AS x FROM cen")
def centroids(spark: SparkSession, sf: str) -> DataFrame:
    return (_centroids(spark, sf).select("label", F.posexplode("vector").alias("dim", "x"))
            .withColumn("x", F.round("x", 6)))


@query("mean_pool_real_tokens", """WITH p AS (SELECT vec_id, i,
  avg(CAST(embedding[(t - 1) * 16 + i] AS DOUBLE)) FILTER (t <= 1 + vec_id % 4) AS x
  FROM embeddings, range(1, 5) AS a(t), range(1, 17) AS b(i) GROUP BY vec_id, i)
SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, round(x, 6) AS x FROM p""")
def mean_pool_real_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """A vector read as four token vectors of width 16, of which the first ones are real."""
    tokens = F.array(*[F.slice("embedding", 1 + 16 * t, 16) for t in range(4)])
    mask = F.transform(F.sequence(F.lit(1), F.lit(4)),
                       lambda t: F.when(t <= 1 + F.col("vec_id") % 4, 1).otherwise(0))
    return (table(spark, sf, "embeddings")
            .select("vec_id", F.posexplode(mean_pool(tokens, mask)).alias("dim", "x"))
            .withColumn("x", F.round("x", 6)))


@query("normalize_vectors", f"""WITH {_CENTROID} SELECT label, CAST(i - 1 AS INTEGER) AS dim,
  round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM cen""")
def normalize_vectors(spark: SparkSession, sf: str) -> DataFrame:
    unit = _centroids(spark, sf).select("label", normalize(F.col("vector")).alias("v"))
    return unit.select("label", F.posexplode("v").alias("dim", "x")).withColumn("x", F.round("x", 6))


_SCORES = f"""{_CENTROID}, cv AS (SELECT label, list(x ORDER BY i) AS v FROM cen GROUP BY label),
scores AS (SELECT e.vec_id, cv.label, list_inner_product(CAST(e.embedding AS DOUBLE[]), cv.v) AS s
  FROM embeddings e, cv),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS r FROM scores)"""


@query("top1_centroid", f"""WITH {_SCORES} SELECT vec_id, CAST(label AS VARCHAR) AS best_id,
  round(s, 6) AS best_score FROM ranked WHERE r = 1""")
def top1_centroid(spark: SparkSession, sf: str) -> DataFrame:
    found = top1(table(spark, sf, "embeddings"), _as_references(_centroids(spark, sf)), "vec_id")
    return found.select("vec_id", "best_id", F.round("best_score", 6).alias("best_score"))


@query("top3_centroids", f"""WITH {_SCORES} SELECT vec_id, CAST(r AS INTEGER) AS rank,
  CAST(label AS VARCHAR) AS id, round(s, 6) AS score FROM ranked WHERE r <= 3""")
def top3_centroids(spark: SparkSession, sf: str) -> DataFrame:
    found = best_matches(table(spark, sf, "embeddings"), _as_references(_centroids(spark, sf)), "vec_id", k=3)
    return found.select("vec_id", F.posexplode("hits").alias("pos", "hit")).select(
        "vec_id", (F.col("pos") + 1).alias("rank"), F.col("hit.id").alias("id"),
        F.round("hit.score", 6).alias("score"))


# Every vector is a record of its label; only the last per label stays.
_UPSERT = """ups AS (SELECT label, arg_max(vec_id, vec_id) AS last_id, min(vec_id) AS ord,
  arg_max(embedding, vec_id) AS v FROM embeddings GROUP BY label)"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("id"), F.col("embedding").alias("vector"),
        F.col("vec_id").alias("record"), F.col("vec_id").alias("seq"))


@query("upsert_last_wins", f"WITH {_UPSERT} SELECT CAST(label AS VARCHAR) AS id, last_id AS record, ord FROM ups")
def upsert_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return upsert(_records(spark, sf)).select("id", "record", "ord")


_UPSERT_HITS = f"""{_UPSERT}, scores AS (SELECT e.vec_id, ups.label, ups.ord,
  list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(ups.v AS DOUBLE[])) AS s FROM embeddings e, ups),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, ord) AS r FROM scores)"""


@query("search_upserted", f"""WITH {_UPSERT_HITS} SELECT vec_id, CAST(label AS VARCHAR) AS best_id,
  round(s, 6) AS best_score FROM ranked WHERE r = 1""")
def search_upserted_records(spark: SparkSession, sf: str) -> DataFrame:
    found = search_upserted(table(spark, sf, "embeddings"), _records(spark, sf), "vec_id")
    return found.select("vec_id", "best_id", F.round("best_score", 6).alias("best_score"))


@query("search_nothing", "SELECT vec_id, CAST(NULL AS VARCHAR) AS best_id, CAST(NULL AS DOUBLE) AS best_score FROM embeddings")
def search_nothing(spark: SparkSession, sf: str) -> DataFrame:
    none = _records(spark, sf).where("record < 0")
    return search_upserted(table(spark, sf, "embeddings"), none, "vec_id").select(
        "vec_id", "best_id", "best_score")


@query("compare_searches", """SELECT count(*) AS queries, count(*) AS agree,
  CAST(0 AS DOUBLE) AS max_score_delta FROM embeddings""")
def compare_searches(spark: SparkSession, sf: str) -> DataFrame:
    """The same search with one matrix and with the references split into blocks."""
    queries = table(spark, sf, "embeddings")
    references = _as_references(_centroids(spark, sf))
    whole = top1(queries, references, "vec_id")
    blocks = top1(queries, references, "vec_id", matrix_bytes=2048)
    return compare_hits(whole, blocks, "vec_id").withColumn(
        "max_score_delta", F.round("max_score_delta", 9))


# --- lookups and dimension joins ---------------------------------------------------

TYPE_SCORES = f"""{embedding_sql('events', 'event_type', 'q')}, {embedding_sql('part', 'p_name', 'c')},
best AS (SELECT text, max(s) AS score FROM (
  SELECT q.text, c.text AS id, sum(q.x * c.x) AS s FROM q JOIN c USING (dim) GROUP BY q.text, c.text)
  GROUP BY text)"""


def type_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Best similarity of each event type to a part name."""
    names = embed_different(table(spark, sf, "part"), "p_name").select(
        F.col("text").alias("id"), F.col("embedding").alias("vector"), F.xxhash64("text").alias("ord"))
    found = top1(embed_different(table(spark, sf, "events"), "event_type"), names, "text_key")
    return found.select("text_key", "text", F.col("best_score").alias("score"))


@query("lookup_text_score", f"""WITH {TYPE_SCORES} SELECT e.event_id, round(best.score, 6) AS score
FROM events e LEFT JOIN best ON best.text = e.event_type""")
def lookup_text_score(spark: SparkSession, sf: str) -> DataFrame:
    scores = type_scores(spark, sf).select(F.col("text").alias("event_type"), "score")
    return join_dimension(table(spark, sf, "events"), scores, "event_type").select(
        "event_id", F.round("score", 6).alias("score"))


@query("fuse_text_similarity", f"""WITH {TXN}, {TYPE_SCORES}
SELECT seq, account, merchant, round(best.score, 6) AS text_similarity
FROM txn JOIN best ON best.text = txn.merchant""")
def fuse_text_similarity(spark: SparkSession, sf: str) -> DataFrame:
    fused = fuse(event_rows(spark, sf), "merchant", type_scores(spark, sf))
    return fused.select("seq", "account", "merchant", F.round("text_similarity", 6).alias("text_similarity"))


@query("label_join", """SELECT d.doc_id, d.source, l.quality, l.toxic
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def label_join(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "source")
    return join_dimension(documents, table(spark, sf, "labels"), "doc_id")


@query("dimension_join", """SELECT n_name, count(*) AS orders,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def dimension_join(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    joined = join_dimension(table(spark, sf, "orders"), customers, "o_custkey", "inner")
    joined = join_dimension(joined, nations, "c_nationkey", "inner")
    return joined.groupBy("n_name").agg(
        F.count(F.lit(1)).alias("orders"),
        exact_sum(F.col("o_totalprice")).alias("total"))


@query("dimension_join_hot_keys", """SELECT l_orderkey, l_linenumber, l_suppkey, s_name, s_nationkey
FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def dimension_join_hot_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A dimension treated as too large to broadcast; suppliers of 500 lines count as hot."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("long").alias("l_suppkey"), "s_name", "s_nationkey")
    return salted_join(lines, suppliers, "l_suppkey", "left", hot_rows=500)
