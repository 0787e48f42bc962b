"""Search queries over documents, benchmark and embeddings.

The tables link no text to a vector: document n is paired with vector n, and vector 7
stands for the embedded query. Both pairings are arbitrary and only exercise the operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..sources.tables import table
from .registry import query

TERMS = "the of ination"


def _bm25_sql(terms: str = TERMS) -> str:
    words = sorted(set(terms.split()))
    tf = ", ".join(f"len(list_filter(t, lambda w: w = '{w}')) AS tf{k}" for k, w in enumerate(words))
    stats = ", ".join(f"count(*) FILTER (tf{k} > 0) AS df{k}" for k in range(len(words)))
    score = " + ".join(
        f"CASE WHEN tf{k} > 0 THEN ln(1 + (n - df{k} + 0.5) / (df{k} + 0.5)) * tf{k} * 2.5 / (tf{k} + 1.5 * (0.25 + 0.75 * length / greatest(mean, 1.0))) ELSE 0.0 END" for k in range(len(words))
    )
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents),
c AS (SELECT doc_id, len(t) AS length, {tf} FROM t), s AS (SELECT count(*) AS n, avg(length) AS mean, {stats} FROM c),
b AS (SELECT doc_id, 0.0::DOUBLE + {score} AS bm25 FROM c, s)"""


@query(_bm25_sql() + " SELECT doc_id, round(bm25, 6) AS bm25 FROM b WHERE bm25 > 0")
def bm25_search(spark, sf_dir):
    return R.bm25(table(spark, sf_dir, "documents"), TERMS).where("bm25 > 0").select("doc_id", F.round("bm25", 6).alias("bm25"))


def _query_vector(spark, sf_dir, vec_id: int = 7):
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("query"))


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


@query(
    f"""SELECT e.vec_id, round({_DOT.format(a='e.embedding', b='q.embedding')}, 6) AS cosine
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY cosine DESC, vec_id LIMIT 20"""
)
def cosine_topk(spark, sf_dir):
    scored = R.against_vector(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir)).select("vec_id", F.round("cosine", 6).alias("cosine"))
    return scored.orderBy(F.desc("cosine"), "vec_id").limit(20)


def _paired(spark, sf_dir):
    lexical = R.bm25(table(spark, sf_dir, "documents"), TERMS)
    vectors = R.against_vector(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir)).select(F.col("vec_id").alias("doc_id"), "cosine")
    return lexical.join(vectors, "doc_id")


_HYBRID = (
    _bm25_sql()
    + f""", v AS (SELECT e.vec_id AS doc_id, {_DOT.format(a='e.embedding', b='q.embedding')} AS cosine
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q),
p AS (SELECT b.doc_id, bm25, cosine FROM b JOIN v USING (doc_id)), m AS (SELECT max(bm25) AS best FROM p),
h AS (SELECT doc_id, bm25, cosine, 0.65 * greatest(0, least(1, (cosine + 1) / 2)) + 0.35 * CASE WHEN best > 0 THEN bm25 / best ELSE 0 END AS score FROM p, m)"""
)


@query(_HYBRID + " SELECT doc_id, round(bm25, 6) AS bm25, round(cosine, 6) AS cosine, round(score, 6) AS score FROM h ORDER BY round(score, 6) DESC, doc_id LIMIT 25")
def hybrid_search(spark, sf_dir):
    scored = R.hybrid(_paired(spark, sf_dir)).select("doc_id", *[F.round(c, 6).alias(c) for c in ("bm25", "cosine", "score")])
    return scored.orderBy(F.desc("score"), "doc_id").limit(25)


@query(
    _HYBRID
    + """, l AS (SELECT h.*, d.lang FROM h JOIN documents d USING (doc_id))
SELECT doc_id, round(greatest(0, least(1, score + CASE WHEN lang = 'en' THEN 0.18 ELSE 0 END)), 6) AS score FROM l"""
)
def boosted_search(spark, sf_dir):
    """The blend with 0.18 added for the preferred class (here: English), clipped to 0..1."""
    pairs = _paired(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return R.hybrid(pairs, boost=F.when(F.col("lang") == "en", 0.18).otherwise(0.0)).select("doc_id", F.round("score", 6).alias("score"))


@query(
    _HYBRID
    + """, l AS (SELECT h.*, d.lang FROM h JOIN documents d USING (doc_id) WHERE d.lang = 'fr')
SELECT doc_id, round(score, 6) AS score FROM l ORDER BY round(score, 6) DESC, doc_id LIMIT 10"""
)
def class_filtered_search(spark, sf_dir):
    """The blend with a hard class filter (here: French) and the best ten."""
    hits = R.hybrid(_paired(spark, sf_dir)).join(table(spark, sf_dir, "documents").where("lang = 'fr'").select("doc_id"), "doc_id")
    return hits.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@query(
    f"""WITH q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id IN (3, 7, 11)),
s AS (SELECT e.vec_id, q.query_id, round({_DOT.format(a='e.embedding', b='q.query')}, 6) AS score FROM embeddings e, q)
SELECT vec_id, max(score) AS score, arg_min(query_id, (-score, query_id)) AS matched_query FROM s GROUP BY vec_id"""
)
def multi_query_argmax(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    queries = e.where(F.col("vec_id").isin(3, 7, 11)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return R.best_query(R.against_vector(e, queries).withColumn("score", F.round("cosine", 6)), "vec_id")


# The searches with every vector whose id is divisible by 20 as a query, against all rows.


def _query_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.lit(0.0).alias("base"))


def _documents(spark, sf_dir):
    """All documents, also those without a vector of their number; base is the share of the text in the score."""
    lexical = R.bm25(table(spark, sf_dir, "documents"), TERMS)
    best = lexical.agg(F.max("bm25").alias("best"))
    base = F.when(F.col("best") > 0, 0.35 * F.col("bm25") / F.col("best")).otherwise(0.0)
    scored = lexical.crossJoin(F.broadcast(best)).select(F.col("doc_id").alias("id"), base.alias("base"))
    return scored.join(_vectors(spark, sf_dir).drop("base"), "id", "left")


def _langs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")


@query()
def cosine_topk_all(spark, sf_dir):
    return R.top_per_query(_vectors(spark, sf_dir), _query_vectors(spark, sf_dir), 20).select("query_id", F.col("id").alias("vec_id"), F.col("score").alias("cosine"))


@query()
def hybrid_search_all(spark, sf_dir):
    return R.top_per_query(_documents(spark, sf_dir), _query_vectors(spark, sf_dir), 25, 0.65).withColumnRenamed("id", "doc_id")


@query()
def boosted_search_all(spark, sf_dir):
    d = _documents(spark, sf_dir).join(_langs(spark, sf_dir), "id").withColumn("base", F.col("base") + F.when(F.col("lang") == "en", 0.18).otherwise(0.0))
    return R.top_per_query(d, _query_vectors(spark, sf_dir), 25, 0.65, clip=True).withColumnRenamed("id", "doc_id")


@query()
def class_filtered_search_all(spark, sf_dir):
    d = _documents(spark, sf_dir).join(_langs(spark, sf_dir).where("lang = 'fr'"), "id")
    return R.top_per_query(d, _query_vectors(spark, sf_dir), 10, 0.65).withColumnRenamed("id", "doc_id")


@query()
def multi_query_argmax_all(spark, sf_dir):
    """Every vector takes the place of a query, and the best query that of its best item."""
    queries = _query_vectors(spark, sf_dir).select(F.col("query_id").alias("id"), F.col("query").alias("vector"), F.lit(0.0).alias("base"))
    best = R.top_per_query(queries, _vectors(spark, sf_dir).select(F.col("id").alias("query_id"), F.col("vector").alias("query")), 1)
    return best.select(F.col("query_id").alias("vec_id"), "score", F.col("id").alias("matched_query"))


_SAMPLES = [
    "High press through the centre", "press near the touchline", "compact low block near the penalty area", "left touchline trap", "Deep-block", "free kick",
    "mid block", "right flank pressure", "left and right", "throw-in", "anything else", "pressing on the wing",
]
_RE = lambda p: p.replace("\\", "\\\\").replace("'", "''")


@query(
    "WITH q AS (SELECT unnest(["
    + ", ".join(f"'{s}'" for s in _SAMPLES)
    + "]) AS query), c AS (SELECT query, replace(lower(query), '-', ' ') AS clean FROM q) SELECT query, regexp_matches(clean, '"
    + T.INTENTS[0][1]
    + "') AS unsupported, CASE WHEN regexp_matches(clean, '"
    + T.INTENTS[0][1]
    + "') THEN NULL "
    + " ".join(f"WHEN regexp_matches(clean, '{p}') THEN '{label}'" for label, p in T.INTENTS[1:])
    + " END AS preferred FROM c"
)
def intent_route(spark, sf_dir):
    q = spark.createDataFrame([(s,) for s in _SAMPLES], "query string")
    unsupported, preferred = T.intent(F.col("query"))
    return q.select("query", unsupported.alias("unsupported"), preferred.alias("preferred"))


@query(
    "WITH q AS (SELECT unnest(["
    + ", ".join(f"'{s}'" for s in _SAMPLES)
    + """]) AS query), w AS (SELECT query, string_split(replace(lower(query), '-', ' '), ' ') AS words FROM q),
s AS (SELECT query, words, CASE WHEN list_contains(words, 'left') AND NOT list_contains(words, 'right') THEN 'left'
  WHEN list_contains(words, 'right') AND NOT list_contains(words, 'left') THEN 'right' END AS side FROM w)
SELECT query, CASE WHEN list_has_any(words, ['press', 'pressing', 'pressure', 'trap', 'touchline', 'flank']) THEN 'trap_' || side END AS flank,
CASE WHEN side IS NULL THEN query ELSE query || '. ' || upper(side[1]) || side[2:] || ' touchline trap. Pressure is concentrated around the ' || side ||
' touchline with defenders positioned inside the ball. Tactical class: trap ' || side || '.' END AS expanded FROM s"""
)
def query_expansion(spark, sf_dir):
    q = spark.createDataFrame([(s,) for s in _SAMPLES], "query string")
    return q.select("query", T.flank_class(F.col("query")).alias("flank"), T.expand_query(F.col("query")).alias("expanded"))


@query(
    """SELECT lang, sum(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')))::BIGINT AS n_tokens, count(*) AS n_docs,
max(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS longest FROM documents GROUP BY lang"""
)
def token_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.size(T.tokens(F.coalesce("text", F.lit("")))).cast("long").alias("n"))
    return d.groupBy("lang").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_docs"), F.max("n").alias("longest"))


@query(
    """SELECT doc_id, lang || '. ' || source || CASE WHEN n_chars > 3000 THEN '. long' ELSE '' END AS document FROM documents"""
)
def retrieval_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.retrieval_text(F.col("lang"), F.col("source"), F.when(F.col("n_chars") > 3000, "long")).alias("document"))
