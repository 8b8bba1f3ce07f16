"""Knowledge-base queries: search, hydration, chunks, lists and upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heron.functions import vectors as V
from heron.operators import chunking, clusters, library, relational
from heron.operators import vectors as search
from heron.plans.base import Plans, shared_root, table
from heron.sources import buckets, files

PLANS = Plans()


def vector_of(vectors: DataFrame, vec_id: int) -> list[float]:
    """One row: the query vector, which stands in the plan as a literal."""
    row = vectors.where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]] if row else [0.0]


_SCORED = """scored AS (
  SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score
  FROM embeddings)"""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@PLANS.query(f"WITH {_SCORED} SELECT vec_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, vec_id LIMIT 5")
def kb_search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return _rounded(search.search(v, vector_of(v, 0)), "score")


@PLANS.query(
    f"""WITH {_SCORED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM scored)
    SELECT label, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 3"""
)
def kb_search_per_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return _rounded(search.search_each(v, vector_of(v, 0), "label", 3), "score")


@PLANS.query(
    f"""WITH {_SCORED}, best AS (SELECT vec_id, score FROM scored ORDER BY score DESC, vec_id LIMIT 20)
    SELECT vec_id, round(score, 6) AS score FROM best WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"""
)
def kb_search_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    deleted = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return _rounded(search.drop_deleted(search.search(v, vector_of(v, 0), 20), deleted), "score")


@PLANS.query(f"WITH {_SCORED} SELECT vec_id, round(score, 6) AS score FROM scored WHERE score >= 0.2 ORDER BY scored.score DESC, vec_id LIMIT 25")
def kb_search_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return _rounded(search.search(v, vector_of(v, 0), 25, min_score=0.2), "score")


@PLANS.query(
    """WITH scored AS (SELECT vec_id, list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings)
    SELECT vec_id, round(score, 6) AS score FROM scored ORDER BY scored.score, vec_id LIMIT 10"""
)
def vector_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return _rounded(search.search(v, vector_of(v, 0), 10, metric="euclidean"), "score")


@PLANS.query(
    """SELECT min(len(embedding))::INTEGER AS min_dim, max(len(embedding))::INTEGER AS max_dim,
    count(*) FILTER (WHERE list_max(list_transform(embedding, lambda x: abs(x))) = 0) AS zero_vectors,
    count(*) FILTER (WHERE NOT list_bool_and(list_transform(embedding, lambda x: isfinite(x)))) AS invalid_vectors, count(*) AS n FROM embeddings"""
)
def embedding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.statistics(table(spark, sf_dir, "embeddings"))


@PLANS.query(
    f"""WITH {_SCORED}, best AS (SELECT vec_id, score FROM scored ORDER BY score DESC, vec_id LIMIT 10)
    SELECT vec_id, round(score, 6) AS score, doc_id, source, lang FROM best JOIN documents ON doc_id = vec_id"""
)
def kb_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    chunks = v.select("vec_id", F.col("vec_id").alias("doc_id"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return _rounded(search.hydrate(search.search(v, vector_of(v, 0), 10), chunks, docs), "score").select("vec_id", "score", "doc_id", "source", "lang")


@PLANS.query(
    """SELECT hit_id, vec_id, round(score, 6) AS score FROM (
      SELECT q.vec_id AS hit_id, v.vec_id AS vec_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
      FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id) WHERE score > 0.3"""
)
def vector_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against the query set: the rows whose id is divisible by 20, in blocks."""
    v = table(spark, sf_dir, "embeddings")
    return _rounded(search.similar_to_set(v, v.where("vec_id % 20 = 0"), threshold=0.3), "score")


_PAIRS = """pairs AS (SELECT q.vec_id AS hit_id, v.vec_id, v.label, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
  FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)"""


@PLANS.query(f"WITH {_PAIRS} SELECT hit_id, vec_id, round(score, 6) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY hit_id ORDER BY score DESC, vec_id) AS r FROM pairs) WHERE r <= 5")
def vector_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every query: the rows whose id is divisible by 20, against all."""
    v = table(spark, sf_dir, "embeddings")
    return _rounded(search.nearest_to_each(v, v.where("vec_id % 20 = 0"), 5), "score")


@PLANS.query(f"WITH {_PAIRS} SELECT hit_id, CAST(label AS VARCHAR) AS label, vec_id, round(score, 6) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY hit_id, label ORDER BY score DESC, vec_id) AS r FROM pairs) WHERE r <= 3")
def vector_nearest_per_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest of each knowledge base, for every query."""
    v = table(spark, sf_dir, "embeddings")
    return _rounded(search.nearest_to_each(v, v.where("vec_id % 20 = 0"), 3, group="label"), "score")


@PLANS.query(
    """WITH v AS (SELECT vec_id, CASE WHEN label = 9 THEN list_transform(embedding, lambda x: -x::DOUBLE) ELSE embedding::DOUBLE[] END AS v FROM embeddings WHERE vec_id % 50 <> 3),
    pairs AS (SELECT q.vec_id AS hit_id, v.vec_id, list_cosine_similarity(v.v, q.embedding::DOUBLE[]) AS score FROM embeddings q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
    SELECT hit_id, vec_id, round(score, 6) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY hit_id ORDER BY score DESC, vec_id) AS r FROM pairs) WHERE r <= 5"""
)
def vector_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from clusters and a delta: vectors of label 9 are replaced, and some go, after the clustering. The nearest
    clusters are read first, then those that may hold something better."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    stored = clusters.ClusteredVectors.write(v, f"{shared_root(spark)}/clusters-{uuid.uuid4().hex}", 16, rounds=3)
    stored.add(v.where("label = 9").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding")), 1)
    stored.add(v.where("vec_id % 50 = 3").select("vec_id", F.lit(None).cast("array<float>").alias("embedding")), 2)
    return _rounded(stored.nearest_to_each(v.where("vec_id % 20 = 0"), 5, probes=4, exact=True), "score")


_DIGEST = "md5(array_to_string(list_transform({v}, lambda x: CAST(round(x::DOUBLE * 1000000) AS BIGINT)), ','))"


def _digest(v) -> Column:
    """All elements of a vector."""
    return F.md5(F.array_join(F.transform(v, lambda x: F.round(x.cast("double") * 1000000).cast("long").cast("string")), ","))


@PLANS.query(
    f"""WITH v AS (SELECT label AS kb_id, vec_id AS chunk_id, CASE WHEN label = 1 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS v FROM embeddings WHERE NOT (label = 2 AND vec_id % 2 = 0)
      UNION ALL SELECT 77, vec_id, embedding FROM embeddings WHERE label = 3)
    SELECT kb_id, chunk_id, {_DIGEST.format(v="v")} AS vector_md5 FROM v WHERE kb_id IN (1, 2, 3, 77)"""
)
def vector_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by knowledge base and bucket: one is updated, half of another deleted, a new one made; four are read."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("kb_id"), "embedding")
    t = buckets.BucketTable(spark, f"{shared_root(spark)}/buckets-{uuid.uuid4().hex}", v.schema, buckets=4)
    t.upsert(v)
    t.upsert(v.where("kb_id = 1").withColumn("embedding", F.transform("embedding", lambda x: -x)).unionByName(v.where("kb_id = 3").withColumn("kb_id", F.lit(77))))
    t.delete(v.where("kb_id = 2 and chunk_id % 2 = 0"))
    return t.read().where("kb_id in (1, 2, 3, 77)").select("kb_id", "chunk_id", _digest(F.col("embedding")).alias("vector_md5"))


@PLANS.query(
    f"""WITH {_SCORED} SELECT vec_id, round(score, 6) AS score FROM scored WHERE label = 3 AND score >= 0.0 ORDER BY scored.score DESC, vec_id LIMIT 5"""
)
def library_search_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return _rounded(library.search_own(v, vector_of(v, 0), F.col("label") == 3, min_score=0.0), "score")


@PLANS.query(
    f"""WITH {_SCORED} SELECT vec_id, round(score, 6) AS score FROM scored WHERE score >= 0.1 AND vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)
    ORDER BY scored.score DESC, vec_id LIMIT 10"""
)
def library_search_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    poor = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("vec_id"), F.lit(True).alias("_poor"))
    items = v.join(poor.distinct(), "vec_id", "left")
    return _rounded(library.search_public(items, vector_of(v, 0), F.col("_poor").isNull(), min_score=0.1), "score")


@PLANS.query("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def vector_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"))
    return library.orphans(table(spark, sf_dir, "embeddings").select("vec_id", "label"), parents, "vec_id")


@PLANS.query("SELECT source, count(*) AS n_documents, count(l.doc_id) AS n_labelled FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY source")
def kb_list_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("one")).distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.join(labelled, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n_documents"), F.count("one").alias("n_labelled"))


@PLANS.query("SELECT doc_id, source, lang FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def doc_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.page(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["doc_id"], 100, 50)


# A line is a paragraph here, as the documents have no blank lines; words are those between ASCII white space.
_PARTS = r"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
worded AS (SELECT doc_id, i, line, list_filter(string_split_regex(line, '[ \t\n\x0b\f\r]+'), lambda w: w <> '') AS w FROM lines),
parts AS (
  SELECT doc_id, i, 0 AS k, line AS content, len(w) AS n, false AS alone FROM worded WHERE len(w) BETWEEN 1 AND {size}
  UNION ALL
  SELECT doc_id, i, k, array_to_string(list_slice(w, k * {size} + 1, (k + 1) * {size}), ' '), len(list_slice(w, k * {size} + 1, (k + 1) * {size})), true
  FROM (SELECT doc_id, i, w, unnest(range((len(w) + {size} - 1) // {size})) AS k FROM worded WHERE len(w) > {size})),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS p FROM parts),
packed AS (
  SELECT doc_id, p, content, n, alone, n AS used, 0 AS chunk FROM numbered WHERE p = 1
  UNION ALL
  SELECT b.doc_id, b.p, b.content, b.n, b.alone,
    CASE WHEN a.alone OR b.alone OR a.used + b.n > {size} THEN b.n ELSE a.used + b.n END,
    CASE WHEN a.alone OR b.alone OR a.used + b.n > {size} THEN a.chunk + 1 ELSE a.chunk END
  FROM packed a JOIN numbered b ON b.doc_id = a.doc_id AND b.p = a.p + 1),
chunks AS (SELECT doc_id, chunk, string_agg(content, chr(10) ORDER BY p) AS content, sum(n) AS n FROM packed GROUP BY doc_id, chunk),
placed AS (SELECT *, max(chunk) OVER (PARTITION BY doc_id) AS last,
  sum(strlen(content)) OVER (PARTITION BY doc_id ORDER BY chunk) AS end_offset FROM chunks),
small AS (SELECT doc_id, last FROM placed WHERE chunk = last AND last > 0 AND n < {least})"""
_PACK = (
    "WITH RECURSIVE "
    + _PARTS.format(size=100, least=20)
    + """
SELECT doc_id, CAST(CASE WHEN s.last IS NOT NULL AND chunk = s.last THEN chunk - 1 ELSE chunk END AS INTEGER) AS chunk_index,
  CAST(sum(n) AS INTEGER) AS n_tokens, md5(string_agg(content, chr(10) ORDER BY chunk)) AS content_md5,
  CAST(min(end_offset - strlen(content)) AS INTEGER) AS start_offset, CAST(max(end_offset) AS INTEGER) AS end_offset
FROM placed LEFT JOIN small s USING (doc_id) GROUP BY ALL"""
)


@PLANS.query(_PACK)
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_documents(table(spark, sf_dir, "documents"), size=100, overlap=0, least=20, by_line=True)
    return chunks.select("doc_id", "chunk_index", "n_tokens", F.md5("content").alias("content_md5"), "start_offset", "end_offset")


_OVERLAP = (
    "WITH RECURSIVE "
    + _PARTS.format(size=100, least=0)
    + """,
tails AS (SELECT p.doc_id, p.chunk, p.content, p.alone, p.p, sum(p.n) OVER (PARTITION BY p.doc_id, p.chunk ORDER BY p.p DESC) AS kept FROM packed p),
backs AS (SELECT c.doc_id, c.chunk, CASE WHEN bool_or(t.alone) THEN 0 ELSE coalesce(sum(strlen(t.content) + 2) FILTER (WHERE t.kept <= 30), 0) END AS back FROM chunks c JOIN tails t USING (doc_id, chunk) GROUP BY ALL),
moved AS (SELECT doc_id, chunk, n, content, strlen(content) AS size, sum(strlen(content) - back) OVER (PARTITION BY doc_id ORDER BY chunk) - (strlen(content) - back) AS start FROM chunks JOIN backs USING (doc_id, chunk))
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk_index, CAST(n AS INTEGER) AS n_tokens, CAST(start AS INTEGER) AS start_offset, CAST(start + size AS INTEGER) AS end_offset FROM moved"""
)


@PLANS.query(
    "WITH RECURSIVE "
    + _PARTS.format(size=100, least=20).replace("string_agg(content, chr(10) ORDER BY p)", "string_agg(content, chr(10) || chr(10) ORDER BY p)")
    + """
SELECT doc_id, CAST(CASE WHEN s.last IS NOT NULL AND chunk = s.last THEN chunk - 1 ELSE chunk END AS INTEGER) AS chunk_index, CAST(2 * sum(n) AS INTEGER) AS n_tokens,
  md5(string_agg(content, chr(10) || chr(10) ORDER BY chunk)) AS content_md5, CAST(min(end_offset - strlen(content)) AS INTEGER) AS start_offset, CAST(max(end_offset) AS INTEGER) AS end_offset
FROM placed LEFT JOIN small s USING (doc_id) GROUP BY ALL"""
)
def chunk_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs between blank lines, counted by a tokenizer that is given: each word has two tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n \n")).alias("text"))
    chunks = chunking.chunk_documents(docs, size=200, overlap=0, least=40, count=lambda texts: [2 * len(t.split()) for t in texts])
    return chunks.select("doc_id", "chunk_index", "n_tokens", F.md5("content").alias("content_md5"), "start_offset", "end_offset")


@PLANS.query(
    f"""SELECT vec_id, 4 * len(embedding)::INTEGER AS n_bytes, {_DIGEST.format(v="embedding")} AS vector_md5,
      round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings"""
)
def vector_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as blobs and back, with their cosine distance from the first."""
    v = table(spark, sf_dir, "embeddings")
    blobs = search.encode_blobs(v.select(F.col("vec_id").alias("chunk_id"), "embedding"))
    back = search.decode_blobs(blobs).join(blobs.select("chunk_id", F.octet_length("blob").alias("n_bytes")), "chunk_id")
    return back.select(F.col("chunk_id").alias("vec_id"), "n_bytes", _digest(F.col("embedding")).alias("vector_md5"), F.round(V.cosine_distance("embedding", vector_of(v, 0)), 6).alias("distance"))


@PLANS.query(_OVERLAP)
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An overlap of 30 words moves the starts, but not behind the pieces of a line that was cut by its words."""
    chunks = chunking.chunk_documents(table(spark, sf_dir, "documents"), size=100, overlap=30, least=0, by_line=True)
    return chunks.select("doc_id", "chunk_index", "n_tokens", "start_offset", "end_offset")


@PLANS.query(
    r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\x0b\f\r]+'), lambda w: w <> '') AS w FROM documents),
    c AS (SELECT doc_id, w, unnest(range((len(w) + 199) // 200)) AS k FROM w WHERE len(w) > 0)
    SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, CAST(len(list_slice(w, k * 200 + 1, k * 200 + 200)) AS INTEGER) AS n_words,
      md5(array_to_string(list_slice(w, k * 200 + 1, k * 200 + 200), ' ')) AS content_md5 FROM c"""
)
def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_words(table(spark, sf_dir, "documents"), 200).select("doc_id", "chunk_index", "n_words", F.md5("content").alias("content_md5"))


@PLANS.query("WITH RECURSIVE " + _PARTS.format(size=500, least=100) + ", n AS (SELECT doc_id, count(*) - (SELECT count(*) FROM small s WHERE s.doc_id = placed.doc_id) AS n FROM placed GROUP BY doc_id) SELECT d.doc_id, CASE WHEN n > 0 THEN 2 ELSE 3 END AS status, coalesce(n, 0) AS chunk_count FROM documents d LEFT JOIN n USING (doc_id)")
def ingest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.ingest(table(spark, sf_dir, "documents"), by_line=True)[1]


@PLANS.query(
    f"""SELECT vec_id, label, {_DIGEST.format(v="embedding")} AS vector_md5 FROM embeddings WHERE label NOT IN (1, 2)
    UNION ALL SELECT vec_id, label, {_DIGEST.format(v="list_transform(embedding, lambda x: -x)")} FROM embeddings WHERE label = 1"""
)
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch replaces the vectors of label 1, twice each, of which the later counts; then those of label 2 are deleted."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    twice = F.array(F.struct(F.lit(1).alias("i"), F.col("embedding").alias("x")), F.struct(F.lit(2).alias("i"), F.transform("embedding", lambda x: -x).alias("x")))
    delta = v.where("label = 1").select("vec_id", "label", F.explode(twice).alias("d"))
    after = relational.upsert(v, delta.select("vec_id", "label", F.col("d.x").alias("embedding"), F.col("d.i").alias("place")), ["vec_id"], ["place"])
    gone = v.where("label = 2").select(F.col("vec_id").alias("id"))
    return relational.cascade_delete({"vectors": (after, "vec_id")}, gone)["vectors"].select("vec_id", "label", _digest(F.col("embedding")).alias("vector_md5"))


@PLANS.query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def kb_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region goes; so do the customers of its nations."""
    gone = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("id"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return relational.cascade_delete({"customer": (customers, "c_nationkey")}, gone)["customer"]


@PLANS.query(
    """WITH d AS (SELECT doc_id, source, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 4 ELSE 2 END AS status FROM documents)
    SELECT doc_id, status, count(*) FILTER (WHERE status = 2) OVER (PARTITION BY source) AS n_live FROM d"""
)
def document_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents get the status of deleted ones; each row has the live documents of its knowledge base."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.lit(2).alias("status"))
    marked = relational.mark(docs, table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "status", 4)
    live = marked.groupBy("source").agg(F.count_if(F.col("status") == 2).alias("n_live"))
    return marked.join(live, "source").select("doc_id", "status", "n_live")


@PLANS.query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def bulk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the ids of orders, many of which ask for the same."""
    asked = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return relational.lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), asked, "c_custkey")


@PLANS.query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey <> 2")
def tables_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables published together twice; the second version, without a region, is what is read, and a third one, which
    broke off before its manifest, is not."""
    root = f"{shared_root(spark)}/published-{uuid.uuid4().hex}"
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    files.publish(spark, {"nations": nations, "regions": regions}, root)
    files.publish(spark, {"nations": nations.where("n_regionkey <> 2"), "regions": regions.where("r_regionkey <> 2")}, root)
    nations.limit(0).write.parquet(f"{root}/data/{'9' * 20}-broken/nations")
    got = files.published(spark, root)
    return got["nations"].join(got["regions"].withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").select("n_nationkey", "n_name", "r_name")


@PLANS.query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'P' ELSE o_orderstatus END AS o_orderstatus, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS affected FROM orders")
def compare_and_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    out, affected = relational.compare_and_set(orders, F.col("o_orderstatus") == "O", {"o_orderstatus": F.lit("P")})
    return out.join(F.broadcast(affected))  # one row


@PLANS.query(
    """SELECT vec_id, label FROM (SELECT vec_id, label, list_filter(embedding, lambda x: NOT isfinite(x)) AS bad, len(embedding) AS n FROM embeddings) WHERE len(bad) = 0 AND n > 0"""
)
def valid_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(V.valid_embedding("embedding")).select("vec_id", "label")


@PLANS.query(
    """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: abs(embedding[i]::DOUBLE - q[i]))) AS score FROM embeddings, q)
    SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score, vec_id LIMIT 10"""
)
def vector_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest by a distance that is registered by name."""
    v = table(spark, sf_dir, "embeddings")
    V.register_distance("manhattan", V.manhattan_distance)
    try:
        return _rounded(search.search(v, vector_of(v, 0), 10, metric="manhattan"), "score")
    finally:
        del V.DISTANCES["manhattan"]


@PLANS.query("SELECT doc_id, [length(text)::DOUBLE, (length(text) - length(replace(text, ' ', '')))::DOUBLE] AS embedding FROM documents")
def texts_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through an embedder that is given, in batches of ten: their characters and blanks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return search.with_embeddings(docs, lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts], 2).select("doc_id", "embedding")


@PLANS.query("SELECT doc_id, source, md5(text) AS text_md5 FROM documents WHERE doc_id % 7 > 0 UNION ALL SELECT doc_id, 'moved', md5(text) FROM documents WHERE doc_id % 7 = 0")
def snapshot_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot, and the next one beside it with every seventh document moved."""
    root = f"{shared_root(spark)}/snapshots-{uuid.uuid4().hex}"
    first = files.write_snapshot(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), f"{root}/1")
    moved = first.where("doc_id % 7 = 0").withColumn("source", F.lit("moved"))
    second = files.write_snapshot(relational.upsert(first, moved, ["doc_id"]), f"{root}/2")
    return second.select("doc_id", "source", F.md5("text").alias("text_md5"))
