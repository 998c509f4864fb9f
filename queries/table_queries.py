"""Sources, keys, content, coverage, profile and bounded SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions import text as X
from nearfield.operators import profile, projection as projection_module, rows
from nearfield.operators.bounded_sql import bounded_query
from nearfield.operators.projection import cluster_keywords, project_2d, sample_rows as sample_embedded, topic_clusters
from nearfield.sources import results, tables
from nearfield.session import scratch_path
from queries import TABLES, query
from queries.sqlparts import NOT_WORD

SPARK_TYPE = """CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string'
    WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'DATE' THEN 'date'
    WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(column_type) END"""
TEXT_COLUMNS = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"],
    "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"], "events": ["event_type", "props"],
    "documents": ["text", "lang", "source"], "pages": ["url", "html"], "benchmark": ["text"],
    "conversations": ["role", "text"],
}


def document_vectors(load):
    return load("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


# -- tables ------------------------------------------------------------------


@query("row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES))
def row_counts(load):
    return tables.row_counts(load.all())


@query("table_catalog", " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, CAST(row_number() OVER () AS INTEGER) AS ordinal, column_name,
    {SPARK_TYPE} AS data_type, "null" = 'YES' AS nullable, (SELECT count(*) FROM {t}) AS row_count FROM (DESCRIBE SELECT * FROM {t})"""
    for t in TABLES))
def table_catalog(load):
    return tables.table_catalog(load.all())


@query("list_tables", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, 'nearfield_listing' AS table_schema" for t in TABLES))
def list_tables(load):
    """The given tables as views of a database of their own, found among all databases."""
    load.spark.sql("CREATE DATABASE IF NOT EXISTS nearfield_listing")
    for name in TABLES:
        load.spark.sql(f"CREATE OR REPLACE VIEW nearfield_listing.{name} AS SELECT * FROM parquet.`{load.path(name)}`")
    return tables.list_tables(load.spark, ["nearfield_listing"])


@query("sample_rows", """
    SELECT CAST(doc_id AS VARCHAR) AS doc_id,
           CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS text,
           lang, source, CAST(n_chars AS VARCHAR) AS n_chars
    FROM documents ORDER BY documents.doc_id LIMIT 5""")
def sample_rows(load):
    return tables.sample_rows(load("documents"), 5, order=["doc_id"])


@query("sample_vectors", """
    SELECT CAST(vec_id AS VARCHAR) AS vec_id, '[vector]' AS embedding, CAST(label AS VARCHAR) AS label
    FROM embeddings ORDER BY embeddings.vec_id LIMIT 10""")
def sample_vectors(load):
    return tables.sample_rows(load("embeddings"), 10, order=["vec_id"])


@query("schema_context", """
    SELECT 'documents' AS table_name, (SELECT count(*) FROM documents) AS row_count,
           'doc_id:bigint text:string lang:string source:string n_chars:bigint' AS columns,
           CAST(doc_id AS VARCHAR) AS doc_id,
           CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS text, lang, source,
           CAST(n_chars AS VARCHAR) AS n_chars, NULL AS conv_id, NULL AS turn, NULL AS role
    FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 3)
    UNION ALL
    SELECT 'conversations', (SELECT count(*) FROM conversations),
           'conv_id:bigint turn:bigint role:string text:string', NULL,
           CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END, NULL, NULL, NULL,
           CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), role
    FROM (SELECT * FROM conversations ORDER BY conv_id, turn LIMIT 3)""")
def schema_context(load):
    chosen = {name: load(name) for name in ("documents", "conversations", "embeddings")}
    context = tables.schema_context(
        chosen, {"documents": ["doc_id"], "conversations": ["conv_id", "turn"]}, only=["documents", "conversations"]
    )
    names = ["doc_id", "text", "lang", "source", "n_chars", "conv_id", "turn", "role"]
    sample = F.from_json("sample", ", ".join(f"{n} string" for n in names))
    described = F.array_join(F.transform("columns", lambda c: F.concat(c["name"], F.lit(":"), c["type"])), " ")
    return context.select("table_name", "row_count", described.alias("columns"), F.explode("samples").alias("sample")).select(
        "table_name", "row_count", "columns", sample.alias("s")
    ).select("table_name", "row_count", "columns", *[f"s.{n}" for n in names])


@query("inline_view", """
    SELECT d.doc_id, d.lang, e.embedding IS NOT NULL AS embedded,
           round(list_sum(e.embedding::DOUBLE[]), 4) AS total
    FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id""")
def inline_view(load):
    view = rows.inline_view(load("documents"), document_vectors(load), ["doc_id"])
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return view.select("doc_id", "lang", F.col("embedding").isNotNull().alias("embedded"), F.round(total, 4).alias("total"))


@query("results_jsonl", "SELECT item_id, text FROM benchmark UNION ALL SELECT doc_id, text FROM documents")
def results_jsonl(load):
    """Write texts as JSON lines and read them back."""
    path = scratch_path(load.spark, "results.jsonl")
    texts = load("benchmark").union(load("documents").select("doc_id", "text"))
    results.write_jsonl(texts, path)
    return load.spark.read.schema("item_id bigint, text string").json(path)


@query("results_csv", """
    SELECT c.c_custkey, c.c_name, COALESCE(CAST(o.o_orderkey AS VARCHAR), '') AS o_orderkey
    FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 400000""")
def results_csv(load):
    """Write rows with missing values as CSV and read them back as text."""
    path = scratch_path(load.spark, "results.csv")
    big = load("orders").where("o_totalprice > 400000").select("o_custkey", "o_orderkey")
    joined = load("customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left")
    results.write_csv(joined.select("c_custkey", "c_name", "o_orderkey"), path)
    back = load.spark.read.option("header", True).schema("c_custkey bigint, c_name string, o_orderkey string").csv(path)
    return back.fillna("", ["o_orderkey"])


# -- content and keys ----------------------------------------------------------


@query("content_expr", """
    SELECT conv_id, turn, 'role: ' || role || chr(10) || 'text: ' || text AS content FROM conversations""")
def content_expr(load):
    return rows.with_content(load("conversations"), ["role", "text"]).select("conv_id", "turn", "content")


@query("row_id_encode", """
    SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || ',' || CAST(turn AS VARCHAR) AS row_id FROM conversations""")
def row_id_encode(load):
    return load("conversations").select("conv_id", "turn", X.row_id(["conv_id", "turn"]).alias("row_id"))


@query("row_id_decode", """
    SELECT row_id,
           CASE WHEN len(string_split(row_id, ',')) = 2 THEN TRY_CAST(string_split(row_id, ',')[1] AS BIGINT) END AS conv_id,
           CASE WHEN len(string_split(row_id, ',')) = 2 THEN TRY_CAST(string_split(row_id, ',')[2] AS BIGINT) END AS turn
    FROM (SELECT CAST(conv_id AS VARCHAR) || ',' || CAST(turn AS VARCHAR) AS row_id FROM conversations
          UNION ALL SELECT CAST(conv_id AS VARCHAR) || ',' || role FROM conversations
          UNION ALL SELECT CAST(doc_id AS VARCHAR) FROM documents)""")
def row_id_decode(load):
    """Well-formed ids, ids with a part that is not a number, and ids with too few parts."""
    conversations = load("conversations")
    ids = (
        conversations.select(X.row_id(["conv_id", "turn"]).alias("row_id"))
        .union(conversations.select(X.row_id(["conv_id", "role"])))
        .union(load("documents").select(X.row_id(["doc_id"])))
    )
    types = {"conv_id": T.LongType(), "turn": T.LongType()}
    return ids.select("row_id", *X.row_id_parts(F.col("row_id"), types))


@query("row_lookup", """
    SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role,
           CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '...' ELSE text END AS text
    FROM conversations c WHERE c.conv_id = 3 AND c.turn = 1 LIMIT 1""")
def row_lookup(load):
    return rows.row_detail(load("conversations"), ["conv_id", "turn"], "3,1")


@query("fetch_text", """
    SELECT k.doc_id, d.text AS content FROM (SELECT DISTINCT user_id AS doc_id FROM events
                                             UNION SELECT DISTINCT o_custkey FROM orders) k
    LEFT JOIN documents d USING (doc_id)""")
def fetch_text(load):
    """Keys from the change feed and from orders, of which some are not documents."""
    keys = load("events").select(F.col("user_id").alias("doc_id")).union(load("orders").select("o_custkey"))
    return rows.fetch_content(keys, load("documents"), ["doc_id"], ["text"])


@query("keyset_page", """
    SELECT conv_id, turn, role FROM conversations
    WHERE conv_id > 10 OR (conv_id = 10 AND turn > 1) ORDER BY conv_id, turn LIMIT 20""")
def keyset_page(load):
    return rows.keyset_page(load("conversations"), ["conv_id", "turn"], 20, [10, 1]).select("conv_id", "turn", "role")


@query("pk_violations", """
    SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1 OR l_orderkey IS NULL""")
def pk_violations(load):
    """The order number alone does not identify a line item."""
    return rows.key_violations(load("lineitem"), ["l_orderkey"])


# -- coverage --------------------------------------------------------------------


@query("unembedded_rows", """
    SELECT doc_id, lang, n_chars FROM documents
    WHERE text IS NOT NULL AND doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def unembedded_rows(load):
    return rows.unembedded_rows(load("documents"), document_vectors(load), ["doc_id"], ["text"]).select(
        "doc_id", "lang", "n_chars"
    )


@query("orphan_embeddings", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def orphan_embeddings(load):
    """Vectors without a labelled document."""
    found = rows.orphan_embeddings(document_vectors(load), load("labels"), ["doc_id"])
    return found.select(F.col("doc_id").alias("vec_id"))


@query("count_embedded", "SELECT count(*) AS embedded FROM embeddings WHERE embedding IS NOT NULL")
def count_embedded(load):
    return rows.count_embedded(document_vectors(load), ["doc_id"])


@query("count_content", """
    SELECT count(*) FILTER (role IS NOT NULL AND text IS NOT NULL) AS with_content, count(*) AS total_rows
    FROM conversations""")
def count_content(load):
    return rows.count_content(load("conversations"), ["role", "text"])


@query("coverage", """
    SELECT (SELECT count(*) FROM embeddings) AS embedded, (SELECT count(*) FROM documents) AS total,
           round(least(100.0, 100.0 * (SELECT count(*) FROM embeddings) / (SELECT count(*) FROM documents))::DOUBLE, 1)
               AS coverage_pct""")
def coverage(load):
    return rows.coverage(load("documents"), document_vectors(load), ["doc_id"], ["text"])


# -- profile -----------------------------------------------------------------------


def profile_sql(table: str, column: str) -> str:
    return f"""SELECT '{table}' AS table_name, 'public' AS table_schema, '{column}' AS column_name, 'string' AS data_type,
        round(COALESCE(avg(length({column})), 0), 4) AS avg_length, count({column}) AS sampled_rows FROM {table}"""


@query("avg_length", " UNION ALL ".join(
    profile_sql(t, c) for t in ("documents", "pages", "conversations") for c in TEXT_COLUMNS[t]))
def avg_length(load):
    merged = None
    for name in ("documents", "pages", "conversations"):
        one = profile.table_profile(load(name), name, share=1.0)
        merged = one if merged is None else merged.unionByName(one)
    return merged.withColumn("avg_length", F.round("avg_length", 4))


@query("profile_columns", f"""
    WITH p AS ({" UNION ALL ".join(profile_sql(t, c) for t, cs in TEXT_COLUMNS.items() for c in cs)}),
    s AS (SELECT *, CASE WHEN column_name IN ('id', 'status', 'code', 'type', 'slug', 'url', 'email', 'phone', 'uuid',
                                              'hash', 'token') THEN 1.0
                    ELSE CASE WHEN avg_length > 200 THEN 3.0 WHEN avg_length >= 50 THEN 2.0 ELSE 1.0 END
                       + CASE WHEN column_name IN ('description', 'body', 'content', 'text', 'summary', 'notes', 'note',
                                                   'bio', 'review', 'comment', 'message', 'details', 'abstract', 'excerpt',
                                                   'title', 'question', 'answer') THEN 0.5 ELSE 0.0 END END::DOUBLE AS score
          FROM p)
    SELECT *, CASE WHEN score >= 2.5 THEN '★★★' WHEN score >= 1.5 THEN '★★☆' ELSE '★☆☆' END AS stars FROM s""")
def profile_columns(load):
    return profile.inspect(load.spark, load.all(), share=1.0).withColumn("avg_length", F.round("avg_length", 4))


@query("length_estimates", """
    SELECT 'text' AS column_name, round(avg(length(text)), 4) AS avg_length, 0.0::DOUBLE AS error, count(text) AS sampled_rows
    FROM documents
    UNION ALL SELECT 'source', round(avg(length(source)), 4), 0.0, count(source) FROM documents""")
def length_estimates(load):
    """With everything read the estimate is exact."""
    found = profile.length_estimates(load("documents"), ["text", "source"], share=1.0)
    return found.select("column_name", F.round("avg_length", 4).alias("avg_length"), "error", "sampled_rows")


@query("safe_sql", """
    SELECT CAST(n_name AS VARCHAR) AS n_name, CAST(count(*) AS VARCHAR) AS customers,
           CAST(max(c_custkey) AS VARCHAR) AS newest
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n_name LIMIT 101""")
def safe_sql(load):
    load("customer").createOrReplaceTempView("nearfield_customer")
    load("nation").createOrReplaceTempView("nearfield_nation")
    return bounded_query(load.spark, """
        SELECT n_name, count(*) AS customers, max(c_custkey) AS newest
        FROM nearfield_customer JOIN nearfield_nation ON c_nationkey = n_nationkey
        WHERE n_name <> 'DROP TABLE' GROUP BY n_name ORDER BY n_name; -- update nothing""")


# -- maps and topics ------------------------------------------------------------------


@query("sample_embedded", """
    SELECT vec_id, label FROM embeddings WHERE embedding IS NOT NULL
    ORDER BY md5(CAST(vec_id AS VARCHAR) || ':42'), vec_id LIMIT 100""")
def sample_embeddings(load):
    return sample_embedded(load("embeddings"), ["vec_id"], 100).select("vec_id", "label")


@query("projection")
def projection(load):
    """All embeddings on two axes, labelled with their given label."""
    return project_2d(load("embeddings"), ["vec_id"], F.col("label"))


@query("vector_stats", """
    SELECT CAST(i - 1 AS INTEGER) AS component, round(avg(x), 9) AS mean, round(var_samp(x), 9) AS variance,
           min(x) AS least, max(x) AS largest
    FROM (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY i""")
def vector_stats(load):
    found = projection_module.vector_stats(load("embeddings"))
    return found.withColumn("mean", F.round("mean", 9)).withColumn("variance", F.round("variance", 9))


@query("covariance", """
    WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
    SELECT CAST(p.i AS INTEGER) AS a, CAST(q.i AS INTEGER) AS b, round(covar_samp(p.v, q.v), 9) AS covariance
    FROM x p JOIN x q ON p.vec_id = q.vec_id AND p.i <= q.i GROUP BY p.i, q.i""")
def covariance(load):
    return projection_module.covariance(load("embeddings")).withColumn("covariance", F.round("covariance", 9))


@query("projection_facts", """
    SELECT count(*) AS points, 0.0::DOUBLE AS least_x, 1.0::DOUBLE AS largest_x, 0.0::DOUBLE AS least_y,
           1.0::DOUBLE AS largest_y, 0.0::DOUBLE AS correlation FROM embeddings""")
def projection_facts(load):
    """Every vector has a point, both axes reach from 0 to 1, and the axes are uncorrelated."""
    points = project_2d(load("embeddings"), ["vec_id"])
    return points.agg(
        F.count("*").alias("points"), F.min("x").alias("least_x"), F.max("x").alias("largest_x"), F.min("y").alias("least_y"),
        F.max("y").alias("largest_y"), F.abs(F.round(F.corr("x", "y"), 3)).alias("correlation"))


@query("cluster_facts", "SELECT count(*) AS members, CAST(0 AS BIGINT) AS nearer_elsewhere FROM embeddings")
def cluster_facts(load):
    """Every vector has a cluster, and nearly the nearest one: after the last round of the fit few would still move."""
    vectors = load("embeddings")
    found = topic_clusters(vectors, ["vec_id"], 8, centers=True)
    unit = vectors.select("vec_id", (F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    length = F.sqrt(dot(F.col("v"), F.col("v")))
    gaps = F.transform("centers", lambda c: dot(c, c) - 2 * dot(c, F.col("v")) / length)
    scored = found.join(unit, "vec_id").select(F.get(gaps, F.col("cluster")).alias("own"), F.array_min(gaps).alias("least"))
    return scored.agg(F.count("*").alias("members"), F.count_if(F.col("own") > F.col("least") + 1e-9).alias("nearer_elsewhere"))


@query("topic_clusters")
def clusters(load):
    return topic_clusters(load("embeddings"), ["vec_id"], 8)


@query("cluster_keywords", f"""
    WITH m AS (SELECT d.doc_id, e.label AS cluster, d.text FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
    w AS (SELECT doc_id, cluster, unnest(string_split_regex(lower(text), '{NOT_WORD}')) AS term FROM m),
    tf AS (SELECT cluster, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY 1, 2),
    df AS (SELECT term, count(DISTINCT doc_id) AS df FROM w WHERE term <> '' GROUP BY 1),
    s AS (SELECT cluster, term, tf, df, round(tf * ln((SELECT count(*) FROM m)::DOUBLE / df), 4) AS score
          FROM tf JOIN df USING (term))
    SELECT cluster, CAST(rank AS INTEGER) AS rank, term, tf, df, score FROM (
        SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS rank FROM s) WHERE rank <= 5""")
def keywords(load):
    members = load("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster"))
    return cluster_keywords(members, load("documents"), ["doc_id"], "text")
