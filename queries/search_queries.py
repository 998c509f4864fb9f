"""Search: exact, filtered, batch, chunked, across tables, approximate."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.embedders import Models, hash_embedder
from nearfield.functions.vectors import register_functions
from nearfield.operators import ann, topk
from nearfield.operators.search import Searchable, TaggedTable, search_all, shaped
from nearfield.plans.indexing import chunk_rows, embed_rows
from nearfield.plans.setup import apply_table
from nearfield.plans.indexing import index_table, migrate_table
from nearfield.plans.text_search import build_lists, search
from nearfield.registry import Registry
from nearfield.session import materialize, scratch_path
from nearfield.sources.embedding_table import EmbeddingTable
from queries import query
from queries.sqlparts import chunks, hash_slots, text_similarity

MODEL = hash_embedder(64)
FIRST_BENCHMARK = "(SELECT text FROM benchmark WHERE item_id = 0)"
COSINE = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
FIRST_VECTOR = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def first_vector(load) -> list[float]:
    return load("embeddings").where("vec_id = 0").first()["embedding"]


def benchmark_text(load) -> str:
    return load("benchmark").where("item_id = 0").first()["text"]


def document_search(load) -> Searchable:
    vectors = load("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return Searchable(load("documents"), vectors, ["doc_id"], ["text"])


def rounded(df):
    return df.withColumn("similarity", F.round("similarity", 4))


@query("semantic_search", f"""
    SELECT e.vec_id, round({COSINE}, 4) AS similarity
    FROM embeddings e CROSS JOIN {FIRST_VECTOR} q
    ORDER BY {COSINE} DESC, e.vec_id LIMIT 10""")
def semantic_search(load):
    return rounded(topk.nearest(load("embeddings"), ["vec_id"], first_vector(load), 10))


@query("sql_similarity", f"""
    SELECT e.vec_id, e.label, round({COSINE}, 4) AS similarity
    FROM embeddings e CROSS JOIN {FIRST_VECTOR} q WHERE {COSINE} > 0.1""")
def sql_similarity(load):
    """The similarity function from SQL, over the whole table."""
    register_functions(load.spark)
    load("embeddings").createOrReplaceTempView("nearfield_embeddings")
    return load.spark.sql("""
        SELECT vec_id, label, round(cosine_similarity(embedding, :query), 4) AS similarity FROM nearfield_embeddings
        WHERE cosine_similarity(embedding, :query) > 0.1""", args={"query": first_vector(load)})


@query("search_external", f"""
    SELECT CAST(d.doc_id AS VARCHAR) AS row_id, d.lang, d.source, round({COSINE}, 4) AS similarity
    FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id CROSS JOIN {FIRST_VECTOR} q
    ORDER BY {COSINE} DESC, d.doc_id LIMIT 10""")
def search_external(load):
    found = document_search(load).search(first_vector(load), 10)
    return rounded(found).select("row_id", "lang", "source", "similarity")


@query("search_shaped", f"""
    SELECT CAST(d.doc_id AS VARCHAR) AS row_id, substr(d.text, 1, 500) AS content, round({COSINE}, 4) AS similarity,
           d.doc_id, d.text, d.lang, d.source, d.n_chars
    FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id CROSS JOIN {FIRST_VECTOR} q
    ORDER BY {COSINE} DESC, d.doc_id LIMIT 5""")
def search_shaped(load):
    return shaped(document_search(load).search(first_vector(load), 5))


def hybrid(load, filters, limit=10):
    found = document_search(load).search(first_vector(load), limit, filters)
    return rounded(found).select("doc_id", "lang", "source", "n_chars", "similarity")


def hybrid_sql(condition: str) -> str:
    return f"""
    SELECT d.doc_id, d.lang, d.source, d.n_chars, round({COSINE}, 4) AS similarity
    FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id CROSS JOIN {FIRST_VECTOR} q
    WHERE {condition} ORDER BY {COSINE} DESC, d.doc_id LIMIT 10"""


@query("hybrid_ilike", hybrid_sql("d.lang ILIKE 'EN' AND d.source ILIKE 'SRC1%'"))
def hybrid_ilike(load):
    return hybrid(load, {"lang": "EN", "source": "SRC1%"})


@query("hybrid_range", hybrid_sql("d.n_chars >= 500 AND d.n_chars <= 3000"))
def hybrid_range(load):
    return hybrid(load, {"n_chars_min": 500, "n_chars_max": 3000})


@query("hybrid_labels", f"""
    SELECT l.doc_id, l.quality, l.toxic, round({COSINE}, 4) AS similarity
    FROM labels l JOIN embeddings e ON l.doc_id = e.vec_id CROSS JOIN {FIRST_VECTOR} q
    WHERE l.quality = 1 AND l.toxic = 0 ORDER BY {COSINE} DESC, l.doc_id LIMIT 10""")
def hybrid_labels(load):
    vectors = load("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    labelled = Searchable(load("labels"), vectors, ["doc_id"], ["quality"])
    found = labelled.search(first_vector(load), 10, {"quality": 1, "toxic": 0})
    return rounded(found).select("doc_id", "quality", "toxic", "similarity")


@query("hybrid_cut", hybrid_sql("d.lang ILIKE 'en' AND d.n_chars >= 500"))
def hybrid_cut(load):
    """A filter that lets too many keys pass to be broadcast: only the keys of the best scores meet it."""
    table = replace(document_search(load), most_allowed=0, small_bytes=0)
    found = table.search(first_vector(load), 10, {"lang": "en", "n_chars_min": 500})
    return rounded(found).select("doc_id", "lang", "source", "n_chars", "similarity")


@query("batch_topk", """
    SELECT item_id, vec_id, round(s, 4) AS similarity, CAST(rank AS INTEGER) AS rank FROM (
        SELECT b.item_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s,
               row_number() OVER (PARTITION BY b.item_id ORDER BY
                   list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank
        FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN embeddings e)
    WHERE rank <= 10""")
def batch_topk(load):
    vectors = load("embeddings")
    asked = load("benchmark").join(vectors, F.col("item_id") == F.col("vec_id")).select("item_id", "embedding")
    found = topk.nearest_batch(vectors, ["vec_id"], asked, "item_id", 10)
    return rounded(found).select("item_id", "vec_id", "similarity", "rank")


@query("batch_topk_blocks", """
    SELECT q.vec_id AS asked, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS similarity
    FROM embeddings q CROSS JOIN embeddings e
    QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY
        round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) DESC, e.vec_id) <= 3""")
def batch_topk_blocks(load):
    """Every vector asks, in passes that hold a third of the queries each at most."""
    vectors = load("embeddings")
    asked = vectors.select(F.col("vec_id").alias("asked"), "embedding")
    size = asked.agg(F.sum(8 * F.size("embedding"))).first()[0]
    found = topk.nearest_batch(vectors, ["vec_id"], asked, "asked", 3, pass_bytes=size // 3)
    return rounded(found).select("asked", "vec_id", "similarity")


@query("text_search_batch", f"""
    WITH d AS ({hash_slots("documents", "doc_id", "text")}), q AS ({hash_slots("benchmark", "item_id", "text")}),
    dn AS (SELECT doc_id, SUM(w * w) AS nn FROM d GROUP BY 1), qn AS (SELECT item_id, SUM(w * w) AS nn FROM q GROUP BY 1),
    dots AS (SELECT item_id, doc_id, SUM(d.w * q.w) AS dot FROM d JOIN q USING (slot) GROUP BY 1, 2),
    scored AS (SELECT item_id, doc_id, COALESCE(dot, 0) / (sqrt(dn.nn) * sqrt(qn.nn)) AS s
               FROM dn CROSS JOIN qn LEFT JOIN dots USING (item_id, doc_id))
    SELECT item_id, doc_id, round(s, 4) AS similarity, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 12) DESC, doc_id) AS rank FROM scored)
    WHERE rank <= 5""")
def text_search_batch(load):
    """Every benchmark text against every document."""
    documents = embed_rows(load("documents"), ["doc_id"], ["text"], MODEL)
    asked = embed_rows(load("benchmark"), ["item_id"], ["text"], MODEL)
    found = topk.nearest_batch(documents, ["doc_id"], asked, "item_id", 5)
    return rounded(found).select("item_id", "doc_id", "similarity", "rank")


@query("chunked_search", f"""
    WITH RECURSIVE {chunks("documents", "doc_id", "text")},
    c AS (SELECT CAST(doc_id AS VARCHAR) || ':' || CAST(chunk_index AS VARCHAR) AS id, * FROM chunks),
    scored AS (SELECT c.*, s.similarity FROM c JOIN ({text_similarity("c", "id", "chunk_text", FIRST_BENCHMARK)}) s USING (id)),
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(similarity, 12) DESC NULLS LAST, chunk_index) AS n
             FROM scored)
    SELECT doc_id, chunk_index, chunk_text AS content, round(similarity, 4) AS similarity
    FROM best WHERE n = 1 ORDER BY round(similarity, 12) DESC NULLS LAST, doc_id LIMIT 10""")
def chunked_search(load):
    documents = load("documents")
    rows = embed_rows(documents, ["doc_id"], ["text"], MODEL, chunked=True)
    table = Searchable(documents, materialize(rows, "chunks"), ["doc_id"], ["text"], chunked=True)
    found = table.search(MODEL.embed_query(benchmark_text(load)), 10)
    return rounded(found).select("doc_id", "chunk_index", "content", "similarity")


@query("search_all", f"""
    WITH conv AS (SELECT CAST(conv_id AS VARCHAR) || ',' || CAST(turn AS VARCHAR) AS row_id, conv_id, turn,
                         'role: ' || role || chr(10) || 'text: ' || text AS content FROM conversations),
    docs AS (SELECT CAST(doc_id AS VARCHAR) AS row_id, text AS content FROM documents),
    marks AS (SELECT CAST(item_id AS VARCHAR) AS row_id, text AS content FROM benchmark),
    found AS (
        SELECT 'conversations' AS t, row_id, content, similarity
        FROM conv JOIN ({text_similarity("conv", "row_id", "content", FIRST_BENCHMARK)}) USING (row_id)
        UNION ALL
        SELECT 'documents', row_id, content, similarity
        FROM docs JOIN ({text_similarity("docs", "row_id", "content", FIRST_BENCHMARK)}) USING (row_id)
        UNION ALL
        SELECT 'benchmark', row_id, content, similarity
        FROM marks JOIN ({text_similarity("marks", "row_id", "content", FIRST_BENCHMARK)}) USING (row_id))
    SELECT t AS _source_table, 'public' AS _source_schema, row_id, content, round(similarity, 4) AS similarity
    FROM found ORDER BY round(similarity, 12) DESC NULLS LAST, t, row_id LIMIT 10""")
def search_tables(load):
    tables = []
    for name, key, columns in (
        ("documents", ["doc_id"], ["text"]),
        ("conversations", ["conv_id", "turn"], ["role", "text"]),
        ("benchmark", ["item_id"], ["text"]),
    ):
        source = load(name)
        vectors = materialize(embed_rows(source, key, columns, MODEL), name)
        tables.append(TaggedTable(name, "public", MODEL.key, Searchable(source, vectors, key, columns)))
    found = search_all(tables, {MODEL.key: MODEL.embed_query(benchmark_text(load))}, 10)
    return rounded(found).drop("row_json")


@query("search_entry", f"""
    SELECT CAST(d.doc_id AS VARCHAR) AS row_id, d.lang, d.source, round(s.similarity, 4) AS similarity
    FROM documents d JOIN ({text_similarity("documents", "doc_id", "text", FIRST_BENCHMARK)}) s USING (doc_id)
    WHERE d.lang ILIKE 'en' ORDER BY round(s.similarity, 12) DESC NULLS LAST, d.doc_id LIMIT 5""")
def search_entry(load):
    """Register, index and search by text, through the same entry a user calls."""
    models, registry, root = Models(), Registry(), scratch_path(load.spark, "search-entry")
    entry = apply_table(
        load.spark, registry, models, table="documents", source=load.path("documents"), root=root,
        primary_key=["doc_id"], column="text", model="hash-64", buckets=4,
    )
    index_table(load.spark, entry, models)
    found = search(load.spark, registry, models, benchmark_text(load), "documents", {"lang": "en"}, limit=5)
    return rounded(found).select("row_id", "lang", "source", "similarity")


@query("ann_all_lists", f"""
    SELECT e.vec_id, round({COSINE}, 4) AS similarity
    FROM embeddings e CROSS JOIN {FIRST_VECTOR} q
    ORDER BY {COSINE} DESC, e.vec_id LIMIT 10""")
def ann_all_lists(load):
    path = scratch_path(load.spark, "lists")
    ann.build_lists(load("embeddings"), ["vec_id"], path, lists=8)
    return rounded(ann.probe(load.spark, path, ["vec_id"], first_vector(load), 10, probes=8))


@query("ann_recall")
def ann_recall(load):
    """Recall of the approximate search for a growing number of probed lists."""
    path, vector = scratch_path(load.spark, "lists"), first_vector(load)
    ann.build_lists(load("embeddings"), ["vec_id"], path, lists=8)
    exact = topk.nearest(load("embeddings"), ["vec_id"], vector, 10)
    merged = None
    for probes in (1, 2, 4, 8):
        found = ann.probe(load.spark, path, ["vec_id"], vector, 10, probes)
        one = ann.recall(exact, found, ["vec_id"]).withColumn("probes", F.lit(probes))
        merged = one if merged is None else merged.unionByName(one)
    return merged


@query("embed_documents", f"""
    SELECT doc_id, CAST(slot AS INTEGER) AS slot, w FROM ({hash_slots("documents", "doc_id", "text")})""")
def embed_documents(load):
    rows = embed_rows(load("documents"), ["doc_id"], ["text"], MODEL)
    return rows.select("doc_id", F.posexplode("embedding").alias("slot", "w")).where("w != 0").select(
        "doc_id", "slot", F.col("w").cast(T.DoubleType()).alias("w")
    )


@query("chunk_documents", f"""
    WITH RECURSIVE {chunks("documents", "doc_id", "text")}
    SELECT doc_id, chunk_index, len(string_split_regex(chunk_text, '\\s+')) AS words, md5(chunk_text) AS digest
    FROM chunks""")
def chunk_documents(load):
    rows = chunk_rows(load("documents"), ["doc_id"], ["text"]).where(F.col("chunk_text").isNotNull())
    return rows.select(
        "doc_id",
        "chunk_index",
        F.size(F.split("chunk_text", r"\s+")).cast("bigint").alias("words"),
        F.md5(F.col("chunk_text").cast("binary")).alias("digest"),
    )


@query("chunk_embeddings", f"""
    WITH RECURSIVE {chunks("documents", "doc_id", "text")},
    c AS (SELECT CAST(doc_id AS VARCHAR) || ':' || CAST(chunk_index AS VARCHAR) AS id, chunk_text, doc_id, chunk_index FROM chunks)
    SELECT c.doc_id, c.chunk_index, COALESCE(SUM(w * w), 0) AS squares, COALESCE(SUM(w), 0) AS total
    FROM c LEFT JOIN ({hash_slots("c", "id", "chunk_text")}) USING (id) GROUP BY 1, 2""")
def chunk_embeddings(load):
    rows = embed_rows(load("documents"), ["doc_id"], ["text"], MODEL, chunked=True).where("embedding IS NOT NULL")
    zero = F.lit(0.0)
    return rows.select(
        "doc_id",
        "chunk_index",
        F.aggregate("embedding", zero, lambda s, x: s + x * x).alias("squares"),
        F.aggregate("embedding", zero, lambda s, x: s + x).alias("total"),
    )


@query("search_limit_2000", f"""
    SELECT d.doc_id, d.lang, round({COSINE}, 4) AS similarity
    FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id CROSS JOIN {FIRST_VECTOR} q
    ORDER BY round({COSINE}, 12) DESC, d.doc_id LIMIT 2000""")
def search_limit_2000(load):
    """More results than a driver would want to hold: vectors are scored in one scan, only keys move."""
    found = document_search(load).search(first_vector(load), 2000)
    return rounded(found).select("doc_id", "lang", "similarity")


@query("search_after_migration", f"""
    SELECT CAST(d.doc_id AS VARCHAR) AS row_id, round(s.similarity, 4) AS similarity
    FROM documents d JOIN ({text_similarity("documents", "doc_id", "text", FIRST_BENCHMARK, 128)}) s USING (doc_id)
    ORDER BY round(s.similarity, 12) DESC NULLS LAST, d.doc_id LIMIT 5""")
def search_after_migration(load):
    """A registry saved before the migration finds the table with its new model all the same."""
    models, registry, root = Models(), Registry(), scratch_path(load.spark, "migrated")
    entry = apply_table(
        load.spark, registry, models, table="documents", source=load.path("documents"), root=root,
        primary_key=["doc_id"], column="text", model="hash-64", buckets=4,
    )
    index_table(load.spark, entry, models)
    registry.save(load.spark, f"{root}/registry.json")
    migrate_table(load.spark, registry, "documents", "hash-128", models)
    earlier = Registry.load(load.spark, f"{root}/registry.json")
    return rounded(search(load.spark, earlier, models, benchmark_text(load), "documents", limit=5)).select("row_id", "similarity")


@query("ann_given_centroids", f"""
    WITH parts AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
    means AS (SELECT label, i, avg(x) AS c FROM parts GROUP BY label, i),
    centers AS (SELECT label, list(c ORDER BY i) AS center, sum(c * c) / 2 AS half FROM means GROUP BY label),
    near AS (SELECT e.vec_id, c.label AS list_id, row_number() OVER (PARTITION BY e.vec_id ORDER BY
                 list_dot_product(e.embedding::DOUBLE[], c.center)
                 / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) - c.half DESC, c.label) AS n
             FROM embeddings e CROSS JOIN centers c),
    probed AS (SELECT c.label FROM centers c CROSS JOIN {FIRST_VECTOR} q ORDER BY
                 list_dot_product(q.embedding::DOUBLE[], c.center)
                 / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) - c.half DESC LIMIT 3)
    SELECT e.vec_id, round({COSINE}, 4) AS similarity
    FROM embeddings e JOIN near ON near.vec_id = e.vec_id AND near.n = 1 CROSS JOIN {FIRST_VECTOR} q
    WHERE near.list_id IN (SELECT label FROM probed)
    ORDER BY round({COSINE}, 12) DESC, e.vec_id LIMIT 10""")
def ann_given_centroids(load):
    """The mean vector of every label as centroids, three lists probed."""
    parts = load("embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    centers = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "c"))).alias("c")).orderBy("label").collect()
    path = scratch_path(load.spark, "lists")
    ann.build_lists(load("embeddings"), ["vec_id"], path, len(centers), centroids=[[p["c"] for p in r["c"]] for r in centers])
    return rounded(ann.probe(load.spark, path, ["vec_id"], first_vector(load), 10, probes=3))


NOW_VECTORS = """
    now AS (SELECT vec_id, CASE WHEN label = 3 THEN list_reverse(embedding) ELSE embedding END::DOUBLE[] AS v
            FROM embeddings WHERE label IS DISTINCT FROM 4)"""


@query("ann_after_changes", f"""
    WITH {NOW_VECTORS},
    parts AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
    means AS (SELECT label, i, avg(x) AS c FROM parts GROUP BY label, i),
    centers AS (SELECT label, list(c ORDER BY i) AS center, sum(c * c) / 2 AS half FROM means GROUP BY label),
    near AS (SELECT vec_id, v, c.label AS list_id, row_number() OVER (PARTITION BY vec_id ORDER BY
                 round(list_dot_product(v, c.center) / sqrt(list_dot_product(v, v)) - c.half, 12) DESC, c.label) AS n
             FROM now CROSS JOIN centers c),
    probed AS (SELECT a.label AS asked, a.center AS q, c.label FROM centers a CROSS JOIN centers c WHERE a.label < 4
               QUALIFY row_number() OVER (PARTITION BY a.label ORDER BY
                   list_dot_product(a.center, c.center) / sqrt(2 * a.half) - c.half DESC) <= 3)
    SELECT asked, vec_id, round(list_cosine_similarity(v, q), 4) AS similarity
    FROM near JOIN probed ON near.n = 1 AND near.list_id = probed.label
    QUALIFY row_number() OVER (PARTITION BY asked ORDER BY round(list_cosine_similarity(v, q), 12) DESC, vec_id) <= 10""")
def ann_after_changes(load):
    """Lists are built once; then rows are replaced, deleted and added, and three lists are probed for several vectors."""
    vectors = load("embeddings")
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    centers = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "c"))).alias("c")).orderBy("label").collect()
    table = EmbeddingTable.create(
        load.spark, scratch_path(load.spark, "changing"), vectors.select("vec_id").schema, "given", "given",
        len(first_vector(load)), "embedding", buckets=4)
    table.append(vectors.where("NOT label <=> 5").select("vec_id", "embedding"))
    build = table.lists().build(len(centers), centroids=[[p["c"] for p in r["c"]] for r in centers])
    table.merge(vectors.where("label = 3").select("vec_id", F.reverse("embedding").alias("embedding")))
    table.merge(deletes=vectors.where("label = 4").select("vec_id"))
    table.append(vectors.where("label = 5").select("vec_id", "embedding"))
    snap = table.snapshot()
    found = None
    for label, row in enumerate(centers[:4]):
        query = [p["c"] for p in row["c"]]
        one = topk.nearest(table.lists().probed(snap, build, query, probes=3), ["vec_id"], query, 10)
        one = one.select(F.lit(label).alias("asked"), "*")
        found = one if found is None else found.unionByName(one)
    return rounded(found)


@query("search_probed", f"""
    SELECT CAST(d.doc_id AS VARCHAR) AS row_id, d.lang, round(s.similarity, 4) AS similarity
    FROM documents d JOIN ({text_similarity("documents", "doc_id", "text", FIRST_BENCHMARK)}) s USING (doc_id)
    WHERE d.lang ILIKE 'en' ORDER BY round(s.similarity, 12) DESC NULLS LAST, d.doc_id LIMIT 5""")
def search_probed(load):
    """Approximate search through the entry a user calls, with a filter; all lists probed, so it is exact."""
    models, registry, root = Models(), Registry(), scratch_path(load.spark, "probed")
    entry = apply_table(
        load.spark, registry, models, table="documents", source=load.path("documents"), root=root,
        primary_key=["doc_id"], column="text", model="hash-64", buckets=4,
    )
    index_table(load.spark, entry, models)
    build_lists(load.spark, entry, 8)
    found = search(load.spark, registry, models, benchmark_text(load), "documents", {"lang": "en"}, limit=5, probes=8)
    return rounded(found).select("row_id", "lang", "similarity")
