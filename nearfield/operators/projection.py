"""Two-dimensional maps of embeddings, samples, topic clusters and their keywords."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.errors import NearfieldError
from nearfield.functions.batches import counted_words
from nearfield.functions.text import quoted, row_id
from nearfield.operators.joins import rows_with_keys, spread

# Rows on a map by default and at most, label width, digits of a coordinate.
SAMPLE_ROWS, MAX_SAMPLE_ROWS = 1000, 5000
LABEL_WIDTH = 100
DIGITS = 4
# Tasks per core that add up products of vectors.
SUMS_PER_CORE = 4


def sample_rows(embeddings: DataFrame, key: list[str], n: int = SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """``n`` rows that have a vector, picked by a hash of the key: random, yet repeatable."""
    if not 1 <= n <= MAX_SAMPLE_ROWS:
        raise NearfieldError(f"sample size must be between 1 and {MAX_SAMPLE_ROWS}, got {n}")
    order = F.md5(F.concat(row_id(key), F.lit(f":{seed}")))
    present = embeddings.where(quoted("embedding").isNotNull())
    return present.orderBy(order, *[quoted(c) for c in key]).limit(n)


def vector_stats(embeddings: DataFrame) -> DataFrame:
    """Mean, variance, least and largest value of every component, from 0 on."""
    parts = embeddings.where(quoted("embedding").isNotNull()).select(F.posexplode("embedding").alias("component", "_x"))
    value = F.col("_x").cast("double")
    return parts.groupBy("component").agg(
        F.avg(value).alias("mean"), F.var_samp(value).alias("variance"), F.min(value).alias("least"), F.max(value).alias("largest")
    )


def covariance(embeddings: DataFrame) -> DataFrame:
    """Sample covariance of every pair of components a <= b.

    Each task adds up the products of its own vectors, and there are only a few tasks for each core, which read
    several parts of the input one after the other: what is shuffled is a matrix per task, whatever the number of
    vectors or files.
    """
    present = embeddings.where(quoted("embedding").isNotNull()).select(quoted("embedding").cast("array<double>").alias("_v"))
    present = present.coalesce(SUMS_PER_CORE * embeddings.sparkSession.sparkContext.defaultParallelism)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                own = rows.T @ rows, rows.sum(axis=0), len(rows)
                total = own if total is None else tuple(x + y for x, y in zip(total, own))
        if total is not None:
            products, plain, n = total
            a, b = np.triu_indices(len(plain))
            yield pa.RecordBatch.from_pydict({
                "a": a.astype(np.int32), "b": b.astype(np.int32), "ab": products[a, b], "sa": plain[a], "sb": plain[b],
                "n": np.full(len(a), n, dtype=np.int64)})

    added = present.mapInArrow(sums, "a int, b int, ab double, sa double, sb double, n bigint").groupBy("a", "b").agg(
        *[F.sum(c).alias(c) for c in ("ab", "sa", "sb", "n")])
    return added.select("a", "b", F.try_divide(
        F.col("ab") - F.col("sa") * F.col("sb") / F.col("n"), (F.col("n") - 1).cast("double")).alias("covariance"))


def project_2d(embeddings: DataFrame, key: list[str], label: Column | None = None) -> DataFrame:
    """First two principal components of the vectors, each scaled to 0..1.

    Spark sums the covariance in parallel; only that matrix, whose size is the square of the vector
    length, reaches the driver. Fewer than two vectors give no points.
    """
    carried = [] if label is None else [F.substring(label.cast("string"), 1, LABEL_WIDTH).alias("label")]
    points = embeddings.where(quoted("embedding").isNotNull()).select(
        *[quoted(c) for c in key], *carried, array_to_vector(quoted("embedding").cast("array<double>")).alias("_v")
    )
    names = [*key, *(["label"] if carried else [])]
    if len(points.select(*key).take(2)) < 2:
        nothing = points.where(F.lit(False))
        return nothing.select(*names, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(points)
    flat = model.transform(points).withColumn("_p", vector_to_array("_p"))
    flat = flat.select(*names, F.col("_p")[0].alias("x"), F.col("_p")[1].alias("y"))
    limits = flat.agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    ).first()

    def scaled(name: str) -> Column:
        low, high = limits[name + "0"], limits[name + "1"]
        return F.round((F.col(name) - low) / ((high - low) or 1.0), DIGITS).alias(name)

    return flat.select(*names, scaled("x"), scaled("y"))


def topic_clusters(
    embeddings: DataFrame, key: list[str], clusters: int, seed: int = 42, centers: bool = False
) -> DataFrame:
    """Cluster number per row, by direction of its vector; with ``centers`` also the centres of all clusters."""
    points = embeddings.where(quoted("embedding").isNotNull()).select(
        *[quoted(c) for c in key], array_to_vector(quoted("embedding").cast("array<double>")).alias("_v")
    )
    points = Normalizer(inputCol="_v", outputCol="_u").transform(points).where(
        F.exists(vector_to_array("_u"), lambda x: x != 0)
    )
    model = KMeans(k=clusters, seed=seed, featuresCol="_u", predictionCol="cluster").fit(points)
    found = model.transform(points).select(*key, "cluster")
    if not centers:
        return found
    # one number per cluster and component
    return found.withColumn("centers", F.array(*[
        F.array(*[F.lit(float(x)) for x in center]) for center in model.clusterCenters()]))


def word_counts(text: Column) -> Column:
    """Distinct words of a text with how often each occurs."""
    # see Embedder.column: keeps Catalyst from calling it twice
    return F.arrow_udf(counted_words, "array<struct<term:string,n:bigint>>").asNondeterministic()(text)


def cluster_keywords(members: DataFrame, texts: DataFrame, key: list[str], text: str, top: int = 5) -> DataFrame:
    """Most telling words per cluster: frequent in it and rare among the other documents.

    Each text is cut into words once and its repeated words are counted in the task that reads it, so
    after partial aggregation the shuffle carries about one row per cluster and word and task.
    """
    names = [quoted(c) for c in key]
    total = members.join(texts.select(*names), key).count()  # keys only
    wanted = rows_with_keys(texts.select(*names, quoted(text)), members, key)
    texts = spread(wanted).select(*names, word_counts(quoted(text)).alias("_words"))
    documents = members.join(texts, key)
    pairs = documents.select("cluster", F.inline("_words"))
    counts = pairs.groupBy("cluster", "term").agg(F.sum("n").alias("tf"), F.count("*").alias("_documents"))
    # one row per cluster is left for a term
    counts = counts.withColumn("df", F.sum("_documents").over(Window.partitionBy("term")))
    score = F.round(F.col("tf") * F.log(F.lit(float(total)) / F.col("df")), DIGITS)
    best = Window.partitionBy("cluster").orderBy(F.desc("score"), "term")
    return (
        counts.withColumn("score", score)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
        .select("cluster", "rank", "term", "tf", "df", "score")
    )
