"""Near-duplicate documents by MinHash with sequential Bayesian verification.

A document is its set of distinct runs of five words; two are linked when their sets' Jaccard index reaches the
threshold. The work goes from thin to wide:

1. One pass over the texts makes a hash of every set, its signature of minima and its band keys. Documents with equal
   sets become one class, however many they are; everything after this sees a class once.
2. Classes that share a band key stand in one bucket. Keys are counted before anything else is joined to them, and
   buckets that are too large are cut: for the forest of step 4 by a second key, then into blocks of bounded size; for
   the second pass into cells of bounded size in which every pair of components' members meets.
3. Within a bucket signatures are compared a batch of places at a time. After every batch a pair is dropped once the
   posterior probability that it reaches the threshold falls below MISS.
4. Survivors are verified on their full sets. First only a forest of the likeliest pairs per bucket is verified and
   joined to components. Then the full sets of documents that have survivors in other components come to their
   buckets, where all such pairs are verified; only links that join something leave the task. A pair within a
   component needs no verification, no table of all pairs is ever made, and no link between components is left out.

Documents without words have empty sets and are linked with nothing; fewer than five words make one run. Null texts
count as empty. Repeated rows are linked with one another; rows that share an id but not a text are linked by their
texts alone. Rows without an id take no part: their component is null and they are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.tasks import map_rows, text_rows, unused
from nearfield.operators.joins import rows_with_keys, rows_without_keys
from nearfield.session import materialize

RUN = 5
# Least Jaccard index in per cent.
PERCENT = 75
# 32 bands of 4 minima: a pair at the threshold shares no band with a probability of 5 in a million.
BANDS, ROWS = 32, 4
PLACES = BANDS * ROWS
# Signature places compared at a time, and the probability of a link below which a pair is dropped.
BATCH, MISS = 16, 1e-5
# Members of a bucket compared in one task; larger buckets are cut.
BUCKET = 2048
# Other bands by which the forest's part of a large bucket is cut, and members of it that meet every block.
SECOND, PIVOTS = 12, 8

_RNG = np.random.default_rng(20240229)
FACTORS = _RNG.integers(0, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _RNG.integers(0, 1 << 63, PLACES, dtype=np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


def runs(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < RUN:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(words) - RUN + 1
    found = each[:n].copy()
    for k in range(1, RUN):
        found = (found ^ (found >> np.uint64(29))) * MIX + each[k : n + k]
    found = (found ^ (found >> np.uint64(32))) * MIX
    return np.unique(found ^ (found >> np.uint64(29)))


def set_hash(found: np.ndarray) -> int:
    """Signed 64-bit hash of a whole set; equal sets have equal hashes."""
    value = xxhash.xxh3_64_intdigest(found.tobytes())
    return value - (1 << 64) if value >> 63 else value


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of every hash function over a set that is not empty."""
    out = np.empty(PLACES, dtype=np.uint64)
    step = max(1, min(PLACES, (1 << 18) // len(found)))
    for i in range(0, PLACES, step):
        out[i : i + step] = (found[None, :] * FACTORS[i : i + step, None] + TERMS[i : i + step, None]).min(1)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; bands have different keys for equal minima."""
    rows = least.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    for k in range(ROWS):
        key = (key ^ rows[:, k]) * MIX
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, set size, hash of the set, signature (one byte per place) and band keys of every document."""

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            found = runs(text)
            if not len(found):
                yield doc_id, 0, None, None, None
                continue
            least = minima(found)
            signature = ((least >> np.uint64(23)) & np.uint64(255)).astype(np.uint8)
            yield doc_id, len(found), set_hash(found), signature.tobytes(), band_keys(least).tolist()

    return map_rows(text_rows(docs), each, "doc_id bigint, n bigint, set_hash bigint, signature binary, bands array<bigint>")


def least_matches(miss: float = MISS, percent: int = PERCENT) -> list[int]:
    """After each batch, the least number of equal places with which a pair may still be a link.

    The prior over the Jaccard index is uniform; two different minima agree in one byte once in 256 times.
    """
    share = (np.arange(20000) + 0.5) / 20000
    equal = np.log(share + (1 - share) / 256)
    differ = np.log((1 - share) * 255 / 256)
    links = share >= percent / 100
    out = []
    for n in range(BATCH, PLACES + 1, BATCH):
        for m in range(n + 1):
            weight = m * equal + (n - m) * differ
            weight = np.exp(weight - weight.max())
            if weight[links].sum() / weight.sum() >= miss:
                break
        out.append(m)
    return out


def surviving(signatures: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, least: list[int],
              percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows that may be links, with their numbers of equal places."""
    small, large = np.minimum(sizes[left], sizes[right]), np.maximum(sizes[left], sizes[right])
    keep = 100 * small >= percent * large
    left, right = left[keep], right[keep]
    equal = np.zeros(len(left), dtype=np.int32)
    for i, needed in enumerate(least):
        places = slice(i * BATCH, (i + 1) * BATCH)
        equal += (signatures[left, places] == signatures[right, places]).sum(1, dtype=np.int32)
        keep = equal >= needed
        left, right, equal = left[keep], right[keep], equal[keep]
    return left, right, equal


def _pairs_within(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places within each of several short ranges."""
    sizes = ends - starts
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for apart in range(1, int(sizes.max(initial=1))):
        reach = np.repeat(starts, np.maximum(sizes - apart, 0))
        counts = np.maximum(sizes - apart, 0)
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        left.append(reach + offset)
        right.append(reach + offset + apart)
    return np.concatenate(left), np.concatenate(right)


class _Roots:
    """Sets that are joined as links are found."""

    def __init__(self) -> None:
        self.up: dict = {}

    def of(self, i):
        up = self.up
        while (above := up.get(i, i)) != i:
            up[i] = up.get(above, above)
            i = above
        return i

    def join(self, i, j) -> bool:
        i, j = self.of(i), self.of(j)
        self.up[j] = i
        return i != j


# Buckets up to this size are compared together; larger ones by themselves.
SHORT = 16


def _compare(rows: dict[str, np.ndarray], forest: bool, least: list[int], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of surviving pairs of rows in different components, within each cell; rows are sorted by cell.

    In a pair at least one row must ask. With ``forest``, large cells give only a forest of their likeliest pairs.
    Without, a pair is given in the first band only that both share, and likelier pairs come first within a cell.
    """
    cells, component, asks, signatures = rows["cell"], rows["component"], rows["asks"], rows["signature"]
    starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
    ends = np.append(starts[1:], len(cells))
    out_left, out_right = [], []

    def sift(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keep = (component[left] != component[right]) & (asks[left] | asks[right])
        left, right, equal = surviving(signatures, rows["n"], left[keep], right[keep], least, percent)
        if not forest and len(left):
            keep = ~_met_before(rows, left, right)
            left, right, equal = left[keep], right[keep], equal[keep]
        return left, right, equal

    short = ends - starts <= SHORT
    left, right, _ = sift(*_pairs_within(starts[short], ends[short]))
    out_left.append(left), out_right.append(right)
    for start, end in zip(starts[~short].tolist(), ends[~short].tolist()):
        found = []
        step = max(1, (1 << 18) // (end - start))
        for i in range(start, end, step):
            j = min(end, i + step)
            left, right = (x.ravel() for x in np.meshgrid(np.arange(i, j), np.arange(start, end), indexing="ij"))
            above = right > left
            found.append(sift(left[above], right[above]))
        left, right, equal = (np.concatenate(x) for x in zip(*found))
        likely = np.argsort(-equal, kind="stable")
        left, right = left[likely], right[likely]
        if forest and len(left):
            roots = _Roots()
            chosen = [k for k, (i, j) in enumerate(zip(left.tolist(), right.tolist())) if roots.join(i, j)]
            left, right = left[chosen], right[chosen]
        out_left.append(left), out_right.append(right)
    return np.concatenate(out_left), np.concatenate(out_right)


def _met_before(rows: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairs that also share the key of an earlier band, in whose bucket they meet."""
    same = rows["bands"][left] == rows["bands"][right]
    return (same & (np.arange(BANDS)[None, :] < rows["band"][left][:, None])).any(1)


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Columns of whole cells, from rows sorted by cell."""
    held: pa.Table | None = None

    def columns(table: pa.Table) -> dict:
        table = table.combine_chunks()
        found = {c: table[c].to_numpy() for c in table.column_names if c not in ("signature", "bands", "runs")}
        found["signature"] = np.frombuffer(b"".join(table["signature"].to_pylist()), dtype=np.uint8).reshape(-1, PLACES)
        if "bands" in table.column_names:
            found["bands"] = pa.concat_arrays([c.flatten() for c in table["bands"].chunks]).to_numpy().reshape(-1, BANDS)
        if "runs" in table.column_names:
            found["runs"] = table["runs"].to_numpy()
        return found

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        cell = held["cell"].to_numpy()
        # the last cell may go on in the next batch
        ready = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if len(cell) and cell[0] != cell[-1] else 0
        if ready:
            yield columns(held.slice(0, ready))
            held = held.slice(ready)
    if held is not None and held.num_rows:
        yield columns(held)


def _in_cells(cells: DataFrame, each, schema: str) -> DataFrame:
    """What ``each`` makes of the columns of whole cells: two equally long arrays at a time."""
    names = [part.split()[0] for part in schema.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_cell(batches):
            one, other = each(rows)
            for i in range(0, len(one), 50_000):
                yield pa.RecordBatch.from_pydict({names[0]: one[i : i + 50_000], names[1]: other[i : i + 50_000]})

    return cells.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(task, schema)


def likely_pairs(cells: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Distinct pairs a < b of nodes: a forest per large cell, all survivors of small ones."""
    least = least_matches(percent=percent)

    def each(rows: dict) -> tuple[np.ndarray, np.ndarray]:
        left, right = _compare(rows, True, least, percent)
        left, right = rows["node"][left], rows["node"][right]
        return np.minimum(left, right), np.maximum(left, right)

    return _in_cells(cells, each, "a bigint, b bigint").where("a != b").distinct()


def participants(cells: DataFrame, percent: int = PERCENT) -> DataFrame:
    """cell and node of the rows that have a survivor in another component of their cell."""
    least = least_matches(percent=percent)

    def each(rows: dict) -> tuple[np.ndarray, np.ndarray]:
        places = np.unique(np.concatenate(_compare(rows, False, least, percent)))
        return rows["cell"][places], rows["node"][places]

    return _in_cells(cells, each, "cell bigint, node bigint").distinct()


def links_between(cells: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Verified links between components; of those that join the same components in a cell, one. ``cells`` also holds
    the full sets in runs."""
    least = least_matches(percent=percent)

    def each(rows: dict) -> tuple[np.ndarray, np.ndarray]:
        roots, found = _Roots(), ([], [])
        cell, node, component, sets = rows["cell"].tolist(), rows["node"], rows["component"].tolist(), rows["runs"]
        for i, j in zip(*(x.tolist() for x in _compare(rows, False, least, percent))):
            a, b = (cell[i], component[i]), (cell[j], component[j])
            if roots.of(a) == roots.of(b):
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                roots.join(a, b)
                found[0].append(int(node[i])), found[1].append(int(node[j]))
        return np.array(found[0], dtype=np.int64), np.array(found[1], dtype=np.int64)

    return _in_cells(cells, each, "a bigint, b bigint").distinct()


def _shared(keyed: DataFrame, name: str) -> DataFrame:
    """key and number of nodes of the keys that more than one node has; counted where they stand first."""
    return materialize(keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), name)


def buckets(classes: DataFrame) -> DataFrame:
    """key, node, number of members and band: classes that share a band."""
    keyed = classes.select("node", F.posexplode("bands").alias("band", "key"))
    return keyed.join(_shared(keyed.select("key"), "near-dups-keys"), "key")


def cut_buckets(placed: DataFrame, classes: DataFrame, limit: int = BUCKET) -> DataFrame:
    """key, node and number of members: members of too large buckets share another band as well. Pairs that share no
    other band are left to the second pass."""
    large = materialize(placed.where(F.col("members") > limit).select("node", "band", "key"), "near-dups-large")
    if large.isEmpty():
        return placed.select("key", "node", "members")
    # nodes of large buckets take the pair of this band and another as key
    other = lambda i: F.get("bands", (F.col("band") + i) % BANDS)
    second = large.join(classes.select("node", "bands"), "node").select("node", F.explode(F.transform(
        F.sequence(F.lit(1), F.lit(SECOND)),
        lambda i: F.xxhash64(F.least("key", other(i)), F.greatest("key", other(i))))).alias("key")).distinct()
    return placed.where(F.col("members") <= limit).select("key", "node", "members").unionByName(
        second.join(_shared(second, "near-dups-second-keys"), "key"))


def first_cells(placed: DataFrame, limit: int = BUCKET) -> DataFrame:
    """Every bucket in blocks of at most about ``limit`` members; a few members of a bucket meet all its blocks."""
    blocks = F.ceil(F.col("members") / limit).cast("int")
    block = F.pmod(F.xxhash64("node"), blocks).cast("int")
    # about PIVOTS members of a large bucket, by hash
    one_in = F.greatest(F.lit(1), (F.col("members") / PIVOTS).cast("bigint"))
    pivot = (blocks > 1) & (F.pmod(F.xxhash64("node", F.lit(5)), one_in) == 0)
    where = F.when(pivot, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(block))
    return placed.select("key", "node", F.explode(where).alias("block")).select(
        F.xxhash64("key", "block").alias("cell"), "node", F.col("node").alias("component"), F.lit(True).alias("asks"))


def second_cells(placed: DataFrame, labels: DataFrame, limit: int = BUCKET) -> DataFrame:
    """Buckets whose members are in different components: all members in blocks, and in every block those that are
    not in the bucket's commonest component, in parts of bounded size; only these ask."""
    met = materialize(placed.join(labels, "node", "left").select(
        "key", "node", "band", F.coalesce("component", "node").alias("component")), "near-dups-met")
    each = met.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = materialize(each.groupBy("key").agg(
        F.count("*").alias("kinds"), F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("members"))
        .where("kinds > 1").select("key", F.col("most.component").alias("common"), "members",
                                   (F.col("members") - F.col("most.n")).alias("others")), "near-dups-mixed")
    blocks, parts = (F.greatest(F.lit(1), F.ceil(F.col(c) / limit)).cast("int") for c in ("members", "others"))
    rows = met.join(mixed, "key").withColumn("blocks", blocks).withColumn("parts", parts)
    block, part = (F.pmod(F.xxhash64("node", F.lit(salt)), F.col(c)).cast("int") for salt, c in ((1, "blocks"), (2, "parts")))
    as_member = rows.select("key", "node", "band", "component", block.alias("block"),
                            F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"))
    as_other = rows.where("component != common").select(
        "key", "node", "band", "component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        part.alias("part"), F.lit(True).alias("asks"))
    return as_member.unionByName(as_other).groupBy(
        F.xxhash64("key", "block", "part").alias("cell"), "node", "band", "component").agg(F.max("asks").alias("asks"))


def full_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """node and its whole set, made anew from one of the class's texts."""
    wanted = materialize(classes.join(nodes, "node", "left_semi").select("doc_id").distinct(), "near-dups-wanted")

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, text in rows:
            found = runs(text)
            if len(found):
                yield set_hash(found), found.view(np.int64).tolist()

    # repeated rows give their set once; written, so that Spark may split a class with very many pairs
    return materialize(map_rows(rows_with_keys(text_rows(docs), wanted, ["doc_id"]), each, "node bigint, runs array<bigint>")
                       .groupBy("node").agg(F.first("runs").alias("runs")), "near-dups-sets")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs of classes whose full sets reach the threshold."""
    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), classes, docs)
    left = sets.select(F.col("node").alias("a"), F.col("runs").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("runs").alias("of_b"))
    met = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("of_a", "of_b")))
    union = F.size("of_a") + F.size("of_b") - F.col("shared")
    return met.where(100 * F.col("shared") >= percent * union).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node and the least node it can reach, by passing on least labels and following labels of labels."""
    both = materialize(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "near-dups-links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("component")), "near-dups-labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        told = materialize(labels.join(heard, "node").select(
            "node", F.col("component").alias("before"), F.least("component", "heard").alias("component")), "near-dups-told")
        above = told.select(F.col("node").alias("component"), F.col("component").alias("above"))
        labels = materialize(told.join(above, "component").select(
            "node", "before", F.least("component", "above").alias("component")), "near-dups-labels")
        if labels.where("component != before").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")


def judged(docs: DataFrame, percent: int = PERCENT, limit: int = BUCKET) -> DataFrame:
    """doc_id, n, set_hash, component and its least doc_id of every row; the latter two are null for rows that take no
    part. Components that have the same least doc_id are told apart by ``component``."""
    every = materialize(signed(docs), "near-dups-signed")
    # node names a class: the hash of its set
    classes = materialize(
        every.where("n > 0 AND doc_id IS NOT NULL").groupBy(F.col("set_hash").alias("node")).agg(
            F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("signature").alias("signature"),
            F.first("bands").alias("bands")), "near-dups-classes")
    placed = materialize(buckets(classes), "near-dups-buckets")
    signatures = classes.select("node", "n", "signature")
    first = materialize(likely_pairs(first_cells(cut_buckets(placed, classes, limit), limit).join(signatures, "node"),
                                     percent), "near-dups-first")
    links = materialize(verified(first, classes, docs, percent), "near-dups-verified")
    labels = components(links)
    cells = materialize(second_cells(placed, labels, limit).join(classes.select("node", "n", "signature", "bands"), "node"),
                        "near-dups-cells")
    rest = materialize(participants(cells, percent), "near-dups-rest")
    sets = full_sets(rest.select("node").distinct(), classes, docs)
    more = materialize(links_between(cells.join(rest, ["cell", "node"]).join(sets, "node"), percent), "near-dups-more")
    if not more.isEmpty():
        labels = components(links.unionAll(more))
    labelled = materialize(classes.select("node", "doc_id").join(labels, "node", "left").select(
        "node", "doc_id", F.coalesce("component", "node").alias("component")), "near-dups-labelled")
    least = materialize(labelled.groupBy("component").agg(F.min("doc_id").alias("component_id")), "near-dups-least")
    by_set = materialize(labelled.join(least, "component").select(F.col("node").alias("set_hash"), "component",
                                                                    "component_id"), "near-dups-components")
    return every.select("doc_id", "n", "set_hash").join(by_set, "set_hash", "left")


def _with_kept(found: DataFrame) -> DataFrame:
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, limit: int = BUCKET) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    return _with_kept(judged(docs, percent, limit))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of every group of near duplicates, the one with the least doc_id.

    Rows that share both id and text are one document and stay once. Rows that share an id but not a text stay or go by
    their own texts; of several in one group under its least id, one stays.
    """
    found = materialize(judged(docs), "near-dups-judged")
    dropped = materialize(_with_kept(found).where(~F.col("kept")).select("doc_id").distinct(), "near-dups-dropped")
    kept = rows_without_keys(docs, dropped, ["doc_id"])
    repeated = materialize(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"),
                           "near-dups-repeated")
    if repeated.isEmpty():
        return kept
    _hash, _least = unused(docs.columns, "set_hash"), unused(docs.columns, "least_text")

    @F.udf("bigint", useArrow=True)
    def hash_of(text):
        own = runs(text or "")
        return set_hash(own) if len(own) else None

    # only rows with repeated ids are read as sets again
    rows = rows_with_keys(docs, repeated, ["doc_id"]).withColumn(_hash, hash_of(F.col("text").cast("string")))
    empty = rows.where(F.col(_hash).isNull())
    chosen = found.where("doc_id = component_id").groupBy("component").agg(
        F.min("doc_id").alias("doc_id"), F.min("set_hash").alias(_hash)).drop("component")
    least = rows.join(chosen, ["doc_id", _hash], "left_semi").groupBy("doc_id", _hash).agg(F.min("text").alias(_least))
    alone = rows.join(least, ["doc_id", _hash]).where(F.col("text") == F.col(_least))
    both = alone.select(*docs.columns).unionByName(empty.select(*docs.columns))
    return rows_without_keys(kept, repeated, ["doc_id"]).unionByName(both.dropDuplicates(["doc_id", "text"]))
