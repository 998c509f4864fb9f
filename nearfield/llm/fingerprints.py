"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is a set of digests: its paragraphs, long ones cut into short runs of words where their content says so, each
with the number of times it stood before. A sketch adds every digest to one cell in each of three tables: a count,
the xor of the digests and the xor of their checks. The sketch of a version minus that of another holds only digests
that differ; cells with a single digest are peeled until nothing is left, which recovers the differing digests without
comparing texts. If peeling gets stuck, both sketches are made twice as large and it starts again. Tables have sizes
of powers of two and are indexed by low bits, so a smaller sketch is a larger one folded.

The likeness of two fingerprints is the Jaccard index that follows from the recovered digests.

Null texts count as empty. The likeness of two empty texts is 1. Repeated rows and rows without an id are documents of
their own: of equal ids the order is that of the texts, and rows without an id come after all others.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.tasks import map_rows

TABLES = 3
# Cells of a table of the published fingerprint, a power of two.
CELLS = 8
# One word in so many begins a new run, as its letters say.
RUN = 4
# Documents that a task compares at a time.
TOGETHER = 128
# Stands for a missing id, below every id.
NO_ID = -(1 << 63)


def _mixed(values: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit mix with wrap-around, the same for every machine."""
    with np.errstate(over="ignore"):
        x = values ^ np.uint64(salt)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def digests(text: str) -> np.ndarray:
    """Distinct 64-bit digests of a text's paragraphs and runs; the n-th copy of one differs from the others."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    data = text.encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(data, dtype=np.uint32).astype(np.uint64)
    space = (points == 32) | (points == 10) | (points == 9) | (points == 13)
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        # white space alone is one run
        starts, ends = np.array([0]), np.array([len(points)])
    padded = np.concatenate([points, np.zeros(3, dtype=np.uint64)])
    letters = padded[starts] * np.uint64(1 << 42) + padded[starts + 1] * np.uint64(1 << 21) + padded[starts + 2]
    cut = (_mixed(letters, 7) % np.uint64(RUN) == 0) | (padded[starts - 1] == 10)
    cut[0] = True
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(starts)) - 1
    found = np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip((4 * starts[first]).tolist(), (4 * ends[last]).tolist())],
                     dtype=np.uint64)
    found.sort()
    new = np.append(True, found[1:] != found[:-1])
    run = np.flatnonzero(new)
    nth = np.arange(len(found)) - run[np.cumsum(new) - 1]
    return np.where(nth > 0, _mixed(found + nth.astype(np.uint64), 11), found)


def _check(found: np.ndarray) -> np.ndarray:
    return _mixed(found, 0x5BD1E995) & np.uint64(0xFFFF)


class Sketches:
    """Sketches of several sets side by side: counts, digest xors and check xors of every cell.

    All have ``size`` cells in each of the three tables. Working on many at once keeps the cost per set small.
    """

    def __init__(self, n: int, size: int) -> None:
        self.n, self.size = n, size
        self.count = np.zeros(n * TABLES * size, dtype=np.int64)
        self.key = np.zeros(n * TABLES * size, dtype=np.uint64)
        self.check = np.zeros(n * TABLES * size, dtype=np.uint64)

    def add(self, owner: np.ndarray, found: np.ndarray, sign: np.ndarray | int = 1) -> None:
        """Add (or with -1 take out) digests, each in the sketch of its owner."""
        checks = _check(found)
        for t in range(TABLES):
            cell = (_mixed(found, 101 + t) & np.uint64(self.size - 1)).astype(np.int64)
            cell += (owner * TABLES + t) * self.size
            np.add.at(self.count, cell, sign)
            np.bitwise_xor.at(self.key, cell, found)
            np.bitwise_xor.at(self.check, cell, checks)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Empties the sketches: owner, digest and sign of all that came out, and which sketches are empty now.

        A digest comes out once; if chance makes a cell look single that is not, its sketch does not end up empty.
        """
        owners, digests_, signs = [], [], []
        look = np.flatnonzero(np.abs(self.count) == 1)
        for _ in range(4 * self.size + 64):
            single = look[(np.abs(self.count[look]) == 1) & (self.check[look] == _check(self.key[look]))]
            if not len(single):
                break
            owner, found, sign = single // (TABLES * self.size), self.key[single], self.count[single]
            order = np.lexsort((found, owner))
            owner, found, sign = owner[order], found[order], sign[order]
            new = np.append(True, (owner[1:] != owner[:-1]) | (found[1:] != found[:-1]))
            owner, found, sign = owner[new], found[new], sign[new]
            owners.append(owner), digests_.append(found), signs.append(sign)
            self.add(owner, found, -sign)
            # only cells that lost something can have become single
            look = np.unique(np.concatenate([
                (_mixed(found, 101 + t) & np.uint64(self.size - 1)).astype(np.int64) + (owner * TABLES + t) * self.size
                for t in range(TABLES)]))
        left = (self.count != 0) | (self.key != 0)
        empty = ~left.reshape(self.n, -1).any(1)
        none = np.zeros(0, dtype=np.int64)
        return (np.concatenate([none, *owners]), np.concatenate([none.astype(np.uint64), *digests_]),
                np.concatenate([none, *signs]), empty)


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return owner, np.concatenate([np.zeros(0, dtype=np.uint64), *sets])


def fingerprints(sets: list[np.ndarray]) -> list[str]:
    """The published fingerprint of each set of digests: how many there are, and their smallest sketch."""
    made = Sketches(len(sets), CELLS)
    made.add(*_flat(sets))
    shape = (len(sets), TABLES * CELLS)
    columns = [made.count.astype("<i2").reshape(shape), made.key.astype("<u8").reshape(shape),
               made.check.astype("<u2").reshape(shape)]
    return [base64.b64encode(struct.pack("<I", len(s)) + b"".join(c[i].tobytes() for c in columns)).decode()
            for i, s in enumerate(sets)]


def differences(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per pair the digests only in the first and only in the second, recovered by peeling.

    The smallest sketches say how much room a pair needs: the squared counts of a difference sum up to about the
    number of digests in it. Pairs whose peeling gets stuck go again with sketches twice as large; from a size on at
    which sketches are larger than the sets themselves, the sets are compared.
    """
    found: list = [None] * len(pairs)
    small = _difference_sketches(pairs, CELLS)
    differing = (small.count.reshape(len(pairs), TABLES, CELLS) ** 2).sum(2).mean(1) if pairs else np.zeros(0)
    waiting: dict[int, list[int]] = {}
    for i, (mine, others) in enumerate(pairs):
        # counts that all lean one way square to more than their number
        lean = (len(mine) - len(others)) ** 2 / CELLS
        size = CELLS
        while TABLES * size < 1.4 * max(differing[i] - lean, abs(len(mine) - len(others))):
            size *= 2
        waiting.setdefault(size, []).append(i)
    while waiting:
        size = min(waiting)
        chosen = waiting.pop(size)
        owner, digest, sign, empty = (made := _difference_sketches([pairs[i] for i in chosen], size)).peel()
        del made
        for side in (1, -1):
            at = np.flatnonzero(sign == side)
            at = at[np.argsort(owner[at], kind="stable")]
            ends = np.searchsorted(owner[at], np.arange(len(chosen) + 1))
            for place, i in enumerate(chosen):
                if empty[place]:
                    out = digest[at[ends[place] : ends[place + 1]]]
                    found[i] = (out,) if side == 1 else (*found[i], out)
        for place, i in enumerate(chosen):
            if not empty[place]:
                mine, others = pairs[i]
                if size > 4 * (len(mine) + len(others) + CELLS):
                    found[i] = np.setdiff1d(mine, others), np.setdiff1d(others, mine)
                else:
                    waiting.setdefault(2 * size, []).append(i)
    return found


def _difference_sketches(pairs: list[tuple[np.ndarray, np.ndarray]], size: int) -> Sketches:
    made = Sketches(len(pairs), size)
    made.add(*_flat([p[0] for p in pairs]))
    made.add(*_flat([p[1] for p in pairs]), -1)
    return made


def likenesses(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
    """Jaccard index of each pair; two empty sets are alike."""
    out = []
    for (mine, others), (only_mine, _) in zip(pairs, differences(pairs)):
        shared = len(mine) - len(only_mine)
        union = len(mine) + len(others) - shared
        out.append(max(0.0, min(1.0, shared / union)) if union else 1.0)
    return out


def beside_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and the place of every row in falling order of ids, with a row's successor behind it.

    Ids are cut into ranges by their quantiles, and texts are shuffled once, each range to its own task. The first row
    of a range is also sent to the range above it, marked ``extra``, so that every task has the successor of its last
    row; the very first row goes to the lowest range in the same way.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = keyed.select("id")
    cuts = ids.approxQuantile("id", [i / parts for i in range(1, parts)], min(0.01, 1 / (4 * parts))) if parts > 1 else []
    bounds = np.array(sorted({int(c) for c in cuts}), dtype=np.int64)

    @F.pandas_udf("int")
    def bucket(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, values.to_numpy(dtype=np.int64)).astype(np.int32))

    # one row per range
    by_range = ids.groupBy(bucket("id").alias("bucket")).agg(F.max("id").alias("id"))
    firsts = sorted((r["bucket"], r["id"]) for r in by_range.collect())
    goes_to: dict[int, list[int]] = {}
    for (at, _), (_, successor) in zip(firsts, [firsts[-1], *firsts[:-1]] if firsts else []):
        goes_to.setdefault(successor, []).append(at)

    @F.pandas_udf("array<int>")
    def targets(values: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, values.to_numpy(dtype=np.int64))
        return pd.Series([[int(b), *(-1 - x for x in goes_to.get(int(v), ()))] for v, b in zip(values, own)])

    # copies for another range carry its number as -1 - number
    sent = keyed.select("id", "text", F.explode(targets("id")).alias("to")).select(
        "id", "text", F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).alias("bucket"),
        (F.col("to") < 0).alias("extra"))
    return sent.repartitionById(max(1, len(bounds) + 1), "bucket").sortWithinPartitions(
        "bucket", "extra", F.desc("id"), "text")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness to one another and to the next text.

    The edited text has its last third replaced by as much from the beginning of the next document in falling order
    of ids; the last document is followed by the first.
    """

    def results(waiting: list[tuple]) -> Iterator[tuple]:
        own = [w[2] for w in waiting]
        edited = []
        for _, text, _, (following, _) in waiting:
            third = len(text) // 3
            edited.append(text[: len(text) - third] + following[:third])
        changed = [digests(e) if e != w[1] else w[2] for e, w in zip(edited, waiting)]
        likeness = likenesses(list(zip(own, changed)) + [(w[2], w[3][1]) for w in waiting])
        for i, (w, e, mine, other) in enumerate(zip(waiting, edited, fingerprints(own), fingerprints(changed))):
            yield (None if w[0] == NO_ID else w[0], len(w[1]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(),
                   mine, other, likeness[i], likeness[len(waiting) + i])

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        before, bucket, closed = None, None, False
        waiting: list[tuple] = []
        for key, text, number, extra in rows:
            if number != bucket:
                before, bucket, closed = None, number, False
            if closed:
                continue
            row = key, text, digests(text)
            if before is not None:
                waiting.append((*before, row[1:]))
                if len(waiting) == TOGETHER:
                    yield from results(waiting)
                    waiting = []
            before, closed = row, extra
        yield from results(waiting)

    return map_rows(beside_next(docs), each, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
                    "edited_fingerprint string, near_edited double, near_next double")
