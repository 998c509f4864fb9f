"""Secret scan with corpus-wide ownership frequency.

Patterns find candidates in every whole text. Whether a candidate is a credential or an example that everybody copies
shows only across the corpus: the hash of its value is counted by distinct repositories and distinct owners. Values
under many owners are copied examples; values under one or few owners that look random are taken as live.

Only hashes and positions are shuffled, never texts. A value that a third of all rows hold is first counted per
repository where it stands, and the join that brings verdicts back reads tables of which Spark can split a hot key.

Null texts count as empty and have no candidates. Repeated rows are scanned each, and count as one owner. A null
source is an owner of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.tasks import map_rows, unused
from nearfield.session import materialize

#: Base kinds in their listed order: pattern, group that holds the value, and its least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
BASE = (
    ("assign", ASSIGN, 2, 12),
    # a run that is too short is dropped whole, so asking for the length at once finds the same runs
    ("access", re.compile(r"AKIA[A-Z0-9]{14,}"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
#: Kinds this operator adds; they come after the base kinds.
ADDED = (
    # through the END line; without one, to the end of the base64 block
    ("private", re.compile(
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]|-(?!----(?:BEGIN|END) ))*+-----END [A-Z ]*PRIVATE KEY-----|"
        r"(?:\s++[A-Z][A-Za-z-]*+: [^\n]*+)*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{16,}+={0,2})*+"
        r"(?:(?:\s|\\[nr])++[A-Za-z0-9+/]++={1,2})?)"), 0, 1),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 1),
    ("forge", re.compile(r"(?:gh[pousr]|glpat|github_pat)[_-][A-Za-z0-9_-]{20,}"), 0, 1),
    ("chat", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), 0, 1),
    ("cloud", re.compile(r"AIza[A-Za-z0-9_-]{35}"), 0, 1),
)
KINDS = {kind: i for i, (kind, *_) in enumerate(BASE + ADDED)}
# A value under at least so many owners is a copied example.
COPIED_OWNERS = 3
# A live-looking value has at least so many distinct characters and none of these words.
DISTINCT = 6
# A key body so long and with so many distinct characters holds such words by chance only.
KEY_LENGTH, KEY_DISTINCT = 64, 24
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "xxxx", "dummy", "sample", "redacted")


HEADER = re.compile(r"-----(?:BEGIN|END) [A-Z ]*PRIVATE KEY-----")
NO_KEY = re.compile(r"\\[nrt]|[^A-Za-z0-9+/=]")


def key_body(found: str) -> str:
    """What tells one private key from others, however its lines are broken; a header without a key stands for itself."""
    return NO_KEY.sub("", HEADER.sub("", found)) or found


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """(start, kind's place, end, value) of every match, by start and then kind."""
    found = []
    for kind, pattern, group, least in BASE + ADDED:
        for m in pattern.finditer(text):
            value = m.group(group)
            if kind == "private":
                value = key_body(value)
            if len(value) >= least:
                found.append((m.start(), KINDS[kind], m.end(), value))
    return sorted(found)


def looks_live(value: str, kind: int = 0) -> bool:
    lower = value.lower()
    if kind == KINDS["private"] and len(value) >= KEY_LENGTH and len(set(lower)) >= KEY_DISTINCT:
        return True
    return len(set(lower)) >= DISTINCT and not any(p in lower for p in PLACEHOLDERS)


def span_list(found: list[tuple[int, int, int]]) -> str:
    names = list(KINDS)
    return ",".join(f"{names[kind]}:{start}:{end}" for start, kind, end in found)


def find(docs: DataFrame) -> DataFrame:
    """Everything a single text tells: counts, spans and the hashes of candidate values. Written once.

    ``row`` tells repeated rows apart; it is stable because the rows are written.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("source").cast("string"), F.lit("")),
                       F.coalesce(F.col("text").cast("string"), F.lit("")))

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, source, text in rows:
            found = candidates(text)
            base = [(s, k, e) for s, k, e, _ in found if k < len(BASE)]
            counts = [sum(k == i for _, k, _ in base) for i in range(len(BASE))]
            yield (doc_id, source, xxhash.xxh64_intdigest(text.encode()) >> 1, *counts,
                   hashlib.sha256(span_list(base).encode()).hexdigest(), span_list([f[:3] for f in found]),
                   [span_list([f[:3]]) for f in found], [xxhash.xxh64_intdigest(f[3]) >> 1 for f in found],
                   [looks_live(f[3], f[1]) for f in found])

    schema = ("doc_id bigint, repository string, text_hash bigint, n_assign bigint, n_access bigint, n_hex bigint, "
              "base_sha256 string, spans string, found array<string>, value array<bigint>, looks array<boolean>")
    return materialize(map_rows(docs, each, schema).withColumn("row", F.monotonically_increasing_id()), "secrets-found")


def ownership(found: DataFrame) -> DataFrame:
    """value, repositories, owners and rows: how widely each candidate value is spread. An owner is what stands
    before the slash of a repository's name, or the whole name."""
    held = found.select(F.explode("value").alias("value"), "repository").groupBy("value", "repository").agg(
        F.count("*").alias("n"))
    owner = F.substring_index("repository", "/", 1)
    return held.groupBy("value").agg(F.count("*").alias("repositories"), F.countDistinct(owner).alias("owners"),
                                     F.sum("n").alias("n"))


def scan(docs: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """One row per document: base counts, all spans, and which spans are live or copied by the corpus's word."""
    found = find(docs)
    spread = materialize(ownership(found).select("value", "repositories", "owners"), "secrets-spread")
    each = found.select("row", F.explode(F.arrays_zip("found", "value", "looks")).alias("c")).select(
        "row", F.col("c.found").alias("span"), F.col("c.value").alias("value"), F.col("c.looks").alias("looks"))
    copied = F.col("owners") >= copied_owners
    judged = each.join(spread, "value").groupBy("row").agg(
        F.sum(copied.cast("bigint")).alias("n_copied"),
        # a row's own candidates only: bounded by its text
        F.collect_list(F.when(~copied & F.col("looks"), F.col("span"))).alias("live"))
    return found.drop("value", "looks", "found").join(judged, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "text_hash",
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.coalesce(F.size("live"), F.lit(0)).cast("bigint").alias("n_live"),
        F.coalesce("live", F.array().cast("array<string>")).alias("live"))


def redact(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """``docs`` with the live spans of their texts replaced by "[secret]", and n_chars counted anew where it changes.

    Rows meet by doc_id and the text's hash, so that repeated rows and rows without an id get their own spans.
    Only rows with live spans change; the columns stay as they are.
    """
    _id, _hash, _spans, _own = (unused(docs.columns, x) for x in ("live_id", "live_hash", "live_spans", "own_hash"))
    live = scanned.where("n_live > 0").groupBy(F.col("doc_id").alias(_id), F.col("text_hash").alias(_hash)).agg(
        F.min("live").alias(_spans))
    own, spans = F.col("text").cast("string"), F.col(f"`{_spans}`")

    @F.udf("bigint", useArrow=True)
    def text_hash(text):
        return xxhash.xxh64_intdigest((text or "").encode()) >> 1

    @F.udf("string", useArrow=True)
    def without(text, found):
        if not found:
            return text
        parts, at = [], 0
        for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in found):
            if start >= at:
                parts += [text[at:start], "[secret]"]
            at = max(at, end)
        return "".join([*parts, text[at:]])

    met = docs.withColumn(_own, text_hash(own)).join(
        live, F.col(f"`{_id}`").eqNullSafe(F.col("doc_id").cast("bigint")) & (F.col(f"`{_hash}`") == F.col(f"`{_own}`")),
        "left")
    met = met.withColumn("text", F.when(spans.isNull(), F.col("text")).otherwise(without(own, spans)))
    recounted = F.when(spans.isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))
    return met.select(*[recounted.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
