"""Line dedup and fill-in-the-middle against plain versions."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F
from samples import frame, odd  # noqa: F401

from nearfield.llm import fill_middle, line_dedup

SPACE = " \t\n\x0b\x0c\r"
WHITE = [(910001, " " * 200_000, "en", "s", 1), (910002, "\t\n" * 100_000 + "end", "en", "s", 1), (910003, "a\n" * 50_000, "en", "s", 1)]


def shown(rows):
    return sorted((tuple(r) for r in rows), key=str)


def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


# -- line dedup --------------------------------------------------------------


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))


def brute_lines(rows, least_documents=10, least_chars=1):
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc_id)
    common = {k for k, ids in holders.items() if len(k) >= least_chars and len(ids) >= least_documents}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in common]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return shown(out)


def pages():
    """Common lines in several spellings, lines just below the threshold, repeats within a text, copies of rows."""
    rng = random.Random(2)
    rows = []
    for i in range(60):
        lines = [f"own line {i} {j}" for j in range(rng.randint(0, 4))]
        lines += rng.choice([["Share this"], ["\tSHARE THIS \x0b"], ["share this", "Share This"], []])
        if i < 9:
            lines += ["held by nine"] * 3
        if 20 <= i < 30:
            lines.append("Ärger Über")
        if 30 <= i < 40:
            lines.append("ärger über")
        lines += rng.choice([[], [""], ["", " "]])
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    return rows + [(7, "held by nine"), (7, "held by nine"), *[(None, "no id here")] * 12, (100, "share this\n" * 5 + "share this")]


@pytest.mark.parametrize("least_documents, least_chars", [(10, 1), (2, 1), (10, 12), (1, 1), (1, 0)])
def test_lines_equal_brute_force(frame, odd, least_documents, least_chars):
    docs = frame(pages()).unionByName(odd).unionByName(frame(WHITE))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = line_dedup.drop_common_lines(docs, least_documents, least_chars)
    assert found.columns == ["doc_id", "n_lines", "n_dropped", "text"]
    assert shown(found.collect()) == brute_lines(rows, least_documents, least_chars)


def test_lines_of_the_given_table(spark):
    docs = documents(spark)
    assert shown(line_dedup.drop_common_lines(docs).collect()) == brute_lines([(r.doc_id, r.text) for r in docs.collect()])


def test_a_row_that_is_a_third_of_the_table(frame):
    rows = [(1, "common\nown")] * 500 + [(i, f"common\nline {i}") for i in range(2, 1000)]
    assert shown(line_dedup.drop_common_lines(frame(rows).repartition(8)).collect()) == brute_lines(rows)


def test_lines_of_an_empty_table_and_clashing_columns(frame):
    assert line_dedup.drop_common_lines(frame([]).limit(0)).collect() == []
    names = ["line", "key", "position", "lines", "lost", "row_1", "key_1", "n_lines", "documents", "Key_2"]
    docs = frame([(i, "same\nthing") for i in range(12)]).select("*", *[F.lit(1).alias(n) for n in names])
    assert {tuple(r)[1:] for r in line_dedup.drop_common_lines(docs).collect()} == {(2, 2, "")}


def test_line_plan_has_no_python_and_moves_no_text_before_the_count(frame):
    plan = line_dedup.drop_common_lines(frame([(1, "x\ny")]))._jdf.queryExecution().executedPlan().toString()
    places = line_dedup.common_keys(line_dedup.line_places(line_dedup.text_rows(frame([(1, "x\ny")]))))
    counting = places._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan + counting)
    moved = [line for line in counting.splitlines() if "Exchange" in line]
    assert moved and not any("text" in line or "line" in line for line in moved)


# -- fill in the middle ------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_middle(doc_id, text, seed=42, cut=50, suffix_first=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= cut:
        return doc_id, len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < suffix_first:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def mixed(rng, size):
    return "".join(rng.choice(["word", "é漢", " ", "\n\t", "😀 x", " ", "<", "S>", "\x00", "\x1f"]) for _ in range(size))


@pytest.mark.parametrize("settings", [{}, {"seed": 7, "cut": 100, "suffix_first": 30}, {"cut": 0}, {"cut": 100, "cache_bytes": 0}])
def test_cuts_equal_brute_force(frame, odd, settings):
    rng = random.Random(6)
    shared = mixed(rng, 3000)
    rows = [(i, mixed(rng, rng.choice([0, 1, 5, 300, 4000])) + rng.choice(["", shared]) + mixed(rng, i)) for i in range(60)]
    rows += [(1000, "holds <M> itself"), (1001, "x" * 20_000 + " " * 20_000 + "y"), (3, rows[3][1])]
    docs = frame(rows).unionByName(odd).unionByName(frame(WHITE))
    plain = {k: v for k, v in settings.items() if k != "cache_bytes"}
    want = shown(brute_middle(r.doc_id, r.text, **plain) for r in docs.collect())
    formed = fill_middle.fill_in_middle(docs, **settings)
    assert shown(formed.collect()) == want
    back = formed.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("text"))
    assert shown(back.collect()) == shown((r.doc_id, r.text or "") for r in docs.collect())


def test_cuts_of_the_given_table(spark):
    docs = documents(spark)
    want = shown(brute_middle(r.doc_id, r.text) for r in docs.collect())
    assert shown(fill_middle.fill_in_middle(docs).collect()) == want


def test_markers_across_an_edge_are_no_markers(frame):
    rows = [(i, "<S <P< <M <") for i in range(40)] + [(i, "<P > <") for i in range(40, 80)]
    formed = fill_middle.fill_in_middle(frame(rows), cut=100)
    back = formed.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")))
    assert shown(back.collect()) == shown(rows) and {r.form for r in formed.collect()} == {"spm", "psm"}


def test_chunks_follow_the_content():
    """Texts that share a passage share its chunks, bounds hold, and blocks of hashes do not show."""
    rng = random.Random(3)
    passage = " ".join(rng.choices([f"w{i}" for i in range(500)], k=20_000)).encode()
    cuts = []
    for before in (b"", b"another beginning " * 50):
        ends = fill_middle.chunk_ends(before + passage)
        lengths = [b - a for a, b in zip([0, *ends], ends)]
        assert sum(lengths) == len(before + passage) and max(lengths) <= fill_middle.MOST_CHUNK
        assert min(lengths[:-1]) >= fill_middle.LEAST_CHUNK
        cuts.append({end - len(before) for end in ends})
    assert len(cuts[0] & cuts[1]) > 0.9 * len(cuts[0])


def test_blocks_of_hashes_do_not_show(monkeypatch):
    data = random.Random(4).randbytes(60_000)
    whole = fill_middle.chunk_ends(data)
    monkeypatch.setattr(fill_middle, "BLOCK", 1000)
    assert fill_middle.chunk_ends(data) == whole


def test_shared_chunks_are_looked_up_and_the_cache_is_bounded():
    rng = random.Random(5)
    passage = mixed(rng, 40_000).encode()
    cache = fill_middle.Cache(1 << 20)
    for i in range(5):
        fill_middle.Units(f"beginning {i} ".encode() * 20 + passage, cache)
    assert cache.hits > 0.7 * cache.asked
    for _ in range(30):
        fill_middle.Units(rng.randbytes(100_000), cache)
        assert cache.held == sum(len(k) + v.ends.nbytes for k, v in cache.known.items()) <= 1 << 20


def test_cuts_of_an_empty_table_and_clashing_columns(frame):
    assert fill_middle.fill_in_middle(frame([]).limit(0)).collect() == []
    docs = frame([(1, "a b c d e f")]).select("*", *[F.lit(1).alias(n) for n in ("n", "form", "output", "Prefix_chars")])
    assert tuple(fill_middle.fill_in_middle(docs).first()) == brute_middle(1, "a b c d e f")
