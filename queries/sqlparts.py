"""Pieces of SQL shared by several queries."""

from __future__ import annotations


# What separates words: anything but letters and digits of any script.
NOT_WORD = r"[^\p{L}\p{N}]+"


def hash_slots(source: str, key: str, text: str, dims: int = 64) -> str:
    """Non-zero components of the word-hash embedding: key, slot, w."""
    return f"""
        SELECT {key}, slot, SUM(sign)::DOUBLE AS w FROM (
            SELECT {key}, ('0x' || substr(md5(tok), 1, 4))::INTEGER % {dims} AS slot,
                   CASE WHEN substr(md5(tok), 5, 1) >= '8' THEN -1 ELSE 1 END AS sign
            FROM (SELECT {key}, unnest(string_split_regex(lower({text}), '{NOT_WORD}')) AS tok FROM {source})
            WHERE tok <> '')
        GROUP BY {key}, slot HAVING SUM(sign) <> 0"""


def text_similarity(source: str, key: str, text: str, query_text: str, dims: int = 64) -> str:
    """Cosine similarity of every row's text with one query text: key, similarity (null without words)."""
    return f"""
        SELECT d.{key}, CASE WHEN n.nn > 0 THEN COALESCE(p.dot, 0) / (sqrt(n.nn) * sqrt(q.nn)) END AS similarity
        FROM {source} d
        LEFT JOIN (SELECT {key}, SUM(w * w) AS nn FROM ({hash_slots(source, key, text, dims)}) GROUP BY 1) n USING ({key})
        LEFT JOIN (SELECT a.{key}, SUM(a.w * b.w) AS dot
                   FROM ({hash_slots(source, key, text, dims)}) a
                   JOIN ({hash_slots(f"(SELECT 0 AS one, {query_text} AS t)", "one", "t", dims)}) b USING (slot)
                   GROUP BY 1) p USING ({key})
        CROSS JOIN (SELECT SUM(w * w) AS nn
                    FROM ({hash_slots(f"(SELECT 0 AS one, {query_text} AS t)", "one", "t", dims)})) q"""


def chunks(source: str, key: str, text: str, window: int = 256, overlap: int = 64) -> str:
    """Sentence-packed chunks: key, chunk_index, chunk_text. A WITH RECURSIVE body ending in ``chunks``."""
    step = window - overlap
    return f"""
        cleaned AS (SELECT {key}, regexp_replace({text}, '^\\s+|\\s+$', '', 'g') AS t FROM {source} WHERE {text} IS NOT NULL),
        split AS (
            SELECT {key}, t, string_split_regex(t, '\\s+') AS words,
                   list_transform(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
                                  lambda s: len(string_split_regex(s, '\\s+'))) AS counts
            FROM cleaned WHERE t <> ''),
        walk AS (
            SELECT {key}, 0 AS i, 0::BIGINT AS s, 0::BIGINT AS e, 0::BIGINT AS closed_from, 0::BIGINT AS closed_to,
                   0::BIGINT AS first_cut, 0::BIGINT AS cuts, counts
            FROM split WHERE len(words) > {window}
            UNION ALL
            SELECT {key}, i + 1,
                   kept + {step} * greatest(0, CAST(ceil((e + counts[i + 1] - kept - {window}) / {step}.0) AS BIGINT)),
                   e + counts[i + 1],
                   CASE WHEN closes THEN s ELSE 0 END, CASE WHEN closes THEN e ELSE 0 END,
                   kept, greatest(0, CAST(ceil((e + counts[i + 1] - kept - {window}) / {step}.0) AS BIGINT)), counts
            FROM (SELECT *, e > s AND e + counts[i + 1] - s > {window} AS closes,
                         CASE WHEN e > s AND e + counts[i + 1] - s > {window} THEN greatest(s, e - {overlap}) ELSE s END AS kept
                  FROM walk WHERE i < len(counts))),
        ranges AS (
            SELECT {key}, i, 0 AS j, closed_from AS a, closed_to AS b FROM walk WHERE closed_to > 0
            UNION ALL
            SELECT {key}, i, 1 + j, first_cut + j * {step}, first_cut + j * {step} + {window}
            FROM (SELECT {key}, i, first_cut, unnest(generate_series(0, cuts - 1)) AS j FROM walk WHERE cuts > 0)
            UNION ALL
            SELECT {key}, i + 1, 0, s, e FROM walk WHERE i = len(counts) AND e > s),
        chunks AS (
            SELECT {key}, 0 AS chunk_index, t AS chunk_text FROM split WHERE len(words) <= {window}
            UNION ALL
            SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY i, j) - 1 AS INTEGER),
                   array_to_string(list_slice(words, a + 1, b), ' ')
            FROM ranges JOIN split USING ({key}))"""


OPERATION = """CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END"""

JOBS = f"""
    SELECT event_id AS id, event_type AS table_name, CAST(user_id AS VARCHAR) AS row_id, 'text' AS column_name,
           {OPERATION} AS operation,
           CASE WHEN value < 50 THEN 'pending' WHEN value < 150 THEN 'processing' ELSE 'failed' END AS status,
           CAST(least(3, floor(value / 50)) AS INTEGER) AS retries, ts AS created_at
    FROM events"""
