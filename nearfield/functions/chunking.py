"""Split long text into overlapping runs of whole sentences."""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield.errors import NearfieldError
from nearfield.functions.batches import pieces

# Default window, overlap and sentence boundary.
MAX_WORDS = 256
OVERLAP = 64
SENTENCE_BREAK = r"(?<=[.!?])\s+"


def check_window(max_words: int, overlap: int) -> None:
    """An overlap as long as the window would never move forward."""
    if max_words < 1 or overlap < 0 or overlap >= max_words:
        raise NearfieldError(f"need 0 <= overlap < max_words, got overlap={overlap}, max_words={max_words}")


def windows(sentence_lengths: list[int], max_words: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks as half-open ranges of word positions.

    The words waiting for the next chunk are always one run [start, end) of the text, so two
    counters describe the state: a sentence that does not fit closes the run and leaves its last
    ``overlap`` words behind, and a run longer than the window is cut at fixed steps.
    """
    step = max_words - overlap
    start = end = 0
    ranges = []
    for length in sentence_lengths:
        if end > start and end + length - start > max_words:
            ranges.append((start, end))
            start = max(start, end - overlap)
        end += length
        cuts = max(0, -((start + max_words - end) // step))
        ranges.extend((start + i * step, start + i * step + max_words) for i in range(cuts))
        start += cuts * step
    if end > start:
        ranges.append((start, end))
    return ranges


def chunk_column(
    text: Column, max_words: int = MAX_WORDS, overlap: int = OVERLAP, max_chunks: int | None = None
) -> Column:
    """Array of chunks per text; null stays null and blank text gives an empty array.

    Word splitting has to follow Unicode whitespace, which Spark's string functions do not, so this
    is an Arrow UDF over the text column alone. ``max_chunks`` is off unless asked for: by default
    the whole text is chunked.
    """
    check_window(max_words, overlap)
    cut_windows = windows
    boundary = SENTENCE_BREAK

    def split_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sentence_break = re.compile(boundary)

        def split(value):
            words = value.split()
            if len(words) <= max_words:
                return [value.strip()] if words else []
            lengths = [len(s.split()) for s in sentence_break.split(value.strip())]
            ranges = cut_windows(lengths, max_words, overlap)[:max_chunks]
            return [" ".join(words[a:b]) for a, b in ranges]

        for piece in (p for batch in batches for p in pieces(batch)):
            rows = [None if v is None else split(v) for v in piece.to_pylist()]
            yield pa.array(rows, type=pa.list_(pa.string()))

    # see Embedder.column: keeps Catalyst from calling it twice
    return F.arrow_udf(split_batches, "array<string>").asNondeterministic()(text)
