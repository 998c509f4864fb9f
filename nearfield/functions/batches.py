"""Arrow batches of text in pieces: a task holds Python's copies of one piece at a time, however large Spark's batches are."""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A word: letters and digits of any script.
WORD = r"[^\W_]+"
# Bytes of text that are Python objects at once; a longer text is a piece by itself.
TEXT_BYTES = 2 << 20


def pieces(batch: pa.Array, texts: int | None = None, size: int = TEXT_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of a text column with at most ``texts`` texts, nulls aside, and ``size`` bytes of text.

    Together they are the whole batch; an empty batch is one empty piece.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    present = np.cumsum(np.asarray(batch.is_valid()), dtype=np.int64)
    if not len(batch):
        yield batch
    start = 0
    while start < len(batch):
        before, seen = (ends[start - 1], present[start - 1]) if start else (0, 0)
        end = np.searchsorted(ends, before + size, side="right")
        if texts is not None:
            end = min(end, np.searchsorted(present, seen + texts, side="right"))
        end = max(start + 1, int(end))
        yield batch.slice(start, end - start)
        start = end


def counted_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Distinct words of every text with how often each occurs; null stays null."""
    words = re.compile(WORD)
    for batch in batches:
        for piece in pieces(batch):
            terms: list[str] = []
            numbers: list[int] = []
            offsets = [0]
            for text in piece:
                found = Counter(words.findall(text.as_py().lower()) if text.is_valid else ())
                terms.extend(found.keys())
                numbers.extend(found.values())
                offsets.append(len(terms))
            entries = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(numbers, pa.int64())], ["term", "n"])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries, mask=piece.is_null())
