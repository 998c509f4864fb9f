"""Fill-in-the-middle: a document is cut at two units and its parts are put in the order that training asks for.

A unit is a word with the white space before it; white space at the end is a unit of its own. A rolling hash cuts a
text into chunks by its content, so that texts which share a passage share most of its chunks. What a chunk says
about units (where its words end, whether its edges are within a word, its code points) is kept in a cache of bounded
size; a chunk is found there by its hash and taken only if its bytes are the same. Summaries put side by side give the
units of the text: a word that goes on in the next chunk ends there. Running sums lead to the chunk that a cut lies in.

Cuts and form follow from the id alone, by the four first numbers of a digest of seed and id. Null ids count as the
empty text, null texts as empty. Empty texts, and texts that hold a marker, stay as they are (form plain). Rows that
are equal give equal rows; two cuts at the same unit leave an empty middle. Texts may be of any length: beside the text
itself only one block of hashes is held. An empty table gives no rows; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.tasks import map_rows, text_rows

SEED = 42
# Percent of documents that are cut, and percent of these that begin with their suffix.
CUT, SUFFIX_FIRST = 50, 80
# What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

# A chunk ends where the upper bits of the hash of the last 32 bytes are 0: about every 1,024 bytes, within bounds.
CHUNK_BITS, LEAST_CHUNK, MOST_CHUNK = 10, 256, 8192
HASHED = 32
# Bytes that are hashed at a time, and bytes of chunks that a task's cache holds at most.
BLOCK, CACHE_BYTES = 1 << 20, 32 << 20
_GEAR = np.random.default_rng(13).integers(0, 1 << 32, 256, dtype=np.uint32)

FORMED = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


class Summary(NamedTuple):
    """Ends of the words within a chunk, whether it begins and ends within a word, and its code points."""

    ends: np.ndarray
    first: bool
    last: bool
    chars: int


def summary(chunk: bytes) -> Summary:
    data = np.frombuffer(chunk, np.uint8)
    solid = _solid(data)
    ends = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
    if solid[-1]:
        ends = np.append(ends, len(data))
    return Summary(ends.astype(np.uint16), bool(solid[0]), bool(solid[-1]), _chars(data))


def _solid(data: np.ndarray) -> np.ndarray:
    return (data != 32) & ((data < 9) | (data > 13))


def _chars(data: np.ndarray) -> int:
    """Code points that begin in these bytes of UTF-8."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def chunk_ends(data: bytes) -> list[int]:
    """Where chunks end; each cut depends on the bytes shortly before it, so equal passages are cut alike."""
    whole = np.frombuffer(data, np.uint8)
    ends: list[int] = []
    start = 0

    def close(end: int) -> None:
        nonlocal start
        while end - start > MOST_CHUNK:
            start += MOST_CHUNK
            ends.append(start)
        if end - start >= LEAST_CHUNK:
            start = end
            ends.append(end)

    for begin in range(0, len(whole), BLOCK):
        before = max(0, begin - HASHED + 1)
        hashes = _GEAR[whole[before : begin + BLOCK]]
        step = 1
        while step < HASHED:
            # twice as many bytes with every round
            hashes[step:] = hashes[step:] + (hashes[:-step] << np.uint32(step))
            step *= 2
        for at in np.flatnonzero(hashes[begin - before :] >> np.uint32(32 - CHUNK_BITS) == 0).tolist():
            close(begin + at + 1)
    close(len(whole))
    if start < len(whole):
        ends.append(len(whole))
    return ends


class Cache:
    """Summaries of chunks by their bytes; the oldest go first."""

    def __init__(self, most: int = CACHE_BYTES) -> None:
        self.known: dict[bytes, Summary] = {}
        self.most, self.held, self.hits, self.asked = most, 0, 0, 0

    def get(self, chunk: bytes) -> Summary:
        self.asked += 1
        # a dictionary finds by hash and takes only equal bytes
        found = self.known.get(chunk)
        if found is not None:
            self.hits += 1
            return found
        found = summary(chunk)
        self.known[chunk] = found
        self.held += len(chunk) + found.ends.nbytes
        while self.held > self.most:
            oldest = next(iter(self.known))
            self.held -= len(oldest) + self.known.pop(oldest).ends.nbytes
        return found


class Units:
    """The units of a text, from the summaries of its chunks."""

    def __init__(self, data: bytes, cache: Cache) -> None:
        self.data = data
        self.ends = chunk_ends(data)
        self.starts = [0, *self.ends[:-1]]
        self.parts = [cache.get(data[a:b]) for a, b in zip(self.starts, self.ends)]
        # a word that goes on in the next chunk does not end here
        goes_on = [a.last and b.first for a, b in zip(self.parts, self.parts[1:])] + [False]
        self.words = np.cumsum([len(p.ends) - g for p, g in zip(self.parts, goes_on)], dtype=np.int64)
        self.chars = np.cumsum([p.chars for p in self.parts], dtype=np.int64)
        self.n = int(self.words[-1]) + (not self.parts[-1].last) if self.parts else 0

    def end(self, unit: int) -> tuple[int, int]:
        """Bytes and code points of the first ``unit`` units."""
        if unit == 0:
            return 0, 0
        if unit > self.words[-1]:
            return len(self.data), int(self.chars[-1])
        at = int(np.searchsorted(self.words, unit))
        before, chars = (int(self.words[at - 1]), int(self.chars[at - 1])) if at else (0, 0)
        offset = int(self.parts[at].ends[unit - before - 1])
        start = self.starts[at]
        return start + offset, chars + _chars(np.frombuffer(self.data, np.uint8, offset, start))


def draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def formed(doc_id: int | None, text: str, cache: Cache, seed: int, cut: int, suffix_first: int) -> tuple:
    data = text.encode()
    units = Units(data, cache)
    one, two, whether, which = draws(doc_id, seed)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or whether % 100 >= cut:
        return doc_id, units.n, "plain", None, None, text
    first, second = sorted((one % (units.n + 1), two % (units.n + 1)))
    (a, a_chars), (b, b_chars) = units.end(first), units.end(second)
    prefix, middle, suffix = (part.decode() for part in (data[:a], data[a:b], data[b:]))
    if which % 100 < suffix_first:
        form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return doc_id, units.n, form, a_chars, b_chars - a_chars, output


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, cache_bytes: int = CACHE_BYTES
) -> DataFrame:
    """doc_id, units, form, code points of prefix and middle (null if plain), and the text in its new order.

    A map: no shuffle. Every task has a cache of its own; what it holds never changes a result.
    """

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        cache = Cache(cache_bytes)
        for doc_id, text in rows:
            yield formed(doc_id, text, cache, seed, cut, suffix_first)

    return map_rows(text_rows(docs), each, FORMED)


def restored(output: Column, form: Column) -> Column:
    """The text as it was. No text that is cut holds a marker, so the first of each is the one that was put there."""

    def between(marker: str, following: str | None) -> Column:
        start = F.instr(output, F.lit(marker)) + len(marker)
        if following is None:
            return F.substring(output, start, F.char_length(output))
        return F.substring(output, start, F.instr(output, F.lit(following)) - start)

    middle = between(MIDDLE, None)
    return (F.when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
            .when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
            .otherwise(output))
