"""Packing of token sequences by best-fit decreasing.

Documents longer than a window are first cut into full windows; what is left of them, and all shorter documents,
go in order of falling length into the tightest open window that still has room. A segment tree over remaining
capacities finds that window in log2(window) steps whatever the number of open windows.

Every task packs the documents of its own partition, so nothing is shuffled and what a task holds is one small
record per document. Rows that a window is short of at the end of a task are its only padding; tasks that read
tens of thousands of documents lose well under one part in a thousand, tasks that read a few dozen some percent.

Null texts count as empty: a document without text is its end token alone. Repeated rows are packed each. Pieces of equal
length are placed in the order in which they come. Texts may be of any length and hold any runs of white space. An
empty table gives no rows; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from nearfield.llm.tasks import map_rows, text_rows

WINDOW = 1024
END_TOKEN = 0
# Documents packed together at most: bounds a task's memory (about 100 bytes each) when a partition is very large.
BLOCK = 1_000_000
# Runs of white space from which on the tokenizers library itself is asked; the pattern takes all of a run at once.
LONG_SPACE = 10_000
SPACES = re.compile(r"\s{256,}+")
PACKED = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")


class Capacities:
    """Open windows by remaining capacity, with a segment tree that counts them."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self._change(capacity, 1)

    def tightest(self, needed: int) -> tuple[int, int] | None:
        """Takes out the window with the least capacity of at least ``needed``; gives it and its capacity."""
        node = needed + self.size
        if not self.count[node]:
            # climb until a right neighbour holds a window, then go down to its least capacity
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node + (not self.count[2 * node])
        capacity = node - self.size
        self._change(capacity, -1)
        return self.windows[capacity].pop(), capacity

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += by
            node >>= 1


def best_fit_decreasing(lengths: Iterable[int], window: int) -> list[tuple[int, int]]:
    """Window and offset of every length (1 to ``window``), in the given order; windows count from 0."""
    lengths = np.asarray(lengths, dtype=np.int64)
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    open_windows, used = Capacities(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = open_windows.tightest(length)
        if found is None:
            at, capacity = used, window
            used += 1
        else:
            at, capacity = found
        placed[i] = at, window - capacity
        if capacity > length:
            open_windows.add(capacity - length, at)
    return placed


class Tokens:
    """Ids of whole texts as the tokenizers library gives them for a file of its own.

    Where the file's merges come in the order of their ids and its texts are split by the public pattern, the ids are
    those of the tiktoken library for the same byte strings, which is several times faster; otherwise the tokenizers
    library itself is used. The file's added tokens, such as <|endoftext|>, have their ids where texts hold them.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        ranks = _ranks(said)
        if ranks is not None:
            fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                     special_tokens={t["content"]: t["id"] for t in said.get("added_tokens") or ()})
            self.fast = lambda text: fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        self.path, self._slow = path, None

    fast = None

    def encode(self, text: str) -> bytes:
        # the pattern of the faster library steps back over white space and gives up on very long runs of it
        if self.fast is None or len(text) >= LONG_SPACE and any(
                m.end() - m.start() >= LONG_SPACE for m in SPACES.finditer(text)):
            return self.slow(text)
        return self.fast(text)

    def slow(self, text: str) -> bytes:
        if self._slow is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            self._slow = tokenizers.Tokenizer.from_file(self.path)
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def _ranks(said: dict) -> dict[bytes, int] | None:
    """Byte strings with their ids, if ids alone decide which merge comes first; else None."""
    model, split = said["model"], said["pre_tokenizer"] or {}
    plain = (model["type"] == "BPE" and said["normalizer"] is None and split.get("type") == "ByteLevel"
             and split.get("use_regex") and not split.get("add_prefix_space") and not model.get("ignore_merges")
             and not model.get("dropout") and not model.get("byte_fallback"))
    if not plain:
        return None
    vocabulary = model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    order = [vocabulary[left + right] for left, right in merges]
    added = said.get("added_tokens") or ()
    special = {t["content"] for t in added}
    # with options, or where one begins another, added tokens are found in ways of the library's own
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")) or any(
            a != b and a.startswith(b) for a in special for b in special):
        return None
    # byte-level files write a byte as a printable character: itself, or the next free one from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(shown)))}
    words = {w: i for w, i in vocabulary.items() if w not in special}
    if any(a >= b for a, b in zip(order, order[1:])) or len(words) != 256 + len(merges) or not set("".join(words)) <= byte.keys():
        return None
    return {bytes(byte[c] for c in word): rank for word, rank in words.items()}


_TOKENS: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One per Python worker and file."""
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """One row per piece of a document: where it begins in the document, and its sequence and offset there.

    ``sequence_id`` holds the task's number in its upper bits, so that ids of different tasks never meet.
    """
    end = np.array([END_TOKEN], dtype="<u4").tobytes()

    def pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
        encode = tokens(path).encode
        for doc_id, text in rows:
            ids = encode(text) + end
            total = len(ids) // 4
            for start in range(0, total, window):
                part = ids[4 * start : 4 * (start + window)]
                yield doc_id, start, len(part) // 4, zlib.crc32(part), total

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        tails: list[tuple] = []

        def placed() -> Iterator[tuple]:
            for piece, (at, offset) in zip(tails, best_fit_decreasing([t[2] for t in tails], window)):
                yield (*piece, sequence + at, offset)

        for piece in pieces(rows):
            if piece[2] == window:
                yield (*piece, sequence, 0)
                sequence += 1
                continue
            tails.append(piece)
            if len(tails) == BLOCK:
                yield from placed()
                sequence, tails = sequence + BLOCK, []
        yield from placed()

    return map_rows(text_rows(docs), each, PACKED)
