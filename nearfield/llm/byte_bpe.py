"""Byte-level BPE by prefix dynamic programming.

BPE has one property that makes it a dynamic program: a token sequence is the encoding of its bytes exactly when
each token encodes itself and each neighbouring pair encodes itself. So every byte prefix of a piece has one valid
last token, and that token depends only on bytes before it. Storing it per prefix gives

* encoding: follow the stored tokens back from the end;
* exact appends: prefixes already stored never change, only new ends are computed;
* edits: prefixes before the edit stay, and pieces of the text away from it are not touched at all.

Null texts count as empty. Repeated rows give repeated results. An empty text has no tokens.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import math
import struct
from collections.abc import Iterator

import public_tokenizers
import regex
from pyspark.sql import DataFrame

from nearfield.llm.tasks import map_rows, text_rows

# Distinct pieces whose ids a task keeps; when full, the memory is emptied.
KEPT_PIECES = 1_500_000
# Longer pieces are encoded each time, so that the kept ones stay small.
KEPT_LENGTH = 64
# Prefixes of pieces, up to a length in bytes, whose last token a task keeps for all pieces.
SHARED_PREFIXES, SHARED_LENGTH = 1_000_000, 32


class Vocabulary:
    """Ranks of byte strings, and which pairs of tokens may follow one another."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._pairs: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._edges: dict[tuple[int, bool], list[tuple[bytes, float]]] = {}
        self.prefixes: dict[bytes, int] = {}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE by repeated merging of the lowest rank; only used on the few bytes of one or two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes encode to it alone."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def edge(self, token: int, right: bool) -> list[tuple[bytes, float]]:
        """The parts that stand at one end of a token while its bytes are merged, from a single byte to the whole,
        each with the rank of the merge that takes it in."""
        known = self._edges.get((token, right))
        if known is None:
            data, ranks = self.bytes_of[token], self.ranks
            parts = [data[i : i + 1] for i in range(len(data))]
            at_end = [parts[-1 if right else 0]]
            while len(parts) > 1:
                _, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if parts[-1 if right else 0] != at_end[-1]:
                    at_end.append(parts[-1 if right else 0])
            taken_in = [ranks.get(p, math.inf) for p in at_end[1:]] + [math.inf]
            known = self._edges[token, right] = list(zip(at_end, taken_in))
        return known

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens together encode to this pair.

        Merges happen in order of rank, as a token's parts have lower ranks than itself. So only the parts on both
        sides of the boundary matter: if at some time they would merge with one another before either is taken in
        by its own neighbour, the boundary is lost. Of equal ranks the one further left merges first.
        """
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
            ranks, before, after = self.ranks, self.edge(left, True), self.edge(right, False)
            i = j = 0
            known = True
            while known:
                (a, a_goes), (b, b_goes) = before[i], after[j]
                across = ranks.get(a + b, math.inf)
                if across < a_goes and across <= b_goes and across < math.inf:
                    known = False
                elif a_goes == b_goes == math.inf:
                    break
                elif a_goes <= b_goes:
                    i += 1
                else:
                    j += 1
            self._pairs[left, right] = known
        return known


    def last_token(self, prefix: bytes) -> int:
        """The same table as ``Prefixes`` for short pieces, filled only where it is asked for and shared by all
        pieces that begin alike."""
        token = self.prefixes.get(prefix)
        if token is None:
            ranks, pairs = self.ranks, self._pairs
            for start in range(max(0, len(prefix) - self.longest), len(prefix)):
                token = ranks.get(prefix[start:])
                if token is None:
                    continue
                if start == 0:
                    if self.whole(token):
                        break
                else:
                    before = self.last_token(prefix[:start])
                    fits = pairs.get((before, token))
                    if fits or fits is None and self.whole(token) and self.may_follow(before, token):
                        break
            else:
                raise ValueError("a byte of the text has no token")
            if len(self.prefixes) >= SHARED_PREFIXES:
                self.prefixes.clear()
            self.prefixes[prefix] = token
        return token

    def encode(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        if len(data) > SHARED_LENGTH:
            return Prefixes(self, data).ids()
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        found, at = [], len(data)
        while at:
            found.append(self.last_token(data[:at]))
            at -= len(self.bytes_of[found[-1]])
        return found[::-1]


class Prefixes:
    """The last token of every byte prefix of one piece; grows at the end and can be cut back to any prefix."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: what is stored for earlier prefixes stays."""
        v, last = self.vocabulary, self.last
        ranks, pairs = v.ranks, v._pairs
        done = len(self.data)
        self.data = data = self.data + more
        for end in range(done + 1, len(data) + 1):
            for start in range(max(0, end - v.longest), end):
                token = ranks.get(data[start:end])
                if token is None:
                    continue
                if start == 0:
                    if v.whole(token):
                        break
                else:
                    before = last[start - 1]
                    fits = pairs.get((before, token))
                    if fits or fits is None and v.whole(token) and v.may_follow(before, token):
                        break
            else:
                raise ValueError("a byte of the text has no token")
            last.append(token)

    def cut(self, length: int) -> None:
        self.data, self.last = self.data[:length], self.last[:length]

    def edit(self, start: int, end: int, replacement: bytes) -> None:
        """Replace bytes; the prefixes before ``start`` are kept."""
        rest = self.data[end:]
        self.cut(start)
        self.append(replacement + rest)

    def ids(self) -> list[int]:
        whole = self.vocabulary.ranks.get(self.data)
        if whole is not None:
            return [whole]
        found, at = [], len(self.data)
        while at:
            found.append(self.last[at - 1])
            at -= len(self.vocabulary.bytes_of[found[-1]])
        return found[::-1]


class Pieces(dict):
    """Ids of pieces already seen, as bytes; a piece that is asked for the first time is encoded."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        ids = self.vocabulary.encode(piece.encode())
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = found
        return found


class Encoder:
    """Encodes texts piece by piece; ids are little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        self.vocabulary, self.split = vocabulary, regex.compile(pattern)
        self.piece = Pieces(vocabulary).__getitem__

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.split.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, memoryview(ids).cast("I")))


class EncodedText:
    """A text with its ids that can be appended to and edited; only pieces near the change are split and encoded anew.

    A match of the pattern looks at no more than two characters behind its own end, so pieces that end earlier
    than that before the change stay, and so do pieces behind it from the first boundary that lines up again.
    """

    LOOKS_AHEAD = 2

    def __init__(self, encoder: Encoder, text: str = "") -> None:
        self.encoder, self.text = encoder, ""
        self._ends: list[int] = []
        self._ids: list[bytes] = []
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, replacement: str) -> int:
        """Replace characters; gives the number of pieces encoded anew."""
        keep = bisect.bisect_left(self._ends, start - self.LOOKS_AHEAD + 1)
        at = self._ends[keep - 1] if keep else 0
        shift = start + len(replacement) - end
        self.text = self.text[:start] + replacement + self.text[end:]
        ends, ids, old = [], [], self._ends
        for match in self.encoder.split.finditer(self.text, at):
            ends.append(match.end())
            ids.append(self.encoder.piece(match.group()))
            if match.end() - shift >= end:
                again = bisect.bisect_left(old, match.end() - shift)
                if again < len(old) and old[again] == match.end() - shift:
                    ends += [x + shift for x in old[again + 1 :]]
                    self._ids[keep:] = ids + self._ids[again + 1 :]
                    self._ends = old[:keep] + ends
                    return len(ids)
        self._ids[keep:], self._ends = ids, old[:keep] + ends
        return len(ids)

    def ids(self) -> bytes:
        return b"".join(self._ids)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    """One per Python worker and vocabulary file."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(Vocabulary.read(path), pattern)
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every whole text. A map: no shuffle."""

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        e = encoder(path)
        return ((doc_id, e.encode(text)) for doc_id, text in rows)

    return map_rows(text_rows(docs), each, "doc_id bigint, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the bytes of the ids; they are not always a string, as ids may be cut anywhere."""

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        e = encoder(path)
        return ((doc_id, e.decode(ids)) for doc_id, ids in rows)

    return map_rows(encoded.select("doc_id", "ids"), each, "doc_id bigint, bytes binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of tokens, the hash of its ids and the hash of what those ids decode to."""

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        e = encoder(path)
        for doc_id, text in rows:
            ids = e.encode(text)
            yield doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(e.decode(ids)).hexdigest()

    return map_rows(text_rows(docs), each, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
