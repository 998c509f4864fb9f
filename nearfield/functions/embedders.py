"""Embedding models: what a model is, the known models, and the built-in word-hash model."""

import hashlib
import re
import sys
import types
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield.errors import DimensionMismatchError, UnknownModelError
from nearfield.functions.batches import WORD, pieces

# Provider key, model name and vector dimensions of the known models; batch sizes.
KNOWN_MODELS = {
    "local": ("all-MiniLM-L6-v2", 384),
    "local-mpnet": ("all-mpnet-base-v2", 768),
    "openai": ("text-embedding-3-small", 1536),
    "openai-large": ("text-embedding-3-large", 3072),
    "ollama": ("nomic-embed-text", 768),
}
BATCH_SIZE = 32
REMOTE_BATCH_SIZE = 100
# Words whose slots a process remembers, and their length at most.
KNOWN_WORDS, KNOWN_LENGTH = 1 << 17, 32

Encoder = Callable[[list[str]], Sequence[Sequence[float]]]


@dataclass(frozen=True)
class Embedder:
    """A model: ``factory`` is called once per Python worker process and returns ``texts -> vectors``."""

    key: str
    model_name: str
    dims: int
    factory: Callable[[], Encoder] | None = None
    batch_size: int = BATCH_SIZE
    identity: str = field(default_factory=lambda: uuid.uuid4().hex, compare=False, repr=False)

    def column(self, text: Column) -> Column:
        """Embed a text column; only that column crosses to Python, in Arrow batches."""
        factory, dims, size, identity = self._require_factory(), self.dims, self.batch_size, self.identity

        def embed_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encode = loaded(identity, factory)
            for piece in (p for batch in batches for p in pieces(batch, size)):
                present = piece.drop_null().to_pylist()
                matrix = np.zeros((0, dims), dtype=np.float32)
                if present:
                    matrix = np.asarray(encode(present), dtype=np.float32)
                if matrix.shape != (len(present), dims):
                    raise ValueError(f"model returned shape {matrix.shape}, expected {dims} dimensions")
                offsets = np.concatenate([[0], np.cumsum(np.asarray(piece.is_valid()).astype(np.int32) * dims)])
                yield pa.ListArray.from_arrays(
                    pa.array(offsets.astype(np.int32)), pa.array(matrix.reshape(-1)), mask=piece.is_null()
                )

        # not repeatable as far as Catalyst knows, or it would copy the call into filters on its result
        return F.arrow_udf(embed_batches, "array<float>").asNondeterministic()(text)

    def column_or_error(self, text: Column) -> Column:
        """Embed a text column to struct<embedding, error>: a text that the model refuses has an error instead.

        Only when a batch fails are its texts tried one by one.
        """
        factory, dims, size, identity = self._require_factory(), self.dims, self.batch_size, self.identity
        result = pa.struct([("embedding", pa.list_(pa.float32())), ("error", pa.string())])

        def shaped(vectors: Sequence[Sequence[float]], n: int) -> list[list[float]]:
            matrix = np.asarray(vectors, dtype=np.float32)
            if matrix.shape != (n, dims):
                raise ValueError(f"model returned shape {matrix.shape}, expected {dims} dimensions")
            return matrix.tolist()

        def embed_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encode = loaded(identity, factory)

            def tried(texts: list[str]) -> list[dict]:
                try:
                    return [{"embedding": v, "error": None} for v in shaped(encode(texts), len(texts))]
                except Exception as error:  # whatever a model raises belongs to the text
                    if len(texts) == 1:
                        return [{"embedding": None, "error": f"{type(error).__name__}: {error}"}]
                    return [one for text in texts for one in tried([text])]

            for piece in (p for batch in batches for p in pieces(batch, size)):
                texts = piece.to_pylist()
                present = [t for t in texts if t is not None]
                found = iter(tried(present) if present else [])
                yield pa.array([None if t is None else next(found) for t in texts], result)

        return F.arrow_udf(embed_batches, "struct<embedding:array<float>,error:string>").asNondeterministic()(text)

    def embed_query(self, text: str) -> list[float]:
        """Embed one short query text on the driver, with a model that is loaded once."""
        vector = [float(x) for x in loaded(self.identity, self._require_factory())([text])[0]]
        if len(vector) != self.dims:
            raise DimensionMismatchError(f"{self.key} returned {len(vector)} dimensions, declared {self.dims}")
        return vector

    def _require_factory(self) -> Callable[[], Encoder]:
        if self.factory is None:
            raise UnknownModelError(f"model {self.key!r} has no provider; register one with a factory")
        return self.factory


def loaded(identity: str, factory: Callable[[], Encoder]) -> Encoder:
    """Processes are reused from task to task and query to query, and so is a model they have loaded."""
    models = sys.modules.setdefault("_nearfield_loaded", types.ModuleType("_nearfield_loaded")).__dict__
    if identity not in models:
        models[identity] = factory()
    return models[identity]


def hash_embedder(dims: int = 64) -> Embedder:
    """Signed counts of hashed words. Matches shared words, not meaning; needs no model files.

    Components are whole numbers, so cosine similarities do not depend on summation order.
    """

    def factory() -> Encoder:
        words = re.compile(WORD)

        class Slots(dict):
            def __missing__(self, word):
                digest = hashlib.md5(word.encode()).hexdigest()
                slot = int(digest[:4], 16) % dims + (dims if digest[4] >= "8" else 0)
                if len(word) <= KNOWN_LENGTH:
                    if len(self) >= KNOWN_WORDS:
                        self.clear()
                    self[word] = slot
                return slot

        slot_of = Slots().__getitem__

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dims), dtype=np.float32)
            for i, text in enumerate(texts):
                slots = list(map(slot_of, words.findall(text.lower())))
                if slots:
                    counts = np.bincount(slots, minlength=2 * dims)
                    out[i] = counts[:dims] - counts[dims:]
            return out

        return encode

    name = f"md5-word-hash-{dims}"
    return Embedder(f"hash-{dims}", name, dims, factory, batch_size=1024, identity=name)


class Models:
    """The models a session can use; known names without a provider resolve but cannot embed."""

    def __init__(self) -> None:
        self._by_key = {
            key: Embedder(key, name, dims, None, REMOTE_BATCH_SIZE if key.startswith("openai") else BATCH_SIZE)
            for key, (name, dims) in KNOWN_MODELS.items()
        }
        for dims in (64, 128, 256):
            self.register(hash_embedder(dims))

    def register(self, model: Embedder) -> None:
        self._by_key[model.key] = model

    def provide(self, key: str, factory: Callable[[], Encoder]) -> Embedder:
        """Attach a provider to a known model."""
        known = self.get(key)
        model = Embedder(known.key, known.model_name, known.dims, factory, known.batch_size)
        self.register(model)
        return model

    def get(self, key: str) -> Embedder:
        if key not in self._by_key:
            raise UnknownModelError(f"unknown model {key!r}; known: {', '.join(sorted(self._by_key))}")
        return self._by_key[key]

    def provided(self, key: str) -> Embedder | None:
        model = self._by_key.get(key)
        return model if model is not None and model.factory is not None else None
