"""Errors raised while a plan is being built or a write is being checked."""

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

# What a failing Spark job raises, depending on where it fails.
JOB_ERRORS = (PySparkException, Py4JJavaError)


class NearfieldError(Exception):
    """Base class of every error this package raises on purpose."""


class InvalidFilterError(NearfieldError):
    """A search filter names a column the table does not have."""


class DimensionMismatchError(NearfieldError):
    """A vector does not have the number of dimensions its table declares."""


class RegistryError(NearfieldError):
    """The table registry is missing, unreadable or inconsistent."""


class UnknownModelError(NearfieldError):
    """No embedding model is registered under the requested name."""


class UnsafeQueryError(NearfieldError):
    """A query text is not a single read-only SELECT."""


class CommitConflictError(NearfieldError):
    """Another writer committed to the same embedding table first."""
