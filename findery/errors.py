"""What can go wrong, by what a caller can do about it."""

from __future__ import annotations


class FinderyError(Exception):
    """Any error of this library; ``status`` is the matching HTTP status for services built on it."""

    status = 500


class DocumentNotFound(FinderyError):
    status = 404


class InvalidDocument(FinderyError):
    status = 400


class NotReady(FinderyError):
    """The store or shard is in a state in which it must not answer."""

    status = 503


class StorageError(FinderyError):
    status = 503


class SemanticDisabled(FinderyError):
    """Vectors were asked for, but there is no embedder."""

    status = 503


class IdentityMismatch(FinderyError):
    """Vectors of different embedders must not be compared."""

    status = 409


class ShardFailed(FinderyError):
    """At least one shard has no copy that may answer; there are no partial results."""

    status = 503


class InvalidTopology(FinderyError, ValueError):
    status = 500
