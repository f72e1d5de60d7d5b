"""Errors raised by the jobs. ``error_id`` values are fixed: callers match on them."""

from __future__ import annotations


class FeaturelineError(Exception):
    error_id = "1000"


class ModelNotFound(FeaturelineError):
    error_id = "1004"


class ModelConflict(FeaturelineError):
    error_id = "1009"


class ChampionMissing(FeaturelineError):
    error_id = "1012"


class TrainingError(FeaturelineError):
    error_id = "2000"


class EmptyDataset(TrainingError):
    error_id = "2001"


class SchemaMismatch(FeaturelineError):
    """A table does not have the declared columns or types."""


class InvalidRows(FeaturelineError):
    """At least one row breaks a row rule; the message carries a few samples."""


class MissingFeatures(FeaturelineError):
    """Null features met the ``fail`` policy."""
