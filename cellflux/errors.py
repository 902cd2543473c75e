"""Errors and warnings: part of the data contract."""

from __future__ import annotations

from collections.abc import Mapping


class DataStandardizationError(Exception):
    """Base of everything that standardisation raises."""


class UnsupportedFormatError(DataStandardizationError):
    """No reader, or no decoder, for this file."""


class MissingColumnError(DataStandardizationError):
    """A needed or selected column is not there."""


class AmbiguousColumnError(DataStandardizationError):
    """Several columns fit equally well; position never decides."""


class UnknownUnitError(DataStandardizationError):
    """A unit is missing or not registered."""


class InvalidUnitError(DataStandardizationError):
    """A registered unit of another quantity."""


class CurrentReconstructionError(DataStandardizationError):
    """Current cannot be derived from capacity."""


class IncompatibleDataError(DataStandardizationError):
    """Data or options break the canonical contract."""


class NonMonotonicTimeError(IncompatibleDataError):
    """Finite time goes backward."""


class CorruptedFileError(DataStandardizationError):
    """A file's structure is broken."""


class MissingDependencyError(DataStandardizationError):
    """An optional part is not installed."""


class OutputExistsError(DataStandardizationError):
    """The destination exists and overwriting was not asked for."""


class DataStandardizationWarning(UserWarning):
    """Base of all warnings."""


class _CountedWarning(DataStandardizationWarning):
    def __init__(self, message: str, affected_counts: Mapping[str, int]):
        super().__init__(message)
        self.affected_counts = dict(affected_counts)


class MissingValueWarning(_CountedWarning):
    """Canonical values are missing."""


class PartialRecoveryWarning(DataStandardizationWarning):
    """Some input could not be used as it stands."""


class MalformedValueWarning(PartialRecoveryWarning, _CountedWarning):
    """Non-empty cells that are no numbers became missing."""
