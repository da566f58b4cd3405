"""Errors of the library. All of them are ValueErrors."""

from __future__ import annotations


class EvidenceError(ValueError):
    """Base class."""


class InvalidContract(EvidenceError):
    """A contract that can't be read."""


class InvalidPattern(EvidenceError):
    """A regular expression that can't be used."""


class MissingColumn(EvidenceError):
    """A column that is asked for isn't there."""


class UnsupportedType(EvidenceError):
    """A value of a type without canonical form."""


class SchemaMismatch(EvidenceError):
    """Two datasets that can't be compared."""


class DuplicateKey(EvidenceError):
    """A key that should name one row names several."""


class NoKeyColumns(EvidenceError):
    """A diff without keys."""


class InvalidReceipt(EvidenceError):
    """A receipt or a report that can't be signed or verified."""
