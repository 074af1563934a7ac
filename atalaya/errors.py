"""Errors raised by contract checks, gates and publication."""

from __future__ import annotations


class ContractError(ValueError):
    """A mapping, column set or value breaks the canonical contract."""


class GateError(ValueError):
    """A data-quality or publication gate found offending rows."""
