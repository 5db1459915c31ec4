"""Errors by category, each with its exit code."""

from __future__ import annotations

from typing import Any


class ReconError(Exception):
    category, code = "interno", 10

    def __init__(self, message: str, details: dict[str, Any] | None = None, hint: str | None = None):
        super().__init__(message)
        self.details, self.hint = details or {}, hint


class UserInputError(ReconError):
    category, code = "entrada", 2


class ConfigError(ReconError):
    category, code = "configuracion", 3


class IngestionError(ReconError):
    category, code = "ingestion", 4


class ContractError(ReconError):
    category, code = "contrato", 5


class IoError(ReconError):
    category, code = "io", 6


CODES = {c.category: c.code for c in (UserInputError, ConfigError, IngestionError, ContractError, IoError, ReconError)}


def classify(error: BaseException) -> tuple[str, int]:
    """(category, exit code) of any exception; file trouble is io, everything unknown internal."""
    if isinstance(error, ReconError):
        return error.category, error.code
    if isinstance(error, FileNotFoundError | IsADirectoryError):
        return "entrada", CODES["entrada"]
    if isinstance(error, OSError):
        return "io", CODES["io"]
    return "interno", CODES["interno"]


def kind_of(error: BaseException) -> str:
    """What the result of `validate` calls an error (fixed values)."""
    if isinstance(error, OSError):
        return "io"
    return next((kind for cls, kind in ((ConfigError, "config"), (IngestionError, "ingestion"), (ContractError, "contract"), (IoError, "io")) if isinstance(error, cls)), "internal")


#: Exit codes by those names; any other is like ingestion.
KIND_CODES = {"config": 3, "ingestion": 4, "contract": 5, "io": 6}
