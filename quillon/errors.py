"""The one error of the engine; `kind` tells what went wrong."""

from __future__ import annotations

KINDS = ("InvalidInput", "DimensionMismatch", "EmbeddingMismatch", "CapacityExceeded", "Conflict", "Corrupt", "Locked", "NotFound", "AlreadyExists", "Io")


class EngineError(Exception):
    def __init__(self, kind: str, message: str, **fields):
        if kind not in KINDS:
            raise ValueError(kind)
        super().__init__(f"{kind}: {message}")
        self.kind, self.fields = kind, fields


def invalid(message: str, **fields) -> EngineError:
    return EngineError("InvalidInput", message, **fields)
