"""Failures of statements."""


class SqlError(Exception):
    """``kind``: syntax, name, type, arity, exists, not_null, unique, check, trigger, transaction, unsupported."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind
