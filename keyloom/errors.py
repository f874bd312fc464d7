"""Errors of the dialect. The numbers are fixed values."""

from __future__ import annotations


class KeyloomError(Exception):
    code = 0


class IllegalToken(KeyloomError):
    code = 3


class MalformedQuery(KeyloomError):
    code = 4


class InvalidContext(KeyloomError):
    code = 6


class ColumnNotFound(KeyloomError):
    code = 7


class TableNotFound(KeyloomError):
    code = 8


class TableAlreadyExists(KeyloomError):
    code = 9


class PrimaryColumnNotIncluded(KeyloomError):
    code = 10


class OnlyOnePrimaryColumn(KeyloomError):
    code = 11


class ColumnNameAlreadyDefined(KeyloomError):
    code = 12


class UnknownColumn(KeyloomError):
    code = 13


class InvalidType(KeyloomError):
    code = 14


class DatabaseAlreadyExists(KeyloomError):
    code = 16


class DatabaseNotFound(KeyloomError):
    code = 17


class IndexAlreadyExists(KeyloomError):
    code = 62


class IllegalOperation(KeyloomError):
    code = 66


class InvalidOption(KeyloomError):
    """An option or its value that does not exist. Its number is of our own."""

    code = 200
