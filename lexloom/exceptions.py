"""Errors of the library."""


class LexloomError(Exception):
    """Base of all errors raised here."""


class InvalidFile(LexloomError):
    """A suite or rule file that cannot be used."""
