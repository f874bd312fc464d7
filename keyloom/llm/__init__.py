"""Operators on the texts of a language-model corpus. Nothing outside this package imports it."""
