"""Databases of keyed, versioned tables, and sessions that run statements on them."""

from keyloom.engine.session import Engine, Options, Result, Session
from keyloom.engine.store import KeyValues

__all__ = ["Engine", "KeyValues", "Options", "Result", "Session"]
