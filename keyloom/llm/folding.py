"""Text reduced to plain letters: no case, accents or punctuation, and letters that scanners confuse are one."""

from __future__ import annotations

import unicodedata

#: Letters that are confused with each other, as one; a letter mistaken for two is written as two.
ONE = {"c": "e", "0": "o", "i": "l", "1": "l", "f": "t"}
TWO = {"m": "rn", "h": "ll", "w": "vv"}
#: Byte of a lost letter, and bytes that a caller may put between sentences and sections.
WILD, BREAK, SECTION = 1, 2, 3


def _table(space: int | None) -> tuple[bytes, bytes]:
    to, drop = bytearray(range(256)), bytearray()
    for b in range(256):
        ch = unicodedata.normalize("NFKD", chr(b).lower())[0]
        if b == WILD or (b in (BREAK, SECTION) and space is not None):
            continue
        if ch.isascii() and ch.isalnum():
            to[b] = ord(ONE.get(ch, ch))
        elif space is None:
            drop.append(b)
        else:
            to[b] = space
    return bytes(to), bytes(drop)


_LETTERS, _WORDS = _table(None), _table(32)


def _plain(ch: str) -> str:
    """A character beyond Latin-1: its base letter if that is Latin, the place of a lost letter, or a letter of its own for other scripts."""
    if ch == "�":
        return chr(WILD)
    base = unicodedata.normalize("NFKD", ch)[0]
    if base.isascii():
        return base if base.isalnum() else " "
    return "abdegjklnopqrstuvxyz23456789"[ord(base) % 28] if base.isalnum() else " "


def _fold(text: str, table: tuple[bytes, bytes]) -> bytes:
    text = text.lower().replace("ß", "ss").replace("\x01", " ").replace("\0", " ")
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        raw = "".join([c if c < "Ā" else _plain(c) for c in text]).encode("latin-1")
    raw = raw.translate(*table)
    for a, b in TWO.items():
        raw = raw.replace(a.encode(), b.encode())
    return raw


def letters(text: str) -> bytes:
    """Letters and digits of a text, folded, with nothing between them; byte WILD where a letter was lost."""
    return _fold(text, _LETTERS)


def words(text: str) -> bytes:
    """As ``letters``, with blanks between words; BREAK and SECTION are kept."""
    return _fold(text, _WORDS)
