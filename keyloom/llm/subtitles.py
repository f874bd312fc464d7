"""The speech of subtitle files: what is said, without numbers, times, mark-up, sounds, adverts and speaker names."""

from __future__ import annotations

import re

#: A time line of either notation, with the number line before it if there is one.
_TIMING = re.compile(r"(?:^|\n)[ \t﻿]*(?:\d+[ \t]*\n[ \t]*)?((?:\d+:)?\d+:\d+[.,]\d+)[ \t]*-->[^\n]*")
_NOISE = re.compile(r"<[^<>\0]{1,80}>|\{\\[^{}\0]*\}|\[[^\[\]\0]*\]|\([^()\0]*\)|♪[^♪\0]*♪|\*[^*\0]+\*|[♪*]+")
_SPEAKER = re.compile(r"(?m)(^|\0)([ \t]*(?:[-–—][ \t]*)?)[^\W\d_a-zà-ÿ][^\W\d_a-zà-ÿ'’. -]*:[ \t]")
#: Fixed phrases of credits and of appeals to viewers, beside any web address.
_ADVERT = re.compile(
    r"(?i)\bwww\.|https?:|\b[\w-]+\.(?:example|com|net|org|tv|info|io)\b"
    r"|\bsubtitles by\b|\bsynced and corrected\b|\bcorrected by\b|\btranslated by\b|\bbecome a vip member\b"
    r"|\bsubt.{1,2}tulos (?:de|por)\b|\bsincronizado por\b|\btraducido por\b|\bhazte socio\b"
    r"|\buntertitel (?:von|durch)\b|\bangepasst von\b|\b.{1,2}bersetzt von\b|\bwerde mitglied\b"
)
#: An advert's match and the rest of its address.
_ADVERT_WORDS = re.compile(rf"(?i)(?:{_ADVERT.pattern.removeprefix('(?i)')})\S*")
#: Units of a text without cues: lines, and sentences of a line. The gaps between them are kept.
_UNIT = re.compile(r"(\n+|(?<=[.!?…])[ \t]+)")
#: Letters of a unit that is taken out whole.
LONGEST_ADVERT = 200
#: What a WebVTT file has before its cues: its first block, and blocks of notes, styles and regions.
_HEADER = re.compile(r"\A[ \t\n﻿]*WEBVTT[^\n]*(?:\n[^\n]+)*|(?:\A|(?<=\n))(?:NOTE|STYLE|REGION)\b[^\n]*(?:\n[^\n]+)*")
_HINTS = ".example www. http: https: .com .net .org .tv .info .io subt synced corrected translated vip sincron traducido socio untertitel angepasst bersetzt mitglied".split()
_BROKEN = re.compile("[ÂÃâÐÑ][\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™�]")
_RUN = re.compile("[\u0080-ÿŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™�]{2,}")
_CYRILLIC = re.compile("[Ѐ-ӿ]")


def _reread(run: re.Match) -> str:
    """UTF-8 that was read as a single-byte code page, read as UTF-8 again; what cannot be is left, a lost byte is U+FFFD."""
    out = bytearray()
    for ch in run.group(0):
        try:
            out += ch.encode("cp1252")
        except UnicodeEncodeError:
            if ord(ch) > 255:
                if ch != "�":
                    return run.group(0)
                out.append(0x3F)
            else:
                out.append(ord(ch))
    try:
        return out.decode("utf-8")
    except UnicodeDecodeError:
        text = out.decode("utf-8", "replace")
        return text.replace("�?", "�") if text.count("�") < len(text) else run.group(0)


def repaired(text: str) -> str:
    """The text with wrong encodings undone where they can be told: UTF-8 read as Western (once or twice), Western read as Cyrillic."""
    for _ in range(2):
        if not _BROKEN.search(text):
            break
        text = _RUN.sub(_reread, text)
    if _CYRILLIC.search(text):
        few = len(_CYRILLIC.findall(text)) < 0.2 * len(text)
        if few:
            text = _CYRILLIC.sub(lambda m: m.group(0).encode("cp1251", "replace").decode("latin-1"), text)
    return text


def _split(text: str) -> tuple[str, list[str], list[str]]:
    """The text outside of cues (all of it where no time line is, else what stands before the first), and start times and texts of the cues."""
    text = repaired(text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    plain, *parts = _TIMING.split(text.replace("\0", " "))
    if parts:
        plain = _HEADER.sub("", plain)
        if not any(c.isalpha() for c in plain):
            plain = ""
    return plain, parts[::2], parts[1::2]


def _said(plain: str) -> str:
    """A text without cues less its adverts: sentences or lines; of one that is longer than a cue only the words that make it an advert."""
    return "".join(x if not _ADVERT.search(x) else _ADVERT_WORDS.sub("", x) if len(x) > LONGEST_ADVERT else "" for x in _UNIT.split(plain))


def cues(text: str) -> tuple[list[str], list[str]]:
    """Start times and texts of the cues, cleaned; adverts are empty texts. Text before the first time line, or without any, is one cue that has no start."""
    plain, starts, bodies = _split(text)
    low = "\0".join([plain, *bodies]).lower()
    if any(h in low for h in _HINTS):
        plain, bodies = _said(plain), ["" if _ADVERT.search(b) else b for b in bodies]
    if plain or not starts:
        starts, bodies = ["", *starts], [plain, *bodies]
    joined = _NOISE.sub(" ", "\0".join(bodies))
    if ":" in joined:
        joined = _SPEAKER.sub(r"\1\2", joined)
    return starts, joined.split("\0")


def adverts(text: str) -> list[str]:
    """What ``cues`` takes for adverts, repaired and each on one line."""
    plain, _, bodies = _split(text)
    low = "\0".join([plain, *bodies]).lower()
    if not any(h in low for h in _HINTS):
        return []
    found = [x if len(x) <= LONGEST_ADVERT else " ".join(m.group(0) for m in _ADVERT_WORDS.finditer(x)) for x in _UNIT.split(plain) if _ADVERT.search(x)]
    return [" ".join(b.split()) for b in [*found, *(b for b in bodies if _ADVERT.search(b))]]


def speech(text: str) -> str:
    """All that is said, cue after cue."""
    return "\n".join(cues(text)[1])
