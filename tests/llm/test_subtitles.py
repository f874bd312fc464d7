import pytest

from keyloom.llm.folding import letters, words
from keyloom.llm.subtitles import adverts, cues, repaired, speech

FILE = """1
00:00:01,000 --> 00:00:02,000
<i>Look at the bond,</i>
{\\an8}then at the [door slams] deficit.

00:00:03,000 --> 00:00:04,000
JOVIK: - What? ♪ soft music ♪

9
00:00:05.000 --> 00:00:06.000 align:start
Support us and become a VIP member
to remove all ads from some.example

4
00:00:07,000 --> 00:00:08,000
(sighs)

5
00:00:09,000 --> 00:00:10,000
- SÜNJE: It is 12:30.
- 1984
"""


@pytest.mark.parametrize("ends", ["\n", "\r\n", "\r"])
def test_speech(ends):
    text = speech(FILE.replace("\n", ends))
    assert text.split() == "Look at the bond, then at the deficit. - What? - It is 12:30. - 1984".split()
    starts, said = cues(FILE.replace("\n", ends))
    assert len(starts) == len(said) == 5 and said[2] == ""
    assert adverts(FILE.replace("\n", ends)) == ["Support us and become a VIP member to remove all ads from some.example"]


def test_notations_and_plain_texts():
    assert speech("WEBVTT\n\n00:30.334 --> 00:33.200\nHallo\n").strip() == "Hallo"
    assert speech("﻿1\n00:00:01,000 --> 00:00:02,000\nHola.").strip() == "Hola."
    assert speech("Just a text (laughs) without times.").split() == "Just a text without times.".split()
    assert speech("") == "" and speech("1\n00:00:01,000 --> 00:00:02,000\n").strip() == ""


@pytest.mark.parametrize("good", ["Suppe erklärt, weiß nicht", "¿Viste cómo la señora?", "I don’t — “know”…"])
def test_encodings(good):
    once = good.encode().decode("cp1252", "replace")
    assert repaired(good.encode().decode("latin-1")) == good
    if "�" not in once:
        assert repaired(once) == good
        twice = once.encode().decode("cp1252", "replace")
        if "�" not in twice:
            assert repaired(twice) == good
    assert repaired(good) == good


def test_cyrillic_reading_of_western_text():
    assert repaired("erklärt für Günter".encode("latin-1").decode("cp1251")) == "erklärt für Günter"
    russian = "Это русский текст, и он таким остаётся."
    assert repaired(russian) == russian


def test_folding():
    assert letters("The witliout financcs B0NO") == letters("the without finances bono")
    assert letters("Niño weiß!") == letters("nino weiss") == letters("NIÑO, WEISS")
    assert letters("modern") == letters("rnodern")
    assert b"\x01" in letters("l�no")
    assert words("a-b  c.\x02d") .split(b"\x02")[0].split() == [b"a", b"b", b"e"]
    assert letters("русский") and letters("русский") != letters("другой") and letters("🙂") == b""
