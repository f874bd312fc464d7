from keyloom.llm import leakage as L
from keyloom.llm.subjects import sentences, spoken
from keyloom.llm.subtitles import adverts, cues, speech

TALK = "The harbour was quiet in the grey morning and nobody saw the two boats leave"
TIMED = "00:00:01,000 --> 00:00:02,000\nHello there.\n"


def test_one_advert_does_not_empty_a_text_without_times():
    for text in (f"{TALK}.\nSubtitles by www.some.example\nThe end.", f"{TALK}. Visit some.example now! The end."):
        assert speech(text).split() == f"{TALK}. The end.".split()
    assert adverts(f"{TALK}.\nVisit some.example now!") == ["Visit some.example now!"]


def test_a_text_without_times_and_without_breaks_loses_the_address_only():
    text = f"{TALK} " * 5 + "www.some.example/page " + TALK
    assert speech(text).split() == (f"{TALK} " * 6).split()
    assert adverts(text) == ["www.some.example/page"]


def test_text_before_the_first_time_line_is_kept():
    assert speech(f"{TALK}.\n\n1\n{TIMED}").split() == f"{TALK}. Hello there.".split()
    assert cues(f"{TALK}.\n\n1\n{TIMED}")[0] == ["", "00:00:01,000"]
    assert speech(f"WEBVTT - title\nLanguage: en\n\nNOTE made\nby hand\n\n{TIMED}").strip() == "Hello there."
    assert speech(f"WEBVTT\n\n{TALK}.\n\n{TIMED}").split() == f"{TALK}. Hello there.".split()


def test_a_plain_text_with_an_advert_leaks():
    passage = "In the misty valley of Otvalos, 1201 tilers once stored barrels of resin from Galbru beneath the stone granary from Otvalmon."
    for text in (f"Good night. {passage}\nSubtitles by www.some.example", f"{passage}\n\n1\n{TIMED}"):
        assert list(L._search(L.Passages([(1, passage)]), [9], [text])) == [(9, 1)]


def test_a_plain_text_with_an_advert_has_sentences():
    assert len(sentences(spoken(f"{TALK}. They came back at night.\nTranslated by nobody."))) == 2
