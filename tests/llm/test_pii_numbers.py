import time

import pytest

from tidemark.llm import pii


def added(text):
    return [(k, text[a:b]) for a, k, b in pii.hidden_spans(text, pii.base_spans(text))]


@pytest.mark.parametrize(
    ("kind", "piece"),
    [
        (1, "192 dot 168 dot 1 dot 10"),
        (1, "8 dot 8 dot 8 dot 8"),
        (1, "one zero dot zero dot zero dot one"),
        (1, "1[.]2[.]3[.]4"),
        (1, "10 (dot) 20 (dot) 30 (dot) 40"),
        (1, "192dot168dot1dot10"),
        (1, "one dot one dot one dot one"),
        (1, "10[.]0.0[.]1"),
        (2, "4111 one one one one one one one one one one one one"),
        (3, "+49 one seven one two three four five six seven eight"),
        (3, "plus 49 one seven one two three four five six seven eight"),
        (3, "five five five five five five five five five five"),
        (0, "x" * 200 + " at example dot com"),
        (0, "john at " + "sub dot " * 40 + "example dot com"),
        (0, "a dot " * 40 + "b at example dot com"),
    ],
)
def test_numbers_and_mails_are_found_whole(kind, piece):
    for text in (piece, f"so: {piece}; and", f"é\n{piece}\n"):
        assert added(text) == [(kind, piece)]
        assert piece not in pii.masked(text)


def test_ends_of_numbers():
    assert added("at 192 dot 168 dot 1 dot 10 5 users came") == [(1, "192 dot 168 dot 1 dot 10")]
    assert added("dot seven five, one nine two dot one six eight dot one dot seven five one day") == [(1, "one nine two dot one six eight dot one dot seven five")]
    assert added("8 dot 8 dot 8 dot 8, 9 dot 9 dot 9 dot 9") == [(1, "8 dot 8 dot 8 dot 8"), (1, "9 dot 9 dot 9 dot 9")]


def test_numbers_in_clean_text_are_left_alone():
    for text in ("version 1 dot 2 dot 3", "300 dot 1 dot 1 dot 1", "1. one 2. two 3. three 4. four", "in 1998 1999 2000 one", "one of 3.4.5 and 12", "8.8.8", "point one, point two"):
        assert not added(text), text


@pytest.mark.parametrize("part", ["one ", "8 dot ", "+ ", "1[.]", "plus ", "a dot ", " at ", "dot at ", "\n", "(", " ", "[ ", " dot", "( at", "@ a.", "one (", "1 \n\n"])
def test_long_runs_take_time_in_proportion(part):
    start = time.perf_counter()
    added(part * (1_000_000 // len(part)))
    assert time.perf_counter() - start < 25


def test_a_longer_hidden_span_takes_in_the_plain_one():
    text = "write j\u200bohn@example.com now"
    assert pii.base_spans(text) == [(8, 0, 23)]
    assert pii.hidden_spans(text, pii.base_spans(text)) == [(6, 0, 23)]
    assert pii.masked(text) == "write <EMAIL> now"


def test_transducers_compose_and_map_back():
    text = "tel: \uff0b49 \u043ene seven one two three four five six seven eight, m\u0430x (at) \u0435xample [dot] com"
    m = pii.normalised(text)
    assert "+4917123" in m.text and "max@example.com" in m.text
    for a, k, b in pii.base_spans(m.text):
        x, y = m.source(a, b)
        assert (k, text[x:y]) in [(3, text[5 : text.index(",")]), (0, text[text.index("m\u0430x") :])]
    assert len(pii.base_spans(m.text)) == 2
