"""Speakers by letter beyond H, and a bound that is an error."""

import pytest

from vanikosh.llm.canon import canonical
from vanikosh.llm.speech import LineParser
from vanikosh.llm.turns import filler_terms


@pytest.mark.parametrize("line, who", [("Speaker I: a b", "n9"), ("[speaker z] a b", "n26"), ("<v Speaker K> a b", "n11"), ("[J] a b", "n10"), ("(Z): a b", "n26"), ("Speaker S: a b", "n19"), ("Speaker H: a b", "n8")])
def test_letters_after_h(line, who):
    assert [p for p in LineParser(()).pieces(canonical(line)) if p[1]] == [(who, ["a", "b"])]


@pytest.mark.parametrize("line, who", [("Speaker 1:a b", "n1"), ("होस्ट:a b", "rhost"), ("वक्ता B:a b", "n2"), ("ID 600004:a b", "i600004"), ("SPK_02:a b", "n2")])
def test_names_glued_to_their_text(line, who):
    assert [p for p in LineParser(()).pieces(canonical(line)) if p[1]] == [(who, ["a", "b"])]


@pytest.mark.parametrize("line, who, word", [("होस्ट:नमस्ते", "rhost", "नमस्ते"), ("হোস্ট:হ্যাঁ", "rhost", "হ্যাঁ"), ("वक्ता २:नमस्ते", "n2", "नमस्ते")])
def test_names_glued_in_their_script(line, who, word):
    assert [p for p in LineParser(()).pieces(canonical(line)) if p[1]] == [(who, [word])]


def test_words_are_no_names():
    for line in ("दुःख होता", "host://a b", "S1:30 b"):
        assert [who for who, _ in LineParser(()).pieces(canonical(line))] == [None], line
    assert [who for who, _ in LineParser(()).pieces(canonical("speakers: a b"))] == [None]
    assert [who for who, _ in LineParser(()).pieces(canonical("Q: a b"))] == [None]


def test_too_many_fillers_are_an_error(spark):
    terms = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "term string")
    assert filler_terms(terms, 2) == ["a", "b"]
    with pytest.raises(ValueError):
        filler_terms(terms, 1)
