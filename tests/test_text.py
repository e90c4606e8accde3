import re

from shelfmark.functions.prices import parse_price, without_nan
from shelfmark.functions.text import drop_special, first_words, strip, words

ODD = [
    "Café №5 ½ price now",
    "a b　 c\x1cd\x85e",
    "[x] {y} (z) \"q\" 'r' -s. $9 & 100% #1 ™",
    "é combining",
    "",
    "   ",
    "one\ttwo\nthree\r\nfour",
    "under_score",
]


def test_words_cut_at_all_white_space(column):
    assert column(ODD, words) == [text.split() for text in ODD]


def test_strip_matches_python(column):
    texts = ["  a b  ", "\x1cx\x1d", "  ", "plain"]
    assert column(texts, strip) == [text.strip() for text in texts]


def test_first_words_joins_by_one_blank(column):
    assert column(ODD, lambda x: first_words(x, 3)) == [" ".join(text.split()[:3]) for text in ODD]


def test_drop_special_keeps_word_characters_and_punctuation(column):
    kept = [re.sub(r'[^\w\s.,;:!?()[\]{}"\'-]', "", text) for text in ODD]
    assert column(ODD, drop_special) == kept


def test_drop_special_keeps_null(column):
    assert column([None, "a&b"], drop_special) == [None, "ab"]


def test_parse_price(column):
    texts = ["$1,299.00", "12", " 7 ", "1e3", ".5", "5.", "-3", "1.0d", "nan", "inf", "", "call us", None]
    expected = [1299.0, 12.0, 7.0, 1000.0, 0.5, 5.0, -3.0] + [None] * 6
    assert column(texts, parse_price) == expected


def test_without_nan(column):
    assert column([1.5, float("nan"), None], without_nan, "double") == [1.5, None, None]
