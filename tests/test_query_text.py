import pytest
from shelfmark.functions import query_text as qt


BOUNDS = [
    ("headphones $50-$200", 50.0, 200.0, "headphones"),
    ("TV $50 - 200.5 or $1-2 now", 50.0, 200.5, "TV  or  now"),
    ("under $30 mouse", None, 30.0, "mouse"),
    ("Cheaper Than 30.25 mouse", None, 30.25, "mouse"),
    ("laptops over $1000", 1000.0, None, "laptops"),
    # both phrases match, and only the lower phrase is cut
    ("no more than $50", 50.0, 50.0, "no"),
    ("cover 5 under $20.50 tv", 5.0, 20.5, "c under $20.50 tv"),
    ("smart tv over $20 and under $450", 20.0, 450.0, "smart tv  and under $450"),
    # no thousands separator, no "max", no "from"
    ("over 1,000 laptops", 1.0, None, ",000 laptops"),
    ("max $500", None, None, "max $500"),
    ("from $100", None, None, "from $100"),
    ("minimum $50", 50.0, None, ""),
    ("min 7 starting at 9", 7.0, None, ""),
    # a range switches the phrases off
    ("over $5 $10-$20", 10.0, 20.0, "over $5"),
    ("  no price here ", None, None, "  no price here "),
]


@pytest.mark.parametrize("at,name", list(enumerate(["low", "high", "rest"])))
def test_price_bounds(column, at, name):
    texts = [case[0] for case in BOUNDS]
    assert column(texts, lambda x: qt.price_bounds(x)[at]) == [case[1 + at] for case in BOUNDS]


def test_phrase_bounds_yield_to_a_range(column):
    texts = ["under 5 $10-$20", "under 5", "over 5 $10-$20", "over 5"]
    assert column(texts, qt.upper_bound) == [None, 5.0, None, None]
    assert column(texts, qt.lower_bound) == [None, None, None, 5.0]


def test_normalize_query(column):
    texts = ["  Mountain   BIKE ", "TV $50-$200 big", "A  $5 x"]
    assert column(texts, qt.normalize_query) == ["mountain bike", "tv  big", "a $5 x"]


def test_brand_hint(column):
    texts = ["brand: Sony TV", "brand new phone", "brand#9", "BRAND:ACME-x", "phone", "brand: \t"]
    assert column(texts, qt.brand_hint) == ["sony tv", "new phone", None, "acme", None, ""]


def test_rating_hint(column):
    texts = ["4+ stars", "3.5 star tv", "5 Stars and 2 stars", "stars", "4 + stars"]
    assert column(texts, qt.rating_hint) == [4.0, 3.5, 5.0, None, None]
