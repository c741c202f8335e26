"""Pages by a listing against pages of the sorted collection."""

import random

import pytest
from test_literature import frame, paper

from citeloom.operators import listing, search

KEPT = [{}, {"source": "a"}, {"source": None, "first": 2015}, {"last": 2018, "category": "c1"}, {"source": "b", "first": 2010, "last": 2020, "category": "c2"}, {"category": "none"}, {"source": "b'"}]


@pytest.fixture(scope="module")
def collection(spark):
    rng = random.Random(6)
    dates = ["", None, "2020-01-01", "2021-05-02", "2019", "1999-12-31"]
    rows = [paper(i * 3, str(i), rng.choice(["Älpha", "alpha", "Beta", "gamma", "", None]) , "", rng.choice([None, 2009, 2015, 2018, 2022]), rng.choice(dates), categories=rng.choice([None, [], ["c1"], ["c2", "c1"], ["c2", "c2"]]), source=rng.choice(["a", "b", None])) for i in range(400)]
    rng.shuffle(rows)
    return frame(spark, *rows).repartition(5).cache()


@pytest.fixture(scope="module", params=["date_desc", "date_asc", "title"])
def listed(request, collection, tmp_path_factory):
    return request.param, listing.build(collection, str(tmp_path_factory.mktemp("l") / "x"), request.param, size=32)


@pytest.mark.parametrize("kept", KEPT)
def test_equals_the_sorted_collection(collection, listed, kept):
    order, made = listed
    whole = [r["pos"] for r in search.browse(collection, **kept, order=order).collect()]
    for number in (1, 2, 5, 99):
        size = 7 if kept else 30
        last = max(1, -(-len(whole) // size))
        want = whole[(min(number, last) - 1) * size :][:size]
        assert [r["pos"] for r in listing.page(collection, made, number, size, **kept).collect()] == want


def test_late_pages_read_no_more(spark, collection, listed, tmp_path):
    """With all folders but the page's own emptied, the page is the same; each page lies in two folders at most."""
    order, _ = listed
    made = listing.build(collection, str(tmp_path / "x"), order, size=32)
    whole = [r["pos"] for r in search.browse(collection, order=order).collect()]
    held = {p: p.read_bytes() for p in (tmp_path / "x" / "rows").rglob("*.parquet")}
    for number in (1, 38):
        own = {(number - 1) * 10 // 32, (number * 10 - 1) // 32}
        for p in held:
            p.write_bytes(held[p] if int(p.parent.name.removeprefix("range=")) in own else b"")
        assert made.places(listing.Kept(), number, 10) == whole[(number - 1) * 10 : number * 10]


def test_nothing_to_list(spark, tmp_path):
    none = frame(spark)
    made = listing.build(none, str(tmp_path / "x"))
    assert listing.page(none, made, 1).isEmpty() and listing.page(none, made, 3, source="a").isEmpty()
