"""Validation of plan documents: odd rings, and a text that is parsed once whatever is asked of it."""

import pytest

from plangauge.sources import documents as A

SQUARE = "[[0,0],[1,0],[1,1],[0,1]]"
RINGS = {
    SQUARE: None, "[[0,0],[1,0],[1,1]]": None, "[[0,0],[1,0],[0,0]]": "malformed-ring", "[]": "malformed-ring", "{}": "room-with-hole", "null": "malformed-ring",
    "[[]]": "malformed-point", "[[],[1,0],[1,1],[0,1]]": "malformed-point", "[null,[1,0],[1,1],[0,1]]": "malformed-point", "[[0,0,1],[1,0],[1,1],[0,1]]": "malformed-point",
    '[["1.5",0],[1,0],[1,1],[0,1]]': None, '[["x",0],[1,0],[1,1],[0,1]]': "malformed-point", "[[true,0],[1,0],[1,1],[0,1]]": None, "[[null,0],[1,0],[1,1],[0,1]]": "malformed-point",
    "[[NaN,0],[1,0],[1,1],[0,1]]": "non-finite-coordinate", "[[-Infinity,0],[1,0],[1,1],[0,1]]": "non-finite-coordinate", f"[{SQUARE},{SQUARE}]": "room-with-hole",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, f'{{"source":"a","rooms":[{{"category":"c","ring":{r}}}]}}') for i, r in enumerate(RINGS)], "i int, text string")


def test_ring_faults(docs):
    """An empty point is a fault, not an error."""
    assert {r.i: r.reason for r in A.validated(docs).select("i", "reason").collect()} == dict(enumerate(RINGS.values()))


def test_checks_are_not_repeated(docs):
    """A filter on the reason must not put the parsing and the checks in place of each mention of what they give."""
    plan = A.validated(docs).where("reason IS NULL").select("i", "doc")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count("$.category") == 2
