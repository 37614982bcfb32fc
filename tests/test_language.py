import pytest

from graphloom.errors import ParseError, ValidationError
from graphloom.lang.parser import parse
from graphloom.lang.validate import validate

GOOD = [
    "RETURN 1",
    "for p in papers filter p.x == 1 return p",
    "FOR p IN papers // comment\nRETURN p",
    "FOR p IN papers COLLECT f = p.field, o = p.open AGGREGATE s = SUM(p.rank) INTO g = p.title WITH COUNT INTO n SORT n DESC LIMIT 1, 2 RETURN {f, s, g, n}",
    'FOR v IN 1..2 ANY "papers/p1" cites RETURN v',
    "FOR v, e, p IN 0..10 INBOUND @s cites RETURN p",
    "FOR d IN VECTOR_SEARCH(papers, [1.0, -2]) RETURN d",
    'UPSERT {a: 1} INSERT {a: 1} UPDATE {b: 2} IN papers RETURN NEW',
    "RETURN a ? 1 : 2" .replace("a ?", "true ?"),
    "RETURN FIRST((FOR p IN papers RETURN p)).title",
    "EXPLAIN ANALYZE FOR p IN papers RETURN p",
    'RETURN "\\u00e9\\n\\/"',
    "RETURN " + "[" * 32 + "1" + "]" * 32,
]
UNPARSABLE = [
    "",
    "FOR p IN papers",
    "FORp IN papers RETURN p",
    "FOR p IN papers FILTER p.a == p.b == p.c RETURN p",
    "FOR p IN papers SORT p.a FILTER p.b RETURN p",
    "FOR p IN papers LIMIT 1 LIMIT 2 RETURN p",
    "FOR p IN papers LIMIT -1 RETURN p",
    "FOR p IN papers LIMIT @n + 1 RETURN p",
    "FOR p IN papers RETURN p..x",
    "RETURN [1, ]",
    "RETURN {a: 1, }",
    "RETURN LENGTH(1, )",
    'RETURN "open',
    'RETURN "\\q"',
    "FOR v IN 3..1 ANY @s cites RETURN v",
    "/* no */ RETURN 1",
    "RETURN (INSERT {} INTO papers RETURN NEW)",
    "FOR p IN papers COLLECT WITH COUNT INTO n RETURN (FOR q IN papers RETURN 1)",
    "REMOVE 1",
    "RETURN " + "(" * 33 + "1" + ")" * 33,
]
INVALID = [
    "FOR p IN papers RETURN q",
    "FOR p IN papers FOR p IN p.tags RETURN p",
    "FOR p IN papers FILTER x LET x = 1 RETURN x",
    "FOR sort IN papers RETURN 1",
    "FOR p IN filter RETURN p",
    "RETURN NOPE(1)",
    "RETURN LENGTH()",
    "RETURN {a: 1, a: 2}",
    "FOR p IN papers LIMIT 0 RETURN p",
    "FOR p IN papers LIMIT 10001 RETURN p",
    "FOR v IN 1..11 ANY @s cites RETURN v",
    "FOR v IN 1..2 ANY 5 cites RETURN v",
    'FOR d IN VECTOR_SEARCH(papers, "x") RETURN d',
    "FOR p IN papers FOR d IN VECTOR_SEARCH(papers, @v) RETURN d",
    "FOR p IN papers COLLECT f = p.x RETURN p",
    "FOR p IN papers COLLECT f = p.x AGGREGATE f = SUM(p.y) RETURN f",
    "FOR p IN papers COLLECT f = p.x AGGREGATE g = MEDIAN(p.y) RETURN g",
    'FOR p IN papers SORT p.x COLLATE "no locale!" RETURN p',
    "EXPLAIN ANALYZE REMOVE @k IN papers",
    "INSERT {a: (RETURN 1)} INTO papers",
    "FOR p IN papers INSERT {d: DOCUMENT(p._id)} INTO papers",
    "LET a = (LET b = (LET c = (LET d = (LET e = (RETURN 1) RETURN e) RETURN d) RETURN c) RETURN b) RETURN a",
]


@pytest.mark.parametrize("text", GOOD)
def test_good(text):
    validate(parse(text))


@pytest.mark.parametrize("text", UNPARSABLE)
def test_unparsable(text):
    with pytest.raises(ParseError):
        parse(text)


@pytest.mark.parametrize("text", INVALID)
def test_invalid(text):
    with pytest.raises(ValidationError):
        validate(parse(text))
