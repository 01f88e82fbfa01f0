"""The search language: each rule, each error."""

import json

import pytest

from symsearch.plans.ast import All, And, Leaf, Not, Nothing, Or
from symsearch.plans.fields import EnumField, ExactField, IntegerField, PathField, Schema, SchemaError
from symsearch.plans.lexer import QueryError, tokens
from symsearch.plans.parser import Parser

NAME = Parser(Schema((ExactField("name", "XNAME"),)))


def leaf(value, wildcard=False, field="name"):
    return Leaf(field, value, wildcard)


FOO, BAR, BAZ = leaf("foo"), leaf("bar"), leaf("baz")


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("", Nothing()),
        ("  \n   ", Nothing()),
        ("  *:*  ", All()),
        ("NOT *:*", Not(All())),
        ("foo", FOO),
        ("  foo  ", FOO),
        ("foo bar", And((FOO, BAR))),
        ("foo bar baz", And((FOO, BAR, BAZ))),
        ("foo AND bar", And((FOO, BAR))),
        ("foo OR bar", Or((FOO, BAR))),
        ("foo AND bar OR baz", Or((And((FOO, BAR)), BAZ))),
        ("foo AND (bar OR baz)", And((FOO, Or((BAR, BAZ))))),
        ("foo OR bar OR baz", Or((FOO, BAR, BAZ))),
        ("NOT foo", Not(FOO)),
        ("!foo", Not(FOO)),
        ("NOT foo bar", And((Not(FOO), BAR))),
        ("NOT !foo", Not(Not(FOO))),
        ("()", Nothing()),
        ("(())", Nothing()),
        ("((foo))", FOO),
        ("((foo) bar)", And((FOO, BAR))),
        ("foo ()", FOO),
        ("foo () bar", And((FOO, BAR))),
        ("() OR foo", FOO),
        (' "foo baz"', leaf("foo baz")),
        (' "foo \\"baz\\""', leaf('foo "baz"')),
        (json.dumps(json.dumps("test")), leaf('"test"')),
        ("name:bar", BAR),
        ("name: FOO", leaf("FOO")),
        ('name:"foo bar"', leaf("foo bar")),
        ("fo*", leaf("fo", True)),
        ("foo *", leaf("foo", True)),
        ("name:foo.b*", leaf("foo.b", True)),
        ("name:*", leaf("", True)),
        ("a*b", And((leaf("a", True), leaf("b")))),
        ("name:", Nothing()),
        ("name: foo", FOO),
        ("name: name:foo", Nothing()),
        ("name: OR foo", FOO),
        ("foo OR name:", FOO),
        ("  /~?# foo ?$@#  ", And((leaf("/~?#"), FOO, leaf("?$@#")))),
        ("  !/~?# foo", And((Not(leaf("/~?#")), FOO))),
        ("  #name://foo//  ", leaf("#name://foo//")),
        ("ANDy ORs NOTe", And((leaf("ANDy"), leaf("ORs"), leaf("NOTe")))),
    ],
)
def test_meaning(query, want):
    assert NAME.parse(query) == want


@pytest.mark.parametrize("query", ["foo OR", "OR foo", "foo OR OR", "foo OR AND", "foo AND", "AND foo", "foo AND AND", "foo AND OR", "NOT", "!NOT", "NOT NOT", "NOT ()", ")", "foo )", "*"])
def test_missing_operands(query):
    with pytest.raises(QueryError):
        NAME.parse(query)


def test_messages_say_where():
    with pytest.raises(QueryError, match=r'closing "[)]".*at position 1.*at position 5'):
        NAME.parse(" (foo")
    with pytest.raises(QueryError, match="[Uu]nterminated"):
        NAME.parse('test "string')
    with pytest.raises(QueryError, match='Unknown field "unknown"'):
        NAME.parse("name:foo unknown:text name:bar")
    with pytest.raises(QueryError, match=r"\bname\b.*at position 5"):
        Parser(NAME.schema, ignore_missing_values=False).parse("name:")
    with pytest.raises(QueryError, match="Expected EOF"):
        NAME.parse("foo ) bar")


def test_default_fields():
    two = Parser(Schema((ExactField("name", "XN"), ExactField("full", "XF"), ExactField("other", "XO"))), ("name", "full"))
    assert two.parse("foo") == Or((leaf("foo"), leaf("foo", field="full")))
    assert two.parse('"a b"*') == Or((leaf("a b", True), leaf("a b", True, "full")))
    assert Parser(two.schema, ()).parse("foo") == Nothing()
    assert Parser(two.schema, ()).parse("name:foo") == FOO
    assert len(Parser(two.schema).parse("foo").of) == 3


def test_auto_wildcard():
    auto = Parser(NAME.schema, auto_wildcard=True)
    assert auto.parse("fo") == leaf("fo", True)
    assert auto.parse("name:fo") == leaf("fo") and auto.parse('"fo"') == leaf("fo")
    long = "x" * 240
    assert auto.parse(long) == leaf(long)
    with pytest.raises(QueryError, match="'name'.*too long.*239"):
        auto.parse(f"name:{long}*")


def test_integers():
    f = IntegerField("value")
    assert [f.bounds(x) for x in ("123..456", "..987", "369..", "369", "0x80", "0x80..0x100", "128..0x100", "..0X1f")] == [(123, 456), (None, 987), (369, None), (369, 369), (128, 128), (128, 256), (128, 256), (None, 31)]
    p = Parser(Schema((f,)))
    for bad in ("-1", "1a", "1_2", ".", "10..20abc", "10...20", "0x"):
        with pytest.raises(QueryError, match="Invalid integer range value"):
            p.parse(f"value:{bad}")
    for bad in ("..", "*", '""'):
        with pytest.raises(QueryError, match="Invalid integer range query"):
            p.parse(f"value:{bad}")


def test_enumerations():
    p = Parser(Schema((EnumField("value", values=("FOO", "FOO_2", "BAR")),)))
    assert p.parse("value:FOO") == leaf("FOO", field="value") and p.parse("value:F*") == leaf("F", True, "value")
    with pytest.raises(QueryError, match="Invalid value for 'value' field.*UNKNOWN"):
        p.parse("value:UNKNOWN")
    with pytest.raises(QueryError, match="Invalid prefix for 'value' field.*ZZZ"):
        p.parse("value:ZZZ*")


def test_paths_and_schemas():
    f = PathField("path", base="/w/d")
    assert f.literals("/a//b/./c/") == ["/a/b/c"] and f.literals("../x") == ["../x", "/w/x"]
    with pytest.raises(SchemaError):
        Schema((ExactField("a", "XA"), ExactField("a", "XB")))
    with pytest.raises(SchemaError):
        Schema((ExactField("a", "XA"), ExactField("b", "XAB")))
    assert Parser(Schema()).parse("any:thing") == leaf("thing", field="any")


def test_positions():
    assert [(t.kind, t.start, t.stop) for t in tokens("a (b*)")] == [("term", 0, 1), ("(", 2, 3), ("term", 3, 4), ("wildcard", 4, 5), (")", 5, 6), ("end", 6, 6)]
