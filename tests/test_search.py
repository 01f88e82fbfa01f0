"""Searches over the fixture rows, and random queries against a plain evaluator."""

import random
import re

import pytest
from pyspark.sql import functions as F

from symsearch.functions import terms
from symsearch.operators import completion, output, ranking
from symsearch.plans import postings
from symsearch.plans.ast import All, And, Leaf, Not, Nothing
from symsearch.plans.compiler import predicate, search
from symsearch.plans.fields import ExactField, IntegerField, NameField, PathField, Schema
from symsearch.plans.lexer import QueryError
from symsearch.plans.parser import Parser
from symsearch.plans.symbols import DEFAULT_FIELDS, SCHEMA
from tests.symbols import COLUMNS, LONG, ROOT, ROWS

CXX, CPP = "_Z12cxx_functionSt6vectorIiSaIiEE", "_Z18CppCamelCaseSymbolPKc"


@pytest.fixture(scope="module")
def symbols(spark):
    return spark.createDataFrame(ROWS, COLUMNS).cache()


def parser(base=ROOT):
    fields = tuple(PathField(f.name, f.prefix, f.key, f.optional, base) if isinstance(f, PathField) else f for f in SCHEMA.fields)
    return Parser(Schema(fields), DEFAULT_FIELDS, auto_wildcard=True)


def names(symbols, query, base=ROOT):
    return {r["name"] for r in search(symbols, query, parser(base)).select("name").collect()}


def below(folder):
    return {r[3] for r in ROWS if r[1].startswith(f"{ROOT}/{folder}")}


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("*:*", {r[3] for r in ROWS}),
        ("name:a_*", {f"a_name{i}" for i in range(5)}),
        ("a_*", {f"a_name{i}" for i in range(5)}),
        ("a_", {f"a_name{i}" for i in range(5)}),
        ("name:a_", set()),
        ("name:foo", {"foo", "foo_", "foo__", "uses_foo"}),
        ("fullname:foo", {"foo"}),
        ('fullname:"CppCamelCaseSymbol(char const*)"', {CPP}),
        ("fullname:_Z18CppCamelCaseSymbolPKc", {CPP}),
        ("camel", {CPP, "CamelCaseSymbol"}),
        ("Camel", {CPP, "CamelCaseSymbol"}),
        ("cas sym", {CPP, "CamelCaseSymbol"}),
        ("CamelC*", {"CamelCaseSymbol"}),
        ("cppcamelc*", {CPP}),
        ("cxx func", {CXX}),
        ("12 c f v", {CXX}),
        ("func vec", {CXX}),
        ("address:0x10", {"foo__"}),
        ("size:8", {"other_top_level_symbol", "foo_"}),
        ("size:0x20..0x80", {"top_level_symbol"}),
        ("type:F* size:13", {"uses_foo", "c_function"}),
        ("path:subdir///*", below("subdir/")),
        (f"path:///{ROOT}///subdir//foo.c.o", below("subdir/foo")),
        ("path:bar.cpp.o", below("subdir/bar")),
        (LONG, {LONG}),
        (LONG[:-1] + '"', set()),
        (f"name:{LONG[:-1]}1", set()),
        (f"name:{LONG[:242]}*", {LONG}),
        ("relocations:foo", {CXX, "uses_foo", "c_function"}),
        ("relocations:*", {"other_top_level_symbol", "main", CXX, "uses_c_function", "uses_foo", "c_function"}),
        ("demangled:*", {CXX, CPP, "_ZL14global_integer"}),
        ("NOT demangled:* type:FUNC", {"main", "uses_c_function", "uses_foo", "c_function", "CamelCaseSymbol"}),
        ("source:*", set()),
        ("section:.bss (size:8 OR name:bar)", {"foo_", "bar"}),
    ],
)
def test_goldens(symbols, query, want):
    if query.endswith('"') and query.count('"') == 1:
        query = f'name:"{query}'
    assert names(symbols, query) == want


def test_relative_path_from_another_folder(symbols):
    assert names(symbols, "path:./*", f"{ROOT}/subdir") == below("subdir/")


def test_errors(symbols):
    with pytest.raises(QueryError, match="'name'.*too long"):
        names(symbols, f"name:{LONG[:243]}*")
    with pytest.raises(QueryError, match="Invalid value for 'type'"):
        names(symbols, "type:INVALIDTYPE")


TOKENS = {
    "foo": "foo",
    "foo_bar": "bar foo",
    "_foo123_bar37_": "foo foo123 123 bar 37 bar37",
    "__foo_bar__": "bar foo",
    "FooBarCamelCase": "Bar Camel Case Foo FooBarCamelCase amel ar ase oo",
    "LSDigitVALUE": "Digit LSD LSDigitVALUE VALUE igit",
    "a::bé_1(x)": "bé_1 1",
}


def test_tokenize(spark):
    got = {r.n: set(r.t) for r in spark.createDataFrame([(n,) for n in TOKENS], "n string").select("n", terms.tokenize("n").alias("t")).collect()}
    assert got == {n: set(t.split()) for n, t in TOKENS.items()}


def test_normalise_path(spark):
    from pathlib import PurePosixPath

    paths = ["/", "a", "a/", "/a//b", "./a", "././a/./b/.", "//a/b", "///a", "/a/./", ".", "./", "a/../b", "/a/.b/c.", "a/./b//", "/.", "//", "x./y"]
    got = {r.p: r.q for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", terms.normalise_path("p").alias("q")).collect()}
    assert got == {p: str(PurePosixPath(p)) for p in paths}


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [("**/*.o", "a.o x/y/b.o", "a.c a.o/c"), ("*.o", "a.o", "x/a.o"), ("dir1/**", "dir1/a dir1/b/c", "dir2/a dir1"), ("**", "a b/c", ""), ("**/dir2/*", "dir2/a x/dir2/b", "dir2/a/b"), ("a?[0-9].{o,so}", "ab1.o ab2.so", "ab.o abc.o a/1.o"), ("**/dir1/sub**/**", "dir1/sub/a x/dir1/subx/y/z", "dir1/xsub/a")],
)
def test_globs(glob, yes, no):
    r = re.compile(terms.glob_regex(glob))
    assert all(r.match(x) for x in yes.split()) and not any(r.match(x) for x in no.split())


FIELDS = Schema((NameField("name"), ExactField("kind", optional=True), IntegerField("size")))


def plain(node, row):
    """Two-valued: a null has no terms."""
    if isinstance(node, All):
        return True
    if isinstance(node, Nothing):
        return False
    if isinstance(node, Not):
        return not plain(node.of, row)
    if isinstance(node, Leaf):
        v = row[node.field]
        if v is None:
            return False
        if node.field == "size":
            low, high = FIELDS["size"].bounds(node.value)
            return (low is None or v >= low) and (high is None or v <= high)
        have = {v} if node.field == "kind" else {v.lower(), *(t.lower() for p in terms.TOKEN_PATTERNS for t in re.findall(p, v))}
        value = node.value if node.field == "kind" else node.value.lower()
        return any(t.startswith(value) if node.wildcard else t == value for t in have)
    return (all if isinstance(node, And) else any)(plain(n, row) for n in node.of)


def test_random_queries_against_plain_evaluator(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice(["fooBar", "foo_bar", "Bar12", "x", None]), rng.choice(["A", "AB", None]), rng.choice([1, 5, 9, None])) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, name string, kind string, size long").cache()
    leaf = lambda: rng.choice(["foo", "bar*", "name:Bar", "kind:A", "kind:A*", "size:1..5", "size:9", "name:*", "kind:*", "*:*", "(size:)"])
    p = Parser(FIELDS, ("name", "kind"))

    def make(depth):
        if not depth:
            return leaf()
        kind = rng.randrange(4)
        return f"NOT ({make(depth - 1)})" if kind == 0 else f"({make(depth - 1)}{rng.choice([' ', ' OR ', ' AND '])}{make(depth - 1)})" if kind < 3 else make(depth - 1)

    asked = [make(3) for _ in range(60)]
    nodes = [p.parse(q) for q in asked]
    got = df.select("id", *(F.coalesce(predicate(n, FIELDS), F.lit(False)).alias(f"q{i}") for i, n in enumerate(nodes))).collect()
    by_id = {r[0]: {"name": r[1], "kind": r[2], "size": r[3]} for r in rows}
    for r in got:
        for i, n in enumerate(nodes):
            assert r[f"q{i}"] == plain(n, by_id[r.id]), (asked[i], by_id[r.id])


def test_postings_say_the_same(spark, symbols):
    rows = symbols.withColumn("__rid", F.monotonically_increasing_id()).cache()
    p = parser()
    table = postings.postings(rows, p.schema).cache()
    for query in ("foo", "camel sym", "foo OR type:FUNC", "NOT foo", "!(foo OR demangled:cxx) type:FUNC", "relocations:foo NOT name:uses", "name:*", "*:*", "section: foo", "(a_ OR bar) size:4", "NOT name:foo NOT name:bar", "fullname:foo OR name:camel"):
        want = sorted(r["name"] for r in search(rows, query, p).collect())
        assert sorted(r["name"] for r in postings.search(p.parse(query), rows, table, p.schema).collect()) == want, query


def test_pushdown(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    spark.createDataFrame(ROWS, COLUMNS).write.parquet(str(tmp_path / "s"))
    rows = search(spark.read.parquet(str(tmp_path / "s")), "size:8.. section:.t* type:FUNC", parser()).select("name")
    plan = rows._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(size,8)" in plan and "StringStartsWith(section,.t)" in plan and re.search(r"EqualTo\(type,FUNC\)", plan)
    assert "relocations" not in plan.split("ReadSchema")[1]


def test_ranking(symbols):
    found = [r["name"] for r in ranking.ranked(symbols, "c funct", parser()).collect()]
    assert set(found) == {CXX, "c_function"}
    first = ranking.ranked(symbols, "foo", parser(), limit=3).collect()
    assert len(first) == 3 and [r.score for r in first] == sorted((r.score for r in first), reverse=True)
    rest = ranking.ranked(symbols, "foo", parser(), first=3).collect()
    assert not {r["name"] for r in rest} & {r["name"] for r in first}


def test_output(spark, symbols):
    rows = symbols.where("name = 'foo_'").withColumn("outdated", F.struct(F.lit(False).alias("binary"), F.lit(True).alias("symbol"))).withColumn("index", F.lit(0)).withColumn("total", F.lit(1))
    assert output.as_json(rows).first().json == '{"outdated":{"binary":false,"symbol":true},"index":0,"total":1,"arch":"X86_64","path":"/w/fixture/subdir/foo.c.o","source":null,"name":"foo_","demangled":null,"section":".bss","address":8,"size":8,"type":"OBJECT","relocations":[],"mtime":1700000000123456789}'
    assert output.as_sexp(rows).first().sexp == '(:outdated (:binary nil :symbol t) :index 0 :total 1 :arch "X86_64" :path "/w/fixture/subdir/foo.c.o" :source nil :name "foo_" :demangled nil :section ".bss" :address 8 :size 8 :type "OBJECT" :relocations () :mtime 1700000000123456789)'
    for template in ("{basename}: {name}", "0x{address:0>10x}|{section:<10}|{size:>5}|{name}", "{endaddress:,} {name!r:>12}", "{{{arch}}}"):
        want = template.format(basename="foo.c.o", name="foo_", address=8, section=".bss", size=8, endaddress=16, arch="X86_64")
        assert output.as_text(rows, template).first().text == want
    with pytest.raises(ValueError, match="known keys"):
        output.as_text(rows, "{nothing}")


def test_completion(symbols):
    p = parser()
    fields = {f"{f}:" for f in p.schema}
    assert {"AND", "OR", "NOT", *fields} <= set(completion.complete(symbols, "", p))
    assert completion.complete(symbols, "AN", p) == ["AND"]
    assert completion.complete(symbols, "ANN", p) == []
    assert set(completion.complete(symbols, "prefix string ", p)) == {"prefix string AND ", "prefix string OR ", "prefix string NOT ", *(f"prefix string {f}" for f in fields)}
    assert set(completion.complete(symbols, "prefix string A", p)) >= {"prefix string AND "}
    assert completion.complete(symbols, "name:Cam", p) == ["name:CamelCaseSymbol"]
    assert completion.complete(symbols, 'demangled:"Cpp', p) == ['demangled:"CppCamelCaseSymbol(char const*)"']
    assert completion.complete(symbols, "demangled:Cpp", p) == ['demangled:"CppCamelCaseSymbol(char const*)"']
    assert completion.complete(symbols, "demangled:global_", p) == ["demangled:global_integer"]
    assert set(completion.complete(symbols, 'demangled:"global_integer" AND demangled:"global', p)) == {'demangled:"global_integer" AND demangled:"global"', 'demangled:"global_integer" AND demangled:"global_integer"'}
    assert completion.complete(symbols, "cxx_function(std::vector<int, std::", p) == ['"cxx_function(std::vector<int, std::allocator<int> >)"']
    assert completion.terms(symbols, p, "size").count() == 0
