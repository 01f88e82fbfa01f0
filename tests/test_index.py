"""Indexes of compiled files, file sets, relocations, the graph, and the command line."""

import os
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from symsearch import config
from symsearch import index as index_
from symsearch.cli import main
from symsearch.functions.terms import unsigned_order
from symsearch.operators import fileset, graph, output, tools
from symsearch.operators.relocations import owners, reference_lists
from symsearch.plans.compiler import search
from symsearch.plans.fields import ExactField, Schema, SchemaError
from symsearch.plans.lexer import QueryError
from symsearch.plans.parser import Parser
from symsearch.plans.symbols import DEFAULT_FIELDS, SCHEMA
from symsearch.plans.symbols import SYMBOL as SCHEMA_ROW
from symsearch.sources import compdb
from symsearch.sources.elf import Elf, ElfError, elf_of, is_elf, read_symbols, stored_files
from symsearch.sources.files import CombinedSource, GlobSource, StaticSource, exclude, exclusion_stats
from symsearch.streaming import incremental
from tests.symbols import COLUMNS, ROWS

needs_as = pytest.mark.skipif(not shutil.which("as"), reason="no assembler")


def thing(name, size, section=".bss"):
    return f"\t.section {section}\n\t.globl {name}\n\t.type {name},@object\n\t.size {name},{size}\n{name}:\t.zero {size}\n"


def code(name, *lines):
    return f"\t.text\n\t.globl {name}\n\t.type {name},@function\n{name}:\n" + "".join(f"\t{x}\n" for x in lines) + f"\tret\n\t.size {name},.-{name}\n"


FOO = thing("foo", 8) + thing("foo_", 16) + thing("foo__", 4) + code("uses_foo", "mov foo(%rip),%rax") + code("c_function", "mov foo(%rip),%rax", "add $1,%rax") + code("CamelCaseSymbol")
TOP = thing("top_level_symbol", 64, ".rodata") + code("main", "call c_function@PLT")
DEEP = thing("_ZN4deep7counterE", 4) + code("_ZN4deep5touchEi", "addl %edi,_ZN4deep7counterE(%rip)", "mov _ZN4deep7counterE(%rip),%eax")


def assemble(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    subprocess.run(["as", "-g", str(path), "-o", f"{path}.o"], check=True)


@pytest.fixture
def tree(tmp_path):
    assemble(tmp_path / "t", "toplev.s", TOP)
    assemble(tmp_path / "t", "sub/foo.s", FOO)
    assemble(tmp_path / "t", "sub/deep.s", DEEP)
    return tmp_path / "t"


def rows_of(index):
    return {r["name"]: r for r in index.symbols().collect()}


@needs_as
def test_index_and_search(spark, tree, tmp_path):
    where = str(tmp_path / "i")
    stats = index_.index_directory(spark, str(tree), where, options=index_.Options(index_relocations=True))
    assert (stats.changed, stats.deleted, stats.errors) == (3, 0, [])
    with index_.SymbolIndex.open(spark, where, readonly=True) as index:
        rows = rows_of(index)
        assert rows["top_level_symbol"].size == 64 and rows["top_level_symbol"].type == "OBJECT" and rows["top_level_symbol"].section == ".rodata"
        assert rows["main"].relocations == ["c_function"] and rows["uses_foo"].relocations == ["foo"]
        assert rows["_ZN4deep5touchEi"].demangled == "deep::touch(int)" and rows["_ZN4deep5touchEi"].relocations == ["_ZN4deep7counterE"]
        assert {r.arch for r in rows.values()} == {"X86_64"} and all(r.mtime == os.stat(r.path).st_mtime_ns for r in rows.values())
        assert {r["name"] for r in index.search("deep touch").collect()} == {"_ZN4deep5touchEi"}
        assert {r["name"] for r in index.search("type:FUNC path:foo.s.o").collect()} == {"uses_foo", "c_function", "CamelCaseSymbol"}
        assert index.search("").count() == len(index.symbols().collect())
        assert index.mtime() == max(r.mtime for r in rows.values()) and index.all_files().count() == 3
        with pytest.raises(index_.ReadOnlyError):
            index.delete_files(index.all_files())
        with pytest.raises(QueryError, match="forget to quote"):
            index.search("deep::touch(i")
        assert index.search("foo", limit=2, ranked=True).count() == 2
        assert index.binary_dir == str(tree)
    with pytest.raises(index_.ClosedError):
        index.symbols()
    hit = index_.hits(index_.SymbolIndex.open(spark, where, readonly=True), "fullname:main").first()
    assert (hit["index"], hit.total, hit.outdated.symbol, hit.outdated.binary) == (0, 1, False, False)


@needs_as
def test_files_in_a_store(spark, tree):
    (tree / "text.o").write_bytes(b"not one")
    found = stored_files(spark, f"file://{tree}")
    symbols, errors = read_symbols(spark, found, with_relocations=True)
    assert errors.count() == 0
    assert {r["name"]: r.relocations for r in symbols.collect()}["uses_foo"] == ["foo"]
    assert {os.path.basename(r.path) for r in found.collect()} == {"toplev.s.o", "foo.s.o", "deep.s.o"}


@needs_as
def test_incremental(spark, tree, tmp_path):
    where = str(tmp_path / "i")
    run = lambda **how: index_.index_directory(spark, str(tree), where, **how)
    run()
    assert (run().changed, run().deleted) == (0, 0)
    plan = {(r.action, os.path.basename(r.path)) for r in run(reindex=True, dry_run=True).collect()}
    assert ("index", "foo.s.o") in plan and ("unindex-outdated-file", "foo.s.o") in plan
    assemble(tree, "sub/foo.s", thing("fresh_symbol", 4))
    newest = max(os.stat(p).st_mtime_ns for p in tree.rglob("*.o"))
    os.utime(tree / "sub/foo.s.o", ns=(newest, newest + 1))
    os.remove(tree / "sub/deep.s.o")
    stats = run()
    assert (stats.changed, stats.deleted, stats.files, stats.symbols) == (1, 1, 1, 1)
    with index_.SymbolIndex.open(spark, where, readonly=True) as index:
        assert set(rows_of(index)) == {"top_level_symbol", "main", "fresh_symbol"}
        assert index.rows_of(str(tree / "sub/foo.s.o")).count() == 1


@needs_as
def test_files_without_symbols_and_broken_files(spark, tmp_path):
    tree, where = tmp_path / "t", str(tmp_path / "i")
    assemble(tree, "none.s", "")
    (tree / "broken.o").write_bytes(b"\x7fELF and no more")
    (tree / "text.o").write_bytes(b"not one")
    for _ in range(2):
        stats = index_.index_directory(spark, str(tree), where)
        assert [os.path.basename(p) for p, _ in stats.errors] == ["broken.o"]
    with index_.SymbolIndex.open(spark, where, readonly=True) as index:
        assert [(os.path.basename(r.path), r["name"], r.type) for r in index.search("*:*").collect()] == [("none.s.o", "", "NOTYPE")]
    with pytest.raises(ElfError):
        Elf(b"\x7fELF" + b"\0" * 100)
    assert not is_elf(str(tree / "text.o")) and not is_elf("/nowhere") and is_elf(str(tree / "none.s.o"))


def test_store(spark, tmp_path):
    where = str(tmp_path / "i")
    with pytest.raises(index_.DoesNotExistError):
        index_.SymbolIndex.open(spark, where, readonly=True)
    symbols = spark.createDataFrame(ROWS, COLUMNS)
    with index_.SymbolIndex.open(spark, where) as index:
        assert index.symbols().count() == 0 and index.mtime() == 0
        with pytest.raises(RuntimeError, match="stop"), index.transaction():
            index.add_symbols(symbols)
            assert index.symbols().count() == 21
            with pytest.raises(index_.TransactionInProgressError), index.transaction():
                pass
            raise RuntimeError("stop")
        assert index.symbols().count() == 0
        index.add_symbols(symbols)
        assert index.symbols().count() == 21
        other = index_.SymbolIndex.open(spark, where)
        with pytest.raises(index_.ModifiedError), index.transaction():
            other.delete_files(symbols.where("path like '%foo.c.o'"))
            index.add_symbols(symbols)
        assert index.symbols().count() == 10
        plain = sorted(r["name"] for r in index.search("symbol").collect())
        index.build_postings()
        found = index.search("symbol")
        assert sorted(r["name"] for r in found.collect()) == plain and "postings" in str(index._postings().inputFiles())
        assert "term" in found._jdf.queryExecution().toString()
        index.set_metadata("a", "1")
        assert (index.get_metadata("a"), index.get_metadata("b"), index.metadata_keys()) == ("1", None, ["a"])
        with pytest.raises(ValueError):
            index.set_metadata("", "x")
    with pytest.raises(SchemaError):
        index_.SymbolIndex.open(spark, where, schema=Schema((ExactField("a", "XA"),)))
    assert len(index_.delete_index(where, dry_run=True)) == 2 == len(index_.delete_index(where))
    assert index_.SymbolIndex.open(spark, where, readonly=True).symbols().count() == 0
    index_.delete_index(where, metadata_too=True)
    assert index_.delete_index(where) == []


def test_file_sets(spark):
    cur = spark.createDataFrame([("a", 5), ("b", 11), ("c", 10), ("n", 1)], "path string, mtime long")
    prev = spark.createDataFrame([("a", 10), ("b", 3), ("c", 10), ("d", 2)], "path string, mtime long")
    changed, deleted = fileset.changed_files(cur, prev, fileset.max_mtime(prev)), fileset.deleted_files(cur, prev)
    assert sorted(r.path for r in changed.collect()) == ["b", "n"]
    assert [r.path for r in deleted.collect()] == ["d"]
    assert sorted(tuple(r) for r in fileset.upsert(prev, changed, changed, deleted).collect()) == [("a", 10), ("b", 11), ("c", 10), ("n", 1)]
    empty = prev.limit(0)
    assert fileset.max_mtime(empty) == 0 and fileset.changed_files(cur, empty, 0).count() == 4


def test_exclusions_and_sources(spark, tmp_path):
    for p in ("x/1.o", "x/dir1/1.o", "x/dir2/2.so", "x/dir2/t.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"\x7fELF")
    root = str(tmp_path / "x")
    found = CombinedSource([GlobSource(), GlobSource(("dir2/*",)), StaticSource(["1.o"])]).paths(spark, root)
    short = lambda df: sorted(os.path.relpath(r.path, root) for r in df.collect())
    assert short(found) == ["1.o", "dir1/1.o", "dir2/2.so", "dir2/t.txt"]
    assert short(exclude(found, ["dir1/**", f"{root}/*.o"], root)) == ["dir2/2.so", "dir2/t.txt"]
    assert sorted(tuple(r) for r in exclusion_stats(found, ["**/1.o", "dir1/**", "no"], root).collect()) == [("**/1.o", 2), ("dir1/**", 0), ("no", 0)]


def test_compilation_database(spark, tmp_path):
    entries = [
        (0, "/d", "a.c", "out/a.o", "cc -o x.o", None),
        (1, "/d", "b.c", None, "cc -o old.o -c b.c -o b1.o ", None),
        (2, None, "/s/c.c", None, None, ["cc", "-o", "c1.o", "-o", "c2.o"]),
        (3, "/d", "d.cpp", None, "cc -c d.cpp", ["-o", "never.o"]),
        (4, "/d", "again.c", "out/a.o", None, None),
        (5, "/d", "e.c", None, None, ["cc"]),
    ]
    got = compdb.resolve(spark.createDataFrame(entries, f"nth long, {compdb.ENTRY}"), "/base")
    assert {r.binary: r.source for r in got.collect()} == {"/d/out/a.o": "/d/again.c", "/d/b1.o": "/d/b.c", "/base/c1.o": "/s/c.c", "/d/d.o": "/d/d.cpp", "/d/e.o": "/d/e.c"}
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "compile_commands.json").write_text('[{"directory": "/d", "file": "a.c", "output": "a.o"}]')
    assert compdb.find(str(tmp_path / "a/b")) == str(tmp_path / "compile_commands.json")
    assert [tuple(r) for r in compdb.read(spark, compdb.find(str(tmp_path))).collect()] == [("/d/a.o", "/d/a.c")]


def test_relocation_owners(spark):
    symbols = [("f", "s", 0, 8, 0, "a"), ("f", "s", 8, 8, 1, "first"), ("f", "s", 8, 8, 2, "alias"), ("f", "s", 20, 4, 3, "gap"), ("f", "s", 30, 0, 4, "zero"), ("f", "", 0, 4, 5, "unnamed"), ("g", "s", 0, 100, 0, "other")]
    offsets = [0, 7, 8, 12, 15, 16, 19, 20, 23, 24, 30]
    sym = spark.createDataFrame(symbols, "file string, section string, address long, size long, ord long, name string")
    rel = spark.createDataFrame([("f", "s", o, f"t{o}") for o in offsets] + [("f", "", 1, ""), ("h", "s", 1, "x")], "file string, section string, r_offset long, target string")
    got = {(r.section, r.r_offset): r["name"] for r in owners(sym, rel).collect()}
    assert got == {("s", 0): "a", ("s", 7): "a", ("s", 8): "first", ("s", 12): "alias", ("s", 15): "alias", ("s", 20): "gap", ("s", 23): "gap", ("", 1): "unnamed"}
    assert {r["name"]: r.relocations for r in reference_lists(sym, rel).collect()} == {"a": ["t0", "t7"], "first": ["t8"], "alias": ["t12", "t15"], "gap": ["t20", "t23"], "unnamed": [""]}


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3), (3, 5), (5, 3), (6, 6), (7, 1)], "src long, dst long")
    ask = lambda starts, goals, **how: {r.goal: r.path for r in graph.routes(edges, spark.createDataFrame([(s,) for s in starts], "start long"), spark.createDataFrame([(g,) for g in goals], "goal long"), **how).collect()}
    assert ask([1], [5]) == {5: [1, 2, 3, 5]}
    assert ask([1, 7], [3, 5], num_routes=None) == {3: [1, 2, 3], 5: [1, 2, 3, 5]}
    assert ask([1], [3, 5], num_routes=1) == {3: [1, 2, 3]}
    assert ask([3], [3]) == {3: [3, 5, 3]} and ask([3], [3], zero_hops=True) == {3: [3]} and ask([6], [6]) == {6: [6, 6]}
    assert ask([5], [1]) == {} and ask([], [1]) == {} and ask([1], [9]) == {}
    assert graph.depth_first(edges, 7, {5}) == [7, 1, 2, 3, 5] and graph.depth_first(edges, 5, {1}) is None


def test_dot(spark):
    symbols = spark.createDataFrame(ROWS, COLUMNS).withColumn("id", F.xxhash64("name"))
    edges = graph.edges(symbols)
    pick = lambda name, c: symbols.where(F.col("name") == name).select(F.col("id").alias(c))
    text = graph.dot(graph.routes(edges, pick("main", "start"), pick("c_function", "goal")), symbols, "main", "c_function")
    assert "main -- uses_c_function" in text and "uses_c_function -- c_function" in text and "cluster_goal_query" in text
    none = graph.dot(graph.routes(edges, pick("nothing", "start"), pick("c_function", "goal")), symbols, "nothing", "c_function")
    assert "--" not in none


def test_stream(spark, tmp_path):
    states = tmp_path / "states"
    spark.createDataFrame([("/a", 1, False), ("/b", 1, False)], "path string, mtime long, deleted boolean").write.parquet(str(states))
    read = lambda files: files.select(*(F.col(c) if c in ("path", "mtime") else F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in COLUMNS.split(", "))))
    index = index_.SymbolIndex.open(spark, str(tmp_path / "i"))

    def follow():
        stream = spark.readStream.schema("path string, mtime long, deleted boolean").parquet(str(states))
        incremental.follow(stream, index, read, str(tmp_path / "c")).awaitTermination()
        return sorted((r.path, r.mtime) for r in index.symbols().collect())

    assert follow() == [("/a", 1), ("/b", 1)]
    spark.createDataFrame([("/a", 2, False), ("/a", 1, False), ("/b", 3, True), ("/c", 1, False)], "path string, mtime long, deleted boolean").write.mode("append").parquet(str(states))
    assert follow() == [("/a", 2), ("/c", 1)]


def test_config(tmp_path, caplog):
    path = tmp_path / "c.toml"
    path.write_text(f'[indexing]\nmin-symbol-size = 3\nexclude = ["*.x"]\nodd = 1\n[arch.default]\ndisassembler = "dis"\n[arch.ARM]\naddr2line = "arm-a2l"\n[directory."{tmp_path}".indexing]\nmin-symbol-size = 9\n')
    c = config.load(str(path))
    assert c.indexing.min_symbol_size == 3 and c.for_machine("ARM").disassembler == "dis" and c.for_machine("ARM").addr2line == "arm-a2l" and c.for_machine("X86_64").addr2line == "addr2line"
    assert c.for_directory(str(tmp_path)).indexing.min_symbol_size == 9 and c.for_directory(str(tmp_path)).indexing.exclude == ["*.x"] and c.for_directory("/") is c
    assert "odd" in caplog.text
    path.write_text("[indexing]\nmin-symbol-size = true\n")
    with pytest.raises(TypeError):
        config.load(str(path))
    assert config.load(str(tmp_path / "none")).indexing.min_symbol_size == 1
    path.write_text(config.Config().to_toml())
    assert config.load(str(path)).indexing == config.Indexing()


def test_tools():
    row = {"arch": "X86_64", "path": "/a b.o", "section": ".text; rm", "address": 16, "endaddress": 32}
    assert tools.disassembly_command(row, config.Config())[-7:] == ["/a b.o", "--section", ".text; rm", "--start-address", "0x10", "--stop-address", "0x20"]
    said = "f\n/s/a.c:3 (discriminator 1)\ng\n/s/b.c:7\n"
    assert tools.chosen_line(said, "g", None) == ("/s/b.c", 7) and tools.chosen_line(said, "x", "/s/b.c") == ("/s/b.c", 7) and tools.chosen_line(said, "x", None) == ("/s/a.c", 3)
    assert tools.chosen_line("??\n??:0\n", "g", "/s") == ("/s", None) and tools.chosen_line("", "g", None) == (None, None)


@needs_as
def test_command_line(spark, tree, tmp_path, capsys):
    where = str(tmp_path / "i")
    run = lambda name, *args: (main([name, "-d", str(tree), "--index-path", where, *args]), capsys.readouterr().out)
    assert run("index", "-o", "index_relocations=true", "-o", "num_processes=2") == (0, "Changed files: 3\nDeleted files: 0\nIndexed files: 3\nIndexed symbols: 10\n")
    code, out = run("search", "name:c_function")
    assert code == 0 and out == "foo.s.o: c_function\n"
    assert '"name":"c_function"' in run("search", "-f", "json", "name:c_function")[1]
    assert len(run("files")[1].split()) == 3
    assert "main -- c_function" in run("graph", "name:main", "name:c_function")[1]
    assert "main -- c_function" in run("graph", "-a", "dfs", "name:main", "name:c_function")[1]
    assert "name:c_function" in run("complete-query", "name:c_f")[1]
    assert run("search", "type:NOPE")[0] == 1
    if shutil.which("objdump"):
        assert "<c_function>" in run("disass", "name:c_function")[1]
    if shutil.which("addr2line"):
        assert "foo.s:" in run("find-definition", "name:c_function")[1]
    assert "[indexing]" in run("print-config")[1]
    assert main(["search", "-d", str(tmp_path), "x"]) == 1


def test_unsigned_addresses(spark):
    """Addresses from 2^63 on: in files, searches, order, ranges, relocations and output."""
    high = 0xFFFFFFFF81000000
    content = elf_of([("low", ".text", 16, 8, 2), ("kernel", ".text", high, 64, 2), ("half", ".text", 1 << 63, 4, 2)])
    files = spark.createDataFrame([("/v/linux.o", 1, bytearray(content))], "path string, mtime long, content binary")
    rows = read_symbols(spark, files, demangle_names=False)[0].cache()
    names = lambda q: [r.name for r in search(rows, q, Parser(SCHEMA, DEFAULT_FIELDS)).orderBy(unsigned_order("address")).collect()]
    assert names("address:0xffffffff81000000") == ["kernel"]
    assert names("address:0x8000000000000000..") == ["half", "kernel"]
    assert names("address:..0x7fffffffffffffff") == ["low"]
    assert names("address:17..0xffffffff80000000") == ["half"]
    assert names("address:0x10..") == ["low", "half", "kernel"]
    assert names("address:0xffffffffffffffff..0x10") == names("address:0x10000000000000000..") == []
    text = {r.text for r in output.as_text(rows, "{name} 0x{address:x} {endaddress} {address:>5X}").collect()}
    assert text == {f"{n} 0x{a:x} {a + z} {a:>5X}" for n, a, z in (("low", 16, 8), ("kernel", high, 64), ("half", 1 << 63, 4))}
    assert f'"address":{high}' in "".join(r.json for r in output.as_json(rows).collect())
    one = next(r.asDict() for r in output.with_dynamic_fields(rows).collect() if r.name == "kernel")
    assert f"0x{high:x}" in tools.disassembly_command(one, config.Config())
    sym = rows.select(F.col("path").alias("file"), "section", "address", "size", F.col("address").alias("ord"), "name")
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    rel = spark.createDataFrame([("/v/linux.o", ".text", signed(at), "x") for at in (15, 16, 23, 24, high, high + 63, high + 64, 1 << 63)], "file string, section string, r_offset long, target string")
    assert {(r.r_offset, r.name) for r in owners(sym, rel).collect()} == {(16, "low"), (23, "low"), (signed(high), "kernel"), (signed(high + 63), "kernel"), (signed(1 << 63), "half")}


def test_settings_as_published(spark, tmp_path):
    """Programs with arguments, tables of a folder, and globs of whole paths."""
    own = tmp_path / "some" / "dir"
    own.mkdir(parents=True)
    (tmp_path / "c.toml").write_text(f"""
[indexing]
exclude = ["**/*.so"]
[arch.default]
addr2line = "addr2line"
[arch.X86_64]
disassembler = "objdump -M intel"
[path."{own}/"]
arch.default.addr2line = "special-addr2line"
indexing.index-relocations = true
""")
    main_ = config.load(str(tmp_path / "c.toml"))
    hit = {"arch": "X86_64", "path": "a b.o", "section": ".text", "address": 16, "endaddress": 32, "name": "f"}
    assert tools.disassembly_command(hit, main_)[:4] == ["objdump", "-M", "intel", "-dC"]
    assert "a b.o" in tools.disassembly_command(hit, main_)
    there = main_.for_directory(str(own))
    assert there.indexing.index_relocations and there.indexing.exclude == ["**/*.so"] and not main_.indexing.index_relocations
    assert there.for_machine("X86_64").addr2line == "special-addr2line" and there.for_machine("X86_64").disassembler == "objdump -M intel"
    with pytest.raises(ValueError, match="CRAY.*X86_64"):
        config.Config.of({"arch": {"CRAY": {}}})
    (own / "libc.so.6").write_bytes(b"x")
    (own / "b.o").write_bytes(b"x")
    found = GlobSource(("*.o", f"{tmp_path}/some/*/libc*.so*")).paths(spark, str(own))
    assert sorted(os.path.basename(r.path) for r in found.collect()) == ["b.o", "libc.so.6"]


def test_paths_are_pushed_down(spark, tmp_path):
    with index_.SymbolIndex.open(spark, str(tmp_path / "i")) as index:
        index.add_symbols(spark.createDataFrame([("NONE", f"/b//x/./f{i}.o", None, f"n{i}", None, ".text", i, 8, "FUNC", [], 1) for i in range(20)], SCHEMA_ROW))
        found = index.search("path:f7.o")
        plan = found._jdf.queryExecution().toString()
        assert "EqualTo(path__plain" in plan and "EqualTo(path__base" in plan
        assert [r.name for r in found.collect()] == ["n7"]
        assert [r.name for r in index.search("path:/b/x/f3.o OR path:/b/x/f1*").orderBy("name").limit(2).collect()] == ["n1", "n10"]


def test_two_writers(spark, tmp_path):
    """The slower one is told."""
    rows = spark.createDataFrame([("NONE", "/a.o", None, "n", None, ".text", 1, 8, "FUNC", [], 1)], SCHEMA_ROW)
    first, second = (index_.SymbolIndex.open(spark, str(tmp_path / "i")) for _ in range(2))
    with pytest.raises(index_.ModifiedError), first.transaction():
        first.add_symbols(rows)
        second.add_symbols(rows)
    assert second.symbols().count() == 1


def test_goals_stop_when_reached(spark):
    """Routes as before, though no level is made for a goal that a start has reached."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 9)] + [(20, 9), (3, 30)], "src long, dst long")
    goals, starts = spark.createDataFrame([(9,), (30,)], "goal long"), spark.createDataFrame([(20,), (1,)], "start long")
    seen = []
    found = graph.routes(edges, starts, goals, num_routes=None, progress=graph.Progress(visited=seen.append))
    assert {r.goal: r.path for r in found.collect()} == {9: [20, 9], 30: [1, 2, 3, 30]}
    assert [bool(n) for n in seen] == [True, True, True, False]


def test_a_store_by_its_name(spark, tmp_path):
    """An index in a folder that is named as Hadoop names it; the metadata's number decides between writers."""
    where = f"file://{tmp_path}/some/i"
    rows = spark.createDataFrame([("NONE", "/a.o", None, "n", None, ".text", 1, 8, "FUNC", [], 1)], SCHEMA_ROW)
    with index_.SymbolIndex.open(spark, where) as index:
        index.add_symbols(rows)
        index.build_postings()
        for i in range(6):
            index.set_metadata("k", str(i))
        assert index.search("n").count() == 1 and index.get_metadata("k") == "5"
        metas = [n for n in index.store.names() if n.startswith("_meta")]
        assert len(metas) == 3 and not index.store.put_new(metas[-1], "x") and index.get_metadata("k") == "5"
        assert not [n for n in index.store.names() if n.startswith("_part")]
    assert index_.SymbolIndex.open(spark, f"{tmp_path}/some/i", readonly=True).symbols().count() == 1
    assert len(index_.delete_index(where, metadata_too=True)) == 4 and index_.delete_index(where) == []


def test_indexes_are_found_by_what_they_are_of(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CACHE_HOME", str(tmp_path / "cache"))
    (tmp_path / "a" / "b" / "c").mkdir(parents=True)
    for name, of in (("one", tmp_path / "a"), ("two", tmp_path / "a" / "b")):
        index_.SymbolIndex.open(spark, os.path.join(index_.default_folder(), name)).set_metadata("binary_dir", str(of))
    found = lambda p: index_.find_index(str(tmp_path / p))
    assert [found(p) and os.path.basename(found(p)) for p in ("a", "a/b", "a/b/c", "ab", ".")] == ["one", "two", "two", None, None]
