"""The 21 symbols of a small C and C++ program, as rows."""

from __future__ import annotations

ROOT = "/w/fixture"
COLUMNS = "arch string, path string, source string, name string, demangled string, section string, address long, size long, type string, relocations array<string>, mtime long"


def row(name, file, section, kind, address=0, size=4, relocations=(), demangled=None):
    return ("X86_64", f"{ROOT}/{file}", None, name, demangled, section, address, size, kind, list(relocations), 1_700_000_000_123_456_789)


LONG = "name_has_256_chars_" + "0" * 237
ROWS = [
    row("top_level_symbol", "toplev.c.o", ".rodata", "OBJECT", 0, 64),
    row("other_top_level_symbol", "toplev.c.o", ".data.rel.ro.local", "OBJECT", 0, 8, ["top_level_symbol"]),
    row("main", "toplev.c.o", ".text", "FUNC", 0, 20, ["uses_c_function"]),
    row(LONG, "toplev.c.o", ".bss", "OBJECT", 64, 4),
    row("bar", "subdir/bar.cpp.o", ".bss", "OBJECT"),
    row("_Z12cxx_functionSt6vectorIiSaIiEE", "subdir/bar.cpp.o", ".text", "FUNC", 0, 24, ["bar", "foo"], "cxx_function(std::vector<int, std::allocator<int> >)"),
    row("_Z18CppCamelCaseSymbolPKc", "subdir/bar.cpp.o", ".text", "FUNC", 24, 11, (), "CppCamelCaseSymbol(char const*)"),
    row("uses_c_function", "subdir/bar.cpp.o", ".text", "FUNC", 35, 11, ["c_function"]),
    row("_ZL14global_integer", "subdir/bar.cpp.o", ".bss", "OBJECT", 4, 4, (), "global_integer"),
    row("foo", "subdir/foo.c.o", ".bss", "OBJECT"),
    row("foo_", "subdir/foo.c.o", ".bss", "OBJECT", 8, 8),
    row("foo__", "subdir/foo.c.o", ".bss", "OBJECT", 16, 4),
    row("uses_foo", "subdir/foo.c.o", ".text", "FUNC", 0, 13, ["foo"]),
    row("c_function", "subdir/foo.c.o", ".text", "FUNC", 13, 13, ["foo"]),
    *(row(f"a_name{i}", "subdir/foo.c.o", ".bss", "OBJECT", 20 + 4 * i, 4) for i in range(5)),
    row("CamelCaseSymbol", "subdir/foo.c.o", ".text", "FUNC", 26, 11),
    row("shared_object", "shared.c.so", ".data", "OBJECT", 0x4000, 4),
]
