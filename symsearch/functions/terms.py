"""Column functions on names and paths: what the search language compares."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a token of a name.
TOKEN_PATTERNS = (
    r"[a-zA-Z]{2,}",
    r"[A-Z][a-z]+",
    r"[A-Z]{2,}",
    r"[a-z]{2,}",
    r"[0-9]+",
    r"[a-zA-Z]+[0-9]+",
)
SCOPED_PATTERN = r"(?U)::(\w+)"

#: The longest term, its field's prefix included, in bytes.
MAX_TERM_BYTES = 244


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(name: Column | str) -> Column:
    """The distinct tokens of a name: words, their camel-case parts, numbers, and scoped names."""
    name = _col(name)
    parts = [F.regexp_extract_all(name, F.lit(p), F.lit(0)) for p in TOKEN_PATTERNS]
    return F.array_distinct(F.concat(*parts, F.regexp_extract_all(name, F.lit(SCOPED_PATTERN), F.lit(1))))


def name_terms(name: Column | str) -> Column:
    """What a name is found by: itself and its tokens, in lower case (null for null)."""
    name = _col(name)
    return F.array_distinct(F.concat(F.array(F.lower(name)), F.transform(tokenize(name), F.lower)))


def raw_terms(name: Column | str) -> Column:
    """A name's terms as an index lists them: as it is, in lower case, and its tokens in lower case."""
    name = _col(name)
    return F.array_distinct(F.concat(F.array(name), name_terms(name)))


def words(text: Column | str) -> Column:
    """The lower-case words of running text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_col(text)), F.lit(r"(?U)\w+"), F.lit(0)))


def normalise_path(path: Column | str) -> Column:
    """A path without repeated slashes, ``.`` steps and a slash at its end; just two leading slashes stay."""
    path = _col(path)
    body = F.regexp_replace(F.regexp_replace(path, r"/+(?:\./+)*", "/"), r"(?<=.)/(?:\./?)*$|^(?:\./)+|(?<=/)\.$", "")
    body = F.when(body.isin("", "."), F.lit(".")).otherwise(body)
    two = path.rlike(r"^//(?!/)")
    return F.when(two, F.concat(F.lit("/"), body)).otherwise(body)


def normalise_path_literal(path: str) -> str:
    """The same for a literal."""
    from pathlib import PurePosixPath

    return str(PurePosixPath(path))


def resolve_literal(path: str, base: str | None = None) -> str:
    return os.path.realpath(os.path.join(base or os.getcwd(), path))


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def unsigned(c: Column | str) -> Column:
    """An unsigned 64-bit number that a long holds."""
    c = _col(c)
    return F.when(c < 0, c.cast("decimal(20,0)") + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(c.cast("decimal(20,0)")).cast("decimal(20,0)")


def unsigned_order(c: Column | str) -> Column:
    """A long that is ordered as the unsigned number is that ``c`` holds."""
    return _col(c).bitwiseXOR(F.lit(-(1 << 63)))


def end_address(address: Column | str = "address", size: Column | str = "size") -> Column:
    return _col(address) + _col(size)


def truncated(term: Column | str, prefix: str = "") -> Column:
    """The term's first bytes, as many as fit behind the prefix."""
    return F.substring(F.encode(_col(term), "UTF-8"), 1, MAX_TERM_BYTES - len(prefix.encode()))


def hashed(term: Column | str, prefix: str = "") -> Column:
    """What stands for a term that doesn't fit behind the prefix: its SHA-1 as hexadecimal digits; null if it fits."""
    whole = F.encode(_col(term), "UTF-8")
    return F.when(F.octet_length(whole) > MAX_TERM_BYTES - len(prefix.encode()), F.sha1(whole))


def parse_integer(text: str) -> int:
    """A decimal, or a hexadecimal with 0x; anything else is a ValueError."""
    if not re.fullmatch(r"0[xX][0-9a-fA-F]+|[0-9]+", text):
        raise ValueError(f"Invalid integer: {text}")
    return int(text, 16) if text[:2].lower() == "0x" else int(text)


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression for whole paths: ``**`` crosses directories, ``*`` and ``?`` do not."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:[^/]+/)*" if i and pattern[i - 1] == "/" or not i else "[^/]*/")
            i += 3
        elif pattern[i:] == "**" and (not i or pattern[i - 1] == "/"):
            out.append(".+" if i else ".*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            while pattern.startswith("*", i):
                i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[{'^' + body[1:] if body[0] in '!^' else body}]")
            i = end + 1
        elif c == "{" and (end := pattern.find("}", i)) > 0:
            out.append("(?:" + "|".join(glob_regex(p)[1:-1] for p in pattern[i + 1 : end].split(",")) + ")")
            i = end + 1
        else:
            out.append(re.escape(c))
            i += 1
    return "^" + "".join(out) + "$"
