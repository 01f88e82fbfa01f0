"""One query for each operator, over the driver's tables, with the SQL that says the same.

The tables are read as symbols: a part is a symbol of a binary, a line item
refers to the next one of its order, an event is a file state.
"""

from __future__ import annotations

import os
import shlex
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symsearch.config import Config
from symsearch.functions.terms import basename, hashed, name_terms, normalise_path, tokenize, truncated
from symsearch.index import SymbolIndex
from symsearch.operators import completion, fileset, graph, output, ranking, tools
from symsearch.operators.checkpoints import shared_folder
from symsearch.operators.relocations import owners, reference_lists
from symsearch.plans import postings
from symsearch.plans.compiler import search
from symsearch.plans.fields import EnumField, ExactField, IntegerField, NameField, PathField, ReferencesField, Schema, TextField
from symsearch.plans.lexer import QueryError
from symsearch.plans.parser import Parser
from symsearch.plans.symbols import SYMBOL
from symsearch.sources import compdb
from symsearch.sources.elf import elf_of, has_magic, read_symbols
from symsearch.sources.files import CombinedSource, FrameSource, exclusion_stats, first_exclusion

# The kinds of parts, and the languages and sources of documents.
KINDS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")

SYM = Schema(
    (
        NameField("name", "XN"),
        NameField("demangled", "XD", optional=True),
        ExactField("fullname", "XFN", key=("name", "demangled"), optional=True),
        PathField("path", "XP", base="/build"),
        PathField("source", "XSRC", optional=True, base="/src"),
        ExactField("section", "XSN"),
        IntegerField("address", unsigned=True),
        IntegerField("size"),
        EnumField("type", "XT", values=KINDS),
        IntegerField("mtime"),
    )
)
DOC = Schema((TextField("text", "XTEXT"), EnumField("lang", "XL", values=("de", "en", "es", "fr")), ExactField("source", "XSRC"), IntegerField("n_chars")))
PAGE = Schema((PathField("url", "XU", base="https:"),))
SYM_PARSER = Parser(SYM, ("name", "demangled"), auto_wildcard=True)

SYM_SQL = """sym as (select p_partkey as id, replace(p_name, ' ', '_') || '_' || p_partkey as name,
 case when p_partkey % 3 = 0 then 'catalog::' || replace(p_name, ' ', '') || '(' || p_type || ')' end as demangled,
 '/build/' || replace(p_brand, '#', '_') || '/part_' || (p_partkey % 50) || '.o' as path,
 case when p_partkey % 2 = 0 then '/src/' || replace(p_name, ' ', '/') || '.c' end as source,
 '.' || lower(p_type) as section, p_partkey * 16 as address, cast(p_size as bigint) as size, p_type as type,
 1600000000000000000 + p_partkey * 1000003 as mtime from part)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sym(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, joined = F.col("p_partkey"), F.replace("p_name", F.lit(" "), F.lit("_"))
    return table(spark, sf_dir, "part").select(
        key.alias("id"),
        F.concat(joined, F.lit("_"), key).alias("name"),
        F.when(key % 3 == 0, F.concat(F.lit("catalog::"), F.replace("p_name", F.lit(" "), F.lit("")), F.lit("("), "p_type", F.lit(")"))).alias("demangled"),
        F.concat(F.lit("/build/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("/part_"), key % 50, F.lit(".o")).alias("path"),
        F.when(key % 2 == 0, F.concat(F.lit("/src/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(".c"))).alias("source"),
        F.concat(F.lit("."), F.lower("p_type")).alias("section"),
        (key * 16).alias("address"),
        F.col("p_size").cast("long").alias("size"),
        F.col("p_type").alias("type"),
        (F.lit(1600000000000000000) + key * 1000003).alias("mtime"),
    )


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def asked(name: str, text: str, where: str, columns: str = "id, name, size, type") -> None:
    """A query of the language over the symbols; ``where``: the same in SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search(sym(spark, sf_dir), text, SYM_PARSER).select(*columns.split(", "))

    run.__name__ = name
    query(f"with {SYM_SQL} select {columns} from sym where {where}")(run)


# The lower-case tokens of a name c, as SQL.
TOKENS_SQL = r"""list_distinct(list_transform(flatten([regexp_extract_all({c}, '[a-zA-Z]{{2,}}'), regexp_extract_all({c}, '[A-Z][a-z]+'),
 regexp_extract_all({c}, '[A-Z]{{2,}}'), regexp_extract_all({c}, '[a-z]{{2,}}'), regexp_extract_all({c}, '[0-9]+'),
 regexp_extract_all({c}, '[a-zA-Z]+[0-9]+'), regexp_extract_all({c}, '::([\p{{L}}\p{{N}}_]+)', 1)]), lambda x: lower(x)))"""


def has_term(c: str, value: str, prefix: bool = False) -> str:
    """SQL: a name is found by a value; null is false."""
    test = f"starts_with(x, '{value}')" if prefix else f"x = '{value}'"
    return f"coalesce(len(list_filter(list_append({TOKENS_SQL.format(c=c)}, lower({c})), lambda x: {test})) > 0, false)"


def any_name(value: str) -> str:
    return f"({has_term('name', value, True)} or {has_term('demangled', value, True)})"


asked("flagship", "red size:10..40 NOT type:PROMO", f"{any_name('red')} and size between 10 and 40 and type <> 'PROMO'")
asked("term_exact", "section:.promo", "section = '.promo'")
asked("term_prefix", "section:.s*", "starts_with(section, '.s')")
asked("name_token_match", "name:Red", has_term("name", "red"))
asked("name_prefix_match", "name:giz*", has_term("name", "giz", True))
asked("path_or_basename", "path:part_7.o OR path:/build//Brand_1/./part_3.o", "path = '/build/Brand_1/part_3.o' or path = '/build/part_7.o' or regexp_extract(path, '[^/]*$') = 'part_7.o'", "id, path")
asked("path_prefix", "path:Brand_2*", "starts_with(path, '/build/Brand_2') or starts_with(regexp_extract(path, '[^/]*$'), 'Brand_2')", "id, path")
asked("int_equal_hex", "size:0x10", "size = 16")
asked("int_range", "size:10..0x20", "size between 10 and 32")
asked("int_open_range", "size:..5 OR address:0x4000..", "size <= 5 or address >= 16384")
asked("enum_exact", "type:PROMO", "type = 'PROMO'")
asked("enum_prefix", "type:S*", "type in ('SMALL', 'STANDARD')")
asked("fullname_either", 'fullname:"catalog::redapple(PROMO)"* OR fullname:red*', "coalesce(starts_with(name, 'catalog::redapple(PROMO)'), false) or coalesce(starts_with(demangled, 'catalog::redapple(PROMO)'), false) or starts_with(name, 'red') or coalesce(starts_with(demangled, 'red'), false)", "id, name, demangled")
asked("match_all", "*:*", "true")
asked("match_nothing", "section: size:1..", "false")
asked("field_present", "demangled:*", "demangled is not null", "id, demangled")
asked("bool_and", "type:PROMO AND size:10..", "type = 'PROMO' and size >= 10")
asked("bool_or", "type:PROMO OR size:50", "type = 'PROMO' or size = 50")
asked("bool_not_null_safe", "!fullname:catalog* NOT demangled:*", "demangled is null")
asked("default_fields_autowildcard", "hot (giz OR anv)", f"{any_name('hot')} and ({any_name('giz')} or {any_name('anv')})")
asked("default_fields_string", '"Gizmo" !"ring"*', f"({has_term('name', 'gizmo')} or {has_term('demangled', 'gizmo')}) and not {any_name('ring')}")
asked("quoted_string", 'fullname:"catalog::red\\u0067izmo("*', "coalesce(starts_with(demangled, 'catalog::redgizmo('), false)", "id, demangled")
asked("wildcard_after_space", "section:.p *", "starts_with(section, '.p')")
asked("two_terms_side_by_side", "name:b*ring", f"{has_term('name', 'b', True)} and {any_name('ring')}")
asked("not_binds_next", "NOT type:PROMO size:..9 OR !(!(size:3..4))", "(type <> 'PROMO' and size <= 9) or size between 3 and 4")
asked("empty_parentheses", "(()) OR (size:50 ())", "size = 50")
asked("int_beyond_long", "address:..0xffffffffffffffff !address:0x8000000000000000..", "true")
asked("nested_precedence", "type:PROMO size:..9 OR !(type:S* OR size:20..)", "(type = 'PROMO' and size <= 9) or not (type in ('SMALL', 'STANDARD') or size >= 20)")
asked("empty_operands", "section: OR size:7 ()", "size = 7")


@query("select doc_id, lang, n_chars from documents where lang = 'en' and n_chars <= 2000 and list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), 'that')")
def text_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), "text:that lang:en n_chars:..2000", Parser(DOC)).select("doc_id", "lang", "n_chars")


@query("select page_id, url from pages where starts_with(regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$'), '6')")
def url_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "pages"), "url:6*", Parser(PAGE)).select("page_id", "url")


@query("select p_partkey, p_brand from part where p_type = 'PROMO' and starts_with(p_brand, 'Brand#1')")
def dynamic_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema of no fields takes every column."""
    return search(table(spark, sf_dir, "part"), "p_type:PROMO p_brand:Brand#1*", Parser(Schema(()))).select("p_partkey", "p_brand")


@query(f"with {SYM_SQL} select id, repeat(name, 30) as long from sym where id = 7")
def long_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal that is longer than an index's terms still asks for the whole value."""
    rows = sym(spark, sf_dir).select("id", F.repeat("name", F.lit(30)).alias("long"))
    value = rows.where("id = 7").first()["long"]
    return search(rows, f'long:"{value}"', Parser(Schema((ExactField("long", "XL"),))))


# Ill-formed queries, and what is said of them.
ERRORS = {
    "foo OR": "Expected RHS operand to OR at position 6",
    "foo AND": "Expected RHS operand to AND at position 7",
    "NOT": "Expected an expression at position 3",
    "(foo": 'Expected closing ")" (opening at position 0) at position 4, got end',
    "foo)": "Expected EOF at position 4, got )",
    "size:abc": "Invalid integer range value: abc",
    "size:..": "Invalid integer range query: ..",
    "size:*": "Invalid integer range query: ",
    "type:GREEN": f"Invalid value for 'type' field: GREEN (supported: {', '.join(KINDS)})",
    "type:X*": f"Invalid prefix for 'type' field: X (supported: {', '.join(KINDS)})",
    "colour:red": f'Unknown field "colour", must be one of [{", ".join(SYM)}]',
}


def _said(text: str, parser: Parser) -> str | None:
    try:
        parser.parse(text)
    except QueryError as e:
        return str(e)
    return None


@query("select * from (values " + ", ".join("('{}', '{}')".format(q.replace("'", "''"), e.replace("'", "''")) for q, e in ERRORS.items()) + ", ('size:', 'Missing value for field size at position 5'), ('size: 7', null)) e(query, error)")
def query_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    strict = Parser(SYM, ("name",), ignore_missing_values=False)
    said = [(q, _said(q, SYM_PARSER)) for q in ERRORS] + [(q, _said(q, strict)) for q in ("size:", "size: 7")]
    return spark.createDataFrame(said, "query string, error string")


EDGE_SQL = """step as (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as dst
 from lineitem), edge as (select distinct src, dst from step where dst is not null)"""


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    return lines.where("dst is not null").distinct()


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols with the names that they refer to."""
    rows = sym(spark, sf_dir)
    lists = edges_of(spark, sf_dir).join(rows.select(F.col("id").alias("dst"), F.col("name").alias("to")), "dst").groupBy("src").agg(F.array_sort(F.collect_set("to")).alias("relocations"))
    return rows.join(lists.withColumnRenamed("src", "id"), "id", "left").withColumn("relocations", F.coalesce("relocations", F.array().cast("array<string>")))


LINKED_SQL = f"{SYM_SQL}, {EDGE_SQL}, named as (select e.src, t.name as target from edge e join sym t on t.id = e.dst)"


@query(f"with {LINKED_SQL} select distinct src as id from named where {has_term('target', 'red')}")
def relocations_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(linked(spark, sf_dir), "relocations:red", Parser(Schema((ReferencesField("relocations", "XR"),)))).select("id")


@query(f"with {LINKED_SQL} select id from sym where id in (select src from named)")
def relocations_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(linked(spark, sf_dir), "relocations:*", Parser(Schema((ReferencesField("relocations", "XR"),)))).select("id")


@query(f"with {SYM_SQL} select path from sym union select source from sym where source is not null")
def combined_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sym(spark, sf_dir)
    return CombinedSource([FrameSource(rows), FrameSource(rows.select(F.col("source").alias("path")))]).paths(spark, "/build")


@query(f"with {SYM_SQL} select distinct path from sym")
def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list with paths below the root."""
    return FrameSource(sym(spark, sf_dir).select(F.regexp_replace("path", "^/build/", "").alias("path")).distinct()).paths(spark, "/build")


# File states from events: a file is a kind of event, a user and an hour of the day.  The first two thirds of the time
# are what an index has seen, the last two thirds what is there now.
STATE_SQL = """state as (select '/f/' || event_type || '/' || user_id || '/' || (epoch_us(ts) // 3600000000 % 24) as path, epoch_us(ts) as us, event_id from events),
 ends as (select min(us) as a, max(us) as b from state),
 prev as (select path, max(us) as mtime from state, ends where us <= a + (b - a) // 3 * 2 group by path),
 cur as (select path, max(us) as mtime from state, ends where us >= a + (b - a) // 3 group by path)"""


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    hour = F.pmod(F.floor(at / F.lit(3600000000)), F.lit(24)).cast("int")
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("/f/"), "event_type", F.lit("/"), "user_id", F.lit("/"), hour).alias("path"), at.alias("at"))


def states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(previous, current) file states."""
    events = event_files(spark, sf_dir)
    low, high = (x or 0 for x in events.agg(F.min("at"), F.max("at")).first())
    third = (high - low) // 3
    newest = lambda rows: rows.groupBy("path").agg(F.max("at").alias("mtime"))
    return newest(events.where(F.col("at") <= low + third * 2)), newest(events.where(F.col("at") >= low + third))


@query(f"with {STATE_SQL} select path, mtime from cur where path not in (select path from prev) or mtime > (select max(mtime) from prev)")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    prev, cur = states(spark, sf_dir)
    return fileset.changed_files(cur, prev, fileset.max_mtime(prev))


@query(f"with {STATE_SQL} select path from prev where path not in (select path from cur)")
def deleted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    prev, cur = states(spark, sf_dir)
    return fileset.deleted_files(cur, prev)


@query(f"with {STATE_SQL} select event_id, path from state where path in (select path from prev where path not in (select path from cur))")
def stale_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    prev, cur = states(spark, sf_dir)
    return fileset.stale_rows(event_files(spark, sf_dir), fileset.deleted_files(cur, prev)).select("event_id", "path")


@query(f"""with {STATE_SQL}, changed as (select path, mtime from cur where path not in (select path from prev) or mtime > (select max(mtime) from prev)),
 gone as (select path from prev where path not in (select path from cur))
 select path, mtime from prev where path not in (select path from changed) and path not in (select path from gone) union all select path, mtime from changed""")
def incremental_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    prev, cur = states(spark, sf_dir)
    changed, deleted = fileset.changed_files(cur, prev, fileset.max_mtime(prev)), fileset.deleted_files(cur, prev)
    return fileset.upsert(prev, changed, changed, deleted)


@query(f"""with {STATE_SQL}, changed as (select path, mtime from cur where path not in (select path from prev) or mtime > (select max(mtime) from prev))
 select 'unindex-deleted-file' as action, path from prev where path not in (select path from cur)
 union all select 'unindex-outdated-file', path from changed where path in (select path from prev) union all select 'index', path from changed""")
def dry_run_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prev, cur = states(spark, sf_dir)
    return fileset.plan(fileset.changed_files(cur, prev, fileset.max_mtime(prev)), fileset.deleted_files(cur, prev), prev)


EXCLUDED = ["**/part_1?.o", "Brand_1/**", "**/*_7.o", "nothing/*"]


@query(f"""with {SYM_SQL}, f as (select distinct path from sym), hit as (select case
 when regexp_matches(path, '/part_1[^/]\\.o$') then 0 when path like '/build/Brand\\_1/%' escape '\\' then 1
 when regexp_matches(path, '/[^/]*_7\\.o$') then 2 end as i from f)
 select pattern, cast(count(i) as bigint) as n from (values (0, '**/part_1?.o'), (1, 'Brand_1/**'), (2, '**/*_7.o'), (3, 'nothing/*')) p(k, pattern) left join hit on i = k group by pattern""")
def exclusion_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exclusion_stats(sym(spark, sf_dir).select("path").distinct(), EXCLUDED, "/build")


@query(f"""with {SYM_SQL} select distinct path from sym where not regexp_matches(path, '/part_1[^/]\\.o$|/[^/]*_7\\.o$') and path not like '/build/Brand\\_1/%' escape '\\'""")
def exclusion_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = sym(spark, sf_dir).select("path").distinct()
    return files.where(first_exclusion("path", EXCLUDED, "/build").isNull())


@query(f"with {SYM_SQL}, db as (select path, max(source) as source from sym group by path) select s.id, s.path, db.source from sym s left join db using (path)")
def source_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sym(spark, sf_dir)
    database = rows.groupBy(F.col("path").alias("binary")).agg(F.max("source").alias("source"))
    return compdb.sources_of(rows.select("id", "path"), database).select("id", "path", "source")


@query(f"""with {SYM_SQL}, db as (select path, max(source) as source from sym where type = 'PROMO' group by path), dwarf as (select path, max('/src/' || type) as source from sym group by path)
 select path as binary, case when d.path is not null then db.source else dwarf.source end as source from dwarf left join db using (path) left join db d using (path)""")
def source_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compilation database's word, else that of the debug information."""
    rows = sym(spark, sf_dir)
    by_path = lambda r, source: r.groupBy(F.col("path").alias("binary")).agg(F.max(source).alias("source"))
    return compdb.resolved(by_path(rows.where("type = 'PROMO'"), F.col("source")), by_path(rows, F.concat(F.lit("/src/"), "type")))


@query(f"""with {SYM_SQL}, e as (select id, case when size % 3 > 0 then '/d/' || type end as d, case when size % 2 = 0 then '/src/f_' || id || '.c' else 'f_' || id || '.c' end as file,
 case type when 'PROMO' then 'out/f_' || size || '.o' when 'SMALL' then '/obj/' || size || '.o' when 'LARGE' then 'a_' || size || '.o' end as o from sym),
 r as (select id, coalesce(d, '/base') as d, file, coalesce(o, coalesce(d, '/base') || '/f_' || id || '.o') as o from e)
 select "binary", arg_max(source, id) as source from (select id, case when starts_with(o, '/') then o else d || '/' || o end as "binary", case when starts_with(file, '/') then file else d || '/' || file end as source from r) group by 1""")
def compilation_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is built from what: by output, command, arguments, or the source's name; the last entry counts."""
    rows, size = sym(spark, sf_dir), F.col("size").cast("string")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    entries = rows.select(
        F.when(F.col("size") % 3 > 0, text("/d/", F.col("type"))).alias("directory"),
        F.when(F.col("size") % 2 == 0, text("/src/f_", F.col("id"), ".c")).otherwise(text("f_", F.col("id"), ".c")).alias("file"),
        F.when(F.col("type") == "PROMO", text("out/f_", size, ".o")).alias("output"),
        F.when(F.col("type").isin("PROMO", "SMALL"), text("cc -o x.o -c -o /obj/", size, ".o -O2")).alias("command"),
        F.when(F.col("type") == "LARGE", F.array(F.lit("cc"), F.lit("-o"), text("a_", size, ".o"), F.lit("-o"), F.lit("b.o"))).alias("arguments"),
        F.col("id").alias("nth"),
    )
    return compdb.resolve(entries, "/base")


# Binaries from orders: those with status P are no ELF files, the others have a symbol for each line.
ELF_SQL = """l as (select '/elf/' || l_orderkey || '.o' as path, 'line' || l_linenumber || '_' || l_suppkey as name, '.text_' || l_returnflag as section, l_partkey * 16 as address,
 cast(l_quantity as bigint) as size, case l_linestatus when 'O' then 'OBJECT' else 'FUNC' end as type, case when l_orderkey % 2 = 0 then 'X86_64' else 'AARCH64' end as arch
 from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus <> 'P')"""


def elf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, mtime, content)."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.concat(F.lit("line"), "l_linenumber", F.lit("_"), "l_suppkey").alias("name"), F.concat(F.lit(".text_"), "l_returnflag").alias("section"), (F.col("l_partkey") * 16).alias("address"), F.col("l_quantity").cast("long").alias("size"), F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("kind"))).alias("symbols"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    path = F.concat(F.lit("/elf/"), "l_orderkey", F.lit(".o"))

    @F.pandas_udf("binary")
    def written(machine: pd.Series, symbols: pd.Series) -> pd.Series:
        return pd.Series([elf_of([tuple(s.values()) for s in own], m) for m, own in zip(machine, symbols, strict=True)])

    machine = F.when(F.col("l_orderkey") % 2 == 0, 62).otherwise(183)
    content = F.when(F.col("o_orderstatus") == "P", F.encode(path, "UTF-8")).otherwise(written(machine, "symbols"))
    return lines.join(orders, "l_orderkey").select(path.alias("path"), F.col("l_orderkey").alias("mtime"), content.alias("content"))


@query(f"with {ELF_SQL} select path, name, section, address, size, type, arch from l where size >= 20 union all select distinct path, '', '', 0, 0, 'NOTYPE', 'NONE' from l where path not in (select path from l where size >= 20)")
def elf_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols from a size on, and a row for each file without any."""
    return read_symbols(spark, elf_files(spark, sf_dir), demangle_names=False, min_symbol_size=20)[0].select("path", "name", "section", "address", "size", "type", "arch")


@query("select distinct '/elf/' || l_orderkey || '.o' as path, 'not an ELF file' as error from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus = 'P'")
def elf_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_symbols(spark, elf_files(spark, sf_dir))[1]


@query(f"with {ELF_SQL} select distinct path from l")
def elf_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elf_files(spark, sf_dir).where(has_magic("content")).select("path")


@query(f"with {ELF_SQL} select count(distinct path) as files, count(*) as symbols from l where size >= 1")
def index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fileset.totals(read_symbols(spark, elf_files(spark, sf_dir), demangle_names=False)[0])


@query("with " + SYM_SQL + " select coalesce(max(mtime), 0) as mtime from sym")
def index_max_mtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(fileset.max_mtime(sym(spark, sf_dir)),)], "mtime long")


@query(f"with {SYM_SQL} select distinct path from sym")
def distinct_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fileset.distinct_files(sym(spark, sf_dir))


# Sections of symbols from line items: in each order a line begins at its part's number and is as long as its quantity.
RELOC_SQL = """s as (select cast(l_orderkey as varchar) as file, l_returnflag as section, l_partkey as address, cast(l_quantity as bigint) as size,
 cast(l_linenumber as bigint) * 100000000 + l_suppkey * 100 + cast(l_quantity as bigint) as ord, 'line' || l_linenumber as name from lineitem),
 r as (select cast(l_orderkey as varchar) as file, l_returnflag as section, l_partkey + k as r_offset, 'supp' || l_suppkey as target
 from lineitem, (values (-7), (0), (3), (25), (60)) v(k)),
 pq as (select r.file, r.section, r.r_offset, r.target,
 max(case when s.address < r.r_offset then {'a': s.address, 'ord': s.ord, 'size': s.size, 'name': s.name} end) as p,
 min(case when s.address >= r.r_offset then {'a': s.address, 'ord': s.ord, 'size': s.size, 'name': s.name} end) as q
 from (select distinct * from r) r join s on s.file = r.file and s.section = r.section group by all),
 own as (select file, r_offset, section, target, case when p.a <= r_offset and r_offset < p.a + p.size then p when q.a <= r_offset and r_offset < q.a + q.size then q end as o from pq)"""


def reloc_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("file"), F.col("l_returnflag").alias("section"), "l_partkey", "l_quantity", "l_linenumber", "l_suppkey")
    symbols = lines.select("file", "section", F.col("l_partkey").alias("address"), F.col("l_quantity").cast("long").alias("size"), (F.col("l_linenumber").cast("long") * 100000000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")).alias("ord"), F.concat(F.lit("line"), "l_linenumber").alias("name"))
    offsets = lines.select("file", "section", F.explode(F.transform(F.array(*map(F.lit, (-7, 0, 3, 25, 60))), lambda k: F.col("l_partkey") + k)).alias("r_offset"), F.concat(F.lit("supp"), "l_suppkey").alias("target"))
    return symbols, offsets.distinct()


@query(f"with {RELOC_SQL} select file, section, r_offset, target, o.ord as ord, o.name as name from own where o is not null")
def reloc_owner_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owners(*reloc_inputs(spark, sf_dir))


@query(f"with {RELOC_SQL} select file, o.name as name, array_to_string(list_sort(list_distinct(list(target))), ',') as relocations from own where o is not null group by file, o.name")
def reference_lists_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_lists(*reloc_inputs(spark, sf_dir)).withColumn("relocations", F.array_join("relocations", ","))


@query(f"with {SYM_SQL} select id, path, address, name from sym where type = 'PROMO' order by path, address, name limit 20 offset 10")
def offset_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(sym(spark, sf_dir), "type:PROMO", SYM_PARSER).orderBy("path", "address", "name").offset(10).limit(20).select("id", "path", "address", "name")


@query(f"with {SYM_SQL} select id, mtime from sym order by mtime desc limit 1")
def latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sym(spark, sf_dir).select("id", "mtime").orderBy(F.desc("mtime")).limit(1)


@query(f"with {SYM_SQL} select id, row_number() over (order by path, address) - 1 as \"index\", count(*) over () as total from sym where size >= 40")
def hit_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search(sym(spark, sf_dir), "size:40..", SYM_PARSER).select("id", "path", "address")
    return ranking.with_ordinals(rows, "path", "address").select("id", "index", "total")


@query(f"with {SYM_SQL} select count(*) as total from (select 1 from sym where size >= 40 limit 50)")
def bounded_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(sym(spark, sf_dir), "size:40..", SYM_PARSER).limit(50).agg(F.count(F.lit(1)).alias("total"))


@query(f"with {SYM_SQL} select count(*) as total from sym where size >= 40")
def document_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(sym(spark, sf_dir), "size:40..", SYM_PARSER).agg(F.count(F.lit(1)).alias("total"))


STAT_SQL = f"""{SYM_SQL}, st as (select path, max(mtime) as mtime from sym where id % 7 <> 0 group by path union all
 select source, max(mtime) + 5 from sym where source is not null and id % 4 = 0 group by source),
 flag as (select s.id, s.path, coalesce(a.mtime, 0) <> s.mtime as symbol_outdated,
 s.source is not null and coalesce(a.mtime, 0) < coalesce(b.mtime, 0) as binary_outdated
 from sym s left join st a on a.path = s.path left join st b on b.path = s.source)"""


def flagged(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    rows = sym(spark, sf_dir) if rows is None else rows
    binaries = rows.where("id % 7 <> 0").groupBy("path").agg(F.max("mtime").alias("mtime"))
    sources = rows.where("source is not null and id % 4 = 0").groupBy(F.col("source").alias("path")).agg((F.max("mtime") + 5).alias("mtime"))
    return fileset.with_staleness(rows, binaries.union(sources))


@query(f"with {STAT_SQL} select id, symbol_outdated, binary_outdated from flag")
def staleness_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select("id", F.col("outdated.symbol").alias("symbol_outdated"), F.col("outdated.binary").alias("binary_outdated"))


@query(f"with {STAT_SQL} select count(distinct case when symbol_outdated then path end) as symbol_files, count(distinct case when binary_outdated then path end) as binary_files from flag")
def stale_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fileset.stale_counts(flagged(spark, sf_dir))


@query(f"with {SYM_SQL} select id, regexp_extract(path, '[^/]*$') as basename, address + size as endaddress from sym")
def dynamic_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output.with_dynamic_fields(sym(spark, sf_dir)).select("id", "basename", "endaddress")


OUT = ("path", "name", "demangled", "address", "size")


@query(f"""with {SYM_SQL} select '{{"path":"' || path || '","name":"' || name || '","demangled":' || coalesce('"' || demangled || '"', 'null') || ',"address":' || address || ',"size":' || size || '}}' as json from sym""")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output.as_json(sym(spark, sf_dir).select(*OUT), OUT)


@query(f"""with {LINKED_SQL}, {STAT_SQL.removeprefix(SYM_SQL + ', ')}, refs as (select src, '["' || string_agg(target, '","' order by target) || '"]' as names from named group by src)
 select '{{"outdated":{{"binary":' || binary_outdated || ',"symbol":' || symbol_outdated || '}},"index":' || (row_number() over (order by s.path, s.address) - 1) || ',"total":' || (count(*) over ())
 || ',"arch":"X86_64","path":"' || s.path || '","source":' || coalesce('"' || source || '"', 'null') || ',"name":"' || name || '","demangled":' || coalesce('"' || demangled || '"', 'null')
 || ',"section":"' || section || '","address":' || address || ',"size":' || size || ',"type":"' || type || '","relocations":' || coalesce(names, '[]') || ',"mtime":' || mtime || '}}' as json
 from sym s join flag using (id) left join refs on src = id""")
def json_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with all their keys."""
    rows = flagged(spark, sf_dir, linked(spark, sf_dir)).withColumn("arch", F.lit("X86_64"))
    return output.as_json(ranking.with_ordinals(rows, "path", "address"))


@query(f"with {SYM_SQL} select id, 'objdump -dC --no-show-raw-insn ' || path || ' --section ' || section || ' --start-address 0x' || lower(to_hex(address)) || ' --stop-address 0x' || lower(to_hex(address + size)) as command from sym")
def disassembly_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.to_dict("records")
            yield pd.DataFrame({"id": batch["id"], "command": [shlex.join(tools.disassembly_command({**r, "arch": "X86_64"}, Config())) for r in rows]})

    return output.with_dynamic_fields(sym(spark, sf_dir)).select("id", "path", "name", "section", "address", "endaddress").mapInPandas(run, "id long, command string")


@query(f"""with {SYM_SQL} select id, case when type = 'PROMO' then '/src/' || section || '.c' when type = 'SMALL' then coalesce(source, '/src/first.c') when type = 'LARGE' then '/src/first.c' else source end as file,
 case when type = 'PROMO' then size when type = 'SMALL' then case when source is null then 1 else 77 end when type = 'LARGE' then 1 end as line from sym""")
def definition_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which line of a program's answer is a symbol's: that with its name, else with its source, else the first."""

    @F.pandas_udf("file string, line long")
    def chosen(said: pd.Series, name: pd.Series, source: pd.Series) -> pd.DataFrame:
        found = [tools.chosen_line(*x) for x in zip(said, name, source, strict=True)]
        return pd.DataFrame({"file": [f for f, _ in found], "line": pd.array([n for _, n in found], "Int64")})

    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    first, other = "first\n/src/first.c:1\n", text("inlined\n", F.coalesce("source", F.lit("/src/none.c")), ":77 (discriminator 3)\n")
    said = F.when(F.col("type") == "PROMO", text(first, other, F.col("name"), "\n/src/", F.col("section"), ".c:", F.col("size"), "\n"))
    said = said.when(F.col("type") == "SMALL", text(first, other)).when(F.col("type") == "LARGE", F.lit(first)).otherwise(F.lit("??\n??:0\n"))
    return sym(spark, sf_dir).select("id", chosen(said, "name", "source").alias("at")).select("id", "at.file", "at.line")


@query(f"""with {SYM_SQL} select '(:path "' || path || '" :name "' || name || '" :demangled ' || coalesce('"' || demangled || '"', 'nil') || ' :address ' || address || ' :size ' || size || ')' as sexp from sym""")
def sexp_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output.as_sexp(sym(spark, sf_dir).select(*OUT), OUT)


@query(f"with {SYM_SQL} select regexp_extract(path, '[^/]*$') || ': ' || name || ' 0x' || lpad(to_hex(address), 10, '0') || ' ' || rpad(section, 10, ' ') as text from sym")
def format_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output.as_text(sym(spark, sf_dir).withColumn("address", F.col("address")), "{basename}: {name} 0x{address:0>10X} {section:<10}")


@query(f"with {SYM_SQL} select id, array_to_string(list_sort(list_distinct(list_append({TOKENS_SQL.format(c='name')}, lower(name)))), ' ') as terms, case when demangled is not null then array_to_string(list_sort({TOKENS_SQL.format(c='demangled')}), ' ') end as tokens from sym")
def tokenize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sym(spark, sf_dir).select("id", F.array_join(F.array_sort(name_terms("name")), " ").alias("terms"), F.when(F.col("demangled").isNotNull(), F.array_join(F.array_sort(F.array_distinct(F.transform(tokenize("demangled"), F.lower))), " ")).alias("tokens"))


@query("select doc_id, substr(hex(encode(text)), 1, 478) as kept, case when octet_length(encode(text)) > 239 then sha1(text) end as sha1 from documents")
def sha1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index of short terms keeps of long ones."""
    return table(spark, sf_dir, "documents").select("doc_id", F.hex(truncated("text", "XTEXT")).alias("kept"), hashed("text", "XTEXT").alias("sha1"))


@query(f"with {SYM_SQL} select id, path, regexp_extract(path, '[^/]*$') as basename from sym")
def path_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    untidy = F.replace("path", F.lit("/part"), F.lit("/.//part"))
    return sym(spark, sf_dir).select("id", normalise_path(F.concat(untidy, F.lit("/"))).alias("path")).withColumn("basename", basename("path"))


@query(f"with {SYM_SQL}, t as (select unnest(list_append(list_append({TOKENS_SQL.format(c='name')}, lower(name)), name)) as term from sym) select distinct term from t where starts_with(term, 'g')")
def term_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completion.terms(sym(spark, sf_dir), SYM_PARSER, "name", "g")


COMPLETED = ("name:gi", "re", "NO", "type:S", "section:.p", "na", "size:1")


@query(f"""with {SYM_SQL}, t as (select unnest(list_append(list_append({TOKENS_SQL.format(c='name')}, lower(name)), name)) as term from sym),
 d as (select unnest(list_append(list_append({TOKENS_SQL.format(c='demangled')}, lower(demangled)), demangled)) as term from sym where demangled is not null)
 select 'name:gi' as query, 'name:' || term as completion from t where starts_with(term, 'gi')
 union select 're', term from (from t union from d) where starts_with(term, 're') union values ('NO', 'NOT'), ('na', 'name:')
 union select 'type:S', 'type:' || type from sym where starts_with(type, 'S') union select 'section:.p', 'section:' || section from sym where starts_with(section, '.p')""")
def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords, fields, and values of a field or of the default fields."""
    rows = sym(spark, sf_dir)
    return spark.createDataFrame([(q, c) for q in COMPLETED for c in completion.complete(rows, q, SYM_PARSER)], "query string, completion string")


@query(f"with {LINKED_SQL} select distinct n.src as id, s.name from named n join sym s on s.id = n.src where n.target = (select name from sym where id = 7)")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = sym(spark, sf_dir).where("id = 7").first()["name"]
    return graph.neighbours(linked(spark, sf_dir), name).select("id", "name")


# The goals of a search: two symbols; its starts: those of a size.  Each round of the recursion keeps the nodes that are new.
GOALS, STARTS = "id in (5, 17)", "size:50"
BFS_SQL = f"""recursive {EDGE_SQL}, walk(goal, node, hops) using key (goal, node) as (select p_partkey, p_partkey, 0 from part where p_partkey in (5, 17)
 union select w.goal, e.src, min(w.hops) + 1 from walk w join edge e on e.dst = w.node left join recurring.walk r on r.goal = w.goal and r.node = e.src where r.node is null group by w.goal, e.src),
 around as (select w.goal, w.goal as node, min(hops) + 1 as hops from walk w join edge e on e.src = w.goal and e.dst = w.node group by w.goal)"""


def goals_and_starts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = sym(spark, sf_dir)
    return rows.where(GOALS).select(F.col("id").alias("goal")), search(rows, STARTS, SYM_PARSER).select(F.col("id").alias("start"))


@query(f"with {BFS_SQL} select goal, node, hops from walk")
def bfs_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Until no node is new."""
    return graph.levels(edges_of(spark, sf_dir), goals_and_starts(spark, sf_dir)[0]).select("goal", "node", "hops")


ROUTES_SQL = f"with {BFS_SQL}, h as (select * from walk where hops > {{least}} union all select * from around) select goal, min(hops) as hops from h where node in (select p_partkey from part where p_size = 50) group by goal order by goal"


@query(ROUTES_SQL.format(least=0))
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortest route to every goal, of any length from one edge on."""
    goals, starts = goals_and_starts(spark, sf_dir)
    return graph.routes(edges_of(spark, sf_dir), starts, goals, num_routes=None).select("goal", (F.size("path") - 1).alias("hops"))


@query(ROUTES_SQL.format(least=0) + " limit 1")
def routes_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    goals, starts = goals_and_starts(spark, sf_dir)
    return graph.routes(edges_of(spark, sf_dir), starts, goals, num_routes=1).select("goal", (F.size("path") - 1).alias("hops"))


@query(ROUTES_SQL.format(least=-1).replace("p_size = 50", "p_size = 50 or p_partkey = 17"))
def routes_of_no_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A goal that is a start is a route by itself."""
    goals, starts = goals_and_starts(spark, sf_dir)
    starts = starts.union(goals.where("goal = 17"))
    return graph.routes(edges_of(spark, sf_dir), starts, goals, num_routes=None, zero_hops=True).select("goal", (F.size("path") - 1).alias("hops"))


@query("""with n as (select n_name, r_name, row_number() over (partition by n_regionkey order by n_nationkey) as k, string_agg(n_name, '/') over (partition by n_regionkey order by n_nationkey rows between current row and unbounded following) as way
 from nation join region on n_regionkey = r_regionkey) select way || '/' || r_name as path from n where k = 1""")
def depth_first_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first nation of each region over all the others to the region."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    region = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    steps = nations.select(F.col("n_name").alias("src"), F.coalesce(F.lead("n_name").over(region), "r_name").alias("dst"), F.row_number().over(region).alias("nth"), "r_name").cache()
    goals = {r.r_name for r in steps.select("r_name").distinct().collect()}
    found = [graph.depth_first(steps.select("src", "dst"), r.src, goals) for r in steps.where("nth = 1").collect()]
    return spark.createDataFrame([("/".join(p),) for p in found], "path string")


@query(f"with {SYM_SQL} select id, name, size, type from sym where ({any_name('gre')} or {any_name('blu')}) and not {any_name('bolt')} and size >= 5")
def postings_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sym(spark, sf_dir)
    asked = SYM_PARSER.parse("(gre OR blu) NOT bolt size:5..")
    return postings.search(asked, rows, postings.postings(rows, SYM, "id"), SYM, "id").select("id", "name", "size", "type")


def _bm25(*prefixes: str) -> str:
    """SQL: the score of an OR of prefixes over the default fields."""
    size = lambda c: f"coalesce(len(list_distinct(list_append(list_append({TOKENS_SQL.format(c=c)}, lower({c})), {c}))), 0)"
    leaves = [(c, p) for p in prefixes for c in ("name", "demangled")]
    test = [f"{has_term(c, p, True)} as t{i}, coalesce(len(list_filter(list_distinct(list_append(list_append({TOKENS_SQL.format(c=c)}, lower({c})), {c})), lambda x: starts_with(x, '{p}'))), 0) as f{i}" for i, (c, p) in enumerate(leaves)]
    # a term of each of path, last part of the path, section and type; a source has two
    terms = f"select *, {size('name')} + {size('demangled')} + 4 + case when source is null then 0 else 2 end as len, {', '.join(test)} from sym"
    weight = [f"(select count(*) as n, avg(len) as mean, {', '.join(f'count_if(t{i}) as n{i}' for i in range(len(leaves)))} from t)"]
    gain = lambda i: f"case when n{i} < n then ln((n - n{i} + 0.5) / (n{i} + 0.5)) else -1.0 end"
    part = lambda i: f"case when t{i} then (case when {gain(i)} >= 2 then {gain(i)} else greatest({gain(i)}, 0.0) * 0.5 + 1 end) * 2 * greatest(f{i}, 1) / (greatest(0.5, len / mean) * 0.5 + 0.5 + greatest(f{i}, 1)) else 0.0 end"
    return f"t as ({terms}), scored as (select *, {' + '.join(part(i) for i in range(len(leaves)))} as score from t, {weight[0]} where {' or '.join(f't{i}' for i in range(len(leaves)))})"


@query(f"with {SYM_SQL}, {_bm25('red', 'giz')} select id, name, round(score, 9) as score from scored order by scored.score desc, path, address, name limit 20")
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most relevant hits."""
    return ranking.ranked(sym(spark, sf_dir), "red OR giz", SYM_PARSER, limit=20).select("id", "name", F.round("score", 9).alias("score"))


@query(f"with {SYM_SQL}, {_bm25('red', 'giz')} select id, round(score, 9) as score from scored")
def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every hit."""
    return ranking.scored(sym(spark, sf_dir), "red OR giz", SYM_PARSER).select("id", F.round("score", 9).alias("score"))


# An index of all symbols: then the files of one brand are indexed again, with sizes one higher, and those of another are gone.
INDEXED_SQL = f"""{SYM_SQL}, now as (select id, name, demangled, path, address, case when starts_with(path, '/build/Brand_1') then size + 1 else size end as size
 from sym where not starts_with(path, '/build/Brand_2'))"""


def indexed(spark: SparkSession, sf_dir: str) -> SymbolIndex:
    rows = sym(spark, sf_dir).withColumns({"arch": F.lit("X86_64"), "relocations": F.array().cast("array<string>")}).select(*SYMBOL.fieldNames())
    changed = rows.where(F.col("path").startswith("/build/Brand_1"))
    index = SymbolIndex.open(spark, f"{shared_folder(spark)}/symsearch-index-{uuid.uuid4().hex}")
    index.add_symbols(rows)
    index.replace_files(changed.withColumn("size", F.col("size") + 1), changed.select("path"), rows.where(F.col("path").startswith("/build/Brand_2")).select("path"))
    return index


@query(f"with {INDEXED_SQL} select name, path, size from now where {any_name('red')} and size between 10 and 40")
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search in an index after a change, over its postings."""
    index = indexed(spark, sf_dir)
    index.build_postings()
    return index.search("red size:10..40").select("name", "path", "size")


@query(f"with {INDEXED_SQL} select name, address, size from now where path = (select max(path) from now)")
def index_rows_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = indexed(spark, sf_dir)
    return index.rows_of(index.all_files().agg(F.max("path")).first()[0]).select("name", "address", "size")


HINTED = ("catalog::redgizmo(", "catalog::nothing(", "red (", "catalog::hot")


@query(f"with {SYM_SQL}, q as (select * from (values {', '.join(f'({q!r})' for q in HINTED)}) v(query)) select query, exists(select 1 from sym where starts_with(lower(name), lower(query)) or starts_with(lower(demangled), lower(query))) as hinted from q")
def quoting_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ill-formed queries get a hint if they begin a name."""
    index = indexed(spark, sf_dir)
    said = []
    for q in HINTED:
        try:
            index.search(q)
        except QueryError as e:
            said.append((q, "forget to quote" in str(e)))
    return spark.createDataFrame(said, "query string, hinted boolean")


def entry(spark: SparkSession) -> DataFrame:
    return QUERIES["flagship"](spark, os.environ.get("SYMSEARCH_TABLES", "/root/testdata/sf0.001"))
