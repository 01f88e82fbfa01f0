"""Secret scans with a random forest that removes false positives.

A pattern finds candidates: runs of 12 token characters or more with a digit,
values of 8 characters or more that are assigned to secret names, and formats
(dotted tokens as a whole, paths of URLs, passwords in URLs).  A shorter run, or
one without a digit, that nothing of this marks isn't looked at.  What speaks for
a secret is then measured with SQL functions:

* the candidate's length, signs, and changes of character class;
* its character transitions: how likely each character is after the one before
  it, by the pairs of characters in the words of all documents;
* dictionary coverage: how much of it are frequent words of the documents, or
  words that labelled false findings are made of;
* whether it stands in a path, and the words of its file's path;
* the words around it.

What a word of a path or beside a candidate speaks for is learned from one half
of the labelled findings (log odds).  A random forest trained on the other half
judges the measures; its trees are written out as one SQL expression, so finding,
measuring, judging and redacting all happen in the JVM on the row.  Only the
counts of words and character pairs are shuffled.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symsearch.llm.common import discard, written

# The form of candidates.
#: A name whose value is a secret, up to its value.
NAMED = r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_ -]?key|access[_ -]?key|secret[_ -]?key|private[_ -]?key|auth|credentials?)[\x22\x27]?\s{0,3}(?:=>|:=|[=:])\s{0,3}"
#: What such a name is given: 8 or more characters of any kind, up to the other quote, or up to a blank or the next parameter.
VALUE = rf"(?:(?<=[\x22\x27])(?<={NAMED}[\x22\x27])[^\s\x22\x27]{{8,}}|(?<=[=:>\s])(?:(?<=[=:>]\s{{0,3}})(?<={NAMED})|(?<=(?i:bearer)\s{{1,3}}))(?=[^\s\x22\x27,;<>]{{8}})[^\s\x22\x27,;<>&]*(?:&(?!\w{{1,30}}=)[^\s\x22\x27,;<>&]*){{0,8}}(?<![.:?)\]}}&]))"
#: The password of a URL, and a path after its host, with a digit.
IN_URL = r"(?<=:)(?<=://[^\s/:@]{0,64}:)[^\s/@]{4,}(?=@)|(?<=[^/:]/)(?<=://[^\s/\x22\x27<>]{1,100}/)(?=[A-Za-z_+/.~%-]*+[0-9])[A-Za-z0-9_+/.~%-]{12,}(?<![.])"
#: Parts of token characters with dots between.
DOTTED = r"(?<![A-Za-z0-9_+/.@-])(?:eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}(?:\.[A-Za-z0-9_-]*){0,3}(?<![.])|(?:SG|ya29)\.[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]{10,})?|(?=[A-Za-z_.-]*+[0-9])[A-Za-z0-9_-]{16,}(?:\.[A-Za-z0-9_-]{6,}){1,3})"
#: A run of 12 or more token characters with a digit, and padding, where no such character, dot or @ is before; not a secret's name.
RUN = rf"(?<![A-Za-z0-9_+/.@-])(?=[A-Za-z_+/-]*+[0-9])(?![A-Za-z0-9_+/-]*{NAMED})[A-Za-z0-9_+/-]{{12,}}+={{0,2}}"
#: What none of them has before it is asked first, as most places in a text are inside a word.
CANDIDATE = f"(?<![A-Za-z0-9_])(?:{VALUE}|{IN_URL}|{DOTTED}|{RUN})"
#: How much text before and after a candidate is looked at.
BEFORE, AFTER = 48, 24
#: So many pieces of text and candidates hold more than that: each two have five characters.
NEAR = 2 * (BEFORE // 5 + 2)

#: How credentials of some public formats begin.
PREFIXES = r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk-|rk_live_|AIza|ya29|SG_|eyJ|npm_|pypi-|SG\.)"
ASSIGNED = r"[=:]\s{0,3}[\x22\x27]?$"
PATH_BEFORE = r"(?:[/\\]|https?:|www\.)[^\s]*$"

#: Characters of which transitions are counted: letters without case, digits as one, all others as one.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0."


def _symbols(text: str) -> str:
    """SQL: a text in SYMBOLS."""
    return f"regexp_replace(translate(lower({text}), '0123456789', '0000000000'), '[^a-z0]', '.')"


def _words(text: str) -> str:
    """SQL: the words of letters in a text, in lower case, camel case taken apart."""
    return f"filter(split(lower(regexp_replace({text}, '([a-z])([A-Z])', '$1 $2')), '[^a-z]+'), w -> length(w) > 1)"


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with a name for a value that is made once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _coverage(words: list[str]) -> str:
    if not words:
        return "0.0"
    return f"aggregate({_words('c')}, 0, (s, w) -> s + if(w in ({', '.join(repr(w) for w in words)}), length(w), 0)) / length(c)"


def _odds(text: str, odds: dict[str, float]) -> str:
    """SQL: the log odds of a text's words, added up."""
    if not odds:
        return "0.0"
    cases = " ".join(f"when {w!r} then {x!r}D" for w, x in odds.items())
    return f"aggregate(array_distinct({_words(text)}), 0D, (s, w) -> s + case w {cases} else 0D end)"


def _transitions(pairs: list[float]) -> str:
    """SQL: the mean log10 chance of the candidate's character pairs."""
    n = len(SYMBOLS)
    place = lambda i: f"instr('{SYMBOLS}', substr(z, {i}, 1))"
    step = f"element_at(array({', '.join(f'{x!r}D' for x in pairs)}), ({place('i')} - 1) * {n} + {place('i + 1')})"
    return _let(_symbols("c"), "z", f"aggregate(sequence(1, greatest(1, length(z) - 1)), 0D, (s, i) -> s + coalesce({step}, 0D)) / greatest(1, length(z) - 1)")


#: What is measured of a candidate c between the texts b and a, in the file p, by its form; SQL over those names.
FORM = {
    "length": "length(c)",
    "changes": r"regexp_count(c, '[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|[A-Z](?=[a-z])') / length(c)",
    "digits": "regexp_count(c, '[0-9]') / length(c)",
    "upper": "regexp_count(c, '[A-Z]') / length(c)",
    "signs": "regexp_count(c, '[_+/=-]') / length(c)",
    "hex": "if(c rlike '^[0-9a-f]+$|^[0-9A-F]+$', 1.0, 0.0)",
    "groups": "if(c rlike '^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$', 1.0, 0.0)",
    "variety": "size(array_distinct(split(c, ''))) / length(c)",
    "prefix": f"if(c rlike '{PREFIXES}', 1.0, 0.0)",
    "assigned": f"if(b rlike '{ASSIGNED}', 1.0, 0.0)",
    "in_path": rf"if(b rlike '{PATH_BEFORE}' or c rlike '^/|[a-z]/[a-z]', 1.0, 0.0)",
    "named": rf"if(b rlike '(?:{NAMED}[\x22\x27]?|(?i:bearer)\s+)$', 1.0, 0.0)",
    "other_signs": "regexp_count(c, '[^A-Za-z0-9_+/.=-]') / length(c)",
    "dots": "regexp_count(c, '[.]')",
    "letters": "if(c rlike '^[A-Za-z]?[a-z]+$', length(c), 0)",
    "longest": "array_max(transform(split(c, '[^A-Za-z0-9]+'), s -> length(s)))",
    "random": r"if(c rlike '(?<![A-Za-z0-9])(?=[A-Za-z0-9]*[0-9])(?=[A-Za-z0-9]*[A-Z])(?=[A-Za-z0-9]*[a-z])[A-Za-z0-9]{16,}', 1.0, 0.0)",
    "code": r"if(c rlike '^[$%{<]|[(\[{]|^[a-zA-Z_]+([.][a-zA-Z_]+)+$|^[*x]+$', 1.0, 0.0)",
    "url_password": r"if(a rlike '^@' and b rlike '://[^\s/:@]*:$', 1.0, 0.0)",
    "hook": r"if(b rlike '(?i)hook[^\s]*$' or c rlike '(?i)hook|^services/T[0-9A-Z]', 1.0, 0.0)",
}
FORM = {k: v.replace("\\", "\\\\") for k, v in FORM.items()}

#: Production parameters: frequent words of the documents in the dictionary; words of labelled findings that count, and in how many findings they have to be.
DICTIONARY, ODDS, LEAST = 2000, 150, 8
#: Of the forest; a finding is a secret from THRESHOLD on.
LABELLED, TREES, DEPTH, THRESHOLD = 6000, 15, 7, 0.5


def labelled_findings(spark: SparkSession, n: int = LABELLED, seed: int = 1) -> DataFrame:
    """(c, b, a, p, label): n labelled candidates with their surroundings, made from hashes of their numbers.

    Credentials of public formats, random values, passwords and pass phrases
    assigned to secret names, passwords in URLs and the paths of webhooks are 1.  Digests, identifiers, numbers, file names, addresses and
    placeholders are 0; so are random values that nothing marks as secret.
    """
    h = f"sha2(concat('{seed}/', id), 256)"
    # letters and digits of both cases, and of upper case alone
    mixed = f"regexp_replace(base64(unhex(concat({h}, sha2({h}, 256)))), '[+/=]', '')"
    caps = f"upper({mixed})"
    pick = lambda salt, *of: f"element_at(array({', '.join(repr(x) for x in of)}), cast(1 + pmod(xxhash64(id, '{salt}', {seed}), {len(of)}) as int))"
    name = pick("n", "password", "secret", "api_key", "access_token", "client_secret", "db_password", "auth_token", "private_key", "token", "passwd")
    sign = pick("s", "=", " = ", ": ", '="', ' = "', ": '")
    prose = pick("w", "the value of", "and then", "Some words here.", "they had", "in the", "see", "was")
    noun = pick("o", "commit", "sha256", "md5", "checksum", "uuid", "revision", "image", "digest", "order id", "version")
    quote = pick("q", "", '"', " and the rest", ".", ", other words", "\n")
    some = lambda text, salt, least, most: f"substr({text}, 1, cast({least} + pmod(xxhash64(id, '{salt}', {seed}), {most - least + 1}) as int))"
    kinds = [
        (f"concat('AKIA', substr({caps}, 1, 16))", f"concat({prose}, ' ')", 1),
        (f"concat({pick('g', 'ghp_', 'gho_', 'glpat-', 'sk_live_', 'xoxb-', 'AIza', 'npm_')}, {some(mixed, 'l', 20, 40)})", f"concat({prose}, ' ')", 1),
        (some(mixed, "l", 14, 44), f"concat({prose}, ' ', {name}, {sign})", 1),
        (some(h, "l", 16, 64), f"concat({prose}, ' ', {name}, {sign})", 1),
        (some(h, "l", 14, 24), f"concat({prose}, ' ', {name}, '=')", 1),
        (f"substr({h}, 1, {40})", f"concat({noun}, ' ')", 0),
        (f"concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-', substr({h}, 13, 4), '-', substr({h}, 17, 4), '-', substr({h}, 21, 12))", f"concat({prose}, ' ', {pick('u', 'id', 'uuid', 'key', 'token', 'was')}, ' ')", 0),
        (some(h, "l", 12, 64), f"concat({prose}, ' ')", 0),
        (f"concat(cast(19000000 + pmod(xxhash64(id), 9000000) as string), {pick('d', '-', '_', '')}, cast(100000 + pmod(xxhash64(id, 2), 900000) as string))", f"concat({prose}, ' ', {pick('v', 'tel', 'order', 'isbn', 'date', '')}, ' ')", 0),
        (f"concat({pick('x', 'your', 'example', 'sample', 'dummy', 'test', 'changeme', 'placeholder')}, {pick('y', '_', '-', '')}, {name}, {pick('z', '_here_1', '123', '0000', '_1')})", f"concat({name}, {sign})", 0),
        (f"concat({pick('e', 'AKIA', 'ghp_', 'sk_live_')}, {pick('f', 'XXXXXXXXXXXXXXX0', 'EXAMPLE0EXAMPLE0', '0000000000000000', '1234567890123456')})", f"concat({prose}, ' ')", 0),
        (f"concat({pick('i', 'image', 'file', 'page', 'build', 'chapter', 'module')}, {pick('j', '_', '-', '/')}, {pick('k', 'alpha', 'release', 'final', 'version', 'north')}, {pick('m', '_', '-', '/')}, cast(pmod(xxhash64(id, 3), 100000) as string))", f"concat({prose}, ' ')", 0),
        (f"concat({pick('a', '/usr/lib/', '/home/user/', 'static/img/', 'src/main/')}, {some(h, 'l', 6, 20)}, '1')", f"concat({prose}, ' ')", 0),
        (some(h, "l", 20, 40), f"concat({prose}, {pick('b', ' https://host.example/', ' www.host.example/x/', ' /var/cache/')})", 0),
        (f"concat(lower(regexp_replace({some(mixed, 'l', 12, 20)}, '[0-9]', 'e')), cast(pmod(id, 97) as string))", f"concat({prose}, ' ')", 0),
    ]
    other = f"regexp_replace(base64(unhex(sha2(concat({h}, 'x'), 256))), '[+/=]', '')"
    word = f"lower(regexp_replace({mixed}, '[0-9]', 'e'))"
    host = pick("h", " https://hooks.host.example/", " https://chat.example/", " http://www.host.example/")
    kinds += [
        (f"concat({some(mixed, 'l', 4, 10)}, {pick('c', '&', '!', '#', '@', '$', '%', '*')}, {some(other, 'r', 3, 12)})", f"concat({prose}, ' ', {name}, {sign})", 1),
        (f"concat({some(mixed, 'l', 4, 10)}, {pick('nn', '&', '!', '#', '@', '$', '_')}, {pick('oo', 'secret', 'main', 'password', 'alpha', 'time', 'north')}, {pick('pp', '#', '!', '', '%')}, cast(pmod(xxhash64(id, 6), 1000) as string))", f"concat({prose}, ' ', {name}, {sign})", 1),
        (some(mixed, "l", 8, 14), f"concat({prose}, ' ', {name}, {sign})", 1),
        (f"concat({some(word, 'l', 5, 9)}, cast(10 + pmod(xxhash64(id, 4), 9000) as string))", f"concat({prose}, ' ', {name}, {sign})", 1),
        (some(word, "l", 16, 32), f"concat({prose}, ' ', {name}, {sign})", 1),
        (f"regexp_replace({some(mixed, 'l', 20, 40)}, '[0-9]', 'Q')", f"concat({prose}, ' ', {name}, {sign})", 1),
        (f"concat('eyJ', {some(mixed, 'l', 12, 30)}, '.eyJ', {some(other, 'r', 12, 40)}, '.', {some(mixed, 't', 20, 43)})", f"concat({prose}, {pick('aa', ' ', ' Authorization: Bearer ', ' token=')})", 1),
        (f"concat({pick('bb', 'SG.', 'ya29.')}, {some(mixed, 'l', 20, 30)}, '.', {some(other, 'r', 20, 43)})", f"concat({prose}, ' ')", 1),
        (f"concat('ya29.', {some(mixed, 'l', 20, 43)})", f"concat({prose}, ' ')", 1),
        (f"concat({pick('cc', 'services/T0', 'api/webhooks/1', 'hooks/B0')}, substr({caps}, 1, 8), '/B0', substr({caps}, 9, 8), '/', {some(mixed, 'l', 20, 40)})", f"concat({prose}, {host})", 1),
        (some(mixed, "l", 6, 24), f"concat({prose}, {pick('dd', ' postgres://admin:', ' https://bob:', ' redis://:', ' amqp://svc:')})", 1, "'@db.host.example/x'"),
        (pick("ee", "password", "changeme", "your_password", "example123", "<password>", "${PASSWORD}"), f"concat({prose}, {pick('ff', ' postgres://user:', ' https://user:')})", 0, "'@db.host.example/x'"),
        (pick("gg", "required", "optional", "undefined", "whatever", "something", "authentication", "rotation", "forgotten", "incorrect", "necessary", "disabled", "deprecated"), f"concat({prose}, ' ', {name}, {sign})", 0),
        (pick("hh", "process.env.DB_PASSWORD", "os.environ.get(KEY)", "config.get(name)", "${DB_PASSWORD}", "{{password}}", "settings.SECRET_KEY", "getpass.getpass()", "********", "xxxxxxxx", "<your-token>"), f"concat({prose}, ' ', {name}, {sign})", 0),
        (f"concat({pick('ii', 'blog', 'articles', 'news', 'docs')}, '/20', cast(10 + pmod(id, 14) as string), '/', {pick('jj', 'how-to-bake-bread', 'release-notes-and-changes', 'some-title-here', 'index')}, {pick('kk', '', '.html', '/page/2', '-12345')})", f"concat({prose}, {host})", 0),
        (f"concat({pick('ll', 'production_backup', 'quarterly-report-final', 'node-exporter-service')}, '_', cast(pmod(xxhash64(id, 5), 100000) as string), {pick('mm', '.backup', '.document', '.example.internal', '.archive.tar-gz')})", f"concat({prose}, ' ')", 0),
    ]
    after = "case pmod(id, {}) {} else {} end".format(len(kinds), " ".join(f"when {k} then {x[3]}" for k, x in enumerate(kinds) if len(x) > 3), quote)
    choose = lambda i: "case pmod(id, {}) {} end".format(len(kinds), " ".join(f"when {k} then {x[i]}" for k, x in enumerate(kinds)))
    # half of the false ones stand in files of tests and texts
    path = f"if({choose(2)} = 0 and pmod(xxhash64(id, 'f'), 2) = 0, {pick('qq', 'tests/test_app.py', 'docs/readme.md', 'examples/sample.cfg', 'spec/fixture.json')}, {pick('p', 'src/app.py', 'config/prod.env', 'notes.txt', 'web', 'host', 'deploy.yaml')})"
    return spark.range(n).selectExpr(f"{choose(0)} as c", f"{choose(1)} as b", f"{after} as a", f"{path} as p", f"{choose(2)} as label")


def _tree(node, names: list[str]) -> str:
    if node.subtreeDepth() == 0:
        stats = [float(x) for x in node.impurityStats().stats()]
        return repr(round(stats[1] / max(sum(stats), 1e-9), 6)) + "D"
    split = node.split()
    return f"if(f.{names[split.featureIndex()]} <= {split.threshold()!r}D, {_tree(node.leftChild(), names)}, {_tree(node.rightChild(), names)})"


def corpus_counts(docs: DataFrame, text_col: str = "text", dictionary: int = DICTIONARY) -> tuple[list[str], list[float]]:
    """(the most frequent words of three letters or more, log10 of each character's chance after each other one), over all texts."""
    words = docs.selectExpr(f"explode(split({_column(text_col)}, '[ \\\\t-\\\\r]+')) as w").where("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    words = written(words, "words")
    some = words.selectExpr(f"explode({_words('w')}) as w", "n").where("length(w) > 2").groupBy("w").agg(F.sum("n").alias("n"))
    frequent = [r.w for r in some.orderBy(F.desc("n"), "w").limit(dictionary).collect()]
    pairs = words.selectExpr(f"{_symbols('w')} as z", "n").where("length(z) > 1").selectExpr("explode(transform(sequence(1, length(z) - 1), i -> substr(z, i, 2))) as pair", "n")
    counts = {r.pair: r.n for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}  # at most the square of SYMBOLS
    discard(words)
    chances = []
    for a in SYMBOLS:
        own = [counts.get(a + b, 0) for b in SYMBOLS]
        chances += [math.log10((n + 0.5) / (sum(own) + 0.5 * len(own))) for n in own]
    return frequent, chances


def _column(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _word_odds(findings: DataFrame, text: str, least: int = LEAST, most: int = ODDS) -> dict[str, float]:
    """How much each word of a text speaks for a secret in labelled findings: log odds of those that are in enough of them, the most frequent ones."""
    total = {r.label: r.n for r in findings.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = findings.selectExpr("label", f"explode(array_distinct({_words(text)})) as w").groupBy("w").agg(F.count_if(F.col("label") == 1).alias("yes"), F.count_if(F.col("label") == 0).alias("no"))
    rows = each.where(F.col("yes") + F.col("no") >= least).orderBy(F.desc(F.col("yes") + F.col("no")), "w").limit(most).collect()
    chance = lambda n, label: (n + 0.5) / (total.get(label, 0) + 1)
    return {r.w: round(math.log(chance(r.yes, 1) / chance(r.no, 0)), 6) for r in rows}


def _tree(node, names: list[str]) -> str:
    if node.subtreeDepth() == 0:
        stats = [float(x) for x in node.impurityStats().stats()]
        return repr(round(stats[1] / max(sum(stats), 1e-9), 6)) + "D"
    split = node.split()
    return f"if(f.{names[split.featureIndex()]} <= {split.threshold()!r}D, {_tree(node.leftChild(), names)}, {_tree(node.rightChild(), names)})"


@dataclass(frozen=True)
class Scanner:
    """Measures of a candidate, as SQL over c, b, a and p, and the forest, as SQL over a struct f of them."""

    measures: dict[str, str]
    forest: str


def learn(docs: DataFrame, labelled: DataFrame | None = None, *, text_col: str = "text", trees: int = TREES, depth: int = DEPTH, seed: int = 1) -> Scanner:
    """From all texts of ``docs`` and labelled findings (c, b, a, p, label); None: those of :func:`labelled_findings`.

    The words' odds come from the findings whose text hashes to an even number,
    the forest from the others.  Without a text no word is in the dictionary and
    all transitions are as likely; null texts have no words.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    frequent, pairs = corpus_counts(docs, text_col)
    labelled = labelled_findings(docs.sparkSession) if labelled is None else labelled
    # written, as several plans read them
    labelled = written(labelled.select("c", "b", "a", "p", "label", (F.pmod(F.xxhash64("c", "b"), F.lit(2)) == 0).alias("even")), "labelled")
    first, second = labelled.where("even"), labelled.where("not even")
    false = first.where("label = 0").selectExpr(f"explode(array_distinct({_words('c')})) as w").where("length(w) > 2").groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)
    words = sorted({*frequent, *(r.w for r in false.collect())})
    measures = FORM | {
        "transitions": _transitions(pairs),
        "dictionary": _coverage(words),
        "before": _odds("b", _word_odds(first, "b")),
        "after": _odds("a", _word_odds(first, "a")),
        "path_words": _odds("p", _word_odds(first, "p")),
    }
    names = list(measures)
    x = written(second.selectExpr(*(f"cast({sql} as double) as {k}" for k, sql in measures.items()), "cast(label as double) as label"), "findings")
    x = VectorAssembler(inputCols=names, outputCol="x").transform(x).select("x", "label").coalesce(1)
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(x)
    grown = [_tree(t._call_java("rootNode"), names) for t in model.trees]
    return Scanner(measures, f"({' + '.join(grown)}) / {len(grown)}D")


def findings(text: str, path: str, scanner: Scanner, threshold: float = THRESHOLD) -> str:
    """SQL: the candidates in a text column as an array of (value, f, score, is_secret)."""
    pattern = CANDIDATE.replace("\\", "\\\\")
    measures = ", ".join(f"'{k}', cast({sql} as double)" for k, sql in scanner.measures.items())
    # what is between candidates and the candidates in turn, no more of each than may be near another one; nothing is longer
    # than NEAR pieces around: a candidate and what is before it have five characters at least
    turns = f"flatten(zip_with(split({text}, '{pattern}', -1), regexp_extract_all({text}, '{pattern}', 0), (s, r) -> array(s, coalesce(r, ''))))"
    join = lambda begin, size: f"array_join(transform(slice(x.t, {begin}, {size}), s -> if(length(s) > {BEFORE + AFTER}, concat(left(s, {AFTER}), right(s, {BEFORE})), s)), '')"
    before = f"right({join(f'greatest(1, 2 * i + 1 - {NEAR})', f'least(2 * i + 1, {NEAR + 1})')}, {BEFORE})"
    after = f"left({join('2 * i + 3', str(NEAR))}, {AFTER})"
    around = _let(f"struct({turns} as t)", "x", f"transform(filter(x.t, (s, k) -> k % 2 = 1), (c, i) -> struct(c as c, {before} as b, {after} as a, coalesce({path}, '') as p))")
    own = measures
    for k in "cbap":
        own = _names(own, k)
    # the last piece has no candidate after it
    measured = f"transform(filter({around}, y -> y.c <> ''), x -> struct(x.c as value, named_struct({own}) as f))"
    scored = f"transform({measured}, x -> struct(x.value as value, x.f as f, {scanner.forest.replace('f.', 'x.f.')} as score))"
    return f"transform({scored}, x -> struct(x.value as value, x.f as f, x.score as score, x.score >= {threshold}D as is_secret))"


def _names(sql: str, name: str) -> str:
    """The variable ``name`` in the measures' SQL as a field of the lambda's x."""
    return "".join(part if i % 2 else re.sub(rf"(?<![\w.]){name}(?![\w(.])", f"x.{name}", part) for i, part in enumerate(re.split(r"('(?:[^'\\]|\\.)*')", sql)))


def scan(docs: DataFrame, *, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each candidate: id, ``nth`` in its document, ``value``, ``score``, ``is_secret``.

    ``scanner``: None learns one from ``docs``.  A null or empty text has no
    candidate, a null path names no file, a null id stays null.  Repeated rows
    give repeated findings.  Other columns are not read.
    """
    scanner = scanner or learn(docs, text_col=text_col)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), (F.col(path_col) if path_col else F.lit("")).cast("string").alias("s"))
    some = rows.where(F.col("t").rlike(CANDIDATE))
    found = some.select("i", F.posexplode(F.expr(findings("t", "s", scanner, threshold))).alias("nth", "x"))
    return found.select(F.col("i").alias(id_col), "nth", F.col("x.value").alias("value"), F.col("x.score").alias("score"), F.col("x.is_secret").alias("is_secret"))


def redacted(text_col: str, path_col: str | None, scanner: Scanner, threshold: float = THRESHOLD, mark: str = "<SECRET>") -> Column:
    """The text with the mark in place of each secret, and all else as it was; null stays null."""
    pattern = CANDIDATE.replace("\\", "\\\\")
    text, path = _column(text_col), f"cast({_column(path_col)} as string)" if path_col else "''"
    own = f"transform({findings(text, path, scanner, threshold)}, x -> if(x.is_secret, '{mark}', x.value))"
    whole = f"array_join(flatten(zip_with(split({text}, '{pattern}', -1), {own}, (s, r) -> array(s, coalesce(r, '')))), '')"
    return F.expr(f"if({text} rlike '{pattern}', {whole}, {text})")


def redact(docs: DataFrame, *, scanner: Scanner | None = None, text_col: str = "text", path_col: str | None = "source", length_col: str | None = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the secrets in its texts marked, and the length column set anew where a text has changed.

    ``scanner``: None learns one from ``docs``.  No row goes; rows without a
    secret, and those with a null or empty text, are as they were; so is an empty
    table.  Columns of any name stay.
    """
    scanner = scanner or learn(docs, text_col=text_col)
    # both in one struct, so that no name can clash
    clean = redacted(text_col, path_col, scanner, threshold)
    columns = [F.col(_column(c)) for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), clean.alias("clean"))
    changed = ~F.col("clean").eqNullSafe(F.col("row")[text_col])
    out = []
    for c in docs.columns:
        value = F.col("row")[c]
        if c == text_col:
            value = F.col("clean")
        elif c == length_col:
            value = F.when(changed, F.char_length("clean")).otherwise(value).cast(docs.schema[c].dataType)
        out.append(value.alias(c))
    return rows.select(*out)
