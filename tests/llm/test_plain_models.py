"""Toxicity, quality and secrets against plain versions of their models and scores, on small tables."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from symsearch.llm import pairwise_quality, queries, secret_scan, toxicity

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
BLANKS = regex.compile(rb"[\x20\x09-\x0D]+")


def plain_measures(text):
    """What the classifiers measure of a text's form, from its definitions."""
    words = [w for w in BLANKS.split(text) if w]
    if not words:
        return [0.0] * len(pairwise_quality.MEASURES)
    n, size = len(words), len(text)
    share = lambda chars, of: sum(text.count(bytes([b])) for b in chars) / of
    times = Counter(words)
    lines = [x for x in text.split(b"\n") if BLANKS.sub(b"", x)]
    mean = sum(map(len, words)) / n
    top = sorted(times.values(), reverse=True)[:10]
    values = {
        "words": math.log(1 + n),
        "chars": math.log(1 + size),
        "word_length": mean,
        "long_words": sum(len(w) > 15 for w in words) / n,
        "distinct": len(times) / n,
        "repeated": math.log(1 + top[0]) / math.log(1 + n),
        "symbols": share(b"#*$%&<>~^=", n),
        "pipes": share(b"|", n),
        "marks": share(b".,;:?()\"'-", n),
        "exclaims": share(b"!", n),
        "digits": share(b"0123456789", size),
        "upper": share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", size),
        "upper_words": sum(w.isupper() for w in words) / n,
        "capitals": sum(w.istitle() for w in words) / n,
        "other": sum(b > 127 for b in text) / size,
        "line_length": math.log(1 + size / len(lines)),
        "dup_lines": 1 - len(set(lines)) / len(lines),
        "stops": len(regex.findall(rb"\. ", text)) / n,
        "ends": len(regex.findall(rb"\.\n", text)) / len(lines),
        "common": sum(top) / n,
        "spread": math.sqrt(max(sum((len(w) - mean) ** 2 for w in words) / n, 0)) if n > 1 else 0.0,
        "at": share(b"@", n),
        "slashes": share(b"/\\", n),
    }
    return [values[k] for k in pairwise_quality.MEASURES]


def fitted(x, y, ridge):
    """Weights and constant of a logistic model."""
    a = np.column_stack((x, np.ones(len(x))))
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w = w - np.linalg.solve(a.T @ np.diag(p * (1 - p)) @ a + penalty, a.T @ (p - y) + penalty @ w)
    return w


def applied(x, w):
    return 1 / (1 + np.exp(-(np.column_stack((x, np.ones(len(x)))) @ w)))


def tables(spark, sf_dir):
    docs = {r.doc_id: (r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    return docs, {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}


def test_toxicity_against_plain_chain(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = tables(spark, sf_dir)
    ids = [i for i in docs if i in labels and zlib.crc32(str(i).encode()) % 5]
    fold = np.array([zlib.crc32(f"{i}/fold".encode()) % 5 for i in ids])
    ys = [np.array([f(*labels[i]) for i in ids], float) for f in (lambda q, t: q == 0, lambda q, t: t == 1, lambda q, t: q == 0 and t == 1)]
    words = {i: {zlib.crc32(w.strip(b".,;:!?()[]{}\"'`*_#$%&|<>")) % (1 << 20) for w in BLANKS.split(t.translate(LOWER).encode()) if w} for i, t in docs.items()}
    form = {i: np.array(plain_measures(t.encode())) for i, t in docs.items()}
    mean, std = (f([form[i] for i in ids], axis=0) for f in (np.mean, np.std))

    def chosen(rows):
        out = set()
        df = Counter(w for r in rows for w in words[ids[r]])
        for y in ys:
            rate = sum(y[r] for r in rows) / len(rows)
            yes = Counter(w for r in rows if y[r] for w in words[ids[r]])
            stray = {w: (yes[w] - n * rate) / math.sqrt(n * rate * (1 - rate) + 1) for w, n in df.items()}
            out |= {w for w in sorted(stray, key=lambda w: (-stray[w], w))[: 512 // 3] if stray[w] >= 4}
        return sorted(out)

    def inputs(of, names):
        return np.array([[float(w in words[i]) for w in names] + (np.clip((form[i] - mean) / (std + 1e-6), -4, 4) / 2).tolist() for i in of])

    every = list(range(len(ids)))
    folds = [chosen([r for r in every if fold[r] != k]) for k in range(5)]
    earlier, models = np.zeros((len(ids), 0)), []
    names = chosen(every)
    thresholds = []
    for y in ys:
        guess = np.zeros(len(ids))
        for k in range(5):
            x = np.column_stack((inputs(ids, folds[k]), earlier))
            guess[fold == k] = applied(x[fold == k], fitted(x[fold != k], y[fold != k], 1.0))
        models.append(fitted(np.column_stack((inputs(ids, names), earlier)), y, 1.0))
        earlier = np.column_stack((earlier, guess))
        # precision counts more than recall
        score = lambda t, y=y, guess=guess: 1.5 * y[guess >= t].sum() / ((guess >= t).sum() + 0.5 * y.sum())
        thresholds.append(max(sorted(guess, reverse=True), key=score))
    x = inputs(docs, names)
    for w in models:
        x = np.column_stack((x, applied(x, w)))
    got = {r.doc_id: r for r in queries.op2_toxicity(spark, sf_dir).collect()}
    assert [(got[i].p_low_quality, got[i].p_toxic, got[i].p_toxic_junk) for i in docs] == [pytest.approx(tuple(p), abs=1e-4) for p in x[:, -3:]]
    # a threshold lies in the gap below the guess that it is taken from
    lower = max((g for g in earlier[:, 1] if g < thresholds[1]), default=0.0)
    assert all(got[i].toxic for i, p in zip(docs, x[:, -2], strict=True) if p > thresholds[1]) and not any(got[i].toxic for i, p in zip(docs, x[:, -2], strict=True) if p < lower)


def test_quality_against_plain_ranking(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = tables(spark, sf_dir)
    rows = [(r[0], [float(v) for v in r[1:]]) for r in pairwise_quality.labelled_rows(spark.read.parquet(f"{sf_dir}/labels.parquet"), ["quality"]).selectExpr("doc", "quality").collect()]
    ids = [i for i, _ in rows]
    assert sorted(ids) == sorted(i for i in docs if i in labels and zlib.crc32(str(i).encode()) % 5)
    x, y = np.array([plain_measures(docs[i].encode()) for i in ids]), np.array([labels[i][0] for i in ids])
    mean, std = x.mean(0), x.std(0) + 1e-6
    scaled = lambda t: np.clip((np.array(plain_measures(t.encode())) - mean) / std, -5, 5)
    z = np.array([scaled(docs[i]) for i in ids])
    rng = np.random.default_rng(1)
    better, worse = rng.choice(np.flatnonzero(y == 1), pairwise_quality.PAIRS), rng.choice(np.flatnonzero(y == 0), pairwise_quality.PAIRS)
    d, w = z[better] - z[worse], np.zeros(z.shape[1])
    for _ in range(60):
        lose = 1 / (1 + np.exp(d @ w))
        w = w + np.linalg.solve((d * (lose * (1 - lose))[:, None]).T @ d / len(d) + 1e-3 * np.eye(len(w)), d.T @ lose / len(d) - 1e-3 * w)
    s = z @ w
    cuts = [0.5 * (a + b) for a, b in zip([s.min()] + sorted(s)[:-1], sorted(s), strict=True)]
    errors = [((s >= c) != (y == 1)).sum() for c in cuts]
    got = {r.doc_id: r for r in pairwise_quality.score_quality(*(spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))).collect()}
    raw = {i: float(scaled(t) @ w) for i, t in docs.items()}
    order = lambda score: [i for i in sorted(docs, key=lambda i: (round(score(i), 5), i))]
    log_odds = lambda i: math.log(got[i].score / (1 - got[i].score)) * max(s.std() / 3, 1e-6)
    inner = [i for i in docs if 1e-12 < got[i].score < 1 - 1e-12]
    shift = {round(raw[i] - log_odds(i), 3) for i in inner}
    assert len(inner) > 500 and max(shift) - min(shift) < 0.02 and order(lambda i: raw[i])[:5]
    at = [i for i in ids if got[i].score >= 0.3]
    assert sum((got[i].score >= 0.3) != (labels[i][0] == 1) for i in ids) <= min(errors) and at


NAMES = "abcdefghijklmnopqrstuvwxyz0."


def symbols(text):
    return "".join(c if "a" <= c <= "z" else "0" if c in "0123456789" else "." for c in text.lower())


def parts(text):
    return [w for w in regex.split("[^a-z]+", regex.sub("([a-z])([A-Z])", r"\1 \2", text).lower()) if len(w) > 1]


def tree_value(sql, f):
    """A forest in SQL, evaluated."""
    sql = regex.sub(r"(?<=\d)D", "", sql)
    while (m := regex.search(r"if\(f\.(\w+) <= ([-0-9.eE]+), ([-0-9.eE]+), ([-0-9.eE]+)\)", sql)) is not None:
        sql = sql[: m.start()] + (m[3] if f[m[1]] <= float(m[2]) else m[4]) + sql[m.end() :]
    return eval(sql, {})  # noqa: S307 (numbers, sums and a quotient)


class PlainScan:
    """The tables that a scanner learns, and its findings, from their definitions; the forest is the scanner's own."""

    def __init__(self, texts, labelled, forest):
        self.forest = forest
        words = Counter(w for t in texts for w in regex.split(r"[ \t-\r]+", t) if w)
        frequent, self.pairs = Counter(), Counter()
        for w, n in words.items():
            for x in parts(w):
                frequent[x] += n * (len(x) > 2)
            z = symbols(w)
            for ab in zip(z, z[1:], strict=False):
                self.pairs[ab] += n
        self.counted = [w for w, n in sorted(frequent.items(), key=lambda x: (-x[1], x[0])) if n][: secret_scan.DICTIONARY]
        total = Counter()
        for (a, _), n in self.pairs.items():
            total[a] += n
        self.chance = {(a, b): math.log10((self.pairs[a, b] + 0.5) / (total[a] + 0.5 * len(NAMES))) for a in NAMES for b in NAMES}
        self.first = [r for r in labelled.selectExpr("*", "pmod(xxhash64(c, b), 2) as h").collect() if r.h == 0]
        false = Counter(w for r in self.first if r["label"] == 0 for w in set(parts(r["c"])) if len(w) > 2)
        self.dictionary = {*self.counted, *(w for w, n in false.items() if n >= 8)}
        self.odds = {k: self._odds(k) for k in "bap"}

    def _odds(self, key):
        n = Counter(r["label"] for r in self.first)
        seen = {k: Counter(w for r in self.first if r["label"] == k for w in set(parts(r[key]))) for k in (0, 1)}
        total = seen[0] + seen[1]
        kept = [w for w in sorted(total, key=lambda w: (-total[w], w)) if total[w] >= 8][:150]
        return {w: math.log(((seen[1][w] + 0.5) / (n[1] + 1)) / ((seen[0][w] + 0.5) / (n[0] + 1))) for w in kept}

    def measured(self, c, b, a, p):
        z, count = symbols(c), lambda pattern, x=c: len(regex.findall(pattern, x))
        named, has = secret_scan.NAMED, lambda pattern, x: float(bool(regex.search(pattern, x, flags=regex.ASCII)))
        return {
            "length": len(c),
            "changes": count("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|[A-Z](?=[a-z])") / len(c),
            "digits": count("[0-9]") / len(c),
            "upper": count("[A-Z]") / len(c),
            "signs": count("[_+/=-]") / len(c),
            "hex": has("^[0-9a-f]+$|^[0-9A-F]+$", c),
            "groups": has("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", c),
            "variety": len(set(c)) / len(c),
            "prefix": has(secret_scan.PREFIXES, c),
            "assigned": has("[=:]\\s{0,3}[\"']?$", b),
            "in_path": max(has(r"(?:[/\\]|https?:|www\.)[^\s]*$", b), has("^/|[a-z]/[a-z]", c)),
            "named": has(rf"(?:{named}[\x22\x27]?|(?i:bearer)\s+)$", b),
            "other_signs": count("[^A-Za-z0-9_+/.=-]") / len(c),
            "dots": c.count("."),
            "letters": len(c) * has("^[A-Za-z]?[a-z]+$", c),
            "longest": max(map(len, regex.split("[^A-Za-z0-9]+", c))),
            "random": has("(?<![A-Za-z0-9])(?=[A-Za-z0-9]*[0-9])(?=[A-Za-z0-9]*[A-Z])(?=[A-Za-z0-9]*[a-z])[A-Za-z0-9]{16,}", c),
            "code": has(r"^[$%{<]|[(\[{]|^[a-zA-Z_]+([.][a-zA-Z_]+)+$|^[*x]+$", c),
            "url_password": has("^@", a) * has(r"://[^\s/:@]*:$", b),
            "hook": max(has(r"(?i)hook[^\s]*$", b), has("(?i)hook|^services/T[0-9A-Z]", c)),
            "transitions": sum(self.chance[ab] for ab in zip(z, z[1:], strict=False)) / max(1, len(z) - 1),
            "dictionary": sum(len(w) for w in parts(c) if w in self.dictionary) / len(c),
            **{k: sum(self.odds[t].get(w, 0.0) for w in set(parts(x))) for k, t, x in (("before", "b", b), ("after", "a", a), ("path_words", "p", p))},
        }

    def find(self, t, path):
        """(match, score) of each candidate."""
        for m in regex.finditer(secret_scan.CANDIDATE, t, flags=regex.ASCII):
            f = self.measured(m[0], t[max(0, m.start() - 48) : m.start()], t[m.end() : m.end() + 24], path or "")
            yield m, tree_value(self.forest, f)

    def redact(self, t, path):
        out, at = "", 0
        for m, score in self.find(t, path):
            out, at = out + t[at : m.start()] + ("<SECRET>" if score >= 0.5 else m[0]), m.end()
        return out + t[at:]


def test_secrets_against_plain_scan(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()][:60]
    texts += ["password = hunter2222 and api_key: 'Zx81kQpL0vBn' http://u:s3cr3tpass@h/x, sha256 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822c", "camelCaseWord12 a/b/c/d1234567890ab the_token=abcd1234efgh;other=9"]
    path = lambda i: "tests/app.py" if i % 2 else "notes.txt"
    docs = spark.createDataFrame([(i, t, path(i)) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    labelled = secret_scan.labelled_findings(spark, 1200)
    scanner = secret_scan.learn(docs, labelled, trees=5)
    plain = PlainScan(texts, labelled, scanner.forest)
    counted, chances = secret_scan.corpus_counts(docs)
    assert counted == plain.counted
    assert chances == pytest.approx([plain.chance[a, b] for a in NAMES for b in NAMES])
    want = [(i, n, m[0], pytest.approx(score, abs=1e-6)) for i, t in enumerate(texts) for n, (m, score) in enumerate(plain.find(t, path(i)))]
    got = sorted((r.doc_id, r.nth, r.value, r.score) for r in secret_scan.scan(docs, scanner=scanner).collect())
    assert len(want) > 6 and got == want
