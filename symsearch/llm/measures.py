"""Numbers that describe a text's form, for the classifiers."""

from __future__ import annotations

from collections import Counter

MEASURES = ("words", "chars", "word_length", "long_words", "distinct", "repeated", "symbols", "pipes", "marks", "exclaims", "digits", "upper", "upper_words", "capitals", "other", "line_length", "dup_lines", "stops", "ends", "common", "spread", "at", "slashes")

#: Deletes everything but the named bytes.
_ONLY = {name: bytes(b for b in range(256) if b not in keep) for name, keep in {"symbols": b"#*$%&<>~^=", "pipes": b"|", "marks": b".,;:?()\"'-", "exclaims": b"!", "digits": b"0123456789", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "other": bytes(range(128, 256)), "at": b"@", "slashes": b"/\\"}.items()}


def measure(text: bytes) -> list[float]:
    """The MEASURES of a text, most of them shares or logarithms; all zero for an empty text."""
    from math import log1p

    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(MEASURES)
    only = {k: len(text.translate(None, drop)) for k, drop in _ONLY.items()}
    times = Counter(words)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    lengths = list(map(len, words))
    mean = sum(lengths) / n
    top = times.most_common(10)
    return [
        log1p(n),
        log1p(size),
        mean,
        sum(x > 15 for x in lengths) / n,
        len(times) / n,
        log1p(top[0][1]) / log1p(n),
        only["symbols"] / n,
        only["pipes"] / n,
        only["marks"] / n,
        only["exclaims"] / n,
        only["digits"] / size,
        only["upper"] / size,
        sum(map(bytes.isupper, words)) / n,
        sum(map(bytes.istitle, words)) / n,
        only["other"] / size,
        log1p(size / len(lines)),
        1 - len(set(lines)) / len(lines),
        text.count(b". ") / n,
        text.count(b".\n") / len(lines),
        sum(c for _, c in top) / n,
        (sum(x * x for x in lengths) / n - mean * mean) ** 0.5 if n > 1 else 0.0,
        only["at"] / n,
        only["slashes"] / n,
    ]
