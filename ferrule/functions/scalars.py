"""Scalar operators on findings, as Column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

SEVERITIES = ("low", "medium", "high", "critical")
CONFIDENCES = ("low", "medium", "high")
#: Layers that weakness numbers stand for.
CWE_LAYERS = {"798": "credentials", "259": "credentials", "321": "credentials", "312": "credentials", "522": "credentials", "256": "credentials", "359": "pii", "200": "pii"}
#: What levels and precisions of reports stand for, card numbers that payment networks give out for tests, and how weakness numbers are written.
LEVELS = {"error": "high", "warning": "medium", "note": "low", "none": "low"}
PRECISIONS = {"very-high": "high", "high": "high", "medium": "medium", "low": "low"}
TEST_CARDS = ("4111111111111111", "4242424242424242", "5555555555554444", "5105105105105100", "378282246310005", "371449635398431", "6011111111111117", "4012888888881881")
CWE = r"(?i)cwe[-_/ ]?0*([0-9]+)"


def lookup(values: dict[str, str], key: Column) -> Column:
    """values[key], null where there is none."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def ranked(names, first: int = 1) -> dict[str, int]:
    return {n: i + first for i, n in enumerate(names)}


def rank_of(names, x: Column, otherwise: int) -> Column:
    """1 for the first name and so on."""
    return F.coalesce(F.element_at(F.create_map(*[y for n, i in ranked(names).items() for y in (F.lit(n), F.lit(i))]), x), F.lit(otherwise))


def name_of(names, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), rank)


def severity_rank(x: Column) -> Column:
    return rank_of(SEVERITIES, x, 0)


def confidence_rank(x: Column, otherwise: int = 0) -> Column:
    """Unknown confidence ranks 0 in views and 2 (as medium) where confidences are combined."""
    return rank_of(CONFIDENCES, x, otherwise)


def min_confidence(a: Column, b: Column) -> Column:
    return F.when(confidence_rank(a, 2) <= confidence_rank(b, 2), a).otherwise(b)


def to_int(x: Column, default: int = 1) -> Column:
    return F.coalesce(x.try_cast("int"), F.lit(default))


def parse_cwe(*candidates: Column) -> Column:
    """The first candidate with a weakness number, as CWE-<n>; candidates are strings or arrays of strings."""
    found = []
    for c in candidates:
        n = F.regexp_extract(c, CWE, 1)
        found.append(F.when(n != "", F.concat(F.lit("CWE-"), F.when(F.ltrim(n, F.lit("0")) == "", F.lit("0")).otherwise(F.ltrim(n, F.lit("0"))))))
    return F.coalesce(*found)


def parse_cwe_array(items: Column) -> Column:
    """Of an array: its first item that has one."""
    hits = F.filter(F.transform(items, lambda c: parse_cwe(c)), lambda c: c.isNotNull())
    return F.get(hits, F.lit(0))


def cwe_layers(cwe: Column) -> Column:
    one = lookup(CWE_LAYERS, F.regexp_extract(cwe, CWE, 1))
    return F.when(cwe.isNull() | one.isNull(), F.array().cast("array<string>")).otherwise(F.array(one))


def severity_of(level: Column, score: Column | None = None) -> Column:
    """The higher of the level's band and the score's; a score that is no number is left out."""
    base = F.coalesce(lookup(LEVELS, F.lower(F.when(F.coalesce(level, F.lit("")) == "", "warning").otherwise(level))), F.lit("medium"))
    if score is None:
        return base
    s = score.try_cast("double")
    # A NaN is below every bound.
    band = F.when(s.isNull(), 0).when(F.isnan(s), 1).when(s >= 9, 4).when(s >= 7, 3).when(s >= 4, 2).otherwise(1)
    return name_of(SEVERITIES, F.greatest(severity_rank(base), band))


def confidence_of(precision: Column, fallback: Column | None = None) -> Column:
    parts = [lookup(PRECISIONS, F.lower(F.coalesce(c, F.lit("")))) for c in (precision, fallback) if c is not None]
    return F.coalesce(*parts, F.lit("medium"))


def semgrep_severity(x: Column) -> Column:
    return F.coalesce(lookup({"ERROR": "high", "WARNING": "medium", "INFO": "low"}, F.coalesce(x, F.lit(""))), F.lit("medium"))


def sink_id(rule_id: Column) -> Column:
    """What stands after the last dot and then after the last slash; `finding` if nothing does."""
    last = F.element_at(F.split(F.element_at(F.split(F.coalesce(rule_id, F.lit("")), r"\.", -1), -1), "/", -1), -1)
    return F.when(last == "", F.lit("finding")).otherwise(last)


def strip_scheme(uri: Column) -> Column:
    """Percent-decoded, without file://, with slashes; a percent sign that starts no code stays."""
    escaped = F.regexp_replace(F.regexp_replace(uri, r"\+", "%2B"), r"%(?![0-9A-Fa-f]{2})", "%25")
    u = F.coalesce(F.try_url_decode(escaped), uri)
    u = F.when(F.startswith(u, F.lit("file://")), F.substring(u, 8, 1 << 30)).otherwise(u)
    u = F.when(u.rlike("^/[A-Za-z]:"), F.substring(u, 2, 1 << 30)).otherwise(u)
    return F.replace(u, F.lit("\\"), F.lit("/"))


def norm_path(path: Column) -> Column:
    """A path without empty and `.` segments and with `..` taken back; the empty path is `.`."""
    rooted = F.startswith(path, F.lit("/"))
    step = lambda acc, s: (
        F.when((s == "") | (s == "."), acc)
        .when((s == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((s == "..") & rooted, acc)
        .otherwise(F.array_append(acc, s))
    )
    body = F.array_join(F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), body)).when(body == "", F.lit(".")).otherwise(body)


def luhn(digits: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def shannon(text: Column) -> Column:
    """Bits per character; 0 for texts of at most one character. For short texts, as names and literals are; see text_entropy for long ones."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.char_length(text)
    # What a character's removal takes away is how often it stands there.
    counts = F.transform(F.array_distinct(chars), lambda c: n - F.char_length(F.replace(text, c, F.lit(""))))
    # -sum(k/n log(k/n)) = log n - sum(k log k) / n: one pass over the counts, without the text.
    mass = F.aggregate(counts, F.lit(0.0), lambda acc, k: acc + k * F.log2(k.cast("double")))
    return F.when(n <= 1, F.lit(0.0)).otherwise(F.log2(n.cast("double")) - mass / n)


@F.pandas_udf(DoubleType())
def _entropy(texts: pd.Series) -> pd.Series:
    def bits(t) -> float | None:
        if t is None:
            return None
        k = np.unique(np.frombuffer(t.encode("utf-32-le"), np.uint32), return_counts=True)[1].astype(float)
        n = k.sum()
        return float(np.log2(n) - (k @ np.log2(k)) / n) if n > 1 else 0.0

    return texts.map(bits, na_action=None)


def text_entropy(text: Column) -> Column:
    """The same for texts of any length; null for a null text. A whole text's characters are sorted and counted as an array of numbers, which expressions on arrays of strings take twenty times as long for."""
    return _entropy(text)


def file_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def module_name(path: Column) -> Column:
    """a/b.py and a/b/__init__.py are a.b."""
    p = F.regexp_replace(path, r"\.py$", "")
    return F.replace(F.regexp_replace(p, r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def line_drift(snippet: Column, disk: Column) -> Column:
    """Whether a tool's snippet is no longer what the line says."""
    first = F.trim(F.split(snippet, "\n", 2)[0])
    return F.coalesce((snippet != "") & (disk != "") & ~F.contains(disk, first) & ~F.contains(snippet, disk), F.lit(False))


def collapse(items: Column) -> Column:
    """An array without repetitions next to each other."""
    return F.filter(items, lambda x, i: (i == 0) | (x != F.get(items, i - 1)))


def est_tokens(text: Column) -> Column:
    return F.floor(F.char_length(text) / 4).cast("long")
