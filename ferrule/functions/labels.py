"""Sensitive data by name and by form, as Column expressions over a rule pack."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrule.functions.scalars import CONFIDENCES, TEST_CARDS, luhn, ranked, shannon
from ferrule.sources.rules import Rules

IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
#: A quoted literal, without backtracking into its body.
QUOTED = r"(['\"])((?:\\.|(?!\1)[^\\])*+)\1"
NO_LAYERS = "array<string>"


def tokens(name: Column) -> Column:
    """Words of accessToken, access_token or APIKey, in lower case."""
    s = F.regexp_replace(F.regexp_replace(name, "(.)([A-Z][a-z]+)", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    return F.filter(F.split(F.lower(s), r"(?U)[_\W]+"), lambda t: t != "")


def norm(name: Column) -> Column:
    return F.concat(F.lit("_"), F.array_join(tokens(name), "_"), F.lit("_"))


def _words(term: str) -> str:
    return "_".join(t for t in term.lower().replace("-", "_").split("_") if t)


def ident_hit(normed: Column, terms) -> Column:
    """Whether a term stands in the name as a whole run of words, in the singular or a regular plural."""
    options = "|".join(_words(t) for t in terms)
    return normed.rlike(f"_(?:{options})(?:s|es)?_")


def ident_layers(name: Column, rules: Rules) -> Column:
    """Sorted layers that the name stands for; empty if none."""
    if not rules.labels:
        return F.array().cast(NO_LAYERS)
    n = norm(name)
    found = [F.when(ident_hit(n, rules.labels[layer]["identifiers"]), F.lit(layer)) for layer in sorted(rules.labels)]
    return F.coalesce(F.array_compact(F.array(*found)), F.array().cast(NO_LAYERS))


def ident_confidence(layers: Column, rules: Rules) -> Column:
    """The least of the layers' confidences; null for no layers."""
    rank = ranked(CONFIDENCES)
    of = F.create_map(*[x for layer, r in sorted(rules.labels.items()) for x in (F.lit(layer), F.lit(rank.get(r["confidence"], 2)))])
    return F.when(F.size(layers) > 0, F.element_at(F.array(*[F.lit(c) for c in CONFIDENCES]), F.array_min(F.transform(layers, lambda x: F.element_at(of, x)))))


def secret(text: Column, rules: Rules) -> Column:
    """struct<layers, source_id, confidence> if the text is a secret, else null.

    Named forms come first, in order; only the first match of a form is looked at, and it is passed over if the match holds a placeholder or
    fails its check. Then a text without placeholders that is long and varied enough counts, by its alphabet.
    """
    sec = rules.secrets
    kind = "struct<layers:array<string>,source_id:string,confidence:string>"
    if sec is None:
        return F.lit(None).cast(kind)

    def denied(x: Column) -> Column:
        out = F.lit(False)
        for d in sec["deny_values"]:
            out = out | x.rlike(d)
        return out

    def result(layers, source_id, confidence) -> Column:
        return F.struct(F.array(*[F.lit(x) for x in layers]).alias("layers"), F.lit(source_id).alias("source_id"), F.lit(confidence).alias("confidence"))

    out = F.when(text.isNull() | (text == ""), F.lit(None).cast(kind))
    for p in sec["patterns"]:
        match = F.regexp_substr(text, F.lit(p["regex"]))
        ok = match.isNotNull() & ~denied(match)
        if p["validator"] == "luhn":
            digits = F.regexp_replace(match, "[^0-9]", "")
            ok = ok & F.char_length(digits).between(13, 19) & ~digits.isin(*TEST_CARDS) & luhn(digits)
        out = out.when(F.coalesce(ok, F.lit(False)), result(p["layers"], f"secret:{p['id']}", p["confidence"]))
    out = out.when(denied(text) | ~F.char_length(text).between(sec["min_length"], sec["max_length"]), F.lit(None).cast(kind))
    out = out.when(text.rlike(r"^[A-Za-z0-9+/=_-]+\z") & (shannon(text) >= sec["base64_threshold"]), result(["credentials"], "secret:high-entropy", sec["confidence"]))
    # Lengths of common digests are no secrets, nor are numbers.
    hexa = text.rlike(r"^[0-9a-fA-F]+\z") & ~F.char_length(text).isin(32, 40, 64) & text.rlike("[a-fA-F]") & (shannon(text) >= sec["hex_threshold"])
    return out.when(hexa, result(["credentials"], "secret:high-entropy-hex", sec["confidence"]))


def identifiers(line: Column) -> Column:
    """Identifiers of a line of code, without what stands in quotes or after a hash."""
    code = F.split(F.regexp_replace(line, QUOTED, " "), "#", 2)[0]
    return F.regexp_extract_all(code, F.lit(f"({IDENTIFIER})"), F.lit(1))


def literals(line: Column) -> Column:
    """Bodies of quoted literals."""
    return F.regexp_extract_all(line, F.lit(QUOTED), F.lit(2))
