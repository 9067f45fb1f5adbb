"""Texts for a reader or a model that judges findings: what is known of a path, with its code windows, whole files, or a report's own words.

Texts are made by expressions, a row per finding. No model is called here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an assistant is told once, before any of the questions below.
INSTRUCTIONS = (
    "You help developers to review and repair their own code. Work from the excerpts and facts that you are given; where they don't suffice, name "
    "the excerpt that is missing instead of filling the gap. Explain weaknesses and how to remove them; don't write attacks. Keep apart what an "
    "excerpt shows and what only follows if code outside of it behaves as assumed."
)
QUESTIONS = (
    "Can someone outside choose the data at the source? Say how.",
    "Is there a step that makes the data safe for this sink? Name it, or the code you would need to see.",
    "Decide: real, false positive, or undecided, and give the reason in a sentence.",
    "How severe is it, given the barriers above?",
    "Which small change at which step removes the cause?",
)


def said(*parts) -> Column:
    """Parts as one text; null parts are a dash."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("-")) for p in parts])


def names(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.array_join(x, ", ")).otherwise("none")


def in_order(rows: DataFrame, key, order, part: Column, between: str, name: str) -> DataFrame:
    """Parts of a text, joined in an order, for each key. A finding has few."""
    each = F.array_sort(F.collect_list(F.struct(*order, part.alias("_part"))))
    return rows.groupBy(*key).agg(F.array_join(F.transform(each, lambda x: x["_part"]), between).alias(name))


def numbered(n: Column, text: Column, mark: Column | None = None) -> Column:
    sign = F.lit(" ") if mark is None else F.when(mark, "*").otherwise(" ")
    return F.concat(sign, F.lpad(n.cast("string"), 6, " "), F.lit(" | "), text)


def excerpts(windows: DataFrame) -> DataFrame:
    """windows: id, ord, role, file, line, stale, n, text, mark. id, excerpts: a path's windows, the place itself marked by an asterisk."""
    body = in_order(windows, ("id", "ord", "role", "file", "line", "stale"), ("n",), numbered(F.col("n"), F.col("text"), F.col("mark")), "\n", "body")
    head = said("[", F.col("role"), "] ", F.col("file"), ", line ", F.col("line"), F.when(F.col("stale"), " (changed since it was analyzed)").otherwise(""), "\n", F.col("body"))
    return in_order(body, ("id",), ("ord",), head, "\n\n", "excerpts")


def whole_files(places: DataFrame, lines: DataFrame) -> DataFrame:
    """places: id, file. id, files: whole files, numbered."""
    wanted = places.select("file").distinct()
    body = in_order(lines.join(wanted, "file", "left_semi"), ("file",), ("n",), numbered(F.col("n"), F.col("text")), "\n", "body")
    j = places.select("id", "file").distinct().join(body, "file", "left")
    return in_order(j, ("id",), ("file",), said("File ", F.col("file"), ":\n", F.coalesce("body", F.lit("(it can't be read)"))), "\n\n", "files")


def finding_prompts(summaries: DataFrame, excerpts: DataFrame, enriched: bool) -> DataFrame:
    """summaries: id, cwe, severity, confidence, layers, unguarded, guard_status, guards, source, sink. id, prompt: a path with its excerpts, with or without what the enrichment found."""
    s, c = summaries.join(excerpts, "id", "left"), F.col
    lines = [said("Finding ", c("id"), ": data may flow from ", c("source"), " to ", c("sink"), "."), said("Weakness ", c("cwe"), ", severity ", c("severity"), ".")]
    if enriched:
        lines += [said("Confidence ", c("confidence"), ". Kinds of data: ", names(c("layers")), "."), said("Barriers on every way: ", names(c("guards")), " (", c("guard_status"), "; without a barrier: ", c("unguarded"), ").")]
    return s.select("id", F.concat_ws("\n", *lines, F.lit("Excerpts, in the order of the flow:"), F.coalesce("excerpts", F.lit("(none)"))).alias("prompt"))


def report_prompts(results: DataFrame, lines: DataFrame) -> DataFrame:
    """results: id, rule_id, rule_text, rule_help, severity, security_severity, message, sink and flow (places of sources/reports.py, with uri as the file). id, prompt: a report's own words and all files of its flow."""
    c = F.col
    steps = F.transform("flow", lambda p: F.concat(F.lit("- "), p["uri"], F.lit(":"), p["line"].cast("string"), F.when(p["expr"] != "", F.concat(F.lit(" "), p["expr"])).otherwise("")))
    files = whole_files(results.select("id", F.explode(F.array_distinct(F.concat(F.array("sink.uri"), F.transform("flow", lambda p: p["uri"])))).alias("file")), lines)
    more = lambda x, head: F.when(F.coalesce(x, F.lit("")) != "", said(head, x))
    text = F.concat_ws(
        "\n", said("An analyzer reports ", c("rule_id"), " at ", c("sink.uri"), ", line ", c("sink.line"), "."), more(c("rule_text"), "What the rule looks for: "), F.when(~c("rule_help").eqNullSafe(c("rule_text")), more(c("rule_help"), "More about it: ")),
        said("Severity ", c("severity"), ", score ", c("security_severity"), "."), more(c("message"), "Its message: "), F.when(F.size("flow") > 0, F.concat_ws("\n", F.lit("The flow, step by step:"), F.array_join(steps, "\n"))), F.lit("All files of the flow:"), c("files"),
    )
    return results.join(files, "id", "left").select("id", text.alias("prompt"))


def review_prompts(summaries: DataFrame, excerpts: DataFrame) -> DataFrame:
    """id, prompt: the questions about one path, with its facts and excerpts."""
    asked = "\n".join(f"{i}. {q}" for i, q in enumerate(QUESTIONS, 1))
    return finding_prompts(summaries, excerpts, True).select("id", F.concat_ws("\n\n", "prompt", F.lit(asked)).alias("prompt"))


def layer_prompt(explained: DataFrame) -> DataFrame:
    """explained: the row of serving.explain_layer. layer, prompt: what to explain of a kind of data, from its provenance alone."""
    c = F.col
    by = F.array_join(F.transform(F.array_sort(F.map_entries("provenance")), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), names(e["value"]))), "\n")
    where = F.when(F.size("tagged_nodes") > 0, said("It marks ", names(c("tagged_nodes")), " on ", c("path_count"), " paths. Which three of these need attention first, and what is to be looked at in each?")).otherwise(
        said("It marks no place by itself and is a property of ", c("path_count"), " paths. What does that mean for them, and what is to be looked at?")
    )
    known = F.concat_ws("\n", said("Explain to a developer the kind of data '", c("layer"), "' in this project. It was found by:"), by, where)
    return explained.select("layer", F.when(c("provenance").isNull(), said("This project has no kind of data '", c("layer"), "'.")).otherwise(known).alias("prompt"))
