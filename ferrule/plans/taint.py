"""Taint: which data reaches which sinks, within functions and across calls.

Inside a function data moves along its value graph. The closure of that graph is taken function by function (its size is bounded by the
function's), which leaves for every place of interest - returns, arguments of bound calls and of sinks, call sites - the parameters, origins and
results of bound calls that reach it. Across functions the rest is relations: what a call returns follows from its callee's returns and its own
arguments, and rounds of joins add to that table until it stays the same. Each round the table is written out, so plans don't grow.

Sinks are then lifted along calls: a parameter that reaches a bound argument whose parameter reaches a sink reaches that sink as well. A fact
keeps the guards that hold on every way to it, as the bits that all ways share, and the shortest way, ties to the smallest. Findings with one
key are merged the same way: guarded only if every way is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.labels import ident_confidence, ident_layers, secret
from ferrule.functions.scalars import CONFIDENCES, collapse, confidence_rank, name_of
from ferrule.operators.callgraph import Index, bindings, classify
from ferrule.operators.lowering import facts
from ferrule.plans.state import kept, kept_paths, watched
from ferrule.sources.rules import Rules

LONGEST_WAY = 8
PORTS = "fn string, port string, call int, slot int, kind string, label int"


def origins(lowered: DataFrame, rules: Rules) -> DataFrame:
    """fn, node, origin (a number within the function), source_id, layers, confidence, line: where data of interest is born."""
    # Both are written: a condition on what is made of a text would be pushed down to it, and have it made once more.
    text = kept(facts(lowered, "text"), "texts")
    named = kept(text.where("role = 'name'").select("fn", "node", "line", ident_layers(F.col("text"), rules).alias("layers")), "named")

    def by_name(df: DataFrame) -> DataFrame:
        return df.where(F.size("layers") > 0).select("fn", "node", F.concat(F.lit("label:"), F.array_join("layers", "-")).alias("source_id"), "layers", ident_confidence(F.col("layers"), rules).alias("confidence"), "line")

    def by_text(df: DataFrame) -> DataFrame:
        return df.where("s is not null").select("fn", "node", "s.source_id", "s.layers", "s.confidence", "line")

    literal = text.where("role = 'literal'").select("fn", "node", "line", secret(F.col("text"), rules).alias("s"))
    constant = text.where("role = 'constant'").select("fn", "node", "line", secret(F.get_json_object("text", "$[0]"), rules).alias("s"), ident_layers(F.get_json_object("text", "$[1]"), rules).alias("layers"))
    born = facts(lowered, "gen").select("fn", "node", "source_id", "layers", "confidence", "line")
    every = born.union(by_name(named)).union(by_text(literal)).union(by_text(constant)).union(by_name(constant.where("s is null").drop("s")))
    # A number from the content, the same each time; a function has few origins.
    return every.groupBy("fn").agg(F.array_sort(F.collect_set(F.struct("node", "source_id", "layers", "confidence", "line"))).alias("all")).select("fn", F.posexplode("all").alias("origin", "o")).select("fn", "origin", "o.*")


def local_closure(lowered: DataFrame, decided: DataFrame, born: DataFrame) -> DataFrame:
    """decided: fn, call, flow (none, some, all), args (for some), bound, over_approx, sink_args. What reaches each place, as PORTS."""
    calls = decided.groupBy("fn").agg(F.to_json(F.collect_list(F.struct("call", "flow", "args", "bound", "over_approx", "sink_args"))).alias("decided"))
    gens = born.groupBy("fn").agg(F.to_json(F.collect_list(F.struct("node", "origin"))).alias("gens"))
    f = facts(lowered, "function").select("fn", "graph").join(calls, "fn", "left").join(gens, "fn", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for fn, graph, decided, gens in zip(frame["fn"], frame["graph"], frame["decided"], frame["gens"]):
                rows += close(fn, json.loads(graph), json.loads(decided) if decided else [], json.loads(gens) if gens else [])
            yield pd.DataFrame(rows, columns=["fn", "port", "call", "slot", "kind", "label"])

    return f.select("fn", "graph", "decided", "gens").mapInPandas(run, PORTS)


def close(fn: str, graph: dict, decided: list[dict], gens: list[dict]) -> list[tuple]:
    """Labels are bits: parameters, then origins, then results of bound calls."""
    n, calls = graph["n"], {int(k): v for k, v in graph["calls"].items()}
    onto: list[list[int]] = [[] for _ in range(n)]
    for a, b in graph["edges"]:
        onto[a].append(b)
    bound = [d["call"] for d in decided if d["bound"]]
    labels = [("P", i) for i in range(len(graph["params"]))] + [("O", i) for i in sorted({g["origin"] for g in gens})] + [("C", c) for c in bound]
    bit = {x: 1 << i for i, x in enumerate(labels)}
    held = [0] * n
    for i, p in enumerate(graph["params"]):
        held[p] |= bit["P", i]
    for g in gens:
        held[g["node"]] |= bit["O", g["origin"]]
    for d in decided:
        slots = calls[d["call"]]
        args = slots["args"]
        if d["bound"]:
            held[d["call"]] |= bit["C", d["call"]]
        if d["flow"] == "all":
            into = [slots["func"], *args]
        elif d["flow"] == "some":
            into = [slots["func"], *(args[i] for i in d.get("args") or [] if i < len(args))]
        else:
            into = []
        for a in into:
            onto[a].append(d["call"])
    todo = [i for i in range(n) if held[i]]
    while todo:
        a = todo.pop()
        for b in onto[a]:
            if held[a] & ~held[b]:
                held[b] |= held[a]
                todo.append(b)

    def rows(port, call, slot, bits):
        while bits:
            low = bits & -bits
            kind, label = labels[low.bit_length() - 1]
            yield fn, port, call, slot, kind, label
            bits ^= low

    out: list[tuple] = []
    returned = 0
    for r in graph["returns"]:
        returned |= held[r]
    out += rows("return", -1, -1, returned)
    for d in decided:
        slots = calls[d["call"]]
        met = held[slots["func"]]
        for a in slots["args"]:
            met |= held[a]
        out += rows("site", d["call"], -1, met)
        if d["bound"]:
            if slots["receiver"] is not None:
                out += rows("arg", d["call"], -1, held[slots["receiver"]])
            for i, a in enumerate(slots["args"]):
                out += rows("arg", d["call"], i, held[a])
        for i in d.get("sink_args") or []:
            if i < len(slots["args"]):
                out += rows("sink", d["call"], i, held[slots["args"][i]])
    return out


class Masks:
    """Sets of guard terms as bits, in as many longs as the terms need; unions and intersections are then operations on numbers."""

    BITS = 62

    def __init__(self, terms: list[str]):
        self.words = [terms[i : i + self.BITS] for i in range(0, len(terms), self.BITS)] or [[]]

    def _struct(self, of) -> Column:
        return F.struct(*[of(i).cast("long").alias(f"w{i}") for i in range(len(self.words))])

    def none(self) -> Column:
        return self._struct(lambda i: F.lit(0))

    def of(self, guards: Column) -> Column:
        def word(i: int) -> Column:
            out = F.lit(0).cast("long")
            for k, t in enumerate(self.words[i]):
                out = out.bitwiseOR(F.when(F.array_contains(guards, t), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
            return out

        return self._struct(word)

    def both(self, a: str, b: str) -> Column:
        return self._struct(lambda i: F.col(a)[f"w{i}"].bitwiseOR(F.col(b)[f"w{i}"]))

    def common(self, mask: str) -> Column:
        """An aggregate: what all rows have."""
        return self._struct(lambda i: F.bit_and(F.col(mask)[f"w{i}"]))

    def exceeds(self, a: str, b: str) -> Column:
        """Whether a has a term that b lacks."""
        more = [F.col(a)[f"w{i}"].bitwiseAND(F.bitwise_not(F.col(b)[f"w{i}"])) != 0 for i in range(len(self.words))]
        return reduce(lambda x, y: x | y, more)

    def names(self, mask: str) -> Column:
        found = [F.when(F.col(mask)[f"w{i}"].bitwiseAND(F.lit(1 << k).cast("long")) != 0, F.lit(t)) for i, w in enumerate(self.words) for k, t in enumerate(w)]
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


class Analysis:
    """findings, tainted (call sites), classified, summaries of a project; seeds and bindings can be left out for the analysis of single functions."""

    def __init__(self, lowered: DataFrame, rules: Rules, across: bool = True, oracle: DataFrame | None = None):
        self.masks = Masks(rules.guard_terms())
        self.lowered, self.rules, self.across = lowered, rules, across
        self.index = Index(lowered)
        self.classified = classify(lowered, rules, self.index, oracle)
        self.functions = self.index.functions
        self.bound = kept(bindings(self.classified, self.functions), "bound") if across else kept(bindings(self.classified.where("false"), self.functions), "bound")
        self.born = kept(origins(lowered, rules), "origins")
        self.ports = kept(local_closure(lowered, self._decided(), self.born), "ports")
        self._returns()
        self._sinks()

    def _decided(self) -> DataFrame:
        taint_args = F.array(*[F.array(*[F.lit(int(i)) for i in r["taint_args"]]) for r in self.rules.sinks] or [F.array().cast("array<int>")])
        some = F.array(*[F.lit(None).cast("array<int>") if "any" in r["from_args"] else F.array(*[F.lit(i) for i in r["from_args"] if isinstance(i, int)]) for r in self.rules.propagators] or [F.lit(None).cast("array<int>")])
        b = self.bound.select("fn", "call", "over_approx", F.lit(True).alias("bound"))
        c = self.classified.join(b, ["fn", "call"], "left").withColumn("bound", F.coalesce("bound", F.lit(False)))
        args = F.get(some, F.col("propagators"))
        flow = F.when(F.col("sources").isNotNull() | F.col("sanitizers").isNotNull(), "none").when(F.col("propagators").isNotNull(), F.when(args.isNull(), "all").otherwise("some")).when(F.col("bound") & ~F.coalesce("over_approx", F.lit(False)), "none").otherwise("all")
        return c.select("fn", "call", flow.alias("flow"), F.when(F.col("propagators").isNotNull(), args).alias("args"), "bound", F.coalesce("over_approx", F.lit(False)).alias("over_approx"), F.when(F.col("sinks").isNotNull(), F.get(taint_args, F.col("sinks"))).alias("sink_args"))

    def _returns(self) -> None:
        """values: fn, call, kind (P or O), of, label: what results of bound calls hold; of is the function where the origin is."""
        p = self.ports
        slots = self.bound.select("fn", "call", "target", F.posexplode("arg_to_param").alias("slot", "param")).union(self.bound.select("fn", "call", "target", F.lit(-1), "receiver_param")).where("param is not null")
        # Of several arguments for one parameter the first counts, the receiver before all.
        slots = slots.groupBy("fn", "call", "target", "param").agg(F.min("slot").alias("slot"))
        own = lambda df: df.select("*", F.when(F.col("kind") == "O", F.col("fn")).alias("of"))
        args = kept(own(p.where("port = 'arg'")).join(slots, ["fn", "call", "slot"]), "args")
        rets = own(p.where("port = 'return'"))
        r0, rc = rets.where("kind <> 'C'").select("fn", "kind", "of", "label"), rets.where("kind = 'C'").select("fn", F.col("label").alias("call"))
        a0, ac = args.where("kind <> 'C'").select("fn", "call", "target", "param", "kind", "of", "label"), args.where("kind = 'C'").select("fn", F.col("call").alias("at"), "target", "param", F.col("label").alias("call"))
        calls = self.bound.select("fn", "call", "target")
        # What calls hold follows from what their targets return, of their own or of parameters that arguments fill. In a round only what is new
        # is joined: new returns with all arguments, new arguments with the returns known before. Rounds end when nothing is new.
        key_r, key_a, key_v = ["fn", "kind", "of", "label"], ["fn", "call", "target", "param", "kind", "of", "label"], ["fn", "call", "kind", "of", "label"]

        def unseen(df: DataFrame, tables: list[DataFrame], key: list[str]) -> DataFrame:
            if not tables:
                return df
            old = kept_paths(tables).select(*[F.col(k).alias(f"old_{k}") for k in key])
            same = [F.col(k).eqNullSafe(F.col(f"old_{k}")) for k in key]
            return df.join(old, reduce(lambda x, y: x & y, same), "left_anti")

        new_r, new_a = kept(r0.distinct(), "returns"), kept(a0.distinct(), "args")
        all_r, all_a, all_v = [new_r], [new_a], []
        through = lambda df: df.where("kind = 'P'").select(F.col("fn").alias("target"), F.col("label").alias("param"))
        while True:
            out = calls.join(new_r.where("kind = 'O'").withColumnRenamed("fn", "target"), "target").select(*key_v)
            out = out.union(kept_paths(all_a).join(through(new_r), ["target", "param"]).select(*key_v))
            if len(all_r) > 1:
                out = out.union(new_a.join(through(kept_paths(all_r[:-1])), ["target", "param"]).select(*key_v))
            new_v, seen = watched(unseen(out.distinct(), all_v, key_v), "values", n=F.count("*"))
            all_v.append(new_v)
            if not seen["n"]:
                break
            new_r = kept(unseen(rc.join(new_v, ["fn", "call"]).select(*key_r).distinct(), all_r, key_r), "returns")
            new_a = kept(unseen(ac.join(new_v, ["fn", "call"]).select("fn", F.col("at").alias("call"), "target", "param", "kind", "of", "label").distinct(), all_a, key_a), "args")
            all_r.append(new_r)
            all_a.append(new_a)
        self.values, self.args, self.returns = kept_paths(all_v), kept_paths(all_a), kept_paths(all_r)

    def _opened(self, port: str) -> DataFrame:
        """Places of a kind, with results of calls replaced by what they hold."""
        p = self.ports.where(F.col("port") == port)
        direct = p.where("kind <> 'C'").select("fn", "call", "slot", "kind", F.when(F.col("kind") == "O", F.col("fn")).alias("of"), "label")
        through = p.where("kind = 'C'").select("fn", F.col("call").alias("at"), "slot", F.col("label").alias("call")).join(self.values, ["fn", "call"])
        return direct.union(through.select("fn", F.col("at").alias("call"), "slot", "kind", "of", "label")).distinct()

    def _guarded(self, calls: DataFrame) -> DataFrame:
        """calls with sid: the guards that hold there, as a mask."""
        g = self.functions.select("fn", F.explode("guards").alias("sid", "g")).select("fn", F.col("sid").cast("int").alias("sid"), self.masks.of(F.col("g")).alias("mask"))
        return calls.join(g, ["fn", "sid"], "left").withColumn("mask", F.coalesce("mask", self.masks.none()))

    def _risen(self) -> Column:
        """Whether a fact that was there before has risen: rounds end because guards, confidences and ways only fall."""
        return F.col("mask_was").isNotNull() & (self.masks.exceeds("mask", "mask_was") | (F.col("conf") > F.col("conf_was")) | (F.size("via") > F.col("way_was")))

    def _sinks(self) -> None:
        rules = self.rules.sinks
        pick = lambda k: F.get(F.array(*[F.lit(r[k]).cast("string") for r in rules] or [F.lit(None).cast("string")]), F.col("sinks"))
        layers = F.get(F.array(*[F.array(*[F.lit(x) for x in r["layers"]]) for r in rules] or [F.array().cast("array<string>")]), F.col("sinks"))
        name = self.functions.select("fn", F.col("name").alias("sink_function"))
        at = self._guarded(self.classified.where("sinks is not null")).join(name, "fn")
        spots = kept(at.select("fn", "call", F.struct(pick("id").alias("sink_id"), "file", "sink_function", F.col("start_line").alias("line"), pick("cwe").alias("cwe"), pick("severity").alias("severity"), layers.alias("layers")).alias("sink"), "mask", confidence_rank(pick("confidence"), 2).alias("conf")), "spots")
        met = kept(self._opened("sink").drop("slot").distinct().join(spots, ["fn", "call"]), "met")
        no_way = F.array().cast("array<string>")
        base = met.where("kind = 'P'").select("fn", F.col("label").alias("param"), "sink", "mask", "conf", no_way.alias("via"))
        # A call that passes data on: from a parameter of fn, or an origin, to a parameter of the target.
        passed = self.args.join(self._guarded(self.bound.select("fn", "call", "sid", "callee", "provenance")), ["fn", "call"])
        passed = kept(passed.select("fn", "target", F.col("param").alias("to"), "kind", "of", "label", "callee", "provenance", F.col("mask").alias("call_mask")), "passed")

        def lifted(s: DataFrame, by: DataFrame) -> DataFrame:
            j = by.join(s.select(F.col("fn").alias("target"), F.col("param").alias("to"), "sink", "mask", "conf", "via"), ["target", "to"])
            via = F.when(F.array_contains("via", F.col("callee")) | (F.size("via") >= LONGEST_WAY), F.col("via")).otherwise(F.array_prepend("via", F.col("callee")))
            conf = F.when(F.col("provenance") == "oracle", F.least("conf", F.lit(2))).otherwise(F.col("conf"))
            return j.select("fn", "kind", "of", "label", "sink", self.masks.both("mask", "call_mask").alias("mask"), conf.alias("conf"), via.alias("via"))

        def merged(df: DataFrame, *key: str, **more: Column) -> DataFrame:
            least = [self.masks.common("mask").alias("mask"), F.min("conf").alias("conf"), F.min(F.struct(F.size("via").alias("n"), "via"))["via"].alias("via")]
            return df.groupBy(*key).agg(*least, *[c.alias(k) for k, c in more.items()])

        # Only facts that are new or changed in a round are lifted in the next. Merging is monotone: guards become fewer, ways and confidences
        # smaller, so old and lifted facts merge to what all of them together would.
        key = ["fn", "param", "sink"]
        s, seen = watched(merged(base, *key), "lifts", fresh=F.count("*"))
        params, fresh, was = passed.where("kind = 'P'"), s, s.select(F.struct("mask", "conf", "via").alias("was")).schema["was"]
        while seen["fresh"]:
            # One merge of what was there, which says so, and what is lifted: no table is joined with itself.
            more = lifted(fresh, params).select("fn", F.col("label").alias("param"), "sink", "mask", "conf", "via", F.lit(None).cast(was.dataType).alias("was"))
            every = s.select(*key, "mask", "conf", "via", F.struct("mask", "conf", "via").alias("was")).unionByName(more)
            # What was there and has stayed the same is not fresh.
            now = merged(every, *key, was=F.first("was", ignorenulls=True)).withColumn("fresh", ~F.struct("mask", "conf", "via").eqNullSafe(F.col("was")))
            now = now.select("*", F.col("was.mask").alias("mask_was"), F.col("was.conf").alias("conf_was"), F.size("was.via").alias("way_was"))
            both, seen = watched(now.drop("was"), "lifts", fresh=F.sum(F.col("fresh").cast("int")), risen=F.sum(self._risen().cast("int")))
            if seen["risen"]:
                raise RuntimeError(f"{seen['risen']} facts have more guards, more confidence or a longer way than in the round before: rounds would not end")
            s, fresh = both.drop("fresh", "mask_was", "conf_was", "way_was"), both.where("fresh").drop("fresh", "mask_was", "conf_was", "way_was")
        self.sink_params = s
        direct = met.where("kind = 'O'").select("fn", "of", "label", "sink", "mask", "conf", no_way.alias("via"))
        far = lifted(s, passed.where("kind = 'O'")).select("fn", "of", "label", "sink", "mask", "conf", "via")
        every = direct.union(far)
        o = self.born.select(F.col("fn").alias("of"), F.col("origin").alias("label"), "source_id", F.col("layers").alias("source_layers"), F.col("confidence").alias("source_conf"), F.col("line").alias("source_line"))
        files = self.functions.select(F.col("fn").alias("of"), F.col("file").alias("source_file"))
        own = self.functions.select("fn", F.col("name").alias("function"), F.col("file").alias("fn_file"))
        e = every.join(o, ["of", "label"]).join(files, "of").join(own, "fn")
        cross = (F.col("sink.file") != F.col("fn_file")) | (F.size("via") > 0)
        trace = F.when(cross, collapse(F.concat(F.array("function"), "via", F.array("sink.sink_function")))).otherwise(no_way)
        rank = F.least(confidence_rank(F.col("source_conf"), 2), F.col("conf"))
        key = ["source_file", "function", "source_id", "source_line", "sink_id", "sink_line", "sink_file"]
        rest = F.struct(F.size("trace").alias("n"), "trace", "sink_function", "cwe", "severity", "layers", "rank")
        flat = e.select("source_file", "function", "source_id", "source_line", "sink.sink_id", F.col("sink.line").alias("sink_line"), F.col("sink.file").alias("sink_file"), "sink.sink_function", "sink.cwe", "sink.severity",
                        F.array_sort(F.array_union("source_layers", "sink.layers")).alias("layers"), rank.alias("rank"), trace.alias("trace"), "mask")
        one = flat.groupBy(*key).agg(self.masks.common("mask").alias("mask"), F.min(rest).alias("r"))
        guards = self.masks.names("mask")
        self.findings = kept(
            one.select(*key, "r.sink_function", "r.cwe", "r.severity", "r.layers", name_of(CONFIDENCES, F.col("r.rank")).alias("confidence"), "r.trace", guards.alias("guards"), (F.size(guards) == 0).alias("unguarded")), "findings"
        )
        self.tainted = self._opened("site").select("fn", "call").distinct()


def unguarded(findings: DataFrame) -> DataFrame:
    return findings.where(F.size("guards") == 0)
