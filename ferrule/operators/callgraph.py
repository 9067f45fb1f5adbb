"""What each call is: index tables of a project's names, the classification of call sites and their bindings, and ratios over them."""

from __future__ import annotations

import builtins

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.operators.lowering import facts
from ferrule.plans.state import kept
from ferrule.sources.rules import Rules

#: Names that count as the language's own, functions and exceptions.
BUILTINS = (
    "int float str bytes bool len print range list dict set tuple repr format open isinstance getattr setattr super enumerate zip map filter sorted min max sum abs type hasattr hash id iter next "
    "vars dir callable bytearray frozenset complex slice object property classmethod staticmethod reversed all any round divmod pow chr ord bin hex oct input globals locals exit quit "
    "Exception BaseException RuntimeError ValueError TypeError KeyError IndexError AttributeError StopIteration FileNotFoundError OSError IOError ImportError NotImplementedError AssertionError "
    "PermissionError ConnectionError TimeoutError LookupError ArithmeticError ZeroDivisionError UnicodeDecodeError NameError OverflowError"
).split()
assert all(hasattr(builtins, b) or b in ("exit", "quit") for b in BUILTINS)
RESOLVED = ("rule", "builtin", "bound", "bound-import", "bound-local", "bound-oracle", "external")


def top(fqn: Column) -> Column:
    return F.split(fqn, r"\.", 2)[0]


def first_by(df: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.min_by(value, F.struct(*order)).alias(value))


class Index:
    """Names of a project: functions by full name, methods by class, classes, module objects and what they were made by, packages."""

    def __init__(self, lowered: DataFrame):
        # Written, since all that follows asks for them: a function's JSON is read once.
        self.functions = kept(facts(lowered, "function").drop("graph"), "functions")
        f = self.functions
        self.tops = facts(lowered, "module").select(top("name").alias("top")).distinct()
        self.classes = first_by(facts(lowered, "class"), ["fqn"], "bases", ["file"])
        plain = f.where("enclosing_class is null and not nested").select(F.concat_ws(".", "module", "name").alias("fqn"), "fn", "file", "line")
        self.by_fqn = first_by(plain, ["fqn"], "fn", ["file", "line"])
        methods = f.where("enclosing_class is not null").select(F.concat_ws(".", "module", "enclosing_class").alias("class"), "name", "fn", "file", "line")
        self.methods = first_by(methods, ["class", "name"], "fn", ["file", "line"]).join(self.classes.select(F.col("fqn").alias("class")), "class", "left_semi")
        made = facts(lowered, "global").groupBy("fqn").agg(F.min_by(F.struct("callee"), "file").alias("callee")).select("fqn", "callee.callee")
        self.globals = kept(self._chased(made), "globals")

    def _chased(self, made: DataFrame) -> DataFrame:
        """fqn, made_by: what an object was made by, through objects that were made by objects; null in a circle. Doubles its reach each round."""
        known = self.classes.select(F.col("fqn").alias("k"))
        objects = made.join(known, made.fqn == known.k, "left_anti")
        g = kept(objects.select("fqn", F.col("callee").alias("made_by")), "chase")
        for _ in range(32):
            nexts = g.select(F.col("fqn").alias("at"), F.struct("made_by").alias("then"))
            j = g.join(nexts, g.made_by == nexts["at"], "left")
            if not j.where(F.col("at").isNotNull()).limit(1).count():
                return g
            step = j.select("fqn", F.when(F.col("then").isNotNull(), F.col("then.made_by")).otherwise(F.col("made_by")).alias("made_by"))
            # A name that meets itself is in a circle.
            g = kept(step.withColumn("made_by", F.when(F.col("made_by") != F.col("fqn"), F.col("made_by"))), "chase")
        return g.join(g.select(F.col("fqn").alias("x")), F.col("made_by") == F.col("x"), "left").select("fqn", F.when(F.col("x").isNull(), F.col("made_by")).alias("made_by"))

    def origins(self, names: DataFrame) -> DataFrame:
        """names: fqn. fqn, origin (class, project-fn, external, unknown), class."""
        n = names.select("fqn").distinct()
        g = self.globals.select(F.col("fqn").alias("g"), "made_by")
        cls = self.classes.select(F.col("fqn").alias("c"))
        own = n.join(cls, n.fqn == cls.c, "left").join(g, n.fqn == g.g, "left")
        real = F.when(F.col("c").isNotNull() | F.col("g").isNull(), F.col("fqn")).otherwise(F.col("made_by"))
        own = own.select("fqn", real.alias("real"))
        cls, fns, tops = self.classes.select(F.col("fqn").alias("c")), self.by_fqn.select(F.col("fqn").alias("f")), self.tops.select(F.col("top").alias("t"))
        own = own.join(cls, own.real == cls.c, "left").join(fns, own.real == fns.f, "left").join(tops, top(own.real) == tops.t, "left")
        origin = F.when(F.col("real").isNull(), "unknown").when(F.col("c").isNotNull(), "class").when(F.col("f").isNotNull(), "project-fn").when(F.col("t").isNull(), "external").otherwise("unknown")
        return own.select("fqn", origin.alias("origin"), F.col("c").alias("class"))

    def library_classes(self) -> DataFrame:
        """class: those that have a library's class among their ancestors."""
        bases = self.classes.select(F.col("fqn").alias("class"), F.explode("bases").alias("base"))
        inner = bases.join(self.classes.select(F.col("fqn").alias("base")), "base", "left_semi")
        outer = bases.join(self.classes.select(F.col("fqn").alias("base")), "base", "left_anti")
        names = F.split("base", r"\.")
        prefixes = outer.select("class", "base", F.explode(F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, 1, i), "."))).alias("fqn"))
        objects = prefixes.join(self.globals.select("fqn"), "fqn", "left_semi")
        longest = objects.groupBy("class", "base").agg(F.max_by("fqn", F.char_length("fqn")).alias("fqn"))
        by_object = longest.join(self.origins(longest).select("fqn", "origin"), "fqn").where("origin = 'external'").select("class")
        tops = self.tops.select(F.col("top").alias("t"))
        foreign = outer.join(tops, top(F.col("base")) == tops.t, "left_anti").select("class")
        found = kept(by_object.union(foreign).distinct(), "library")
        n = found.count()
        while True:
            below = inner.join(found.select(F.col("class").alias("base")), "base").select("class")
            found = kept(found.union(below).distinct(), "library")
            n, before = found.count(), n
            if n == before:
                return found


def rule_column(rules: Rules, kind: str, method: Column, fqn: Column) -> Column:
    """Position of the first rule of the kind that matches a call, or null: `.name` entries match any receiver, others the full name."""
    by: dict[str, dict[str, int]] = {"method": {}, "fqn": {}}
    for i, r in enumerate(getattr(rules, kind)):
        if r["kind"] == "call":
            for c in r["callee"]:
                by["method" if c.startswith(".") else "fqn"].setdefault(c.removeprefix("."), i)

    def get(names: dict[str, int], x: Column) -> Column:
        return F.element_at(F.create_map(*[y for k, v in names.items() for y in (F.lit(k), F.lit(v))]), x) if names else F.lit(None).cast("int")

    return F.least(get(by["method"], method) if kind != "sources" else F.lit(None).cast("int"), get(by["fqn"], fqn))


def classify(lowered: DataFrame, rules: Rules, index: Index | None = None, oracle: DataFrame | None = None) -> DataFrame:
    """Every call with its category and, if it is bound, target, kind and provenance.

    oracle: fn, target: functions that another tool saw fn call; of those with the method's name a single one is bound.
    """
    x = index or Index(lowered)
    c = facts(lowered, "call")
    for kind in ("sources", "sinks", "sanitizers", "propagators"):
        c = c.withColumn(kind, rule_column(rules, kind, F.col("method"), F.col("fqn")))
    key = ["fn", "call"]

    # Names that calls lead to, as functions, classes and packages.
    reach = F.when(F.col("shape") == "name", F.coalesce("imported", "local_fqn")).when((F.col("shape") == "attr") & F.col("base_imported"), F.col("fqn"))
    fns, cls, tops = x.by_fqn.select(F.col("fqn").alias("f_fqn"), F.col("fn").alias("f_fn")), x.classes.select(F.col("fqn").alias("c_fqn")), x.tops.select(F.col("top").alias("t"))
    init = x.methods.where("name = '__init__'").select(F.col("class").alias("i_class"), F.col("fn").alias("init"))
    c = c.withColumn("goal", reach)
    c = c.join(fns, c.goal == fns.f_fqn, "left").join(cls, c.goal == cls.c_fqn, "left").join(init, c.goal == init.i_class, "left").join(tops, top(c.goal) == tops.t, "left")
    c = kept(c.select("*", F.col("t").isNull().alias("foreign")).drop("f_fqn", "i_class", "t"), "calls")

    # Origins of receivers.
    attr = c.where("shape = 'attr' and base is not null")
    typed = attr.where("has_type").select(*key, F.explode("typed").alias("j")).select(*key, F.get_json_object("j", "$[0]").alias("callee"), F.get_json_object("j", "$[1]").alias("same"))
    annotated = attr.where("annotation is not null").select(*key, F.ltrim("annotation", F.lit("=")).alias("fqn"), F.startswith("annotation", F.lit("=")).alias("own"))
    made = attr.where("global_fqn is not null").select(*key, F.col("global_fqn").alias("fqn"))
    brought = attr.where("import_fqn is not null").select(*key, F.col("import_fqn").alias("fqn"))
    names = typed.select(F.col("callee").alias("fqn")).union(annotated.select("fqn")).union(made.select("fqn")).union(brought.select("fqn")).where("fqn is not null")
    origins = kept(x.origins(names), "origins")
    named = lambda df, col: df.join(origins.select(F.col("fqn").alias(col), "origin", "class"), col, "left")
    t = named(typed, "callee").join(x.classes.select(F.col("fqn").alias("same"), F.lit(True).alias("is_class")), "same", "left")
    mine = (F.coalesce(F.col("origin"), F.lit("unknown")) == "external") & F.coalesce("is_class", F.lit(False))
    t = t.select(*key, F.struct(F.when(mine, "class").otherwise(F.coalesce("origin", F.lit("unknown"))).alias("origin"), F.when(mine, F.col("same")).otherwise(F.col("class")).alias("class")).alias("o"))
    t = t.groupBy(*key).agg(F.min("o").alias("o_type"), F.max("o").alias("o_max")).where("o_type <=> o_max").drop("o_max")
    pack = lambda name: F.struct("origin", "class").alias(name)
    a = named(annotated, "fqn").where("(not own and origin <> 'unknown') or origin = 'class'").select(*key, pack("o_annotation"))
    m, b = named(made, "fqn").select(*key, pack("o_global")), named(brought, "fqn").select(*key, pack("o_import"))
    own_class = x.classes.select(F.col("fqn").alias("self_class"), F.lit(True).alias("self_known"))
    c = c.join(t, key, "left").join(a, key, "left").join(m, key, "left").join(b, key, "left").join(own_class, "self_class", "left")
    nothing = F.struct(F.lit("unknown").alias("origin"), F.lit(None).cast("string").alias("class"))
    self_origin = F.when(F.col("self_class").isNotNull(), F.when(F.col("self_known"), F.struct(F.lit("class").alias("origin"), F.col("self_class").alias("class"))).otherwise(nothing))
    c = c.withColumn("receiver", F.coalesce(self_origin, "o_type", "o_annotation", "o_global", "o_import", nothing))
    of = x.methods.select(F.col("class").alias("m_class"), F.col("name").alias("m_name"), F.col("fn").alias("m_fn"))
    c = c.join(of, (F.col("receiver.class") == F.col("m_class")) & (F.col("method") == F.col("m_name")) & (F.col("receiver.origin") == "class"), "left")
    lib = x.library_classes().select(F.col("class").alias("l_class"))
    c = c.join(lib, F.col("receiver.class") == F.col("l_class"), "left")
    if oracle is not None:
        one = c.where("shape = 'attr'").select(*key, "method").join(oracle.select("fn", F.col("target").alias("o_fn")).distinct(), "fn")
        one = one.join(x.functions.select(F.col("fn").alias("o_fn"), F.col("name").alias("method"), F.col("enclosing_class").alias("o_class")), ["o_fn", "method"])
        one = one.groupBy(*key).agg(F.count("*").alias("n"), F.min("o_fn").alias("o_fn"), F.min("o_class").alias("o_class")).where("n = 1").drop("n")
        c = c.join(one, key, "left")
    else:
        c = c.withColumn("o_fn", F.lit(None).cast("string")).withColumn("o_class", F.lit(None).cast("string"))

    ruled = F.coalesce("sources", "sinks", "sanitizers", "propagators").isNotNull()
    outcome = lambda category, target=None, kind=None, by=None: F.struct(F.lit(category).alias("category"), (F.lit(None).cast("string") if target is None else target).alias("target"), F.lit(kind).cast("string").alias("kind"), F.lit(by).cast("string").alias("provenance"))
    is_name, is_attr, f_fn = F.col("shape") == "name", F.col("shape") == "attr", F.col("f_fn").isNotNull()
    imported = F.col("imported").isNotNull()
    brought_in = is_attr & F.col("base_imported")
    origin = F.col("receiver.origin")
    kind = F.when(F.col("o_class").isNotNull(), "method").otherwise("function")
    out = (
        F.when(ruled, outcome("rule"))
        .when(is_name & F.col("is_local"), outcome("unknown-receiver"))
        .when(is_name & imported & f_fn, outcome("bound-import", F.col("f_fn"), "function", "import"))
        .when(is_name & imported & F.col("c_fqn").isNotNull(), outcome("bound", F.col("init"), "constructor", "import"))
        .when(is_name & imported & F.col("foreign"), outcome("external"))
        .when(is_name & imported, outcome("unresolved-project"))
        .when(is_name & f_fn, outcome("bound-local", F.col("f_fn"), "function", "local"))
        .when(is_name & F.col("c_fqn").isNotNull(), outcome("bound", F.col("init"), "constructor", "local"))
        .when(is_name & F.col("ident").isin(*BUILTINS), outcome("builtin"))
        .when(is_name, outcome("unresolved-project"))
        .when(brought_in & f_fn, outcome("bound-import", F.col("f_fn"), "function", "import"))
        .when(brought_in & F.col("c_fqn").isNotNull(), outcome("bound", F.col("init"), "constructor", "import"))
        .when(brought_in & F.col("foreign"), outcome("external"))
        .when(is_attr & origin.isin("external", "project-fn"), outcome("external"))
        .when(is_attr & (origin == "class") & F.col("m_fn").isNotNull(), outcome("bound", F.col("m_fn"), "method", "method-recv"))
        .when(is_attr & (origin == "class") & F.col("l_class").isNotNull(), outcome("external"))
        .when(is_attr & (origin == "class"), outcome("unresolved-project"))
        .when(is_attr & F.col("o_fn").isNotNull(), F.struct(F.lit("bound-oracle").alias("category"), F.col("o_fn").alias("target"), kind.alias("kind"), F.lit("oracle").alias("provenance")))
        .otherwise(outcome("unknown-receiver"))
    )
    cols = ["fn", "file", "call", "sid", "start_line", "start_col", "end_line", "end_col", "shape", "method", "n_args", "kw_names", "sources", "sinks", "sanitizers", "propagators"]
    return kept(c.withColumn("r", out).select(*cols, "r.*"), "classified")


def bindings(classified: DataFrame, functions: DataFrame) -> DataFrame:
    """Bound calls with the parameter of each argument: receiver_param, arg_to_param, over_approx (the summary alone would lose data)."""
    f = functions.select(F.col("fn").alias("target"), F.col("name").alias("callee"), "params", "field_escape")
    b = classified.where("target is not null").join(f, "target")
    own = F.col("kind").isin("method", "constructor") & F.coalesce(F.get("params", F.lit(0)).isin("self", "cls"), F.lit(False))
    b = b.withColumn("offset", own.cast("int"))
    names, params = F.col("kw_names"), F.col("params")

    def param(k: Column, i: Column) -> Column:
        place = F.col("offset") + F.size(F.filter(names, lambda n, j: n.isNull() & (j < i)))
        by_name = F.array_position(params, k).cast("int") - 1
        return F.when(k.isNotNull(), F.when(by_name >= 0, by_name)).when(place < F.size(params), place)

    mapped = F.transform(names, param)
    over = (F.col("kind") == "constructor") | ((F.col("kind") == "method") & F.col("field_escape"))
    return b.select("fn", "call", "sid", "target", "callee", "kind", "provenance", mapped.alias("arg_to_param"), F.when(own, F.lit(0)).alias("receiver_param"), over.alias("over_approx"))


def binding_rate(classified: DataFrame) -> DataFrame:
    """One row: counts, PCR = bound / (bound + unresolved-project) and UNK = unknown-receiver / method calls; calls bound by an oracle are neither."""
    n = lambda *names: F.count_if(F.col("category").isin(*names))
    r = classified.agg(
        F.count("*").alias("total"), n("bound", "bound-import", "bound-local").alias("bound"), n("bound-oracle").alias("bound_oracle"), n("unresolved-project").alias("unresolved_project"),
        n("unknown-receiver").alias("unknown_receiver"), F.count_if(F.col("shape") == "attr").alias("method_sites"),
    )
    ratio = lambda a, b, none: F.when(b == 0, F.lit(none)).otherwise(a / b)
    return r.select("*", ratio(r.bound, r.bound + r.unresolved_project, 1.0).alias("PCR"), ratio(r.unknown_receiver, r.method_sites, 0.0).alias("UNK"))


def category_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("category").agg(F.count("*").alias("n"))


def taint_relevant_resolution(classified: DataFrame, tainted: DataFrame) -> DataFrame:
    """tainted: fn, call. Of the calls that tainted data meets, the share whose callee is known."""
    r = classified.join(tainted.select("fn", "call").distinct(), ["fn", "call"], "left_semi")
    r = r.agg(F.count("*").alias("tainted_sites"), F.count_if(F.col("category").isin(*RESOLVED)).alias("resolved"))
    return r.select("*", F.when(r.tainted_sites == 0, F.lit(1.0)).otherwise(r.resolved / r.tainted_sites).alias("TRR"))
