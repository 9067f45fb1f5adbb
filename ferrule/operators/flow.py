"""Flow over control-flow graphs as relations: reaching definitions, dominators, and what is proved on every way.

All three ask which facts arrive at a node on some way that nothing on it stops. A function's facts are numbered, and a node's facts are bits of
longs: rows (fn, at, word, bits). Taking a step is a join and an `and not`, meeting is `bit_or` (summed before the shuffle), and what is new is a difference of
bits, so only new bits go on. A function's size bounds no task: its rows are dealt by node and word.

Straight ways are taken by doubling: a node with a single step onward has jumps of 1, 2, 4, ... steps, each with all that it stops. From the largest
jump to the smallest every place on such a way is met in as many joins as its length has binary digits, and one more step is
taken only where ways part. Rounds grow with the partings on a way, not with its length.

What a round costs grows with all facts known so far, which it is held against. So nodes that no step leads to are taken off first, again and again as long as that takes a fair share of the
steps: such a node's facts are complete, take its steps once, and are never looked at again. Rounds are left with what lies on circles and behind them, and with long ways.

Rounds shuffle all facts each time, so functions of at most SMALL rows, which are as a rule nearly all, are left to tasks that hold one such function at a time.

steps: fn, src, dst; of any types, alike in all tables of a call. Repeated rows count once; rows with a null take no part.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ferrule.plans.state import discard, kept, kept_paths, watched

FACT = ["fn", "at", "word"]
#: Steps, starts and stops of a function that one task takes at once.
SMALL = 1024
#: The facts of a word are spread over this many tasks where they are listed.
SALTS = 8


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with word and bit, numbers that are dense within a function, written."""
    n = df.distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id())
    return kept(n.withColumn("word", F.shiftright("_n", 6)).withColumn("bit", F.expr("shiftleft(1L, CAST(_n & 63 AS INT))")).drop("_n"), "bits")


def _met(facts: DataFrame) -> DataFrame:
    return facts.groupBy(*FACT).agg(F.bit_or("bits").alias("bits"))


def _without(bits: str, mask: str) -> Column:
    return F.col(bits).bitwiseAND(F.bitwise_not(F.coalesce(mask, F.lit(0).cast("long"))))


def _taken(facts: DataFrame, steps: DataFrame, stops: DataFrame) -> DataFrame:
    """The facts after a step each. stops: fn, src, dst, word, mask."""
    j = facts.withColumnRenamed("at", "src").join(steps, ["fn", "src"]).join(stops, ["fn", "src", "dst", "word"], "left")
    return j.select("fn", F.col("dst").alias("at"), "word", _without("bits", "mask").alias("bits")).where("bits <> 0")


def _jumps(steps: DataFrame, stops: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Jumps of 1, 2, 4, ... steps from nodes with a single step onward, with what they stop."""
    only = steps.groupBy("fn", "src").agg(F.count("*").alias("n"), F.min("dst").alias("dst")).where("n = 1").drop("n")
    most = steps.groupBy("fn").count().agg(F.max("count")).first()[0] or 0
    out: list[tuple[DataFrame, DataFrame]] = []
    jump, seen = watched(only, "jumps", n=F.count("*"))
    stop = kept(stops.join(jump, ["fn", "src", "dst"], "left_semi"), "stops")
    while seen["n"]:
        out.append((jump, stop))
        if 1 << len(out) > most:  # straight ways in a circle have no end
            break
        two = jump.join(jump.select("fn", F.col("src").alias("dst"), F.col("dst").alias("end")), ["fn", "dst"])
        both = two.select("fn", "src", F.col("dst").alias("mid"), F.col("end").alias("dst"))
        jump, seen = watched(both.drop("mid"), "jumps", n=F.count("*"))
        first = stop.select("fn", "src", F.col("dst").alias("mid"), "word", "mask")
        second = stop.select("fn", F.col("src").alias("mid"), F.col("dst"), "word", "mask")
        stop = kept(both.join(first, ["fn", "src", "mid"]).select("fn", "src", "dst", "word", "mask").union(both.join(second, ["fn", "mid", "dst"]).select("fn", "src", "dst", "word", "mask")).groupBy("fn", "src", "dst", "word").agg(F.bit_or("mask").alias("mask")), "stops")
    return out


def arriving(steps: DataFrame, start: DataFrame, stops: DataFrame) -> DataFrame:
    """fn, at, word, bits: all facts that arrive at a node, written. start: the same columns, what is there before any step. stops: fn, src, dst, word, mask of each step."""
    steps = kept(steps.select("fn", "src", "dst").dropna().distinct(), "steps")
    stops = kept(stops.join(steps, ["fn", "src", "dst"], "left_semi").groupBy("fn", "src", "dst", "word").agg(F.bit_or("mask").alias("mask")), "stops")
    start = kept(_met(start), "start")
    of = [x.groupBy("fn").agg(F.count("*").alias("n")) for x in (steps, start, stops)]
    every = of[0].union(of[1]).union(of[2]).groupBy("fn").agg(F.sum("n").alias("n"))
    small = F.col("n") <= SMALL
    sizes, seen = watched(every, "sizes", small=F.count(F.when(small, 1)), large=F.count(F.when(~small, 1)))
    some = lambda which: [x.join(sizes.where(which).select("fn"), "fn", "left_semi") if seen["small"] and seen["large"] else x for x in (steps, start, stops)]
    out = []
    if seen["small"]:
        out.append(kept(_by_function(*some(small)), "small"))
    if seen["large"] or not out:
        out.append(_in_rounds(*some(~small)))
    discard(steps, start, stops, sizes)
    return out[0] if len(out) == 1 else out[0].union(out[1])


def _by_function(steps: DataFrame, start: DataFrame, stops: DataFrame) -> DataFrame:
    """As arriving(), function by function. Steps are rows without a word, starts rows without a src."""
    none = F.lit(None)
    one = steps.select("fn", "src", "dst", none.cast("long").alias("word"), none.cast("long").alias("bits"))
    rows = one.union(start.select("fn", none.cast(steps.schema["src"].dataType).alias("src"), F.col("at").alias("dst"), "word", "bits")).union(stops.select("fn", "src", "dst", "word", "mask"))
    schema = StructType([StructField("fn", steps.schema["fn"].dataType), StructField("at", rows.schema["dst"].dataType), StructField("word", LongType()), StructField("bits", LongType())])
    return rows.groupBy("fn").applyInArrow(_followed, schema)


def _followed(rows: pa.Table) -> pa.Table:
    """All words of a node's facts are one number here."""
    number = {w: i * 64 for i, w in enumerate(sorted({w for w in rows["word"].to_pylist() if w is not None}))}
    onward, stopped, facts = {}, {}, {}
    for src, dst, word, bits in zip(*(rows[c].to_pylist() for c in ("src", "dst", "word", "bits"))):
        if word is None:
            onward.setdefault(src, []).append(dst)
            continue
        of, key = (facts, dst) if src is None else (stopped, (src, dst))
        of[key] = of.get(key, 0) | (bits & (1 << 64) - 1) << number[word]
    todo = dict.fromkeys(facts)  # in order, each node once
    while todo:
        src = next(iter(todo))
        del todo[src]
        for dst in onward.get(src, ()):
            known = facts.get(dst, 0)
            if more := facts[src] & ~stopped.get((src, dst), 0) & ~known:
                facts[dst] = known | more
                todo[dst] = None
    found = [(at, word, bits) for at, x in facts.items() for word, i in number.items() if (bits := x >> i & (1 << 64) - 1)]
    ats, words, bits = zip(*found) if found else ((), (), ())
    fn = rows["fn"][0].as_py() if len(rows) else None
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    return pa.table([pa.array([fn] * len(ats), rows.schema.field("fn").type), pa.array(ats, rows.schema.field("dst").type), pa.array(words, pa.int64()), pa.array(signed, pa.int64())], names=["fn", "at", "word", "bits"])


def _in_rounds(steps: DataFrame, start: DataFrame, stops: DataFrame) -> DataFrame:
    """As arriving(), for functions of any size."""
    done, steps, start = _from_the_front(steps, start, stops)
    known = _rounds(steps, start, stops) if steps is not None else None
    if not done:
        return known
    out = kept_paths(done).where("due").select(*FACT, "bits")
    return out if known is None else out.unionByName(known)


def _from_the_front(steps: DataFrame, start: DataFrame, stops: DataFrame) -> tuple[list[DataFrame], DataFrame | None, DataFrame | None]:
    """Takes nodes off that no step leads to, with their steps, as long as that is a quarter of the steps each time. Tables of facts that are complete where they are `due` (their other
    rows stand in the next table as well), the steps left and what is there before any of them; None if no steps are left.
    """
    n, done, over = steps.count(), [], []
    while n:
        led = steps.select("fn", F.col("dst").alias("src")).distinct()
        inner, seen = watched(steps.join(led, ["fn", "src"], "left_semi").select("fn", "src", "dst"), "inner", n=F.count("*"))
        if (n - seen["n"]) * 4 < n:
            discard(inner)
            return done, steps, start
        due = start.join(led.select("fn", F.col("src").alias("at"), F.lit(False).alias("due")), ["fn", "at"], "left")
        facts = kept(due.select(*FACT, "bits", F.coalesce("due", F.lit(True)).alias("due")), "fronts")
        done.append(facts)
        discard(*over)
        sent = _taken(facts.where("due").select(*FACT, "bits"), steps, stops)
        start = _met(facts.where("NOT due").select(*FACT, "bits").union(sent))
        over = [steps] if len(done) > 1 else []  # the first is the caller's
        steps, n = inner, seen["n"]
    if not done:
        return done, steps, start
    done.append(kept(start.withColumn("due", F.lit(True)), "fronts"))
    discard(*over, steps)
    return done, None, None


def _rounds(steps: DataFrame, start: DataFrame, stops: DataFrame) -> DataFrame:
    """As arriving(): all facts step on at once, and what is new goes on, until nothing is."""
    jumps = _jumps(steps, stops)
    parting = kept(steps.join(jumps[0][0].select("fn", "src"), ["fn", "src"], "left_anti") if jumps else steps, "parting")
    fresh, seen = watched(start, "facts", n=F.count("*"))
    known = None
    while True:
        levels = jumps[::-1] if seen["n"] else []
        for two in (levels[i : i + 2] for i in range(0, len(levels), 2)):  # two in a write: more would read the facts too often
            before = fresh
            for jump, stop in two:
                fresh = _met(fresh.union(_taken(fresh, jump, stop)))
            fresh = kept(fresh, "facts")
            discard(before)
        if known is None:
            merged = fresh.withColumn("new", F.col("bits"))
        else:
            merged = known.select(*FACT, F.col("bits").alias("old")).join(fresh.select(*FACT, F.col("bits").alias("more")), FACT, "full")
            both = F.coalesce("old", F.lit(0).cast("long")).bitwiseOR(F.coalesce("more", F.lit(0).cast("long")))
            merged = merged.select(*FACT, both.alias("bits"), _without("more", "old").alias("new"))
        now = kept(merged, "known")
        if known is not None:
            discard(known)
        known = now
        more = _met(_taken(now.where("new <> 0").select(*FACT, F.col("new").alias("bits")), parting, stops)).withColumnRenamed("bits", "more")
        more = more.join(now.select(*FACT, "bits"), FACT, "left").select(*FACT, _without("more", "bits").alias("bits")).where("bits <> 0")
        before, (fresh, seen) = fresh, watched(more, "facts", n=F.count("*"))
        discard(before)
        if not seen["n"]:
            discard(fresh, parting, *(x for level in jumps for x in level))
            return known.select(*FACT, "bits")


def _listed(facts: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """fn, at, word, bit: a row for each bit. With of (fn, word, bit and more, a row for each bit) the rows that bits stand for, without word and bit: facts meet all rows of a word (64 at most) at once,
    so that facts are shuffled and not what they are listed as; those of a word are spread over a few tasks.
    """
    if of is None:
        return facts.select(*FACT, F.explode(F.expr("filter(transform(sequence(0, 63), i -> bits & shiftleft(1L, i)), b -> b <> 0)")).alias("bit"))
    more = [k for k in of.columns if k not in ("fn", "word", "bit")]
    salts = F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)]))
    words = of.groupBy("fn", "word").agg(F.collect_list(F.struct("bit", *more)).alias("of")).withColumn("salt", salts)
    met = facts.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(SALTS))).join(words, ["fn", "word", "salt"])
    return met.select("fn", "at", "bits", F.explode("of").alias("of")).where(F.col("bits").bitwiseAND(F.col("of.bit")) != 0).select("fn", "at", *[F.col(f"of.{k}") for k in more])


def reaching_definitions(steps: DataFrame, defs: DataFrame) -> DataFrame:
    """fn, var, site, at: the definition of var at site arrives at `at` on some way on which no other node defines var again. defs: fn, var, site."""
    d = _numbered(defs.select("fn", "var", "site").dropna(), "fn", "var", "site")
    of_var = d.groupBy("fn", "var", "word").agg(F.bit_or("bit").alias("mask"))
    stops = steps.join(d.select("fn", "var", F.col("site").alias("src")), ["fn", "src"]).join(of_var, ["fn", "var"]).select("fn", "src", "dst", "word", "mask")
    start = steps.join(d.withColumnRenamed("site", "src"), ["fn", "src"]).select("fn", F.col("dst").alias("at"), "word", F.col("bit").alias("bits"))
    return _listed(arriving(steps, start, stops)).join(d, ["fn", "word", "bit"]).select("fn", "var", "site", "at")


def _lacking(facts: DataFrame, d: DataFrame, reached: DataFrame) -> DataFrame:
    """fn, at, word, bits: which of the numbered d do not arrive at the reached (fn, at)."""
    words = d.groupBy("fn", "word").agg(F.bit_or("bit").alias("mask"))
    return reached.join(words, "fn").join(facts, FACT, "left").select(*FACT, _without("mask", "bits").alias("bits")).where("bits <> 0")


def _passed(steps: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The numbered nodes (fn, node, word, bit), and as bits those that every way from the entry to a node passes before it (fn, at, word, bits).

    A node's name is a fact that is at hand in the entry and stopped where the node is left, so what does not arrive was on every way.
    """
    entries = entries.select("fn", "node").dropna().distinct()
    nodes = steps.select("fn", F.col("src").alias("node")).union(steps.select("fn", "dst")).union(entries).dropna()
    d = _numbered(nodes, "fn", "node")
    start = entries.withColumnRenamed("node", "at").join(d, "fn").select("fn", "at", "word", F.col("bit").alias("bits"))
    stops = steps.join(d.withColumnRenamed("node", "src"), ["fn", "src"]).select("fn", "src", "dst", "word", F.col("bit").alias("mask"))
    facts = arriving(steps, start, stops)
    return d, _lacking(facts, d, facts.select("fn", "at").distinct())


def dominators(steps: DataFrame, entries: DataFrame) -> DataFrame:
    """fn, node, dom: every way from the entry (fn, node) to the node passes dom, another node. Nodes without a way have no rows."""
    d, rest = _passed(steps, entries)
    out = _listed(rest).join(d.withColumnRenamed("node", "dom"), ["fn", "word", "bit"])
    return out.select("fn", F.col("at").alias("node"), "dom")


def immediate_dominators(steps: DataFrame, entries: DataFrame) -> DataFrame:
    """immediate(dominators(steps, entries)) without their pairs: what dominates a node is its immediate dominator and what dominates that one. So the two have equal sets, and sets are
    told apart by their size and 128 bits of their words.
    """
    d, rest = _passed(steps, entries)
    none = F.lit(0).cast("long")
    both = rest.select(*FACT, "bits", none.alias("own")).union(d.select("fn", "node", "word", none, "bit"))
    both = both.groupBy(*FACT).agg(F.bit_or("bits").alias("bits"), F.bit_or("own").alias("own")).withColumn("all", F.col("bits").bitwiseOR(F.col("own")))
    mark = lambda x: [F.sum(F.bit_count(x)).alias(f"n_{x}"), *[F.bit_xor(F.when(F.col(x) != 0, F.xxhash64("word", x, F.lit(i)))).alias(f"h{i}_{x}") for i in (1, 2)]]
    sets = kept(both.groupBy("fn", "at").agg(*mark("bits"), *mark("all")), "sets")
    above = sets.select("fn", F.col("at").alias("idom"), *[F.col(f"{c}_all").alias(f"{c}_bits") for c in ("n", "h1", "h2")])
    return sets.where("n_bits > 0").join(above, ["fn", "n_bits", "h1_bits", "h2_bits"]).select("fn", F.col("at").alias("node"), "idom", F.col("n_bits").alias("depth"))


def immediate(doms: DataFrame) -> DataFrame:
    """fn, node, idom, depth of all nodes that have dominators (fn, node, dom): the dominator that has most itself, and how many there are."""
    depth = doms.groupBy("fn", F.col("node").alias("dom")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return doms.join(depth, ["fn", "dom"], "left").groupBy("fn", "node").agg(F.max_by("dom", n).alias("idom"), F.count("*").alias("depth"))


def proved(steps: DataFrame, entries: DataFrame, proofs: DataFrame) -> DataFrame:
    """fn, node, guard: every way from the entry (fn, node) to the node takes a step that proves the guard. proofs: fn, src, dst, guard."""
    entries = entries.select("fn", "node").dropna().distinct()
    p = proofs.select("fn", "src", "dst", "guard").dropna().distinct()
    # Beside the guards a fact that nothing stops: where it arrives there is a way.
    d = _numbered(p.select("fn", "guard").union(entries.select("fn", F.lit(None).cast(p.schema["guard"].dataType))), "fn", "guard")
    start = entries.withColumnRenamed("node", "at").join(d, "fn").select("fn", "at", "word", F.col("bit").alias("bits"))
    facts = arriving(steps, start, p.join(d, ["fn", "guard"]).select("fn", "src", "dst", "word", F.col("bit").alias("mask")))
    out = _listed(_lacking(facts, d, facts.select("fn", "at").distinct())).join(d, ["fn", "word", "bit"])
    return out.select("fn", F.col("at").alias("node"), "guard")
