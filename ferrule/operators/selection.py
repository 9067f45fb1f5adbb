"""Exact medians and other ranks of every group at once, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.plans.state import discard, kept, watched

#: Bounds of equal shares of a group are taken in this many steps.
STEPS = 512
_WIDE = "decimal(38,0)"
#: A large group's rows are spread over this many tasks.
SALTS = 64
#: As many rows about large groups go to all tasks at most, so that the groups' own rows stay where they are.
FEW = 4096


def same(a: str, b: str, keys: list[str]) -> list[Column]:
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]


def _held(rows: DataFrame, some: DataFrame, n: int, keys: list[str], how: str = "inner") -> DataFrame:
    """rows (x, a written table, so that a task that runs again spreads them alike) joined with what is known of large groups (y, n rows). Few such rows are broadcast, and nothing is
    shuffled or sorted; of many each stands at every salt.
    """
    if n <= FEW:
        return rows.alias("x").join(F.broadcast(some.alias("y")), same("x", "y", keys), how)
    x = rows.withColumn("_salt", F.floor(F.rand(11) * SALTS)).alias("x")
    y = some.withColumn("_salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)]))).alias("y")
    return x.join(y, same("x", "y", [*keys, "_salt"]), how)


def at_ranks(rows: DataFrame, wanted: DataFrame, keys: list[str], value: str, bound: int = 10_000) -> DataFrame:
    """rows: keys, value; wanted: keys, rank (from 0, in ascending order of value). A row per wanted rank that exists: keys, rank, value.

    Ranks of groups of at most `bound` rows are read off their sorted rows. For a larger group a mergeable sketch gives bounds of equal shares; the two that should enclose the rank are
    taken, and the rows below, at, between and above them are counted exactly, all groups in one pass. Either one of the two is the value, or the rows of one open range go on: fewer in
    any case, since the bounds are values of the group. So the sketch's error bears on the number of rounds alone, and many equal values end a rank at once. Sketches are of doubles, so
    those of integers are of what each is above the least; where even this has no exact double, the next round starts from a nearer least. All ranks of a group share its rows and its
    sketch in the first round. Rows of large groups are only read, not shuffled, as long as what is known of these groups has few rows: a group has over `bound` rows.

    Nulls in value take no part; NaN is the largest; null keys are a group of their own; repeated wanted ranks count once. The value is a double, float or integer; others raise.
    """
    c = F.col
    kind = rows.schema[value].dataType
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if not whole and not isinstance(kind, (T.DoubleType, T.FloatType)):
        raise TypeError(f"{value}: ranks are of numbers; cast {kind.simpleString()} to a long or double first")
    as_bound, from_bound = c("v"), lambda x: x
    if whole:
        as_bound = (c("v").cast(_WIDE) - c("least").cast(_WIDE)).cast("double")
        from_bound = lambda x: F.least(c("least").cast(_WIDE) + x.cast(_WIDE), c("most").cast(_WIDE)).cast(kind)
    ks = [f"_k{i}" for i in range(len(keys))]
    ids = [c(k).alias(n) for k, n in zip(keys, ks)]
    group = [*ks, "_rank"]
    live, of = kept(rows.where(c(value).isNotNull()).select(*ids, c(value).alias("v")), "ranks"), ks
    asked, seen = watched(wanted.select(*ids, c("rank").cast("long").alias("_rank")).distinct().withColumn("r", c("_rank")), "ranks", n=F.count("*"))
    found, ranks = [], seen["n"]
    # Rows have their group's keys, of later rounds their rank's as well; what is asked of them (the rank wanted, and which it is among the rows left) stands beside them.
    while True:
        sizes, seen = watched(live.groupBy(*of).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")), "ranks", small=F.count_if(c("n") <= bound), large=F.count_if(c("n") > bound))
        large, many = sizes.where(c("n") > bound), seen["large"]
        if seen["small"] or not many:
            small = _held(live, large, many, of, "left_anti") if many else live
            few = F.broadcast(asked) if ranks <= FEW else asked
            found.append(_sorted(small.alias("x").join(few.alias("y"), same("x", "y", of)).select(*[c(f"x.{k}").alias(k) for k in of], *[c(f"y.{k}") for k in group if k not in of], "y.r", "x.v"), group))
        if not many:
            break
        shares = _held(live, large, many, of).select("x.*", "y.least", "y.most").groupBy(*of).agg(
            F.count("*").alias("n"), F.max("least").alias("least"), F.max("most").alias("most"), F.percentile_approx(as_bound, [i / STEPS for i in range(STEPS + 1)], 20 * STEPS).alias("s")
        )
        step = F.floor(c("r") / c("n") * STEPS).cast("int")
        of_share = shares.alias("x").join(asked.alias("y"), same("x", "y", of)).where("y.r >= 0 AND y.r < x.n").select("x.*", *[c(f"y.{k}") for k in group if k not in of], "y.r").withColumn("step", step)
        bounds, seen = watched(of_share.select(*group, "r", from_bound(F.get("s", F.greatest(c("step") - 1, F.lit(0)))).alias("lo"), from_bound(F.get("s", F.least(c("step") + 2, F.lit(STEPS)))).alias("hi")), "ranks", n=F.count("*"))
        counts = _held(live, bounds, seen["n"], of).select("x.v", *[c(f"y.{k}") for k in group], "y.r", "y.lo", "y.hi").groupBy(*group).agg(
            F.max("r").alias("r"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.count_if(c("v") < c("lo")).alias("below"), F.count_if(c("v") == c("lo")).alias("at_lo"),
            F.count_if((c("v") > c("lo")) & (c("v") < c("hi"))).alias("inside"), F.count_if((c("v") == c("hi")) & (c("hi") > c("lo"))).alias("at_hi"),
        )
        # The part that holds the rank, and the rows before that part.
        to_lo = c("below") + c("at_lo")
        to_hi = to_lo + c("inside") + c("at_hi")
        part = F.when(c("r") < c("below"), "below").when(c("r") < to_lo, "lo").when(c("r") < to_lo + c("inside"), "inside").when(c("r") < to_hi, "hi").otherwise("above")
        before = F.when(part == "below", 0).when(part == "inside", to_lo).otherwise(to_hi)
        on = ~c("part").isin("lo", "hi")
        chosen, seen = watched(counts.select(*group, "lo", "hi", part.alias("part"), (c("r") - before).alias("r")), "ranks", on=F.count_if(on))
        found.append(chosen.where(~on).select(*group, F.when(c("part") == "lo", c("lo")).otherwise(c("hi")).alias("v")))
        if not seen["on"]:
            break
        asked, ranks = chosen.where(on), seen["on"]
        goes = _held(live, asked, ranks, of).where("CASE y.part WHEN 'below' THEN x.v < y.lo WHEN 'inside' THEN x.v > y.lo AND x.v < y.hi ELSE x.v > y.hi END")
        before_these = live
        live, of = kept(goes.select(*[c(f"y.{k}").alias(k) for k in group], "x.v"), "ranks"), group
        discard(before_these, bounds)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(*[c(n).alias(k) for k, n in zip(keys, ks)], c("_rank").alias("rank"), c("v").alias(value))


def _sorted(few: DataFrame, group: list[str]) -> DataFrame:
    """Ranks of groups of bounded size, written: group, v."""
    nth = F.row_number().over(Window.partitionBy(*group).orderBy("v")) - 1
    return kept(few.withColumn("_nth", nth).where(F.col("_nth") == F.col("r")).select(*group, "v"), "ranks")


def medians(rows: DataFrame, keys: list[str], value: str, bound: int = 10_000) -> DataFrame:
    """A row per group of rows (keys, value) with values that aren't null: keys, n (such values), median (double: the middle one, or the mean of the two in the middle)."""
    n = kept(rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n")), "medians")
    ranks = n.select(*keys, F.explode(F.array_distinct(F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)))).alias("rank"))
    found = at_ranks(rows.select(*keys, value), ranks, keys, value, bound)
    middle = found.groupBy(*keys).agg(((F.min(value).cast("double") + F.max(value).cast("double")) / 2).alias("_median"))
    return n.alias("x").join(middle.alias("y"), same("x", "y", keys)).select(*[F.col(f"x.{k}").alias(k) for k in keys], F.col("x._n").alias("n"), F.col("y._median").alias("median"))
