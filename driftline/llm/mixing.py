"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share, by weight, of `share` times all sizes, stopped at `most` times the source's own
size; what is cut off is dealt again by weight until no source is above its stop. The rate target / source size gives
each document floor(rate) certain whole copies. The rest of the rate is the inclusion probability p of one more copy:
documents are ranked by Pareto's ranking number, (u / (1 - u)) / (p / (1 - p)) with u a hash of the document, and the
smallest are taken as long as they bring the source's words nearer to its target. The order needs no sort of a source
in one task: sums over a histogram of the ranking number find the cell in which the target is met, and only documents
of that cell are put in order, cell by cell, on `levels` levels.

Defined cases: null source forms a source of its own, last in order; null text and empty texts have size 0 and are
taken 0 times; a text of any length is counted whole; columns that have a result's name are replaced, no other name can
clash; repeated rows have the same u and are told apart by nothing, so they are taken or left together at the
end of the order; an empty table gives an empty result. Reruns agree: u depends on the id and the seed alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import WORD, numbered_columns, stored
from driftline.session import is_small

WEIGHTS = (5.0, 2.0, 1.0)
#: u has 39 bits, dealt to cells of 13 bits on each of the three levels.
BITS, CELL = 39, 13


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def unit(key: str, seed: int) -> Column:
    """A number of BITS bits from the key: the first 10 hex digits of an MD5 hash, without the last bit."""
    digits = F.substring(F.md5(F.concat(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary")), 1, 10)
    return F.shiftright(F.conv(digits, 16, 10).cast("long"), 40 - BITS)


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sizes (source, source_size), one row a source, with target. A few rows a source: the windows here run over sources, not documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("total", share * F.sum("source_size").over(every).cast("double"))
    # Sources reach their stop in the order of stop / weight; at the right level, those before it are at their stop and the rest share what is left.
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("left", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("total") - F.col("before")) / F.col("left"))
    s = s.withColumn("place", F.row_number().over(by)).withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(every)["level"])
    s = s.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
    return s.select("source", "source_size", "target")


def odds(p: Column) -> Column:
    return p / (1 - p)


def ranking(u: Column, inclusion_odds: Column) -> Column:
    """Pareto's ranking number odds(u) / inclusion odds, mapped in order to a whole number of BITS bits."""
    q = F.try_divide(odds((u.cast("double") + 0.5) / float(1 << BITS)), inclusion_odds)
    return F.least(F.floor(q / (1 + q) * float(1 << BITS)), F.lit((1 << BITS) - 1)).cast("long")


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 7, prior: str | None = None, size_power: float = 0.0, carry: list[str] | None = None) -> DataFrame:
    """docs (the columns of carry; all) with size, source_size, target, copies and taken.

    A document's inclusion odds are those of its source's rate, times its size to the power size_power, times prior (a
    column of positive factors). With neither, all documents of a source have the same odds.
    """
    names = ("size", "source_size", "target", "copies", "taken")
    own = [c for c in (docs.columns if carry is None else carry) if c not in names]
    size, factor = word_count(text), F.coalesce(F.col(f"`{prior}`").cast("double"), F.lit(1.0)) if prior else F.lit(1.0)
    read = numbered_columns(docs, own, size=size, u=unit(key, seed), source=F.col(f"`{source}`"), factor=factor)
    read = read.withColumn("prior", F.col("factor") * (F.pow(F.col("size").cast("double"), F.lit(size_power)) if size_power else F.lit(1.0))).drop("factor")
    if carry is not None:
        read = stored(read, "mix")  # words are counted in the texts once, for all levels and the result
    slim = (read if carry is not None else stored(read.select("u", "source", "size", "prior"), "mix")).select(*[F.col(c).alias(f"__{c}") for c in ("u", "source", "size", "prior")])
    goal = targets(slim.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size")), share, most, weights)
    goal = goal.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    goal = goal.withColumn("whole", F.floor("rate")).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("odds", odds(F.col("rate") - F.col("whole")))
    goal = stored(goal, "mix-goal")
    few = is_small(goal)
    plan = goal.join(threshold(slim, goal, few), F.col("source").eqNullSafe(F.col("at")), "left").select(F.col("source").alias("of"), "source_size", "target", "whole", "odds", F.coalesce("last", F.lit(-1)).alias("last"))
    plan = stored(plan, "mix-plan")
    out = read.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("of")), "left")
    more = (F.col("last") >= 0) & (ranking(F.col("u"), F.col("odds") * F.col("prior")) <= F.col("last"))
    copies = (F.coalesce("whole", F.lit(0)) + F.when(more, 1).otherwise(0)).cast("long")
    result = [F.col("size"), F.col("source_size").cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken")]
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], *result)


def threshold(slim: DataFrame, goal: DataFrame, few: bool) -> DataFrame:
    """For each source the ranking number (last) up to which the words taken come nearest to need, by cells; each level looks into one cell of the level above."""
    state = goal.where("need > 0 AND odds > 0").select(F.col("source").alias("at"), "odds", F.lit(0).cast("long").alias("low"), "need", F.lit(0.0).alias("done"))
    shift = BITS
    while shift > 0:
        inside = slim.join(F.broadcast(state) if few else state, slim["__source"].eqNullSafe(state["at"])).withColumn("r", ranking(F.col("__u"), F.col("odds") * F.col("__prior")))
        inside = inside.where((F.shiftright("r", shift) == F.col("low")) & (F.col("__size") > 0))
        shift -= CELL
        cells = inside.groupBy("at", "odds", "need", "done", F.shiftright("r", shift).alias("cell")).agg(F.sum("__size").cast("double").alias("words"))
        run = Window.partitionBy("at").orderBy("cell")  # at most 2 ** CELL rows a source
        cells = cells.withColumn("upto", F.col("done") + F.sum("words").over(run))
        met = F.col("upto") >= F.col("need")
        if shift:
            state = cells.groupBy("at", "odds", "need").agg(F.coalesce(F.min(F.when(met, F.col("cell"))), F.max("cell")).alias("low"), F.max(F.when(~met, F.struct("cell", "upto"))).alias("below"), F.max("cell").alias("top"), F.min("done").alias("done"), F.max(F.when(met, 1)).alias("met"))
            # Where no cell meets need, the last one is looked into, and what lies before it is done.
            before = cells.join(state.select(F.col("at").alias("at2"), F.col("low").alias("low2")), F.col("at").eqNullSafe(F.col("at2")) & (F.col("cell") < F.col("low2"))).groupBy(F.col("at").alias("at3")).agg(F.max("upto").alias("before"))
            state = stored(state.join(before, F.col("at").eqNullSafe(F.col("at3")), "left").select("at", "odds", "low", "need", F.coalesce("before", "done").alias("done")), "mix-level")
    edge = cells.groupBy("at", "need").agg(F.min(F.when(met, F.struct("cell", "upto"))).alias("over"), F.max(F.when(~met, F.struct("cell", "upto"))).alias("under"), F.min("done").alias("done"), F.min("cell").alias("first"))
    under = F.coalesce(F.col("under.upto"), F.col("done"))
    nearer = F.col("over").isNotNull() & (F.col("over.upto") - F.col("need") <= F.col("need") - under)
    return edge.select("at", F.when(nearer, F.col("over.cell")).otherwise(F.coalesce(F.col("under.cell"), F.col("first") - 1)).alias("last"))
