"""Held bars without a row a day: a tree of aligned blocks over each ticker's bars.

Level 0 of the tree are the bars, and a node of level j covers 2**j neighbouring bars.  A range of bars is the sum of at most two nodes
a level, so a position reads a number of rows that grows with the logarithm of its holding time.  A node carries what can be put together
from left to right: the highest high and close, the least ATR, and the best trailing level (the highest high so far less a multiple of the
ATR, over its bars).  Where a close first reaches a gain is found by going down the tree, ``STRIDE`` levels a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.operators.asof import asof_join

#: Levels of the tree; a range of more bars than the top level covers takes several nodes of that level.
LEVELS = 14
#: Levels that a step down the tree passes, so a node lists the closes of at most 2**STRIDE nodes below.
STRIDE = 5


def block_tree(bars: DataFrame, trail_atr: float = 0.0) -> DataFrame:
    """``ticker, level, node, high, close, low_atr, trail``: every aligned block of ``ticker, n, high, close, atr``.

    Tickers are dealt once; the windows and sums of all levels stay within that partitioning.
    """
    spread = bars.repartition("ticker").select("ticker", "n", "high", "close", "atr", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"))
    spread = spread.withColumn("node", F.expr("shiftright(n, level)"))
    so_far = F.max("high").over(Window.partitionBy("ticker", "level", "node").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return spread.withColumn("trail", so_far - trail_atr * F.col("atr")).groupBy("ticker", "level", "node").agg(
        F.max("high").alias("high"), F.max("close").alias("close"), F.min("atr").alias("low_atr"), F.max("trail").alias("trail"))


def nodes_of(first: Column, last: Column) -> Column:
    """The nodes that make up the bars ``first`` to ``last``, as structs of level, node and first bar; none for an empty range."""
    stop = last + 1

    def at(level: Column) -> Column:
        width = F.pow(F.lit(2), level).cast("long")
        lo, hi = F.floor((first + width - 1) / width), F.floor(stop / width)
        node = lambda k: F.struct(level.cast("int").alias("level"), k.cast("long").alias("node"), (k * width).cast("long").alias("start"))
        left = F.when((lo < hi) & (lo % 2 == 1), F.array(node(lo)))
        right = F.when((lo < hi) & (hi % 2 == 1) & ~((lo % 2 == 1) & (hi - 1 == lo)), F.array(node(hi - 1)))
        inner = F.when(lo < hi, F.transform(F.sequence(lo, hi - 1), node))
        none = F.array().cast("array<struct<level:int,node:bigint,start:bigint>>")
        return F.when(level == LEVELS - 1, F.coalesce(inner, none)).otherwise(F.concat(F.coalesce(left, none), F.coalesce(right, none)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), at))


def located(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Positions that hold a bar, with the numbers of their first and last one (``a``, ``b``) and the last bar as ``z``.

    ``bars`` carries ``n``, the number of a bar within its ticker.
    """
    px = bars.withColumn("on", F.col("date"))
    first = asof_join(positions, px, "ticker", "entry_date", "on", {"n": "a"}, "forward")
    z = F.struct(*[c for c in bars.columns if c != "ticker"])
    both = asof_join(first, px.withColumn("z", z), "ticker", "as_of", "on", {"z": "z"}, points=positions)
    return both.withColumn("b", F.col("z.n")).where("a <= b")


def numbered(bars: DataFrame) -> DataFrame:
    """Bars with their number within the ticker, from 0."""
    return bars.withColumn("n", (F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1).cast("long"))


def extremes(positions: DataFrame, tree: DataFrame, enough: Column) -> DataFrame:
    """Located positions with the highest high ``hh`` and close ``peak`` since entry, and ``hit``: the first node with a close that is ``enough``.

    ``enough`` is a test of ``close``, and of the columns of ``positions``, that higher closes pass too.
    """
    spread = positions.withColumn("x", F.explode(nodes_of(F.col("a"), F.col("b")))).select("*", "x.level", "x.node", "x.start").drop("x")
    rows = spread.join(tree.select("ticker", "level", "node", "high", "close"), ["ticker", "level", "node"])
    found = rows.groupBy("position_id").agg(
        F.max("high").alias("hh"), F.max("close").alias("peak"), F.min_by(F.struct("level", "node"), F.when(enough, F.col("start"))).alias("_hit"),
        F.max(enough).alias("_any"))
    return positions.join(found.withColumn("hit", F.when(F.col("_any"), F.col("_hit"))).drop("_hit", "_any"), "position_id")


def first_at(positions: DataFrame, tree: DataFrame, enough: Column) -> DataFrame:
    """``position_id, m``: the first held bar with a close that is ``enough``, below the node ``hit`` of each position that has one."""
    now = positions.where("hit IS NOT NULL").select("*", "hit.level", "hit.node")
    below = tree.select("ticker", F.col("level").alias("sub"), F.col("node").alias("child"), "close")
    step = f"least(level, {STRIDE})"
    for _ in range(-(-(LEVELS - 1) // STRIDE)):
        asked = now.withColumn("sub", F.expr(f"level - {step}")).withColumn("child", F.explode(F.expr(f"sequence(shiftleft(node, {step}), shiftleft(node + 1, {step}) - 1)")))
        good = asked.join(below, ["ticker", "sub", "child"]).where(enough)
        lower = good.groupBy("position_id").agg(F.min("child").alias("node"), F.first("sub").alias("level"))
        now = now.drop("level", "node").join(lower, "position_id")
    return now.select("position_id", F.col("node").alias("m"))


def best_trail(positions: DataFrame, tree: DataFrame, trail_atr: float) -> DataFrame:
    """``position_id, armed``: the best trailing level on any bar from ``m`` on, with the highest high since entry on each bar."""
    x = F.flatten(F.array(nodes_of(F.col("a"), F.col("m") - 1), nodes_of(F.col("m"), F.col("b"))))
    spread = positions.select("position_id", "ticker", "m", F.explode(x).alias("x")).select("position_id", "ticker", "m", "x.*")
    rows = spread.join(tree, ["ticker", "level", "node"])
    before = F.max("high").over(Window.partitionBy("position_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    level = F.greatest("trail", before - trail_atr * F.col("low_atr"))
    return rows.withColumn("level_here", F.when(F.col("start") >= F.col("m"), level)).groupBy("position_id").agg(F.max("level_here").alias("armed"))
