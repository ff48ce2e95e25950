"""Mixing sources to target weights by Pareto order sampling.

Sources ordered by code point (null last) weigh 1, 2, 3, repeating, and share the total size of all documents; a
target stops at `most` times its source's size and the excess is reshared by weight (water-filling, in closed form).
A source's rate is target / size. Every document gets floor(rate) certain copies; the rest of the target is filled by
Pareto order sampling: documents are ranked by random odds u / (1 - u) over inclusion odds p / (1 - p), and the first
ones are taken until their words come nearest to what is left of the target. u is derived from the id, so reruns agree.

The inclusion odds are c / sqrt(size): of a source's documents a long one is less readily taken once more, so none takes
the whole rest of a target, and the cut is fine. c is the source's, such that the expected words are what is left; as it
scales all ranks of a source alike, the fixed size sets it and it needn't be computed. `odds` takes another rule.

Ranks lie on a scale of 2**52 steps (r / (1 + r) of the ratio r). The cut is found without sorting a source in one task:
the sizes are summed in 4,096 cells of the scale a source, the cell that holds the cut is split into 4,096 cells again,
and only the documents of that last cell are ordered.

Defined results: size counts words between white space, 0 for null or empty texts, which are always taken once their
turn comes at no cost; a null id is hashed as the empty string; rows that repeat an id have the same u, and those that
repeat its size too are taken alike; ties in rank go by id; other columns are kept by `mixed` and ignored by `mix`; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, filled

CELLS = 4096
#: Tables of so many sources at most are broadcast; beyond it Spark joins them by shuffle.
BROADCAST_SOURCES = 20_000
DIGITS = 13


def inverse_root(size: Column) -> Column:
    """Inclusion odds that fall with the square root of the size; 1 at 256 words."""
    return F.lit(16.0) / F.sqrt(F.greatest(size, F.lit(1)).cast("double"))


Odds = Callable[[Column], Column]


def draw(id_col: Column, seed: int) -> Column:
    """52 random bits from the id, as a long."""
    key = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("long")


def rank(u: Column, odds: Column) -> Column:
    """Place on the scale: the odds of u over the inclusion odds, as a long below 2**52."""
    top = 1 << (4 * DIGITS)
    ratio = u.cast("double") / (F.lit(top) - u).cast("double") / odds
    return F.least(F.floor(ratio / (ratio + 1.0) * float(top)), F.lit(top - 1)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, share: float = 1.0) -> DataFrame:
    """sources: src, source_size. Adds target: level * weight where that is under the cap of most * source_size.

    One row per source; the windows without a key run over this table only, never over documents.
    """
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn.cast("int") + 1)
    t = sources.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    t = t.withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("src").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    # the first source, by cap / weight, that the level leaves under its cap sets the level
    t = t.withColumn("level", level)
    fits = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(Window.partitionBy())
    return t.withColumn("target", F.least("cap", F.coalesce(fits["level"] * F.col("w"), F.col("cap")))).select(
        "src", "source_size", "target"
    )


def _cells(u: Column) -> tuple[Column, Column]:
    width = (1 << (4 * DIGITS)) // CELLS
    return F.floor(u / width).cast("int"), F.floor((u % width) / (width // CELLS)).cast("int")


class _Cuts:
    """Where each source's ranking is cut.

    sized: src, id, u (its rank), size per document. sources: a row per source; last: the documents of the cells that are cut.
    """

    def __init__(self, sized: DataFrame, weights: tuple[float, ...], most: float) -> None:
        self.most = int(most)
        c1, c2 = _cells(F.col("u"))
        sized = sized.withColumn("c1", c1).withColumn("c2", c2)
        coarse = sized.groupBy("src", "c1").agg(F.sum("size").alias("words"))
        goal = targets(coarse.groupBy("src").agg(F.sum("words").alias("source_size")), weights, most)
        rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(0)
        goal = goal.withColumn("whole", rate.cast("int")).withColumn(
            "rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))
        )
        goal = cut(goal)
        self.small = small = F.broadcast if goal.count() <= BROADCAST_SOURCES else lambda df: df
        first = self._crossing(coarse, "c1", goal, "rest", "rest1")
        inner = sized.join(small(first), sized["src"].eqNullSafe(first["src"]) & (sized["c1"] == first["c1_cut"])).select(sized["*"])
        fine = inner.groupBy("src", "c2").agg(F.sum("size").alias("words"))
        second = cut(self._crossing(fine, "c2", first, "rest1", "rest2"))
        last = inner.join(small(second), inner["src"].eqNullSafe(second["src"]) & (inner["c2"] == second["c2_cut"])).select(
            inner["src"], "id", "u", "size", "rest2"
        )
        order = Window.partitionBy("src").orderBy("u", F.col("id").asc_nulls_last())
        # the document at the cut is taken if that comes nearer to the target than leaving it
        last = last.withColumn("run", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).select(
            F.col("src").alias("__l_src"),
            F.col("id").alias("__l_id"),
            (2 * F.col("rest2") >= 2 * F.col("run") - F.col("size")).alias("__l_take"),
        )
        self.last = cut(last.groupBy("__l_src", "__l_id").agg(F.max("__l_take").alias("__l_take")))
        f, s = first.withColumnRenamed("src", "f_src"), second.withColumnRenamed("src", "s_src")
        self.sources = cut(
            goal.join(f, F.col("src").eqNullSafe(F.col("f_src")), "left")
            .join(s, F.col("src").eqNullSafe(F.col("s_src")), "left")
            .select(*[F.col(c).alias(f"__{c}") for c in ("src", "source_size", "target", "whole", "rest", "c1_cut", "c2_cut")])
        )

    @staticmethod
    def _crossing(cells: DataFrame, cell: str, left: DataFrame, rest: str, out: str) -> DataFrame:
        """For each source the first cell whose running words exceed what is left, and what is left before it."""
        run = F.sum("words").over(Window.partitionBy("src").orderBy(cell))  # at most CELLS rows of a source
        t = cells.withColumn("run", run).alias("a")
        t = t.join(left.select("src", F.col(rest).alias("_rest")).alias("b"), F.col("a.src").eqNullSafe(F.col("b.src")))
        return (
            t.filter(F.col("run") > F.col("_rest"))
            .groupBy(F.col("a.src").alias("src"))
            .agg(F.min(F.struct(cell, (F.col("_rest") - (F.col("run") - F.col("words"))).alias("r"))).alias("m"))
            .select("src", F.col(f"m.{cell}").alias(f"{cell}_cut"), F.col("m.r").alias(out))
        )

    def copies(self, rows: DataFrame, src: Column, id_: Column, u: Column) -> DataFrame:
        """rows with the columns of their source (prefixed __) and __copies."""
        c1, c2 = _cells(u)
        few = self.last.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
        out = rows.join(self.small(self.sources), src.eqNullSafe(F.col("__src")), "left")
        last = F.broadcast(self.last) if few else self.last
        out = out.join(last, src.eqNullSafe(F.col("__l_src")) & id_.eqNullSafe(F.col("__l_id")), "left")
        at = F.col("__c1_cut")
        before = at.isNull() | (c1 < at) | ((c1 == at) & (c2 < F.col("__c2_cut")))
        extra = (F.col("__rest") > 0) & (before | F.coalesce(F.col("__l_take"), F.lit(False)))
        whole = F.col("__whole") + F.coalesce(extra, F.lit(False)).cast("int")
        return out.withColumn("__copies", F.least(whole, F.lit(self.most)).cast("int"))


def words_of(text: Column) -> Column:
    return F.regexp_count(filled(text), F.lit(WORD)).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, odds: Odds) -> DataFrame:
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), words_of(F.col(text_col)).alias("size"))
    # ids, sources and sizes only: the texts are read once
    return cut(sized.withColumn("u", rank(draw(F.col("id"), seed), odds(F.col("size")))))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    most: float = 3.0,
    seed: int = 1,
    odds: Odds = inverse_root,
) -> DataFrame:
    """One row per document: id, size, source_size, target (both of its source), taken (words), copies."""
    sized = _sized(docs, id_col, text_col, source_col, seed, odds)
    out = _Cuts(sized, weights, most).copies(sized, F.col("src"), F.col("id"), F.col("u"))
    return out.select(
        F.col("id").alias(id_col),
        "size",
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("size") * F.col("__copies")).cast("long").alias("taken"),
        F.col("__copies").alias("copies"),
    )


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    most: float = 3.0,
    seed: int = 1,
    odds: Odds = inverse_root,
) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns; the texts aren't shuffled."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # so that no name of the table meets one of ours
    id_, text, source = (f"c{names.index(c)}" for c in (id_col, text_col, source_col))
    cuts = _Cuts(_sized(plain, id_, text, source, seed, odds), weights, most)
    # a column of its own below the joins, so that a text's words are counted once
    ranked = plain.withColumn("__u", rank(draw(plain[id_], seed), odds(words_of(plain[text]))))
    out = cuts.copies(ranked, ranked[source], ranked[id_], ranked["__u"]).filter(F.col("__copies") > 0)
    again = F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__turn")
    return out.select(*[ranked[c] for c in plain.columns], again).drop("__turn").toDF(*names)
