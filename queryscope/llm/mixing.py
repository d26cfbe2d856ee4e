"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from queryscope.llm.common import sendable, stored

#: Fixed pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3


def sizes(text_col: str = "text"):
    """Column: number of words of a whole text; null counts as none."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target double).

    Sources by code point, null last, bear ``weights`` in turn and share the total; none gets over ``most`` times its
    size, and what is over is shared again by weight. That ends where target = min(most * size, weight * level) for one
    level: capped sources are those of least most * size / weight, found by running sums. One row a source.
    """
    everyone, place = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(place) - 1) % n + 1).cast("int"))
    t = per_source.withColumn("w", weight).withColumn("cap", F.col("source_size").cast("double") * most)
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("total", F.sum(F.col("source_size").cast("double")).over(everyone)).withColumn("w_all", F.sum("w").over(everyone))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / (F.col("w_all") - F.coalesce(F.sum("w").over(up), F.lit(0.0)))
    #: the level if all before are capped and this one is not; the first source that it does not cap sets it for all
    t = t.withColumn("level", level).withColumn("free", F.col("cap") > F.col("w") * F.col("level"))
    t = t.withColumn("level", F.min_by(F.when(F.col("free"), F.col("level")), F.when(F.col("free"), F.col("cap") / F.col("w"))).over(everyone))
    return t.select("source", "source_size", F.coalesce(F.least("cap", F.col("w") * F.col("level")), F.col("cap")).alias("target"))


def draw(key, seed: int = 17):
    """Column: a number in [0, 1) that depends on the key's text and the seed alone (52 bits of an MD5)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies int), one row for each document row.

    A document of a source with repetition rate target / size is taken floor(rate) times, and once more with the rate's
    fraction as probability, by a hash of its id: reruns agree, and rows that repeat an id fare alike. Null texts have
    size 0; a source without words has target 0 and takes nothing. Sources' sums are combined before the shuffle; what is
    sent to all tasks is one row a source, if their counted number allows it, else they are joined by a shuffle.
    """
    each = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), sizes(text_col).alias("size")), "sizes")
    goals = sendable(stored(targets(each.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets"))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (draw(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    both = each.alias("e").join(goals.alias("g"), F.col("e.source").eqNullSafe(F.col("g.source")))
    return both.select("e.doc_id", "e.source", "e.size", "g.source_size", "g.target", copies.cast("int").alias("copies"))


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it, with the columns of ``docs`` whatever their names.

    Null texts have no words and fare as their source does; rows that repeat an id fare alike; no rows give none.
    """
    goals = targets(docs.select(F.col("source").cast("string").alias("source"), sizes().alias("size")).groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    goals = stored(goals.select(F.col("source").alias("_source"), F.least(F.lit(float(most)), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).alias("_rate")), "rates")
    goals = sendable(goals)  # a row for each source; so documents are not dealt out by source
    both = docs.join(goals, docs["source"].cast("string").eqNullSafe(goals["_source"]))
    rate = goals["_rate"]
    copies = (F.floor(rate) + (draw(docs["doc_id"], seed) < rate - F.floor(rate)).cast("long")).cast("int")
    #: a whole row as one value, so that no helper column can clash with those of docs
    row = F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns])
    return both.where(copies > 0).select(F.explode(F.array_repeat(row, copies)).alias("row")).select("row.*")
