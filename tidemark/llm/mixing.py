"""Mixing sources to target weights.

Words are counted per source; a source's target is its share of all words by weight, at most ``ceiling`` times what
it has, with the excess reshared by weight. A document comes out floor(rate) times, rate = target / source size, and
once more with probability equal to the fraction, drawn by a hash of its id.

Defined cases: null text has size 0; a null source is a source of its own, last in order; a source of size 0 takes
nothing; documents of size 0 take no words (and come out as often as others of their source); rows with the same id
share one draw; a null id draws by its text; an empty table gives an empty table; other columns go through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import cut

WORD = r"[^\x20\x09-\x0D]+"
#: A join side of at most this many rows (one for each source, under 100 bytes) is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 100_000


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of a hash."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), ceiling: int = 3) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    One row for each source comes out of a map-side combined sum; the windows below see those rows only. With
    sources in the order in which they reach the ceiling, the level at which the uncapped ones share what the capped
    ones leave is the largest of (all - capped before) / (weights not before).
    """
    n = len(weights)
    per_source = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % n + 1).cast("int")).cast("long")
    per_source = per_source.select("source", "source_size", rank.alias("rank"), weight.alias("weight"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - ceiling * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    heft = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    leveled = per_source.withColumn("share", left.cast("double") / heft).withColumn("level", F.max("share").over(everything))
    return leveled.select("source", "source_size", F.least((F.col("source_size") * ceiling).cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Each row with its source's size and target, and copies, the times it comes out."""
    targets = cut(targets).withColumnRenamed("source", "of")
    small = targets.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(targets) if small else targets, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = (F.col("draw") < rate - F.floor(rate)).cast("long")
    return joined.withColumn("copies", F.floor(rate).cast("long") + extra)


def _rows(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    key = F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))
    return docs.select(*more, F.col(source_col).alias("source"), words(text_col).alias("size"), draw(key, seed).alias("draw"))


def mix_plan(docs: DataFrame, weights=(1, 2, 3), ceiling=3, seed=17, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """(id, size, source_size, target, copies, taken) of each row. The text is read once."""
    sized = cut(_rows(docs, seed, id_col, text_col, source_col, F.col(id_col).alias("__id")))
    planned = _with_targets(sized, source_targets(sized, weights, ceiling))
    return planned.select(F.col("__id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, weights=(1, 2, 3), ceiling=3, seed=17, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with their own columns."""
    sized = docs.select(F.col(source_col).alias("source"), words(text_col).alias("size"))
    rows = _rows(docs, seed, id_col, text_col, source_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    planned = _with_targets(rows, source_targets(sized, weights, ceiling)).where("copies > 0")
    return planned.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, text, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight,
    row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM sized GROUP BY source),
leveled AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS share
  FROM ranked WINDOW w AS (ORDER BY source_size::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, max(share) OVER () * weight) AS target FROM leveled),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, s.draw, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT AS copies,
  (floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT) * size AS taken
FROM rated
"""
