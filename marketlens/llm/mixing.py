"""Mixing sources to target weights (operator 5).

A source's target is its weight's share of all words, at most MOST times its
own words; what that leaves over is shared among the others by weight until no
source is above.  A source gives complete epochs first: all its documents as
often as they fit.  The rest is a fraction of an epoch, chosen by
Efraimidis-Spirakis sampling: each document draws an exponential key divided by
its quality weight, and documents are taken in ascending order of the key while
the middle of their words lies within the rest.

* Draws are a hash of the doc_id, so reruns agree.
* The prefix sum within a source runs in two levels: words per (source, slot of
  the key's range), then within a slot.  A source of a third of all rows is
  spread over as many slots as its documents need; only slot totals meet.
* Quality comes from a table of labels, pre-aggregated to one row per document:
  weight 1/2 + mean quality, or 1 without a label.

Cases: a null or empty text has no words and is taken 0 times; a null source is
a source of its own, last in order; a null doc_id draws by its text; repeated
rows draw alike, and any of them may be the one that a fraction takes; no words
at all: targets of 0; empty table: no rows; extra columns are not read, and
``mixed`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.llm.common import materialise, read_table, row_key, row_order, whole_row

WEIGHTS = (5, 2, 1)
#: Target of a source, and repeats of a document, at most.
MOST = 3
#: Documents that a slot is meant for, and most slots of a source.
SLOT, SLOTS = 2000, 1 << 16


def words(text: Column) -> Column:
    """Number of maximal runs outside white space (space, tab to carriage
    return)."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    gaps = F.octet_length(flat) - F.octet_length(F.replace(flat, F.lit(" "), F.lit("")))
    return F.when(F.octet_length(flat) > 0, gaps + 1).otherwise(0).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """``sources``: source, words, docs (one row each).  Adds target.  With
    sources in order of the level at which they are full (MOST * words /
    weight), a source is full if the level of it and those after it, once the
    ones before it are full, reaches that."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weights = ", ".join(f"{w}L" for w in WEIGHTS)
    df = sources.withColumn("weight", F.element_at(F.expr(f"array({weights})"), ((F.row_number().over(by_name) - 1) % len(WEIGHTS)) + 1))
    df = df.withColumns({"cap": F.col("words") * MOST, "level": F.expr(f"cast({MOST} * words as double) / weight")})
    before = Window.orderBy("level", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    summed = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("decimal(38,0)")
    df = df.withColumns({"left": summed("words", everything) - summed("cap", before), "sharing": summed("weight", everything) - summed("weight", before)})
    df = df.withColumn("full", F.col("weight") * F.col("left") >= F.col("cap") * F.col("sharing"))
    rest = summed("words", everything) - summed(F.when(F.col("full"), F.col("cap")), everything)
    sharing = summed("weight", everything) - summed(F.when(F.col("full"), F.col("weight")), everything)
    df = df.withColumns({"rest": rest.cast("double"), "sharing": sharing.cast("double")})
    return df.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("rest") / F.nullif(F.col("sharing"), F.lit(0.0)))).select("source", "words", "docs", "target")


def qualities(labels: DataFrame) -> DataFrame:
    """doc_id, weight: one row for each labelled document."""
    known = labels.where("doc_id is not null and quality is not null")
    return known.groupBy("doc_id").agg((F.avg(F.col("quality").cast("double")) + 0.5).alias("weight"))


def mix(docs: DataFrame, quality: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: key (see ``row_key``), doc_id, source,
    size, source_size, target, copies (how often the mix takes the document),
    taken (words)."""
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[source_col].alias("source"))
    rows = materialise(src.select("doc_id", "source", row_key().alias("key"), words(F.col("text")).alias("size")), "mixing-rows")
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")))
    plan = plan.withColumn("epochs", F.expr("if(words > 0, cast(floor(target / words) as long), 0L)"))
    plan = plan.selectExpr("source as plan_source", "words as source_size", "target", "epochs", "target - epochs * words as rest", f"cast(least({SLOTS}, 1 + docs div {SLOT}) as int) as slots")
    plan = materialise(plan, "mixing-plan")

    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("key").cast("string")).cast("binary"))
    uniform = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    drawn = rows.join(quality, "doc_id", "left").withColumn("draw", -F.log(uniform) / F.coalesce("weight", F.lit(1.0)))
    drawn = drawn.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    # slots keep the order of draws, and unweighted draws fill them evenly
    slot = F.expr("cast(least(slots - 1, floor(slots * (1 - exp(-draw)))) as int)")
    drawn = materialise(drawn.select("key", "doc_id", "source", "size", "draw", slot.alias("slot"), "source_size", "target", "epochs", "rest"), "mixing-draws")
    earlier = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    totals = drawn.groupBy("source", "slot").agg(F.sum("size").alias("s"))  # SLOTS rows a source at most
    totals = totals.select(F.col("source").alias("t_source"), F.col("slot").alias("t_slot"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("before"))
    placed = drawn.join(totals, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("slot") == F.col("t_slot")))
    inside = Window.partitionBy("source", "slot").orderBy("draw", "doc_id", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("before") + F.sum("size").over(inside) - F.col("size") / 2
    copies = F.when(F.col("size") > 0, F.col("epochs") + (middle <= F.col("rest")).cast("long")).otherwise(0).cast("long")
    out = placed.select("key", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, quality: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    copies = mix(docs, quality).groupBy("key", "source").agg(F.sum("copies").alias("copies")).where("copies > 0")
    copies = copies.select(F.col("key").alias("c_key"), F.col("source").alias("c_source"), "copies")
    rows = docs.select(row_key().alias("key"), F.col("source").alias("s"), row_order(docs).alias("order"), whole_row(docs).alias("row"))
    # rows equal in id, text and source stand for each other: one of them, as often as all are taken
    once = rows.join(copies, (F.col("key") == F.col("c_key")) & F.col("s").eqNullSafe(F.col("c_source")))
    once = once.groupBy("key", "s", "copies").agg(F.min_by("row", "order").alias("row"))
    return once.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(read_table(spark, sf_dir, "documents"), qualities(read_table(spark, sf_dir, "labels")))
    return found.select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), source_words AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS words, {MOST} * CAST(sum(size) AS BIGINT) AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 {' '.join(f'WHEN {i} THEN {w}' for i, w in enumerate(WEIGHTS))} END AS weight
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, (SELECT sum(words) FROM source_words) - coalesce(sum(cap) OVER w, 0) AS remains,
         (SELECT sum(weight) FROM source_words) - coalesce(sum(weight) OVER w, 0) AS sharing
  FROM source_words
  WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), filled AS (
  SELECT *, weight * remains >= cap * sharing AS full_up FROM ordered
), planned AS (
  SELECT source, words, CASE WHEN full_up THEN CAST(cap AS DOUBLE) ELSE
           weight * CAST((SELECT sum(words) FROM filled) - (SELECT coalesce(sum(cap), 0) FROM filled WHERE full_up) AS DOUBLE)
           / CAST((SELECT sum(weight) FROM filled) - (SELECT coalesce(sum(weight), 0) FROM filled WHERE full_up) AS DOUBLE) END AS target
  FROM filled
), graded AS (
  SELECT doc_id, 0.5 + avg(CAST(quality AS DOUBLE)) AS weight FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), drawn AS (
  SELECT s.*, -ln((CAST('0x' || substr(md5(CAST(s.doc_id AS VARCHAR)), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0::DOUBLE) / coalesce(g.weight, 1) AS draw
  FROM sized s LEFT JOIN graded g ON s.doc_id = g.doc_id
), placed AS (
  SELECT d.doc_id, d.size, p.words, p.target, floor(p.target / nullif(p.words, 0)) AS epochs,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size / 2 AS middle
  FROM drawn d JOIN planned p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, words AS source_size, target,
       CAST(CASE WHEN size > 0 THEN (epochs + CASE WHEN middle <= target - epochs * words THEN 1 ELSE 0 END) * size ELSE 0 END AS BIGINT) AS taken
FROM placed
"""
