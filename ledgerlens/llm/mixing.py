"""Mixing sources to target weights by Pareto order sampling.

Word targets per source come from filling by weight under a cap.  Inside a
source every document has an expected number of copies; its whole part is
certain, and the fractional part is its inclusion probability in a Pareto
sample: documents are ranked by random odds over inclusion odds, and the
sample is the prefix whose words come nearest to the words still wanted.
The random number is a hash of the document's id and text, so reruns agree and
rows that share an id (or have none) spread over the ranks.

A source is never sorted as a whole: ranks fall into about sqrt(n) buckets,
bucket sums find the one bucket the cut falls into, and only that bucket's
rows are put in exact order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm._util import stored

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2
SALT = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key: Column, salt: str) -> Column:
    """A number in (0, 1) that depends on the key's text only (null: as the empty text)."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":" + salt)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


# --- targets ----------------------------------------------------------------

def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   cap: float = CAP) -> DataFrame:
    """``source, source_size, n, target`` for ``sized(source, size)``.

    Sources sort by code point, null last, and take the weights in turn.  The
    words ``share * sum(size)`` are shared by weight; a source stops at ``cap``
    times its size and its excess is shared again until none is above.
    """
    spark = sized.sparkSession
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ordered = sums.orderBy(F.asc_nulls_last("source"))
    every, turn = len(weights), [float(w) for w in weights]
    ranked = ordered.rdd.zipWithIndex().map(lambda p: (*p[0], turn[p[1] % every]))
    sources = stored(spark.createDataFrame(ranked, "source string, source_size long, n long, weight double"),
                     "mix-sources")
    full = (F.col("source_size") * float(cap)).cast("double")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget, left, open_weight, capped = share * total, share * total, None, -1
    while True:
        if open_weight is None:
            stops = F.lit(False)
        elif open_weight > 0:  # full / weight <= left / open_weight
            stops = full * open_weight <= F.col("weight") * left
        else:
            stops = F.lit(True)
        state = sources.agg(F.count_if(stops), F.sum(F.when(stops, full).otherwise(0.0)),
                            F.sum(F.when(stops, 0.0).otherwise(F.col("weight")))).first()
        if state[0] == capped:
            break
        capped, left, open_weight = state[0], budget - (state[1] or 0.0), state[2] or 0.0
    target = F.when(stops, full).otherwise(
        F.col("weight") * F.lit(left) / F.lit(open_weight)) if open_weight else full
    return sources.select("source", "source_size", "n", target.alias("target"))


# --- expected copies --------------------------------------------------------

def expected_copies(rows: DataFrame, cap: float) -> DataFrame:
    """Adds ``expected``: copies per document, in proportion to its weight, at most ``cap``.

    Without weights (all equal) it is target / source_size.  With weights the
    scale of each source is raised until the words lost at the cap are made
    up; each round is one aggregate by source.
    """
    scale = rows.groupBy("source", "target").agg(F.sum(F.col("weight") * F.col("size")).alias("open")).select(
        "source", F.when(F.col("open") > 0, F.col("target") / F.col("open")).otherwise(0.0).alias("scale"))
    capped = -1
    while True:
        scale = stored(scale, "mix-scale")
        met = rows.join(scale, rows["source"].eqNullSafe(scale["source"])).drop(scale["source"])
        stops = (F.col("weight") > 0) & (F.col("weight") * F.col("scale") >= cap)
        now = met.agg(F.count_if(stops)).first()[0]
        if now <= capped or now == 0:
            return met.withColumn("expected", F.least(F.col("weight") * F.col("scale"), F.lit(float(cap)))).drop("scale")
        capped = now
        scale = met.groupBy("source", "target").agg(
            F.sum(F.when(stops, F.col("size") * float(cap)).otherwise(0.0)).alias("full"),
            F.sum(F.when(stops, 0.0).otherwise(F.col("weight") * F.col("size"))).alias("open"),
            F.max("scale").alias("before")).select("source", F.when(
                F.col("open") > 0, F.greatest("before", (F.col("target") - F.col("full")) / F.col("open")))
                .otherwise(F.col("before")).alias("scale"))


# --- Pareto order sample ----------------------------------------------------

def pareto_rank(unit: Column, inclusion: Column) -> Column:
    """``Q / (1 + Q)`` of the Pareto ranking variable: random odds over inclusion odds."""
    q = (unit / (1.0 - unit)) / (inclusion / (1.0 - inclusion))
    return F.when((inclusion > 0) & (inclusion < 1), q / (1.0 + q))


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                  cap: int = CAP, weight_col: str | None = None, salt: str = SALT,
                  carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``.

    ``carry`` names columns to hand through in a struct ``carried``;
    ``weight_col`` gives documents unequal expected copies (null or negative:
    zero).  A document without words is never taken.  Null sources are one
    source of their own.  Repeated rows count as often as they occur; rows equal in
    id, text and source are interchangeable.  An empty table gives no rows.
    """
    weight = F.lit(1.0) if weight_col is None else F.greatest(
        F.coalesce(F.col(f"`{weight_col}`").cast("double"), F.lit(0.0)), F.lit(0.0))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))
    columns = ["doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
               weight.alias("weight"), unit_hash(key, salt).alias("unit")]
    if not carry:
        base = stored(docs.select(*columns), "mix-sizes")
        narrow = base
    else:  # texts are carried by a second scan, not through the sums
        narrow = stored(docs.select(*columns), "mix-sizes")
        base = docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried"))
    targets = stored(source_targets(narrow, weights, share, cap), "mix-targets")

    def ranked(rows: DataFrame) -> DataFrame:
        met = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])
        if weight_col is None:
            met = met.withColumn("expected", F.when(
                F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        else:
            met = expected_copies(met, cap)
        whole = F.floor("expected")
        rank = pareto_rank(F.col("unit"), F.col("expected") - whole)
        return met.select("*", F.when(F.col("size") > 0, whole).otherwise(0).cast("long").alias("whole"),
                          F.when(F.col("size") > 0, rank).alias("rank")).withColumn(
            "bucket", F.floor(F.col("rank") * F.ceil(F.sqrt("n"))))

    cuts = stored(_cuts(ranked(narrow)), "mix-cuts")
    all_rows = ranked(base)
    met = all_rows.join(cuts, all_rows["source"].eqNullSafe(cuts["cut_source"]), "left")
    inside = F.col("bucket").eqNullSafe(F.col("cut_bucket")) & F.col("bucket").isNotNull()
    out = ["doc_id", "source", "size", "source_size", "target", *(["carried"] if carry else [])]
    plain = met.where(~inside).select(*out, (F.col("whole") + F.when(
        F.col("bucket") < F.coalesce("cut_bucket", F.lit(1 << 62)), 1).otherwise(0)).alias("copies"))
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = met.where(inside).withColumn("before", F.col("cut_before") + before).select(
        *out, (F.col("whole") + F.when(F.col("before") + F.col("size") / 2.0 <= F.col("wanted"), 1)
               .otherwise(0)).alias("copies"))
    return plain.unionByName(edge).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def _cuts(ranked: DataFrame) -> DataFrame:
    """Per source the bucket in which the sampled words reach ``wanted``, and the words before it."""
    # With equal copies the wanted words follow from the source's totals; sums of many
    # doubles would depend on their order.
    wanted = ranked.groupBy("source").agg(
        F.max("target").alias("goal"), F.sum(F.col("whole") * F.col("size")).alias("certain")).select(
        F.col("source").alias("cut_source"), (F.col("goal") - F.col("certain")).alias("wanted"))
    buckets = ranked.where("bucket is not null").groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    running = buckets.withColumn("after", F.sum("words").over(upto))
    met = running.join(wanted, running["source"].eqNullSafe(wanted["cut_source"]))
    return met.where((F.col("after") - F.col("words") <= F.col("wanted")) & (F.col("wanted") < F.col("after"))).select(
        "cut_source", F.col("bucket").alias("cut_bucket"),
        (F.col("after") - F.col("words")).alias("cut_before"), "wanted")


def mixed_corpus(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it has copies, all columns as they are."""
    rows = mix_documents(docs, carry=docs.columns, **options).where("copies > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("carried.*")


#: DuckDB twin of ``mix_documents`` with its defaults.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':mix'), 1, 13))::BIGINT::DOUBLE + 0.5)
           / 4503599627370496.0::DOUBLE AS u FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE k % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS "full" FROM src),
steps AS (
  SELECT *, row_number() OVER byratio AS j,
         sum("full") OVER byratio AS full_upto, sum(weight) OVER byratio AS weight_upto,
         sum(weight) OVER () AS all_weight, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM weighted
  WINDOW byratio AS (ORDER BY "full" / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
stops AS (
  SELECT *, "full" * (all_weight - weight_upto + weight) <= weight * (budget - full_upto + "full") AS stop FROM steps),
cut AS (SELECT coalesce(min(j) FILTER (WHERE NOT stop), max(j) + 1) AS j FROM stops),
filled AS (
  SELECT source, source_size, n, CASE WHEN s.j < cut.j THEN "full" ELSE
         weight * (budget - coalesce(sum(CASE WHEN s.j < cut.j THEN "full" END) OVER (), 0.0))
         / nullif(sum(CASE WHEN s.j < cut.j THEN 0.0 ELSE weight END) OVER (), 0.0) END AS target
  FROM stops s, cut),
expected AS (
  SELECT d.doc_id, d.source, d.size, f.source_size, f.target,
         CASE WHEN f.source_size > 0 THEN f.target / f.source_size ELSE 0.0 END AS e, d.u
  FROM sized d JOIN filled f ON d.source IS NOT DISTINCT FROM f.source),
ranked AS (
  SELECT *, CASE WHEN size > 0 THEN floor(e)::BIGINT ELSE 0 END AS whole,
         CASE WHEN size > 0 AND e - floor(e) > 0 THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS q
  FROM expected),
summed AS (
  SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS wanted,
         sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id, size
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM ranked)
SELECT doc_id, source, size, source_size, target, (whole + (CASE WHEN q IS NOT NULL AND
         before + size / 2.0::DOUBLE <= wanted THEN 1 ELSE 0 END))::BIGINT AS copies,
       ((whole + (CASE WHEN q IS NOT NULL AND before + size / 2.0::DOUBLE <= wanted THEN 1 ELSE 0 END)) * size)::BIGINT AS taken
FROM summed
"""
