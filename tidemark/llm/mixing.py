"""Mixing sources to target weights by Pareto order sampling.

A source's target fixes the expected number of copies of its words. The whole
part of that number is allotted for certain; for the rest each document has
inclusion odds, those of its source times the root of its words, so that longer
documents are likelier to be taken once more. It draws a uniform U keyed by its
content and is ranked by Q, its random odds U / (1 - U) over its inclusion odds.
The documents of smallest Q whose words fill what remains of the target are
taken: a sample of unequal probabilities and of fixed size in words. DataFrame
functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import clear_of, global_rank, small_or_not, written

#: Weights of the sources in code-point order, null last, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Bins of one level of the search for a source's last taken document.
BINS = 1024
#: Rows of a source's last bin that are sorted; more are binned again.
LAST_ROWS = 10_000
#: Equal rows that one task numbers.
EQUAL_ROWS = 100_000
#: Levels at most: 1024**5 bins tell 52-bit ranks apart.
LEVELS = 5


def word_count(text: Column) -> Column:
    """Number of runs of characters other than 0x20 and 0x09-0x0D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def allotted(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Adds target: each source's part by weight of share times all sizes,
    stopped at most times its size, the excess shared again by weight.

    Each round fixes the sources above their stop, so it ends; only sums of a
    round reach the driver."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    stop = most * F.col("source_size")
    level: float | None = None
    before = -1
    while True:
        full = F.lit(False) if level is None else F.lit(level) * F.col("weight") >= stop
        fixed, weight, n = sources.agg(
            F.sum(F.when(full, stop).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.sum(full.cast("int"))
        ).first()
        if not weight:
            return sources.withColumn("target", stop)
        if n == before:
            break
        level, before = (share * total - fixed) / weight, n
    return sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), stop))


def digest(seed: int) -> Column:
    """A digest of seed, id and text; rows equal in these share it."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))))


def uniform() -> Column:
    """A number in (0, 1) from 52 bits of the digest of a row and its number
    among equal rows."""
    drawn = F.md5(F.concat_ws(":", "digest", F.col("nth").cast("string")))
    return (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def numbered(rows: DataFrame) -> DataFrame:
    """Each row with a count m as m rows, with the number nth from 0; those of
    a large count are made in several tasks."""
    up_to = lambda low, high: F.explode(F.sequence(low, high - 1))
    few = rows.filter(F.col("m") <= EQUAL_ROWS).withColumn("nth", up_to(F.lit(0).cast("long"), F.col("m")))
    many = rows.filter(F.col("m") > EQUAL_ROWS)
    if not many.head(1):
        return few
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    begun = many.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(EQUAL_ROWS).cast("long")))).repartition(parts, "digest", "_from")
    made = begun.withColumn("nth", up_to(F.col("_from"), F.least(F.col("_from") + EQUAL_ROWS, F.col("m"))))
    return few.unionByName(made.drop("_from"))


def odds_rank() -> Column:
    """Q / (1 + Q), in (0, 1): Pareto rank, monotone in the random odds over
    the inclusion odds."""
    u = F.col("u")
    q = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")) * F.sqrt(F.col("size").cast("double")))
    return F.when((F.col("p") > 0) & (F.col("p") < 1) & (F.col("size") > 0), q / (1 + q))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 20) -> DataFrame:
    """Copies of each document such that each source's words come near its
    target. Returns doc_id, source, size, source_size, target, copies, taken,
    draw (a hash of the text), m (rows equal in id, source and text) and nth
    (the number among them).

    Null sources are one source, the last; a null or empty text has size 0 and
    takes nothing; a document is never cut, so a source misses its target by
    less than half of one document. Draws are keyed by id, text and, of equal
    rows, their number: reruns agree whatever the partitions, and equal rows
    are drawn apart. Extra columns are not read. An empty table gives no rows."""
    rows = clear_of(docs, ["doc_id", "text", "source"]).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64(F.col("text")).alias("draw"),
        digest(seed).alias("digest"),
    )
    # equal rows are counted before they meet, then numbered
    equal = written(rows.groupBy("doc_id", "source", "size", "draw", "digest").agg(F.count(F.lit(1)).alias("m")), "mix-equal")
    rows = written(numbered(equal).withColumn("u", uniform()).drop("digest"), "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = global_rank(sources, ["source"], "at", "mix-sources")
    nth = reduce(lambda rest, i: F.when(F.col("at") % len(weights) == i, F.lit(float(weights[i]))).otherwise(rest), range(len(weights)), F.lit(None).cast("double"))
    sources = written(sources.withColumn("weight", nth), "mix-weights")
    sources = allotted(sources, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = sources.select(
        "source", "source_size", "target",
        F.floor(ratio).cast("int").alias("whole"),
        (ratio - F.floor(ratio)).alias("p"),
        (F.col("target") - F.floor(ratio) * F.col("source_size")).alias("rest"),
    )
    plan = written(plan, "mix-plan")
    same = F.col("source").eqNullSafe(F.col("of"))
    drawn = rows.join(small_or_not(plan.withColumnRenamed("source", "of")), same).drop("of").withColumn("rank", odds_rank())
    cut = written(last_ranks(drawn, plan).withColumnRenamed("source", "of"), "mix-cut")
    joined = drawn.join(small_or_not(cut), same, "left").drop("of")
    copies = F.col("whole") + F.when(F.col("rank") <= F.col("last"), 1).otherwise(0)
    return joined.withColumn("copies", copies).select(
        "doc_id", "source", "draw", "m", "nth", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


def last_ranks(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source the greatest rank that is taken: that whose running words
    come nearest to the rest of the target.

    The ranks are counted in bins; only the bin in which the rest ends is
    binned again, until its rows are few, and these are sorted."""
    by = Window.partitionBy("source").orderBy("bin")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    state = plan.filter("p > 0").select("source", "rest", F.lit(0.0).alias("low"), F.lit(1.0).alias("width"), F.lit(0).cast("long").alias("done"))
    found: DataFrame | None = None
    live = drawn.filter("rank is not null and size > 0").select("source", "rank", "size")
    for level in range(LEVELS):
        edge = small_or_not(state.withColumnRenamed("source", "of"))
        inside = live.join(edge, F.col("source").eqNullSafe(F.col("of"))).filter("rank >= low and rank < low + width")
        bins = inside.withColumn("bin", F.least(F.floor((F.col("rank") - F.col("low")) / (F.col("width") / BINS)), F.lit(BINS - 1)).cast("int"))
        sums = bins.groupBy("source", "bin").agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"),
            *[F.first(c).alias(c) for c in ("rest", "low", "width", "done")])
        sums = sums.withColumn("to", F.col("done") + F.sum("words").over(by)).withColumn("from", F.col("done") + F.coalesce(F.sum("words").over(before), F.lit(0)))
        ends = sums.filter(F.col("from") < F.col("rest")).withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("bin")))).filter("nth = 1")
        state = written(ends.select(
            "source", "rest", (F.col("low") + F.col("bin") * F.col("width") / BINS).alias("low"),
            (F.col("width") / BINS).alias("width"), F.col("from").alias("done"), "n"), f"mix-level{level}")
        if level + 1 < LEVELS and (state.agg(F.max("n")).first()[0] or 0) > LAST_ROWS:
            state = state.drop("n")
            continue
        found = state.drop("n")
        break
    edge = small_or_not(found.withColumnRenamed("source", "of"))
    near = live.join(edge, F.col("source").eqNullSafe(F.col("of"))).filter("rank >= low and rank < low + width")
    near = near.groupBy("source", "rank").agg(F.sum("size").alias("size"), *[F.first(c).alias(c) for c in ("rest", "low", "done")])
    running = Window.partitionBy("source").orderBy("rank")
    near = near.withColumn("to", F.col("done") + F.sum("size").over(running))
    near = near.withColumn("off", F.abs(F.col("to") - F.col("rest")))
    below = F.abs(F.col("done") - F.col("rest"))
    best = near.groupBy("source").agg(F.min_by(F.struct("rank", "off"), F.struct("off", "rank")).alias("b"), F.first("low").alias("low"), F.min(below).alias("below"))
    # where no row of the bin brings the words nearer, the last is just below it
    return best.select("source", F.when(F.col("b.off") < F.col("below"), F.col("b.rank")).otherwise(F.col("low") * (1 - 2.0**-50)).alias("last"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with all
    their columns, clashing names included.

    Rows equal in id, source and text are numbered, and each taken by its
    number; nulls are equal. An empty table gives no rows."""
    names = {"doc_id": "_id", "draw": "_draw", "source": "_source", "copies": "_copies", "m": "_m", "nth": "_nth"}
    plan = written(mix(docs, **how).select(*[F.col(a).alias(b) for a, b in names.items()]), "mix-copies")
    # the row goes along as one value, so that no column of its own can clash
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    row = F.col("row")
    same = row["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(row["text"]) == F.col("_draw")) & row["source"].cast("string").eqNullSafe(F.col("_source"))
    taken = keyed.join(plan.filter("_m = 1 and _copies > 0"), same).select("row", "_copies")
    equal = plan.filter("_m > 1")
    if equal.head(1):
        some = keyed.join(small_or_not(written(equal.select("_id", "_draw", "_source").distinct(), "mix-repeated")), same)
        group = F.md5(F.concat_ws(":", F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("_draw").cast("string"), F.coalesce(F.concat(F.lit("s"), F.col("_source")), F.lit(""))))
        ranked = global_rank(some.select("row", group.alias("_group")), ["_group"], "_place", "mix-ranked", within="_group")
        wanted = equal.filter("_copies > 0").select(group.alias("_of"), "_nth", "_copies")
        taken = taken.unionByName(ranked.join(wanted, (F.col("_group") == F.col("_of")) & (F.col("_place") == F.col("_nth"))).select("row", "_copies"))
    made = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_nth"))
    return made.select(*[made["row"].getField(c).alias(c) for c in docs.columns])


#: DuckDB SQL of op5 over documents: sources fill up in the order in which a
#: rising level would stop them, and a source's sample ends nearest to its rest.
ORACLE = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    (('0x' || substr(md5(md5('20:' || COALESCE(doc_id::VARCHAR, '') || ':' || COALESCE(text, '')) || ':' || nth), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM (SELECT doc_id, source, text, row_number() OVER (PARTITION BY doc_id, source, text) - 1 AS nth FROM documents)),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighted AS (
  SELECT *, list_extract([5, 2, 1], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM sources),
filled AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS stop,
    ((SELECT 1.5::DOUBLE * sum(source_size) FROM sources) - COALESCE(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
targets AS (
  SELECT source, source_size, LEAST(COALESCE((SELECT arg_min(level, stop) FROM filled WHERE level < stop), 'infinity'::DOUBLE) * weight, 2.0::DOUBLE * source_size) AS target FROM filled),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM targets),
ranked AS (
  SELECT docs.*, source_size, target, floor(ratio) AS whole, ratio - floor(ratio) AS p, target - floor(ratio) * source_size AS rest FROM docs JOIN plan ON docs.source IS NOT DISTINCT FROM plan.source),
odds AS (
  SELECT *, CASE WHEN p > 0 AND p < 1 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p) * sqrt(size::DOUBLE)) END AS q FROM ranked),
running AS (
  SELECT source, q, rest, sum(size) OVER (PARTITION BY source ORDER BY q) AS words FROM odds WHERE q IS NOT NULL),
cuts AS (
  SELECT source, arg_min(q, struct_pack(off := abs(words - rest), words := words)) AS last
  FROM (SELECT * FROM running UNION ALL SELECT DISTINCT source, -1.0, rest, 0 FROM running) GROUP BY source)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN q <= last THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM odds LEFT JOIN cuts ON odds.source IS NOT DISTINCT FROM cuts.source
"""
