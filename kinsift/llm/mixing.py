"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Targets: the weights share `share` times the size of everything; a source's target stops at `most`
times its own size and what it can't take is shared again by weight. That is water-filling, and in the
order of size over weight one pass of running sums over the table of sources settles it.

Copies: a document of size s in a source whose target is f times its size gets floor(f) certain whole
copies. The rest is drawn without replacement with unequal inclusion probabilities p = min(1, c * w),
w = log2(2 + s), where c makes the expected words of the draw the words that are missing; documents
whose p reaches 1 are certain too. Pareto order sampling ranks the documents of a source by

    (u / (1 - u)) / (p / (1 - p)),   u uniform from a hash of the document's id,

and takes them from the lowest rank on. The size that is fixed is the number of words: the draw ends
before the document that would exceed what is missing, and the two documents further down that fit the
remaining gap best, one after the other, close it.

Scale: a source may hold a third of the rows, so no source is ever sorted or summed by one task. Ranks
fall into bands by r / (1 + r); words per source and band are summed (on the map side first), running
sums over bands find the band in which the draw ends, and only that band's rows are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kinsift.llm.common import WORD, read, word_count
from kinsift.storage import materialize

#: Bands of the ranks of a source, and how many of them are summed up together.
BANDS, COARSE = 4096, 64
#: Rounds that settle which documents are certain.
ROUNDS = 3


def source_order() -> list[Column]:
    """Sources by code point, null last."""
    return [F.col("source").asc_nulls_last()]


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sources (source, source_size) with `target`. Sources of size 0 get 0."""
    ranked = sources.withColumn("nth", F.row_number().over(W.orderBy(*source_order())) - 1)
    weight = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("cap") / F.col("weight"), "nth")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(1))
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(after))
        .withColumn("capped", F.col("left") * F.col("weight") >= F.col("cap") * F.col("open"))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0)))
        .withColumn("level", F.col("rest") / F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything))
    )
    return ranked.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 from a hash of the id; the same in every run."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def copies(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: bool = True,
) -> DataFrame:
    """(row, size, source_size, target, copies) for every row of docs; row holds all its columns.

    size: words; null and empty texts have 0 and are taken 0 words. A null source is a source. Rows with
    equal or null ids and equal sizes share a rank, and a draw that ends among them takes some of them,
    it doesn't matter which. Where everything has size 0 all targets are 0. An empty table gives an empty
    result. Only the three named columns are looked at. Without `carry`, row holds id and source alone
    and texts are read once.
    """
    sized = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = sized.withColumn("w", F.log2(F.col("size") + 2.0)).withColumn("u", uniform(F.col("id"), seed))
    rows = materialize(sized.drop("row"), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = materialize(targets(sources, weights, share, most), "targets")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("base", F.floor(times + 1e-12).cast("long"))
    plan = plan.withColumn("missing", F.greatest(F.lit(0.0), F.col("target") - F.col("base") * F.col("source_size")))
    plan = plan.withColumn("missing", F.when(F.col("missing") < 0.5, 0.0).otherwise(F.col("missing")))

    # c of p = min(1, c * w): what is missing after the certain ones, over the weighted words of the others.
    factors = plan.select("source", "base", "missing", "source_size", "target", F.lit(0.0).alias("c"))
    for _ in range(ROUNDS):
        certain = F.col("c") * F.col("w") >= 1
        sums = _with(rows, factors).where("missing > 0").groupBy("source").agg(
            F.sum(F.when(certain, F.col("size")).otherwise(0)).alias("sure"),
            F.sum(F.when(~certain, F.col("size") * F.col("w")).otherwise(0.0)).alias("spread"),
        )
        c = F.when((F.col("spread") > 0) & (F.col("missing") > F.col("sure")), (F.col("missing") - F.col("sure")) / F.col("spread"))
        factors = _with(factors.drop("c"), sums, "left").withColumn("c", F.coalesce(c, F.lit(0.0))).drop("sure", "spread")
        factors = materialize(factors, "factors")

    p = F.least(F.lit(1.0), F.col("c") * F.col("w"))
    r = F.when(p >= 1, 0.0).otherwise(F.col("u") / (1 - F.col("u")) * (1 - p) / p)
    rank = F.when((F.col("missing") > 0) & (F.col("c") > 0) & (F.col("size") > 0), r / (1 + r))
    drawn = _with(rows, factors).withColumn("rank", rank).where("rank IS NOT NULL").withColumn("band", F.floor(F.col("rank") * BANDS).cast("int"))

    # Running sums over a source's bands, in two levels of at most BANDS / COARSE and COARSE rows.
    bands = drawn.groupBy("source", "band").agg(F.sum("size").alias("words"), F.first("missing").alias("need"))
    bands = bands.withColumn("part", F.floor(F.col("band") / COARSE).cast("int"))
    parts = bands.groupBy("source", "part").agg(F.sum("words").alias("in_part"))
    parts = parts.withColumn("so_far", F.sum("in_part").over(W.partitionBy("source").orderBy("part")) - F.col("in_part"))
    parts = parts.select(F.col("part").alias("p"), "so_far", "source")
    bands = _with(bands.withColumn("p", F.col("part")), parts, also="p")
    within = F.sum("words").over(W.partitionBy("source", "part").orderBy("band")) - F.col("words")
    bands = bands.withColumn("before", F.col("so_far") + within)
    last = materialize(bands.where("before < need AND before + words >= need").select("source", "band", "before"), "last")
    inside = drawn.join(last.select(F.col("source").alias("s"), F.col("band").alias("b"), "before"), F.col("source").eqNullSafe(F.col("s")) & (F.col("band") == F.col("b")))
    run = F.sum("size").over(W.partitionBy("source", "band").orderBy("rank", "id")) + F.col("before")  # rows of equal rank and id together
    fits = F.when(F.col("run") < F.col("missing"), F.struct("run", F.col("rank").alias("rank"), "id"))
    ends = inside.withColumn("run", run).groupBy("source").agg(F.max(fits).alias("end"), F.first("before").alias("before"), F.first("band").alias("band"))
    # Where no row of the last band fits any more, the draw ends where that band begins.
    ends = ends.select(
        "source",
        F.coalesce(F.col("end.rank"), F.col("band") / F.lit(float(BANDS))).alias("end_rank"),
        F.col("end.id").alias("end_id"),
        F.col("end").isNull().alias("open"),
        F.coalesce(F.col("end.run"), F.col("before")).alias("got"),
    )
    ends = _with(factors, ends, "left").withColumn("gap", F.when(F.col("got").isNotNull(), F.col("missing") - F.col("got")).otherwise(0.0))
    ends = materialize(ends, "ends")

    here = F.struct("rank", "id")
    inner = F.col("got").isNull() | (F.col("rank") < F.col("end_rank")) | (~F.col("open") & (F.col("rank") == F.col("end_rank")) & (F.col("id") <= F.col("end_id")))
    known = [c for c in ends.columns if c not in ("source", "base", "missing", "source_size", "target", "c")]
    drawn = drawn.select(*(c for c in drawn.columns if c not in known))
    state, picks = ends.withColumn("picks", F.array().cast(f"array<struct<rank:double,id:{dict(rows.dtypes)['id']}>>")), 2
    for _ in range(picks):
        others = _with(drawn, state.select("source", *known, "picks")).where(~F.coalesce(inner, F.lit(False)) & ~F.array_contains("picks", here) & (F.col("gap") > 0))
        off = F.abs(F.col("size") - F.col("gap"))
        best = others.where(off < F.col("gap")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "rank", "id", "size")).alias("best"))
        state = _with(state, best, "left").withColumn("picks", F.when(F.col("best").isNull(), F.col("picks")).otherwise(F.concat("picks", F.array(F.struct("best.rank", "best.id")))))
        state = materialize(state.withColumn("gap", F.col("gap") - F.coalesce(F.col("best.size"), F.lit(0))).drop("best"), "picks")

    # Documents meet the small table of sources alone, so their texts are not shuffled.
    full = _with(_with(sized if carry else rows.withColumn("row", F.struct("id", "source")), factors).withColumn("rank", rank), state.select("source", *known, "picks"))
    extra = F.col("rank").isNotNull() & (F.coalesce(inner, F.lit(False)) | F.array_contains("picks", here))
    number = F.col("base") + F.coalesce(extra, F.lit(False)).cast("long")
    return full.select("row", "size", "source_size", "target", number.alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs with every row as often as the mix takes it, and no row that it doesn't take.

    Null texts and texts without words have no size and are never taken; a null source is a source like any
    other, null ids and repeated rows are rows like any other. An empty table gives an empty result. Other
    columns come along, whatever their names.
    """
    found = copies(docs, **options)
    return found.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def _with(left: DataFrame, right: DataFrame, how: str = "inner", also: str | None = None) -> DataFrame:
    """left with the columns that right has for its source, and for its value of `also`; a null source meets the null source."""
    other = right.withColumnRenamed("source", "_source")
    same = left["source"].eqNullSafe(other["_source"])
    if also:
        other = other.withColumnRenamed(also, "_also")
        same &= left[also] == other["_also"]
    return left.join(other, same, how).drop("_source", "_also")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    found = copies(read(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0, carry=False)
    return found.select(F.col("row.id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def _op8_sql(weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, picks: int = 2) -> str:
    """The same mix without bands: every source is ordered whole."""
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    steps = [f"""d AS (
      SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
        (CAST('0x' || substr(md5('{seed}:' || doc_id), 1, 12) AS BIGINT) + 0.5::DOUBLE) / {2**48}.0::DOUBLE AS u FROM documents
    ), s AS (
      SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {weight} END AS DOUBLE) AS weight FROM d GROUP BY source
    ), s1 AS (
      SELECT *, {most}::DOUBLE * source_size AS cap, {share}::DOUBLE * sum(source_size) OVER () - coalesce(sum({most}::DOUBLE * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM s WINDOW w AS (ORDER BY {most}::DOUBLE * source_size / weight, source NULLS LAST)
    ), s2 AS (SELECT *, rest * weight >= cap * open AS capped FROM s1),
    s3 AS (
      SELECT *, CASE WHEN capped THEN cap ELSE weight * (({share}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) FILTER (capped) OVER (), 0)) / sum(weight) FILTER (NOT capped) OVER ()) END AS target FROM s2
    ), s4 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS base FROM s3),
    f0 AS (SELECT source, source_size, target, base, CASE WHEN target - base * source_size < 0.5 THEN 0 ELSE target - base * source_size END AS missing, 0.0::DOUBLE AS c FROM s4),
    e AS (SELECT *, log2(size + 2.0::DOUBLE) AS w FROM d)"""]
    for i in range(ROUNDS):
        steps.append(f"""g{i} AS (
          SELECT e.source, sum(CASE WHEN c * w >= 1 THEN size ELSE 0 END) AS sure, sum(CASE WHEN c * w >= 1 THEN 0 ELSE size * w END) AS spread
          FROM e JOIN f{i} ON e.source IS NOT DISTINCT FROM f{i}.source WHERE missing > 0 GROUP BY e.source
        ), f{i + 1} AS (
          SELECT f.source, source_size, target, base, missing, CASE WHEN spread > 0 AND missing > sure THEN (missing - sure) / spread ELSE 0 END AS c
          FROM f{i} f LEFT JOIN g{i} g ON f.source IS NOT DISTINCT FROM g.source
        )""")
    steps.append(f"""r0 AS (
      SELECT e.*, f.source_size, f.target, f.base, f.missing, CASE WHEN missing > 0 AND c > 0 AND size > 0 THEN CASE WHEN c * w >= 1 THEN 0 ELSE u / (1 - u) * (1 - c * w) / (c * w) END END AS r
      FROM e JOIN f{ROUNDS} f ON e.source IS NOT DISTINCT FROM f.source
    ), r1 AS (SELECT *, r / (1 + r) AS rank FROM r0),
    r2 AS (SELECT *, CASE WHEN rank IS NOT NULL THEN sum(size) FILTER (rank IS NOT NULL) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id) END AS run FROM r1),
    t0 AS (
      SELECT source, CASE WHEN count(*) FILTER (run >= missing) > 0 THEN any_value(missing) - coalesce(max(run) FILTER (run < missing), 0) ELSE 0 END AS gap FROM r2 GROUP BY source
    ), x0 AS (SELECT *, rank IS NOT NULL AND run < missing AS extra FROM r2)""")
    for i in range(picks):
        steps.append(f"""b{i} AS (
          SELECT x.source, arg_min({{'rank': rank, 'id': doc_id, 'size': size}}, {{'off': abs(size - gap), 'rank': rank, 'id': doc_id, 'size': size}}) AS best
          FROM x{i} x JOIN t{i} t ON x.source IS NOT DISTINCT FROM t.source WHERE rank IS NOT NULL AND NOT extra AND gap > 0 AND abs(size - gap) < gap GROUP BY x.source
        ), t{i + 1} AS (SELECT t.source, gap - coalesce(best.size, 0) AS gap FROM t{i} t LEFT JOIN b{i} b ON t.source IS NOT DISTINCT FROM b.source),
        x{i + 1} AS (
          SELECT x.* REPLACE (extra OR coalesce(best.rank = rank AND best.id = doc_id, false) AS extra) FROM x{i} x LEFT JOIN b{i} b ON x.source IS NOT DISTINCT FROM b.source
        )""")
    return f"WITH {', '.join(steps)} SELECT doc_id, size, source_size, target, CAST((base + CASE WHEN extra THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM x{picks}"


OP8_SQL = _op8_sql()
