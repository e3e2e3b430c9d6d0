"""Mixing sources to target weights. Native: DataFrame functions only.

Capped water-filling over the sources' table; then whole repetitions of every document, and for the fractional one a
seeded order: documents fall into hash bins, bins below the source's cut are taken whole, the bin at the cut gives the
rest in equal shares, rounded by a hash of each row, and rows alike together, so that a source's words meet its target to
rounding. No task needs the documents of a source together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm.common import WORD, text_of, written

BINS = 256
#: Hex digits of the bins that the bin at a cut is dealt into.
FINE_DIGITS = 4
#: Rows alike that one row stands for when they are made again.
ALIKE = 65_536
#: Columns of the result; those of the input that have these names give way.
ADDED = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def hex_number(seed: str, doc_id: Column, start: int, digits: int) -> Column:
    """A whole number from the hex digits of a seeded hash of the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), start, digits), 16, 10).cast("long")


def water_fill(sizes: DataFrame, most_epochs: int = 3, total: int | None = None) -> DataFrame:
    """Targets for ``sizes`` (source, size, weight): shares of ``total`` (all sizes) by weight, none above
    ``most_epochs`` times its size; what a clamped source can't take is dealt again by weight until none is above.

    In the order of the level at which a source is full, those before the first that isn't are clamped; that one row comes
    to the driver. Sources of size 0 have target 0.
    """
    order = Window.orderBy(F.lit(float(most_epochs)) * F.col("size") / F.col("weight"), F.col("source").asc_nulls_last())  # a row a source
    cap = F.col("size") * most_epochs
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) if total is None else F.lit(total)
    filled = sizes.where("size > 0").select("weight", cap.alias("cap"), F.row_number().over(order).alias("k"), (whole - F.coalesce(F.sum(cap).over(before), F.lit(0))).alias("rest"), F.sum("weight").over(on).alias("free"))
    level = filled.where(F.col("rest").cast("double") / F.col("free") * F.col("weight") < F.col("cap")).agg(F.min(F.struct("k", "rest", "free")).alias("l")).select("l.*").first()
    share = F.col("weight").cast("double") * F.lit(float(level["rest"])) / F.lit(float(level["free"])) if level["k"] else F.lit(float("inf"))
    return sizes.select("source", "size", "weight", F.when(F.col("size") > 0, F.least(share, cap.cast("double"))).otherwise(0.0).alias("target"))


def planned(docs: DataFrame, weights: Sequence[int], most_epochs: int, seed: str, id_column: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` with size and bin, and what the mix takes of each source's bins."""
    sized = docs.withColumns({"size": word_count(text_of()), "_mix_bin": hex_number(seed, F.col(id_column), 1, 2)})
    bins = written(sized.groupBy("source", "_mix_bin").agg(F.sum("size").alias("words")), "bins")  # BINS rows a source at most
    sources = bins.groupBy("source").agg(F.sum("words").alias("size"))
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1))  # a row a source
    targets = water_fill(written(ranked, "sources"), most_epochs)

    before = F.sum("words").over(Window.partitionBy("source").orderBy("_mix_bin").rowsBetween(Window.unboundedPreceding, -1))
    cut = bins.withColumn("before", F.coalesce(before, F.lit(0))).alias("b").join(targets.alias("t"), F.expr("b.source <=> t.source"))
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long")
    rest = F.col("target") - F.col("whole") * F.col("size")
    share = F.when(F.col("words") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (rest - F.col("before")) / F.col("words")))).otherwise(0.0)
    plan = written(
        cut.withColumn("whole", whole).select(
            F.col("b.source").alias("_mix_plan_source"), F.col("_mix_bin").alias("_mix_plan_bin"), F.col("size").alias("source_size"), "target", F.col("whole").alias("_mix_whole"), share.alias("_mix_share"),
            (rest - F.col("before")).alias("_mix_left"),
        ),
        "plan",
    )
    return sized, plan


def mix(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most_epochs: int = 3, seed: str = "mix", id_column: str = "doc_id"
) -> DataFrame:
    """``docs`` with size, source_size, target and taken added, a row for each row of the input.

    Sources by code point, null last, weigh ``weights`` in turn. An empty text or a source without words has size 0 and
    takes nothing. ``taken`` is whole repetitions times size, plus what the fractional one takes: of the bin at a source's
    cut each row has the same share, rounded by a hash of the whole row; rows alike are rounded together, some of them a
    word higher, so that their sum is right however many they are. An empty table gives an empty result.
    """
    docs = docs.drop(*ADDED)
    sized, plan = planned(docs, weights, most_epochs, seed, id_column)
    in_cut = "_mix_share > 0 AND _mix_share < 1"
    here = F.expr("source <=> _mix_plan_source AND _mix_bin = _mix_plan_bin")
    whole = F.col("_mix_whole") * F.col("size")
    plain = sized.join(plan, here, "left").where(f"NOT coalesce({in_cut}, false)")
    plain = plain.withColumn("taken", whole + F.when(F.col("_mix_share") >= 1, F.col("size")).otherwise(0))
    # a bin a source: rows alike are one row with their number here
    at_cut = docs.withColumn("_mix_bin", hex_number(seed, F.col(id_column), 1, 2)).join(plan.where(in_cut), here)
    alike = at_cut.groupBy(*(f"`{c}`" for c in docs.columns), "source_size", "target", "_mix_whole", "_mix_share").agg(F.count("*").alias("_mix_n")).withColumn("size", word_count(text_of()))
    rest = [c for c in docs.columns if c not in (id_column, "source", "text")]
    others = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rest))) if rest else F.lit("{}")
    row = F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit(":"), text_of(), F.lit(":"), others)
    sum_ = F.floor(F.col("_mix_n") * (F.col("_mix_share") * F.col("size")) + hex_number(f"{seed}:part", row, 1, 6) / F.lit(float(16**6))).cast("long")
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_mix_n") - 1) / ALIKE))
    dealt = alike.withColumns({"_mix_sum": F.least(F.col("_mix_n") * F.col("size"), sum_), "_mix_block": F.explode(blocks)}).repartition("_mix_block", F.xxhash64(row))
    numbers = F.sequence(F.col("_mix_block") * ALIKE + 1, F.least(F.col("_mix_n"), (F.col("_mix_block") + 1) * ALIKE))
    each = dealt.withColumn("_mix_k", F.explode(numbers))
    more = F.when(F.col("_mix_k") <= F.col("_mix_sum") % F.col("_mix_n"), 1).otherwise(0)
    each = each.withColumn("taken", whole + F.floor(F.col("_mix_sum") / F.col("_mix_n")).cast("long") + more)
    return plain.select(*docs.columns, *ADDED).unionByName(each.select(*docs.columns, *ADDED))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix as rows: each document as often as ``taken`` has it whole, and its first words for what is left over."""
    columns = [c for c in mixed.columns if c not in ADDED]
    whole, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    some = mixed.where("size > 0 AND taken > 0").withColumns({"_whole": whole, "_rest": rest})
    full = some.where("_whole > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_whole")))).select(*columns)
    words = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = some.where("_rest > 0").withColumn("text", F.array_join(F.slice(words, F.lit(1), F.col("_rest")), ""))
    if "n_chars" in columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast("long"))
    return full.unionByName(cut.select(*columns))


def mixed_whole(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most_epochs: int = 3, seed: str = "mix", id_column: str = "doc_id"
) -> DataFrame:
    """The mix as rows, whole documents only: each as often as whole repetitions have it, and once more those that the
    fractional one takes. Columns are those of ``docs``, without the names of ADDED.

    The bin at a source's cut is dealt into finer ones by a hash of id and text, and the fine bin at the cut is taken row
    by row while at least half of the row is below the target, so that a source meets it to half a document. Rows alike
    in all columns are told apart by their count alone. Documents without words take no part.
    """
    docs = docs.drop(*ADDED)
    sized, plan = planned(docs, weights, most_epochs, seed, id_column)
    within = F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit(":"), text_of())
    fine = hex_number(f"{seed}:fine", within, 1, FINE_DIGITS)
    at_cut = plan.where("_mix_share > 0 AND _mix_share < 1").select(
        F.col("_mix_plan_source").alias("_mix_cut_source"), F.col("_mix_plan_bin").alias("_mix_cut_bin"), F.col("_mix_left").alias("_mix_cut_left"), F.col("_mix_whole").alias("_mix_cut_whole")
    )  # a row a source
    in_bin = F.expr("source <=> _mix_cut_source AND _mix_bin = _mix_cut_bin")
    fines = written(
        sized.join(at_cut, in_bin).groupBy("_mix_cut_source", "_mix_cut_left", "_mix_cut_whole", "_mix_cut_bin", fine.alias("_mix_cut_fine")).agg(F.sum("size").alias("words")), "fine_bins"
    )  # at most 16 ** FINE_DIGITS rows a source
    before = F.coalesce(F.sum("words").over(Window.partitionBy("_mix_cut_source").orderBy("_mix_cut_fine").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = written(
        fines.withColumn("_mix_cut_left", F.col("_mix_cut_left") - before).where("_mix_cut_left > 0 AND _mix_cut_left <= words").drop("words"), "cuts"
    )  # a row a source

    once = F.when(F.col("_mix_share") >= 1, 1).when(F.col("_mix_share") <= 0, 0).when(fine < F.col("_mix_cut_fine"), 1).otherwise(0)
    here = (F.col("_mix_bin") == F.col("_mix_cut_bin")) & (fine == F.col("_mix_cut_fine"))
    most = (
        sized.where("size > 0").join(plan.drop("source_size", "target"), F.expr("source <=> _mix_plan_source AND _mix_bin = _mix_plan_bin"))
        .join(last, F.expr("source <=> _mix_cut_source"), "left").where(~F.coalesce(here, F.lit(False)))
        .withColumn("_mix_times", F.col("_mix_whole") + once)
    )
    # the rows of one fine bin a source: those alike are one row with their number
    named = docs.withColumn("_mix_bin", hex_number(seed, F.col(id_column), 1, 2))
    few = named.join(last, in_bin).where(fine == F.col("_mix_cut_fine")).groupBy(*docs.columns, "_mix_cut_source", "_mix_cut_left", "_mix_cut_whole").agg(F.count("*").alias("_mix_n"))
    few = few.withColumn("size", word_count(text_of())).where("size > 0")
    order = Window.partitionBy("_mix_cut_source").orderBy(F.md5(within), F.xxhash64(*docs.columns)).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_mix_cut_left") - F.coalesce(F.sum(F.col("size") * F.col("_mix_n")).over(order), F.lit(0))
    some = F.least(F.col("_mix_n"), F.greatest(F.lit(0), F.floor(left / F.col("size") + 0.5)))
    few = few.withColumn("_mix_times", F.col("_mix_cut_whole") * F.col("_mix_n") + some)
    times = lambda rows: rows.where("_mix_times > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_times").cast("int")))).select(*docs.columns)
    return times(most).unionByName(times(few))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with what the mix takes of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h, md5('mix:part:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '') || ':{}') AS g,
         count(*) OVER same AS alike, row_number() OVER same AS number FROM documents WINDOW same AS (PARTITION BY doc_id, source, text)),
e AS (SELECT *, ('0x' || substr(h, 1, 2))::BIGINT AS bin, ('0x' || substr(g, 1, 6))::BIGINT AS u FROM d),
s AS (SELECT source, sum(size)::BIGINT AS size FROM e GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * size / weight, source NULLS LAST) AS k FROM w WHERE size > 0),
c AS (SELECT *, coalesce(sum(3 * size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS held,
             sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS free,
             sum(size) OVER ()::BIGINT AS total FROM o),
l AS (SELECT total - held AS rest, free FROM c WHERE (total - held)::DOUBLE / free * weight < 3 * size ORDER BY k LIMIT 1),
t AS (SELECT w.source, w.size AS source_size, CASE WHEN w.size > 0 THEN least(w.weight::DOUBLE * l.rest::DOUBLE / l.free::DOUBLE, (3 * w.size)::DOUBLE) ELSE 0.0 END AS target FROM w, l),
b AS (SELECT source, bin, sum(size)::BIGINT AS words FROM e GROUP BY source, bin),
f AS (SELECT source, bin, words, coalesce(sum(words) OVER (PARTITION BY source ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM b),
p AS (SELECT f.source, f.bin, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole, words, before
      FROM f JOIN t ON f.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN words > 0 THEN least(1.0, greatest(0.0, (target - whole * source_size - before) / words)) ELSE 0.0 END AS share FROM p),
r AS (SELECT doc_id, size, source_size, target, whole, alike, number, least(alike * size, floor(alike * (share * size) + u / 16777216.0)::BIGINT) AS part
      FROM e JOIN q ON e.source IS NOT DISTINCT FROM q.source AND e.bin = q.bin)
SELECT doc_id, size, source_size, target, (whole * size + part // alike + CASE WHEN number <= part % alike THEN 1 ELSE 0 END)::BIGINT AS taken FROM r
"""
