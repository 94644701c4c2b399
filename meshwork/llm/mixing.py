"""Mixing sources to target weights by Pareto order sampling.

A source's target is a number of words. Every document has an expected number
of copies, at most two: its size class times a factor that makes the expected
words meet the target. The whole part of it is certain. For the rest, documents
are ranked by their random odds divided by their inclusion odds, and the first
of them are taken until the source's remaining words are met (a fixed size, in
words, with unequal probabilities); one document more or less then brings the
words as near to the target as it can.

DataFrame operations only. No source is ever sorted as a whole: the ranking
number is cut into buckets, whole buckets are decided by their word totals, and
only the documents of the one bucket where the target falls are sorted. What a
document gets follows from its source, id and size and from small tables (a row
a source, and the rows of those buckets), so the texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.llm.common import n_words, uniform
from meshwork.runtime import materialise, small_join

#: The most copies that a document can have, the share of all words that is shared out, and the sources' weights in turn.
MOST_COPIES, SHARE, WEIGHTS = 2, 1.5, (5, 2, 1)
#: Buckets of the ranking number for each source at least, and the rows that one may hold on average; one a source is sorted.
BUCKETS, BUCKET_ROWS = 4096, 50_000


def size_class(size: Column) -> Column:
    """The size's number of binary digits: longer documents are likelier, far below in proportion."""
    return F.length(F.bin(size)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source_key, source_size, target) from (source_key, source, size) rows.

    Sources take the weights in turn, by code point, null last. Words go out by
    weight; what exceeds MOST_COPIES times a source's words is shared again
    among the others. The end of those rounds is one common rate for the
    sources below their limit, found by sorting sources by limit over weight:
    the sources' totals, a row each, go through one task.
    """
    per_source = sizes.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.get(F.array(*[F.lit(x) for x in WEIGHTS]), F.pmod(turn, F.lit(len(WEIGHTS)))).cast("double")
    limit = (F.col("source_size") * MOST_COPIES).cast("double")
    by_ratio = Window.orderBy("__ratio", "__turn")
    up_to = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    df = per_source.select("*", turn.alias("__turn"), weight.alias("__weight"), limit.alias("__limit"))
    df = df.withColumn("__ratio", F.col("__limit") / F.col("__weight"))
    everything = Window.partitionBy()
    rate = (F.lit(SHARE) * F.sum("source_size").over(everything) - F.coalesce(F.sum("__limit").over(up_to), F.lit(0.0))) / F.sum("__weight").over(onward)
    df = df.withColumn("__rate", rate)
    # the first source, in this order, that stays below its limit sets the rate
    common = F.min(F.when(F.col("__rate") <= F.col("__ratio"), F.struct("__ratio", "__turn", "__rate"))).over(everything)["__rate"]
    return df.withColumn("__common", common).select(
        "source_key", "source_size", F.coalesce(F.least("__limit", F.col("__common") * F.col("__weight")), F.col("__limit")).alias("target")
    )


def factors(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """(source_key, factor, whole_from): expected copies are factor * size class, MOST_COPIES from that size on."""
    classes = sizes.where("size > 0").groupBy("source_key", size_class(F.col("size")).alias("cls")).agg(F.sum("size").alias("words"))
    df = classes.join(goal, "source_key")
    down = Window.partitionBy("source_key").orderBy(F.col("cls").desc())
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("cls")).over(down.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("factor", (F.col("target") - F.lit(float(MOST_COPIES)) * above) / rest)
    # classes from the top reach MOST_COPIES until one stays below it
    fits = F.when(F.col("factor") * F.col("cls") <= MOST_COPIES, F.struct((-F.col("cls")).alias("down"), "factor", "cls"))
    best = df.groupBy("source_key").agg(F.min(fits).alias("best"))
    return best.select("source_key", F.col("best.factor").alias("factor"), F.col("best.cls").alias("top_class"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    source = F.col(source_col)
    key = F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))
    return docs.select(*more, F.col(id_col).alias("id"), source.alias("source"), key.alias("source_key"), n_words(F.col(text_col)).alias("size"))


def placed(df: DataFrame, buckets: int, seed: str) -> DataFrame:
    """``df`` (id, size, factor, top_class) with the certain copies and, where one more is open, its place in [0, 1) and bucket."""
    cls, most = size_class(F.col("size")), F.lit(float(MOST_COPIES))
    expected = F.when(F.col("size") == 0, F.lit(0.0)).when(cls > F.coalesce("top_class", F.lit(0)), most).otherwise(F.least(most, F.col("factor") * cls))
    df = df.withColumn("expected", expected).withColumn("certain", F.floor("expected").cast("long")).withColumn("p", F.col("expected") - F.col("certain"))
    df = df.withColumn("u", uniform(seed, F.col("id")))
    # q / (1 + q) for q = (u / (1 - u)) / (p / (1 - p)): the same order, within [0, 1)
    place = F.col("u") * (1 - F.col("p")) / (F.col("u") * (1 - F.col("p")) + (1 - F.col("u")) * F.col("p"))
    df = df.withColumn("place", F.when(F.col("p") > 0, place))
    return df.withColumn("bucket", F.when(F.col("place").isNotNull(), F.least(F.floor(F.col("place") * buckets), F.lit(buckets - 1)).cast("long")))


def with_more(df: DataFrame, line: DataFrame) -> DataFrame:
    """``df`` (placed, with its source's ``cut``) with ``more``: whether the open copy is taken. ``line`` has the decisions of the cut buckets."""
    on = F.col("source_key").eqNullSafe(F.col("line_source")) & F.col("id").eqNullSafe(F.col("line_id")) & (F.col("size") == F.col("line_size"))
    df = small_join(df, line, on, "left")
    more = F.when(F.col("bucket").isNull(), 0).when(F.col("cut").isNull() | (F.col("bucket") < F.col("cut")), 1).when(F.col("bucket") > F.col("cut"), 0).otherwise(F.col("line_more"))
    return df.withColumn("more", more.cast("long"))


def rules(sizes: DataFrame, seed: str) -> tuple[DataFrame, DataFrame, int]:
    """What decides on every document of ``sizes`` (materialised): a row a source, the cut buckets' rows, the number of buckets."""
    buckets = max(BUCKETS, -(-sizes.count() // BUCKET_ROWS))
    goal = materialise(targets(sizes), "targets")
    params = materialise(goal.join(factors(sizes, goal), "source_key", "left"), "factors")
    df = placed(small_join(sizes, params, "source_key"), buckets, seed)
    df = materialise(df.select("id", "source_key", "size", "target", "certain", "place", "bucket"), "ranked")
    # words still wanted, by source, and the bucket in which they are met
    totals = df.groupBy("source_key", "bucket").agg(
        F.sum(F.when(F.col("place").isNotNull(), F.col("size")).otherwise(0)).alias("words"), F.sum(F.col("certain") * F.col("size")).alias("sure"), F.first("target").alias("target")
    )
    whole = Window.partitionBy("source_key")
    run = Window.partitionBy("source_key").orderBy(F.col("bucket").asc_nulls_first())
    steps = totals.withColumn("left", F.col("target") - F.sum("sure").over(whole)).withColumn("before", F.sum("words").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    cut = steps.where("bucket IS NOT NULL AND before + words > left").groupBy("source_key").agg(F.min(F.struct("bucket", "before", "left")).alias("cut"))
    cuts = materialise(cut.select("source_key", F.col("cut.bucket").alias("cut"), F.col("cut.before").alias("before"), F.col("cut.left").alias("left")), "cuts")
    df = small_join(df, cuts, "source_key", "left")
    # rows that repeat source, id and size are one entry; it is in when more than half of it is wanted
    entries = df.where("bucket = cut").groupBy("source_key", "id", "size", "place").agg(F.sum("size").alias("words"), F.first("before").alias("before"), F.first("left").alias("left"))
    upto = F.sum("words").over(Window.partitionBy("source_key").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, 0))
    chosen = entries.select("source_key", "id", "size", (F.col("before") + upto - F.col("words") / 2 <= F.col("left")).cast("long").alias("more"))
    line = materialise(chosen.toDF("line_source", "line_id", "line_size", "line_more"), "line")
    drawn = materialise(with_more(df, line).select("id", "source_key", "size", "target", "certain", "place", "more"), "drawn")
    # the last step of a source: one entry more or less where that brings the words nearer to the target
    gaps = materialise(drawn.groupBy("source_key").agg((F.first("target") - F.sum((F.col("certain") + F.col("more")) * F.col("size"))).alias("gap")), "gaps")
    open_ = small_join(drawn, gaps, "source_key")
    miss = F.abs(F.abs("gap") - F.col("size"))
    able = F.col("place").isNotNull() & (F.col("more") == F.when(F.col("gap") > 0, 0).otherwise(1)) & (miss < F.abs("gap"))
    best = open_.where(able).groupBy("source_key").agg(F.min(F.struct(miss.alias("miss"), "place", "id", "size")).alias("x"))
    best = materialise(best.select(F.col("source_key").alias("key"), F.col("x.id").alias("last_id"), F.col("x.size").alias("last_size")), "best")
    # the entry may stand for several rows
    mine = (F.col("source_key") == F.col("key")) & F.col("id").eqNullSafe(F.col("last_id")) & (F.col("size") == F.col("last_size"))
    words = small_join(open_, best, mine).groupBy("key", "last_id", "last_size").agg(F.sum("size").alias("words"), F.first("gap").alias("gap"))
    last = words.where(F.abs(F.abs("gap") - F.col("words")) < F.abs("gap")).select(F.col("key").alias("source_key"), "last_id", "last_size")
    table = params.join(cuts.select("source_key", "cut"), "source_key", "left").join(last, "source_key", "left")
    return materialise(table, "rules"), line, buckets


def decided(df: DataFrame, table: DataFrame, line: DataFrame, buckets: int, seed: str) -> DataFrame:
    """``df`` (id, source_key, size and others) with source_size, target, copies and taken: a projection but for the small tables."""
    df = with_more(placed(small_join(df, table, "source_key"), buckets, seed), line)
    turned = F.col("last_size").isNotNull() & F.col("id").eqNullSafe(F.col("last_id")) & (F.col("size") == F.col("last_size"))
    more = F.when(turned, 1 - F.col("more")).otherwise(F.col("more"))
    return df.withColumn("copies", F.col("certain") + more).withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """One row per document: id, size, source_size, target, copies, taken.

    Size is the number of words (null and empty texts: 0, never taken, no
    copies). Null is a source of its own, the last. Equal ids, null among them,
    have equal random numbers; rows that repeat source, id and size are taken
    alike, whatever else differs. An empty table gives an empty result; further
    columns are ignored. The same seed gives the same mix. A text is counted
    where it stands, whatever its length.
    """
    sizes = materialise(sized(docs, id_col, text_col, source_col), "sizes")
    return decided(sizes, *rules(sizes, seed), seed).select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", "taken")


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """``docs`` with each row as often as the mix takes it, with its columns, whatever their names.

    Null and repeated ids are taken as ``mix`` says: a row of its own each.
    """
    sizes = materialise(sized(docs, id_col, text_col, source_col), "sizes")
    rows = sized(docs, id_col, text_col, source_col, F.struct("*").alias("row"))
    taken = decided(rows, *rules(sizes, seed), seed).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")
