"""Quality rules: base rules, then a hashed n-gram likelihood ratio.

Word n-grams (one and two words) are hashed to a fixed number of buckets. Two
multinomials over the buckets are counted: one over the trusted texts and one
over the whole raw corpus, every text whole. A document's score is the mean
over its n-grams of log P(bucket | trusted) / P(bucket | raw); it is kept when
the score reaches a fixed threshold. Every language of the raw corpus weighs
what it has among the trusted texts: which languages happen to be labelled says
nothing of a document.

No document is scored by its own n-grams: ids are dealt to FOLDS folds by a
hash, all documents are counted by fold, and a fold is scored by the counts of
the others. Trusted documents are therefore judged as unseen ones are. Counts
are integers and each score is a sum in the order of the text, so that reruns
agree to the last bit.

DataFrame operations only. Scoring is a projection without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import words
from meshwork.runtime import materialise

#: Buckets of the two multinomials; this also bounds what reaches the driver and each task (a double each).
BUCKETS = 8192
#: Documents with a mean log ratio below this go.
THRESHOLD = -0.05
#: Pseudo-count of the trusted multinomial, two a bucket, dealt to the buckets as the raw corpus has them.
PRIOR_WEIGHT = 2.0 * BUCKETS
MIN_WORDS = 50
#: Slots of languages, and folds of documents.
LANGS, FOLDS = 32, 4
#: Labelled documents that serve as the trusted target, at most.
TRUSTED_DOCS = 20_000


def _hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _pairs(h: Column) -> Column:
    """Hashes of neighbouring words, from the words' hashes."""
    return F.transform(F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.xxhash64(F.get(h, i), x))


def _bucket(x: Column) -> Column:
    return F.pmod(x, F.lit(BUCKETS)).cast("int")


def fold_of(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(FOLDS)).cast("int")


def base_columns(rows: DataFrame) -> DataFrame:
    """``rows`` (text and others) with a struct ``base`` of the base figures and the words' hashes ``h``.

    Repeated windows: where a text's three-word windows are not all distinct,
    their hashes are sorted with their places, and equal neighbours are
    repeats. Their places are sorted again, and each adds the words that the
    one before did not cover: n log n for the longest of texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = rows.withColumn("words", words(F.col("text")))
    df = df.withColumn("h", _hashes(F.col("words")))
    h = F.col("h")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.transform(F.slice(h, 3, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(F.get(h, i), F.get(h, i + 1), x))
    df = df.withColumn("lines", lines).withColumn("win", windows)
    v = F.col("win")
    placed = F.sort_array(F.transform(v, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    df = df.withColumn("win", F.when(F.size(v) == F.size(F.array_distinct(v)), F.lit(None)).otherwise(placed))
    same = lambda x, other: F.coalesce(other["h"] == x["h"], F.lit(False))
    twice = F.filter(v, lambda x, i: F.when(i > 0, same(x, F.get(v, i - 1))).otherwise(F.lit(False)) | same(x, F.get(v, i + 1)))
    df = df.withColumn("win", F.sort_array(F.transform(twice, lambda x: x["p"])))
    covered = F.aggregate(
        v,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")),
        lambda a: a["n"],
    )
    return df.withColumn(
        "base",
        F.struct(
            F.size("words").cast("long").alias("n_words"),
            F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
            F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        ),
    ).drop("words", "lines", "win")


def bucket_counts(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, lang_col: str = "lang") -> DataFrame:
    """(lang, bucket, n0.., good0..): how often each bucket occurs in the texts of each fold, and in the trusted ones of it.

    One pass over the corpus; partial counts keep the shuffle to a row for each
    bucket, language and task. ``trusted`` holds TRUSTED_DOCS ids at most.
    Languages are hashed to LANGS slots, null like a language; those that share
    a slot are weighed as one.
    """
    lang = F.pmod(F.xxhash64(F.col(lang_col)), F.lit(LANGS)) if lang_col in docs.columns else F.lit(0)
    rows = docs.select(F.col(id_col).alias("id"), lang.cast("int").alias("lang"), fold_of(id_col).alias("fold"), words(F.col(text_col)).alias("w"))
    marked = rows.join(F.broadcast(trusted), "id", "left").select("lang", "fold", F.coalesce("good", F.lit(0)).alias("good"), _hashes(F.col("w")).alias("h"))
    pieces = marked.select("lang", "fold", "good", F.explode(F.concat(F.col("h"), _pairs(F.col("h")))).alias("piece"))
    counts = pieces.groupBy("lang", "fold", _bucket(F.col("piece")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"))
    own = lambda c, f: F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}")
    return counts.groupBy("lang", "bucket").agg(*[own(c, f) for c in ("n", "good") for f in range(FOLDS)])


def log_ratios(trusted: dict[int, int], raw: dict[int, int], level: dict[int, float] | None = None) -> list[float]:
    """log P(bucket | trusted) / P(bucket | raw), smoothed towards 0 where the trusted texts tell little.

    ``level``: the raw counts with the languages weighed as among the trusted
    texts, which the ratio is then taken against.
    """
    all_raw, all_trusted = sum(raw.values()) + BUCKETS, sum(trusted.values())
    level = raw if level is None else level
    all_level = sum(level.values()) + BUCKETS
    out = []
    for b in range(BUCKETS):
        p = (raw.get(b, 0) + 1) / all_raw
        q = (trusted.get(b, 0) + PRIOR_WEIGHT * p) / (all_trusted + PRIOR_WEIGHT)
        out.append(math.log(q / ((level.get(b, 0) + 1) / all_level)))
    return out


def by_language(rows) -> tuple[dict[int, int], dict[int, int], dict[int, float]]:
    """(trusted, raw, level) counts of each bucket, from (lang, bucket, n, good) rows.

    A language's weight is its share of the trusted n-grams over its share of
    the raw ones, smoothed as the buckets are: where no text of a language is
    trusted, its buckets come out near 0.
    """
    rows = sorted(rows, key=lambda r: (r["lang"], r["bucket"]))
    n, good = Counter(), Counter()
    for r in rows:
        n[r["lang"]] += r["n"]
        good[r["lang"]] += r["good"]
    all_raw, all_trusted = sum(n.values()), sum(good.values())
    weight = {k: (good[k] * all_raw / n[k] + PRIOR_WEIGHT) / (all_trusted + PRIOR_WEIGHT) for k in n}
    trusted, raw, level = Counter(), Counter(), Counter()
    for r in rows:
        trusted[r["bucket"]] += r["good"]
        raw[r["bucket"]] += r["n"]
        level[r["bucket"]] += weight[r["lang"]] * r["n"]
    return trusted, raw, level


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of texts that the labels call good: TRUSTED_DOCS at most, by a hash of the id."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id")).distinct()
    return good.orderBy(F.xxhash64("id"), "id").limit(TRUSTED_DOCS).withColumn("good", F.lit(1))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """The log ratios of each bucket by which each fold is scored, one fold after the other.

    Counted over all of ``docs``; BUCKETS * LANGS rows reach the driver at most.
    """
    trusted = materialise(trusted_ids(labels), "trusted")
    counts = bucket_counts(docs, trusted, id_col, text_col).collect()
    out = []
    for fold in range(FOLDS):
        others = [f for f in range(FOLDS) if f != fold]
        rows = [{"lang": r["lang"], "bucket": r["bucket"], "n": sum(r[f"n{f}"] for f in others), "good": sum(r[f"good{f}"] for f in others)} for r in counts]
        out += log_ratios(*by_language([r for r in rows if r["n"]]))
    return out


def verdicts(rows: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """``rows`` (text, fold and others) with a struct ``verdict``: the base figures, base_failed, llr, kept.

    Null and empty texts have no words and fail the base rules. Every row is
    judged by itself, so repeated rows get the same verdict; an empty table
    gives an empty one. A text of any length is one row, its words an array in
    one task.
    """
    # one literal array of FOLDS * BUCKETS doubles, folded when the plan is made
    table = F.split(F.lit(",".join(repr(x) for x in ratios)), ",").cast("array<double>")
    df = base_columns(rows).withColumn("at", F.col("fold") * BUCKETS)
    h, base = F.col("h"), F.col("base")
    add = lambda a, x: a + F.get(table, F.col("at") + _bucket(x))
    total = F.aggregate(h, F.lit(0.0), add) + F.aggregate(_pairs(h), F.lit(0.0), add)
    failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
    df = df.withColumn("llr", F.when(F.size(h) > 0, total / (2 * F.size(h) - 1)).otherwise(F.lit(0.0))).withColumn("failed", failed)
    return df.withColumn(
        "verdict",
        F.struct("base.*", F.col("failed").alias("base_failed"), F.round("llr", 9).alias("llr"), (~F.col("failed") & (F.col("llr") >= threshold)).alias("kept")),
    ).drop("base", "h", "llr", "failed", "at")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, base figures, base_failed, llr, kept. Further columns are ignored, whatever their names."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), fold_of(id_col).alias("fold"))
    return verdicts(rows, fit(docs, labels, id_col, text_col)).select(F.col("id").alias(id_col), "verdict.*")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns, whatever their names."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"), fold_of(id_col).alias("fold"))
    judged = verdicts(rows, fit(docs, labels, id_col, text_col))
    # a filter on the verdict itself would be pushed below its own steps, each copied into it; the generator stops that
    passed = judged.select("row", F.explode(F.when(F.col("verdict.kept"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))).alias("pass"))
    return passed.select("row.*")
