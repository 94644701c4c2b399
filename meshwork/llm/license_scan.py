"""License scans by diagonal voting.

All rolling word k-gram hashes of every text are joined with the positions of
the templates' k-grams. A hit votes for its diagonal, the offset of the text
position over the template position. Neighbouring diagonals (words put in or
left out in between) are merged into spans, and the span's words are compared
with the template's: coverage is the longest common subsequence over the
template's words.

Diagonals are merged in their own order, so one that a repeated wording of the
template puts far away stays apart and cannot come between two true ones. Words
put in at one place beyond ``reach`` of the template (a fifth of it, NEAR at
least) leave two spans, each judged by itself.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.runtime import materialise, ship, small_join

#: Words of a k-gram, the words that a span may have between its hits, and the share of a template that must be there.
GRAM, GAP, COVERAGE = 4, 40, 0.7
#: How far neighbouring diagonals may be apart at least, and as a share of the template's words.
NEAR, NEAR_SHARE = 6, 0.2
#: Texts with a hit that are told to every task at most (24 bytes each); beyond them the join is a shuffle join.
WANTED_ROWS = 500_000

#: Phrases that always count, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Wording by which well-known licences are stated or announced.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2.0",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    "bsd-notice": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc-by-nc-4.0": "licensed under cc by-nc 4.0",
    "cc-by-sa-4.0": "licensed under cc by-sa 4.0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that
        it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
        See the GNU General Public License for more details.""",
    "mit-notice": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED""",
    "mit-released": "released under the mit license",
}

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower case in which a word equals one of ASCII letters only if it does so with A-Z alone lowered.

    The Kelvin sign is the one other character whose lower case is an ASCII
    letter; it becomes another letter first. What else is lowered beyond A-Z
    changes neither where words end nor which of them match.
    """
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u212b")))


def license_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), _BETWEEN), "")


def _split(text: str) -> list[str]:
    return [w for w in re.split(_BETWEEN, text.lower()) if w]


def _grams(h: Column, k: int) -> Column:
    return F.transform(F.slice(h, k, F.greatest(F.size(h) - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(*[F.get(h, i + j) for j in range(k - 1)], x))


def _hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def reach(words: int) -> int:
    """How far neighbouring diagonals of a template with so many words may be apart."""
    return max(NEAR, int(NEAR_SHARE * words))


def template_table(spark, templates: dict[str, str]) -> DataFrame:
    """(label, tpl, near): a row for each template, the bound of everything that is broadcast here."""
    rows = [(k, _split(v)) for k, v in sorted(templates.items())]
    return spark.createDataFrame([(k, w, reach(len(w))) for k, w in rows if w], "label string, tpl array<string>, near int")


def common_length(template: list[str], words: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows: one whole-number step a word."""
    masks: dict[str, int] = {}
    for i, w in enumerate(template):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(template)) - 1
    row = full
    for w in words:
        mask = masks.get(w)
        if mask:
            hit = row & mask
            row = (row + hit | row - hit) & full
    return len(template) - row.bit_count()


def _verified(templates: dict[str, list[str]], batches):
    for batch in batches:
        labels, words = batch.column("label").to_pylist(), batch.column("words").to_pylist()
        share = [common_length(templates[x], w) / len(templates[x]) for x, w in zip(labels, words)]
        keep = [c for c in batch.schema.names if c != "words"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(share, pa.float64())], names=[*keep, "coverage"])


def _same_text(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on (id, key), null ids included; ``right`` comes with id2 and key2."""
    return small_join(left, right, F.col("id").eqNullSafe(F.col("id2")) & F.col("key").eqNullSafe(F.col("key2")), how, WANTED_ROWS)


def spans(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM) -> DataFrame:
    """Verified spans: id, key (hash of the text), label, start, end (words, end not included), coverage, votes.

    Spans below COVERAGE come too; the caller decides. Null and empty texts
    have none. Rows with the same id and text have the same spans, once. Texts
    of any length are scanned whole; the words of one are an array in one task.
    """
    spark = ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    tpl = template_table(spark, templates)
    # the hashes are a column of their own: within the grams' lambda an expression would be worked out again for each word
    places = tpl.select("label", "near", _hashes(F.col("tpl")).alias("h")).select("label", "near", F.posexplode(_grams(F.col("h"), k)).alias("at", "gram"))
    words = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), license_words(F.col(text_col)).alias("w"))
    grams = words.select("id", "key", _hashes(F.col("w")).alias("h")).select("id", "key", F.posexplode(_grams(F.col("h"), k)).alias("pos", "gram"))
    hits = grams.join(F.broadcast(places), "gram").select("id", "key", "label", "near", (F.col("pos") - F.col("at")).alias("diagonal"), "pos")
    # repeated rows vote once
    votes = hits.groupBy("id", "key", "label", "near", "diagonal").agg(F.collect_set("pos").alias("set"))
    diagonals = materialise(votes.select("id", "key", "label", "near", "diagonal", F.size("set").alias("votes"), F.array_min("set").alias("first"), F.array_max("set").alias("last")), "diagonals")
    # bands of near diagonals first, then places
    per = Window.partitionBy("id", "key", "label").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(per) > F.col("near")
    banded = diagonals.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("band", F.sum("new").over(per.rowsBetween(Window.unboundedPreceding, 0)))
    per = Window.partitionBy("id", "key", "label", "band").orderBy("first", "diagonal")
    far = F.col("first") - F.max("last").over(per.rowsBetween(Window.unboundedPreceding, -1)) > GAP
    merged = banded.withColumn("new", F.coalesce(far, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(per.rowsBetween(Window.unboundedPreceding, 0)))
    found = merged.groupBy("id", "key", "label", "band", "span").agg(F.sum("votes").alias("votes"), F.min("first").alias("start"), (F.max("last") + k).alias("end"))
    listed = found.groupBy("id", "key").agg(F.collect_list(F.struct("label", "start", "end", "votes")).alias("found"))
    listed = materialise(listed.select(F.col("id").alias("id2"), F.col("key").alias("key2"), "found"), "found")
    # verification: the words themselves, cut out where they stand
    whole = _same_text(words, listed, "inner").select("id", "key", "w", F.explode("found").alias("f"))
    cut = whole.select("id", "key", "f.*", F.slice("w", F.col("f.start") + 1, F.col("f.end") - F.col("f.start")).alias("words")).dropDuplicates(["id", "key", "label", "start", "end"])
    plain = {r["label"]: r["tpl"] for r in tpl.collect()}
    return cut.mapInArrow(lambda batches: _verified(plain, batches), f"id {kind}, key long, label string, start int, end int, votes long, coverage double")


def base_places(w: Column) -> Column:
    """(start, label) of each place where a phrase's words stand consecutively."""
    found = None
    for phrase, label in PHRASES.items():
        places = F.transform(w, _phrase_at(w, phrase.split(), label))
        found = places if found is None else F.concat(found, places)
    return F.filter(found, lambda x: x.isNotNull())


def _phrase_at(w: Column, parts: list[str], label: str):
    def at(x, i):
        whole = x == parts[0]
        for j, part in enumerate(parts[1:], 1):
            whole = whole & F.coalesce(F.get(w, i + j) == part, F.lit(False))
        return F.when(whole, F.struct(i.alias("start"), F.lit(label).alias("label")))

    return at


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` has the verified spans that count, as (label, start, end,
    coverage). Score is 1 where a phrase stands, else the best coverage of any
    span, also one that is too short to count. Null and empty texts have no
    words, labels "" and score 0; repeated rows get the same answer each; an
    empty table gives an empty result; further columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), license_words(F.col(text_col)).alias("w"), ascii_lower(F.col(text_col)).rlike("license|cc").alias("may"))
    none = F.array().cast("array<struct<start:int,label:string>>")
    # the words end here: only figures go on into the join
    base = rows.select("id", "key", F.size("w").cast("long").alias("n_words"), F.when(F.col("may"), base_places(F.col("w"))).otherwise(none).alias("b"))
    found = spans(docs, templates, id_col, text_col)
    counts = F.col("coverage") >= coverage
    own = found.groupBy("id", "key").agg(
        F.max("coverage").alias("best"), F.collect_set(F.when(counts, F.col("label"))).alias("own"), F.sort_array(F.collect_list(F.when(counts, F.struct("start", "end", "label", "coverage")))).alias("spans")
    )
    own = materialise(own.withColumnRenamed("id", "id2").withColumnRenamed("key", "key2"), "own")
    df = _same_text(base, own, "left")
    starts, base_labels = F.transform("b", lambda x: x["start"].cast("long")), F.array_distinct(F.transform("b", lambda x: x["label"]))
    return df.select(
        F.col("id").alias(id_col), "n_words", F.size("b").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), F.array_join(F.sort_array(base_labels), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base_labels, F.coalesce("own", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("b") > 0, F.lit(1.0)).otherwise(F.round(F.coalesce("best", F.lit(0.0)), 6)).alias("score"), "spans",
    )
