"""Line dedup by site-relative frequency.

For every host and line the pages of the host that hold the line are counted
and divided by the host's pages. Lines at or above the boilerplate ratio, on
enough pages, are dropped from every page of the host.

A page's lines are made distinct before they are counted, and counts are
partial first, so a line on every page of a huge host is one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.runtime import materialise, small_join

#: A line is boilerplate from this share of a host's pages on, if at least so many pages hold it.
RATIO, MIN_PAGES = 0.1, 3
#: For sources of documents, which are wider than a web site.
SOURCE_RATIO, SOURCE_MIN_PAGES = 0.02, 5

#: Tags that end a line of a page, and the entities that are resolved.
BLOCK_TAGS = "p|div|h[1-6]|li|ul|ol|br|tr|table|article|section|nav|header|footer|title|blockquote|pre|hr|td|th|head|body|html"
UNSEEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def page_lines(html: Column) -> Column:
    """The visible lines of a page: block tags end lines, white space is folded, empty lines go."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, "")
    text = F.regexp_replace(text, rf"(?i)</?({BLOCK_TAGS})\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]+>", "")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    # blanks other than line ends are folded; then one split takes line ends with the blanks and empty lines beside them
    text = F.btrim(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "), F.lit(" \n"))
    return F.filter(F.split(text, r" ?\n[ \n]*"), lambda x: x != "")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def text_lines(text: Column) -> Column:
    """The lines of a plain text as they stand, empty ones too."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def text_keys(text: Column) -> Column:
    """What the lines of ``text_lines`` are compared by: outer blanks cut, inner ones folded; "" for blank lines."""
    folded = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09\x0B-\x0D]+", " "), r" ?\n ?", "\n")
    return F.split(F.btrim(folded, F.lit(" ")), "\n")


def boilerplate(rows: DataFrame, ratio: float, min_pages: int, fold: bool) -> DataFrame:
    """(host, often): the boilerplate lines of each host that has some, from (host, keys) rows.

    Counted by the lines' hashes first, which leaves few lines. Those are then
    counted by the lines themselves, as two lines could share a hash.
    """
    held = rows.select("host", F.array_distinct(F.filter("keys", lambda x: x != "")).alias("keys"))
    hashed = held.withColumn("hashes", F.transform("keys", lambda x: F.xxhash64(x)))
    if fold:
        # the null line stands for the page itself, so that one pass counts both
        once = hashed.select("host", "hashes").distinct()
        lined = once.select("host", F.explode(F.concat(F.array(F.lit(None).cast("long")), "hashes")).alias("line"))
    else:
        lined = hashed.select("host", F.explode(F.concat(F.array(F.lit(None).cast("long")), "hashes")).alias("line"))
    counts = lined.groupBy("host", "line").agg(F.count(F.lit(1)).alias("on"))
    counts = materialise(counts.where(F.col("line").isNull() | (F.col("on") >= min_pages)), "held")
    pages = counts.where("line IS NULL").select("host", F.col("on").alias("of"))

    def often(df):
        return df.where(F.col("on") >= min_pages).join(pages, "host").where(F.col("on") >= F.lit(ratio) * F.col("of"))

    # a host has at most (lines of a page / ratio) boilerplate lines, so the arrays stay short
    likely = materialise(often(counts.where("line IS NOT NULL")).groupBy("host").agg(F.collect_set("line").alias("likely")), "likely")
    df = small_join(hashed, likely, "host").withColumn("own", F.array_intersect("hashes", "likely")).where(F.size("own") > 0)
    page = F.xxhash64("hashes") if fold else F.lit(0)
    exact = df.select("host", page.alias("page"), F.explode(F.filter("keys", lambda x: F.array_contains(F.col("own"), F.xxhash64(x)))).alias("line"))
    if fold:
        exact = exact.distinct()
    exact = often(exact.groupBy("host", "line").agg(F.count(F.lit(1)).alias("on")))
    return materialise(exact.groupBy("host").agg(F.collect_set("line").alias("often")), "sites")


def drop_boilerplate(rows: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, fold: bool = False) -> DataFrame:
    """``rows`` (host, lines, keys and any others) with n_lines, n_dropped and, in ``lines``, what stays.

    ``keys`` is what the lines are compared by, character by character. Lines
    whose key is "" are never boilerplate. A page with the same line twice
    counts once for it and loses both. Repeated rows are pages of their own, but
    with ``fold`` the pages of a host with the same set of lines are counted as
    one, in a line's pages and in the host's; an empty table gives an empty
    result; a page may lose all of its lines and stays, empty. A page of any
    length is one row, its lines an array: a page has to fit into a task a few
    times over.
    """
    df = small_join(rows, boilerplate(rows, ratio, min_pages, fold), "host", "left")
    # only this page's own boilerplate is searched line by line
    df = df.withColumn("own", F.when(F.col("often").isNotNull(), F.array_intersect("keys", "often")))
    stays = F.when(F.col("own").isNull() | (F.size("own") == 0), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.array_contains(F.col("own"), F.get("keys", i))))
    df = df.withColumn("n_lines", F.size("lines").cast("long")).withColumn("lines", stays)
    return df.withColumn("n_dropped", F.col("n_lines") - F.size("lines")).drop("keys", "often", "own")


def clean_pages(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per page: page_id, host, n_lines, n_dropped, text (the lines that stay).

    Null or empty pages have no lines; a null or unreadable address is the host
    "". Pages are parsed once, to the shared scratch folder. Further columns are
    ignored, whatever their names.
    """
    parsed = materialise(pages.select("page_id", host_of(F.col("url")).alias("host"), page_lines(F.col("html")).alias("lines")), "lines")
    df = drop_boilerplate(parsed.withColumn("keys", F.col("lines")), ratio, min_pages)
    return df.select("page_id", "host", "n_lines", "n_dropped", F.array_join("lines", "\n").alias("text"))


def clean_documents(docs: DataFrame, text_col: str = "text", source_col: str = "source", ratio: float = SOURCE_RATIO, min_pages: int = SOURCE_MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines of their source taken out of the text; n_chars, where there is one, follows.

    Equal texts of a source are one page: copies of a document, which a later
    stage folds, do not make its lines boilerplate. Null and empty texts stay as
    they are, a null source is the source "", columns of any name stay.
    """
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("host"), text_lines(F.col(text_col)).alias("lines"), text_keys(F.col(text_col)).alias("keys"))
    df = drop_boilerplate(rows, ratio, min_pages, fold=True).withColumn("text", F.when(F.col("n_dropped") > 0, F.array_join("lines", "\n")))
    new = {text_col: F.coalesce("text", F.col("row")[text_col])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.char_length("text").cast("long"), F.col("row")["n_chars"])
    return df.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


SQL = rf"""
WITH lined AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(
      {"replace(" * len(ENTITIES)}regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{UNSEEN}', '', 'g'),
      '(?i)</?({BLOCK_TAGS})\b[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g'){"".join(", '" + a + "', '" + b.replace("'", "''") + "')" for a, b in ENTITIES)},
      '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
  FROM pages),
per AS (SELECT host, count(*) AS of FROM lined GROUP BY host),
often AS (
  SELECT host, line FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM lined) JOIN per USING (host)
  GROUP BY host, line, of HAVING count(*) >= {MIN_PAGES} AND count(*) >= {RATIO}::DOUBLE * of),
sites AS (SELECT host, list(line) AS drops FROM often GROUP BY host),
cleaned AS (SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(drops, []), x)) AS stays FROM lined LEFT JOIN sites USING (host))
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(stays))::BIGINT AS n_dropped, coalesce(array_to_string(stays, chr(10)), '') AS text FROM cleaned
"""
