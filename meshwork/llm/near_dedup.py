"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

Signatures are SuperMinHash (Ertl, 2017): every element gives each signature
place a rank from its own random permutation plus a fraction, so the places of
one element are correlated and the estimate's variance is lower than with
independent hashes; the steps end once no later rank can lower any place.

Texts with the same shingle set are one representative from then on. The
signature's bands deal representatives into buckets:

1. Each member of a bucket is held against the bucket's smallest id. Links that
   the full sets confirm are joined by union-find.
2. In buckets of up to SMALL members that still hold several components, the
   members outside the largest one are held against those of other components.
3. The members of larger open buckets are held against the bucket's most
   central text. Those still apart go through an exact prefix filter: two sets
   that are similar enough share one of their rarest shingles (a quarter of the
   set and one more), early enough in both for the overlap to suffice. Texts
   that only have a passage in common, and copies with many edits of their own,
   have rarer shingles than the shared ones, so they are not paired. Of the
   texts of a family, which share wording but were edited each for itself, the
   sets' bitmaps show how much they differ at least: what cannot be similar
   enough never leaves the join. No other candidate is dropped.

Pairs inside a component are never made, so a huge group of near copies costs
about one pair per member and band, not the square of its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.shingles import mixed, shingle_sets, slices
from meshwork.operators.components import connected_components
from meshwork.runtime import materialise, ship, small_join

PLACES, ROWS = 128, 4
BANDS = PLACES // ROWS
SHINGLE, PERCENT = 5, 75
#: Share of equal signature places below which a pair is not looked at: over four standard errors under 0.75.
LEAST_AGREEMENT = 0.58
#: Members of a bucket that may be paired directly; larger ones go through the prefix filter.
SMALL = 48
#: Bits of a set's bitmap, in words of 64, and the cells in which shingles are counted (a power of two; four bytes each to every task).
BITS, WORDS, CELLS = 2048, 32, 1 << 20


def superminhash(elements: np.ndarray, places: int = PLACES) -> np.ndarray:
    """The SuperMinHash signature of distinct uint64 elements, as float64; needs one element at least."""
    sig = np.full(places, np.inf)
    order, n = None, len(elements)
    rows = np.arange(n)
    for step in range(places):
        bits = mixed(elements + np.uint64((step + 1) * 0xA0761D6478BD642F & (2**64 - 1)))
        part = (bits >> np.uint64(11)).astype(np.float64) * 2.0**-53
        pick = step + (mixed(bits) % np.uint64(places - step)).astype(np.int64)
        if step == 0:
            place, first = pick, pick
        else:
            if order is None:  # the permutations are only written out when a second step is needed
                order = np.tile(np.arange(places, dtype=np.int16), (n, 1))
                order[rows, first] = 0
                order[:, 0] = first
            place = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, step]
            order[:, step] = place
        np.minimum.at(sig, place, part + step)
        if sig.max() < step + 1:
            break
    return sig


def _signed(batches):
    """(id, n, a, b, bands, sig): a and b digest the set, sig holds 8 bits a place."""
    for batch in batches:
        ids, texts = batch.column("id"), batch.column("text")
        for start, rows in slices(texts):
            n, a, b, bands, sigs = [], [], [], [], []
            for s in shingle_sets(texts.slice(start, rows), SHINGLE):
                n.append(len(s))
                if not len(s):
                    a.append(0), b.append(0), bands.append(None), sigs.append(None)
                    continue
                x = mixed(s)
                a.append(int(x.sum(dtype=np.uint64).view(np.int64)))
                b.append(int(np.bitwise_xor.reduce(mixed(x + np.uint64(1))).view(np.int64)))
                sig = mixed(superminhash(s).view(np.uint64))
                key = np.zeros(BANDS, np.uint64)
                for j in range(ROWS):
                    key = mixed(key + sig[j::ROWS])
                bands.append(mixed(key + np.arange(BANDS, dtype=np.uint64)).view(np.int64))
                sigs.append((sig & np.uint64(0xFF)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [ids.slice(start, rows), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                names=["id", "n", "a", "b", "bands", "sig"],
            )


def _sets(batches):
    for batch in batches:
        for start, rows in slices(batch.column("text")):
            sets = [s.tobytes() for s in shingle_sets(batch.column("text").slice(start, rows), SHINGLE)]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(start, rows), pa.array(sets, pa.binary())], names=["id", "set"])


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """BITS bits as int64 words; a bit is set when some shingle falls on it.

    A bit that only one of two sets has set stands for a shingle that the other
    lacks, so the sets differ in at least as many shingles as bitmaps in bits.
    """
    bits = np.zeros(BITS, np.uint8)
    bits[(mixed(shingles) % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _listed(batches):
    """(id, shingles, bits): the full sets as arrays of whole numbers, and their bitmaps."""
    for batch in batches:
        for start, rows in slices(batch.column("text")):
            sets = shingle_sets(batch.column("text").slice(start, rows), SHINGLE)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(start, rows), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([bitmap(s) for s in sets], pa.list_(pa.int64()))], names=["id", "shingles", "bits"]
            )


def _agreeing(batches):
    """Of pairs with both signatures those that agree in enough places."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PLACES) for c in ("sig_x", "sig_y"))
            near = (x == y).sum(axis=1) >= LEAST_AGREEMENT * PLACES
            yield batch.select(["src", "dst"]).filter(pa.array(near))


def _verified(batches):
    """Of pairs with both full sets those that are similar enough."""
    for batch in batches:
        good = []
        for x, y in zip(batch.column("set_x").to_pylist(), batch.column("set_y").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select(["src", "dst"]).filter(pa.array(good, pa.bool_()))


def _confirmed(docs: DataFrame, pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Of candidate pairs (src, dst) those that the full sets confirm."""
    x, y = (reps.select(F.col("id").alias(c), F.col("sig").alias(s)) for c, s in (("src", "sig_x"), ("dst", "sig_y")))
    likely = materialise(pairs.join(x, "src").join(y, "dst").mapInArrow(_agreeing, "src long, dst long"), "likely")
    wanted = materialise(likely.select(F.col("src").alias("id")).union(likely.select("dst")).distinct(), "wanted")
    sets = materialise(small_join(docs, wanted, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_sets, "id long, set binary"), "sets")
    x, y = (sets.select(F.col("id").alias(c), F.col("set").alias(s)) for c, s in (("src", "set_x"), ("dst", "set_y")))
    return materialise(likely.join(x, "src").join(y, "dst").mapInArrow(_verified, "src long, dst long"), "links")


def _open(members: DataFrame) -> DataFrame:
    """The members (key, id, comp) of buckets with two components or more, with the bucket's size and largest component."""
    per = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    tops = per.groupBy("key").agg(F.sum("c").alias("size"), F.max(F.struct("c", "comp"))["comp"].alias("top"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    # open buckets are few: counted, then told to every task, so that a large bucket's members stay where they are
    return small_join(members, materialise(tops.drop("comps"), "tops"), "key")


def _across(members: DataFrame) -> DataFrame:
    """Pairs of different components within a bucket, each with one end outside the bucket's largest component."""
    out = members.where("comp <> top").select("key", F.col("id").alias("x"), F.col("comp").alias("cx"))
    other = members.select("key", F.col("id").alias("y"), F.col("comp").alias("cy"), "top")
    pairs = out.join(other, "key").where("cx <> cy AND (cy = top OR x < y)")
    return pairs.select(F.greatest("x", "y").alias("src"), F.least("x", "y").alias("dst")).distinct()


def _ordered(cells: np.ndarray, batches):
    """(id, n, alone, centre, front, bits) of (id, shingles, bits) rows: see ``_rare_first``."""
    for batch in batches:
        n, alone, centre, front = [], [], [], []
        for s in batch.column("shingles"):
            s = s.values.to_numpy()
            often = cells[_cell(s)]
            order = np.lexsort((s, often))
            single = int((often == 1).sum())
            reach = len(s) - -(-len(s) * PERCENT // 100) + 1
            n.append(len(s)), alone.append(single), centre.append(float(often.mean())), front.append(s[order[single:reach]])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(n, pa.int64()), pa.array(alone, pa.int64()), pa.array(centre, pa.float64()), pa.array(front, pa.list_(pa.int64())), batch.column("bits")], names=["id", "n", "alone", "centre", "front", "bits"]
        )


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) % np.uint64(CELLS)).astype(np.int64)


def _rare_first(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, n, alone, centre, front, bits) for the members of large buckets.

    Shingles are ordered by how many members have one on the same of CELLS
    cells, which is as many as have it or more, then by their value: one order
    for all texts, about the rarest first. ``alone`` is the number of shingles
    that the text has its cell to itself with, which come first; ``front`` are
    those after them that a similar text may meet first. ``centre`` is the mean
    count: the texts of a family with the fewest changes of their own have the
    largest. Only the cells' counts reach the driver and the tasks.
    """
    ids = materialise(members.select("id").distinct(), "ids")
    texts = small_join(docs, ids, "id", "left_semi").dropDuplicates(["id"])
    sets = materialise(texts.mapInArrow(_listed, "id long, shingles array<long>, bits array<long>").where("size(shingles) > 0"), "listed")
    cell = F.pmod(F.col("s"), F.lit(CELLS))
    counts = sets.select(F.explode("shingles").alias("s")).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").toArrow()
    cells = np.ones(CELLS, np.int32)
    cells[counts["cell"].to_numpy()] = np.minimum(counts["n"].to_numpy(), 2**31 - 1)
    return materialise(sets.mapInArrow(lambda batches: _ordered(cells, batches), "id long, n long, alone long, centre double, front array<long>, bits array<long>"), "rare")


def _central_pairs(members: DataFrame, rare: DataFrame) -> DataFrame:
    """Each member of a large open bucket with the bucket's most central text, if their components differ."""
    placed = members.select("key", "id", "comp").join(rare.select("id", "centre"), "id")
    hubs = materialise(placed.groupBy("key").agg(F.max(F.struct("centre", "id", "comp")).alias("hub")), "hubs")
    # one row a bucket: told to every task, or joined by files, so that a large bucket's members are not dealt to one task
    pairs = small_join(placed, hubs, "key").where(F.col("comp") != F.col("hub.comp")).select("id", F.col("hub.id").alias("hub"))
    return pairs.select(F.greatest("id", "hub").alias("src"), F.least("id", "hub").alias("dst")).distinct()


def _prefix_pairs(members: DataFrame, rare: DataFrame) -> DataFrame:
    """Candidate pairs among the members (key, id, comp, top) of open buckets by an exact prefix filter.

    One end lies outside the largest component of a bucket, and the components
    differ. A similar pair's first common shingle lies within both prefixes,
    and what is left behind it in either set suffices for the overlap that the
    sizes ask for; shingles of one text alone count for the places. Nor may the
    bitmaps show more differences than the sizes allow.
    """
    ids = members.groupBy("id").agg(F.first("comp").alias("comp"), F.max(F.col("comp") != F.col("top")).alias("out"))
    front = rare.join(ids, "id").select("id", "comp", "out", "n", "alone", "bits", F.posexplode("front").alias("at", "s"))
    prefix = materialise(front.select("id", "comp", "out", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("behind"), "s", "bits"), "prefix")
    x = prefix.where("out").select("s", F.col("id").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"), F.col("behind").alias("bx"), F.col("bits").alias("mx"))
    y = prefix.select("s", F.col("id").alias("y"), F.col("comp").alias("cy"), "out", F.col("n").alias("ny"), F.col("behind").alias("by"), F.col("bits").alias("my"))
    # ``behind`` counts the common shingle itself; an overlap o is enough if o * (100 + PERCENT) >= PERCENT * (nx + ny)
    enough = (100 + PERCENT) * F.least("bx", "by") >= PERCENT * (F.col("nx") + F.col("ny"))
    # sets that differ in d shingles are similar enough if (100 + PERCENT) * d <= (100 - PERCENT) * (nx + ny)
    apart = sum((F.bit_count(F.get("mx", F.lit(i)).bitwiseXOR(F.get("my", F.lit(i)))) for i in range(WORDS)), F.lit(0))
    near = (100 + PERCENT) * apart <= (100 - PERCENT) * (F.col("nx") + F.col("ny"))
    pairs = x.join(y, (x["s"] == y["s"]) & (F.col("cx") != F.col("cy")) & (~F.col("out") | (F.col("x") < F.col("y"))) & enough & near)
    return pairs.select(F.greatest("x", "y").alias("src"), F.least("x", "y").alias("dst")).distinct()


def _named(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(id, text) rows whose ids are whole numbers, each once, and the rows behind them where those are not the table's own ids.

    Where ids are null or repeated the rows are written with a number each, and
    that number serves as the id; the second table (id, own, row) has the rest.
    """
    own = F.col(id_col).cast("long")
    ids = docs.select(own.alias("id"))
    if ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").isEmpty():
        return docs.select(own.alias("id"), F.col(text_col).alias("text")), None
    rows = docs.select(own.alias("own"), F.col(text_col).alias("text"), F.struct("*").alias("row"))
    rows = materialise(rows.withColumn("id", F.monotonically_increasing_id()), "rows")
    return rows.select("id", "text"), rows.select("id", "own", "row")


def _regrouped(found: DataFrame, rows: DataFrame) -> DataFrame:
    """What ``_groups`` found of numbered rows, in terms of the table's own ids: id (the row's number), own, n, component, kept, first."""
    df = found.join(rows.select("id", "own"), "id")
    # the smallest id names a group, any id before null; groups without one keep the row with the smallest number
    least = df.groupBy("component").agg(F.min(F.struct(F.col("own").isNull(), "own", "id")).alias("least"))
    named = df.join(least, "component").withColumn("component", F.col("least.own"))
    return named.select("id", "own", "n", "component", F.coalesce(F.col("own") == F.col("component"), F.col("id") == F.col("least.id")).alias("kept"), (F.col("id") == F.col("least.id")).alias("first"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Links are pairs whose shingle sets have 100 * intersection >= 75 * union; a
    component's id is its smallest document id. Null and empty texts have an
    empty set and stand alone. Rows that repeat an id are documents of their own
    with that id: ``kept`` is true for the rows whose id is the component's. Rows
    without an id are documents too; a component without any id has the id null
    and keeps one row. An empty table gives an empty result; further columns are
    ignored. Ids are whole numbers or null. Whole texts are read, a very long one
    in a batch alone.

    A pair is found when the signatures agree in one of 32 bands of four places
    and in LEAST_AGREEMENT of all places: each misses a pair at the bound of 0.75
    with a probability of about 5 in a million.
    """
    texts, rows = _named(docs, id_col, text_col)
    found = _groups(texts)
    if rows is None:
        named = found.select("id", "n", "component", (F.col("id") == F.col("component")).alias("kept"))
    else:
        named = _regrouped(found, rows).select(F.col("own").alias("id"), "n", "component", "kept")
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, exactly one document of each group, with their columns, whatever their names.

    Of rows that repeat the id of the document that stays, one stays.
    """
    texts, rows = _named(docs, id_col, text_col)
    found = _groups(texts)
    if rows is None:
        gone = found.where("id <> component").select(F.col("id").alias("gone"))
        held = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"))
        return held.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")
    return rows.join(_regrouped(found, rows).where("first").select("id"), "id", "left_semi").select("row.*")


def _groups(docs: DataFrame) -> DataFrame:
    """(id, n, component) of (id, text) rows whose ids are whole numbers, each once."""
    spark = ship(docs.sparkSession)
    signed = materialise(docs.mapInArrow(_signed, "id long, n long, a long, b long, bands array<long>, sig binary"), "signatures")
    groups = materialise(signed.where("n > 0").groupBy("n", "a", "b").agg(F.min("id").alias("rep")), "sets")
    first = signed.where("n > 0").join(groups.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    reps = materialise(first.dropDuplicates(["id"]).select("id", "sig"), "reps")
    rows = first.select("id", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    members = materialise(rows.join(buckets, "key"), "members")
    star = members.where("id <> leader").select(F.col("id").alias("src"), F.col("leader").alias("dst")).distinct()
    links = _confirmed(docs, star, reps)
    comps = materialise(connected_components(links), "components")

    def labelled(df):
        return df.join(comps, "id", "left").select("key", "id", F.coalesce("label", "id").alias("comp"))

    # several components in a bucket: what lies outside the largest is held against the others
    left = materialise(_open(labelled(members.select("key", "id"))), "open")
    pairs = _across(left.where(F.col("size") <= SMALL))
    large = left.where(F.col("size") > SMALL)
    if not large.isEmpty():
        # first against the most central text, which settles most of a family, then by prefixes what is still open
        rare = _rare_first(docs, large)
        links = links.union(_confirmed(docs, materialise(_central_pairs(large, rare), "central"), reps))
        comps = materialise(connected_components(links), "components")
        still = materialise(_open(large.select("key", "id").join(comps, "id", "left").select("key", "id", F.coalesce("label", "id").alias("comp"))), "still")
        pairs = pairs.union(_prefix_pairs(still, rare))
    more = _confirmed(docs, materialise(pairs.distinct(), "pairs"), reps)
    comps = materialise(connected_components(links.union(more)), "components")
    classes = groups.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("n", "a", "b", F.coalesce("label", "rep").alias("component"))
    named = signed.select("id", "n", "a", "b").join(classes, ["n", "a", "b"], "left")
    return named.select("id", "n", F.coalesce("component", "id").alias("component"))
