"""Operators 5, 7 and 8 and the pipeline: brute force, exact round trips, edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meshwork.llm import catalog, mixing, packing, ranking, sharding
from meshwork.llm.common import table
from meshwork.llm.wordbpe import WordBpe
from tests.llm.test_dedup import BLANKS, LOW, brute_groups, docs_of, prose, words_of

SCHEMA = "doc_id long, text string, source string, size long, target string"


def sourced(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, "x") for i, (t, s) in enumerate(rows)], SCHEMA)


def water_fill(sizes):
    """The rounds of the rule, by source in order: share by weight, cut at twice the size, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    rest, free = 1.5 * sum(sizes.values()), set(names)
    while rest > 1e-9 and free:
        total, spare = sum(weight[s] for s in free), 0.0
        for s in list(free):
            target[s] += rest * weight[s] / total
            if target[s] >= 2 * sizes[s]:
                spare += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
        rest = spare
    return target


def test_mixing(spark):
    rng = random.Random(6)
    names = ["b", "a", "é", "Z", None, "empty"]
    rows = [(prose(rng, rng.choice([1, 5, 40, 300])), rng.choice(names[:4] + ["a"] * 4)) for _ in range(400)]
    rows += [(prose(rng, 30), None), (None, "empty"), ("", "empty"), (" \n", "a"), (prose(rng, 3000), "b")]
    df = sourced(spark, rows)
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    size = {i: len([w for w in BLANKS.split(t or "") if w]) for i, (t, _) in enumerate(rows)}
    per = defaultdict(int)
    for i, (_, s) in enumerate(rows):
        per[s] += size[i]
    want, taken = water_fill(per), defaultdict(int)
    for i, (_, s) in enumerate(rows):
        r = got[i]
        assert r["size"] == size[i] and r["source_size"] == per[s] and math.isclose(r["target"], want[s], rel_tol=1e-9, abs_tol=1e-6)
        assert r["taken"] == r["copies"] * size[i] <= 2 * size[i]
        taken[s] += r["taken"]
    for s in per:
        assert abs(taken[s] - want[s]) <= max((size[i] for i, (_, x) in enumerate(rows) if x == s), default=0) / 2
    assert {k: r["taken"] for k, r in got.items()} == {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(7)).collect()}
    copies = Counter(r["doc_id"] for r in mixing.repeat_documents(df).collect())
    assert copies == {k: r["copies"] for k, r in got.items() if r["copies"]}
    assert mixing.mix(df.limit(0)).count() == 0
    assert all(r["taken"] == 0 for r in mixing.mix(sourced(spark, [(None, None), ("", "a")])).collect())


def test_mixing_without_ids_and_of_repeated_ids(spark):
    """Rows that repeat source, id and size are taken alike; every other row is taken by itself."""
    rng = random.Random(16)
    rows = [(None, prose(rng, 9), "a")] * 2 + [(None, prose(rng, n), rng.choice("ab")) for n in range(1, 40)]
    rows += [(5, prose(rng, 7), "a")] * 3 + [(5, prose(rng, 8), "b"), (6, None, "a"), (None, "", None)] + [(i, prose(rng, rng.randint(1, 50)), rng.choice("abc")) for i in range(10, 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("id", "size", "row", "copies", "place", "more", "target", "cut")})
    copies = {}
    for r in mixing.mix(df).collect():
        assert copies.setdefault((r["doc_id"], r["size"], r["source_size"]), r["copies"]) == r["copies"]
    per = Counter()
    for _, t, s in rows:
        per[s] += len((t or "").split())
    want = Counter()
    for i, t, s in rows:
        n = copies[i, len((t or "").split()), per[s]]
        if n:
            want[i, t, s] += n
    out = mixing.repeat_documents(df)
    assert out.columns == df.columns and Counter((r["doc_id"], r["text"], r["source"]) for r in out.collect()) == want
    goal = water_fill(per)
    for s in per:
        taken = sum(copies[i, len((t or "").split()), per[s]] * len((t or "").split()) for i, t, x in rows if x == s)
        heaviest = max((sum(len((u or "").split()) for j, u, y in rows if (j, y, len((u or "").split())) == (i, s, len((t or "").split()))) for i, t, x in rows if x == s), default=0)
        assert abs(taken - goal[s]) <= heaviest / 2 + 1e-6


def test_inclusion_follows_the_expected_copies(spark):
    """Over many seeds a document's mean copies come near factor times size class."""
    rows = [("w " * n, "a") for n in (1, 3, 9, 30, 100, 300) for _ in range(6)] + [("w " * 40, "b")]
    df = sourced(spark, rows).cache()
    total = defaultdict(float)
    for seed in range(12):
        for r in mixing.mix(df, seed=str(seed)).where("source_size > 100").collect():
            total[r["size"]] += r["copies"]
    means = [total[n] for n in (1, 3, 9, 30, 100, 300)]
    assert all(a <= b + 16 for a, b in zip(means, means[1:])) and means[0] < means[-1]


def test_ranks(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919 % 3000) / 3000).alias("u"), "id").cache()
    for groups in ([], ["g"]):
        rows = ranking.ranked(df, groups, "u", ["id"], 64, "r").collect()
        by = defaultdict(list)
        for r in rows:
            by[r["g"] if groups else 0].append((r["u"], r["r"]))
        assert all([x[1] for x in sorted(v)] == list(range(len(v))) for v in by.values())


def test_sharding(spark):
    rng = random.Random(2)
    rows = [(prose(rng, 5), "hot") for _ in range(500)] + [(prose(rng, 5), rng.choice("abc")) for _ in range(300)] + [(None, None), ("", "a"), ("é", "b")]
    got = sharding.shard(sourced(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(rows)))
    slots, mixture = defaultdict(list), defaultdict(Counter)
    for r in got:
        text = rows[r["doc_id"]][0] or ""
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode()) and r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        mixture[r["shard"]][rows[r["doc_id"]][1]] += 1
    counts = [len(v) for v in slots.values()]
    assert set(slots) == set(range(16)) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    for source, n in Counter(s for _, s in rows).items():
        assert all(abs(m[source] - n / 16) < 2 for m in mixture.values())
    assert sharding.shard(sourced(spark, [])).count() == 0
    assert sorted(r["shard"] for r in sharding.shard(sourced(spark, [("a", "s")] * 3)).collect()) == [0, 5, 10]
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(sourced(spark, rows).repartition(9)).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in got}


def chance(seed, key):
    return (int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def brute_shards(rows, shards=16):
    """(id, shard, slot) of (id, text, source) rows, sorted as a whole."""
    first = lambda x: (x is not None, x)
    per = defaultdict(list)
    for i, t, s in rows:
        data = (t or "").encode()
        size, crc, source = len(data) + 1, zlib.crc32(data), "null" if s is None else f"={s}"
        per[source].append((chance("shard", f"{'null' if i is None else i}:{size}:{crc}"), first(i), size, crc))
    placed = []
    for source, members in per.items():
        phase = chance("shard", source)
        placed += [((k + phase) / len(members), *m, source) for k, m in enumerate(sorted(members))]
    out, n = [], len(rows)
    for at, (_, _, i, _, _, _) in enumerate(sorted(placed)):
        shard = int(at * shards / n)
        out.append((i[1], shard, at - math.ceil(shard * n / shards)))
    return out


def test_sharding_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(0, 6)), "hot") for i in range(300)] + [(None, prose(rng, 4), "b") for _ in range(80)]
    rows += [(1000 + i, prose(rng, 3), f"lone {i}") for i in range(200)] + [(7, "same", "b"), (7, "same", "b"), (8, None, None), (9, "x" * 200_000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("id", "u", "rank", "place", "at")})
    got = sorted((r["shard"], r["slot"], r["doc_id"] or -1) for r in sharding.shard(df.repartition(5)).collect())
    assert got == sorted((s, k, i or -1) for i, s, k in brute_shards(rows))


def test_no_bucket_of_the_ranking_is_hot(spark):
    """Sources of one document, and null ids, spread over the buckets."""
    rows = [(None, f"text {i}", f"lone {i}") for i in range(3000)]
    seen = []
    real = sharding.ranked

    def watched(df, groups, place, order, buckets, out):
        if not groups:
            seen.append(df.groupBy(F.floor(F.col(place) * 64)).count().agg(F.max("count")).first()[0])
        return real(df, groups, place, order, buckets, out)

    sharding.ranked = watched
    try:
        assert sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, source string")).count() == 3000
    finally:
        sharding.ranked = real
    assert seen and seen[0] < 3 * 3000 / 64


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(catalog.tokenizer_path())


def test_encoder_equals_the_tokenizer(tokenizer):
    rng = random.Random(1)
    signs = "abcdefghijklmnopqrstuvwxyzABCDEFÀÉßñöüçŉſİĲ0123!?.,-_|#*$%&''  \n\t\x0b\xa0́ΑΣς日本<>|endoftext"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(4000)] + [None, "", "   ", "<|endoftext|>", "don't 's", "x" * 3000]
    texts += ["a <|endoftext|> b", "A<|endoftext|>b<|startoftext|>", "<|EndOfText|> <|endoftext", "é<|endoftext|>é"]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(0, 14))) for _ in range(10_000)]
    flat, n = WordBpe(catalog.tokenizer_path()).encode(pa.array(texts))
    want = [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert n.tolist() == [len(w) for w in want] and flat.tolist() == [x for w in want for x in w]


def test_packing_round_trip(spark, tokenizer):
    rng = random.Random(3)
    texts = [None, "", " ", "Hello, World's", prose(rng, 9000)] + [prose(rng, rng.randint(0, 200)) for _ in range(60)] + ["again"] * 2
    pieces = packing.pack(docs_of(spark, texts).repartition(3), catalog.tokenizer_path()).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p["doc_id"]].append(p), sequences[p["sequence_id"]].append(p)
    for i, t in enumerate(texts):
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        parts = sorted(by[i], key=lambda p: p["start"])
        ids = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in parts])
        assert ids.tolist() == want and [p["start"] for p in parts] == np.cumsum([0] + [p["length"] for p in parts[:-1]]).tolist()
        assert all(p["doc_tokens"] == len(want) and p["continued"] == (p["start"] > 0) and p["continues"] == (p["start"] + p["length"] < len(want)) for p in parts)
    last = max(sequences)
    for s, parts in sequences.items():
        parts.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in parts] == np.cumsum([0] + [p["length"] for p in parts[:-1]]).tolist()
        assert sum(p["length"] for p in parts) == 2048 or s == last
    assert sorted(sequences) == list(range(last + 1))
    digests = packing.packed_digests(docs_of(spark, texts[:5]), catalog.tokenizer_path()).where("doc_id = 0").first()
    assert digests["ids_crc32"] == zlib.crc32(np.array([1], "<u4").tobytes())
    assert packing.pack(docs_of(spark, []), catalog.tokenizer_path()).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_equal_their_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        db.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    df = catalog.queries()[name](spark, sf_dir)
    want = db.sql(catalog.oracle_sql()[name])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


def test_pipeline(spark, sf_dir):
    """Every stage on its predecessor's rows, against plain Python where there is one answer."""
    docs = table(spark, sf_dir, "documents").cache()
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, sf_dir).cache()
    verdict = {r["doc_id"]: r["kept"] for r in catalog.op4_quality_rules(spark, sf_dir).collect()}
    assert sorted(r["doc_id"] for r in good.select("doc_id").collect()) == sorted(k for k, v in verdict.items() if v)
    lines = stages["lines"](spark, good, sf_dir).cache()
    pages, held = Counter(), defaultdict(Counter)
    key = lambda x: BLANKS.sub(" ", x).strip(" ")
    for r in good.collect():
        pages[r["source"]] += 1
        held[r["source"]].update({key(x) for x in r["text"].split("\n")} - {""})
    drop = {(s, x) for s, c in held.items() for x, n in c.items() if n >= 5 and n >= 0.02 * pages[s]}
    want = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if (r["source"], key(x)) not in drop) for r in good.collect()}
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == want
    near = stages["near"](spark, lines, sf_dir).cache()
    order = sorted(want)
    kept = {order[root] for _, root in brute_groups([want[i] for i in order])}
    assert {r["doc_id"] for r in near.select("doc_id").collect()} == kept
    mixed = stages["mix"](spark, near, sf_dir).cache()
    assert all(d.columns == docs.columns for d in (good, lines, near, mixed))
    copies = Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    assert set(copies) <= kept and max(copies.values()) <= 2
    packed = stages["pack"](spark, mixed, sf_dir)
    whole = packed.where("start = 0").groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in whole} == copies
    assert words_of("A b") == ["a", "b"] and "A".translate(LOW) == "a"
