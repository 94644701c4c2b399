"""Operators 1, 3 and 6 against brute force, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshwork.llm import exact_dedup as E
from meshwork.llm import line_dedup as L
from meshwork.llm import near_dedup as N
from meshwork.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id string, key int"
BLANKS = re.compile(r"[\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, texts, first=0):
    """Documents with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(first + i, t, "en", "s", None, True, "x", 1) for i, t in enumerate(texts)], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(n))


def edge_texts(rng):
    base = prose(rng, 120)
    words = base.split()
    near = [" ".join(words[:i] + ["Zz"] + words[i + 1 :]) for i in (5, 60, 110)]
    return [None, "", " \n\t", base, base.upper(), base.replace(" ", "  "), *near, prose(rng, 120), "one two", "ONE two ", "a b c d e", prose(rng, 20_000), base, base]


# exact dedup


def test_filters_hold_their_keys():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        blob = E.build_filter(keys)
        assert E.in_filter(blob, keys).all()
    assert len(blob) < 1.3 * len(keys)  # small filters have more room
    others = rng.integers(0, 2**63, 100_000, dtype=np.uint64)
    assert E.in_filter(blob, others).mean() < 0.01


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_exact_dedup(spark, batches):
    texts = edge_texts(random.Random(1))
    got = {r["doc_id"]: r for r in E.exact_dedup(docs_of(spark, texts), batches=batches).collect()}
    norm = [BLANKS.sub(" ", t or "") for t in texts]
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (same[0], len(same), i == same[0])
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("batches", [1, 2])
def test_exact_dedup_keeps_one_row_of_equal_texts(spark, batches):
    """Null and repeated ids too: any id comes before null."""
    rows = [(5, "a"), (5, "a"), (None, "b"), (7, "b"), (None, "c"), (None, "c"), (None, "d"), (9, ""), (9, None), (9, "a"), (None, " \t"), (None, " ")]
    got = E.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), batches=batches).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    seen = {t: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in got if r["text_sha256"] == sha(t)) for t in ("a", "b", "c", "d", "", " ")}
    assert [x[4] for x in seen["a"]] in ([True, False, False], [False, True, False]) and {x[2:4] for x in seen["a"]} == {(5, 3)}
    assert seen["b"] == [(False, 7, 7, 2, True), (True, 0, 7, 2, False)]
    assert sorted(x[4] for x in seen["c"]) == [False, True] and {x[2] for x in seen["c"]} == {None}
    assert seen["d"] == [(True, 0, None, 1, True)] and sum(x[4] for x in seen[""]) == sum(x[4] for x in seen[" "]) == 1
    assert len(got) == len(rows) and E.exact_dedup(docs_of(spark, [])).count() == 0


# line dedup


def test_pages(spark):
    page = lambda body: f"<html><head><title>T</title><script>x('</p>')</script></head><body><nav><li>Home</li></nav><p>{body}</p><!-- c --><footer>&copy; all &amp; more</footer></body></html>"
    rows = [(i, f"https://A.example/{i}", page(f"text {i}")) for i in range(10)] + [(10, None, None), (11, "http://b.example", page("only")), (12, "bad url", ""), (13, "https://a.example/x", "<p>Home<br>Home</p>")]
    out = {r["page_id"]: r for r in L.clean_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3]["text"] == "text 3" and out[3]["n_lines"] == 4 and out[3]["n_dropped"] == 3 and out[3]["host"] == "a.example"
    assert out[11]["text"] == "T\nHome\nonly\n© all & more" and out[10]["text"] == "" and out[12]["host"] == "" and out[13]["n_dropped"] == 2
    assert L.clean_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_very_long_pages_and_clashing_names(spark):
    rng = random.Random(14)
    long = "".join(f"<p>{prose(rng, 3)} {i}</p>" for i in range(20_000))
    rows = [(i, "http://a.example/x", f"<div>menu</div><p>{i}</p>{long if i == 0 else ''}", "x", 1, 2, 3) for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, lines int, keys int, often int")
    out = {r["page_id"]: r for r in L.clean_pages(pages).collect()}
    assert out[0]["n_lines"] == 20_002 and out[0]["n_dropped"] == 1 and out[1]["text"] == "1"
    docs = docs_of(spark, ["a\nb"] * 3 + [None]).withColumns({c: F.lit(1) for c in ("host", "lines", "keys", "often", "own", "row", "n_lines", "n_dropped", "__host")})
    kept = L.clean_documents(docs)
    assert kept.columns == docs.columns and sorted(r["text"] or "" for r in kept.collect()) == ["", "a\nb", "a\nb", "a\nb"]


def test_a_line_is_told_from_another_with_its_hash(spark, monkeypatch):
    """Where all lines share a hash, the lines themselves decide."""
    real = F.xxhash64
    monkeypatch.setattr(L.F, "xxhash64", lambda *c: real(F.length(c[0])) if len(c) == 1 else real(*c))
    rows = [(i, "http://a.example", f"<p>menu</p><p>x{i:03d}</p>") for i in range(100)]
    out = L.clean_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in out} == {i: f"x{i:03d}" for i in range(100)}


def test_documents_lose_boilerplate_only(spark):
    rng = random.Random(4)
    texts = [f"{prose(rng, 30)}\nsubscribe to our  letter\n\n{prose(rng, 9)}" for _ in range(40)] + [None, "", "subscribe to our letter"]
    df = docs_of(spark, texts).withColumn("n_chars", F.char_length("text").cast("long"))
    got = {r["doc_id"]: r for r in L.clean_documents(df).collect()}
    assert list(got[0].asDict()) == df.columns and len(got) == 43
    for i, t in enumerate(texts[:40]):
        want = "\n".join(x for x in t.split("\n") if not x.startswith("subscribe"))
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)
    assert got[40]["text"] is None and got[41]["text"] == "" and got[42]["text"] == ""


@pytest.mark.parametrize("copies", [5, 60])
def test_copies_of_a_document_are_one_page(spark, copies):
    rng = random.Random(6)
    clean = f"{prose(rng, 30)}\n{prose(rng, 30)}\n{prose(rng, 9)}"
    texts = [f"{prose(rng, 30)}\nsubscribe to our letter" for _ in range(100)] + [clean] * copies
    lines = L.clean_documents(docs_of(spark, texts))
    got = [r["text"] for r in lines.orderBy("doc_id").collect()]
    assert got[100:] == [clean] * copies
    assert got[:100] == [t.split("\n")[0] for t in texts[:100]]
    assert [r["text"] for r in N.keep_one(lines).collect()].count(clean) == 1
    # copies do not raise the source's total either: 6 of 105 texts hold the line
    few = [f"{prose(rng, 20)}\nread on" for _ in range(6)] + [prose(rng, 20) for _ in range(98)] + [clean] * 300
    assert not any("read on" in r["text"] for r in L.clean_documents(docs_of(spark, few)).collect())


# near dedup


def words_of(t):
    return [w for w in BLANKS.split((t or "").translate(LOW)) if w]


def set_of(t):
    w = words_of(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_groups(texts):
    sets = [set_of(t) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_shingle_sets():
    rng = random.Random(2)
    texts = edge_texts(rng) + ["Ärger ÄRGER a", "ärger a", "x" * 5000, "İ ı"]
    got = shingle_sets(pa.array(texts))
    want = [set_of(t) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])
    assert [len(s) for s in shingle_sets(pa.array(texts).slice(3, 4))] == [len(s) for s in want[3:7]]


def test_superminhash_estimates():
    rng = np.random.default_rng(7)
    errors = []
    for n in (1, 3, 40, 300, 3000):
        pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = np.unique(pool[: n + n // 2]), np.unique(pool[n // 2 :])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append(abs((N.superminhash(a) == N.superminhash(b)).mean() - true))
        assert np.isfinite(N.superminhash(a)).all() and (N.superminhash(a) == N.superminhash(a[::-1])).all()
    assert max(errors) < 0.15


def test_bitmaps_never_show_more_differences_than_there_are():
    rng = np.random.default_rng(5)
    for n in (1, 7, 200, 3000):
        pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        for share in (0, n // 8, n):
            a, b = np.unique(pool[:n]), np.unique(pool[share : share + n])
            seen = sum((x ^ y).bit_count() for x, y in zip(N.bitmap(a).view(np.uint64).tolist(), N.bitmap(b).view(np.uint64).tolist()))
            assert seen <= len(np.setxor1d(a, b)) and (n > 200 or share == 0 or seen > 0)


def near_family(rng, n, edits):
    words = prose(rng, 150).split()
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = prose(rng, 1) + "q"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small", [48, 2])
def test_near_groups(spark, monkeypatch, small):
    monkeypatch.setattr(N, "SMALL", small)
    rng = random.Random(11)
    passage = prose(rng, 60)
    texts = edge_texts(rng) + near_family(rng, 30, 7) + [f"{passage} {prose(rng, 40)}" for _ in range(30)] + [prose(rng, rng.randint(1, 60)) for _ in range(20)]
    got = {r["doc_id"]: r for r in N.near_groups(docs_of(spark, texts)).collect()}
    want = brute_groups(texts)
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_near_groups_without_ids_and_of_repeated_ids(spark):
    """Rows are documents of their own, whatever their ids; a group is named by its smallest id."""
    rng = random.Random(17)
    family, other = near_family(rng, 6, 3), near_family(rng, 3, 2)
    rows = [(4, family[0]), (4, other[0]), (None, family[1]), (2, family[2]), (None, other[1]), (9, None), (None, None), (None, "a b c d e f"), (None, "A b c d e f"), (7, "a b c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "row", "own", "component", "first", "kept", "gone")})
    want = brute_groups([t for _, t in rows])
    ids = [min((i for (i, _), (_, root) in zip(rows, want) if root == r and i is not None), default=None) for _, r in want]
    got = N.near_groups(docs).collect()
    show = lambda x: (x is None, x or 0)
    assert sorted((show(r["doc_id"]), r["n_shingles"], show(r["component_id"])) for r in got) == sorted((show(i), n, show(c)) for (i, _), (n, _), c in zip(rows, want, ids))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["component_id"] is not None)
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({root for _, root in want})
    left = [r["text"] for r in kept.collect()]
    assert sum(t in family for t in left) == 1 and sum(t in other for t in left) == 1 and left.count(None) == 2


def test_near_groups_of_nothing_and_of_repeats(spark):
    assert N.near_groups(docs_of(spark, [])).count() == 0
    twice = docs_of(spark, ["a b c d e f", None]).union(docs_of(spark, ["a b c d e f", None]))
    assert sorted((r["doc_id"], r["component_id"]) for r in N.near_groups(twice).collect()) == [(0, 0), (0, 0), (1, 1), (1, 1)]
    kept = N.keep_one(docs_of(spark, ["a b c d e f", "a b c d e f ", "", None]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3] and kept.columns == docs_of(spark, []).columns
