"""Collocations, decontamination and ranked search against plain re-statements of their definitions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from check import digest
from tallyspark.llm import collocations, decontamination, ranked_search

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.mark.parametrize("name", ["op11_collocations", "op12_decontamination", "op13_ranked_search"])
def test_sql_gives_the_same(name, spark, duck):
    df = E.queries()[name](spark, SF)
    cur = duck.execute(E.oracle_sql()[name])
    cols, rows = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(cols) == sorted(df.columns) and rows
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(cols, rows)[0]


# ---- collocations --------------------------------------------------------------------------------------------------

def plain_collocations(rows, min_count, top):
    seen, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = tuple(re.findall(r"[^\x20\x09]+", piece))
            total[lang] += len(ws)
            for k in (1, 2, 3):
                seen[lang].update(ws[i:i + k] for i in range(len(ws) - k + 1))
    out = []
    for lang, f in seen.items():
        f = {p: n for p, n in f.items() if n >= min_count}
        ranked = []
        for p, a in f.items():
            if len(p) < 2 or any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * n >= 50 * a for q, n in f.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def collocation_rows(n, seed=3):
    rng = random.Random(seed)
    vocabulary = ["New", "york", "city", "é", "x\x00y", "the", "of", "\U0001f600", "ab", "zz"]
    return [(rng.choice(["en", "fr", None, ""]),
             "".join(rng.choice(vocabulary) + rng.choice([" ", "\t", "  ", ". ", ",", "\n", " "]) for _ in range(rng.randrange(40)))) for _ in range(n)]


def test_collocations_match_definition(spark):
    rows = collocation_rows(300) + [("en", None), (None, ""), ("en", "New york city " * 5000)] + [("de", "a b")] * 12
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for min_count, top in ((10, 2000), (4, 7)):
        got = sorted(tuple(r) for r in collocations.collocations(df, min_count, top).collect())
        assert got == plain_collocations(rows, min_count, top)


def test_collocations_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(collocation_rows(200), "lang string, text string")
    whole = sorted(tuple(r) for r in collocations.collocations(df, 5).collect())
    dealt = sorted(tuple(r) for r in collocations.collocations(df.repartition(7), 5, partition_mass=100).collect())
    assert whole == dealt and whole


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 400), st.integers(2, 12))
def test_summary_keeps_every_frequent_place(seed, n, min_count):
    rng = np.random.default_rng(seed)
    places = (rng.zipf(1.3, n) % 300).astype(np.uint32)
    keys, counts = np.unique(places, return_counts=True)
    half = len(keys) // 2  # counters of one place arrive in two parts
    places_in, counts_in = np.concatenate((keys, keys[:half])), np.concatenate((counts, counts[:half]))
    true = dict(zip(*[x.tolist() for x in (keys, counts + np.where(np.arange(len(keys)) < half, counts, 0))]))
    got, left, less = collocations.merged(places_in, counts_in, min_count)
    kept = dict(zip(got.tolist(), left.tolist()))
    assert less < min_count and len(kept) <= sum(true.values()) // min_count + 1
    for place, f in true.items():
        assert f - less <= kept.get(place, 0) <= f
        if f >= min_count:
            assert kept[place] + less >= min_count


def test_collocations_odd_rows(odd_docs, no_docs):
    got = collocations.collocations(odd_docs, 3)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = [(r["lang"], r["text"]) for r in odd_docs.collect()]
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, 3, 2000)
    assert collocations.collocations(no_docs).count() == 0


# ---- decontamination -----------------------------------------------------------------------------------------------

def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_passages(rows, items, size=10):
    found = []
    for doc, text in rows:
        ws, hit, met = plain_words(text), set(), set()
        for item, body in items:
            own = plain_words(body)
            for w in ([own[i:i + size] for i in range(len(own) - size + 1)] if len(own) >= size else [own] if own else []):
                for i in range(len(ws) - len(w) + 1):
                    if ws[i:i + len(w)] == w:
                        hit.update(range(i, i + len(w)))
                        met |= {str(item)} - {"None"}
        found.append((doc, len(ws), len(hit), tuple(sorted(met))))
    return sorted(found, key=repr)


def passages(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in df.collect()), key=repr)


def passage_tables(seed=5):
    """Few different words, so windows overlap, repeat and share blocks."""
    rng = random.Random(seed)
    some = lambda n: " ".join(rng.choice(["a", "B", "c", "dé", "e5"]) for _ in range(n))
    items = [(k, some(n)) for k, n in enumerate([14, 10, 10, 25, 3, 1, 9, 0])] + [(2, None), (None, some(12)), (20, " ., "), (21, "a " * 30)]
    items.append((22, items[0][1]))
    rows = [(k, some(rng.randrange(60)) + " - " + rng.choice(items)[1 if k % 3 else 1].__str__() + ", " + some(5)) for k in range(60)]
    rows += [(7, rows[7][1]), (7, "other"), (None, items[0][1]), (None, items[3][1]), (None, None), (99, None), (100, ""), (101, some(30_000))]
    return rows, items


@pytest.mark.parametrize("pairs", [200_000, 15])
def test_passages_match_definition(spark, pairs):
    rows, items = passage_tables()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit(1)).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit("x"))
    short = [r for r in rows if len(r[1] or "") < 10_000]
    docs = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 10_000)
    assert passages(decontamination.find_passages(docs, bench, pairs=pairs)) == plain_passages(short, items)


def test_passages_in_a_very_long_text(spark):
    rng = random.Random(1)
    ws = [rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(50_000)]
    items = [(k, " ".join(ws[s:s + 15])) for k, s in enumerate((0, 777, 49_985, 25_000, 25_005))]
    docs = spark.createDataFrame([(1, " ".join(ws)), (2, " ".join(ws[:9]))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.find_passages(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert [tuple(s) for s in got[1]["spans"]] == [(0, 15), (777, 792), (25_000, 25_020), (49_985, 50_000)]
    assert got[1]["items"] == ["0", "1", "2", "3", "4"] and got[1]["n_hit"] == 65 and got[2]["n_hit"] == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 12), st.integers(1, 6))
def test_search_finds_every_occurrence(seed, m, symbols):
    rng = np.random.default_rng(seed)
    rows = np.unique(rng.integers(1, symbols + 1, (rng.integers(1, 30), m)), axis=0)
    sym = rng.integers(0, symbols + 1, rng.integers(0, 900))
    at, row = decontamination.Tables(rows).search(sym)
    want = {(i + m - 1, r) for i in range(len(sym) - m + 1) for r in range(len(rows)) if (sym[i:i + m] == rows[r]).all()}
    assert set(zip(at.tolist(), row.tolist())) == want and len(at) == len(want)


def test_passages_odd_rows(spark, odd_docs, no_docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontamination.find_passages(odd_docs, bench).count() == odd_docs.count()
    assert decontamination.find_passages(no_docs, bench).count() == 0
    assert {r["n_hit"] for r in decontamination.find_passages(odd_docs, bench.where("false")).collect()} == {0}


# ---- ranked search -------------------------------------------------------------------------------------------------

def plain_search(rows, items, k=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    docs = [(doc, Counter(cut(t))) for doc, t in rows]
    docs = [(doc, c, sum(c.values())) for doc, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c, n in docs:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in cut(text) if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def search_tables(seed=9):
    rng = random.Random(seed)
    some = lambda n: " ".join(rng.choice("the of a_b é x-y UP up 7 z".split()) for _ in range(n))
    rows = [(k, some(rng.randrange(8))) for k in range(500)] + [(3, "up up"), (None, "up up"), (None, None), (None, "up up"), (900, ""), (901, some(20_000))]
    items = [(k, some(n)) for k, n in enumerate((1, 2, 5, 40, 0, 9))] + [(1, "up"), (None, "é É"), (30, None), (31, "nowhere")]
    return rows, items


@pytest.mark.parametrize("item_bytes", [1_000_000, 30])
def test_search_matches_definition(spark, item_bytes):
    rows, items = search_tables()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(4)
    got = ranked_search.search(docs, spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0)), item_bytes=item_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_search(rows, items)


def test_small_tiles_give_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    counts = [{int(t): int(rng.integers(1, 4)) for t in rng.integers(0, 50, 12)} for _ in range(9)] + [{}, {3: 5}]
    weights = {t: int(rng.integers(0, 9000)) for t in range(50)}
    monkeypatch.setattr(ranked_search, "TERM_TILE", 3)
    monkeypatch.setattr(ranked_search, "ITEM_TILE", 4)
    for exact in (2 ** 53, ranked_search.IMPACT * 5000):  # with the lower bound, weights are spread over columns
        monkeypatch.setattr(ranked_search, "EXACT", exact)
        sums = np.zeros((len(counts), 50), np.int64)
        for lo, hi, parts in ranked_search.tiles(counts, weights):
            for terms, w in parts:
                assert len(terms) <= 3 and (w.max(axis=1).sum() * ranked_search.IMPACT < exact)
                for t, row in zip(terms.tolist(), w):
                    sums[lo:hi, t] += row.astype(np.int64)
        assert (sums == [[c.get(t, 0) * weights[t] for t in range(50)] for c in counts]).all()


def test_ties_at_the_edge_go_by_doc_id():
    best = ranked_search.Best(1, 3)
    for lot in ([9, 8, 7], [6, 1, 30], [5]):
        best.add(0, np.full((len(lot), 1), 44), np.array(lot), np.zeros(len(lot), bool))
    best.add(0, np.array([[44], [45]]), np.array([0, 70]), np.array([True, False]))
    assert best.doc.tolist() == [70, 1, 5]


def test_search_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "the cat"), (2, "word")], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = ranked_search.search(odd_docs, bench)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_search(rows, [(1, "the cat"), (2, "word")])
    assert ranked_search.search(no_docs, bench).count() == 0
    assert ranked_search.search(odd_docs, bench.where("false")).count() == 0
