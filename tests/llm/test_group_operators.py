import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.llm import embed_dedup, simhash
from tallyspark.llm.components import components


def joined(ids, linked):
    """Smallest id reachable, by union-find over all linked pairs of places."""
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    return [least[find(k)] for k in range(len(ids))]


# ---- components ----------------------------------------------------------------------------------------------------

def test_components_of_odd_graphs(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(501, 700)] + [(3, 2), (2, 3), (9, 9), (None, 4), (700, 120)]
    edges += [(int(a), int(b)) for a, b in rng.integers(1000, 1100, (60, 2))]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    ids = sorted({x for e in real for x in e})
    at = {x: k for k, x in enumerate(ids)}
    assert got == dict(zip(ids, joined(ids, [(at[a], at[b]) for a, b in real]))) or \
        {k: v for k, v in zip(ids, joined(ids, [(at[a], at[b]) for a, b in real]))} == got | {x: x for x in ids if x not in got}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- SimHash -------------------------------------------------------------------------------------------------------

def test_fingerprint_matches_spark_hash(spark):
    text = "A bb\tCc a BB cc  a bb cc\x0bdd É"
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in text.replace("\t", " ").replace("\x0b", " ").split()]
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    hs = [r[0] & (2**64 - 1) for r in spark.createDataFrame([(g,) for g in grams], "g string").select(F.xxhash64("g")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint(text) & (2**64 - 1) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One TWO") == simhash.fingerprint("one\ntwo")


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 900))
def test_tree_finds_every_pair(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, max(1, n // 3), dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (n, 3)).astype(np.uint64)
    fps = np.unique(base[rng.integers(0, len(base), n)] ^ flips[:, 0] ^ flips[:, 1] ^ (flips[:, 2] * rng.integers(0, 2, n).astype(np.uint64)))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    ids = list(range(len(fps)))
    want = joined(ids, list(zip(*np.nonzero(near))))
    got = simhash.links(np.arange(len(fps)), fps, 2, leaf=16)
    assert all(near[a, b] for a, b in got)
    assert joined(ids, got) == want


def check_groups(spark, df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    fps = np.array([simhash.fingerprint(t) for _, t in rows], np.int64).view(np.uint64)
    named = [k for k, (i, _) in enumerate(rows) if i is not None]
    near = np.bitwise_count(fps[named][:, None] ^ fps[named][None, :]) <= 2
    comp = joined([rows[k][0] for k in named], list(zip(*np.nonzero(near))))
    of = {int(fps[k]): c for k, c in zip(named, comp)}
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(df).collect())
    assert got == sorted((i is None, i or 0, f"{int(f):016x}", of.get(int(f))) for (i, _), f in zip(rows, fps))


def test_groups_match_all_pairs(spark, docs, odd_docs):
    check_groups(spark, docs)
    check_groups(spark, odd_docs)


def test_groups_of_many_close_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "fingerprint_column", lambda text, n: F.expr("cast(text as long)"))
    rng = np.random.default_rng(3)
    fps = {int(x) for x in (np.uint64(1) << rng.integers(0, 62, (4000, 4)).astype(np.uint64)).sum(1, dtype=np.uint64).astype(np.int64)}
    rows = [(i, str(f)) for i, f in enumerate(sorted(fps))]
    got = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().sort_values("doc_id")
    near = np.bitwise_count(np.array(sorted(fps), np.uint64)[:, None] ^ np.array(sorted(fps), np.uint64)[None, :]) <= 2
    assert got["component_id"].tolist() == joined(list(range(len(rows))), list(zip(*np.nonzero(np.triu(near, 1)))))


def test_one_of_each_group_stays(spark, docs, odd_docs, no_docs):
    kept = simhash.keep_one(docs)
    groups = simhash.simhash_groups(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in groups.select("component_id").distinct().collect())
    odd = simhash.keep_one(odd_docs)
    assert odd.columns == odd_docs.columns
    # one of each group: the copies of row 1 without an id, and the wordless one beside row 3, go as any other copy does
    assert sorted(r[0] for r in odd.select("doc_id").collect()) == [1, 3, 6, 7, 8, 2**62]
    assert simhash.keep_one(no_docs).count() == 0


# ---- embeddings ----------------------------------------------------------------------------------------------------

def clusters(n=900, d=16, seed=1, noise=0.18):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // 12, d))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    x = centre[rng.integers(0, len(centre), n)]
    x[: n // 3] = centre[0]  # a third of all rows around one point
    x = x + noise * rng.normal(size=x.shape) / np.sqrt(d)
    return (x * rng.uniform(0.1, 9, (n, 1))).astype(np.float32), rng.integers(0, 3, n)


def test_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "PER_CELL", 8)
    monkeypatch.setattr(embed_dedup, "BLOCK", 32)
    x, label = clusters()
    x[5] = x[4]
    label[5] = label[4]
    rows = [(i, [float(a) for a in v], int(c)) for i, (v, c) in enumerate(zip(x, label))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit("clash")).withColumn("cell", F.lit(0))
    got = embed_dedup.near_vectors(df).toPandas().sort_values("vec_id")
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    assert link.sum() > 1000
    found = got["n_links"].to_numpy()
    assert (found <= link.sum(1)).all() and found.sum() >= 0.99 * link.sum()
    want = np.array(joined(list(range(len(x))), list(zip(*np.nonzero(np.triu(link))))))
    assert (got["component_id"].to_numpy() == want).mean() > 0.99
    assert (got["kept"] == (got["vec_id"] == got["component_id"])).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, nan], 1), (7, [inf, 1.0], 1),
            (8, [1.0, None], 1), (9, [], 1), (10, [1.0, 0.0, 0.0], 1), (11, [5.0], 2), (12, [7.0], 2), (13, [-7.0], 2), (None, [1.0, 0.0], 1),
            (2, [2.0, 0.0], 1), (14, [3.0, 0.0], 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"]) for r in embed_dedup.near_vectors(df).collect())
    assert got == [(-1, 0, None), (1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9),
                   (10, 0, 10), (11, 1, 11), (12, 1, 11), (13, 0, 13), (14, 0, 14)]
    assert embed_dedup.near_vectors(df.where("false")).count() == 0


def test_traversal_is_in_order():
    rng = np.random.default_rng(0)
    a, b = np.sort(rng.random(9)).tolist(), np.sort(rng.random(7)).tolist()
    got = embed_dedup._traverse(a, b, 0.6)
    sums = [a[i] + b[j] for i, j in got]
    assert sums == sorted(sums) and len(set(got)) == len(got)
    assert set(got) == {(i, j) for i in range(9) for j in range(7) if a[i] + b[j] <= a[0] + b[0] + 0.6}


# ---- SimHash: rows without a name, repeated names --------------------------------------------------------------------

def chain(seed=0):
    """Three texts, the first and last of which are linked only through the one between."""
    import random

    rng = random.Random(seed)
    text = lambda ws: " ".join(ws)
    far = lambda x, y: ((simhash.fingerprint(text(x)) ^ simhash.fingerprint(text(y))) & (2**64 - 1)).bit_count()

    def changed(ws):
        some = list(ws)
        for _ in range(rng.randint(1, 20)):
            some[rng.randrange(len(some))] = f"x{rng.randrange(10**6)}"
        return some

    a = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
    b = next(x for x in (changed(a) for _ in range(10**4)) if far(a, x) == 2)
    c = next(x for x in (changed(b) for _ in range(10**4)) if far(b, x) == 2 and far(a, x) > 2)
    return text(a), text(b), text(c)


def test_unnamed_row_links_named_ones(spark):
    a, b, c = chain()
    for rows, want in (([(1, a), (2, b), (3, c)], {1: 1, 2: 1, 3: 1}), ([(1, a), (None, b), (3, c)], {1: 1, None: 1, 3: 1}),
                       ([(None, a), (None, b)], {None: None}), ([(5, a), (None, "quite another text")], {5: 5, None: None})):
        got = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_keep_one_loses_no_text(spark):
    x, y, z = ("alpha beta gamma delta " * 9, "one two three four five " * 9, "north south east west up " * 9)
    rows = [(1, x, "a"), (1, y, "a"), (2, x, "b"), (None, z, "c"), (None, z, "d"), (7, "", "e"), (8, None, "f"), (9, y, "g"), (9, y, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string").withColumn("fp", F.lit(0)).repartition(3)
    for _ in range(2):
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns
        got = sorted(((r["doc_id"], r["text"], r["tag"]) for r in kept.collect()), key=repr)
        assert len(got) == 4 and {r[1] or "" for r in got} == {x, y, z, ""}
        assert [r[:2] for r in got if r[1] == x] == [(1, x)] and [r[:2] for r in got if r[1] == y] == [(1, y)]
        assert [r[0] for r in got if not r[1]] == [7]
    equal = spark.createDataFrame([(None, z, "c")] * 3 + [(4, z, "c")] * 2, "doc_id long, text string, tag string")
    assert [tuple(r) for r in simhash.keep_one(equal).collect()] == [(4, z, "c")]
    assert [tuple(r) for r in simhash.keep_one(equal.where("doc_id is null")).collect()] == [(None, z, "c")]


def test_public_functions_ship_their_code(spark):
    from tallyspark.llm import common

    common._shipped.clear()
    assert simhash.simhash_groups(spark.createDataFrame([(1, "a")], "doc_id long, text string")).count() == 1
    assert spark.sparkContext.applicationId in common._shipped
