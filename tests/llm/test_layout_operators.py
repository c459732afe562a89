import posixpath
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import mixing, packing, quality, sharding, simhash, token_output, toxicity
from tallyspark.llm.common import checkpoint_dir
from tallyspark.llm.tokens import WordTokenizer, cut_pieces

SF = "/root/testdata/sf0.001"


# ---- tokens --------------------------------------------------------------------------------------------------------

def test_word_tokenizer_equals_the_library(token_file, docs):
    tok = WordTokenizer(token_file, max_cached=500)
    texts = ["", "  a  ", "<|endoftext|> hi<|startoftext|>x", "Ünïcode ΣΑΣ naïve İstanbul", "can't we'll 'tis it's", "a\x1cb\x85c\xa0d　e",
             "中文 text ́ é", "½ ² 12345 ###$$$ the,,, x.y", "don't!! ​ zero", "ﬁ ǅ ǆ ß"] + [r[0] for r in docs.select("text").collect()]
    want = [np.array(e.ids, "<u4").tobytes() for e in tok.full.encode_batch(texts, add_special_tokens=False)]
    assert tok.encode(texts, step=64) == want


# ---- sharding ------------------------------------------------------------------------------------------------------

@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=0, max_size=80), st.integers(1, 7))
def test_best_fit_decreasing(sizes, shards):
    place = sharding.assign([(str(k), s) for k, s in enumerate(sizes)], shards)
    assert sorted(place) == sorted(str(k) for k in range(len(sizes))) and all(0 <= x < shards for x in place.values())
    ordered, rooms, out = sorted(sizes, reverse=True), [], []
    for s in ordered:  # the same rule with a plain list
        fit = [(r, k) for k, r in enumerate(rooms) if r >= s]
        if fit:
            k = min(fit)[1]
        else:
            k = len(rooms)
            rooms.append(500)
        rooms[k] -= s
        out.append(k)
    assert sharding.best_fit_decreasing(ordered, 500, 10**6) == out


def check_shards(df, n):
    got = sharding.shard(df, n).toPandas()
    texts = Counter(r["text"] or "" for r in df.collect())
    assert len(got) == sum(texts.values())
    assert Counter(got["text_crc32"]) == Counter({zlib.crc32(t.encode()): 0 for t in texts} | {}) + Counter(
        {c: k for c, k in Counter(zlib.crc32(t.encode()) for t, m in texts.items() for _ in range(m)).items()})
    assert (got.groupby("text_crc32")["shard"].nunique() <= 1).all()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    return got


def test_shards(spark, docs, odd_docs, no_docs):
    got = check_shards(docs, 24)
    bytes_ = got.groupby("shard")["size"].sum()
    assert len(bytes_) == 24 and bytes_.max() - bytes_.min() <= got["size"].max()
    check_shards(odd_docs, 3)
    assert sharding.shard(no_docs).count() == 0


# ---- mixing --------------------------------------------------------------------------------------------------------

def test_targets_reshare_the_excess():
    t = mixing.targets([("b", 100), ("a", 100), (None, 100), ("c", 100)])
    assert t == {"a": 200.0, "b": pytest.approx(400 * 2 / 8), "c": pytest.approx(400 * 1 / 8), None: 200.0} or sum(t.values()) == pytest.approx(600)
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}
    assert all(v <= 2 * 100 for v in t.values())


def test_mix_meets_targets(spark, docs, odd_docs, no_docs):
    for df in (docs, odd_docs):
        got = mixing.mix(df).toPandas()
        assert len(got) == df.count()
        source = {(r["doc_id"], len((r["text"] or "").split())): r["source"] for r in df.collect()}
        got["source"] = [source.get((None if np.isnan(i) else int(i), s), "?") or "-" for i, s in zip(got["doc_id"].astype(float), got["size"])]
        assert got["copies"].between(0, 2).all() and (got["taken"] == got["copies"] * got["size"]).all()
        for _, g in got.groupby(["source_size", "target"]):
            assert abs(g["taken"].sum() - g["target"].iloc[0] * g["source"].nunique()) <= max(g["size"].max(), 1) * g["source"].nunique()
        again = mixing.mix(df).toPandas()
        order = ["doc_id", "size", "copies"]
        assert again.sort_values(order)[order].reset_index(drop=True).equals(got.sort_values(order)[order].reset_index(drop=True))
    assert mixing.mix(no_docs).count() == 0


def test_multipliers_meet_targets_before_rounding(spark):
    rng = np.random.default_rng(1)
    rows = [("a", int(s), 3) for s in set(rng.integers(1, 4000, 200))] + [("b", 7, 10**9), (None, 5, 2)]
    cells = spark.createDataFrame(rows, "source string, size long, n long")
    own = {s: sum(r[1] * r[2] for r in rows if r[0] == s) for s in ("a", "b", None)}
    mean = {s: own[s] / sum(r[2] for r in rows if r[0] == s) for s in own}
    goal = {"a": 0.3 * own["a"], "b": 1.99 * own["b"], None: 2.0 * own[None]}
    lam = mixing.solve(cells, own, goal, mean)
    for s in own:
        got = sum(n * z * 2 / (1 + np.exp(-lam[s] * z / mean[s])) for q, z, n in rows if q == s)
        assert got == pytest.approx(goal[s], rel=1e-6)


def test_mixed_rows_follow_the_copies(spark, odd_docs, docs):
    for df in (docs, odd_docs):
        rows = mixing.mixed_rows(df)
        assert rows.columns == df.columns
        want = Counter()
        for r in mixing.mix(df).collect():
            want[r["doc_id"]] += r["copies"]
        assert Counter(r[0] for r in rows.select("doc_id").collect()) == +want


# ---- packing -------------------------------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 300), max_size=40))
def test_plan_places_everything(counts):
    got = Counter()
    patterns = packing.plan(counts, 100, 8)
    for p, n in patterns.items():
        assert sum(p) <= 100 and n > 0
        for x in p:
            got[x] += n
    assert got == Counter(counts)
    # no packing needs fewer: by volume, and as no two pieces above half the room share a sequence
    low = max(-(-sum(k * v for k, v in counts.items()) // 100), sum(v for k, v in counts.items() if k > 50))
    assert low <= sum(patterns.values()) <= 1.7 * low + 1


def check_packing(df, token_file, capacity):
    got = packing.pack_documents(df, token_file, capacity).toPandas()
    tok = WordTokenizer(token_file)
    want = Counter()
    for r in df.collect():
        ids = tok.encode([r["text"] or ""])[0] + b"\0\0\0\0"
        for i, at in enumerate(range(0, len(ids) // 4, capacity)):
            part = ids[4 * at:4 * (at + capacity)]
            want[(r["doc_id"] if r["doc_id"] is not None else -1, i, at, len(part) // 4, zlib.crc32(part))] += 1
    have = Counter(zip(got["doc_id"].fillna(-1).astype(int), got["piece"], got["start"], got["length"], got["ids_crc32"]))
    assert have == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.cumsum(g["length"]) - g["length"].to_numpy()).all() and g["length"].sum() <= capacity
    return got


def test_packing(spark, docs, odd_docs, no_docs, token_file):
    got = check_packing(docs, token_file, 2048)
    assert got["sequence_id"].nunique() <= 1.03 * (-(-got["length"].sum() // 2048)) + 1
    check_packing(odd_docs, token_file, 64)
    assert packing.pack_documents(no_docs, token_file).count() == 0


# ---- token output --------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 3, 100, 4097])
def test_feistel_is_a_permutation(n):
    x = np.arange(n)
    y = token_output.feistel(x, n, 99)
    assert sorted(y) == list(range(n)) and (token_output.feistel(y, n, 99, back=True) == x).all()
    assert n < 50 or (y != token_output.feistel(x, n, 100)).any()


def test_shard_files_hold_every_sequence(spark, docs, odd_docs, no_docs, token_file):
    for k, df in enumerate((docs, odd_docs, no_docs)):
        folder = posixpath.join(checkpoint_dir(spark), f"tokens-{k}-{np.random.default_rng().integers(10**12)}")
        got = token_output.write_shards(df, folder, token_file, ids=32, shard_bytes=20_000).toPandas().sort_values("slot")
        assert got["slot"].tolist() == list(range(len(got)))
        files = list(token_output.read_slots(spark, folder, 0, 10**9))
        assert [zlib.crc32(f.tobytes()) for f in files] == got["ids_crc32"].tolist()
        tok = WordTokenizer(token_file)
        want = Counter()
        for r in df.collect():
            ids = np.append(np.frombuffer(tok.encode([r["text"] or ""])[0], "<u4"), 0).astype("<u2")
            for i in range(0, len(ids), 32):
                want[zlib.crc32(ids[i:i + 32].tobytes())] += 1
        assert Counter(got["ids_crc32"]) == want
        if len(files) > 40:
            assert [x.tolist() for x in token_output.read_slots(spark, folder, 17, 5)] == [x.tolist() for x in files[17:22]]


def test_id_width_follows_the_vocabulary(spark, odd_docs, token_file, monkeypatch):
    """Ids beyond 16 bits are written whole, and no id is taken for padding."""
    assert token_output.id_type(token_file) == "<u2" and token_output.id_type(token_file, 65_534) == "<u2"
    assert token_output.id_type(token_file, 65_535) == "<u4"
    for end in (65_535, 70_000):
        folder = posixpath.join(checkpoint_dir(spark), f"tokens-{end}-{np.random.default_rng().integers(10**12)}")
        got = token_output.write_shards(odd_docs, folder, token_file, ids=16, end_id=end)
        files = list(token_output.read_slots(spark, folder, 0, 10**9))
        assert sum(int((f == end).sum()) for f in files) == odd_docs.count()
        assert sorted(len(f) for f in files) == sorted(r["n_ids"] for r in got.collect())


def test_unknown_partitions_are_an_error(spark, odd_docs, token_file):
    rows = token_output.sequences(odd_docs.repartition(3), token_file, {0: 0}, 10**6, 10**6)
    with pytest.raises(Exception, match="was not there when the sequences were numbered"):
        rows.collect()


def test_ids_are_the_tokenizers(token_file):
    """Contractions, digits, runs of signs, case and letters on both sides of what is taken as plain text."""
    import random

    tok, rng = WordTokenizer(token_file), random.Random(1)
    alphabet = "abcXYZ'sSdtlLrevm0129.,;:!?|-_#@ \n\t\x0b éÀßñŉǆ×÷²¼ºªµ日\U0001f600"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["we'LL it's !'s", "<unk> </w> a</w>", "A\u0301 e\u0301", "１２", "İx"]
    for t, got in zip(texts, tok.encode(texts)):
        assert got == np.array(tok.full.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_pieces_are_the_ids_again(token_file):
    tok = WordTokenizer(token_file)
    texts = ["", None, "a b c d e f g", "é . x" * 9, " \n ", "one"]
    flat, bounds = tok.encode_flat(texts)
    assert [flat[a:z].tobytes() for a, z in zip(bounds, bounds[1:])] == tok.encode([t or "" for t in texts])
    for size in (1, 3, 2048):
        ids, text, number, cuts = cut_pieces(flat, bounds, 7, size)
        back = [ids[a:z].tolist() for a, z in zip(cuts, cuts[1:])]
        for k, t in enumerate(texts):
            mine = [b for b, x in zip(back, text) if x == k]
            assert sum(mine, []) == [*np.frombuffer(tok.encode([t or ""])[0], "<u4").tolist(), 7]
            assert all(len(m) == size for m in mine[:-1]) and 1 <= len(mine[-1]) <= size
            assert [n for n, x in zip(number.tolist(), text) if x == k] == list(range(len(mine)))
    assert [len(x) for x in cut_pieces(*tok.encode_flat([]), 0, 5)] == [0, 0, 0, 1]


# ---- pipeline ------------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark, docs):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF)
        kept = kept.persist()
        assert kept.columns == docs.columns, name
        ids, prior = Counter(r[0] for r in kept.select("doc_id").collect()), {r[0] for r in before.select("doc_id").collect()}
        assert set(ids) <= prior
        assert name == "mixing" or max(ids.values()) == 1
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert Counter(r[0] for r in packed.where("piece = 0").select("doc_id").collect()) == Counter(r[0] for r in kept.select("doc_id").collect())


def test_pipeline_matches_plain_stages(spark, docs):
    lex = toxicity.fit_lexicon(toxicity.labelled_sample(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    clean = [r for r in docs.collect() if lex.score(r["text"]) < toxicity.THRESHOLD]
    got = toxicity.drop_toxic(docs, lex)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in clean)
    good = quality.drop_poor(got)
    verdict = {r["doc_id"] for r in quality.quality(got).where("kept").collect()}
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(verdict)
    fps = {r["doc_id"]: simhash.fingerprint(r["text"]) & (2**64 - 1) for r in good.collect()}
    left, groups = set(fps), 0
    first = set()
    while left:
        group, todo = set(), [min(left)]
        first.add(min(left))
        while todo:
            x = todo.pop()
            if x in left:
                left.discard(x)
                group.add(x)
                todo += [y for y in left if (fps[x] ^ fps[y]).bit_count() <= 2]
        groups += 1
    assert {r["doc_id"] for r in simhash.keep_one(good).collect()} == first


def test_odd_rows_pass_every_stage(spark, odd_docs, no_docs, token_file):
    for df in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, SF).columns == df.columns
        assert packing.pack_documents(df.withColumn("piece", F.lit(1)), token_file).count() >= df.count()
