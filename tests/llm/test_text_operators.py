import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from check import digest
from tallyspark.llm import chat, html_extract, quality, toxicity

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


# ---- toxicity ------------------------------------------------------------------------------------------------------

def test_fold_undoes_disguises():
    assert toxicity.fold("ІDІОТ") == toxicity.fold("idiot")  # Cyrillic letters
    assert toxicity.fold("1d10t") == toxicity.fold("idiot") == toxicity.fold("ｉｄｉｏｔ")
    assert toxicity.fold("l0ser, $cum!") == toxicity.fold("loser scum")
    assert toxicity.fold(None) == toxicity.fold("") == "  "


def test_exceptions_and_length():
    lex = toxicity.Lexicon({" trash": 5.0, " idiot ": 4.0}, ("trash can",), -2.0, 1.0)
    assert lex.density("a trash can here") == 0.0
    assert lex.density("you trash") > lex.density("you trash " + "word " * 50) > 0
    assert lex.density("idiotic") == 0.0 and lex.density("trashy") > 0  # whole word against beginning
    assert 0 < lex.score("") < 0.3 and lex.score("trash " * 5) > 0.9


def test_toxicity_learns_held_out(spark):
    out = E.queries()["op1_toxicity"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert out.count() == docs.count()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = out.where("held_out").join(labels, "doc_id").toPandas()
    assert ((got["predicted"] == 1) == (got["toxic"] == 1)).mean() > 0.93
    assert got["score"].between(0, 1).all()


def test_whole_words_do_not_match_longer_ones(spark):
    rows = [(f"you oaf {k}", 1) for k in range(40)] + [(f"an oafish hat {k}", 0) for k in range(40)] + [(f"see the oafen {k}", 1) for k in range(40)]
    lex = toxicity.fit_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert " oaf " in lex.weights and " oaf" not in lex.weights
    assert lex.density("you oaf") > 0 and lex.density("the oafen") > 0 and lex.density("an oafish hat") == 0.0


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    lab = spark.createDataFrame([(1, 1, None), (3, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    lex = toxicity.fit_lexicon(toxicity.labelled_sample(odd_docs, lab))
    out = toxicity.toxicity(odd_docs, lex).toPandas()
    assert len(out) == odd_docs.count() and out["score"].between(0, 1).all()
    assert toxicity.toxicity(no_docs, lex).count() == 0
    assert toxicity.drop_toxic(odd_docs, toxicity.Lexicon({" cat": 9.0}, (), -3.0, 3.0)).columns == odd_docs.columns
    empty = toxicity.fit_lexicon(toxicity.labelled_sample(no_docs, lab.where("false")))
    assert empty.weights == {}


def test_automaton_matches_plain_search():
    rng = random.Random(4)
    lex = toxicity.Lexicon({f" {w}": 1.0 + k for k, w in enumerate(["ab", "abc", "ca"])} | {" bb ": 9.0}, ("abc d",))
    for _ in range(300):
        t = " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 4))) for _ in range(8))
        folded, total = toxicity.fold(t), 0.0
        free = [(m.start(), m.end()) for m in re.finditer(r"(?= abc d)", folded) for m in [re.compile(" abc d").match(folded, m.start())]]
        for m in re.finditer(" ", folded[:-1]):
            at = m.start()
            best = max([w for term, w in lex.weights.items() if folded.startswith(term, at)], default=0)
            if best and not any(a <= at < b for a, b in free):
                total += best
        assert lex.density(t) == pytest.approx(np.log1p(100 * total / 8))


# ---- quality -------------------------------------------------------------------------------------------------------

def plain_figures(text):
    t = text or ""
    words = [w for w in SPACE.split(t) if w]
    wins = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for w in wins:
        seen[w] = seen.get(w, 0) + 1
    places = {i + k for i, w in enumerate(wins) if seen[w] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if SPACE.sub("", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(places)


def test_base_figures_match_plain(spark, docs, odd_docs):
    for df in (docs, odd_docs):
        got = quality.quality(df).collect()
        want = {r["doc_id"]: plain_figures(r["text"]) for r in df.collect()}
        assert len(got) == df.count()
        for r in got:
            if r["doc_id"] is not None:
                assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want[r["doc_id"]]
                assert not (r["base_failed"] and r["kept"])


def test_repeats_many_and_few(spark):
    few, many = "a b c " * 9, " ".join(f"w{i % 200}" for i in range(900))
    got = quality.quality(spark.createDataFrame([(1, few, "en"), (2, many, "en")], "doc_id long, text string, lang string")).collect()
    assert {r["doc_id"]: r["n_repeat_words"] for r in got} == {1: plain_figures(few)[4], 2: plain_figures(many)[4]}


def test_quality_keeps_clean_and_drops_poor(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.quality(docs).join(labels, "doc_id").where("not base_failed").toPandas()
    assert got[got["quality"] == 1]["kept"].mean() > 0.99
    assert got[got["quality"] == 0]["kept"].mean() < 0.3
    assert quality.quality(no_docs).count() == 0
    out = quality.drop_poor(odd_docs)
    assert out.columns == odd_docs.columns and out.count() <= odd_docs.count()


@pytest.mark.parametrize("others", [0, 9, 199])
def test_verdict_does_not_hang_on_the_size_of_a_language(spark, others):
    """A rare language's junk is judged like a common one's, and its prose is kept."""
    rng = random.Random(7)
    prose = lambda: " ".join(rng.choice("ser las casa en monte que rio para flor con agua sol y luna".split()) for _ in range(120)).capitalize() + "."
    junk = " ".join(f"{rng.randrange(10**6)}#%$|" for _ in range(96))
    rows = [(k, prose(), "xx") for k in range(2, others + 2)] + [(k, prose(), "en") for k in range(1000, 1200)] + [(0, junk, "xx"), (1, prose(), "xx")]
    got = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[0] and got[1] and sum(got.values()) == len(rows) - 1


@pytest.mark.parametrize("name", ["op8_chat_formatting", "op10_quality_rules"])
def test_sql_gives_the_same(name, spark, duck):
    df = E.queries()[name](spark, SF)
    cur = duck.execute(E.oracle_sql()[name])
    cols, rows = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(cols) == sorted(df.columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(cols, rows)[0]


# ---- chat ----------------------------------------------------------------------------------------------------------

def test_machine_is_in_the_plan(spark):
    """The registered query's rows carry what the machine says of their turn order."""
    df = E.queries()["op8_chat_formatting"](spark, SF)
    assert "assistant>user" in df._jdf.queryExecution().optimizedPlan().toString()
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "user", "b"), (3, 0, "system", "a"), (4, 0, "robot", "x"),
            (5, 0, "system", "s"), (5, 1, "user", "u"), (5, 2, "assistant", "t"), (5, 3, "user", "v")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r["conv_id"]: (r["end_state"], r["valid"]) for r in got} == {
        1: ("assistant", True), 2: ("error", False), 3: ("system", False), 4: ("error", False), 5: ("user", True)}


def test_chat_round_trip(spark):
    texts = ["plain", "", None, "</turn>\n<turn user>", "&lt; & &amp;lt; <", "\\### Assistant: </turn> ok", "<turn x>&gt;", "日本\U0001f600\n"]
    rows = [(c, i, r, t) for c in range(len(texts)) for i, (r, t) in enumerate([("user", texts[c]), ("assistant", texts[-c - 1])])]
    rows += [(50, 0, "us>er & <x", "t"), (50, 0, None, "t"), (None, 0, "user", "n"), (51, 1, "assistant", "b"), (51, 1, "assistant", "a"), (51, None, "user", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    chats = chat.format_chats(df)
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]]
            for r in chats.select("conv_id", chat.parsed(F.col("formatted")).alias("turns")).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]
        assert back[c] == want
    for r in chat.digests(chats).collect():
        loss = "".join(t for role, t in back[r["conv_id"]] if role == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        whole = "".join(f"{a}\n{b}\n" for a, b in back[r["conv_id"]])
        assert r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert chat.digests(chat.format_chats(df.where("false"))).count() == 0


def test_role_machine(spark):
    runs = {1: "user assistant", 2: "system user assistant user", 3: "assistant user", 4: "user user", 5: "system", 6: "user assistant system"}
    rows = [(c, i, r, "x") for c, run in runs.items() for i, r in enumerate(run.split())]
    got = {r["conv_id"]: r["valid"] for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}


# ---- html ----------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def model(spark, docs):
    return html_extract.train(html_extract.sample_lines(spark.read.parquet(f"{SF}/pages.parquet")))


def test_lstm_gradients_by_differences():
    rng = np.random.default_rng(0)
    m = html_extract.BlockLabeller(hidden=3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, live = html_extract.padded([rng.normal(size=(5, html_extract.DIMS)) * 0.3, rng.normal(size=(3, html_extract.DIMS)) * 0.3])
    y = (rng.random(live.shape) < 0.5).astype(float)
    _, g = m.gradients(x, live, y)
    for k in ("Wf", "Ub", "cf", "V", "o"):
        flat, at = m.p[k].reshape(-1), int(rng.integers(m.p[k].size))
        old, eps = flat[at], 1e-3
        flat[at] = old + eps
        up = m.gradients(x, live, y)[0]
        flat[at] = old - eps
        down = m.gradients(x, live, y)[0]
        flat[at] = old
        assert np.asarray(g[k]).reshape(-1)[at] == pytest.approx((up - down) / (2 * eps), abs=2e-4)


def test_blocks_split_and_decode():
    page = "<body><p>a &amp; <b>b\n c</b><p>d<br>e</p><ul><li>x<li>y</ul><script>'</p>no'</script><!-- no --><div>z&lt;</div>tail"
    assert [t for t, _, _ in html_extract.blocks(page)] == ["a & b c", "d e", "x", "y", "z<", "tail"]
    assert html_extract.blocks(None) == html_extract.blocks("") == []
    assert html_extract.blocks("<p title='<p>'>q</p><a href=\"x") == html_extract.blocks("<p title='<p>'>q</p><a href=\"x")


def test_blocks_after_elements_without_text():
    def texts(page):
        return [t for t, _, _ in html_extract.blocks(page)]

    both = "<article><p>one</p>{}<p>two</p></article>"
    for mid in ('<svg class="i"/>', "<svg />", "<math/>", "<svg-icon></svg-icon>", "<select-box>", "<title-bar></title-bar>", "<template-x/>",
                "<object data='a'>", "<svg>", "<noscript>", "<iframe>", "<svg><svg/>x</svg>", "<TITLE>x</title >", "<script>x</script a>"):
        assert texts(both.format(mid)) == ["one", "two"], mid
    assert texts(both.format("<svg/>") + "<svg><text>x</text></svg>tail") == ["one", "two", "tail"]
    assert texts(both.format("<script src=a/>")) == ["one"]
    assert texts("<object>" * 20_000 + "x") == ["x"]


def test_long_attributes_keep_their_own_path():
    plain, advert = "<div>x</div>", f'<div class="advert" hidden style="{"a:b;" * 100}">x</div>'
    for order in ((plain, advert), (advert, plain)):
        html_extract._path_of.clear()
        got = {page: html_extract.blocks(page)[0][1] for page in order}
        assert len(got[plain][0]) == 1 and len(got[advert][0]) == 3


def test_labeller_on_unseen_layouts(spark, model):
    rng, wrong, n = random.Random(987), 0, 0
    for _ in range(200):
        found = html_extract.blocks(html_extract.training_page(["some words of a page.", "other lines, more of them"], rng))
        y = np.array([html_extract.MARK in t for t, _, _ in found])
        got = model.label([html_extract.vectors([(t.replace(html_extract.MARK, ""), p, k) for t, p, k in found])])[0]
        wrong, n = wrong + (y != got).sum(), n + len(y)
    assert wrong / n < 0.03


def test_pages_match_their_articles(spark, model):
    import html as h

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(pages, model).collect()}
    bad = 0
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(h.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", inner)]
        bad += got[r["page_id"]] != "\n".join(x for x in parts if x)
    assert bad <= 1


def test_pages_odd_rows(spark, model):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<nav>x</nav>"), (2, None, "<article><p>" + "word " * 50_000 + "</article>"), (3, "u", "<<<>>> </p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    got = html_extract.extract_pages(df, model).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract_pages(df.where("false"), model).count() == 0
