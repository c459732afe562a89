"""Quality rules by distribution divergence, in DataFrame functions only.

A text's histograms of character classes and of the most common words of its
language are compared with the language's references by the Jensen-Shannon
distance (base 2, between 0 and 1).  A language's reference is the summed
histogram of all its documents that pass the base rules, and a fixed weight of
the summed histogram of all languages beside it: a language with few documents
is judged by what all have in common, one with many by its own, and no size
decides whether a document is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A text differs from its language beyond these distances, with more room for short texts: slack / sqrt(n_words).
MAX_CHAR_DISTANCE, CHAR_SLACK = 0.20, 0.8
MAX_WORD_DISTANCE, WORD_SLACK = 0.20, 1.0
#: Common words are compared from this many words on.
MIN_COMMON_WORDS = 50
#: Characters and words by which all languages together weigh in each language's reference.
POOLED_CHARS, POOLED_WORDS = 20_000, 3_000
SYMBOLS = r"[#*$%&|<>]"
#: Character classes that are counted by pattern; white space, symbols and the rest (mostly small letters) follow from the base figures.
CLASSES = ("[A-Z\u00c0-\u00d6\u00d8-\u00de]", "[0-9]", "[.,;:?!'\"()\\-]")
#: Frequent function words of the languages, at most six letters each.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not",
           "this", "are", "at", "a"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "auf", "für", "ist", "im", "dem",
           "nicht", "ein", "eine", "als", "an", "sich"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par",
           "pas", "au", "sur", "a"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "para",
           "es", "al", "lo"),
}
_LETTERS = "ABCDEFGHIJKLMNOPQRST"


def _windows(hashes: Column) -> Column:
    """64-bit hashes of all windows of three words, in order, from the words' hashes."""
    n = F.size(hashes) - 2
    part = lambda k: F.slice(hashes, F.lit(k), n)
    pair = F.zip_with(part(1), part(2), lambda a, b: F.xxhash64(a, b))
    return F.when(n >= 1, F.zip_with(pair, part(3), lambda p, c: F.xxhash64(p, c))).otherwise(F.array().cast("array<bigint>"))


def _covered(places: Column) -> Column:
    """Words in windows that begin at the (ascending) places: each adds the distance to the next one, three at most."""
    nxt = F.slice(places, F.lit(2), F.size(places))
    gaps = F.zip_with(places, nxt, lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)


def base_features(docs: DataFrame, keep: list[str], lang: bool = False) -> DataFrame:
    """``keep`` and the base figures of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Repeated windows come from a sorted copy of the hashes.  With few
    different ones their places are looked up one by one; with many,
    (hash, place) pairs are sorted, which stays near linear in the text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    own = [F.coalesce(F.col("lang"), F.lit("")).alias("_lang")] if lang else []
    step = docs.select(*keep, *own, text.alias("_t"), words_of(F.col("text")).alias("_w"), lines.alias("_l"))
    step = step.withColumn("_k", F.transform("_w", lambda w: F.xxhash64(w)))
    step = step.withColumn("_g", _windows(F.col("_k")))
    ordered = F.sort_array("_g")
    step = step.withColumn("_o", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), ordered).otherwise(F.array().cast("array<bigint>")))
    twice = F.array_distinct(F.filter(F.zip_with("_o", F.slice("_o", F.lit(2), F.size("_o")), lambda a, b: F.when(a == b, a)),
                                      lambda x: x.isNotNull()))
    step = step.withColumn("_d", F.when(F.size("_o") > 0, twice).otherwise(F.array().cast("array<bigint>")))
    few = F.filter(F.transform("_g", lambda g, i: F.when(F.array_contains(F.col("_d"), g), i)), lambda x: x.isNotNull())
    pairs = F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    step = step.withColumn("_p", F.when(F.size("_d") > 32, pairs))
    both = F.array_union(_same(F.col("_p"), 0), _same(F.col("_p"), 1))
    places = F.when(F.size("_d") == 0, F.array().cast("array<int>")).when(F.size("_d") <= 32, few).otherwise(F.sort_array(both))
    step = step.withColumn("_x", places)
    return step.select(
        *keep, *(["_lang"] if lang else []), "_t", "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("_x")).alias("n_repeat_words"))


def _same(pairs: Column, second: int) -> Column:
    """Places of sorted (hash, place) pairs whose successor (0) or predecessor (1) has the same hash."""
    nxt = F.slice(pairs, F.lit(2), F.size(pairs))
    met = F.zip_with(pairs, nxt, lambda a, b: F.when(a["g"] == b["g"], (b if second else a)["i"]))
    return F.filter(met, lambda x: x.isNotNull())


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def _sum(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)


def _distance(mine: Column, theirs: Column) -> Column:
    """Jensen-Shannon distance (base 2) between two arrays of shares."""
    term = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(mine, theirs, lambda p, q: term(p, (p + q) / 2) + term(q, (p + q) / 2))
    return F.sqrt(F.greatest(_sum(terms) / 2, F.lit(0.0)))


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Base figures, language key, histograms of character classes (_c) and common words (_m; last: other words)."""
    base = base_features(docs, keep, lang=True)
    lists = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    base = base.withColumn("_known", F.element_at(lists, F.col("_lang")))
    # one letter for each common word, so that counting a word is counting a letter
    short = F.filter("_w", lambda w: F.octet_length(w) <= 6)
    hits = F.array_join(F.transform(short, lambda w: F.substring(F.lit(" " + _LETTERS), F.array_position(F.col("_known"), w).cast("int") + 1, F.lit(1))), "")
    base = base.withColumn("_h", F.when(F.size("_known") > 0, F.replace(hits, F.lit(" "), F.lit(""))).otherwise(""))
    own = [c for c in base.columns if c not in ("_t", "_w", "_known", "_h")]
    counted = F.array(*[F.regexp_count("_t", F.lit(c)).cast("double") for c in CLASSES])
    base = base.select(*own, F.length("_t").cast("double").alias("_n"), "_h", counted.alias("_q"))
    n, chars, symbols = F.col("_n"), F.col("word_chars").cast("double"), F.col("n_symbols").cast("double")
    per_word = F.transform(F.array(*[F.lit(x) for x in _LETTERS]),
                           lambda x: (F.length("_h") - F.length(F.replace("_h", x, F.lit("")))).cast("double"))
    return base.select(*own, "_n", F.concat("_q", F.array(n - chars, symbols, chars - symbols - _sum(F.col("_q")))).alias("_c"),
                       F.concat(per_word, F.array((F.col("n_words") - F.length("_h")).cast("double"))).alias("_m"))


def _summed(column: str, size: int) -> Column:
    return F.array(*[F.sum(F.col(column)[i]) for i in range(size)])


def judge(feats: DataFrame, keep: list[str]) -> DataFrame:
    """Base figures, base_failed, both distances and ``kept`` for stored ``features``."""
    feats = feats.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    summed = stored(feats.where(~F.col("base_failed")).groupBy(F.col("_lang").alias("_rl")).agg(
        _summed("_c", len(CLASSES) + 3).alias("_rc"), _summed("_m", len(_LETTERS) + 1).alias("_rm")))
    share = lambda c: F.transform(c, lambda x: x / F.greatest(_sum(c), F.lit(1.0)))
    pooled = summed.agg(_summed("_rc", len(CLASSES) + 3).alias("_pc"),
                        F.array(*[F.sum(F.when(F.col("_rl").isin(*COMMON_WORDS), F.col("_rm")[i])) for i in range(len(_LETTERS) + 1)]).alias("_pm"))
    mixed = lambda own, all_, weight: F.zip_with(own, share(F.col(all_)), lambda o, p: o + weight * F.coalesce(p, F.lit(0.0)))
    both = summed.withColumns({c: pooled.select(c).scalar() for c in ("_pc", "_pm")})  # one row of sums over all languages
    ref = both.select("_rl", mixed("_rc", "_pc", POOLED_CHARS).alias("_rc"), mixed("_rm", "_pm", POOLED_WORDS).alias("_rm"))
    ref = stored(ref.select("_rl", share(F.col("_rc")).alias("_rc"), share(F.col("_rm")).alias("_rm")))
    both = feats.join(ref, F.col("_lang") == F.col("_rl"), "left").withColumns({"_sc": _sum(F.col("_c")), "_sm": _sum(F.col("_m"))})
    both = both.withColumns({"_pc": F.transform("_c", lambda x: x / F.greatest("_sc", F.lit(1.0))),
                             "_pm": F.transform("_m", lambda x: x / F.greatest("_sm", F.lit(1.0)))})
    listed = F.col("_lang").isin(*COMMON_WORDS) & (F.col("n_words") >= MIN_COMMON_WORDS)
    both = both.withColumns({
        "char_distance": F.when(F.col("_rl").isNotNull(), _distance(F.col("_pc"), F.col("_rc"))).otherwise(0.0),
        "word_distance": F.when(F.col("_rl").isNotNull() & listed, _distance(F.col("_pm"), F.col("_rm"))).otherwise(0.0)})
    slack = F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    return both.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("char_distance") <= MAX_CHAR_DISTANCE + CHAR_SLACK / slack)
         & (F.col("word_distance") <= MAX_WORD_DISTANCE + WORD_SLACK / slack)).alias("kept"),
        "char_distance", "word_distance")


def quality(docs: DataFrame) -> DataFrame:
    """(doc_id, base figures, base_failed, kept, char_distance, word_distance), one row per row of ``docs``.

    Null and empty texts have no words and fail.  A null or unlisted language
    is compared by character classes only, with the others of its kind and,
    like every language, with all languages together (POOLED_CHARS).  Very long
    texts are read whole; repeated rows count as often as they come; an empty
    table gives no rows.  Columns other than doc_id, text and lang are not read.
    """
    return judge(stored(features(docs, ["doc_id"])), ["doc_id"])


def drop_poor(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are.

    Rows are matched by (doc_id, text length, text hash), so rows that repeat a doc_id are judged by their own text.
    """
    key = fresh(docs, "_quality")
    tag = F.xxhash64("doc_id", F.length("text"), "text", "lang")
    keyed = docs.withColumn(key, tag)
    good = judge(stored(features(keyed, [key])), [key]).where("kept").select(F.col(key).alias(key + "k")).distinct()
    return keyed.join(good, F.col(key) == F.col(key + "k"), "left_semi").drop(key)
