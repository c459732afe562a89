"""The registered queries of this subpackage: one per operator, over its whole table, and their DuckDB SQL."""

from __future__ import annotations

import functools
import posixpath
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat,
    collocations,
    decontamination,
    embed_dedup,
    html_extract,
    mixing,
    packing,
    quality,
    ranked_search,
    sharding,
    simhash,
    token_output,
    toxicity,
)
from .common import checkpoint_dir, ship_code, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def fitted_lexicon(docs: DataFrame, spark: SparkSession, sf_dir: str) -> toxicity.Lexicon:
    return toxicity.fit_lexicon(toxicity.labelled_sample(docs, table(spark, sf_dir, "labels")))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, fitted_lexicon(docs, spark, sf_dir))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = posixpath.join(checkpoint_dir(spark), f"token_shards-{uuid.uuid4().hex}")
    return token_output.write_shards(table(spark, sf_dir, "documents"), folder, tokenizer_path())


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = r"\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", probe), (-7, 1, "assistant", probe)]
    extra = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(chats.unionByName(extra)))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _with_code(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_code(spark)
        return f(spark, sf_dir)

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _with_code(f) for f in (op1_toxicity, op2_embedding_near_dedup, op3_html_extraction, op4_sharding, op5_mixing, op6_token_output,
                            op7_simhash_near_dedup, op8_chat_formatting, op9_packing, op10_quality_rules, op11_collocations,
                            op12_decontamination, op13_ranked_search)}

_CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))
            + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + length('<turn >') + length('</turn>') + 1 AS n
  FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(n) AS formatted_chars, list(role ORDER BY turn, role, text) AS roles
  FROM e GROUP BY conv_id),
m AS (SELECT *, list_reduce(list_prepend('start', roles), lambda s, r: CASE s || '>' || r STEPS ELSE 'error' END) AS end_state FROM g)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars, end_state, end_state IN (ACCEPTING) AS valid
FROM m
""".replace("STEPS", " ".join(f"WHEN '{a}>{role}' THEN '{b}'" for a, row in chat.TRANSITIONS.items() for role, b in row.items())).replace(
    "ACCEPTING", ", ".join(f"'{x}'" for x in chat.ACCEPTING))


def _quality_sql() -> str:
    lists = " UNION ALL ".join(
        f"SELECT '{lang}' AS lang, '{w}' AS word, {i} AS slot" for lang, ws in quality.COMMON_WORDS.items() for i, w in enumerate(ws))
    quoted = [c.replace("'", "''") for c in quality.CLASSES]
    k, others = len(quoted), len(quality._LETTERS)
    counted = ", ".join(f"len(regexp_extract_all(t, '{c}')) AS c{i}" for i, c in enumerate(quoted))
    sums = " + ".join(f"c{i}" for i in range(k))
    chars = " UNION ALL ".join(
        [f"SELECT rid, 'c' AS kind, {i} AS slot, c{i} AS n FROM b" for i in range(k)]
        + [f"SELECT rid, 'c', {k}, n_chars - word_chars FROM b", f"SELECT rid, 'c', {k + 1}, n_symbols FROM b",
           f"SELECT rid, 'c', {k + 2}, word_chars - n_symbols - ({sums}) FROM b"])
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang FROM documents),
s AS (SELECT rid, doc_id, lang, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM s)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
b AS (
  SELECT rid, doc_id, lang, length(t) AS n_chars, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '{quality.SYMBOLS}')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, {counted}
  FROM s LEFT JOIN cov USING (rid)),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b),
common AS ({lists}),
met AS (SELECT rid, c.slot, count(*) AS n FROM (SELECT rid, lang, unnest(ws) AS word FROM s) w JOIN common c USING (lang, word) GROUP BY rid, c.slot),
h AS (
  {chars}
  UNION ALL SELECT rid, 'w', slot, n FROM met
  UNION ALL SELECT rid, 'w', {others}, n_words - coalesce((SELECT sum(n) FROM met m WHERE m.rid = b.rid), 0) FROM b),
own AS (SELECT f.lang, kind, slot, sum(n) AS n FROM h JOIN f USING (rid) WHERE NOT base_failed GROUP BY f.lang, kind, slot),
pool AS (SELECT kind, slot, sum(n) AS n FROM own WHERE kind = 'c' OR lang IN (SELECT lang FROM common) GROUP BY kind, slot),
part AS (SELECT kind, slot, n / greatest(sum(n) OVER (PARTITION BY kind), 1) AS share FROM pool),
every AS (SELECT lang, kind, slot FROM (SELECT DISTINCT lang FROM own), part),
ref AS (
  SELECT lang, kind, slot, coalesce(own.n, 0) + share * CASE kind WHEN 'c' THEN {quality.POOLED_CHARS} ELSE {quality.POOLED_WORDS} END AS n
  FROM every JOIN part USING (kind, slot) LEFT JOIN own USING (lang, kind, slot)),
q AS (SELECT lang, kind, slot, n / sum(n) OVER (PARTITION BY lang, kind) AS q FROM ref),
p AS (SELECT rid, kind, slot, n / sum(n) OVER (PARTITION BY rid, kind) AS p FROM h WHERE rid IN (SELECT rid FROM f WHERE NOT base_failed)),
z AS (
  SELECT f.rid, q.kind, coalesce(p.p, 0) AS p, q.q AS q, (coalesce(p.p, 0) + q.q) / 2 AS m
  FROM f JOIN q USING (lang) LEFT JOIN p ON p.rid = f.rid AND p.kind = q.kind AND p.slot = q.slot
  WHERE NOT f.base_failed),
js AS (
  SELECT rid, kind, sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END) + (CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END)) / 2)) AS js
  FROM z GROUP BY rid, kind),
far AS (
  SELECT DISTINCT rid FROM js JOIN f USING (rid)
  WHERE kind = 'c' AND js > {quality.MAX_CHAR_DISTANCE} + {quality.CHAR_SLACK} / sqrt(f.n_words)
     OR kind = 'w' AND js > {quality.MAX_WORD_DISTANCE} + {quality.WORD_SLACK} / sqrt(f.n_words) AND f.n_words >= {quality.MIN_COMMON_WORDS} AND f.lang IN (SELECT lang FROM common))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rid NOT IN (SELECT rid FROM far) AS kept
FROM f
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_COLLOCATIONS_SQL = rf"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM (SELECT coalesce(lang, '{collocations.NO_LANG}') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
g AS (
  SELECT lang, 1 AS k, ws[i] AS phrase FROM t
  UNION ALL SELECT lang, 2, ws[i] || ' ' || ws[i + 1] FROM t WHERE i + 1 <= len(ws)
  UNION ALL SELECT lang, 3, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FROM t WHERE i + 2 <= len(ws)),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= {collocations.MIN_COUNT}),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
cuts AS (
  SELECT lang, phrase, a, 1 AS cut, w[1] AS x, CASE k WHEN 2 THEN w[2] ELSE w[2] || ' ' || w[3] END AS y FROM f WHERE k >= 2
  UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM f WHERE k = 3),
scored AS (
  SELECT c.lang, c.phrase, c.a, cut, fx.a AS l, fy.a AS r,
         CAST((1000000::HUGEINT * c.a * c.a) // (fx.a::HUGEINT * fy.a) AS BIGINT) AS score
  FROM cuts c JOIN f fx ON fx.lang = c.lang AND fx.phrase = x JOIN f fy ON fy.lang = c.lang AND fy.phrase = y),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM scored),
inside AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM f WHERE k = 3) GROUP BY lang, phrase),
left_over AS (
  SELECT s.* FROM lowest s LEFT JOIN inside i USING (lang, phrase)
  WHERE nth = 1 AND (longer IS NULL OR 100 * longer < {collocations.COVERED_PERCENT} * a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {collocations.TOP}
"""

_DECONTAMINATION_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{decontamination.WORD}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{decontamination.WORD}') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(ws), {decontamination.WINDOW}) AS m, array_to_string(ws[i:i + {decontamination.WINDOW - 1}], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - {decontamination.WINDOW - 2}, 2))) AS i FROM b WHERE len(ws) > 0)),
places AS (
  SELECT rid, m, i, array_to_string(ws[i:i + m - 1], ' ') AS g
  FROM (SELECT rid, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win))),
met AS (SELECT rid, i, p.m, item_id FROM places p JOIN win USING (m, g)),
hit AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS j FROM (SELECT DISTINCT rid, i, m FROM met)) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM met WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_SEARCH_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ws FROM documents),
size AS (SELECT CAST(count(*) FILTER (len(ws) > 0) AS BIGINT) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM d),
tf AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(ws) AS t FROM d) GROUP BY rid, t),
df AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
       FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), size),
q AS (
  SELECT no, item_id, t, count(*) AS c
  FROM (SELECT no, item_id, unnest(ws) AS t FROM (SELECT row_number() OVER () AS no, item_id, {_TERMS} AS ws FROM benchmark)) GROUP BY no, item_id, t),
m AS (SELECT rid, doc_id, 25 + (75 * len(ws) * n_docs) // n_terms AS m FROM d, size WHERE len(ws) > 0),
scores AS (
  SELECT no, item_id, rid, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN df USING (t) JOIN tf USING (t) JOIN m USING (rid) GROUP BY no, item_id, rid, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY no ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
WHERE rank <= {ranked_search.TOP}
"""

ORACLES: dict[str, str] = {
    "op8_chat_formatting": _CHAT_SQL, "op10_quality_rules": _quality_sql(), "op11_collocations": _COLLOCATIONS_SQL,
    "op12_decontamination": _DECONTAMINATION_SQL, "op13_ranked_search": _SEARCH_SQL}
