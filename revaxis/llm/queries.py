"""Registered queries of this subpackage and their SQL twins.

Each query applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, code_search, hard_negatives, mixing, pairwise_quality, pii, preferences, rule_list, runs, set_join, simhash, site_lines,
    token_rollup,
)
from .common import shared_folder, word_count, words_of, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return register


#: Rows and bytes in each batch sent to Python: texts are long, and a worker holds one batch at a time.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The vocabulary file that the queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op8_bpe_automaton")
def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, vocabulary()).select(
        "doc_id", "n_tokens",
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op10_pairwise_quality")
def op10_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = pairwise_quality.learn_quality(docs, labels.where(pairwise_quality.training_part(F.col("doc_id"))))
    return pairwise_quality.score_documents(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(~pairwise_quality.training_part(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


SITE_LINES_SQL = f"""
WITH text AS (
  SELECT page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/:?#]+)', 1), '') AS host,
    regexp_replace(regexp_replace(coalesce(html, ''),
      '(?is)<(script|style)[^>]*>.*?</(script|style)>', chr(10), 'g'), '<[^>]*>', chr(10), 'g') AS t
  FROM pages),
numbered AS (SELECT row_number() OVER () AS r, * FROM text),
lines AS (
  SELECT r, host, unnest(string_split(t, chr(10))) AS raw, unnest(range(len(string_split(t, chr(10))))) AS i
  FROM numbered),
trimmed AS (SELECT *, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM lines),
per_host AS (SELECT host, count(*) AS total FROM numbered GROUP BY host),
counted AS (SELECT host, line, count(DISTINCT r) AS n FROM trimmed WHERE line <> '' GROUP BY host, line),
boilerplate AS (
  SELECT c.host, c.line FROM counted c JOIN per_host p ON c.host IS NOT DISTINCT FROM p.host
  WHERE n >= least({site_lines.MIN_PAGES}, total // 2 + 1) AND n >= 2 AND n > {site_lines.RATIO} * total),
marked AS (
  SELECT t.*, b.line IS NOT NULL AS gone
  FROM trimmed t LEFT JOIN boilerplate b ON t.host IS NOT DISTINCT FROM b.host AND t.line = b.line),
cleaned AS (
  SELECT r, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS t,
    CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped
  FROM marked GROUP BY r)
SELECT page_id, host, n_dropped, sha256(c.t) AS text_sha256
FROM numbered JOIN cleaned c USING (r)
"""


@query("op6_site_lines", SITE_LINES_SQL)
def op6_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(
        "page_id", site_lines.host_of(F.col("url")).alias("host"), site_lines.page_lines(F.col("html")).alias("text"))
    return site_lines.drop_boilerplate(pages, "host", "text", dropped="n_dropped", small_hosts=True).select(
        "page_id", "host", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("op5_source_mix")
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    planned = mixing.plan_mix(docs, size="size", source="source", doc_id="doc_id", weight=mixing.repeating_weights)
    return planned.select(
        "doc_id", "size", "source_size", "target", mixing.taken(F.col("size"), F.col("copies")).alias("taken"))


@query("op4_set_join")
def op4_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return set_join.near_duplicates(docs, n=4, threshold=Fraction(85, 100)).select("doc_id", "n_shingles", "component_id")


@query("op2_bilstm_crf_pii")
def op2_bilstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal(docs, pii.learn_tagger(docs))
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *(
            F.size(F.array_remove(F.transform(base, lambda s: s["kind"] != F.lit(kind)), True)).cast("long").alias(f"n_{kind}")
            for kind in pii.KINDS
        ),
        F.sha2(pii.joined_spans(base).cast("binary"), 256).alias("base_sha256"),
        pii.joined_spans(F.col("spans")).alias("spans"),
    )


@query("op3_rule_list")
def op3_rule_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = rule_list.learn_rules(docs, table(spark, sf_dir, "labels"))
    return rule_list.judge(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op1_code_search")
def op1_code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return code_search.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


TOKEN_ROLLUP_SQL = """
WITH counted AS (
  SELECT doc_id, source, lang,
    CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\x0C\\r]+'), lambda x: x <> '')) AS BIGINT) AS words,
    CAST(length(coalesce(text, '')) - length(translate(coalesce(text, ''), '.,;:!?', '')) AS BIGINT) AS marks,
    doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
  FROM documents),
current AS (
  SELECT source, lang, CASE WHEN lang = 'en' THEN 'words-2' ELSE 'words-1' END AS tokenizer,
    words + CASE WHEN lang = 'en' THEN marks ELSE 0 END AS tokens
  FROM counted WHERE NOT coalesce(toxic, false))
SELECT source, lang, tokenizer, count(*) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens
FROM current GROUP BY ALL
"""


@query("op7_token_rollup", TOKEN_ROLLUP_SQL)
def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted, English ones are revised to a version that counts marks too, and toxic ones deleted."""
    text = F.coalesce(F.col("text"), F.lit(""))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("toxic", F.lit(True))
    marks = F.length(text) - F.length(F.translate(text, ".,;:!?", ""))
    counted = written(table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", word_count(text).alias("words"), marks.cast("long").alias("marks")), "counts")
    counted = counted.join(toxic, "doc_id", "left")
    english, none = F.col("lang") == "en", F.lit(None)

    def change(op: str, new: tuple | None, old: tuple | None) -> list:
        def side(prefix: str, values: tuple | None) -> list:
            tokenizer, tokens = values or (none, none)
            keys = [(F.col(k) if values else none).cast("string").alias(prefix + k) for k in ("source", "lang")]
            return [*keys, tokenizer.cast("string").alias(f"{prefix}tokenizer"), tokens.cast("long").alias(f"{prefix}tokens")]

        return [F.lit(op).alias("op"), *side("", new), *side("old_", old)]

    first, second = (F.lit("words-1"), F.col("words")), (F.lit("words-2"), F.col("words") + F.col("marks"))
    now = tuple(F.when(english, b).otherwise(a) for a, b in zip(first, second))
    load = counted.select(*change("insert", first, None))
    revise = counted.where(english).select(*change("revise", second, first))
    delete = counted.where("toxic").select(*change("delete", None, now))
    rollup = token_rollup.Rollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    for name, changes in (("load", load), ("revise", revise), ("delete", delete), ("revise", revise)):
        rollup.commit(name, changes)
    return rollup.totals()


PREFERENCES_SQL = """
WITH said AS (
  SELECT conv_id AS pair_id, CAST(turn AS BIGINT) AS turn, role, text FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) AS n
    FROM conversations WHERE conv_id IS NOT NULL) WHERE n = 1),
last AS (SELECT pair_id, max(turn) AS last FROM said WHERE role = 'assistant' GROUP BY pair_id),
kept AS (SELECT s.*, l.last FROM said s LEFT JOIN last l USING (pair_id) WHERE l.last IS NULL OR s.turn <= l.last),
reply AS (SELECT xor(pair_id, 1) AS pair_id, text AS reply FROM kept WHERE turn = last),
rejected AS (
  SELECT pair_id, turn, role, text FROM kept WHERE last IS NULL OR turn < last
  UNION ALL SELECT k.pair_id, k.turn, k.role, r.reply FROM kept k JOIN reply r USING (pair_id) WHERE k.turn = k.last),
matched AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.turn, r.turn) AS turn,
    c.pair_id IS NOT NULL AS in_c, c.role AS c_role, c.text AS c_text,
    r.pair_id IS NOT NULL AS in_r, r.role AS r_role, r.text AS r_text,
    c.pair_id IS NOT NULL AND r.pair_id IS NOT NULL AND c.role IS NOT DISTINCT FROM r.role
      AND c.text IS NOT DISTINCT FROM r.text AS same
  FROM kept c FULL JOIN rejected r ON c.pair_id = r.pair_id AND c.turn = r.turn),
differing AS (SELECT pair_id, min(turn) AS differs FROM matched WHERE NOT same GROUP BY pair_id),
parts AS (
  SELECT m.pair_id, 'prompt' AS part, turn, c_role AS role, c_text AS text
  FROM matched m LEFT JOIN differing d USING (pair_id) WHERE d.differs IS NULL OR turn < d.differs
  UNION ALL
  SELECT m.pair_id, 'chosen', turn, c_role, c_text FROM matched m JOIN differing d USING (pair_id) WHERE turn >= d.differs AND in_c
  UNION ALL
  SELECT m.pair_id, 'rejected', turn, r_role, r_text FROM matched m JOIN differing d USING (pair_id) WHERE turn >= d.differs AND in_r),
shown AS (
  SELECT *, '<|im_start|>' || coalesce(role, 'unknown') || chr(10) AS head,
    coalesce(text, '') || '<|im_end|>' || chr(10) AS body, part <> 'prompt' AND coalesce(role = 'assistant', false) AS trained
  FROM parts)
SELECT pair_id, part, turn, head || body AS segment,
  CASE WHEN trained THEN CAST(length(head) AS BIGINT) END AS train_from,
  CASE WHEN trained THEN CAST(length(head) + length(body) AS BIGINT) END AS train_to
FROM shown
"""


@query("op9_preferences", PREFERENCES_SQL)
def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, rejected = preferences.swapped_replies(table(spark, sf_dir, "conversations"))
    return preferences.format_preferences(chosen, rejected)


@query("op11_kruskal_runs")
def op11_kruskal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents; of a tenth of them, picked by a hash, the words repeat from some place on."""
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    group = F.floor(code / 10)

    def repeated(words: Column) -> Column:
        n = F.greatest(F.size(words), F.lit(1))
        start = F.pmod(group, n).cast("int")
        period = F.floor((n - start) / (3 + F.pmod(group, F.lit(8)))).cast("int") + 1
        turns = F.flatten(F.array_repeat(F.slice(words, start + 1, period), F.ceil((n - start) / period).cast("int")))
        return F.slice(F.concat(F.slice(words, 1, start), turns), 1, n)

    # Bound to a name, so that the words are found once a text.
    words = F.transform(F.array(words_of(F.col("text"))), lambda w: F.when(F.pmod(code, F.lit(10)) == 0, repeated(w)).otherwise(w))[0]
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(words, " ").alias("text"))
    found = runs.find_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        (r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("start"), (-r["period"]).alias("period"), r["length"].alias("length"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


HARD_NEGATIVES_SQL = """
WITH taken AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS alike, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM taken a JOIN taken r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""


@query("op12_hard_negatives", HARD_NEGATIVES_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives.hard_negatives(rows, rows.where(F.col("vec_id") % 100 == 0))


@query("op13_simhash_grid")
def op13_simhash_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))
