"""Registered queries of this package and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_token_counts(spark, sf_dir):
    from scholium.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


@query
def op5_language_id(spark, sf_dir):
    from scholium.llm.common import held_out
    from scholium.llm.language_id import identify

    out = identify(table(spark, sf_dir, "documents"))
    return out.select("doc_id", held_out(out.doc_id).alias("held_out"), "lang_pred", "score", "mixture")


@query
def op3_quality(spark, sf_dir):
    from scholium.llm.common import held_out
    from scholium.llm.quality import score

    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(out.doc_id).alias("held_out"), "score", "predicted")


@query
def op1_best_fit_packing(spark, sf_dir):
    from scholium.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


@query
def op8_secret_scans(spark, sf_dir):
    from scholium.llm.secret_scan import scan, span_text

    def of_kind(kind):
        return F.filter("spans", lambda s: s["kind"] == kind)

    out = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return out.select(
        "doc_id",
        *[F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex", "crf")],
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
    )


@query
def op2_chat_format(spark, sf_dir):
    from scholium.llm.chat_format import format_conversations, recovered

    conflict = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(conflict).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = format_conversations(turns).withColumn("read", recovered(F.col("formatted"), F.col("escaped")))
    loss = F.array_join(F.transform(F.filter("read", lambda t: t["loss"]), lambda t: t["text"]), "")
    return out.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "escaped", "exact",
    )


# A conversation whose texts or roles hold a control string is escaped; nothing else needs to be, as a
# text without one can neither open nor close a turn.
ORACLES["op2_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, len(regexp_extract_all(text, '[<\[]\\*(?:</?SYS>>|<TURN>>|</TURN>>|<TEXT>>|/?INST\]|/?s>)')) AS marks FROM turns
), conv AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length(text) + marks + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 25 + length(role) END) AS formatted_chars,
    bool_or(marks > 0) AS escaped, true AS exact
  FROM marked GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, loss_chars::BIGINT AS loss_chars, loss_sha256, formatted_chars::BIGINT AS formatted_chars, escaped, exact FROM conv
"""


@query
def op10_nearest(spark, sf_dir):
    from scholium.llm.nearest import neighbours

    vectors = table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@query
def op4_near_dedup(spark, sf_dir):
    from scholium.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


@query
def op7_decontamination(spark, sf_dir):
    from scholium.llm.decontamination import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op7_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
item AS (SELECT item_id, len(w) AS n, greatest(1, len(w) - 4) AS m, w FROM i WHERE len(w) > 0),
ish AS (SELECT item_id, s, count(*) AS c FROM (
    SELECT item_id, unnest(list_transform(range(1, m + 1), lambda p: array_to_string(w[p:p + least(5, n) - 1], ' '))) AS s FROM item) GROUP BY ALL),
dsh AS (SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda p: array_to_string(w[p:p + 4], ' '))) AS s FROM d WHERE len(w) > 0)),
pairs AS (SELECT DISTINCT doc_id, item_id FROM dsh JOIN ish USING (s)),
-- a text shorter than the item is a window itself, if its shingles are enough to be as similar
win AS (SELECT p.doc_id, p.item_id, least(n, len(d.w)) AS n, m, greatest(1, least(n, len(d.w)) - 4) AS own,
    unnest(CASE WHEN len(d.w) >= n THEN range(0, len(d.w) - n + 1) WHEN len(d.w) >= 5 AND 100 * (len(d.w) - 4) >= 80 * (n - 4) THEN [0] ELSE [] END) AS start
    FROM pairs p JOIN d USING (doc_id) JOIN item USING (item_id)),
wsh AS (SELECT win.doc_id, win.item_id, win.n, win.m, win.own, start,
    unnest(list_transform(range(1, win.own + 1), lambda p: array_to_string(d.w[start + p:start + p + least(5, win.n) - 1], ' '))) AS s FROM win JOIN d USING (doc_id)),
cnt AS (SELECT doc_id, item_id, n, m, own, start, s, count(*) AS c FROM wsh GROUP BY ALL),
sim AS (SELECT doc_id, cnt.item_id, n, start, sum(least(cnt.c, ish.c)) AS both_, any_value(m) + any_value(own) AS total FROM cnt JOIN ish ON cnt.item_id = ish.item_id AND cnt.s = ish.s GROUP BY ALL)
SELECT doc_id, item_id, (both_ / (total - both_))::DOUBLE AS similarity, start::BIGINT AS start, n::BIGINT AS n_words FROM sim
WHERE 100 * both_ >= 80 * (total - both_)
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY both_ / (total - both_) DESC, start) = 1
"""


@query
def op6_substring_dedup(spark, sf_dir):
    from scholium.llm.substring_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_license_scans(spark, sf_dir):
    from scholium.llm.license_rules import SURE
    from scholium.llm.license_scan import scan

    out = scan(table(spark, sf_dir, "documents"))
    base = F.filter("detections", lambda d: d["base"])
    sure = F.create_map(*[F.lit(x) for pair in SURE.items() for x in pair])

    def labels(rows):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda d: d["label"]))), ",")

    starts = F.transform(base, lambda d: d["start"])
    spans = F.transform(F.filter("detections", lambda d: ~d["base"]), lambda d: F.concat_ws(":", d["label"], d["level"].cast("string"), d["start"].cast("string"), d["stop"].cast("string")))
    return out.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: sure[d["level"]])), F.lit(0.0)).alias("score"),
        F.array_join(F.array_sort(spans), ",").alias("spans"),
    )


def _license_oracle():
    from scholium.llm.license_rules import SURE, rules

    def row(k, r):
        return f"({k}, '{r.label}', {r.level}, {str(r.base).lower()}, {SURE[r.level]}::DOUBLE, '{r.pattern}')"

    values = ", ".join(row(k, r) for k, r in enumerate(rules()))
    return rf"""
WITH rules(rule, label, level, base, sure, pattern) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT row, ' ' || array_to_string(w, '  ') || ' ' AS spaced FROM d),
likely AS (SELECT * FROM s WHERE regexp_matches(spaced, 'licen|gpl| cc |spdx|apache|bsd|commons|cc0| org |perl|domain|reserved|copyright|proprietary|rail|wtfpl|hereby|compliance|applicable|redistributions|endorse|advertising|altered|evil|beer|eclipse|mozilla')),
hit AS (SELECT row, rule, regexp_extract_all(spaced, pattern) AS inside, string_split_regex(spaced, pattern) AS around FROM likely, rules WHERE regexp_matches(spaced, pattern)),
words AS (SELECT row, rule, list_transform(inside, lambda x: len(string_split(trim(x), '  '))) AS own,
    list_transform(around, lambda x: CASE WHEN trim(x) = '' THEN 0 ELSE len(string_split(trim(x), '  ')) END) AS gap FROM hit),
nth AS (SELECT row, rule, own, gap, unnest(range(1, len(own) + 1)) AS k FROM words),
det AS (SELECT row, rule, label, level, base, sure, start, start + own[k] AS stop FROM
    (SELECT *, coalesce(list_sum(gap[1:k]), 0) + coalesce(list_sum(own[1:k - 1]), 0) AS start FROM nth) JOIN rules USING (rule)),
kept AS (SELECT * FROM det a WHERE base OR NOT EXISTS (SELECT 1 FROM det b WHERE b.row = a.row AND NOT b.base AND b.level <= a.level AND b.start <= a.start AND b.stop >= a.stop
    AND (b.stop - b.start > a.stop - a.start OR b.level < a.level OR (b.level = a.level AND b.rule < a.rule)))),
agg AS (SELECT row, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(sure) AS score,
    string_agg(label || ':' || level || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY label || ':' || level || ':' || start::BIGINT || ':' || stop::BIGINT) FILTER (NOT base) AS spans
    FROM kept GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
    coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score, coalesce(spans, '') AS spans FROM d LEFT JOIN agg USING (row)
"""


ORACLES["op11_license_scans"] = _license_oracle()


@query
def op12_hard_negatives(spark, sf_dir):
    from scholium.llm.hard_negatives import mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", label), lambda vec_id: vec_id % 100 == 0)


ORACLES["op12_hard_negatives"] = """
WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
    FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positive AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = own
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id) WHERE label <> own AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""


@query
def op13_token_alignment(spark, sf_dir):
    from scholium.llm.token_alignment import align

    return align(table(spark, sf_dir, "documents"))
