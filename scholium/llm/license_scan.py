"""Licence scan by ordered signature rules, in DataFrame functions only.

A keyword prefilter decides which rules a text is searched with; most texts hold no rule's keywords and are only
counted. Rules are regular expressions over words, so that line breaks and marks between words do not matter, and give
intervals of word positions. A detection goes if one of the same or a better level holds its
interval; of equal ones the earlier rule's stays.

Intervals leave their document only as numbers: start and length of every hit. Windows over one document's hits sum up
its positions and carry the largest end so far, which settles containment without comparing pairs.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholium.llm.common import store
from scholium.llm.license_rules import HINT, TAG, Rule, rules
from scholium.operators.frames import pin

#: Words are runs of ASCII letters and digits and of anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CC_BY = r"(?i)cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def keywords_in(low: Column, keywords: list[str]) -> Column:
    """Those of the keywords that a text in lower case holds."""
    def held(word: str) -> Column:
        return F.contains(low, F.lit("cc")) & F.regexp_like(low, F.lit(_CC_BY)) if word == "cc-by" else F.contains(low, F.lit(word))

    return F.filter(F.array(*[F.when(held(w), F.lit(w)) for w in keywords]), lambda w: w.isNotNull())


def n_words(spaced: Column) -> Column:
    """Words of a text in which every word has a blank on either side."""
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("long")


def hits(docs: DataFrame, ordered: list[Rule]) -> DataFrame:
    """``doc_id, row, n_words, hits``: for every rule with hits the words before each one, since the last, and within it."""
    table = [{"rule": k, "pattern": r.pattern, "keywords": list(r.keywords)} for k, r in enumerate(ordered)]
    known = F.from_json(F.lit(json.dumps(table)), "array<struct<rule:int,pattern:string,keywords:array<string>>>")
    keywords = sorted({w for r in ordered for w in r.keywords})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = pin(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text.alias("text")), low=F.lower("text"))
    rows = pin(rows, found=keywords_in(F.col("low"), keywords)).drop("low")
    rows = pin(rows, rules=F.when(F.size("found") > 0, F.filter(known, lambda r: F.size(F.array_except(r["keywords"], "found")) == 0)))
    spaced = F.concat(F.lit(" "), F.array_join(words_of(F.translate("text", _UPPER, _LOWER)), "  "), F.lit(" "))
    rows = pin(rows, n_words=F.size(words_of(F.col("text"))).cast("long"), spaced=F.when(F.size("rules") > 0, spaced)).drop("text", "found")

    def places(rule: Column) -> Column:
        inside = F.regexp_extract_all("spaced", rule["pattern"], F.lit(0))
        between = F.split("spaced", rule["pattern"], -1)
        return F.struct(rule["rule"].alias("rule"), F.zip_with(F.slice(between, 1, F.size(between) - 1), inside, lambda b, i: F.struct(n_words(b).alias("before"), n_words(i).alias("own"))).alias("at"))

    matching = F.filter("rules", lambda r: F.regexp_like(F.col("spaced"), r["pattern"]))
    return pin(rows, hits=F.transform(matching, places)).select("doc_id", "row", "n_words", "hits")


def scan(docs: DataFrame, ordered: list[Rule] | None = None) -> DataFrame:
    """Licence detections of every whole text.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A-Z counts as lower case. Null and empty texts have no words and no
    detections. Rows that repeat an id, or have none, are documents of their own. No rows give no rows.

    Returns ``doc_id, n_words, detections``: array of (start, stop, label, level, rule, base) in order of start, longest first,
    in words from 0, ``stop`` exclusive. A rule's hits do not overlap each other. Detections of a base rule always stay and
    suppress nothing.
    """
    ordered = rules() if ordered is None else ordered
    facts = store(hits(docs, ordered))
    facts_with = F.size(F.coalesce("hits", F.array().cast(facts.schema["hits"].dataType))) > 0
    each = facts.where(facts_with).select("row", F.explode("hits").alias("h")).select("row", "h.rule", F.posexplode("h.at").alias("nth", "at"))
    upto = F.sum(F.col("at.before") + F.col("at.own")).over(Window.partitionBy("row", "rule").orderBy("nth"))
    table = docs.sparkSession.createDataFrame([(k, r.label, r.level, r.base) for k, r in enumerate(ordered)], "rule int, label string, level int, base boolean")
    placed = each.select("row", "rule", (upto - F.col("at.own")).alias("start"), upto.alias("stop")).join(F.broadcast(table), "rule")  # a few hundred fixed rows
    before = Window.partitionBy("row").orderBy("start", F.col("stop").desc(), "level", "rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = range(TAG, HINT + 1)
    reach = F.array(*[F.max(F.when(~F.col("base") & (F.col("level") <= k), F.col("stop"))).over(before) for k in levels])
    marked = placed.withColumn("reach", reach)
    kept = marked.where(F.col("base") | F.coalesce(F.get("reach", F.col("level")) < F.col("stop"), F.lit(True)))
    one = F.struct("start", (-F.col("stop")).alias("order"), "stop", "label", "level", "rule", "base")
    lists = kept.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("d"))
    lists = lists.select("row", F.transform("d", lambda d: F.struct(*[d[c].alias(c) for c in ("start", "stop", "label", "level", "rule", "base")])).alias("detections"))
    some = facts.where(facts_with).select("doc_id", "row", "n_words").join(lists, "row").select("doc_id", "n_words", "detections")
    none = facts.where(~facts_with).select("doc_id", "n_words", F.array().cast(some.schema["detections"].dataType).alias("detections"))
    return some.unionByName(none)
