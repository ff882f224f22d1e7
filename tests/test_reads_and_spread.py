"""What is read once, what is moved, and over how many tasks costly expressions run."""

import pytest
from pyspark.sql import functions as F

from catalog import queries as Q
from scholium.functions import headings as H
from scholium.functions import sections as S
from scholium.functions.text import is_upper
from scholium.operators import references as REF


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("small"))
    rows = [(i, f"Plain words of paper {i}. " * 5) for i in range(60)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_identifiers_are_looked_up_from_stored_facts(spark, small):
    """the look-up reads the facts several times, so no segmentation may be left in its plan."""
    for limits in ({}, {"sample": 5, "first": 10}):
        plan = Q.id_status(spark, small, **limits)._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan
    assert Q.QUERIES["v5_uncovered_refs"](spark, small).count() > 0


def test_work_on_linked_documents_stays_spread(spark):
    """few bytes, much work: partitions must not be merged by size."""
    docs = spark.createDataFrame([(i, "r") for i in range(40)] + [(None, "n"), (3, "again")], "doc_id bigint, refs string")
    links = spark.createDataFrame([(3, ["10.1/x"]), (None, ["10.1/y"])], "doc_id bigint, dois array<string>")
    out = REF.with_links(docs, links)
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = [(r.doc_id, r.refs, r.links) for r in out.collect()]
    assert len(got) == 42 and sorted(x[1] for x in got if x[2]) == ["again", "r"] and (None, "n", None) in got


def test_comparison_moves_no_text(spark, small):
    """papers and their candidate headings are written once, and read from there."""
    files = Q.QUERIES["l15_compare_extractions"](spark, small).inputFiles()
    assert len({f.rsplit("/", 2)[-2] for f in files if "/bucketed-" in f}) == 2


def test_a_line_is_stripped_once_for_the_map(spark):
    """stripping and testing were repeated within the rule of a line."""
    lines = ["  INTRO  ", "text of it", " # Methods ", "more", "METHODS 2", "x" * 200]
    df = spark.createDataFrame([("\n".join(lines), [("intro", "introduction"), ("methods", "methodology")])],
                               "text string, mapping array<struct<clean:string,section:string>>")
    out = df.select(S.map_sections(F.col("text"), F.col("mapping")).alias("s"))
    # four times as many when the rule of a line held the stripping instead of its result
    assert out._jdf.queryExecution().analyzed().toString().count("trim(") <= 32
    got = {r.section: (r.text, r.by_hash) for r in out.first().s if r.text}
    assert got == {"introduction": ("INTRO  \ntext of it", False),
                   "methodology": ("# Methods \nmore\nMETHODS 2\n" + "x" * 200, True)}


def test_short_cuts_of_the_heading_rule(spark):
    """the guards decide as the patterns behind them do."""
    rows = [None, "", "ABC", "ABc", "ÄÖÜ", "äÖÜ", "ß" * 3, "A" * 50, "A" * 50 + "b", "A" * 50 + "ä", "12", "[1] Smith said.", "[1] SMITH",
            "1. Smith", "٣. Title", "٣ Title of many words " + "x" * 90, "IV. Limits " + "x" * 90, "Very long " + "x" * 90,
            "IX" + " " * 3 + "Y" + "z" * 90, "| table", "ends.", "X. A.", "V", "1. smith", "# x" + "." * 90, "ABC 5", "ABC ²"]
    df = spark.createDataFrame([(x,) for x in rows], "t string")
    t, n = F.col("t"), F.length("t")
    plain_upper = (F.upper(t) == t) & (F.lower(t) != t)
    has = lambda p: F.regexp_like(t, F.lit(p))
    plain = (
        F.when(n == 0, False).when(t.startswith("#"), True).when(has(H.BIBLIOGRAPHY_ITEM), False)
        .when((n >= 3) & plain_upper & ~has(H.ANY_DIGIT), True).when(has(H.NUMBERED_HEADING), True)
        .otherwise((n < 80) & ~t.endswith(".") & ~t.startswith("|")))
    bad = df.where(~H.heading_rule(t).eqNullSafe(plain) | ~is_upper(t).eqNullSafe(plain_upper))
    assert [r.t for r in bad.collect()] == []
    assert df.select(is_upper(t).alias("x")).where("x").count() == df.where(plain_upper).count() > 3
