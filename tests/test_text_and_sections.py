import random
import re

from pyspark.sql import functions as F

from scholium.functions import prompts as PF
from scholium.functions import text as T
from scholium.constants import SECTIONS
from scholium.functions import sections as SF
from scholium.operators import sections as SEC
from scholium.sources.shared import Bucketed


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_round_exact_is_exact(spark):
    rng = random.Random(7)
    values = [0.35, 0.25, 2.675, 1.005, 0.145, 22.5] + [
        rng.choice([rng.randint(0, 4000) / 200, rng.random() * 100]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for x, a, b in df.select("x", T.round_exact(F.col("x"), 1), T.round_exact(F.col("x"), 2)).collect():
        assert (a, b) == (round(x, 1), round(x, 2)), x


def test_split_lines_and_strip(spark):
    texts = ["", "a", "a\n", "\n", "a\r\nb\rc\x0bd\x85e f\x1cg\n\n", "  x \n\x0c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, lines, stripped in df.select("t", T.split_lines(F.col("t")), T.strip(F.col("t"))).collect():
        assert lines == t.splitlines() and stripped == t.strip()


LINES = [
    "# Abstract", "Introduction", "INTRODUCTION", "2 Related Work", "Methods", "plain words end here.",
    "another sentence that is long enough to be no heading at all because it has a final period.",
    "# References", "REFERENCES", "Smith, Funding of things", "# Appendix", "APPENDIX", "Acknowledgements",
    "A proof", "Results", "", "1. Introduction to it", "Discussion",
]


def test_segmentation_equals_a_line_by_line_walk(spark):
    rng = random.Random(3)
    docs = [(i, "\n".join(rng.choice(LINES) for _ in range(rng.randint(0, 25)))) for i in range(300)]
    papers = spark.createDataFrame(docs, "doc_id bigint, text string")
    events = {(r.doc_id, r.line_no): (r.event, r.section)
              for r in SEC.line_events(SEC.explode_lines(papers)).collect()}
    got = {(r.doc_id, r.section): r.text
           for r in SEC.long_sections(SEC.keyword_sections(papers)).collect()}
    want = {}
    for doc, text in docs:
        current, out = None, {}
        for no, line in enumerate(text.splitlines()):
            event, section = events[(doc, no)]
            if event == "SET":
                current = section
            elif event == "HARD_CLEAR" or (event == "SOFT_CLEAR" and current != "references"):
                current = None
            if current:
                out.setdefault(current, []).append(line)
        want.update({(doc, k): "\n".join(v).strip() for k, v in out.items() if "\n".join(v).strip()})
    assert got == want


def test_long_documents_do_not_overflow(spark):
    text = "# Methods\n" + "\n".join(f"line {i} of the long method text." for i in range(60000))
    papers = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    rows = SEC.long_sections(SEC.segment_sections(papers)).collect()
    assert [r.section for r in rows] == ["methodology"] and rows[0].text == text


def test_segmentation_is_narrow_and_jvm_only(spark):
    papers = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    plan = plan_of(SEC.long_sections(SEC.segment_sections(papers)))
    assert "Exchange" not in plan and "Python" not in plan.replace("PythonRDD", "")


def test_tier_merge_uses_the_map_only_for_sparse_papers(spark):
    text = "OVERVIEW\nshort view.\n2 Pre-Training\nlong text.\nIV. Limits\nsome limits.\nDiscussion\nwords."
    papers = spark.createDataFrame([(1, text), (2, "# Abstract\nA.\n# Introduction\nI.\n# Methods\nM.\n# Results\nOVERVIEW\nR.")],
                                   "doc_id bigint, text string")
    hmap = spark.createDataFrame(
        [("OVERVIEW", "abstract"), ("2 Pre-Training", "methodology"), ("IV. Limits", "conclusion"), ("X", "bogus")],
        "heading string, section string")
    out = {r.doc_id: r for r in SEC.detect_sections(papers, hmap).collect()}
    assert out[1].tier == 2 and out[2].tier == 1
    assert {s.section for s in out[1].sections if s.text} == {"abstract", "methodology", "conclusion", "discussion"}


def test_no_text_is_shuffled_when_the_map_is_laid_over(spark):
    """With joins by broadcast off, what is exchanged above the bucketed table holds neither texts nor sections."""
    papers = spark.createDataFrame([(i, f"OVERVIEW\nview {i}.\nIV. Limits\nlimits.\n") for i in range(40)], "doc_id bigint, text string")
    hmap = spark.createDataFrame([("OVERVIEW", "abstract"), ("IV. Limits", "conclusion")], "heading string, section string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = Bucketed(spark)
        for out in (SEC.detect_sections(papers, hmap, tables), SEC.segment_by_map(papers, hmap, tables)):
            plan = out._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
            lines = plan.splitlines()
            depth = lambda line: len(line) - len(line.lstrip(" :+-"))
            for k, line in enumerate(lines):
                if "Exchange hashpartitioning(doc_id" in line:
                    below = lines[k + 1]
                    assert "mapping" in below or "collect_list" in below or "count" in below or "pos" in below, below
                    assert "text" not in below and "sections" not in below
            assert len(out.collect()) == 40
        assert {r.tier for r in SEC.detect_sections(papers, hmap, tables, keep_text=False).collect()} == {2}
        names = [n for n, _ in tables.tables]
        tables.remove()
        assert not any(spark.catalog.tableExists(n) for n in names)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plain_scan(text, sections):
    """The keyword scan, keyword by keyword."""
    space = r"[ \t\n]*"

    def pattern(words, anchor):
        return re.compile(anchor + space + r"(?:\d+\.?" + space + ")?(?:" + "|".join(map(re.escape, words)) + ")" + space + r"[\n\-—:.]", re.I)

    every = pattern([w for _, _, ws in SECTIONS for w in ws], r"(?<!\n)\n")
    out = []
    for (_, _, words), have in zip(SECTIONS, sections):
        hits = [m for m in (pattern([w], r"(?:\A|(?<!\n)\n)").search(text) for w in words) if m]
        if have or not hits:
            out.append(have)
            continue
        tail = text[hits[0].end():]
        stop = every.search(tail)
        out.append((hits[0].group() + (tail[: stop.start()] if stop else tail)).strip())
    return out


def test_one_pass_scan_equals_the_scan_by_keyword(spark):
    rng = random.Random(9)
    words = [w for _, _, ws in SECTIONS for w in ws]
    parts = ["\n", "\n\n", " ", "1. ", "2", ":", "-", ".", "—", "some words", "method of", "x"]
    texts = ["".join(rng.choice([*parts, rng.choice(words), rng.choice(words).upper(), "\n" + rng.choice(words) + "\n"]) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
    bare = SF.keyword_sections(SF.section_runs(F.col("t")))
    for _, t, have, got in df.withColumn("s", bare).select("i", "t", "s", SF.scan_missing(F.col("t"), F.col("s"))).collect():
        assert [s.text for s in got] == plain_scan(t, [s.text for s in have]), t


def test_checksum_by_residues(spark):
    rng = random.Random(2)
    texts = ["", "a", "é日\U0001F600"] + ["".join(chr(rng.choice([rng.randrange(1, 128), rng.randrange(128, 3000)])) for _ in range(rng.randrange(60))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, points in df.select("t", SF.points_mod_6(F.col("t"))).collect():
        assert points == sum(map(ord, t)) % 6


def test_smart_truncate(spark):
    df = spark.createDataFrame([("One end. Two words here",), ("nospaces" * 4,), ("short",)], "t string")
    got = [r[0] for r in df.select(PF.smart_truncate(F.col("t"), 12)).collect()]
    assert got == ["One end.\n[...truncated]", "nospacesnosp\n[...truncated]", "short"]
