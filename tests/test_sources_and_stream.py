import bisect
import hashlib
import json

from pyspark.sql import functions as F

from scholium.operators import validation as VAL
from scholium.plans.analyze import analyze_corpus, validate_batch
from scholium.sources import derived
from scholium.sources import incremental as INC
from scholium.sources import readers
from scholium.streaming.analyze_stream import analyze_stream

ENTRY = """<entry><id>http://arxiv.org/abs/{i}v2</id><title> A
 long   title </title>{link}</entry>"""


def test_feed(spark, tmp_path):
    link = '<link title="pdf" href="http://x/p.pdf" rel="related"/><link href="http://y" rel="alternate"/>'
    (tmp_path / "f.xml").write_text(
        '<feed xmlns="http://www.w3.org/2005/Atom">' + ENTRY.format(i="2301.1", link=link)
        + ENTRY.format(i="2301.2", link='<link href="http://y" rel="alternate"/>') + "</feed>")
    rows = {r.arxiv_id: r for r in readers.read_feed(spark, str(tmp_path / "f.xml")).collect()}
    assert rows["2301.1"].pdf_url == "http://x/p.pdf" and rows["2301.1"].title == "A long title"
    assert rows["2301.2"].pdf_url == "https://arxiv.org/pdf/2301.2.pdf"


def test_text_files_and_rejects(spark, tmp_path):
    (tmp_path / "a.txt").write_text("word " * 50)
    (tmp_path / "b.txt").write_text("  too short  ")
    good, bad = readers.load_papers(spark, str(tmp_path), "text")
    assert good.count() == 1 and bad.first().chars == 9


def test_batch_results_and_summary(spark, tmp_path):
    layer = {"score": 5.0, "issues": ["x"], "suggestions": ["y"]}
    names = ["structure_sections", "clarity_writing", "methodology_rigor", "evidence_claims", "citations"]
    response = {
        "filename": "p.pdf", "detected_sections": {"Abstract": 90, "Methods": 88}, "section_count": 2, "warnings": [],
        "layer_scores": dict.fromkeys(names, 5.0), "layer_details": dict.fromkeys(names, layer), "final_score": 50.0,
        "grade": "D — Poor", "citation_result": {"total_refs": 3, "verified": 1, "not_found": 0, "unreachable": 0,
                                                 "flagged_dois": [], "flagged_items": []}}
    records = [
        {"paper": "a", "title": "A", "category": "cs", "analyze_status": 200, "analyze_time_ms": 100, "report_size_bytes": 9000, "analyze_response": response},
        {"paper": "b", "title": "B", "category": "cs", "analyze_status": 500, "analyze_time_ms": 0, "error": "boom", "analyze_response": None},
        {"paper": "c", "title": "C", "category": "bio", "analyze_status": 200, "analyze_time_ms": 300, "report_size_bytes": 9000, "analyze_response": response}]
    (tmp_path / "r.json").write_text(json.dumps(records))
    results = readers.read_results(spark, str(tmp_path / "r.json"))
    meta = spark.createDataFrame([("a", ["abstract"], False, None), ("c", ["abstract", "results"], True, 20)],
                                 "paper string, expected_sections array<string>, has_dois boolean, expected_ref_count int")
    out = validate_batch(results, meta)
    status = {r.paper: r for r in out["validations"].collect()}
    assert [status[p].status for p in "abc"] == ["PASS", "FAIL", "WARN"]
    assert status["b"].errors == ["Analysis failed: boom"]
    s = out["summary"].first()
    assert (s.total, getattr(s, "pass"), s.warn, s.fail, s.avg_score, s.avg_time_ms) == (3, 1, 1, 1, 50.0, 200.0)
    assert out["verdict"].first()[0] == "FAILURES DETECTED"


def test_store_keeps_failures_out(spark):
    store = spark.createDataFrame([("k1", 7)], "content_digest string, v int")
    new = spark.createDataFrame([(2, "k1", 9, False), (3, "k2", 8, False), (1, "k2", 6, False), (4, "k3", 5, True)],
                                "doc_id bigint, content_digest string, v int, analysis_failed boolean")
    assert sorted(map(tuple, INC.merge_store(store, new).collect())) == [("k1", 7), ("k2", 6)]


def test_records_of_unknown_shape(spark):
    rows = [
        ("new", '{"final_score": 7, "grade": "B", "citation_result": {"total_refs": 3, "verified": 1, "flagged_dois": ["x"]}, "layer_scores": {"citations": 2.5}}'),
        ("old", '{"final_score": 76.5, "citations": {"total_refs": 53, "verified": 0, "score": 2.0}, "detected_sections": {"Abstract": 92}, "verdict": "fine"}'),
        ("odd", '{"final_score": {"value": 1}, "grade": 5, "layer_scores": [1, 2]}'), ("list", "[1]"), ("broken", "{"), ("none", None), ("empty", ""),
    ]
    df = spark.createDataFrame([(p, j, "c") for p, j in rows], "paper string, response_json string, category string")
    got = {r.paper: r for r in readers.tolerant_responses(df).drop("response").collect()}
    assert (got["new"].final_score, got["new"].total_refs, got["new"].flagged_dois, got["new"].layer_scores) == (7.0, 3, ["x"], {"citations": 2.5})
    assert (got["old"].final_score, got["old"].total_refs, got["old"].grade, got["old"].unknown) == (76.5, 53, None, ["verdict"])
    assert got["odd"].final_score is None and got["odd"].grade == "5" and got["odd"].layer_scores is None
    assert [got[p].readable for p in ("list", "broken", "none", "empty")] == [True, False, False, False]
    assert all(got[p].unknown == [] for p in ("list", "broken", "none", "empty"))
    shapes = readers.response_shapes(df).collect()
    assert len(shapes) == 1 and shapes[0].n == 4 and readers.tolerant_responses(df.limit(0)).count() == 0


def test_summary_while_writing(spark, tmp_path):
    rows = [("a", "PASS", 50.0, 10, [], ["w"]), ("b", "FAIL", None, 0, ["e", "f"], []), ("c", "WARN", 70.0, 30, [], ["w", "v"])]
    df = spark.createDataFrame(rows, "paper string, status string, final_score double, analyze_time_ms bigint, errors array<string>, warnings array<string>")
    for c in ("fallback_layers", "section_gaps", "citation_gaps"):
        df = df.withColumn(c, F.array().cast("array<string>"))
    observed = VAL.write_with_summary(df, str(tmp_path / "v"))
    assert observed.collect() == VAL.run_summary(df).collect() and spark.read.parquet(str(tmp_path / "v")).count() == 3
    none = VAL.write_with_summary(df.limit(0), str(tmp_path / "w")).first()
    assert (none.total, none.avg_score, none.total_errors) == (0, 0.0, 0)


def test_sketches_of_batches_add_up(spark):
    times = [(i * 7919) % 100003 for i in range(30000)]
    df = spark.createDataFrame([("a" if i % 3 else "b", 200 if i % 5 else 500, t) for i, t in enumerate(times)], "category string, analyze_status int, analyze_time_ms bigint")
    whole = {r.category: r for r in VAL.merged_counts(VAL.latency_sketches(df)).collect()}
    parts = VAL.latency_sketches(df.where("analyze_time_ms < 30000")).union(VAL.latency_sketches(df.where("analyze_time_ms >= 30000")))
    merged = {r.category: r for r in VAL.merged_counts(parts).collect()}
    for c in "ab":
        own = sorted(t for i, t in enumerate(times) if (i % 3 > 0) == (c == "a"))
        assert merged[c][1:4] == whole[c][1:4]
        for r in (merged[c], whole[c]):
            for share, value in ((0.5, r.p50_time_ms), (0.9, r.p90_time_ms)):
                assert abs(bisect.bisect_right(own, value) / len(own) - share) < 0.005


def files_of(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def folders_read(store, digests):
    """Folders of the rows that a look-up scans; the scan's own partition filter leaves out the others."""
    rows = store._touched(digests, store.digits())
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder#" in plan or "folder#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    return {r.folder for r in rows.select("folder").distinct().collect()}


def test_store_merges_in_place(spark, tmp_path):
    """Folders that a batch does not touch keep their files, and are not read; a full folder makes the store grow by a digit."""
    root = tmp_path / "store"
    store = INC.ResultStore(spark, str(root), "content_digest string, v bigint", rows_per_folder=40)
    digest = lambda i: hashlib.sha256(str(i).encode()).hexdigest()

    def frame(ids, plus=0):
        return spark.createDataFrame([(digest(i), i + plus) for i in ids], "content_digest string, v bigint")

    assert store.lookup(frame([1])).count() == 0
    store.merge(frame(range(300)))
    assert store.digits() == 1 and store.rows().count() == 300
    before = files_of(root)
    new = [i for i in range(300, 400) if digest(i)[0] == "a"]
    store.merge(frame(new).union(frame([0], 9)).where(F.col("content_digest").startswith("a")))
    after = files_of(root)
    changed = {f.split("/")[1] for f, _ in set(before.items()) ^ set(after.items())}
    assert changed == {"folder=da"}
    asked = [i for i in range(300) if digest(i)[0] == "3"] + [10**6]
    found = store.lookup(frame(asked))
    assert sorted(r.v for r in found.collect()) == sorted(asked[:-1])
    assert folders_read(store, frame(asked)) == {"d3", "d" + digest(10**6)[0]}
    store.merge(frame([0], 50))  # stored rows win
    assert store.lookup(frame([0])).first().v == 0
    store.merge(frame(range(400, 1400)))
    assert store.digits() == 2 and store.rows().count() == 300 + len(new) + 1000
    store.merge(frame(range(400, 1400)))  # once more: nothing changes
    assert store.rows().count() == 300 + len(new) + 1000 and not (root / "digits=1").exists()


def test_a_batch_reads_no_more_from_an_older_store(spark, tmp_path):
    digest = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    store = INC.ResultStore(spark, str(tmp_path / "s"), "content_digest string, v bigint", rows_per_folder=60)
    read = []
    for start in (0, 2000):
        rows = [(digest(i), i) for i in range(start, start + 2000)]
        store.merge(spark.createDataFrame(rows, "content_digest string, v bigint"))
        batch = spark.createDataFrame([(digest(i),) for i in range(5)], "content_digest string")
        assert len(folders_read(store, batch)) <= 5 and store.lookup(batch).count() == 5
        read.append(store._touched(batch, store.digits()).count())
    assert store.rows().count() == 4000 and max(read) <= 5 * 60


REVIEW = json.dumps({**{n: {"score": 8, "issues": ["i"], "suggestions": ["s"]} for n in
                        ["structure_sections", "clarity_writing", "methodology_rigor", "evidence_claims"]}, "discipline": "physics"})
TEXT = ("# Abstract\nWe study {i}.\n# Introduction\n" + "Many words about the topic of the day. " * 20
        + "\n# Methods\nWe do it.\n# References\n[1] Smith, J. (2020). Title of a paper here. J. DOI: 10.1000/w.{i}")


def test_stream_equals_batch_and_reuses_reviews(spark, tmp_path):
    source, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    papers = spark.createDataFrame([(i, TEXT.format(i=i)) for i in range(3)], "doc_id bigint, text string")
    works = spark.createDataFrame([("10.1000/w.0", "Title of a paper here", 2020)], "doi string, title string, year int")
    preprints = spark.createDataFrame([("1234.56789",)], "arxiv_id string")

    asked = []

    def reviews_of(wanted):
        asked.append(wanted.count())
        return wanted.select("doc_id", F.lit(REVIEW).alias("review_json"))

    def run():
        analyze_stream(spark, source, out, ck, 2024, reviews_of, works, preprints).awaitTermination()

    papers.coalesce(1).write.parquet(source)
    run()
    first = spark.read.parquet(out).select("doc_id", "final_score", "citation_result.verified").collect()
    batch = analyze_corpus(papers, None, None, papers.select("doc_id", F.lit(REVIEW).alias("review_json")), works, preprints, 2024)
    assert sorted(first) == sorted(batch.select("doc_id", "final_score", "citation_result.verified").collect())
    spark.createDataFrame([(10, TEXT.format(i=1)), (11, TEXT.format(i=5))], "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(source)
    run()
    again = spark.read.parquet(out).collect()
    assert sorted(r.doc_id for r in again) == [0, 1, 2, 10, 11] and not any(r.analysis_failed for r in again)
    assert asked == [3, 1]  # the copy's review comes from the store
    # a batch that is run again, as after a crash before its commit, changes nothing
    for f in sorted((tmp_path / "ck" / "commits").glob("*1*")):
        f.unlink()
    run()
    assert asked == [3, 1, 0]
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, again))
    assert len({r.content_digest for r in again}) == 4


def test_every_usable_paper_has_a_record(spark):
    papers = spark.createDataFrame([(1, TEXT.format(i=1)), (2, TEXT.format(i=2)), (3, "too short")], "doc_id bigint, text string")
    works = spark.createDataFrame([("10.1000/w.1", "Title of a paper here", 2020)], "doi string, title string, year int")
    preprints = spark.createDataFrame([("1234.56789",)], "arxiv_id string")
    reviews = spark.createDataFrame([(1, REVIEW)], "doc_id bigint, review_json string")
    rows = {r.doc_id: r for r in analyze_corpus(papers, None, None, reviews, works, preprints, 2024).collect()}
    assert sorted(rows) == [1, 2] and [rows[i].analysis_failed for i in (1, 2)] == [False, True]
    assert rows[1].layer_details["clarity_writing"].score == 8.0 and rows[1].layer_scores["clarity_writing"] == 8.5
    assert rows[2].layer_scores["clarity_writing"] == 0.0
    known = spark.createDataFrame([(rows[2].content_digest, REVIEW)], "content_digest string, review_json string")
    stored = {r.doc_id: r for r in analyze_corpus(papers, None, None, reviews.limit(0), works, preprints, 2024, store=known).collect()}
    assert [stored[i].analysis_failed for i in (1, 2)] == [True, False]


def test_driver_keeps_nothing_of_a_derived_tables_text(spark, tmp_path, monkeypatch):
    """The parser drops its states of the long text, and the heap that planning took is given back; other texts are parsed as before."""
    spark.createDataFrame([(1, "some text")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    during, given, parse = [], [], type(spark).sql
    key = "spark.sql.parser.parserDfaCacheFlushThreshold"

    def spy(self, *args, **kw):
        during.append(self.conf.get(key, None))
        return parse(self, *args, **kw)

    monkeypatch.setattr(type(spark), "sql", spy)
    monkeypatch.setattr(derived, "give_back", lambda s: given.append(s), raising=False)
    before = spark.conf.get(key, None)
    for _ in range(2):
        assert derived.load(spark, str(tmp_path), derived.works_sql).columns == ["doi", "title", "year"]
    assert during == ["1000"] and len(given) == 1 and spark.conf.get(key, None) == before
