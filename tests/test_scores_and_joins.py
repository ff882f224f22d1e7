import difflib
import random

import pytest
from pyspark.sql import functions as F

from scholium.constants import DISCIPLINE_WEIGHTS, LAYERS, max_marks
from scholium.functions import scoring as SC
from scholium.functions import similarity as SIM
from scholium.operators import reviews as RV
from scholium.operators import verification as V
from scholium.operators.lookup import lookup_join
from scholium.sources.shared import materialize

FACTS = """doc_id bigint, blank boolean, total_refs int, dois array<string>, doi_labels array<string>,
arxiv_ids array<string>, duplicates array<string>,
recency struct<recency_score:double,recent_ratio:double,recency_note:string,ref_years:array<int>>,
verified_dois array<string>, missing_dois array<string>, blocked_dois array<string>, arxiv_verified int"""


def score(spark, ok=0, bad=0, blocked=0, titles=(0, 0, 0), recency=7.0, dups=0, arxiv=(0, 0), blank=False, n=5):
    names = [[f"{p}{i}" for i in range(k)] for p, k in (("v", ok), ("m", bad), ("u", blocked))]
    dois = sum(names, [])
    facts = spark.createDataFrame(
        [(1, blank, n, dois, dois, ["a"] * arxiv[1], ["d"] * dups, (recency, None, "note", []), *names, arxiv[0])], FACTS)
    rows = [(1, s) for s, k in zip(("verified", "not_found", "unreachable"), titles) for _ in range(k)]
    return V.citation_results(V.outcome_counts(facts, spark.createDataFrame(rows, "doc_id bigint, status string"))).first()


@pytest.mark.parametrize("kwargs,want", [
    (dict(ok=2, recency=10.0), 10.0),
    (dict(ok=1, bad=1, recency=5.0), 5.0),
    (dict(ok=1, blocked=1, recency=10.0), 10.0),
    (dict(blocked=1), 7.0),
    (dict(ok=1, bad=2, recency=7.0), 4.0),
    (dict(ok=1, bad=1, titles=(0, 1, 0), recency=5.0), 3.6),
    (dict(ok=1, titles=(1, 1, 0), recency=6.0), 6.6),
    (dict(titles=(4, 1, 0), recency=10.0), 6.0),
    (dict(titles=(2, 3, 0), recency=5.0), 4.2),
    (dict(titles=(1, 4, 0), recency=3.0), 2.2),
    (dict(recency=7.0), 3.8),
    (dict(titles=(0, 0, 3), recency=7.0), 6.0),
    (dict(titles=(2, 3, 0), recency=5.0, dups=1), 3.4),
    (dict(titles=(2, 3, 0), recency=5.0, arxiv=(7, 10)), 5.0),
    (dict(ok=1, bad=1, recency=5.0, arxiv=(7, 10)), 6.2),
    (dict(ok=1, bad=1, recency=5.0, arxiv=(4, 10)), 5.6),
    (dict(blank=True, n=0), 0.0),
])
def test_citation_scores(spark, kwargs, want):
    assert score(spark, **kwargs).score == want


def test_throttled_result_is_cleared(spark):
    r = score(spark, blocked=2, titles=(0, 0, 1), dups=1)
    assert (r.score, r.verified, r.not_found, r.unreachable) == (7.0, 0, 0, 3)
    assert r.flagged_items == [] and "throttled" in r.issues[0]


def test_weights_and_marks():
    assert all(abs(sum(w) - 1) < 1e-9 for w in DISCIPLINE_WEIGHTS.values())
    totals = {d: sum(max_marks(w) for w in ws) for d, ws in DISCIPLINE_WEIGHTS.items()}
    assert totals["computer_science"] == 99 and totals["physics"] == 101 and totals["medicine_biology"] == 100


def test_weighted_scores(spark):
    df = spark.createDataFrame(
        [("x", dict.fromkeys(LAYERS, 10.0)), ("mathematics", {"evidence_claims": 10.0}), ("humanities_social", {"evidence_claims": 10.0})],
        "d string, s map<string,double>")
    got = [r[0] for r in df.select(SC.weighted_score(F.col("s"), SC.resolve_discipline(F.col("d")))).collect()]
    assert got == [100.0, 37.5, 20.0]
    cal = spark.createDataFrame([(float(i),) for i in range(11)], "x double").select(SC.calibrate(F.col("x")))
    assert [r[0] for r in cal.collect()][5:10] == [4.0, 5.5, 7.0, 8.5, 10.0]


def test_review_parsing(spark):
    good = '{"structure_sections":{"score":12,"issues":["a"],"suggestions":[]},"clarity_writing":{},"methodology_rigor":null,"evidence_claims":{"score":3}}'
    df = spark.createDataFrame([(1, good), (2, '{"structure_sections": {"sc'), (3, '{"score": 4}')], "doc_id bigint, review_json string")
    out = {r.doc_id: r for r in RV.parse_reviews(df).collect()}
    assert [x.score for x in out[1].layers] == [10.0, 0.0, 0.0, 3.0] and not out[1].analysis_failed
    assert out[1].layers[2].issues == ["Section not found in document."]
    assert out[2].analysis_failed and [x.score for x in out[3].layers] == [4.0] * 4


def test_hot_keys_join_like_a_plain_join(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{rng.randint(0, 20)}") for i in range(900)], "id int, key string")
    dim = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(15)], "key string, v int")
    plain = sorted(map(str, rows.join(dim, "key", "left").select("id", "key", "v").collect()))
    spread = sorted(map(str, lookup_join(rows, dim, "key", rows_per_slice=10).select("id", "key", "v").collect()))
    assert plain == spread


def brute_hits(refs, works):
    out = []
    for r in refs:
        rt = set(r.lower().split())
        hits = []
        for w in {w.lower() for w in works}:
            shared = len(rt & set(w.split()))
            if shared >= (3 * len(rt) + 4) // 5:
                hits.append((-shared, w))
        out += [(r.lower(), w, -s) for s, w in hits]
    return sorted(out)


def test_title_search_is_exact_under_skew(spark):
    rng = random.Random(11)
    words = ["the", "of", "alpha", "beta", "gamma", "delta", "kappa", "sigma"]
    make = lambda: " ".join(["the"] + rng.sample(words[1:], rng.randint(1, 5)))
    refs, works = [make() for _ in range(60)], [make() for _ in range(200)]
    refs += ["the of alpha"] * 40
    works += ["The of Alpha"] * 80
    r = spark.createDataFrame([(t,) for t in refs], "title string")
    w = spark.createDataFrame([(f"d{i}", t, 2000 + i % 5) for i, t in enumerate(works)], "doi string, title string, year int")
    for slices in (1_000_000, 5):
        got = sorted((x.title, x.found, x.shared) for x in V.search_titles(r, w, rows_per_slice=slices).collect())
        assert got == brute_hits(sorted(set(refs)), works)


def test_equal_title_is_found_among_many_longer_ones(spark):
    titles = ["A deep learning view of river ice", "Ample deep learning for tide tables", "Applied deep learning in tram depots", "Deep Learning"]
    works = spark.createDataFrame([(f"d{i}", t, 2015) for i, t in enumerate(titles)], "doi string, title string, year int")
    checks = spark.createDataFrame(
        [(1, 0, "deep learning", ""), (1, 1, "Deep Learning", "19\u0663\u0664"), (2, 0, "methods survey grids image nets solar", "")],
        "doc_id bigint, pos int, title string, year string")
    more = works.union(spark.createDataFrame([("e", "solar nets image grids survey methods", 2015)], works.schema))
    for dice in (False, True):
        got = {(r.doc_id, r.pos): r.status for r in V.verify_titles(checks, more, dice=dice).collect()}
        assert got[(1, 0)] == got[(1, 1)] == "verified"
        assert got[(2, 0)] == ("verified" if dice else "not_found")  # same words, other order


def test_a_changed_weight_changes_the_score(spark):
    layers = "array<struct<layer:string,score:double,issues:array<string>>>"
    df = spark.createDataFrame([(1, "physics", [(l, 8.0, []) for l in LAYERS]), (2, "astrology", [(LAYERS[0], 5.0, [])]), (3, None, None)],
                               f"doc_id bigint, discipline string, layers {layers}")
    rows = [(d, l, i, w[i], max_marks(w[i])) for d, w in DISCIPLINE_WEIGHTS.items() for i, l in enumerate(LAYERS)]
    schema = "discipline string, layer string, ord int, weight double, max_marks int"
    same = {r.doc_id: r for r in RV.weighted_score_by(df, spark.createDataFrame(rows, schema)).collect()}
    plain = {r.doc_id: r.final_score for r in RV.weighted_score(RV.resolve_discipline(df.where("layers is not null"))).collect()}
    assert {i: same[i].final_score for i in plain} == plain and same[3].final_score == 0.0
    halved = [(d, l, i, w / 2 if d == "physics" else w, m) for d, l, i, w, m in rows]
    other = {r.doc_id: r.final_score for r in RV.weighted_score_by(df, spark.createDataFrame(halved, schema)).collect()}
    assert other[1] == plain[1] / 2 and other[2] == plain[2]


def test_character_bound_is_above_the_ratio(spark):
    rng = random.Random(5)
    make = lambda: "".join(rng.choice("abcd ef") for _ in range(rng.randint(0, 14)))
    pairs = spark.createDataFrame([(make(), make()) for _ in range(300)], "a string, b string")
    rows = pairs.select(SIM.character_bound(F.col("a"), F.col("b")).alias("u"), SIM.matching_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(r.u >= r.r - 1e-12 for r in rows)


def test_matching_ratio_is_the_sequence_matchers(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 8)))
    rows = [("", ""), ("a", ""), ("", "b"), ("abc", "abc"), ("é日\U0001F600x", "日\U0001F600x"), ("ab" * 120, "ba" * 120)]
    for size, changes, n in ((8, 3, 200), (60, 20, 15)):  # the longer ones have popular characters
        for _ in range(n):
            a = [word() for _ in range(rng.randint(1, size) if size < 60 else size)]
            b = list(a)
            for _ in range(rng.randrange(changes + 1)):
                b[rng.randrange(len(b))] = word()
            if rng.random() < 0.3:
                rng.shuffle(b)
            rows.append((" ".join(a), " ".join(b)))
    for _ in range(15):
        a = [chr(rng.randrange(97, 900)) for _ in range(250)]
        b = [chr(rng.randrange(97, 900)) if rng.random() < 0.2 else c for c in a]
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string").repartition(4)
    for a, b, r in df.select("a", "b", SIM.matching_ratio(F.col("a"), F.col("b"))).collect():
        assert r == difflib.SequenceMatcher(None, a, b).ratio(), (a, b)


def test_title_check_runs_in_the_jvm(spark):
    works = spark.createDataFrame([("d", "Slow kilns of the upper valley", 2017)], "doi string, title string, year int")
    checks = spark.createDataFrame([(1, 0, "Slow kilns of an upper valley", "2016")], "doc_id bigint, pos int, title string, year string")
    out = V.verify_titles(checks, works)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.first().status == "verified" and "EvalPython" not in plan and "MapInPandas" not in plan


def test_year_relaxes_the_threshold_and_exact_ratio(spark):
    works = spark.createDataFrame([("d", "Salt Roads Of The Desert", 2017)], "doi string, title string, year int")
    checks = spark.createDataFrame(
        [(1, 0, "Salt roads of the desert", ""), (1, 1, "Salt roads", "2018"), (1, 2, "Quantum biology now", "2017"), (1, 3, "", "")],
        "doc_id bigint, pos int, title string, year string")
    for dice in (False, True):
        got = {r.pos: r.status for r in V.verify_titles(checks, works, dice=dice).collect()}
        assert got == {0: "verified", 1: "verified", 2: "not_found", 3: "not_found"}
    assert spark.range(1).select(SIM.dice(SIM.bigrams(F.lit("night")), SIM.bigrams(F.lit("nacht")))).first()[0] == 0.25


def test_titles_with_a_likely_hit_are_not_searched_for(spark):
    """Every title has every work as a hit: only those without a similar one may meet them all."""
    ends = [f"{a}{b}" for a in ("kel", "mor", "tas", "vin", "rop", "dul") for b in ("ane", "ibo", "uck", "esh", "olt", "irm")]
    works = spark.createDataFrame(
        [(f"d{i}", f"Common glacier sediment survey of {e}", 2000) for i, e in enumerate(ends)], "doi string, title string, year int")
    rows = [(i, 0, f"Common glacier sediment survey of {e}x", "1990") for i, e in enumerate(ends)]
    rows += [(900, 0, "Bread ovens and their smoke", "1990"), (901, 0, f"common glacier sediment survey of {'q' * 300}", "1990")]
    checks = spark.createDataFrame(rows, "doc_id bigint, pos int, title string, year string")
    for dice in (False, True):
        sizes = []

        def cut(df):
            out = materialize(df)
            sizes.append(out.count())
            return out

        got = {r.doc_id: r.status for r in V.verify_titles(checks, works, dice=dice, cut=cut).collect()}
        assert got == {**{i: "verified" for i in range(len(ends))}, 900: "not_found", 901: "verified" if dice else "not_found"}  # equal pairs of one letter count once
        assert max(sizes) <= 8 * len(rows)


def test_least_ratio_is_a_lower_bound(spark):
    texts = ["", "a", "abc", "on abc and more", "river ice", "river mice", "ice river", "aaab", "aab", "x" * 250, "y" + "x" * 120, "😀ice", "ice😀"]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = pairs.select("a", "b", SIM.least_ratio(a, b).alias("least"), SIM.matching_ratio(a, b).alias("ratio")).collect()
    assert [r for r in got if r.least > r.ratio] == []
    assert {(r.a, r.b): r.least for r in got}[("river mice", "river ice")] == 12 / 19


def test_marks_of_words_never_hide_a_shared_word(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(150)]  # more than there are marks
    pairs = [(rng.sample(words, rng.randrange(0, 12)), rng.sample(words, rng.randrange(0, 60))) for _ in range(300)]
    rows = spark.createDataFrame(pairs + [(words, words), (words, [])], "a array<string>, b array<string>")
    bound = SIM.shared_bound(F.size("a"), SIM.word_marks(F.col("a")), SIM.word_marks(F.col("b")))
    got = rows.select(F.size(F.array_intersect("a", "b")).alias("shared"), bound.alias("bound"), F.size("a").alias("size")).collect()
    assert all(r.shared <= r.bound <= r.size for r in got)
    assert sum(r.bound for r in got[:300]) < sum(r.size for r in got[:300])


def test_title_search_looks_at_marks_before_words(spark):
    titles = spark.createDataFrame([("salt roads of the high desert",)], "title string")
    works = spark.createDataFrame([("d", "Salt roads of a desert", 2017)], "doi string, title string, year int")
    found = V.search_titles(titles, works)
    assert [(r.title, r.found, r.shared) for r in found.collect()] == [("salt roads of the high desert", "salt roads of a desert", 4)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line and "array_intersect" in line)
    assert 0 <= join.index("bit_count") < join.index("array_intersect")


def test_pairs_are_looked_up_only_for_titles_without_a_hit_by_all_words(spark):
    works = spark.createDataFrame(
        [("a", "Salt roads desert", 2017), ("b", "Salt roads desert caravans north", 2017), ("c", "Slow kilns valley clay", 2017)],
        "doi string, title string, year int")
    titles = spark.createDataFrame([("salt roads desert revisited",), ("slow kilns valley survey caravans",)], "title string")
    stored = []

    def cut(df):
        stored.append(df)
        return df

    got = {(r.title, r.found) for r in V.likely_hits(titles, works, cut).collect()}
    assert got == {("salt roads desert revisited", "salt roads desert"), ("slow kilns valley survey caravans", "slow kilns valley clay")}
    # hits by all words are settled on their own
    assert [(r.title, r.found) for r in stored[-1].collect()] == [("salt roads desert revisited", "salt roads desert")]


def test_outcomes_of_titles_are_looked_up_once(spark):
    """The plan of the last look-ups holds the first only once: not again for their counts, nor for the hot keys of those."""
    works = spark.createDataFrame([("Deep parsing of odd tables", 2001), ("Deep parsing of odd tables", 2010), ("Other things", None)], "title string, year int")
    log = spark.createDataFrame([("title", "Blocked Title Here", 1, 503), ("doi", "Other things", 1, 503)], "kind string, id string, attempt int, http_status int")
    rows = [("Deep Parsing of Odd Tables", "2001"), ("Deep parsing of odd tables", None), ("deep parsing of even tables", "2011"), ("deep parsing of even tables", "1990"),
            ("blocked title here", "2001"), ("OTHER THINGS", ""), ("nothing alike at all", "2001"), ("", "2001")]
    checks = spark.createDataFrame([(i % 3, i, t, y) for i, (t, y) in enumerate(rows * 2)], "doc_id bigint, pos int, title string, year string")
    plain = {r.pos: r.status for r in V.verify_titles(materialize(checks), works, log).collect()}
    assert [plain[i] for i in (0, 1, 4, 5, 6, 7)] == ["verified", "verified", "unreachable", "verified", "not_found", "not_found"]
    out = V.verify_titles(materialize(checks), works, log, cut=materialize)
    assert {r.pos: r.status for r in out.collect()} == plain and out.count() == len(plain) == 16
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation ") <= 16
