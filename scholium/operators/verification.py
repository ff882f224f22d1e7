"""Reference verification as joins against registries, and the citation score.

Identifiers are looked up once per distinct value for the whole corpus; what travels is ids and
statuses, never reference text. Frames are keyed by doc_id and hold arrays as long as the document's
own reference list. The limits of the original on remote calls are arguments without a default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.constants import (
    DUPLICATE_DETAIL, NEUTRAL_SCORE, NO_DOI_CAP, NOT_FOUND_DETAIL, TITLE_MIN_SIMILARITY,
    TITLE_MIN_SIMILARITY_SAME_YEAR,
)
from scholium.functions import references as RF
from scholium.functions import similarity as SIM
from scholium.functions.text import empty_strings, first_n, let, round_exact
from scholium.operators.frames import pin
from scholium.operators.lookup import ROWS_PER_SLICE, hot_keys, lookup_join

# Outcomes that are tried once more, by kind of lookup (0 = no answer).
RETRIED = {"doi": [429, 503, 0], "title": [429], "arxiv": []}
# Rarest words of a title whose pairs lead to its likely hit.
PAIRED_WORDS = 4


def lookup_status(log: DataFrame) -> DataFrame:
    """(kind, id, status) of past lookups, at most two attempts.

    ``status`` is NULL where the service answered and the registry itself decides.
    """
    code = F.coalesce("http_status", F.lit(0))
    attempts = log.groupBy("kind", "id").agg(
        F.max(F.when(F.col("attempt") == 1, code)).alias("first"),
        F.max(F.when(F.col("attempt") == 2, code)).alias("second"),
    )
    retried = F.lit(False)
    for kind, codes in RETRIED.items():
        if codes:
            retried = retried | ((F.col("kind") == kind) & F.col("first").isin(codes))
    final = F.when(retried, F.coalesce("second", F.lit(0))).otherwise(F.col("first"))
    return attempts.withColumn("final", final).select(
        "kind", "id",
        F.when((F.col("kind") == "doi") & (F.col("final") == 200), "verified")
        .when((F.col("kind") == "doi") & (F.col("final") == 404), "not_found")
        .when(F.col("final") != 200, "unreachable").alias("status"),
    )


def registry(works: DataFrame, preprints: DataFrame) -> DataFrame:
    return (
        works.select(F.lit("doi").alias("kind"), F.col("doi").alias("id"))
        .unionByName(preprints.select(F.lit("arxiv").alias("kind"), F.col("arxiv_id").alias("id")))
        .distinct()
    )


def verify_ids(ids: DataFrame, known: DataFrame, log: DataFrame | None) -> DataFrame:
    """Adds ``status`` to (doc_id, pos, kind, id) rows; each distinct id is looked up once."""
    counts = ids.groupBy("kind", "id").agg(F.count(F.lit(1)).alias("n"))
    found = counts.join(known.withColumn("known", F.lit(True)), ["kind", "id"], "left")
    status = F.when(F.col("known"), "verified").otherwise("not_found")
    if log is not None:
        found = found.join(lookup_status(log).withColumnRenamed("status", "logged"),
                           ["kind", "id"], "left")
        status = F.coalesce("logged", status)
    return lookup_join(
        ids, found.select("kind", "id", status.alias("status")), ["kind", "id"], counts=counts
    )


def verify_dois(dois: DataFrame, works: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """(doc_id, pos, doi) rows with their status."""
    ids = dois.select("doc_id", "pos", F.lit("doi").alias("kind"), F.col("doi").alias("id"))
    known = works.select(F.lit("doi").alias("kind"), F.col("doi").alias("id")).distinct()
    return verify_ids(ids, known, log).select("doc_id", "pos", F.col("id").alias("doi"), "status")


def verify_arxiv(
    arxiv: DataFrame, preprints: DataFrame, log: DataFrame | None = None, most: int | None = None
) -> DataFrame:
    """Per document: all ids, verified ids (among the first ``most``, if given), and the ratio over all."""
    ids = (arxiv if most is None else arxiv.where(F.col("pos") < most)).select(
        "doc_id", "pos", F.lit("arxiv").alias("kind"), F.col("arxiv_id").alias("id"))
    known = preprints.select(F.lit("arxiv").alias("kind"), F.col("arxiv_id").alias("id")).distinct()
    checked = verify_ids(ids, known, log).groupBy("doc_id").agg(
        F.count_if(F.col("status") == "verified").alias("verified"))
    total = arxiv.groupBy("doc_id").agg(F.count(F.lit(1)).alias("ids"))
    return total.join(checked, "doc_id").withColumn("ratio", F.col("verified") / F.col("ids"))


# --- titles ------------------------------------------------------------------

def _sliced(rows: DataFrame, hot: DataFrame, own: str, other: str, spread: Column) -> DataFrame:
    """Spread rows of a hot token over their own slices, repeat them over the other side's."""
    out = rows.join(F.broadcast(hot), "token", "left")
    return out.withColumn(
        f"_{own}", F.pmod(spread, F.coalesce(f"{own}_slices", F.lit(1))).cast("int")
    ).withColumn(
        f"_{other}", F.explode(F.sequence(F.lit(0), F.coalesce(f"{other}_slices", F.lit(1)) - 1))
    ).drop("ref_slices", "work_slices")


def registry_titles(works: DataFrame) -> DataFrame:
    """Equal registry titles (lower case) as one row with their years: (found, years)."""
    return works.groupBy(F.lower("title").alias("found")).agg(
        F.sort_array(F.collect_set(F.when(F.col("year").between(1000, 2999), F.col("year"))))
        .alias("years")
    )


def needed_words(size: Column) -> Column:
    """60 % of a title's ``size`` words, rounded up: so many a hit has to share."""
    return F.floor((size * 3 + 4) / 5).cast("int")


def likely_hits(titles: DataFrame, works: DataFrame, cut) -> DataFrame:
    """At most one hit of a title, found in time linear in titles and registry: (title, found).

    Both sides give all their registry words as one key, and the pairs of the ``PAIRED_WORDS`` rarest as more; a key leads to
    two registry titles, and of all that a title comes to by the first, else by the others, the hit with most shared words and the nearest length is named. It
    may settle a title; what it does not settle has to be searched for (:func:`search_titles`).
    """
    entries = cut(pin(
        registry_titles(works).select(F.col("found").alias("title")).where(F.col("title") != ""),
        tokens=SIM.title_tokens(F.col("title"))))
    frequency = cut(entries.select(F.explode_outer("tokens").alias("token")).where(F.col("token").isNotNull())
                    .groupBy("token").agg(F.count(F.lit(1)).alias("n")))

    def keys(rows: DataFrame) -> DataFrame:
        words = rows.select("title", F.explode_outer("tokens").alias("token")).where(F.col("token").isNotNull())
        known = lookup_join(words, frequency, "token", how="inner", counts=words.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
        ranked = known.groupBy("title").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("ranked"))
        rare = pin(ranked, rare=F.transform(F.slice("ranked", 1, PAIRED_WORDS), lambda x: x["token"]))
        both = F.flatten(F.transform("rare", lambda a, i: F.transform(
            F.slice(F.col("rare"), i + 2, F.lit(PAIRED_WORDS)), lambda b: F.concat(a, F.lit(" "), b))))
        # no word is empty, so two blanks in front tell this key from a pair
        every = F.concat(F.lit("  "), F.array_join(F.transform("ranked", lambda x: x["token"]), " "))
        return rare.select("title", F.explode(F.concat(both, F.array(every))).alias("key"))

    few = keys(entries).groupBy("key").agg(F.min("title").alias("first"), F.max("title").alias("last"))
    refs = pin(titles.select("title"), tokens=SIM.title_tokens(F.col("title")))
    probes = cut(keys(refs))
    tokens, found_tokens = SIM.title_tokens(F.col("title")), SIM.title_tokens(F.col("found"))
    nearest = -F.abs(F.length("title") - F.length("found"))

    def named(some: DataFrame) -> DataFrame:
        led = lookup_join(some, few, "key", how="inner").select("title", F.explode(F.array("first", "last")).alias("found")).distinct()
        met = pin(led, size=F.size(tokens), shared=F.size(F.array_intersect(tokens, found_tokens)))
        return met.where(F.col("shared") >= needed_words(F.col("size"))).groupBy("title").agg(
            F.max_by("found", F.struct(F.col("shared"), nearest.alias("near"), F.col("found"))).alias("found"))

    # a hit by all words has as many as there can be: pairs are looked up only for titles without one
    by_all = F.startswith("key", F.lit("  "))
    whole = cut(named(probes.where(by_all)))
    return whole.unionByName(named(probes.where(~by_all).join(whole.select("title"), "title", "left_anti")))


def search_titles(
    titles: DataFrame, works: DataFrame, rows_per_slice: int = ROWS_PER_SLICE, cut=None,
    least_length_ratio: float = 0.0,
) -> DataFrame:
    """All registry titles that share at least 60 % of a title's words: (title, found, years, shared).

    At least one of the query's ``m - ceil(0.6 m) + 1`` rarest words must be in any hit, so only
    those are joined on: the frequent words cost nothing and no hit is lost. A pair is emitted
    at its first common rare word only. ``least_length_ratio`` leaves out pairs whose lengths alone
    bound ``2 * shorter / (shorter + longer)`` below it; the condition is part of the join.
    ``cut`` may materialise the distinct titles and the probes, which are read several times.
    """
    cut = cut or (lambda df: df)
    refs = titles.select(F.lower("title").alias("title")).where(F.col("title") != "").distinct()
    refs = cut(pin(refs, tokens=SIM.title_tokens(F.col("title"))))
    entries = pin(registry_titles(works), found_tokens=SIM.title_tokens(F.col("found")))
    entries = pin(entries, found_marks=SIM.word_marks(F.col("found_tokens")))
    postings = entries.select("found", "years", "found_tokens", "found_marks",
                              F.explode_outer("found_tokens").alias("token"))
    frequency = postings.groupBy("token").agg(F.count(F.lit(1)).alias("n"))

    words = refs.select("title", F.explode_outer("tokens").alias("token"))
    ranked = (
        lookup_join(words, frequency, "token", rows_per_slice=rows_per_slice)
        .groupBy("title")
        .agg(F.sort_array(F.collect_list(
            F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token").alias("token"))
        )).alias("ranked"))
    )
    need = needed_words(F.size("ranked"))
    probes = ranked.select(
        "title", need.alias("need"),
        F.transform("ranked", lambda x: x["token"]).alias("tokens"),
        F.transform(F.slice(F.col("ranked"), F.lit(1), F.size("ranked") - need + 1),
                    lambda x: x["token"]).alias("rare"),
    )
    probes = cut(probes.select("*", SIM.word_marks(F.col("tokens")).alias("marks"), F.explode_outer("rare").alias("token")))

    hot_works = hot_keys(frequency, ["token"], rows_per_slice, "work_slices")
    hot_refs = hot_keys(
        probes.groupBy("token").agg(F.count(F.lit(1)).alias("n")), ["token"], rows_per_slice,
        "ref_slices",
    )
    hot = hot_works.join(hot_refs, "token", "full_outer")
    left = _sliced(probes, hot, "ref", "work", F.xxhash64("title"))
    right = _sliced(postings, hot, "work", "ref", F.xxhash64("found"))
    first_common = F.get(F.array_intersect("rare", "found_tokens"), F.lit(0))
    shared = F.size(F.array_intersect("tokens", "found_tokens"))
    a, b = F.length("title"), F.length("found")
    # the join multiplies rows, so its partitions must not be merged by their input size
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["token", "_ref", "_work"]
    # one condition, cheap parts first: most pairs share too few words, which their marks tell without a look at the words
    may_share = SIM.shared_bound(F.size("tokens"), F.col("marks"), F.col("found_marks")) >= F.col("need")
    long_enough = 2 * F.least(a, b) >= F.lit(least_length_ratio) * (a + b)
    return (
        left.repartition(parts, *keys)
        .join(right, keys)
        .where(may_share & long_enough & (first_common == F.col("token")) & (shared >= F.col("need")))
        .select("title", "found", "years", shared.alias("shared"))
    )


def similar_enough(hits: DataFrame, dice: bool) -> DataFrame:
    """(title, found) rows whose similarity is enough whatever the year."""
    a, b = F.col("title"), F.col("found")
    if dice:
        enough = SIM.dice(SIM.bigrams(a), SIM.bigrams(b)) >= TITLE_MIN_SIMILARITY
    else:
        enough = (SIM.least_ratio(a, b) >= TITLE_MIN_SIMILARITY) | (SIM.matching_ratio(a, b) >= TITLE_MIN_SIMILARITY)
    return pin(hits, enough=enough).where("enough").drop("enough")


def verify_titles(
    checks: DataFrame, works: DataFrame, log: DataFrame | None = None,
    dice: bool = False, cut=None,
) -> DataFrame:
    """Adds ``status`` to (doc_id, pos, title, year) rows.

    Verified when any hit is similar enough; a year within one of a hit's lowers the threshold.
    Equal titles are settled first by an equi-join, with ``cut`` most others by their likely hit (:func:`likely_hits`); only
    titles that are left open are searched for. Similarity is the matching-blocks ratio, in one expression, computed
    for pairs whose common characters (an upper bound of it) allow it, the hit with most shared words first; with ``dice`` it is
    Dice over character pairs. Per title only the outcome is kept, and the years for which it is near.
    """
    staged, cut = cut is not None, cut or (lambda df: df)
    titles = checks.where(F.col("title") != "").select(F.lower("title").alias("title")).distinct()
    same = titles.join(registry_titles(works).select(F.col("found").alias("title")), "title", "left_semi")
    rest = titles.join(same, "title", "left_anti")
    if staged:
        rest = cut(rest)
        same = cut(same.union(similar_enough(likely_hits(rest, works, cut), dice).select("title")))
        rest = rest.join(same, "title", "left_anti")
    hits = search_titles(
        rest, works, cut=cut, least_length_ratio=0.0 if dice else TITLE_MIN_SIMILARITY_SAME_YEAR)
    if dice:
        hits = pin(hits, a=SIM.bigrams(F.col("title")), b=SIM.bigrams(F.col("found")))
        scored = hits.withColumn("similarity", SIM.dice(F.col("a"), F.col("b")))
    else:
        bound = SIM.character_bound(F.col("title"), F.col("found"))
        possible = cut(pin(hits, bound=bound).where(F.col("bound") >= TITLE_MIN_SIMILARITY_SAME_YEAR))
        # most titles are settled by their likeliest hit: the others are compared only where it is not enough
        likeliest = possible.groupBy("title").agg(
            F.max_by(F.struct("found", "years"), F.struct("shared", "bound", "found")).alias("h")).select("title", "h.*")
        first = cut(pin(likeliest, similarity=SIM.matching_ratio(F.col("title"), F.col("found"))))
        settled = first.where(F.col("similarity") >= TITLE_MIN_SIMILARITY).select("title")
        rest = possible.join(settled, "title", "left_anti").select("title", "found", "years")
        rest = pin(rest, similarity=SIM.matching_ratio(F.col("title"), F.col("found")))
        scored = first.select("title", "years", "similarity").union(rest.select("title", "years", "similarity"))
    scored = cut(scored.where(F.col("similarity") >= TITLE_MIN_SIMILARITY_SAME_YEAR).select("title", "years", "similarity"))
    sure = same.union(scored.where(F.col("similarity") >= TITLE_MIN_SIMILARITY).select("title")).distinct()
    years = scored.select("title", F.explode("years").alias("w"))
    near = years.select(
        F.col("title").alias("key"), F.explode(F.array(F.col("w") - 1, F.col("w"), F.col("w") + 1)).alias("y")
    ).distinct().withColumn("near", F.lit(True))
    dim = sure.select(F.col("title").alias("key"), F.lit(True).alias("sure"))
    if log is not None:
        blocked = lookup_status(log.where(F.col("kind") == "title")).select(
            F.lower("id").alias("key"), (F.col("status") == "unreachable").alias("blocked")
        ).groupBy("key").agg(F.max("blocked").alias("blocked"))
        dim = dim.join(blocked, "key", "full_outer")
    else:
        dim = dim.withColumn("blocked", F.lit(False))
    keyed = checks.withColumn("key", F.lower("title")).withColumn("y", RF.year_number(F.col("year")))
    found = F.col("title") != ""
    # rows without a title can match nothing and stay out of the joins; a look-up keeps their number, so both count before the first
    named = keyed.where(found)

    def counts(*keys: str) -> DataFrame:
        return cut(named.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))

    rows = lookup_join(named, cut(dim), "key", counts=counts("key"))
    rows = lookup_join(rows, cut(near), ["key", "y"], counts=counts("key", "y"))
    status = (
        F.when(F.col("blocked"), "unreachable")
        .when(F.coalesce("sure", "near", F.lit(False)), "verified").otherwise("not_found")
    )
    done = rows.withColumn("status", status).select(*checks.columns, "status")
    return done.unionByName(checks.where(~found).withColumn("status", F.lit("not_found")))


# --- per document ------------------------------------------------------------

def sample_items(
    items: Column, dois: Column, verified: Column, sample: int | None = None, first: int | None = None
) -> Column:
    """Items to check by title: those without a verified DOI, all of them where there are no DOIs.

    ``sample`` takes an even spread of the former, ``first`` the first of the latter.
    """
    uncovered = F.filter(
        items, lambda it: ~F.exists(it["doi_hits"], lambda i: F.array_contains(verified, dois[i]))
    )
    sampled = let(uncovered, lambda u: RF.spread_sample(u, sample))
    chosen = F.when(F.size(dois) > 0, sampled).otherwise(first_n(items, first))
    return F.filter(chosen, lambda it: it["title"] != "")


def with_id_status(
    facts: DataFrame, known: DataFrame, log: DataFrame | None, max_arxiv: int | None = None,
    sample: int | None = None, first: int | None = None,
) -> DataFrame:
    """Facts with the looked-up statuses: verified / not_found / unreachable DOIs, arXiv count.

    ``checks`` are the items to look up by title. The limits are those of the functions used.
    """
    doi_ids = F.transform("dois", lambda d: F.struct(F.lit("doi").alias("kind"), d.alias("id")))
    arxiv_ids = F.transform(
        first_n(F.col("arxiv_ids"), max_arxiv),
        lambda a: F.struct(F.lit("arxiv").alias("kind"), a.alias("id")),
    )
    ids = facts.select(
        "doc_id", F.posexplode_outer(F.concat(doi_ids, arxiv_ids)).alias("pos", "x")
    ).where(F.col("pos").isNotNull()).select("doc_id", "pos", "x.kind", "x.id")
    checked = verify_ids(ids, known, log).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "kind", "id", "status"))).alias("checked")
    )

    def of(kind: str, status: str) -> Column:
        rows = F.filter(
            F.coalesce("checked", F.array().cast(
                "array<struct<pos:int,kind:string,id:string,status:string>>")),
            lambda c: (c["kind"] == kind) & (c["status"] == status),
        )
        return F.transform(rows, lambda c: c["id"])

    joined = pin(
        facts.join(checked, "doc_id", "left"),
        verified_dois=of("doi", "verified"), missing_dois=of("doi", "not_found"),
        blocked_dois=of("doi", "unreachable"), arxiv_verified=F.size(of("arxiv", "verified")),
    ).drop("checked")
    return pin(
        joined, checks=sample_items(
            F.col("items"), F.col("dois"), F.col("verified_dois"), sample, first)
    ).drop("items")


def title_checks(with_status: DataFrame) -> DataFrame:
    """(doc_id, pos, title, year): references to look up by title, ``pos`` their line."""
    rows = with_status.select("doc_id", F.explode_outer("checks").alias("c")).where(F.col("c").isNotNull())
    return rows.select("doc_id", "c.pos", "c.title", "c.year")


def outcome_counts(with_status: DataFrame, titles: DataFrame) -> DataFrame:
    """Adds the title outcomes of ``titles`` (doc_id, status) and the blended counters."""
    per_doc = titles.groupBy("doc_id").agg(
        *[F.count_if(F.col("status") == s).alias(f"t_{s}")
          for s in ("verified", "not_found", "unreachable")]
    )
    out = with_status.join(per_doc, "doc_id", "left")
    for s in ("verified", "not_found", "unreachable"):
        out = out.withColumn(f"t_{s}", F.coalesce(f"t_{s}", F.lit(0)))
    return (
        out.withColumn("t_checked", F.col("t_verified") + F.col("t_not_found") + F.col("t_unreachable"))
        .withColumn("verified", F.size("verified_dois") + F.col("t_verified"))
        .withColumn("not_found", F.size("missing_dois") + F.col("t_not_found"))
        .withColumn("unreachable", F.size("blocked_dois") + F.col("t_unreachable"))
    )


def _blend(score: Column, recency: Column) -> Column:
    return round_exact(F.lit(0.80) * score + F.lit(0.20) * recency, 1)


def _arxiv_ratio() -> Column:
    return F.when(F.size("arxiv_ids") > 0, F.col("arxiv_verified") / F.size("arxiv_ids"))


def _linear(ratio_of: Column) -> Column:
    return round_exact(F.col("verified") / ratio_of * 10.0, 1)


def throttled() -> Column:
    attempts = F.size("dois") + F.col("t_checked")
    return (F.size("dois") > 0) & (F.col("unreachable") == attempts)


def score_with_dois() -> Column:
    scorable = F.col("verified") + F.col("not_found")
    base = F.when(scorable > 0, _linear(scorable)).otherwise(NEUTRAL_SCORE)
    ratio = _arxiv_ratio()
    boosted = let(
        base,
        lambda b: F.when(ratio >= 0.7, F.least(b + 1.5, F.lit(10.0)))
        .when(ratio >= 0.4, F.least(b + 0.75, F.lit(10.0))).otherwise(b),
    )
    return F.when(throttled(), NEUTRAL_SCORE).otherwise(
        _blend(boosted, F.col("recency.recency_score"))
    )


def score_without_dois() -> Column:
    scorable = F.col("verified") + F.col("not_found")
    base = (
        F.when(scorable > 0, _linear(scorable))
        .when(F.col("unreachable") > 0, NEUTRAL_SCORE)
        .otherwise(3.0)
    )
    less = F.when(F.size("duplicates") > 0, F.greatest(base - 1.0, F.lit(0.0))).otherwise(base)
    boosted = F.when(_arxiv_ratio() >= 0.7, F.least(less + 1.0, F.lit(10.0))).otherwise(less)
    return F.least(_blend(boosted, F.col("recency.recency_score")), F.lit(NO_DOI_CAP))


def _s(col: Column) -> Column:
    return col.cast("string")


def _messages(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda m: m.isNotNull())


def issue_messages() -> Column:
    n_dois, n_missing = F.size("dois"), F.size("missing_dois")
    n_blocked, n_dup, n_arxiv = F.size("blocked_dois"), F.size("duplicates"), F.size("arxiv_ids")
    note = F.col("recency.recency_note")
    clean = (n_missing == 0) & (n_dup == 0) & (n_blocked == 0)
    duplicates = F.when(n_dup > 0, F.concat(_s(n_dup), F.lit(" duplicate reference(s) detected.")))
    with_dois = _messages(
        F.when(n_missing > 0, F.concat(_s(n_missing), F.lit(" of "), _s(n_dois), F.lit(
            " DOI(s) could not be verified (not found in CrossRef)."))),
        F.when(F.col("t_checked") > 0, F.concat(
            F.lit("Title fallback: "), _s(F.col("t_verified")), F.lit("/"), _s(F.col("t_checked")),
            F.lit(" reference(s) verified via Semantic Scholar."))),
        F.when(n_arxiv > 0, F.concat(_s(F.col("arxiv_verified")), F.lit("/"), _s(n_arxiv),
                                     F.lit(" ArXiv preprint reference(s) verified."))),
        duplicates,
        F.when(n_blocked > 0, F.concat(_s(n_blocked), F.lit(" of "), _s(n_dois), F.lit(
            " DOI(s) were unreachable during validation."))),
        note,
        F.when(clean, F.concat(F.lit("All "), _s(n_dois), F.lit(" DOI(s) verified successfully."))),
    )
    without = _messages(
        F.lit("No DOIs found in references section."),
        F.when(F.col("t_checked") > 0, F.concat(
            F.lit("Title verification: "), _s(F.col("t_verified")), F.lit("/"),
            _s(F.col("t_checked")), F.lit(" references verified via Semantic Scholar.")))
        .otherwise(F.concat(F.lit("Could not extract titles from "), _s(F.col("total_refs")),
                            F.lit(" reference entries for verification."))),
        F.when(F.col("unreachable") > 0, F.concat(_s(F.col("unreachable")), F.lit(
            " reference(s) unreachable during verification (excluded from score)."))),
        duplicates,
        F.when(n_arxiv > 0, F.concat(_s(F.col("arxiv_verified")), F.lit("/"), _s(n_arxiv),
                                     F.lit(" ArXiv reference(s) verified."))),
        note,
    )
    return (
        F.when(F.col("blank"), F.array(F.lit("No references section found in document.")))
        .when(n_dois == 0, without)
        .when(throttled(), F.array(F.lit(
            "Citation verification throttled — all DOIs unreachable. Neutral score applied.")))
        .otherwise(with_dois)
    )


def suggestion_messages() -> Column:
    some = _messages(
        F.when(F.size("missing_dois") > 0, F.lit(
            "Check flagged DOIs for typos or confirm they are published in indexed journals.")),
        F.when(F.size("duplicates") > 0, F.lit(
            "Remove duplicate entries and ensure consistent formatting.")),
        F.when(F.size("blocked_dois") > 0, F.lit(
            "Retry the analysis to attempt validation of unreachable DOIs.")),
    )
    return (
        F.when(F.col("blank"), F.array(F.lit(
            "Add a References section with properly formatted citations including DOIs.")))
        .when(F.size("dois") == 0, F.array(
            F.lit("Include DOIs for all cited works to improve citation verifiability."),
            F.lit("Papers with verifiable DOIs receive higher citation scores.")))
        .when(throttled(), F.array(F.lit("Retry the analysis when API demand is lower.")))
        .when(F.size(some) > 0, some)
        .otherwise(F.array(F.lit("No citation issues found.")))
    )


def flagged_items() -> Column:
    """Missing DOIs with their citation, then repeated references."""
    missing = F.transform(
        F.filter(
            F.arrays_zip("dois", "doi_labels"),
            lambda z: F.array_contains(F.col("missing_dois"), z["dois"]),
        ),
        lambda z: F.struct(
            z["doi_labels"].alias("citation"), F.lit("not_found").alias("category"),
            F.lit(NOT_FOUND_DETAIL).alias("detail"),
        ),
    )
    repeated = F.transform(
        "duplicates",
        lambda d: F.struct(
            d.alias("citation"), F.lit("duplicate").alias("category"),
            F.lit(DUPLICATE_DETAIL).alias("detail"),
        ),
    )
    nothing = F.slice(missing, 1, 0)
    return F.when(throttled(), nothing).otherwise(F.concat(missing, repeated))


def citation_results(counted: DataFrame) -> DataFrame:
    """One citation result per document from the counted facts."""
    # blank lists have neither DOIs nor titles, so only their score and texts differ
    cleared = throttled()
    return counted.select(
        "doc_id",
        F.when(F.col("blank"), 0.0)
        .when(F.size("dois") == 0, score_without_dois())
        .otherwise(score_with_dois()).alias("score"),
        "total_refs",
        F.when(cleared, 0).otherwise(F.col("verified")).cast("int").alias("verified"),
        F.when(cleared, 0).otherwise(F.col("not_found")).cast("int").alias("not_found"),
        F.col("unreachable").cast("int").alias("unreachable"),
        F.col("arxiv_verified").cast("int").alias("arxiv_verified"),
        F.when(cleared, empty_strings()).otherwise(F.col("missing_dois")).alias("flagged_dois"),
        flagged_items().alias("flagged_items"),
        "recency",
        issue_messages().alias("issues"),
        suggestion_messages().alias("suggestions"),
    )


def check_citations(
    facts: DataFrame, works: DataFrame, preprints: DataFrame, log: DataFrame | None = None,
    dice: bool = False, cut=None,
) -> DataFrame:
    """Citation result per document from :func:`reference_facts`.

    ``cut`` may materialise the frame that the title check and the score both read, the outcomes of titles, and the
    counters: as one plan, what follows the title search takes the driver more memory than any other.
    """
    staged, cut = cut, cut or (lambda df: df)
    with_status = cut(with_id_status(facts, registry(works, preprints), log))
    titles = verify_titles(title_checks(with_status), works, log, dice=dice, cut=staged)
    titles = cut(titles.select("doc_id", "status"))
    return citation_results(cut(outcome_counts(with_status, titles)))


def citation_summary(results: DataFrame) -> DataFrame:
    """Unverified references and success percentages as report (floor) and dashboard (half up)."""
    rate = F.col("verified") / F.col("total_refs") * 100.0
    any_refs = F.col("total_refs") > 0
    return results.select(
        "doc_id", "total_refs", "verified",
        (F.col("not_found") + F.col("unreachable")).alias("unverified"),
        F.when(any_refs, F.floor(rate)).otherwise(0).cast("int").alias("success_pct"),
        F.when(any_refs, F.floor(F.col("verified") / F.col("total_refs") * 100.0 + 0.5)).otherwise(0)
        .cast("int").alias("rate_pct"),
    )
