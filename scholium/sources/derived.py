"""Paper corpora derived from the given tables.

The given documents are prose without headings, references or identifiers. These expressions
turn every document into a paper (its whole text is the introduction) and derive registries,
look-up logs, reviews and batch results from the same ids. One template is rendered for Spark
and for DuckDB, so both engines read equal inputs and nothing is stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from scholium.constants import STALE_FALLBACK_ISSUE
from scholium.sources.readers import spread
from scholium.sources.shared import give_back, materialize

NL = "chr(10)"


@dataclass(frozen=True)
class Dialect:
    name: str

    def pick(self, values: list[str], index: str) -> str:
        items = ", ".join(f"'{v}'" for v in values)
        if self.name == "spark":
            return f"element_at(array({items}), cast(({index}) % {len(values)} AS INT) + 1)"
        return f"list_extract([{items}], ({index}) % {len(values)} + 1)"

    def join_range(self, count: str, body: str, sep: str = NL) -> str:
        """Joined strings of ``body`` for i = 1..count (count >= 1)."""
        if self.name == "spark":
            return f"array_join(transform(sequence(1, cast({count} AS INT)), i -> {body}), {sep})"
        return f"array_to_string(list_transform(range(1, ({count}) + 1), lambda i: {body}), {sep})"

    def explode_range(self, count: str) -> str:
        if self.name == "spark":
            return f"explode(sequence(1, cast({count} AS INT)))"
        return f"unnest(range(1, ({count}) + 1))"


SPARK, DUCKDB = Dialect("spark"), Dialect("duckdb")

ADJ = ["Adaptive", "Spectral", "Robust", "Sparse", "Hybrid", "Causal", "Latent", "Neural",
       "Modular", "Dynamic", "Bayesian"]
HEADS = ["lum", "tar", "vex", "mor", "sil", "gran", "pol", "quen", "dra", "fen", "hox"]
MIDDLES = ["ora", "iva", "edu", "ano", "isk", "ulo", "emi", "aru", "oti", "uze", "ebo", "yma", "ilo"]
TAILS = ["tron", "gen", "form", "net", "path", "cast", "mark", "field", "scope", "wave", "graph",
         "plex", "node", "span", "core", "type", "band"]
OBJ = ["climate", "traffic", "genome", "language", "vision", "energy", "supply", "quantum",
       "epidemic", "speech", "urban", "marine", "financial", "robotic", "social", "clinical",
       "historical"]
DISCIPLINES = ["computer_science", "mathematics", "physics", "chemistry", "medicine_biology",
               "humanities_social", "other", "astrology"]


def s(x: str) -> str:
    return f"cast({x} AS STRING)"


def doi(w: str) -> str:
    plain = f"'10.' || {s(f'1000 + ({w}) % 9000')} || '/w.' || {s(w)}"
    round_ = f"'10.' || {s(f'1000 + ({w}) % 9000')} || '/w(' || {s(w)} || ')'"
    return f"(CASE WHEN ({w}) % 10 = 4 THEN {round_} ELSE {plain} END)"


def title(D: Dialect, w: str) -> str:
    """Common words and three composed rarer ones; works that share the first are near titles."""
    first = f"{D.pick(HEADS, w)} || {D.pick(MIDDLES, w)} || 'ine'"
    second = f"{D.pick(MIDDLES[:7], w)} || {D.pick(TAILS, w)}"
    third = f"{D.pick(HEADS + TAILS[:8], w)} || {D.pick(TAILS + MIDDLES[:6], w)} || 'al'"
    return (f"({D.pick(ADJ, w)} || ' ' || {first} || ' ' || {second} || ' for ' || {third} || ' systems')")


def year(w: str) -> str:
    return f"(1995 + ({w}) % 28)"


def arxiv(w: str) -> str:
    return f"({s(f'1000 + ({w}) % 9000')} || '.' || lpad({s(f'({w}) % 100000')}, 5, '0'))"


def _reference(D: Dialect) -> str:
    """Reference line i of document d; a few entries are repeated, perturbed or have no id."""
    j = "(CASE WHEN doc_id % 9 = 5 AND i = 3 THEN 2 ELSE i END)"
    w = f"(CASE WHEN {j} = 1 AND doc_id % 3 = 0 THEN 1 ELSE doc_id + ({j} - 1) * 3 END)"
    num = f"'[' || {s(j)} || '] '"
    t = title(D, w)
    said = (f"(CASE doc_id % 5 WHEN 1 THEN {t} || ' revisited' "
            f"WHEN 2 THEN 'On ' || {t} || ' and beyond' "
            f"WHEN 3 THEN 'Unknown essay about nothing in particular' ELSE {t} END)")
    y = f"{s(f'{year(w)} + (CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END)')}"
    kind = f"(CASE WHEN doc_id % 7 = 4 THEN 3 + ({j} % 2) ELSE (doc_id + {j}) % 6 END)"
    lines = [
        f"{num} || 'Smith, J. (' || {y} || '). ' || {said} || '. Journal of Testing, 1(2), 3-9. DOI: ' || {doi(w)}",
        f"{num} || 'Brown, K. (' || {y} || '). \"' || {said} || '.\" Conf B, 1-10. https://doi.org/' || {doi(w)} || '.'",
        f"{s(j)} || '. Lee, M. et al. (' || {y} || '). ' || {said} || '. Proceedings. (' || {doi(w)} || ')'",
        f"{num} || 'Green, P., ' || {y} || '. ' || {said} || '. Venue, 4(1).'",
        f"{num} || 'Grey & Partners (' || {y} || '). ' || {said} || '. arXiv preprint arXiv:' || {arxiv(w)}",
        f"{num} || 'Short ' || {y}",
    ]
    cases = " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(lines))
    blocked = (f"{num} || 'anonymous entry, no name given, doi:' || {doi('11 * (doc_id + i) + 3')}")
    many = (f"{num} || 'Many, A. (2020). ' || {t} || '. DOI: ' || {doi('doc_id * 2 + i')}")
    return (f"(CASE WHEN doc_id % 31 = 8 THEN {blocked} WHEN doc_id % 50 = 0 THEN {many} "
            f"ELSE CASE {kind} {cases} END END)")


def paper_text(D: Dialect) -> str:
    """SQL expression over (doc_id, text) for the paper text."""
    def para(*parts: str) -> str:
        return " || ".join(parts) + f" || {NL}"

    def when(cond: str, expr: str) -> str:
        return f"(CASE WHEN {cond} THEN {expr} ELSE '' END)"

    topic = D.pick(OBJ, "doc_id")
    head = para(
        f"'Paper ' || {s('doc_id')} || ' on ' || {topic}", NL,
        f"(CASE doc_id % 9 WHEN 3 THEN 'No date given.' "
        f"WHEN 4 THEN 'Drafts of 2010 and 2012.' "
        f"ELSE 'Submitted ' || {s('2004 + doc_id % 20')} || ', revised ' || {s('2004 + doc_id % 20')} || '. See 1998.' END)",
    )
    abstract = when("doc_id % 10 <> 7", para(
        D.pick(["# Abstract", "ABSTRACT", "Abstract—", "**Abstract**", "Abstract:"], "doc_id"), NL,
        f"'We study ' || {topic} || ' data [1].   The gain is ' || {s('doc_id % 40')} || ' percent.'",
    ))
    intro = para(
        D.pick(["## 1 Introduction", "1. Introduction", "I. INTRODUCTION", "INTRODUCTION"], "doc_id"), NL,
        "text", NL,
        "'In this paper, we propose a careful reading. It is worth noting that models differ [1, 2-5]. "
        "In recent years, tools matured (Smith et al., 2020). See https://example.org/repo now. "
        "Models were tuned by hand. Models were tuned by hand. See Figure 2 for the plan.'",
    )
    related = when("doc_id % 3 <> 0", para(
        D.pick(["## 2 Related Work", "2 Background", "LITERATURE REVIEW"], "doc_id"), NL,
        "'As mentioned above, prior studies exist (Jones, 2019a). As shown in Table 1, they agree [7]. "
        "There is a growing interest in the field. Over the past few years, it grew.'",
    ))
    method = when("doc_id % 11 <> 5", para(
        D.pick(["## 3 Proposed Method", "3.1 Model Architecture", "METHODS", "Materials and Methods"], "doc_id"),
        "(CASE doc_id % 6 WHEN 1 THEN chr(13) || chr(10) WHEN 2 THEN chr(12) ELSE chr(10) END)",
        f"'We use   ' || {s('100 + doc_id % 900')} || ' samples. The model is trained twice.'",
    ))
    results = when("doc_id % 4 <> 3", para(
        D.pick(["## 4 Results", "4 Experiments", "EVALUATION", "Findings"], "doc_id"), NL,
        f"'The method reaches ' || {s('50 + doc_id % 50')} || ' percent. As shown in Table 3, it holds.'", NL,
        f"'Figure ' || {s('1 + doc_id % 3')} || ': Accuracy of the ' || {topic} || ' study over all runs.'", NL,
        "'Table 2. Error of every baseline on the held out part'", NL,
        "'= 12 + 34 / 56'", NL,
        f"'Figure ' || {s('1 + doc_id % 3')} || ': Accuracy of the ' || {topic} || ' study over all runs.'", NL,
        "'The method holds up well. The method holds up well. ^1 done (see Table 4) and ^{1,2} too.'",
    ))
    discussion = when("doc_id % 5 <> 2", para(
        D.pick(["## 5 Discussion", "Analysis", "DISCUSSION"], "doc_id"), NL,
        "'In summary, we find support. Shown in Figure 3 is the trend [3; 4]. To the best of our knowledge, this is new. "
        "(see Fig. 5) The trend is stable. The trend is stable.'",
    ))
    conclusion = when("doc_id % 10 <> 3", para(
        D.pick(["# Conclusion", "SUMMARY", "6 Closing Remarks"], "doc_id"), NL,
        "'The study ends here. More data would help.'",
    ))
    stops = (
        when("doc_id % 7 = 2", para("'Acknowledgements'", NL, "'We thank many people.'"))
        + " || " + when("doc_id % 7 = 3", para("'# Funding'", NL, "'Paid by a grant.'"))
    )
    count = "(CASE WHEN doc_id % 50 = 0 THEN 30 ELSE 3 + doc_id % 9 END)"
    refs = when("doc_id % 13 <> 6", para(
        D.pick(["# References", "REFERENCES", "Bibliography", "Works Cited"], "doc_id"), NL,
        when("doc_id % 6 = 4", "'Grant office, Funding of small science 2011' || " + NL),
        D.join_range(count, _reference(D)),
    ))
    tail = (
        when("doc_id % 8 = 5", para("'# Appendix'", NL, "'Extra proofs follow here.'"))
        + " || " + when("doc_id % 8 = 6", para("'APPENDIX B'", NL, "'B.1 more tables'"))
    )
    full = " || ".join([head, abstract, intro, related, method, results, discussion, conclusion,
                        stops, refs, tail])
    sparse = para(
        head, "'OVERVIEW'", NL, f"'A short view of ' || {topic} || ' practice.'", NL,
        "'2 Pre-Training'", NL, "text", NL, "'plain sub heading'", NL, "'It goes on.'", NL,
        "'IV. Limits'", NL, "'Some limits remain.'", NL, "'# Thanks To All'", NL, "'Names.'", NL,
        D.pick(["# References", "SOURCES", "Bibliography: ", "## Findings"], "doc_id"), NL,
        D.join_range("3", _reference(D)),
    )
    return f"(CASE WHEN doc_id % 14 = 9 THEN {sparse} ELSE {full} END)"


def papers_sql(D: Dialect) -> str:
    return f"SELECT doc_id, {paper_text(D)} AS text FROM documents"


HEADING_MAP_ROWS = [
    ("OVERVIEW", "abstract"), ("2 Pre-Training", "methodology"), ("IV. Limits", "discussion"),
    ("# Thanks To All", "none"), ("SOURCES", "references"), ("## Findings", "results"),
    ("# References", "references"), ("INTRODUCTION", "introduction"), ("METHODS", "bogus"),
]


def heading_map_sql(D: Dialect) -> str:
    rows = ", ".join(f"('{h}', '{k}')" for h, k in HEADING_MAP_ROWS)
    return f"SELECT heading, section FROM (VALUES {rows}) AS t(heading, section)"


def works_sql(D: Dialect) -> str:
    return (f"SELECT {doi('doc_id')} AS doi, {title(D, 'doc_id')} AS title, {year('doc_id')} AS year "
            "FROM documents WHERE doc_id % 5 <> 0")


def preprints_sql(D: Dialect) -> str:
    return f"SELECT {arxiv('doc_id')} AS arxiv_id FROM documents WHERE doc_id % 4 <> 0"


def lookup_log_sql(D: Dialect) -> str:
    d = doi("doc_id")
    blocked = doi("11 * doc_id + 3")
    t = title(D, "doc_id")
    parts = [
        ("doi", d, 1, "429", "doc_id % 11 = 3"), ("doi", d, 2, "503", "doc_id % 11 = 3"),
        ("doi", d, 1, "503", "doc_id % 11 = 4"), ("doi", d, 2, "200", "doc_id % 11 = 4"),
        ("doi", d, 1, "404", "doc_id % 11 = 5"),
        ("doi", d, 1, "NULL", "doc_id % 11 = 6"), ("doi", d, 2, "NULL", "doc_id % 11 = 6"),
        ("doi", d, 1, "500", "doc_id % 11 = 7"), ("doi", d, 2, "200", "doc_id % 11 = 7"),
        ("doi", blocked, 1, "429", "doc_id % 11 <> 3"), ("doi", blocked, 2, "429", "doc_id % 11 <> 3"),
        ("arxiv", arxiv("doc_id"), 1, "500", "doc_id % 10 = 9"),
        ("title", t, 1, "503", "doc_id % 12 = 7"),
    ]
    return " UNION ALL ".join(
        f"SELECT '{k}' AS kind, {i} AS id, {a} AS attempt, cast({st} AS INT) AS http_status "
        f"FROM documents WHERE {cond}" for k, i, a, st, cond in parts
    )


def feed_sql(D: Dialect) -> str:
    return (f"SELECT 'http://arxiv.org/abs/' || {arxiv('doc_id')} || 'v' || {s('1 + doc_id % 3')} AS id, "
            f"' ' || {title(D, 'doc_id')} || chr(10) || '   of  note' AS title, "
            f"CASE WHEN doc_id % 4 <> 1 THEN 'https://arxiv.org/pdf/' || {arxiv('doc_id')} || 'v9' END AS href FROM documents")


def links_sql(D: Dialect) -> str:
    other = doi("doc_id + 2")
    rows = [
        (0, f"'https://example.org/' || {s('doc_id')}", "doc_id % 2 = 0"),
        (1, f"'https://doi.org/' || {other} || '.'", "doc_id % 4 = 2"),
        (2, f"'https://publisher.example/x?doi=' || {doi('doc_id')} || '>more'", "doc_id % 4 <> 1"),
        (3, f"'http://dx.doi.org/' || {other}", "doc_id % 4 = 2"),
    ]
    return " UNION ALL ".join(
        f"SELECT doc_id, {n} AS link_no, {uri} AS uri FROM documents WHERE {cond}" for n, uri, cond in rows)


def review_json(D: Dialect) -> str:
    def layer(name: str, k: int) -> str:
        score = s(f"(doc_id * {k} + {k}) % 12")
        return (f"'\"{name}\":{{\"score\":' || {score} || ',\"issues\":[\"{name} issue ' || {s('doc_id % 7')} "
                f"|| '\",\"second\"],\"suggestions\":[\"fix {name}\"]}}'")

    evidence = (
        "(CASE doc_id % 17 WHEN 2 THEN '\"evidence_claims\":{\"score\":6}' "
        "WHEN 3 THEN '\"evidence_claims\":null' "
        "WHEN 4 THEN '\"other\":1' "
        "WHEN 6 THEN '\"evidence_claims\":{\"score\":\"8\",\"issues\":[\"late\"],\"analysis_failed\":true}' ELSE " + layer("evidence_claims", 7) + " END)"
    )
    disc = f"(CASE WHEN doc_id % 19 = 5 THEN '' ELSE ',\"discipline\":\"' || {D.pick(DISCIPLINES, 'doc_id')} || '\"' END)"
    zero = "'{\"score\":0,\"issues\":[\"none\"],\"suggestions\":[\"none\"]}'"
    flat = " || ',' || ".join(
        f"'\"{n}\":' || {zero}"
        for n in ["structure_sections", "clarity_writing", "methodology_rigor", "evidence_claims"])
    body = (f"'{{' || {layer('structure_sections', 1)} || ',' || {layer('clarity_writing', 3)} || ',' || "
            f"{layer('methodology_rigor', 5)} || ',' || {evidence} || {disc} || '}}'")
    return (f"(CASE WHEN doc_id % 13 = 0 THEN '{{\"structure_sections\": {{\"score\": ' "
            f"WHEN doc_id % 23 = 1 THEN '{{' || {flat} || ',\"discipline\":\"physics\"}}' ELSE {body} END)")


def reviews_sql(D: Dialect) -> str:
    return f"SELECT doc_id, {review_json(D)} AS review_json FROM documents"


def candidates_sql(D: Dialect) -> str:
    return (f"SELECT 'q' || {s('doc_id - doc_id % 5')} AS name, doc_id % 5 AS priority, "
            f"{arxiv('doc_id')} AS arxiv_id, {title(D, 'doc_id')} AS title, "
            "doc_id % 7 IN (1, 4) AS available FROM documents")


def fallback_sql(D: Dialect) -> str:
    return (f"SELECT 'q' || {s('doc_id')} AS name, {arxiv('doc_id * 3')} AS arxiv_id, "
            f"{title(D, 'doc_id * 3')} AS title, doc_id % 9 <> 0 AS available "
            "FROM documents WHERE doc_id % 5 = 0")


def response_json(D: Dialect) -> str:
    def layer(name: str, k: int) -> str:
        score = s(f"1 + (doc_id * {k}) % 9")
        return (f"'\"{name}\":{{\"score\":' || {score} || "
                f"'.0,\"issues\":[\"i {name}\"],\"suggestions\":[\"s\"]}}'")

    m = "doc_id % 10"
    name = "'\"filename\":\"p' || " + s("doc_id") + " || '.pdf\",'"
    filename = f"(CASE WHEN {m} = 1 THEN '' ELSE {name} END)"
    shown = ("(CASE doc_id % 3 WHEN 0 THEN '\"Abstract\":90,\"Methods\":88,\"Results\":84,\"References\":95' "
             "WHEN 1 THEN '\"Abstract\":90,\"Introduction\":81,\"References\":95' "
             "ELSE '\"Odd\":80,\"Methods\":83' END)")
    high = f"(CASE WHEN {m} = 3 THEN '12.5' ELSE '6.5' END)"
    low = f"(CASE WHEN {m} = 5 THEN '0.0' ELSE '5.5' END)"
    scores = (f"'\"layer_scores\":{{\"structure_sections\":' || {high} || "
              f"',\"clarity_writing\":7.0,\"methodology_rigor\":' || {low} || "
              f"',\"evidence_claims\":8.0,\"citations\":' || {s('doc_id % 7')} || '.5}},'")
    structure = (f"(CASE WHEN {m} = 4 THEN "
                 "'\"structure_sections\":{\"score\":5.0,\"issues\":[],\"suggestions\":[\"s\"]}' "
                 f"ELSE {layer('structure_sections', 2)} END)")
    method = (f"(CASE WHEN {m} = 5 THEN '\"methodology_rigor\":{{\"score\":0.0,\"issues\":[\""
              f"{STALE_FALLBACK_ISSUE}\"],\"suggestions\":[\"s\"]}}' "
              f"WHEN {m} = 6 THEN '\"methodology_rigor\":{{\"score\":0.0,\"issues\":[\"x\"],"
              "\"suggestions\":[\"s\"],\"analysis_failed\":true}' "
              f"ELSE {layer('methodology_rigor', 4)} END)")
    cites = f"(CASE WHEN {m} = 4 THEN '' ELSE ',' || {layer('citations', 7)} END)"
    details = (f"'\"layer_details\":{{' || {structure} || ',' || {layer('clarity_writing', 3)} || ',' || "
               f"{method} || ',' || {layer('evidence_claims', 5)} || {cites} || '}},'")
    final = f"(CASE WHEN doc_id % 20 = 16 THEN '120.5' ELSE {s('doc_id % 100')} || '.5' END)"
    grade = f"(CASE WHEN {m} = 2 THEN 'Z' ELSE {D.pick(['A — Excellent', 'B — Good', 'F — Very Poor'], 'doc_id')} END)"
    refs = f"(CASE WHEN {m} IN (6, 7) THEN '0' ELSE {s('5 + doc_id % 30')} END)"
    verified = f"(CASE WHEN {m} IN (7, 8) THEN '0' ELSE '4' END)"
    flagged = "(CASE WHEN doc_id % 4 = 0 THEN '' ELSE '\"10.1/x\"' END)"
    return (f"(CASE WHEN {m} = 0 THEN NULL ELSE '{{' || {filename} || '\"detected_sections\":{{' || {shown} || "
            f"'}},\"section_count\":3,\"warnings\":[],' || {scores} || {details} || '\"final_score\":' || {final} || "
            f"',\"grade\":\"' || {grade} || '\",\"citation_result\":{{\"total_refs\":' || {refs} || "
            f"',\"verified\":' || {verified} || ',\"not_found\":1,\"unreachable\":0,\"flagged_dois\":[' || {flagged} || "
            "'],\"flagged_items\":[]}}' END)")


def results_sql(D: Dialect) -> str:
    return (f"SELECT 'paper_' || {s('doc_id')} AS paper, 'Title ' || {s('doc_id')} AS title, "
            f"{D.pick(['cs', 'bio', 'physics'], 'doc_id')} AS category, "
            "CASE WHEN doc_id % 10 = 0 THEN 503 ELSE 200 END AS analyze_status, "
            "(doc_id % 50) * 100 AS analyze_time_ms, "
            "CASE WHEN doc_id % 25 = 7 THEN NULL WHEN doc_id % 25 = 8 THEN 1200 ELSE 10000 END AS report_size_bytes, "
            f"CASE WHEN doc_id % 20 = 0 THEN 'timeout' END AS error, {response_json(D)} AS response_json FROM documents")


def meta_sql(D: Dialect) -> str:
    """Expected sections as one comma-separated string."""
    sections = D.pick(["abstract,methodology,references", "abstract,introduction,references",
                       "abstract,results"], "doc_id + doc_id % 2")
    return (f"SELECT 'paper_' || {s('doc_id')} AS paper, {sections} AS expected, doc_id % 3 <> 1 AS has_dois, "
            "cast(CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 3 ELSE 25 END AS INT) AS expected_ref_count "
            "FROM documents WHERE doc_id % 15 <> 2")


_TABLES: dict = {}


def load(
    spark: SparkSession, sf_dir: str, sql, tables: tuple[str, ...] = ("documents",),
    spread_key: str | None = None,
) -> DataFrame:
    """A derived table in Spark; only the named given tables are read.

    The derivation is test input, not part of any operator, so each derived table is written
    once per session to the shared folder: its long expressions would otherwise be planned and
    run again inside every query. What the driver needed for them is given back.
    """
    key = (spark.sparkContext.applicationId, sf_dir, sql.__name__)
    if key not in _TABLES:
        df = _load(spark, sf_dir, sql, tables)
        if spread_key:
            df = spread(df, spread_key)
        _TABLES[key] = materialize(df)
        give_back(spark)
    return _TABLES[key]


#: The parser drops its states after a text that took more of them.
_PARSER = {"spark.sql.parser.manageParserCaches": "true", "spark.sql.parser.parserDfaCacheFlushThreshold": "1000"}


@contextmanager
def parsed_once(spark: SparkSession) -> Iterator[None]:
    """The parser keeps nothing of a text that is parsed once; it keeps over 100 MB of the longest one otherwise."""
    before = {k: spark.conf.get(k, None) for k in _PARSER}
    for k, v in _PARSER.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _load(spark: SparkSession, sf_dir: str, sql, tables: tuple[str, ...]) -> DataFrame:
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    text = sql(SPARK)
    for name in frames:
        text = text.replace(f"FROM {name}", "FROM {" + name + "}")
    with parsed_once(spark):
        return spark.sql(_escape(text, frames), **frames)


def _escape(text: str, frames: dict) -> str:
    """Double the braces of JSON literals, keep the table placeholders."""
    out = text.replace("{", "{{").replace("}", "}}")
    for name in frames:
        out = out.replace("{{" + name + "}}", "{" + name + "}")
    return out
