"""DuckDB SQL for the registered queries.

Written independently of the Spark side where the two differ in method: sections are segmented
here with window functions over lines, lists are de-duplicated with row numbers, and so on.
Named sub-queries are put together by :func:`with_ctes`.
"""

from __future__ import annotations

import re

from scholium import constants as C
from scholium.functions.text import LINE_BREAKS, WS_CHARS, uni
from scholium.sources import derived as D

DD = D.DUCKDB
CTES: dict[str, str] = {}
ORACLES: dict[str, str] = {}
OVERRIDES: dict[str, dict[str, str]] = {}


# Patterns of headings and references, written here for DuckDB's engine and not taken from the library.
GAP, INK, NUM = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]", r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]", r"\p{Nd}"
HEADING_MARKS = f"^#{{1,4}}{GAP}*"
LEADING_NUMBER = rf"^{NUM}+\.?{NUM}*\.?{GAP}*"
LEADING_ROMAN = rf"^[IVX]+\.?{GAP}+"
TRAILING_MARKS = r"(?:—|–|:|-|\.)+\z"
LIST_ENTRY = rf"^(?:\[{NUM}+\]|{NUM}+\.){GAP}+[A-Z][a-z]"
NUMBERED_LINE = rf"^(?:[IVX]|{NUM})+\.?{NUM}*\.?{GAP}+[A-Z]"
LETTERED_LINE = rf"^[a-z](?:\.{NUM}+)*{GAP}"
DIGIT_LIKE = "[\\p{Nd}²³¹⁰⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉]"
TOP_HASH, TOP_NUMBER, TOP_ROMAN = f"^##?{GAP}+", f"^{NUM}{NUM}?{GAP}+[A-Z]", rf"^[IVX]{{1,5}}\.{GAP}+[A-Z]"
ARXIV = rf"(?i)(?:arXiv{GAP}*(?:preprint{GAP}*arXiv)?{GAP}*:|arxiv\.org/(?:abs|pdf)/)({NUM}{{4}}\.{NUM}{{4}}{NUM}?)"
DOI_LABELLED = rf"(?i)(?:doi\.org/|doi:{GAP}*)(10\.{NUM}{{4,}}/{INK}+)"
NOT_IN_DOI = r"\s\x0b\x1c-\x1f\x{85}\p{Z},;)\]>'\"`‘’“”"
DOI_STANDALONE = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(10\.{NUM}{{4,9}}/[^{NOT_IN_DOI}]+)"
DOI_OF_LINK = rf"(10\.{NUM}{{4,9}}/[^\s\x0b\x1c-\x1f\x{{85}}\p{{Z}},;)\]>'\"]+)"
DOI_ENDS = r"[.,;:>'\"`\\\-‘’“”]+\z"
ENTRY_NUMBER = rf"\A{GAP}*(?:\[{NUM}+\]|\({NUM}+\)|{NUM}+[.)]){GAP}*"
QUOTED = "[\"“]([^\\n]+?)[\"”]"
AFTER_PARENS = rf"\({NUM}{{4}}\)\.?{GAP}*([^\n]+?)\."
AFTER_BARE_YEAR = rf"{NUM}{{4}}[.,]{GAP}*([^\n]+?)\."
AUTHOR_YEAR = rf"\A([A-Z][a-z]+(?:{GAP}+(?:et{GAP}+al\.?|&{GAP}+[\p{{L}}\p{{N}}_]+))?[^\n]*?{NUM}{{4}})"
LINK_TARGET = 'href="([^"]*)"'


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def with_ctes(body: str, overrides: dict[str, str] | None = None) -> str:
    """Prepend every named sub-query that ``body`` uses, in definition order."""
    ctes = {**CTES, **(overrides or {})}
    needed, frontier = set(), [body]
    while frontier:
        text = frontier.pop()
        for name, sql in ctes.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                frontier.append(sql)
    heads = [f"{n} AS (\n{ctes[n]}\n)" for n in ctes if n in needed]
    return ("WITH " + ",\n".join(heads) + "\n" if heads else "") + body


def build_all() -> dict[str, str]:
    return {name: with_ctes(sql, OVERRIDES.get(name)) for name, sql in ORACLES.items()}


def sub(col: str, pattern: str, repl: str = "", flags: str = "g") -> str:
    return f"regexp_replace({col}, {q(pattern)}, {q(repl)}, '{flags}')"


def has(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q(pattern)})"


def strip(col: str) -> str:
    return f"trim({col}, {q(WS_CHARS)})"


def is_upper(col: str) -> str:
    return f"(upper({col}) = {col} AND lower({col}) <> {col})"


def split_lines(col: str) -> str:
    body = f"regexp_replace(regexp_replace({col}, {q(LINE_BREAKS)}, chr(10), 'g'), '\\n\\z', '')"
    return f"(CASE WHEN {col} = '' THEN []::VARCHAR[] ELSE string_split({body}, chr(10)) END)"


def clean_heading(col: str) -> str:
    x = sub(strip(col), HEADING_MARKS)
    x = sub(sub(f"replace({x}, '**', '')", LEADING_NUMBER), LEADING_ROMAN)
    return f"lower({strip(sub(x, TRAILING_MARKS))})"


def is_heading(x: str) -> str:
    """On a stripped line."""
    return (f"(CASE WHEN {x} = '' THEN false WHEN starts_with({x}, '#') THEN true "
            f"WHEN {has(x, LIST_ENTRY)} THEN false "
            f"WHEN length({x}) >= 3 AND {is_upper(x)} AND NOT {has(x, DIGIT_LIKE)} THEN true "
            f"WHEN {has(x, NUMBERED_LINE)} THEN true "
            f"ELSE length({x}) < 80 AND NOT ends_with({x}, '.') AND NOT starts_with({x}, '|') END)")


def any_of(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


SECTION_CASE = "CASE " + " ".join(
    f"WHEN {any_of('clean', words)} THEN {q(key)}" for key, _, words in C.SECTIONS) + " END"
ORD = {k: i for i, k in enumerate(C.SECTION_KEYS)}
SECTION_VALUES = ", ".join(f"({i}, {q(k)})" for k, i in ORD.items())

CTES["papers"] = D.papers_sql(DD)
CTES["heading_map"] = D.heading_map_sql(DD)
CTES["section_dim"] = f"SELECT * FROM (VALUES {SECTION_VALUES}) AS t(ord, section)"


def lines_of(table: str) -> str:
    return (f"SELECT doc_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS line "
            f"FROM (SELECT doc_id, {split_lines('text')} AS ls FROM {table})")


CTES["lines"] = lines_of("papers")
CTES["raw_lines"] = lines_of("documents")
CTES["headings"] = (
    f"SELECT doc_id, line_no, line, s, CASE WHEN h THEN {clean_heading('line')} END AS clean, h FROM ("
    f"SELECT *, {is_heading('s')} AS h FROM (SELECT *, {strip('line')} AS s FROM lines))")
CTES["events"] = f"""
SELECT doc_id, line_no, line, s, clean,
  CASE WHEN clean IS NULL THEN NULL
       WHEN {any_of('clean', C.STOP_WORDS)} THEN
         CASE WHEN starts_with(s, '#') OR (length(s) >= 3 AND {is_upper('s')}) THEN 'HARD_CLEAR' ELSE 'SOFT_CLEAR' END
       WHEN {has('clean', LETTERED_LINE)} THEN 'HARD_CLEAR'
       WHEN ({SECTION_CASE}) IS NOT NULL THEN 'SET' END AS event,
  CASE WHEN clean IS NULL OR {any_of('clean', C.STOP_WORDS)} OR {has('clean', LETTERED_LINE)} THEN NULL
       ELSE {SECTION_CASE} END AS section
FROM headings"""
CTES["states"] = """
SELECT *, CASE WHEN opened IS NULL THEN NULL
               WHEN opened = 'references' THEN 'references'
               WHEN soft_at > opened_at THEN NULL ELSE nullif(opened, '') END AS state
FROM (
  SELECT *,
    last_value(CASE WHEN event = 'SET' THEN section WHEN event = 'HARD_CLEAR' THEN '' END IGNORE NULLS) OVER w AS opened,
    last_value(CASE WHEN event IN ('SET', 'HARD_CLEAR') THEN line_no END IGNORE NULLS) OVER w AS opened_at,
    coalesce(last_value(CASE WHEN event = 'SOFT_CLEAR' THEN line_no END IGNORE NULLS) OVER w, -1) AS soft_at
  FROM events
  WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
CTES["keyword_sections"] = f"""
SELECT doc_id, state AS section, {strip("string_agg(line, chr(10) ORDER BY line_no)")} AS text,
  bool_or(event = 'SET' AND section = state AND starts_with(s, '#')) AS by_hash
FROM (SELECT *, coalesce(event, '') AS e FROM states) WHERE state IS NOT NULL GROUP BY doc_id, state"""


def keyword_pattern(words: list[str], anchor: str) -> str:
    alternatives = "|".join(re.escape(w).replace(r"\ ", " ") for w in words)
    return "(?i)" + anchor + uni(r"\s*(?:\d+\.?\s*)?") + f"(?:{alternatives})" + uni(r"\s*[\n\-—:.]")


ALL_WORDS = [w for _, _, ws in C.SECTIONS for w in ws]
SCAN_VALUES = ", ".join(
    f"({q(key)}, {i}, {q(keyword_pattern([w], '(?:^|\\n)'))})"
    for key, _, ws in C.SECTIONS for i, w in enumerate(ws))
CTES["scan_words"] = f"SELECT * FROM (VALUES {SCAN_VALUES}) AS t(section, word_no, pattern)"
CTES["scan_hits"] = f"""
SELECT p.doc_id, w.section, arg_min(m, word_no) AS m FROM (
  SELECT p.doc_id, w.section, w.word_no, regexp_extract(p.text, w.pattern) AS m
  FROM (SELECT p.* FROM papers p LEFT JOIN (SELECT doc_id, count(*) AS n FROM keyword_sections WHERE text <> '' GROUP BY doc_id) k
        USING (doc_id) WHERE coalesce(k.n, 0) <= {C.FALLBACK_SCAN_MAX_SECTIONS}) p, scan_words w
  WHERE NOT EXISTS (SELECT 1 FROM keyword_sections k WHERE k.doc_id = p.doc_id AND k.section = w.section)
) AS w JOIN papers p USING (doc_id) WHERE m <> '' GROUP BY p.doc_id, w.section"""
CTES["scan_cuts"] = f"""
SELECT doc_id, section, m, tail, regexp_extract(tail, {q(keyword_pattern(ALL_WORDS, chr(92) + 'n'))}) AS nxt
FROM (SELECT h.doc_id, h.section, m, substr(p.text, instr(p.text, m) + length(m)) AS tail
      FROM scan_hits h JOIN papers p USING (doc_id))"""
CTES["sections1"] = f"""
SELECT doc_id, section, text, by_hash FROM keyword_sections WHERE text <> ''
UNION ALL
SELECT doc_id, section, {strip(f"concat(m, substr(tail, 1, CASE WHEN nxt = '' THEN length(tail) ELSE instr(tail, nxt) - 1 END))")} AS text, false AS by_hash
FROM scan_cuts"""
CTES["candidates"] = f"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS pos, s AS heading FROM (
  SELECT doc_id, line_no, s, row_number() OVER (PARTITION BY doc_id, lower(s) ORDER BY line_no) AS rn
  FROM headings WHERE length(s) BETWEEN 1 AND 90 AND (
    {has('s', TOP_HASH)} OR (length(s) >= 3 AND {is_upper('s')} AND NOT {has('s', DIGIT_LIKE)})
    OR {has('s', TOP_NUMBER)} OR {has('s', TOP_ROMAN)}))
WHERE rn = 1"""
CTES["mapped_keys"] = f"""
SELECT doc_id, {clean_heading('heading')} AS clean, arg_max(section, pos) AS target
FROM candidates JOIN heading_map USING (heading)
WHERE section IN ({", ".join(q(k) for k in C.VALID_MAP_KEYS)}) GROUP BY doc_id, {clean_heading('heading')}"""
CTES["map_states"] = f"""
SELECT *, nullif(last_value(CASE WHEN stops OR target = 'none' THEN '' ELSE target END IGNORE NULLS)
    OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS state
FROM (SELECT h.doc_id, line_no, line, target,
        coalesce({any_of('h.clean', C.STOP_WORDS)} OR {has('h.clean', LETTERED_LINE)}, false) AS stops
      FROM headings h LEFT JOIN mapped_keys m ON m.doc_id = h.doc_id AND m.clean = h.clean)"""
CTES["map_sections"] = f"""
SELECT doc_id, state AS section, {strip("string_agg(line, chr(10) ORDER BY line_no)")} AS text
FROM map_states WHERE state IS NOT NULL GROUP BY doc_id, state"""
CTES["tier_counts"] = f"""
SELECT doc_id, coalesce(a.n, 0) AS n1, coalesce(b.n, 0) AS n2,
  CASE WHEN coalesce(a.n, 0) < {C.TIER2_MIN_SECTIONS} AND coalesce(b.n, 0) > coalesce(a.n, 0) THEN 2 ELSE 1 END AS tier
FROM papers LEFT JOIN (SELECT doc_id, count(*) AS n FROM sections1 WHERE text <> '' GROUP BY doc_id) a USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM map_sections WHERE text <> '' GROUP BY doc_id) b USING (doc_id)"""
CTES["sections"] = f"""
SELECT doc_id, section, tier, by_hash,
  CASE WHEN n1 >= {C.TIER2_MIN_SECTIONS} THEN a_text WHEN tier = 2 THEN coalesce(b_text, a_text) ELSE coalesce(a_text, b_text) END AS text
FROM (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.section, b.section) AS section,
        nullif(a.text, '') AS a_text, nullif(b.text, '') AS b_text, coalesce(a.by_hash AND a.text <> '', false) AS by_hash
      FROM sections1 a FULL OUTER JOIN map_sections b ON a.doc_id = b.doc_id AND a.section = b.section)
JOIN tier_counts USING (doc_id)
WHERE CASE WHEN n1 >= {C.TIER2_MIN_SECTIONS} THEN a_text ELSE coalesce(a_text, b_text) END IS NOT NULL"""

line_count = f"len({split_lines('text')})"
CTES["confidences"] = f"""
SELECT doc_id, section, CAST(greatest(80, least(99,
  CASE WHEN tier = 2 THEN 88 WHEN by_hash THEN 85 ELSE 70 END
  + CASE WHEN {line_count} >= 20 THEN 10 WHEN {line_count} >= 10 THEN 7 WHEN {line_count} >= 5 THEN 4 ELSE 2 END
  + list_sum(list_transform(range(1, length(text) + 1), lambda i: unicode(substr(text, i, 1)))) % 6)) AS BIGINT) AS confidence
FROM sections"""

ORACLES["l1_explode_lines"] = "SELECT doc_id, line_no, line FROM lines"
ORACLES["l1_explode_lines_raw"] = "SELECT doc_id, line_no, line FROM raw_lines"
ORACLES["l2_clean_heading"] = f"SELECT doc_id, line_no, {clean_heading('line')} AS clean FROM lines"
ORACLES["l3_is_heading"] = "SELECT doc_id, line_no, line FROM headings WHERE h"
ORACLES["l3_is_heading_raw"] = (
    f"SELECT doc_id, line_no, line FROM (SELECT *, {strip('line')} AS s FROM raw_lines) WHERE {is_heading('s')}")
ORACLES["l4_line_events"] = "SELECT doc_id, line_no, event, section FROM events WHERE event IS NOT NULL"
ORACLES["l5_classify_heading"] = (
    f"SELECT clean, {SECTION_CASE} AS section, count(*) AS n FROM headings WHERE clean IS NOT NULL GROUP BY ALL")
ORACLES["l6_segment_sections"] = "SELECT doc_id, section, text, by_hash FROM keyword_sections WHERE text <> ''"
ORACLES["l7_fallback_scan"] = "SELECT doc_id, section, text, by_hash FROM sections1"
ORACLES["l8_candidate_headings"] = "SELECT doc_id, pos, heading FROM candidates"
ORACLES["l9_segment_by_map"] = "SELECT doc_id, section, text FROM map_sections WHERE text <> ''"
ORACLES["l10_merge_tiers"] = "SELECT doc_id, section, text, CAST(tier AS BIGINT) AS tier FROM sections"
ORACLES["l11_section_confidence"] = "SELECT doc_id, section, confidence FROM confidences"
ORACLES["l12_section_warnings"] = """
SELECT doc_id, concat_ws(',', CASE WHEN NOT coalesce(bool_or(section = 'abstract'), false) THEN 'abstract' END,
  CASE WHEN NOT coalesce(bool_or(section = 'methodology'), false) THEN 'methodology' END,
  CASE WHEN NOT coalesce(bool_or(section = 'conclusion'), false) THEN 'conclusion' END) AS warnings,
  count(section) AS section_count
FROM papers LEFT JOIN sections USING (doc_id) GROUP BY doc_id"""
ORACLES["l13_section_profile"] = "SELECT doc_id, " + ", ".join(
    f"CAST(coalesce(max(length(s.text)) FILTER (section = '{k}'), 0) AS BIGINT) AS {k}" for k in C.SECTION_KEYS
) + " FROM papers LEFT JOIN sections1 s USING (doc_id) GROUP BY doc_id"
ORACLES["l14_heading_profile"] = f"""
SELECT doc_id, line_no, heading, total FROM (
  SELECT doc_id, line_no, s AS heading, count(*) OVER (PARTITION BY doc_id) AS total,
    row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rn
  FROM (SELECT *, {strip('line')} AS s FROM raw_lines)
  WHERE length(s) BETWEEN 1 AND 80 AND (starts_with(s, '#') OR ({is_upper('s')} AND length(s) >= 3)
    OR {has('s', NUMBERED_LINE)} OR (length(s) < 80 AND NOT ends_with(s, '.') AND NOT starts_with(s, '|'))))
"""
ORACLES["l15_compare_extractions"] = """
SELECT doc_id, d.section, CASE WHEN a.section IS NOT NULL AND b.section IS NOT NULL THEN 'both'
  WHEN a.section IS NOT NULL THEN 'a_only' WHEN b.section IS NOT NULL THEN 'b_only' ELSE 'neither' END AS outcome
FROM papers p CROSS JOIN section_dim d
LEFT JOIN (SELECT * FROM keyword_sections WHERE text <> '') a USING (doc_id, section)
LEFT JOIN (SELECT * FROM map_sections WHERE text <> '') b USING (doc_id, section)"""

# --- compression -------------------------------------------------------------

RE2_NUMBER_LIST = uni(r"\[\d+(?:[,;\s–\-]+\d+)*\]")
RE2_AUTHOR_YEAR = uni(r"\(\w[\w\s,.&]+,?\s+\d{4}[a-z]?\)")
RE2_BRACED_CARET = uni(r"(^|[^\w])\^\{\d+(?:,\d+)*\}")
RE2_PLAIN_CARET = uni(r"(^|[^\w])\^[\d,]+")


def normalize_ws(x: str) -> str:
    x = f"replace(replace({x}, chr(12), chr(10)), chr(65279), '')"
    x = sub(sub(x, r"\r\n|\r", "\n"), r"[ \t]{2,}", " ")
    return strip(sub(x, r"\n{3,}", "\n\n"))


def mask_urls(x: str) -> str:
    return sub(x, uni(r"https?://\S+"), "[URL]")


def strip_citations(x: str) -> str:
    x = sub(sub(x, RE2_NUMBER_LIST), RE2_AUTHOR_YEAR)
    x = sub(x, r"[\x{b9}\x{b2}\x{b3}\x{2074}-\x{2079}]+")
    x = sub(sub(x, RE2_BRACED_CARET, r"\1"), RE2_PLAIN_CARET, r"\1")
    return sub(sub(x, uni(r"\[\s*\]")), uni(r"\(\s*\)"))


def strip_boilerplate(x: str, evidence: bool) -> str:
    for pattern in C.BOILERPLATE_PATTERNS + (C.EVIDENCE_PATTERNS if evidence else []):
        x = sub(x, uni(pattern + r"[,]?\s*"), " ")
    x = sub(x, " {2,}", " ")
    return f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: {strip('l')}), chr(10))"


def drop_formula(x: str, aggressive: bool = False) -> str:
    letters = "length(regexp_replace(l, '[^\\p{L}]+', '', 'g'))"
    if aggressive:
        keep = f"length({strip('l')}) < 5 OR {letters} / length({strip('l')}) >= 0.4"
    else:
        keep = f"{strip('l')} = '' OR regexp_matches(l, '\\p{{L}}')"
    return f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: {keep}), chr(10))"


def sentence_split(x: str) -> str:
    marked = f"regexp_replace({x}, {q(uni(r'([.!?])' + chr(92) + 's+'))}, concat('\\1', chr(1)), 'g')"
    return f"string_split({marked}, chr(1))"


def dedup_ctes(prefix: str, source: str, keys: str, col: str) -> None:
    """Sentence de-duplication of ``col`` per ``keys`` as sub-queries prefix_a, prefix_b."""
    key = sub(f"lower({strip('sent')})", uni(r"\s+"), " ")
    CTES[f"{prefix}_a"] = (
        f"SELECT {keys}, unnest(range(0, len(ss))) AS pos, unnest(ss) AS sent FROM "
        f"(SELECT {keys}, {sentence_split(col)} AS ss FROM {source})")
    CTES[f"{prefix}_b"] = f"""
SELECT {keys}, string_agg(sent, ' ' ORDER BY pos) AS dd FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys}, k ORDER BY pos) AS rn FROM (SELECT *, {key} AS k FROM {prefix}_a))
WHERE length(k) <= 10 OR rn = 1 GROUP BY {keys}"""


ORACLES["c1_normalize_ws"] = f"SELECT doc_id, {normalize_ws('text')} AS out FROM papers"
ORACLES["c2_mask_urls"] = f"SELECT doc_id, {mask_urls('text')} AS out FROM papers"
ORACLES["c2_mask_urls_pages"] = "SELECT page_id, " + mask_urls("concat_ws(' ', url, html)") + " AS out FROM pages"
ORACLES["c3_strip_citations"] = f"SELECT doc_id, {strip_citations('text')} AS out FROM papers"
ORACLES["c4_strip_boilerplate"] = f"SELECT doc_id, {strip_boilerplate('text', False)} AS out FROM papers"
ORACLES["c5_strip_boilerplate_evidence"] = f"SELECT doc_id, {strip_boilerplate('text', True)} AS out FROM papers"
dedup_ctes("raw_dedup", "documents", "doc_id", "text")
ORACLES["c6_dedup_sentences"] = "SELECT doc_id, dd AS out FROM raw_dedup_b"
ORACLES["c7_drop_formula_lines"] = (
    f"SELECT doc_id, {drop_formula('text')} AS light, {drop_formula('text', True)} AS aggressive FROM papers")

CTES["comp_a"] = (
    f"SELECT doc_id, section, text, n, {drop_formula(strip_citations(mask_urls('n')))} AS s1 FROM "
    f"(SELECT doc_id, section, text, {normalize_ws('text')} AS n FROM sections)")
CTES["comp_b"] = f"""
SELECT doc_id, section, CASE WHEN section = 'results' THEN s1 WHEN section = 'discussion' THEN {strip_boilerplate('s1', False)}
  ELSE {strip_boilerplate('s1', True)} END AS pre
FROM comp_a WHERE section IN ('results', 'discussion', 'introduction', 'related_work')"""
dedup_ctes("comp_dedup", "comp_b", "doc_id, section", "pre")
CTES["compressed"] = f"""
SELECT a.doc_id, a.section, a.text, CASE WHEN a.section = 'references' THEN a.text
  WHEN a.section IN ('abstract', 'methodology', 'conclusion') THEN n ELSE {normalize_ws('dd')} END AS compressed
FROM comp_a a LEFT JOIN comp_dedup_b d ON a.doc_id = d.doc_id AND a.section = d.section"""


def round_py(x: str, digits: int = 1) -> str:
    """printf rounds the exact binary value, ties to even."""
    return f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


def pct(o: str, c: str) -> str:
    return f"CASE WHEN {o} > 0 THEN {round_py(f'(1.0::DOUBLE - {c}::DOUBLE / {o}) * 100.0::DOUBLE')} ELSE 0.0::DOUBLE END"


CTES["comp_stats"] = f"""
SELECT CASE g WHEN 0 THEN 'section' WHEN 1 THEN 'paper' ELSE 'corpus' END AS level, doc_id, section,
  CAST(o AS BIGINT) AS original, CAST(c AS BIGINT) AS compressed, {pct('o', 'c')} AS pct
FROM (SELECT grouping(doc_id, section) AS g, doc_id, section, sum(length(text)) AS o, sum(length(compressed)) AS c
      FROM compressed WHERE section <> 'references' GROUP BY ROLLUP(doc_id, section))"""
ORACLES["c8_compress_sections"] = "SELECT doc_id, section, compressed FROM compressed"
ORACLES["c9_compression_stats"] = "SELECT * FROM comp_stats"
ORACLES["c10_compression_report"] = f"""
SELECT *, pct >= 20.0 AS meets_threshold FROM (
  SELECT papers, original, compressed, grew, {pct('original', 'compressed')} AS pct FROM (
    SELECT count(DISTINCT doc_id) AS papers, CAST(sum(original) AS BIGINT) AS original,
      CAST(sum(compressed) AS BIGINT) AS compressed, count(*) FILTER (compressed > original) AS grew
    FROM comp_stats WHERE level = 'section'))"""

# --- prompts -----------------------------------------------------------------

RE2_CAPTION = (
    r"(?im)(?:^|\n)[ \t]*(?:\*{0,2})(?:Figure|Fig\.?|Table|Tbl\.|Scheme|Chart)" + uni(r"[ \t]+\d+[.:)]?")
    + r"(?:\*{0,2})[ \t]*([^\n]{15,})")
CTES["sent_texts"] = """
SELECT c.doc_id, d.ord, c.section, CASE WHEN c.section = 'methodology' THEN c.text ELSE c.compressed END AS t
FROM compressed c JOIN section_dim d USING (section)"""
CTES["caption_rows"] = f"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord, seq) - 1 AS pos, cap FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, lower(cap) ORDER BY ord, seq) AS rn FROM (
    SELECT doc_id, ord, seq, rtrim({strip('raw')}, '.') AS cap FROM (
      SELECT doc_id, ord, unnest(range(0, len(caps))) AS seq, unnest(caps) AS raw FROM (
        SELECT doc_id, ord, regexp_extract_all(t, {q(RE2_CAPTION)}, 1) AS caps FROM sent_texts)))
  WHERE length(cap) >= 15)
WHERE rn = 1"""


def smart_truncate(x: str, limit: str) -> str:
    window = f"substr({x}, 1, {limit})"
    sentence = f"regexp_extract({window}, {q(uni('(?s)^(.*[.!?]' + chr(92) + 's)'))}, 1)"
    last_space = f"(length({window}) - instr(reverse({window}), ' '))"
    ws = q(WS_CHARS)
    return (f"(CASE WHEN length({x}) <= {limit} THEN {x} ELSE concat(CASE WHEN {sentence} <> '' THEN rtrim({sentence}, {ws}) "
            f"WHEN contains({window}, ' ') AND {last_space} > {limit} // 2 THEN rtrim(substr({window}, 1, {last_space}), {ws}) "
            f"ELSE {window} END, {q(C.TRUNCATION_MARK)}) END)")


LIMITS = ", ".join(f"({q(k)}, {q(label)}, {n})" for k, label, n in C.PROMPT_SECTIONS)
CTES["prompt_dim"] = f"SELECT * FROM (VALUES {LIMITS}) AS t(section, label, lim)"
CTES["prompt_body"] = f"""
SELECT p.doc_id, CASE WHEN coalesce(size, 0) < 1 THEN coalesce(raw, '') ELSE joined END AS body
FROM papers p
LEFT JOIN (SELECT doc_id, string_agg(concat('[', label, ']', chr(10), chunk), chr(10) || chr(10) ORDER BY ord) AS joined,
             sum(length(chunk) + length(label) + 3) AS size
           FROM (SELECT doc_id, ord, label, {strip('t')} AS chunk
                 FROM sent_texts JOIN prompt_dim USING (section) WHERE {strip('t')} <> '') GROUP BY doc_id) j USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(t, ' ' ORDER BY ord) AS raw FROM sent_texts WHERE {strip('t')} <> '' GROUP BY doc_id) r USING (doc_id)"""
CTES["prompts"] = f"""
SELECT doc_id, CASE WHEN {strip('body')} = '' THEN '' WHEN block IS NULL THEN body
  ELSE concat(body, chr(10), chr(10), {q(C.CAPTION_HEADER)}, chr(10), block) END AS prompt
FROM prompt_body LEFT JOIN (SELECT doc_id, string_agg('- ' || cap, chr(10) ORDER BY pos) AS block
  FROM caption_rows GROUP BY doc_id) USING (doc_id)"""
ORACLES["p1_captions"] = f"SELECT doc_id, pos, cap AS caption FROM caption_rows"
ORACLES["p2_smart_truncate"] = (
    f"SELECT doc_id, {smart_truncate('text', '700')} AS cut_700, {smart_truncate('text', '40')} AS cut_40 FROM documents")
ORACLES["p3_assemble_prompt"] = "SELECT doc_id, prompt FROM prompts"
BUDGET = "CASE section " + " ".join(f"WHEN {q(k)} THEN {n}" for k, n in C.BUDGET_LIMITS) + " ELSE 0 END"
ORACLES["p4_token_budget"] = f"""
SELECT CASE g WHEN 0 THEN 'section' WHEN 1 THEN 'paper' ELSE 'corpus' END AS level, doc_id, section,
  CAST(c AS BIGINT) AS chars, CAST(s AS BIGINT) AS sent, CAST(c // 4 AS BIGINT) AS tokens,
  {round_py('s::DOUBLE / c * 100.0::DOUBLE')} AS share,
  CASE WHEN g = 1 THEN CAST({C.TOKENS_PER_MINUTE} // ((s + {C.PROMPT_OVERHEAD_CHARS}) // 4) AS BIGINT) END AS papers_per_minute
FROM (SELECT grouping(doc_id, section) AS g, doc_id, section, sum(length(text)) AS c, sum(least(length(text), {BUDGET})) AS s
      FROM sections GROUP BY ROLLUP(doc_id, section))"""
ORACLES["s8_content_key"] = """
SELECT doc_id, substr(sha256(text), 1, 16) AS content_key, 'hmap_' || substr(sha256(coalesce(hs, '')), 1, 12) AS heading_key
FROM papers LEFT JOIN (SELECT doc_id, string_agg(heading, '|' ORDER BY pos) AS hs FROM candidates GROUP BY doc_id) USING (doc_id)"""

# --- references --------------------------------------------------------------

NOW = 2024
YEAR = r"\b(19[0-9]{2}|20[0-9]{2})\b"

CTES["works"] = D.works_sql(DD)
CTES["preprints"] = D.preprints_sql(DD)
CTES["lookup_log"] = D.lookup_log_sql(DD)
CTES["links"] = D.links_sql(DD)
CTES["refs"] = """SELECT p.doc_id, p.text AS full_text, coalesce(s.text, '') AS refs
FROM papers p LEFT JOIN sections1 s ON s.doc_id = p.doc_id AND s.section = 'references'"""


def lines_cte(source: str, col: str) -> str:
    return f"""SELECT doc_id, seq AS line_no, line, {strip('line')} AS s FROM (
  SELECT doc_id, unnest(range(0, len(ls))) AS seq, unnest(ls) AS line FROM (SELECT doc_id, {split_lines(col)} AS ls FROM {source}))"""


CTES["ref_all_lines"] = lines_cte("refs", "refs")
CTES["ref_lines"] = """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS pos, s AS line
FROM ref_all_lines WHERE length(s) > 20"""


def peel(x: str, opening: str, closing: str) -> str:
    opens, closes = f"(length({x}) - length(replace({x}, '{opening}', '')))", f"(length({x}) - length(replace({x}, '{closing}', '')))"
    run = f"(length({x}) - length(rtrim({x}, '{closing}')))"
    return f"substr({x}, 1, length({x}) - least({run}, greatest({closes} - {opens}, 0)))"


CTES["doi_raw"] = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS kind, unnest(range(0, len(m))) AS n, unnest(m) AS raw FROM (SELECT doc_id, regexp_extract_all(refs, {q(pat)}, 1) AS m FROM refs)"
    for k, pat in enumerate([DOI_LABELLED, DOI_STANDALONE]))
CTES["text_dois"] = f"""
SELECT doc_id, pos, doi FROM (
  SELECT doc_id, doi, row_number() OVER (PARTITION BY doc_id ORDER BY kind, n) - 1 AS pos FROM (
    SELECT doc_id, doi, kind, n, row_number() OVER (PARTITION BY doc_id, doi ORDER BY kind, n) AS rn FROM (
      SELECT doc_id, kind, n, {peel('y', '[', ']')} AS doi FROM (
        SELECT doc_id, kind, n, {peel('x', '(', ')')} AS y FROM (
          SELECT doc_id, kind, n, {strip(sub('raw', DOI_ENDS))} AS x FROM doi_raw)))
    WHERE doi <> '')
  WHERE rn = 1)"""
CTES["link_rows"] = f"""
SELECT doc_id, doi, min(link_no) AS link_no FROM (SELECT doc_id, link_no, rtrim(regexp_extract(uri, {q(DOI_OF_LINK)}, 1), '.') AS doi FROM links)
WHERE doi <> '' GROUP BY doc_id, doi"""
CTES["dois"] = f"""
SELECT doc_id, pos, doi FROM (
  SELECT doc_id, doi, row_number() OVER (PARTITION BY doc_id ORDER BY src, pos) - 1 AS pos FROM (
    SELECT 0 AS src, doc_id, pos, doi FROM text_dois
    UNION ALL SELECT 1, doc_id, link_no, doi FROM link_rows l
      WHERE NOT EXISTS (SELECT 1 FROM text_dois t WHERE t.doc_id = l.doc_id AND t.doi = l.doi)))"""
CTES["scored_dois"] = f"SELECT d.* FROM dois d JOIN refs USING (doc_id) WHERE {strip('refs')} <> ''"
CTES["arxiv_ids"] = f"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS pos, arxiv_id FROM (
  SELECT doc_id, arxiv_id, min(n) AS n FROM (SELECT doc_id, unnest(range(0, len(m))) AS n, unnest(m) AS arxiv_id
    FROM (SELECT doc_id, regexp_extract_all(refs, {q(ARXIV)}, 1) AS m FROM refs)) GROUP BY doc_id, arxiv_id)"""


def title_of(line: str) -> str:
    x = strip(sub(line, ENTRY_NUMBER, "", ""))
    quoted = f"regexp_extract({x}, {q(QUOTED)}, 1)"
    a, b = (strip(f"regexp_extract({x}, {q(p)}, 1)") for p in (AFTER_PARENS, AFTER_BARE_YEAR))
    return (f"(CASE WHEN {quoted} <> '' THEN {strip(quoted)} WHEN length({a}) > 10 THEN {a} "
            f"WHEN length({b}) > 10 THEN {b} ELSE '' END)")


def year_of(line: str) -> str:
    return f"regexp_extract({line}, {q(YEAR)}, 1)"


def label_of(line: str, default: str, flags: str = "") -> str:
    m = f"regexp_extract({line}, {q(flags + AUTHOR_YEAR)}, 1)"
    return f"(CASE WHEN {m} <> '' THEN {m} ELSE {default} END)"


CTES["titles"] = f"SELECT doc_id, pos, line, {title_of('line')} AS title, {year_of('line')} AS year FROM ref_lines"
CTES["paper_years"] = f"""
SELECT doc_id, arg_max(y, n * 10000 + y) AS year FROM (SELECT doc_id, y, sum(c) AS n FROM (
  SELECT doc_id, 1 AS c, CAST(unnest(regexp_extract_all(text, {q(YEAR)}, 1)) AS BIGINT) AS y FROM papers
  UNION ALL SELECT doc_id, -1, CAST(unnest(regexp_extract_all(refs, {q(YEAR)}, 1)) AS BIGINT) FROM refs)
  WHERE y > 1950 AND y <= {NOW} GROUP BY doc_id, y HAVING sum(c) > 0) GROUP BY doc_id"""
CTES["recency_counts"] = f"""
SELECT r.doc_id, py.year, count(y) AS n, count(*) FILTER (y >= coalesce(py.year, {NOW}) - 3) AS recent,
  array_to_string(list_sort(list(DISTINCT y) FILTER (y IS NOT NULL)), ',') AS ref_years
FROM refs r LEFT JOIN paper_years py USING (doc_id)
LEFT JOIN (SELECT doc_id, CAST(nullif(year, '') AS BIGINT) AS y FROM titles) t
  ON t.doc_id = r.doc_id AND y > 1950 AND y <= {NOW}
GROUP BY r.doc_id, py.year"""
CTES["recency"] = f"""
SELECT doc_id, year, CASE WHEN n = 0 THEN 7.0 WHEN ratio >= 0.35 THEN 10.0 WHEN ratio >= 0.2 THEN 8.0 WHEN ratio >= 0.08 THEN 6.0 ELSE 4.0 END::DOUBLE AS recency_score,
  ratio AS recent_ratio,
  CASE WHEN n = 0 THEN 'Could not extract publication years from references.'
    WHEN ratio >= 0.35 THEN concat(share, ' — excellent currency.') WHEN ratio >= 0.2 THEN concat(share, ' — good currency.')
    WHEN ratio >= 0.08 THEN concat(share, ' — moderate currency.') ELSE concat('Only ', share, ' — literature survey may be outdated.') END AS recency_note,
  coalesce(ref_years, '') AS ref_years
FROM (SELECT *, CASE WHEN n > 0 THEN {round_py('recent::DOUBLE / n', 2)} END AS ratio,
  concat(recent, '/', n, ' refs from ', CASE WHEN year IS NULL THEN 'last 3 years' ELSE concat('last 3 years before paper (', year, ')') END) AS share
  FROM recency_counts)"""


def duplicates_sql(source: str) -> str:
    norm = sub("lower(s)", uni(r"\s+"), " ")
    return f"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS pos, {label_of('s', 'substr(s, 1, 40)', '(?i)')} AS citation
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, norm ORDER BY line_no) AS rn FROM (
  SELECT doc_id, line_no, s, {norm} AS norm FROM {source}) WHERE length(norm) > 20) WHERE rn > 1"""


CTES["raw_stripped"] = f"SELECT doc_id, {strip('text')} AS t FROM documents"
CTES["raw_ref_lines"] = lines_cte("raw_stripped", "t")
CTES["duplicates"] = duplicates_sql("ref_all_lines")
ORACLES["s2_link_dois"] = "SELECT doc_id, string_agg(doi, '|' ORDER BY link_no) AS dois FROM link_rows GROUP BY doc_id"
ORACLES["s2_hrefs"] = f"""SELECT page_id, unnest(range(0, len(m))) AS link_no, unnest(m) AS uri
FROM (SELECT page_id, regexp_extract_all(html, {q(LINK_TARGET)}, 1) AS m FROM pages)"""
ORACLES["k1_ref_lines"] = "SELECT doc_id, pos, line FROM ref_lines"
ORACLES["k1_total_refs"] = f"""SELECT doc_id, CASE WHEN {strip('refs')} = '' THEN 0 ELSE greatest(coalesce(n, 0), 1) END AS total_refs
FROM refs LEFT JOIN (SELECT doc_id, count(*) AS n FROM ref_lines GROUP BY doc_id) USING (doc_id)"""
ORACLES["k2_extract_dois"] = "SELECT doc_id, pos, doi FROM text_dois"
ORACLES["k3_merge_dois"] = """SELECT doc_id, coalesce(d, '') AS dois FROM papers
LEFT JOIN (SELECT doc_id, string_agg(doi, '|' ORDER BY pos) AS d FROM dois GROUP BY doc_id) USING (doc_id)"""
ORACLES["k4_ref_year"] = "SELECT doc_id, pos, year FROM titles"
ORACLES["k5_extract_arxiv"] = "SELECT doc_id, pos, arxiv_id FROM arxiv_ids"
ORACLES["k6_ref_title"] = "SELECT doc_id, pos, title FROM titles"
ORACLES["k7_paper_year"] = "SELECT doc_id, year FROM papers LEFT JOIN paper_years USING (doc_id)"
ORACLES["k8_recency"] = "SELECT * FROM recency"
ORACLES["k9_duplicate_refs"] = f"SELECT *, 'duplicate' AS category, {q(C.DUPLICATE_DETAIL)} AS detail FROM duplicates"
ORACLES["k9_duplicate_lines_raw"] = duplicates_sql("raw_ref_lines")
ORACLES["k10_citation_label"] = (
    f"SELECT doc_id, pos, {label_of('line', q('none'))} AS exact, {label_of('line', 'substr(line, 1, 40)', '(?i)')} AS loose FROM ref_lines")

# --- verification --------------------------------------------------------------

CTES["log_status"] = """
SELECT kind, id, CASE WHEN kind = 'doi' AND final = 200 THEN 'verified' WHEN kind = 'doi' AND final = 404 THEN 'not_found'
  WHEN final <> 200 THEN 'unreachable' END AS status
FROM (SELECT kind, id, CASE WHEN (kind = 'doi' AND coalesce(a, 0) IN (429, 503, 0)) OR (kind = 'title' AND a = 429) THEN coalesce(b, 0) ELSE coalesce(a, 0) END AS final
  FROM (SELECT kind, id, max(http_status) FILTER (attempt = 1) AS a, max(http_status) FILTER (attempt = 2) AS b FROM lookup_log GROUP BY kind, id))"""


def doi_status(source: str) -> str:
    return f"""SELECT d.doc_id, d.pos, d.doi, coalesce(l.status, CASE WHEN d.doi IN (SELECT doi FROM works) THEN 'verified' ELSE 'not_found' END) AS status
FROM {source} d LEFT JOIN log_status l ON l.kind = 'doi' AND l.id = d.doi"""


CTES["doi_status"] = doi_status("text_dois")
CTES["scored_doi_status"] = doi_status("scored_dois")
CTES["arxiv_status"] = f"""SELECT a.doc_id, a.pos, coalesce(l.status, CASE WHEN a.arxiv_id IN (SELECT arxiv_id FROM preprints) THEN 'verified' ELSE 'not_found' END) AS status
FROM arxiv_ids a LEFT JOIN log_status l ON l.kind = 'arxiv' AND l.id = a.arxiv_id"""


def tokens(x: str) -> str:
    return (f"list_distinct(list_filter(string_split(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''))")


def grams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x})), lambda i: substr({x}, i, 2)))"


CTES["ref_titles"] = "SELECT DISTINCT lower(title) AS title FROM titles WHERE title <> ''"
CTES["work_titles"] = "SELECT lower(title) AS found, list(DISTINCT year) AS years FROM works GROUP BY lower(title)"
CTES["ref_tokens"] = f"SELECT title, unnest({tokens('title')}) AS token FROM ref_titles"
CTES["work_tokens"] = f"SELECT found, unnest({tokens('found')}) AS token FROM work_titles"
CTES["hits"] = f"""
SELECT title, found, shared FROM (
  SELECT title, found, count(*) AS shared FROM ref_tokens JOIN work_tokens USING (token) GROUP BY title, found)
JOIN (SELECT title, count(*) AS m FROM ref_tokens GROUP BY title) USING (title)
WHERE shared >= (3 * m + 4) // 5"""
CTES["title_sims"] = f"""
SELECT h.title, years, 2.0::DOUBLE * len(list_intersect({grams('h.title')}, {grams('h.found')})) / (len({grams('h.title')}) + len({grams('h.found')})) AS sim
FROM hits h JOIN work_titles w ON w.found = h.found"""


CTES["title_best"] = "SELECT title, max(sim) AS best FROM title_sims GROUP BY title"
CTES["title_near"] = """SELECT DISTINCT title, w + o AS y FROM (SELECT title, unnest(years) AS w FROM title_sims WHERE sim >= 0.5), (VALUES (-1), (0), (1)) AS v(o)"""


def title_status(source: str) -> str:
    return f"""SELECT t.doc_id, t.pos, t.title, t.year, CASE WHEN t.title = '' THEN 'not_found'
  WHEN lower(t.title) IN (SELECT lower(id) FROM log_status WHERE kind = 'title' AND status = 'unreachable') THEN 'unreachable'
  WHEN b.best >= 0.6 OR n.y IS NOT NULL THEN 'verified' ELSE 'not_found' END AS status
FROM {source} t LEFT JOIN title_best b ON b.title = lower(t.title)
LEFT JOIN title_near n ON n.title = lower(t.title) AND n.y = TRY_CAST(t.year AS BIGINT)"""


CTES["title_rows"] = title_status("titles")
CTES["scored_uncovered"] = """
SELECT t.*, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n
FROM titles t WHERE NOT EXISTS (
  SELECT 1 FROM scored_doi_status d WHERE d.doc_id = t.doc_id AND d.status = 'verified' AND contains(t.line, d.doi))"""


def in_sample(k: int) -> str:
    return f"(n <= {k} OR i IN ({', '.join(f'({j} * n) // {k}' for j in range(k))}))"


CTES["sampled"] = """
SELECT doc_id, pos, title, year FROM scored_uncovered WHERE title <> ''"""
CTES["small_sample"] = f"""
SELECT doc_id, pos, title, year FROM scored_uncovered
WHERE title <> '' AND {in_sample(5)} AND doc_id IN (SELECT doc_id FROM scored_dois)
UNION ALL SELECT doc_id, pos, title, year FROM titles
WHERE title <> '' AND pos < 10 AND doc_id NOT IN (SELECT doc_id FROM scored_dois)"""
CTES["sampled_status"] = title_status("sampled")
CTES["counted"] = f"""
SELECT r.doc_id, {strip('r.refs')} = '' AS blank, coalesce(n_dois, 0) AS n_dois, coalesce(d_v, 0) AS d_v, coalesce(d_n, 0) AS d_n, coalesce(d_u, 0) AS d_u,
  coalesce(t_v, 0) AS t_v, coalesce(t_n, 0) AS t_n, coalesce(t_u, 0) AS t_u, coalesce(n_arxiv, 0) AS n_arxiv, coalesce(a_v, 0) AS a_v,
  coalesce(n_dup, 0) AS n_dup, CASE WHEN {strip('r.refs')} = '' THEN 0 ELSE greatest(coalesce(n_lines, 0), 1) END AS total_refs,
  rc.recency_score, rc.recency_note
FROM refs r JOIN recency rc USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_dois, count(*) FILTER (status = 'verified') AS d_v, count(*) FILTER (status = 'not_found') AS d_n,
   count(*) FILTER (status = 'unreachable') AS d_u FROM scored_doi_status GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) FILTER (status = 'verified') AS t_v, count(*) FILTER (status = 'not_found') AS t_n,
   count(*) FILTER (status = 'unreachable') AS t_u FROM sampled_status GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_arxiv FROM arxiv_ids GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) FILTER (status = 'verified') AS a_v FROM arxiv_status GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_dup FROM duplicates GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_lines FROM ref_lines GROUP BY doc_id) USING (doc_id)"""
linear = round_py("(d_v + t_v)::DOUBLE / (d_v + t_v + d_n + t_n) * 10.0::DOUBLE")
ratio = "(CASE WHEN n_arxiv > 0 THEN a_v::DOUBLE / n_arxiv END)"
CTES["base_scores"] = f"""
SELECT *, (n_dois > 0 AND d_u + t_u = n_dois + t_v + t_n + t_u) AS cleared,
  CASE WHEN d_v + t_v + d_n + t_n > 0 THEN {linear} WHEN n_dois > 0 THEN 7.0 WHEN d_u + t_u > 0 THEN 7.0 ELSE 3.0 END::DOUBLE AS base FROM counted"""
CTES["boosted"] = f"""
SELECT *, CASE WHEN n_dois > 0 THEN least(base + CASE WHEN {ratio} >= 0.7 THEN 1.5 WHEN {ratio} >= 0.4 THEN 0.75 ELSE 0 END, 10)
  ELSE least(CASE WHEN n_dup > 0 THEN greatest(base - 1, 0) ELSE base END + CASE WHEN {ratio} >= 0.7 THEN 1 ELSE 0 END, 10) END::DOUBLE AS raised FROM base_scores"""
CTES["scores"] = f"""
SELECT *, CASE WHEN blank THEN 0.0 WHEN cleared THEN 7.0 WHEN n_dois > 0 THEN blended ELSE least(blended, 6.0) END::DOUBLE AS score
FROM (SELECT *, {round_py('0.8::DOUBLE * raised + 0.2::DOUBLE * recency_score')} AS blended FROM boosted)"""
CTES["citation_rows"] = """
SELECT doc_id, score, CAST(total_refs AS BIGINT) AS total_refs, CASE WHEN cleared THEN 0 ELSE d_v + t_v END AS verified,
  CASE WHEN cleared THEN 0 ELSE d_n + t_n END AS not_found, d_u + t_u AS unreachable, a_v AS arxiv_verified FROM scores"""
ORACLES["v1_lookup_status"] = "SELECT * FROM log_status"
ORACLES["v2_verify_dois"] = "SELECT * FROM doi_status"
ORACLES["v3_verify_arxiv"] = """SELECT doc_id, ids, verified, verified::DOUBLE / ids AS ratio
FROM (SELECT doc_id, count(*) AS ids FROM arxiv_ids GROUP BY doc_id)
JOIN (SELECT doc_id, count(*) FILTER (status = 'verified') AS verified FROM arxiv_status GROUP BY doc_id) USING (doc_id)"""
ORACLES["v4_search_titles"] = "SELECT title, found, shared FROM hits"
ORACLES["v4_verify_titles"] = ORACLES["v4_verify_titles_dice"] = "SELECT * FROM title_rows"
ORACLES["v5_uncovered_refs"] = "SELECT doc_id, pos, title, year FROM sampled"
ORACLES["v6_sample_refs"] = "SELECT doc_id, pos, title, year FROM small_sample"
ORACLES["v7_outcome_counts"] = """SELECT doc_id, d_v + t_v AS verified, d_n + t_n AS not_found, d_u + t_u AS unreachable,
t_v + t_n + t_u AS checked_titles FROM counted"""
ORACLES["v8_citation_score"] = "SELECT * FROM citation_rows"
ORACLES["v9_citation_score_no_doi"] = "SELECT doc_id, score FROM scores WHERE n_dois = 0 AND NOT blank"
ORACLES["v10_blank_references"] = f"""SELECT doc_id, 0.0::DOUBLE AS score, CAST(0 AS BIGINT) AS total_refs FROM refs WHERE {strip('refs')} = ''"""
CTES["flag_rows"] = f"""
SELECT doc_id, 0 AS grp, d.pos AS ord, {label_of('coalesce(line, ' + q('') + ')', 'd.doi')} AS citation, 'not_found' AS category, {q(C.NOT_FOUND_DETAIL)} AS detail
FROM scored_doi_status d LEFT JOIN (SELECT d.doc_id, d.pos, arg_min(line, r.pos) AS line FROM scored_dois d JOIN ref_lines r
  ON r.doc_id = d.doc_id AND contains(r.line, d.doi) GROUP BY d.doc_id, d.pos) USING (doc_id, pos) WHERE status = 'not_found'
UNION ALL SELECT doc_id, 1, pos, citation, 'duplicate', {q(C.DUPLICATE_DETAIL)} FROM duplicates"""
ORACLES["v11_flagged_items"] = """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp, ord) - 1 AS pos, citation, category, detail
FROM flag_rows WHERE doc_id IN (SELECT doc_id FROM scores WHERE NOT cleared)"""
ORACLES["v12_citation_messages"] = """
SELECT doc_id, CASE WHEN blank THEN 'No references section found in document.'
 WHEN n_dois = 0 THEN concat_ws('|', 'No DOIs found in references section.',
   CASE WHEN t_v + t_n + t_u > 0 THEN concat('Title verification: ', t_v, '/', t_v + t_n + t_u, ' references verified via Semantic Scholar.')
     ELSE concat('Could not extract titles from ', total_refs, ' reference entries for verification.') END,
   CASE WHEN t_u > 0 THEN concat(t_u, ' reference(s) unreachable during verification (excluded from score).') END,
   CASE WHEN n_dup > 0 THEN concat(n_dup, ' duplicate reference(s) detected.') END,
   CASE WHEN n_arxiv > 0 THEN concat(a_v, '/', n_arxiv, ' ArXiv reference(s) verified.') END, recency_note)
 WHEN cleared THEN 'Citation verification throttled — all DOIs unreachable. Neutral score applied.'
 ELSE concat_ws('|', CASE WHEN d_n > 0 THEN concat(d_n, ' of ', n_dois, ' DOI(s) could not be verified (not found in CrossRef).') END,
   CASE WHEN t_v + t_n + t_u > 0 THEN concat('Title fallback: ', t_v, '/', t_v + t_n + t_u, ' reference(s) verified via Semantic Scholar.') END,
   CASE WHEN n_arxiv > 0 THEN concat(a_v, '/', n_arxiv, ' ArXiv preprint reference(s) verified.') END,
   CASE WHEN n_dup > 0 THEN concat(n_dup, ' duplicate reference(s) detected.') END,
   CASE WHEN d_u > 0 THEN concat(d_u, ' of ', n_dois, ' DOI(s) were unreachable during validation.') END, recency_note,
   CASE WHEN d_n = 0 AND n_dup = 0 AND d_u = 0 THEN concat('All ', n_dois, ' DOI(s) verified successfully.') END) END AS issues,
 CASE WHEN blank THEN 'Add a References section with properly formatted citations including DOIs.'
 WHEN n_dois = 0 THEN 'Include DOIs for all cited works to improve citation verifiability.|Papers with verifiable DOIs receive higher citation scores.'
 WHEN cleared THEN 'Retry the analysis when API demand is lower.'
 WHEN d_n + n_dup + d_u = 0 THEN 'No citation issues found.'
 ELSE concat_ws('|', CASE WHEN d_n > 0 THEN 'Check flagged DOIs for typos or confirm they are published in indexed journals.' END,
   CASE WHEN n_dup > 0 THEN 'Remove duplicate entries and ensure consistent formatting.' END,
   CASE WHEN d_u > 0 THEN 'Retry the analysis to attempt validation of unreachable DOIs.' END) END AS suggestions
FROM scores"""
ORACLES["v13_citation_summary"] = """
SELECT doc_id, total_refs, verified, not_found + unreachable AS unverified,
  CASE WHEN total_refs > 0 THEN CAST(floor(verified::DOUBLE / total_refs * 100.0::DOUBLE) AS BIGINT) ELSE 0 END AS success_pct,
  CASE WHEN total_refs > 0 THEN CAST(floor(verified::DOUBLE / total_refs * 100.0::DOUBLE + 0.5) AS BIGINT) ELSE 0 END AS rate_pct
FROM citation_rows"""

# --- sources and incremental analysis ------------------------------------------

CTES["candidate_rows"] = D.candidates_sql(DD)
CTES["fallback_rows"] = D.fallback_sql(DD)
CTES["reviews"] = D.reviews_sql(DD)
ORACLES["s1_load_papers"] = f"""
SELECT doc_id, CASE WHEN length({strip('text')}) >= 100 THEN 'accepted' ELSE 'Could not extract meaningful text' END AS outcome FROM documents"""
ORACLES["s4_pick_first_available"] = """
SELECT name, arxiv_id, title, source FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY r) AS best FROM (
    SELECT name, arxiv_id, title, available, 'arxiv_api' AS source, row_number() OVER (PARTITION BY name ORDER BY priority) AS r FROM candidate_rows
    UNION ALL SELECT name, arxiv_id, title, available, 'arxiv_fallback', 1000000 FROM fallback_rows)
  WHERE available)
WHERE best = 1"""


def layer_field(name: str, field: str) -> str:
    return f"json_extract(ok, '$.{name}.{field}')"


def layer_select(name: str, n: int) -> str:
    present = " AND ".join(f"json_type(ok, '$.{m}') IS NOT NULL" for m in C.MODEL_LAYERS)
    lists = {
        f: f"array_to_string(CAST(json_extract_string(ok, '$.{name}.{f}[*]') AS VARCHAR[]), '|')" for f in ("issues", "suggestions")}
    texts = {"issues": (C.FALLBACK_ISSUE, C.NO_SECTION_ISSUE, C.NO_ISSUES),
             "suggestions": (C.FALLBACK_SUGGESTION, C.NO_SECTION_SUGGESTION, C.NO_SUGGESTIONS)}
    cols = ", ".join(
        f"CASE WHEN ok IS NULL THEN {q(texts[f][0])} WHEN NOT ({present}) THEN {q(texts[f][2])} "
        f"WHEN json_type(ok, '$.{name}') <> 'OBJECT' THEN {q(texts[f][1])} "
        f"WHEN json_type(ok, '$.{name}.{f}') IS NULL THEN {q(texts[f][2])} ELSE {lists[f]} END AS {f}" for f in lists)
    marked = "coalesce(" + " OR ".join(f"coalesce(json_extract_string(ok, '$.{m}.analysis_failed') = 'true', false)" for m in C.MODEL_LAYERS) + ", false)"
    return (f"SELECT doc_id, ok IS NULL OR {marked} AS analysis_failed, {DISCIPLINE} AS discipline, {n} AS ord, '{name}' AS layer, "
            f"least(10.0, greatest(0.0, CASE WHEN ok IS NOT NULL AND {present} THEN coalesce(TRY_CAST(json_extract_string(ok, '$.{name}.score') AS DOUBLE), 0) ELSE 0 END))::DOUBLE AS score, "
            f"{cols} FROM review_docs")


KNOWN_DISCIPLINES = ", ".join(q(d) for d in C.DISCIPLINE_WEIGHTS)
DISCIPLINE = (f"CASE WHEN json_extract_string(ok, '$.discipline') IN ({KNOWN_DISCIPLINES}) THEN json_extract_string(ok, '$.discipline') "
              f"ELSE 'computer_science' END")
CTES["review_docs"] = "SELECT doc_id, CASE WHEN json_valid(review_json) THEN CAST(review_json AS JSON) END AS ok FROM reviews"
CTES["review_layers"] = " UNION ALL ".join(layer_select(n, i) for i, n in enumerate(C.MODEL_LAYERS))
ORACLES["s5_parse_reviews"] = "SELECT * EXCLUDE (ord) FROM review_layers"
CTES["keyed"] = "SELECT doc_id, sha256(text) AS content_digest FROM documents"
CTES["stored"] = "SELECT content_digest, min(doc_id) AS stored_doc FROM keyed WHERE doc_id % 3 = 0 GROUP BY content_digest"
ORACLES["s9_incremental"] = "SELECT doc_id, coalesce(stored_doc, -1) AS stored_doc FROM keyed LEFT JOIN stored USING (content_digest)"
ORACLES["s9_merge_store"] = """SELECT * FROM stored UNION ALL SELECT content_digest, min(doc_id) FROM keyed
WHERE doc_id % 7 <> 0 AND content_digest NOT IN (SELECT content_digest FROM stored) GROUP BY content_digest"""
ORACLES["s9_result_store"] = ORACLES["s9_merge_store"]

# --- reviews and scores --------------------------------------------------------


def calibrated(x: str) -> str:
    stretched = f"greatest(0.0::DOUBLE, least(10.0::DOUBLE, 7.0::DOUBLE + ({x} - 7.0::DOUBLE) * 1.5::DOUBLE))"
    return f"(CASE WHEN {x} <= 0 THEN {x} ELSE {round_py(stretched)} END)"


CITE_SCORE = "CAST(doc_id * 3 % 21 AS DOUBLE) / 2.0::DOUBLE"
CTES["calibrated_layers"] = f"""
SELECT doc_id, discipline, ord, layer, {calibrated('score')} AS score, issues FROM review_layers
UNION ALL SELECT doc_id, {DISCIPLINE}, 4, 'citations', {CITE_SCORE}, 'citation issue' FROM review_docs WHERE doc_id % 7 <> 0"""
WEIGHTS = ", ".join(f"({q(d)}, {q(l)}, {w[i]}::DOUBLE, {C.max_marks(w[i])})"
                    for d, w in C.DISCIPLINE_WEIGHTS.items() for i, l in enumerate(C.LAYERS))
CTES["weights"] = f"SELECT * FROM (VALUES {WEIGHTS}) AS t(discipline, layer, weight, max_marks)"
layer_sum = " + ".join(
    f"coalesce(max(score) FILTER (layer = '{l}'), 0.0::DOUBLE) * max(weight) FILTER (layer = '{l}')" for l in C.LAYERS)
layer_cols = ", ".join(f"coalesce(max(score) FILTER (layer = '{l}'), 0.0::DOUBLE) AS {l}" for l in C.LAYERS)


def final_scores(source: str) -> str:
    final = round_py(f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, (0.0::DOUBLE + {layer_sum}) * 10.0::DOUBLE))")
    return f"""SELECT doc_id, discipline, {final} AS final_score, {layer_cols}
FROM (SELECT d.doc_id, d.discipline, w.layer, w.weight, c.score FROM (SELECT DISTINCT doc_id, discipline FROM {source}) d
  JOIN weights w USING (discipline) LEFT JOIN {source} c ON c.doc_id = d.doc_id AND c.layer = w.layer) GROUP BY doc_id, discipline"""


CTES["final_scores"] = final_scores("calibrated_layers")
LETTER = "CASE WHEN final_score >= 85 THEN 'A' WHEN final_score >= 70 THEN 'B' WHEN final_score >= 55 THEN 'C' WHEN final_score >= 40 THEN 'D' ELSE 'F' END"


def by_letter(values: dict) -> str:
    return f"CASE {LETTER} " + " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in values.items()) + " END"


ORACLES["r1_layer_rows"] = "SELECT doc_id, layer, score FROM review_layers"
ORACLES["r2_calibrate"] = "SELECT doc_id, layer, score FROM calibrated_layers"
ORACLES["r3_resolve_discipline"] = f"""SELECT doc_id, CASE WHEN d IN ({KNOWN_DISCIPLINES}) THEN d ELSE 'computer_science' END AS discipline
FROM (SELECT doc_id, json_extract_string(ok, '$.discipline') AS d FROM review_docs)"""
ORACLES["r4_weighted_score"] = "SELECT doc_id, discipline, final_score FROM final_scores"
CTES["other_weights"] = """SELECT * FROM weights WHERE discipline <> 'physics' UNION ALL
SELECT 'physics', layer, weight, max_marks FROM weights WHERE discipline = 'mathematics' AND layer <> 'citations'"""
ORACLES["r4_weighted_score_by_table"] = f"""
SELECT doc_id, discipline, {round_py("greatest(0.0::DOUBLE, least(100.0::DOUBLE, total * 10.0::DOUBLE))")} AS final_score, earned FROM (
  SELECT doc_id, discipline, list_reduce(list(score * weight ORDER BY ord), lambda a, b: a + b) AS total,
    string_agg(CAST(round_even(score * max_marks / 10.0::DOUBLE, 0) AS BIGINT), ',' ORDER BY ord) AS earned
  FROM (SELECT d.doc_id, d.discipline, w.weight, w.max_marks, coalesce(c.score, 0.0::DOUBLE) AS score, list_position({list(C.LAYERS)}, w.layer) AS ord
    FROM (SELECT DISTINCT doc_id, discipline FROM calibrated_layers) d JOIN other_weights w USING (discipline)
    LEFT JOIN calibrated_layers c ON c.doc_id = d.doc_id AND c.layer = w.layer) GROUP BY doc_id, discipline)"""
ORACLES["r5_grade"] = f"SELECT doc_id, {by_letter(C.GRADE_TEXT)} AS grade FROM final_scores"
ORACLES["r6_marks"] = """SELECT doc_id, layer, CAST(max_marks AS BIGINT) AS max_marks,
CAST(round_even(score * max_marks / 10.0::DOUBLE, 0) AS BIGINT) AS earned FROM calibrated_layers JOIN weights USING (discipline, layer)"""
ORACLES["r7_worst_layers"] = f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score, ord) - 1 AS rank, layer, score,
concat(CASE layer {' '.join(f"WHEN '{k}' THEN {q(v)}" for k, v in C.LAYER_LABEL.items())} END, ': ', string_split(issues, '|')[1]) AS issue
FROM calibrated_layers QUALIFY rank < 2"""
ORACLES["r8_verdict"] = "SELECT doc_id, CASE " + LETTER + " " + " ".join(
    f"WHEN '{k}' THEN concat({q(C.VERDICT_TEXT[k][0])}, CAST(final_score AS VARCHAR), {q(C.VERDICT_TEXT[k][1])})" for k in "ABC"
) + f" ELSE concat({q(C.VERDICT_TEXT['*'][0])}, CAST(final_score AS VARCHAR), {q(C.VERDICT_TEXT['*'][1])}) END AS verdict_text FROM final_scores"
ORACLES["r9_labels"] = f"""SELECT doc_id, {LETTER} AS letter, {by_letter({g[1]: g[2] for g in C.GRADES})} AS grade_label,
 {by_letter(C.QUALITY_TITLE)} AS quality_title, {by_letter(C.RECOMMENDATION)} AS recommendation,
 {by_letter(C.DASHBOARD_RECOMMENDATION)} AS dashboard_recommendation, {by_letter(C.SCORE_DESCRIPTION)} AS description FROM final_scores"""
ORACLES["r10_bands"] = """SELECT doc_id, CASE WHEN final_score >= 85 THEN 'emerald' WHEN final_score >= 70 THEN 'cyan' WHEN final_score >= 55 THEN 'amber' ELSE 'red' END AS gauge, """ + ", ".join(
    f"CASE WHEN {l} / 10.0::DOUBLE >= 0.8::DOUBLE THEN 'success' WHEN {l} / 10.0::DOUBLE >= 0.6::DOUBLE THEN 'warning' ELSE 'danger' END AS {l}" for l in C.LAYERS) + " FROM final_scores"
CTES["confidences1"] = CTES["confidences"].replace("FROM sections", "FROM (SELECT *, 1 AS tier FROM sections1)")
ORACLES["r10_confidence_bands"] = """SELECT section, CASE WHEN confidence >= 85 THEN 'success' WHEN confidence >= 70 THEN 'warning' ELSE 'danger' END AS band,
count(*) AS n FROM confidences1 GROUP BY ALL"""
ORACLES["r11_quota_flag"] = "SELECT doc_id, final_score = 0 AND " + " AND ".join(f"{l} = 0" for l in C.MODEL_LAYERS) + " AS quota_suspected FROM final_scores"
ORACLES["c11_score_drift"] = """SELECT doc_id, layer, score_a, score_b, delta, max(delta) OVER (PARTITION BY doc_id) AS max_delta,
 CASE WHEN delta <= 0.5 THEN 'OK' ELSE 'DRIFT' END AS status
FROM (SELECT a.doc_id, a.layer, a.score AS score_a, coalesce(b.score, 0) AS score_b, abs(coalesce(b.score, 0) - a.score) AS delta
  FROM review_layers a LEFT JOIN calibrated_layers b ON a.doc_id = b.doc_id AND a.layer = b.layer)"""

# --- batch validation ------------------------------------------------------------

CTES["results"] = D.results_sql(DD)
CTES["meta"] = D.meta_sql(DD)
CTES["answers"] = "SELECT *, CAST(response_json AS JSON) AS j FROM results WHERE response_json IS NOT NULL"
CTES["missing_rows"] = "SELECT paper, concat_ws(',', " + ", ".join(
    f"CASE WHEN json_type(j, '$.{k}') IS NULL THEN '{k}' END" for k in C.RESULT_KEYS) + ") AS missing FROM answers"
GRADE_LIST = "[" + ", ".join(f"'{g}'" for g in C.GRADE_TEXT.values()) + "]"
CTES["range_rows"] = " UNION ALL ".join(
    f"SELECT paper, concat('layer_scores.{l} out of range [0,10]: ', CAST(v AS VARCHAR)) AS error FROM (SELECT paper, CAST(json_extract(j, '$.layer_scores.{l}') AS DOUBLE) AS v FROM answers) WHERE v < 0 OR v > 10"
    for l in C.LAYERS) + f"""
UNION ALL SELECT paper, concat('final_score out of range [0,100]: ', CAST(v AS VARCHAR)) FROM (SELECT paper, CAST(json_extract(j, '$.final_score') AS DOUBLE) AS v FROM answers) WHERE v < 0 OR v > 100
UNION ALL SELECT paper, concat({q("Invalid grade: '")}, g, {q("' (expected one of " + GRADE_LIST + ")")}) FROM (SELECT paper, json_extract_string(j, '$.grade') AS g FROM answers)
WHERE g NOT IN ({', '.join(q(g) for g in C.GRADE_TEXT.values())})"""


def warn(l: str) -> str:
    p = f"$.layer_details.{l}"
    zero = f"CASE WHEN CAST(json_extract(j, '{p}.score') AS DOUBLE) = 0 THEN 'layer {l} returned score 0 — possible analysis failure' END" if l != "citations" else "NULL"
    return f"""CASE WHEN json_type(j, '{p}') IS NULL THEN 'Missing layer_details entry: {l}' END,
 CASE WHEN json_array_length(j, '{p}.issues') = 0 THEN {q(f"layer_details.{l} 'issues' is empty or not a list")} END, {zero}"""


CTES["layer_warnings"] = "SELECT paper, concat_ws('|', " + ", ".join(warn(l) for l in C.LAYERS) + ") AS warnings, concat_ws(',', " + ", ".join(
    f"CASE WHEN contains(CAST(json_extract(j, '$.layer_details.{l}.issues') AS VARCHAR), {q(C.STALE_FALLBACK_ISSUE)}) OR json_extract_string(j, '$.layer_details.{l}.analysis_failed') = 'true' THEN '{l}' END" for l in C.LAYERS) + ") AS fallback FROM answers"
shown = " ".join(f"WHEN '{d}' THEN '{k}'" for k, d, _ in C.SECTIONS)
CTES["gap_rows"] = f"""
SELECT paper, section FROM (SELECT paper, unnest(string_split(expected, ',')) AS section FROM meta) e JOIN answers USING (paper)
WHERE section NOT IN (SELECT CASE k {shown} ELSE lower(k) END FROM (SELECT unnest(json_keys(j, '$.detected_sections')) AS k))"""
CTES["cite_facts"] = """
SELECT paper, has_dois, expected_ref_count, CAST(json_extract(j, '$.citation_result.total_refs') AS BIGINT) AS refs,
 CAST(json_extract(j, '$.citation_result.verified') AS BIGINT) AS verified, json_array_length(j, '$.citation_result.flagged_dois') AS flagged
FROM answers LEFT JOIN meta USING (paper)"""
CTES["cite_gaps"] = """
SELECT paper, 'citation_extraction_failure' AS gap_type, concat('Expected ~', expected_ref_count, ' refs but found 0') AS detail FROM cite_facts WHERE expected_ref_count > 5 AND refs = 0
UNION ALL SELECT paper, 'doi_extraction_failure', concat('Paper expected to have DOIs but none were extracted (total_refs=', refs, ')') FROM cite_facts WHERE has_dois AND refs > 0 AND verified = 0 AND flagged = 0"""
CTES["artifacts"] = """SELECT paper, CASE WHEN coalesce(report_size_bytes, 0) <= 0 THEN 'Report PDF not found'
 WHEN report_size_bytes < 5000 THEN concat('Report PDF too small (', report_size_bytes, ' bytes, expected ≥5000)') END AS error FROM results"""
CTES["error_rows"] = """
SELECT paper, concat('Missing schema keys: [''', replace(missing, ',', ''', '''), ''']') AS error FROM missing_rows WHERE missing <> ''
UNION ALL SELECT * FROM range_rows
UNION ALL SELECT paper, concat('Report PDF: ', a.error) FROM artifacts a JOIN answers USING (paper) WHERE a.error IS NOT NULL
UNION ALL SELECT paper, concat('Analysis failed: ', coalesce(error, 'unknown error')) FROM results WHERE response_json IS NULL"""
CTES["warning_counts"] = """
SELECT paper, sum(n) AS n FROM (
  SELECT paper, CASE WHEN warnings = '' THEN 0 ELSE len(string_split(warnings, '|')) END + CASE WHEN fallback <> '' THEN 1 ELSE 0 END AS n FROM layer_warnings
  UNION ALL SELECT paper, 1 FROM gap_rows GROUP BY paper UNION ALL SELECT paper, count(*) FROM cite_gaps GROUP BY paper) GROUP BY paper"""
CTES["statuses"] = """
SELECT r.paper, a.j IS NOT NULL AND missing = '' AS schema_ok, a.j IS NOT NULL AND r.paper NOT IN (SELECT paper FROM range_rows) AS score_ranges_ok,
 a.j IS NOT NULL AND warnings = '' AND fallback = '' AS layer_details_ok, a.j IS NOT NULL AND f.error IS NULL AS report_pdf_ok,
 CASE WHEN e.n > 0 THEN 'FAIL' WHEN w.n > 0 THEN 'WARN' ELSE 'PASS' END AS status,
 CAST(coalesce(w.n, 0) AS BIGINT) AS n_warnings, coalesce(e.n, 0) AS n_errors, CAST(json_extract(a.j, '$.final_score') AS DOUBLE) AS final_score, r.analyze_time_ms AS ms
FROM results r LEFT JOIN answers a USING (paper) LEFT JOIN missing_rows USING (paper) LEFT JOIN layer_warnings USING (paper) LEFT JOIN artifacts f USING (paper)
LEFT JOIN (SELECT paper, count(*) AS n FROM error_rows GROUP BY paper) e USING (paper) LEFT JOIN warning_counts w USING (paper)"""
CTES["finding_rows"] = """
SELECT paper, 'section_gap' AS kind, section AS item, NULL::VARCHAR AS detail FROM gap_rows
UNION ALL SELECT paper, 'citation_gap', gap_type, detail FROM cite_gaps
UNION ALL SELECT paper, 'fallback_layer', unnest(string_split(fallback, ',')), NULL FROM layer_warnings WHERE fallback <> ''
UNION ALL SELECT paper, 'error', error, NULL FROM error_rows"""
ORACLES["q1_check_schema"] = "SELECT * FROM missing_rows"
ORACLES["q2_check_ranges"] = "SELECT * FROM range_rows"
ORACLES["q3_check_layers"] = "SELECT * FROM layer_warnings"
ORACLES["q4_section_gaps"] = "SELECT * FROM gap_rows"
ORACLES["q5_citation_gaps"] = "SELECT * FROM cite_gaps"
ORACLES["q6_check_artifacts"] = "SELECT * FROM artifacts"
ORACLES["q7_validate"] = "SELECT * EXCLUDE (final_score, ms) FROM statuses"
ORACLES["q8_run_summary"] = """
SELECT count(*) AS total, count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'WARN') AS warn, count(*) FILTER (status = 'FAIL') AS fail,
 round(avg(final_score), 6) AS avg_score, round(avg(ms) FILTER (ms > 0), 6) AS avg_time_ms,
 (SELECT count(*) FROM finding_rows WHERE kind = 'fallback_layer') AS total_fallback_layers, (SELECT count(*) FROM gap_rows) AS total_section_gaps,
 (SELECT count(*) FROM cite_gaps) AS total_citation_gaps, CAST(sum(n_warnings) AS BIGINT) AS total_warnings, CAST(sum(n_errors) AS BIGINT) AS total_errors
FROM statuses"""
ORACLES["q9_findings"] = "SELECT * FROM finding_rows"
ORACLES["q10_run_verdict"] = """SELECT CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'FAILURES DETECTED'
 WHEN count(*) FILTER (status = 'WARN') > 0 THEN 'WARNINGS FOUND' ELSE 'ALL CLEAR' END AS verdict FROM statuses"""
ORACLES["q11_batch_counts"] = """SELECT category, count(*) FILTER (analyze_status = 200) AS success, count(*) FILTER (analyze_status <> 200) AS failed,
 round(avg(analyze_time_ms), 6) AS avg_time_ms, CAST(quantile_disc(analyze_time_ms, 0.5) AS BIGINT) AS median_time_ms FROM results GROUP BY category"""
ORACLES["q8_observed_summary"] = ORACLES["q8_run_summary"]
ORACLES["q11_merged_counts"] = """SELECT category, count(*) FILTER (analyze_status = 200) AS success, count(*) FILTER (analyze_status <> 200) AS failed,
 round(avg(analyze_time_ms), 6) AS avg_time_ms, CAST(quantile_disc(analyze_time_ms, 0.5) AS BIGINT) AS p50_time_ms,
 CAST(quantile_disc(analyze_time_ms, 0.9) AS BIGINT) AS p90_time_ms FROM results GROUP BY category"""
ORACLES["s6_old_shapes"] = """
SELECT paper, j IS NOT NULL AS readable, TRY_CAST(json_extract_string(j, '$.final_score') AS DOUBLE) AS final_score, json_extract_string(j, '$.grade') AS grade,
  CAST(coalesce(json_extract(j, '$.citation_result.total_refs'), json_extract(j, '$.citations.total_refs')) AS BIGINT) AS total_refs,
  CAST(coalesce(json_extract(j, '$.citation_result.verified'), json_extract(j, '$.citations.verified')) AS BIGINT) AS verified,
  CASE WHEN j IS NULL THEN '' ELSE array_to_string(list_sort(list_filter(json_keys(j), lambda k: k IN ('reviewer', 'mark', 'score'))), ',') END AS unknown,
  CAST(json_extract(j, '$.layer_scores.citations') AS DOUBLE) AS citations
FROM (SELECT paper, CASE WHEN json_valid(old) THEN CAST(old AS JSON) END AS j FROM (SELECT paper, CASE CAST(regexp_extract(paper, '([0-9]+)', 1) AS BIGINT) % 6
  WHEN 1 THEN replace(response_json, '"citation_result"', '"citations"') WHEN 2 THEN replace(response_json, '"grade":"', '"reviewer":"me","mark":"')
  WHEN 3 THEN replace(response_json, '"final_score":', '"final_score":"high","score":') WHEN 4 THEN 'oops ' || response_json ELSE response_json END AS old FROM results))"""
ORACLES["e3_validate_batch"] = "SELECT kind, item, count(*) AS n FROM finding_rows GROUP BY kind, item"

# --- whole jobs ------------------------------------------------------------------

# The job scores the references of the two-tier sections, the V queries those of the first tier; short
# notes, one per fortieth paper, are rejected, and every twenty-ninth paper has no review.
FAILED = "doc_id % 29 = 7"
CTES["job_reviews"] = f"""
SELECT doc_id, CASE WHEN {FAILED} THEN 'computer_science' ELSE discipline END AS discipline, {FAILED} OR analysis_failed AS failed, layer,
  CASE WHEN {FAILED} THEN 0.0::DOUBLE ELSE score END AS raw, {calibrated('score')} AS own,
  CASE WHEN {FAILED} THEN {q(C.FALLBACK_ISSUE)} ELSE issues END AS issues,
  CASE WHEN {FAILED} THEN {q(C.FALLBACK_SUGGESTION)} ELSE suggestions END AS suggestions FROM review_layers"""
CTES["job_layers"] = f"""
SELECT doc_id, discipline, layer, CASE WHEN {FAILED} THEN 0.0::DOUBLE ELSE own END AS score FROM job_reviews
UNION ALL SELECT s.doc_id, r.discipline, 'citations', s.score FROM scores s JOIN (SELECT DISTINCT doc_id, discipline FROM job_reviews) r USING (doc_id)"""
CTES["job_scores"] = final_scores("job_layers")
CTES["job_warnings"] = ORACLES["l12_section_warnings"]
CTES["job_failed"] = "SELECT DISTINCT doc_id, failed FROM job_reviews"
JOB = f"""
FROM job_scores JOIN prompts USING (doc_id) JOIN job_warnings USING (doc_id) JOIN citation_rows USING (doc_id) JOIN job_failed USING (doc_id)
JOIN papers USING (doc_id) WHERE length({strip('papers.text')}) >= 100"""
HEAD = f"""SELECT doc_id, substr(sha256(prompt), 1, 16) AS content_key, failed AS analysis_failed, section_count, final_score,
  {by_letter(C.GRADE_TEXT)} AS grade, total_refs, verified"""
ORACLES["e1_analyze_corpus"] = f"{HEAD}, warnings, discipline, {', '.join(C.LAYERS)} {JOB}"
ORACLES["e2_analyze_stream"] = f"{HEAD} {JOB}"
shown_name = "CASE section " + " ".join(f"WHEN {q(k)} THEN {q(d)}" for k, d, _ in C.SECTIONS) + " END"
CTES["job_detected"] = f"SELECT doc_id, string_agg({shown_name}, ',' ORDER BY {shown_name}) AS detected FROM sections GROUP BY doc_id"
CTES["job_flags"] = "SELECT doc_id, count(*) AS n_flagged FROM flag_rows WHERE doc_id IN (SELECT doc_id FROM scores WHERE NOT cleared) GROUP BY doc_id"
VERDICT = ORACLES["r8_verdict"].removeprefix("SELECT doc_id, ").removesuffix(" AS verdict_text FROM final_scores")
CTES["job_messages"] = ORACLES["v12_citation_messages"]
ORACLES["r12_analysis_record"] = f"""
SELECT l.doc_id, failed AS analysis_failed, l.layer, coalesce(r.raw, l.score) AS raw_score, coalesce(r.issues, m.issues) AS issues,
  coalesce(r.suggestions, m.suggestions) AS suggestions, l.score, CAST(w.max_marks AS BIGINT) AS max_marks, verdict_text,
  coalesce(detected, '') AS detected, c.unreachable, coalesce(n_flagged, 0) AS n_flagged
FROM job_layers l LEFT JOIN (SELECT doc_id, layer, raw, issues, suggestions FROM job_reviews) r ON r.doc_id = l.doc_id AND r.layer = l.layer
JOIN (SELECT doc_id, {VERDICT} AS verdict_text FROM job_scores) v ON v.doc_id = l.doc_id
JOIN weights w ON w.discipline = l.discipline AND w.layer = l.layer
JOIN citation_rows c ON c.doc_id = l.doc_id JOIN job_failed f ON f.doc_id = l.doc_id JOIN job_messages m ON m.doc_id = l.doc_id
LEFT JOIN job_detected d ON d.doc_id = l.doc_id LEFT JOIN job_flags g ON g.doc_id = l.doc_id
JOIN papers p ON p.doc_id = l.doc_id WHERE length({strip('p.text')}) >= 100"""
JOB_TABLES = {
    "papers": f"SELECT doc_id, text FROM ({CTES['papers']}) UNION ALL SELECT -1 - doc_id, 'Note on paper ' || doc_id FROM documents WHERE doc_id % 40 = 3",
    "refs": CTES["refs"].replace("sections1 s", "sections s"),
}
OVERRIDES["e1_analyze_corpus"] = OVERRIDES["r12_analysis_record"] = JOB_TABLES
OVERRIDES["e2_analyze_stream"] = {**JOB_TABLES, "links": CTES["links"] + " LIMIT 0"}
CTES["feed"] = D.feed_sql(DD)
ORACLES["s3_read_feed"] = """
SELECT arxiv_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, coalesce(href, 'https://arxiv.org/pdf/' || arxiv_id || '.pdf') AS pdf_url
FROM (SELECT *, regexp_extract(id, '/abs/([0-9.]+)v', 1) AS arxiv_id FROM feed)"""
ORACLES["s6_read_results"] = """
SELECT paper, category, CAST(analyze_status AS BIGINT) AS analyze_status, error, json_extract_string(j, '$.grade') AS grade,
  CAST(json_extract(j, '$.final_score') AS DOUBLE) AS final_score, CAST(json_extract(j, '$.citation_result.total_refs') AS BIGINT) AS total_refs,
  CAST(json_extract(j, '$.layer_scores.citations') AS DOUBLE) AS citations,
  CASE WHEN j IS NOT NULL THEN array_to_string(CAST(json_extract_string(j, '$.citation_result.flagged_dois[*]') AS VARCHAR[]), ',') END AS flagged
FROM (SELECT *, CAST(response_json AS JSON) AS j FROM results)"""
ORACLES["s7_write_results"] = "SELECT category, count(*) AS n, CAST(sum(analyze_time_ms) AS BIGINT) AS ms FROM results GROUP BY category"
ORACLES["c8_compress_sections_off"] = "SELECT doc_id, section, text AS compressed FROM sections"
ORACLES["c8_compress_sections_aggressive"] = f"""
SELECT a.doc_id, CASE WHEN a.section = 'related_work' THEN 'survey' ELSE a.section END AS section, CASE WHEN a.section = 'references' THEN a.text
  WHEN a.section IN ('abstract', 'methodology', 'conclusion') THEN n
  WHEN a.section = 'related_work' THEN {normalize_ws(drop_formula('dd', True))} ELSE {normalize_ws('dd')} END AS compressed
FROM comp_a a LEFT JOIN comp_dedup_b d ON a.doc_id = d.doc_id AND a.section = d.section"""
