"""Readers: paper texts, links, feeds, batch results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholium.functions import references as RF
from scholium.functions.text import extract_all, strip, sub, uni

MIN_TEXT_CHARS = 100
TOO_SHORT = "Could not extract meaningful text"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores when the input is too small to be split across them.

    A small file is one row group, hence one task. Inputs with at least as many splits as the
    cluster has cores come back unchanged, so large corpora are never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def accept_papers(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split (doc_id, text) into usable papers and rejected ones with the reason."""
    size = F.length(strip(F.coalesce("text", F.lit(""))))
    accepted = papers.where(size >= MIN_TEXT_CHARS).select("doc_id", "text")
    rejected = papers.where(size < MIN_TEXT_CHARS).select(
        "doc_id", F.lit(TOO_SHORT).alias("reason"), size.alias("chars")
    )
    return accepted, rejected


def load_papers(spark: SparkSession, path: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """(papers, rejected) from parquet (doc_id, text), or from text files, one paper per file, its path the id."""
    if fmt == "text":
        raw = spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text")
        )
    else:
        raw = spark.read.format(fmt).load(path).select("doc_id", "text")
    return accept_papers(raw)


def hrefs(pages: DataFrame) -> DataFrame:
    """Link targets of web pages, in order."""
    found = extract_all(F.col("html"), RF.HREF)
    return pages.select("page_id", F.posexplode_outer(found).alias("link_no", "uri")).where(
        F.col("link_no").isNotNull()
    )


def link_dois(links: DataFrame) -> DataFrame:
    """Distinct DOIs of a document's links, in order of first occurrence: (doc_id, dois).

    Repeats collapse before the lists are built, so a list never exceeds the distinct DOIs.
    """
    found = links.select("doc_id", "link_no", RF.link_doi(F.col("uri")).alias("doi")).where(
        F.col("doi").isNotNull()
    )
    first = found.groupBy("doc_id", "doi").agg(F.min("link_no").alias("link_no"))
    return first.groupBy("doc_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("link_no", "doi"))), lambda x: x["doi"]
        ).alias("dois")
    )


def _text(col: Column) -> Column:
    return strip(sub(col, uni(r"\s+"), " "))


FEED_SCHEMA = (
    "id string, title string, link array<struct<_title:string,_href:string,_rel:string>>"
)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an Atom feed: (arxiv_id, title, pdf_url)."""
    raw = spark.read.format("xml").option("rowTag", "entry").schema(FEED_SCHEMA).load(path)
    arxiv_id = F.element_at(
        F.split(F.element_at(F.split(strip(F.col("id")), "/abs/"), -1), "v"), 1
    )
    pdf = F.filter("link", lambda l: l["_title"] == "pdf")
    default = F.concat(F.lit("https://arxiv.org/pdf/"), F.col("arxiv_id"), F.lit(".pdf"))
    return (
        raw.where(F.col("id").isNotNull() & F.col("title").isNotNull())
        .select(arxiv_id.alias("arxiv_id"), _text(F.col("title")).alias("title"),
                F.get(F.transform(pdf, lambda l: l["_href"]), F.lit(0)).alias("href"))
        .select("arxiv_id", "title", F.coalesce("href", default).alias("pdf_url"))
    )


def pick_first_available(candidates: DataFrame, fallback: DataFrame, k: int | None = None) -> DataFrame:
    """Per query its first available candidate (of the best ``k``, if given), else the available fallback.

    candidates: (name, priority, arxiv_id, title, available); fallback: same without priority.
    """
    tried = candidates
    if k is not None:
        top = Window.partitionBy("name").orderBy("priority")
        tried = candidates.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    both = tried.where("available").select(
        "name", "arxiv_id", "title", F.struct(F.lit(0).alias("kind"), F.col("priority").cast("long").alias("n")).alias("rank"),
        F.lit("arxiv_api").alias("source")
    ).unionByName(
        fallback.where("available").select(
            "name", "arxiv_id", "title", F.struct(F.lit(1).alias("kind"), F.lit(0).cast("long").alias("n")).alias("rank"),
            F.lit("arxiv_fallback").alias("source"))
    )
    best = both.groupBy("name").agg(F.min_by(F.struct("arxiv_id", "title", "source"), "rank").alias("b"))
    return best.select("name", "b.arxiv_id", "b.title", "b.source")


RESPONSE_SCHEMA = """struct<
  filename:string, detected_sections:map<string,int>, section_count:int, warnings:array<string>,
  layer_scores:map<string,double>,
  layer_details:map<string,struct<score:double,issues:array<string>,suggestions:array<string>,analysis_failed:boolean>>,
  final_score:double, grade:string,
  citation_result:struct<total_refs:int,verified:int,not_found:int,unreachable:int,
    flagged_dois:array<string>,
    flagged_items:array<struct<citation:string,category:string,detail:string>>>>"""
RESULT_SCHEMA = f"""
paper string, title string, category string, analyze_status int, analyze_time_ms bigint,
report_status int, report_size_bytes bigint, error string, analyze_response {RESPONSE_SCHEMA}
"""


def read_results(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """Batch records, nested and partly null, from JSON arrays or one object per file.

    ``by_line`` reads one record per line instead, as :func:`scholium.sources.incremental.write_results` writes them.
    """
    return spark.read.schema(RESULT_SCHEMA).option("multiLine", not by_line).json(path)


# Where a field of a response is found: in today's records, then in older ones.
RESPONSE_FIELDS = {
    "final_score": ("double", ["final_score"]),
    "grade": ("string", ["grade"]),
    "layer_scores": ("map<string,double>", ["layer_scores"]),
    "detected_sections": ("map<string,int>", ["detected_sections"]),
    "total_refs": ("int", ["citation_result.total_refs", "citations.total_refs"]),
    "verified": ("int", ["citation_result.verified", "citations.verified"]),
    "flagged_dois": ("array<string>", ["citation_result.flagged_dois", "citations.flagged_dois"]),
}
KNOWN_KEYS = [
    "filename", "detected_sections", "section_count", "warnings", "layer_scores", "layer_details", "final_score", "grade", "citation_result",
    "citations", "discipline", "layer_max_marks", "verdict_text",
]


def tolerant_responses(results: DataFrame) -> DataFrame:
    """Batch records of any shape: typed fields where they can be read, and what is not known.

    ``response_json`` is kept as it is, as VARIANT ``response`` (null where it is no JSON). A field that is absent, or of another
    type, is null; older names count. ``unknown`` are the keys that no field is read from, ``readable`` says whether there is JSON at all.
    """
    parsed = results.withColumn("response", F.try_parse_json("response_json"))

    def field(kind: str, paths: list[str]) -> Column:
        return F.coalesce(*[F.try_variant_get("response", F.lit(f"$.{p}"), kind) for p in paths])

    keys = F.when(F.col("response").isNotNull(), F.json_object_keys("response_json"))
    return parsed.select(
        *results.columns, "response", F.col("response").isNotNull().alias("readable"),
        *[field(*how).alias(name) for name, how in RESPONSE_FIELDS.items()],
        F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*map(F.lit, KNOWN_KEYS))).alias("unknown"),
    )


def response_shapes(results: DataFrame, by: str = "category") -> DataFrame:
    """The merged schema of all responses of a group, and how many there are: shows new and changed fields at a glance."""
    parsed = results.withColumn("response", F.try_parse_json("response_json")).where(F.col("response").isNotNull())
    return parsed.groupBy(by).agg(F.count("*").alias("n"), F.schema_of_variant_agg("response").alias("shape"))
