"""Reviews to scores. Layers stay in one array per document, so scoring is a projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.constants import (
    DASHBOARD_RECOMMENDATION, DEFAULT_DISCIPLINE, FALLBACK_ISSUE, FALLBACK_SUGGESTION, GRADES, LAYER_LABEL, LAYERS,
    MODEL_LAYERS, NO_ISSUES, NO_SECTION_ISSUE, NO_SECTION_SUGGESTION, NO_SUGGESTIONS,
    QUALITY_TITLE, RECOMMENDATION, SCORE_DESCRIPTION,
)
from scholium.functions import scoring as SC
from scholium.functions.text import round_exact
from scholium.operators.frames import pin
from scholium.operators.lookup import lookup_join

LAYER_SCHEMA = "struct<score:string,issues:array<string>,suggestions:array<string>,analysis_failed:boolean>"


def _layer(name: str, score: Column, issues: Column, suggestions: Column) -> Column:
    return F.struct(
        F.lit(name).alias("layer"), score.alias("score"), issues.alias("issues"),
        suggestions.alias("suggestions"),
    )


def _one(text: str) -> Column:
    return F.array(F.lit(text))


def fallback_layers() -> Column:
    """The layers of a paper whose review is not to be had."""
    return F.array(*[_layer(n, F.lit(0.0), _one(FALLBACK_ISSUE), _one(FALLBACK_SUGGESTION)) for n in MODEL_LAYERS])


def parse_reviews(reviews: DataFrame) -> DataFrame:
    """(doc_id, analysis_failed, discipline, layers) from review JSON.

    Malformed JSON gives the fallback review. When a layer is absent the whole object stands in
    for every layer, so its own fields (usually none) and the defaults apply.
    """
    parsed = pin(
        reviews.select("doc_id", "review_json"),
        keys=F.json_object_keys("review_json"),
        top=F.from_json("review_json", "map<string,string>"),
    )
    failed = F.col("keys").isNull()
    # a stored review may say of a layer that its analysis failed
    marked_failed = F.exists(
        F.array(*map(F.lit, MODEL_LAYERS)),
        lambda n: F.coalesce(F.from_json(F.try_element_at("top", n), LAYER_SCHEMA)["analysis_failed"], F.lit(False)),
    )
    complete = F.size(F.array_intersect("keys", F.array(*map(F.lit, MODEL_LAYERS)))) == len(MODEL_LAYERS)

    def layer(name: str) -> Column:
        raw = F.when(complete, F.try_element_at("top", F.lit(name))).otherwise(F.col("review_json"))
        obj = F.from_json(raw, LAYER_SCHEMA)
        score = SC.clip(F.coalesce(obj["score"].try_cast("double"), F.lit(0.0)), 0.0, 10.0)
        is_object = F.coalesce(raw.startswith("{"), F.lit(False))
        return (
            F.when(failed, _layer(name, F.lit(0.0), _one(FALLBACK_ISSUE), _one(FALLBACK_SUGGESTION)))
            .when(~is_object, _layer(name, F.lit(0.0), _one(NO_SECTION_ISSUE),
                                     _one(NO_SECTION_SUGGESTION)))
            .otherwise(_layer(name, score, F.coalesce(obj["issues"], _one(NO_ISSUES)),
                              F.coalesce(obj["suggestions"], _one(NO_SUGGESTIONS))))
        )

    return pin(
        parsed,
        analysis_failed=failed | F.coalesce(marked_failed, F.lit(False)),
        discipline=SC.resolve_discipline(F.try_element_at("top", F.lit("discipline"))),
        layers=F.array(*[layer(n) for n in MODEL_LAYERS]),
    ).drop("review_json", "keys", "top")


def layer_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.posexplode_outer("layers").alias("ord", "x")).where(
        F.col("ord").isNotNull()
    ).select("doc_id", "ord", "x.*")


def calibrate(parsed: DataFrame) -> DataFrame:
    """Calibrates the model layers of a ``layers`` array, keeping ``raw``; citations pass unchanged."""

    def one(x: Column) -> Column:
        score = F.when(x["layer"] == "citations", x["score"]).otherwise(SC.calibrate(x["score"]))
        return x.withField("score", score).withField("raw", x["score"])

    return pin(parsed, layers=F.transform("layers", one))


def add_citations_layer(calibrated: DataFrame, results: DataFrame) -> DataFrame:
    """Appends the citations layer from citation results, joined on doc_id."""
    cites = results.select(
        "doc_id", _layer("citations", F.col("score"), F.col("issues"), F.col("suggestions"))
        .withField("raw", F.col("score")).alias("cites"))
    joined = calibrated.join(cites, "doc_id", "left")
    return joined.withColumn(
        "layers", F.concat("layers", F.filter(F.array("cites"), lambda c: c.isNotNull()))
    ).drop("cites")


def score_map(layers: Column) -> Column:
    return F.map_from_arrays(
        F.transform(layers, lambda x: x["layer"]), F.transform(layers, lambda x: x["score"])
    )


def resolve_discipline(df: DataFrame) -> DataFrame:
    return df.withColumn("discipline", SC.resolve_discipline(F.col("discipline")))


def weighted_score(layered: DataFrame) -> DataFrame:
    """Adds final_score and grade to (doc_id, discipline, layers)."""
    out = pin(layered, scores=score_map(F.col("layers")))
    out = pin(out, final_score=SC.weighted_score(F.col("scores"), F.col("discipline")))
    return out.withColumn("grade", SC.grade(F.col("final_score")))


def weight_table(weights: DataFrame) -> DataFrame:
    """(discipline, weights): the rows (discipline, layer, ord, weight, max_marks) of a discipline, in order."""
    row = F.struct("ord", "layer", "weight", "max_marks")
    return weights.groupBy("discipline").agg(F.sort_array(F.collect_list(row)).alias("weights"))


def weighted_score_by(layered: DataFrame, weights: DataFrame) -> DataFrame:
    """As :func:`weighted_score`, with the weights of a table; adds ``marks`` too, (layer, max_marks, earned) of every weighted layer.

    A discipline without weights scores like ``DEFAULT_DISCIPLINE``. The table's rows come to the papers by a look-up, which the planner sends
    around only if they are small enough.
    """
    table = weight_table(weights)
    known = lookup_join(layered, table, "discipline")
    fallback = table.where(F.col("discipline") == DEFAULT_DISCIPLINE).select("weights").scalar()
    out = pin(known, scores=score_map(F.col("layers")), weights=F.coalesce("weights", fallback))

    def score_of(w: Column) -> Column:
        return F.coalesce(F.try_element_at("scores", w["layer"]), F.lit(0.0))

    total = F.aggregate("weights", F.lit(0.0), lambda t, w: t + score_of(w) * w["weight"])
    out = pin(out, final_score=round_exact(SC.clip(total * 10.0, 0.0, 100.0), 1), marks=F.transform("weights", lambda w: F.struct(
        w["layer"].alias("layer"), w["max_marks"].alias("max_marks"), SC.earned_marks(score_of(w), w["max_marks"]).alias("earned"))))
    return out.drop("weights").withColumn("grade", SC.grade(F.col("final_score")))


def marks(layered: DataFrame) -> DataFrame:
    """Maximum and earned marks per layer; the maxima of a discipline may add to 99 or 101."""
    rows = layered.select(
        "doc_id", "discipline", F.explode_outer("layers").alias("x")
    ).select("doc_id", "discipline", "x.layer", "x.score").where(F.col("layer").isNotNull())
    limit = SC.max_mark(F.col("discipline"), F.col("layer"))
    return rows.withColumn("max_marks", limit).withColumn(
        "earned", SC.earned_marks(F.col("score"), F.col("max_marks")))


def worst(layers: Column, k: int = 2) -> Column:
    """The ``k`` lowest layers, ties by layer order, with their first issue."""
    ranked = F.sort_array(F.transform(
        layers,
        lambda x, i: F.struct(
            x["score"].alias("score"), i.alias("ord"), x["layer"].alias("layer"),
            F.get(x["issues"], F.lit(0)).alias("issue"),
        ),
    ))
    return F.slice(ranked, 1, k)


def worst_layers(layered: DataFrame, k: int = 2) -> DataFrame:
    rows = layered.select("doc_id", F.posexplode_outer(worst(F.col("layers"), k)).alias("rank", "w"))
    return rows.where(F.col("rank").isNotNull()).select(
        "doc_id", "rank", "w.layer", "w.score",
        F.concat(SC.lookup(LAYER_LABEL, F.col("w.layer")), F.lit(": "), F.col("w.issue")).alias("issue"),
    )


def verdict(scored: DataFrame) -> DataFrame:
    letter = SC.grade_letter(F.col("final_score"))
    return scored.withColumn("verdict_text", SC.verdict(F.col("final_score"), letter))


def labels(scored: DataFrame) -> DataFrame:
    letter = SC.grade_letter(F.col("final_score"))
    return scored.select(
        "doc_id", letter.alias("letter"),
        SC.lookup({g[1]: g[2] for g in GRADES}, letter).alias("grade_label"),
        SC.lookup(QUALITY_TITLE, letter).alias("quality_title"),
        SC.lookup(RECOMMENDATION, letter).alias("recommendation"),
        SC.lookup(DASHBOARD_RECOMMENDATION, letter).alias("dashboard_recommendation"),
        SC.lookup(SCORE_DESCRIPTION, letter).alias("description"),
    )


def bands(scored: DataFrame) -> DataFrame:
    """Gauge band of the score and the band of every layer."""
    return scored.select(
        "doc_id", SC.gauge_band(F.col("final_score")).alias("gauge"),
        *[SC.layer_band(F.coalesce(F.try_element_at("scores", F.lit(l)), F.lit(0.0))).alias(l)
          for l in LAYERS],
    )


def quota_flag(scored: DataFrame) -> DataFrame:
    """Suspected quota failure: final score and all model layers are 0."""
    zero = F.col("final_score") == 0
    for layer in MODEL_LAYERS:
        zero = zero & (F.coalesce(F.try_element_at("scores", F.lit(layer)), F.lit(0.0)) == 0)
    return scored.select("doc_id", zero.alias("quota_suspected"))
