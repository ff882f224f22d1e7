"""Calibration, weighting, grades, marks and labels as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholium.constants import (
    CALIBRATION_CENTER, CALIBRATION_STRETCH, DEFAULT_DISCIPLINE, DISCIPLINE_WEIGHTS, GRADE_TEXT,
    GRADES, LAYERS, VERDICT_TEXT, max_marks,
)
from scholium.functions.text import round_exact


def lookup(values: dict, key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.try_element_at(pairs, key)


def clip(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def calibrate(score: Column) -> Column:
    """Stretch around the centre; 0 stays, as it marks a missing section."""
    stretched = F.lit(CALIBRATION_CENTER) + (score - CALIBRATION_CENTER) * CALIBRATION_STRETCH
    return F.when(score <= 0, score).otherwise(round_exact(clip(stretched, 0.0, 10.0), 1))


def resolve_discipline(col: Column) -> Column:
    return F.when(col.isin(list(DISCIPLINE_WEIGHTS)), col).otherwise(DEFAULT_DISCIPLINE)


def weight(discipline: Column, layer: str) -> Column:
    i = LAYERS.index(layer)
    return lookup({d: w[i] for d, w in DISCIPLINE_WEIGHTS.items()}, discipline)


def max_mark(discipline: Column, layer: Column) -> Column:
    table = {f"{d}/{l}": max_marks(w[i]) for d, w in DISCIPLINE_WEIGHTS.items()
             for i, l in enumerate(LAYERS)}
    return lookup(table, F.concat_ws("/", discipline, layer))


def weighted_score(scores: Column, discipline: Column) -> Column:
    """Final score 0..100 from a map of layer scores; missing layers count as 0."""
    total = F.lit(0.0)
    for layer in LAYERS:
        score = F.coalesce(F.try_element_at(scores, F.lit(layer)), F.lit(0.0))
        total = total + score * weight(discipline, layer)
    return round_exact(clip(total * 10.0, 0.0, 100.0), 1)


def grade_letter(score: Column) -> Column:
    rule = None
    for limit, letter, _ in GRADES:
        rule = F.when(score >= limit, letter) if rule is None else rule.when(score >= limit, letter)
    return rule.otherwise("F")


def grade(score: Column) -> Column:
    return lookup(GRADE_TEXT, grade_letter(score))


def earned_marks(score: Column, marks: Column) -> Column:
    return F.rint(score * marks / 10.0).cast("int")


def verdict(score: Column, letter: Column) -> Column:
    def sentence(key: str) -> Column:
        before, after = VERDICT_TEXT[key]
        return F.concat(F.lit(before), score.cast("string"), F.lit(after))

    return (
        F.when(letter == "A", sentence("A")).when(letter == "B", sentence("B"))
        .when(letter == "C", sentence("C")).otherwise(sentence("*"))
    )


def band(value: Column, steps: list[tuple[float, str]], last: str) -> Column:
    rule = None
    for limit, name in steps:
        rule = F.when(value >= limit, name) if rule is None else rule.when(value >= limit, name)
    return rule.otherwise(last)


def layer_band(score: Column) -> Column:
    return band(score / 10.0, [(0.80, "success"), (0.60, "warning")], "danger")


def confidence_band(confidence: Column) -> Column:
    return band(confidence, [(85, "success"), (70, "warning")], "danger")


def gauge_band(score: Column) -> Column:
    return band(score, [(85, "emerald"), (70, "cyan"), (55, "amber")], "red")
