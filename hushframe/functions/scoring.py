"""Evidence to score to action.  Each scorer takes boolean columns and gives (score, action, reasons)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AUTO, REVIEW = 0.85, 0.50


def _check(auto: float, review: float) -> None:
    if not 0 <= review <= auto <= 1:
        raise ValueError("thresholds must satisfy 0 <= review <= auto <= 1")


def _sum(evidence: list[tuple[Column, float, str]], extra: list[tuple[Column, str]] = []) -> tuple[Column, Column]:  # noqa: B006
    """Weights are thousandths, so that sums are exact."""
    score = F.lit(0)
    reasons = []
    for seen, weight, name in evidence:
        seen = F.coalesce(seen, F.lit(False))
        score = score + F.when(seen, F.lit(round(weight * 1000))).otherwise(F.lit(0))
        reasons.append(F.when(seen, F.lit(name)))
    reasons += [F.when(F.coalesce(seen, F.lit(False)), F.lit(name)) for seen, name in extra]
    return F.least(score, F.lit(1000)), F.array_compact(F.array(*reasons))


def _result(points: Column, action: Column, reasons: Column) -> Column:
    return F.struct((points / F.lit(1000.0)).alias("score"), action.alias("action"), reasons.alias("reasons"))


def body_name(label: Column, role: Column, boundary: Column, distance: Column, position: Column, region_state: Column, auto: float = AUTO, review: float = REVIEW) -> Column:
    """A person's name in a public document."""
    _check(auto, review)
    points, reasons = _sum(
        [
            (label, 0.5, "authoritative_label"),
            (role, 0.6, "approval_role"),
            (boundary, 0.1, "label_boundary"),
            (distance.between(0, 12), 0.1, "label_distance"),
            (position, 0.05, "page_position"),
            (region_state.isin("confirmed", "user_confirmed"), 0.1, "confirmed_region"),
            (region_state == "user_confirmed", 0.05, "user_confirmed_region"),
        ]
    )
    action = F.when(points >= round(auto * 1000), "auto_mask").when(points >= round(review * 1000), "review").otherwise("preserve")
    return _result(points, action, reasons)


def _never_dropped(points: Column, allowed: Column, auto: float) -> Column:
    return F.when(allowed & (points >= round(auto * 1000)), "auto_mask").otherwise("review")


def region_value(label: Column, hierarchy: Column, boundary: Column, quoted: Column, dictionary: Column | None = None, auto: float = AUTO, review: float = REVIEW) -> Column:
    """A region's name; a dictionary hit alone is for review, never dropped."""
    _check(auto, review)
    found = F.lit(True) if dictionary is None else dictionary
    points, reasons = _sum(
        [(found, 0.4, "region_dictionary"), (label, 0.25, "region_label"), (hierarchy, 0.2, "hierarchical_region"), (boundary, 0.1, "exact_boundary")],
        [(quoted, "quoted_context")],
    )
    return _result(points, _never_dropped(points, ~F.coalesce(quoted, F.lit(False)), auto), reasons)


def institution_value(pattern: Column, label: Column, boundary: Column, independent: Column, quoted: Column, auto: float = AUTO, review: float = REVIEW) -> Column:
    _check(auto, review)
    points, reasons = _sum(
        [(pattern, 0.45, "institution_pattern"), (label, 0.3, "institution_label"), (boundary, 0.1, "exact_boundary"), (independent, 0.1, "independent_context")],
        [(quoted, "quoted_context")],
    )
    return _result(points, _never_dropped(points, ~F.coalesce(quoted, F.lit(False)), auto), reasons)


def institution_address(pattern: Column, label: Column, footer: Column, boundary: Column, auto: float = AUTO, review: float = REVIEW) -> Column:
    """Always for review."""
    _check(auto, review)
    points, reasons = _sum(
        [(pattern, 0.4, "address_pattern"), (label, 0.25, "address_label"), (footer, 0.2, "footer_contact_context"), (boundary, 0.1, "exact_boundary")]
    )
    return _result(points, F.lit("review"), reasons)


def region_evidence(box: Column, label: Column, structure: Column, distance: Column, position: Column, confidence: Column, cap: Column | float = 96.0, least_confidence: float = 0.8) -> Column:
    """(score, state, missing) of a layout region: confirmed with all evidence, unconfirmed with little."""
    near = F.coalesce(distance <= cap, F.lit(False))
    flag = lambda c: F.coalesce(c, F.lit(False))
    missing = F.array_compact(
        F.array(
            F.when(confidence.isNull(), "ocr_confidence_missing").when(confidence < least_confidence, "ocr_confidence_uncertain"),
            F.when(~flag(box), "box_structure_missing"),
            F.when(~flag(label), "label_evidence_missing"),
            F.when(~flag(structure), "layout_structure_missing"),
            F.when(distance.isNull(), "label_value_distance_missing").when(~near, "label_value_distance_out_of_range"),
            F.when(~flag(position), "page_position_evidence_missing"),
        )
    )
    points = F.lit(0)
    for seen, weight in ((box, 3), (label, 3), (near, 2), (position, 2)):
        points = points + F.when(flag(seen), F.lit(weight)).otherwise(F.lit(0))
    state = F.when((points == 10) & (F.size(missing) == 0), "confirmed").when(points < 5, "unconfirmed").otherwise("review_required")
    return F.struct(points.alias("score"), state.alias("state"), missing.alias("missing"))
