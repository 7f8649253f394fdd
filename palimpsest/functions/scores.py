"""Pairwise features and the hybrid score as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.text import common_prefix

#: Fixed weights: cosine, lexical, heading by kind of pair.
SECTION = (0.74, 0.10, 0.08)
BODY = (0.82, 0.10, 0.04)
OTHER = (0.80, 0.10, 0.08)
SECTION_BONUS = 0.05
BODY_KINDS = ("paragraph", "bullet")


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def heading_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.size(a), F.size(b))
    return F.when((F.coalesce(F.size(a), F.lit(0)) < 1) | (F.coalesce(F.size(b), F.lit(0)) < 1), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(common_prefix(a, b) / longest)


def kind_compatibility(a: Column, b: Column) -> Column:
    return (
        F.when(a.isNull() | b.isNull(), F.lit(0.0))
        .when(a == b, F.when(a == "section", F.lit(1.0)).otherwise(F.lit(0.6)))
        .when(a.isin(*BODY_KINDS) & b.isin(*BODY_KINDS), F.lit(0.35))
        .otherwise(F.lit(-0.5))
    )


def token_balance(a: Column, b: Column) -> Column:
    x, y = F.greatest(a, F.lit(1)), F.greatest(b, F.lit(1))
    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(0.05 * F.least(x, y) / F.greatest(x, y))


def page_bonus(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.when(d.isNull(), F.lit(0.0)).when(d == 0, F.lit(0.03)).when(d == 1, F.lit(0.02)).when(d <= 3, F.lit(0.01)).otherwise(F.lit(0.0))


def kind_class(kind: Column) -> Column:
    """Kinds that may be matched with one another share a class."""
    return F.when(kind == "section", F.lit("section")).when(kind.isin(*BODY_KINDS), F.lit("body")).otherwise(kind)


def hybrid_score(cosine: Column, lexical: Column, heading: Column, page: Column, kind_a: Column, kind_b: Column, size: Column) -> Column:
    kind = kind_compatibility(kind_a, kind_b)
    mix = lambda w: w[0] * cosine + w[1] * lexical + w[2] * heading + page
    return (
        F.when((kind_a == "section") & (kind_b == "section"), mix(SECTION) + SECTION_BONUS + size)
        .when(kind_a.isin(*BODY_KINDS) & kind_b.isin(*BODY_KINDS), mix(BODY) + kind + size)
        .otherwise(mix(OTHER) + kind + size)
    )


def change_type(score: Column, unchanged: float) -> Column:
    return F.when(score >= unchanged, F.lit("unchanged")).otherwise(F.lit("modified"))


def change_rank(kind: Column) -> Column:
    out = F.lit(99)
    for i, name in enumerate(("unchanged", "modified", "split", "merged", "removed", "added")):
        out = F.when(kind == name, F.lit(i)).otherwise(out)
    return out
