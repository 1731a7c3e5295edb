"""Warnings, scores and reports on extracted papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.schema import CONFIDENCE_FIELDS, LIST_FIELDS, PAPER_FIELDS, SCORED_FIELDS


def warnings_of(least_words: int = 8) -> Column:
    """array<struct<field, warning>> of a paper's row."""
    words = F.size(F.array_remove(F.split(T.collapse(F.coalesce("methodology", F.lit(""))), " "), ""))
    w = lambda field, said: F.struct(F.lit(field).alias("field"), F.lit(said).alias("warning"))
    none = F.when(F.coalesce(F.size("datasets"), F.lit(0)) <= 0, w("datasets", "No datasets were extracted."))
    short = F.when(words < least_words, w("methodology", f"Methodology is shorter than {least_words} words."))
    return F.array_compact(F.array(none, short))


def quality_warnings(papers: DataFrame) -> DataFrame:
    return papers.select("paper_id", F.inline(warnings_of()))


def _present(field: str) -> Column:
    if field in LIST_FIELDS:
        return F.coalesce(F.size(field), F.lit(0)) > 0
    if field == "confidence":
        return F.greatest(*[F.coalesce(f"confidence.{c}", F.lit(0.0)) for c in CONFIDENCE_FIELDS]) > 0
    return T.collapse(F.coalesce(field, F.lit(""))) != ""


def _count(fields: list[str]) -> Column:
    out = F.lit(0)
    for f in fields:
        out = out + _present(f).cast("int")
    return out


def score(n_warnings: Column) -> Column:
    confidence = sum((F.coalesce(f"confidence.{c}", F.lit(0.0)) for c in CONFIDENCE_FIELDS), F.lit(0.0)) / len(CONFIDENCE_FIELDS)
    raw = _count(SCORED_FIELDS) / F.lit(len(SCORED_FIELDS)) * 0.75 + confidence * 0.25 - F.least(F.lit(0.35), n_warnings * 0.08)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 3)


def quality_by_paper(report: DataFrame, pos: str = "pos") -> DataFrame:
    """The last row (by `pos`) of each paper_id of a stored report: what a lookup by id finds."""
    whole = F.struct(*[c for c in report.columns if c != pos])
    return report.groupBy("paper_id").agg(F.max_by(whole, pos).alias("q")).select("q.*")


def quality_report(papers: DataFrame) -> DataFrame:
    """A row a paper. Rows that share a paper_id share their warnings, in the order of the rows (paper_pos)."""
    order = F.col("paper_pos") if "paper_pos" in papers.columns else F.lit(0)
    held = papers.select("paper_id", F.struct(order.alias("at"), warnings_of().alias("w")).alias("x")).groupBy(F.col("paper_id").alias("of")).agg(F.array_sort(F.collect_list("x")).alias("x"))
    shared = held.select("of", F.flatten(F.transform("x", lambda x: x["w"])).alias("warnings"))
    at = papers.join(shared, F.col("paper_id").eqNullSafe(F.col("of"))).drop("of")
    return at.select("paper_id", score(F.size("warnings")).alias("quality_score"), F.size("warnings").alias("warning_count"), "warnings", "confidence", _count(PAPER_FIELDS).alias("extracted_field_count"), F.lit(len(PAPER_FIELDS)).alias("total_field_count"))
