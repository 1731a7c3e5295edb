"""Extraction of paper records: built-in extractor, lists, merging of chunks, presence checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.schema import CONFIDENCE_FIELDS, KNOWN_BASELINES, KNOWN_DATASETS, KNOWN_METRICS, LIST_FIELDS, PAPER_FIELDS, TEXT_FIELDS


def keywords_of(text: Column, limit: int = 8) -> Column:
    """First `limit`, in order, of the distinct words among the first 200 that are longer than five characters."""
    words = F.filter(F.split(text, T.WHITE + "+"), lambda w: F.length(w) > 5)
    bare = F.transform(words, lambda w: F.btrim(F.lower(w), F.lit(".,:;()[]{}")))
    return F.slice(F.sort_array(F.array_distinct(F.slice(bare, 1, 200))), 1, limit)


def builtin_extract(texts: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """A 23-field record for each (paper_id, text), by fixed rules. `metadata` has one row a paper_id."""
    fields = ["arxiv_id", "title", "authors", "summary", "published", "entry_url"]
    at = texts.select("paper_id", F.coalesce("text", F.lit("")).alias("text"))
    if metadata is None:
        at = at.select("*", *[F.lit(None).cast("array<string>" if f == "authors" else "string").alias(f"m_{f}") for f in fields], F.lit(False).alias("m_any"))
    else:
        held = metadata.select("paper_id", *[F.col(f).alias(f"m_{f}") if f in metadata.columns else F.lit(None).cast("array<string>" if f == "authors" else "string").alias(f"m_{f}") for f in fields], F.lit(True).alias("m_any"))
        at = at.join(held, "paper_id", "left").withColumn("m_any", F.coalesce("m_any", F.lit(False)))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    found = {"datasets": T.known_terms(F.col("text"), KNOWN_DATASETS), "baselines": T.known_terms(F.col("text"), KNOWN_BASELINES), "metrics": T.known_terms(F.col("text"), KNOWN_METRICS), "keywords": keywords_of(F.col("text"))}
    at = at.select("*", *[v.alias(k) for k, v in found.items()])
    gated = lambda pattern, value: F.when(F.col("text").rlike("(?i)" + pattern), F.lit(value)).otherwise(F.lit(""))
    empty = F.array().cast("array<string>")
    values = {
        "paper_id": F.col("paper_id"),
        "arxiv_id": F.when(F.col("m_any"), F.coalesce(some("m_arxiv_id"), F.col("paper_id"))).otherwise(F.lit("")),
        "venue_or_source": F.when(F.col("m_any"), F.coalesce(some("m_entry_url"), F.lit("arXiv"))).otherwise(F.lit("")),
        "title": F.coalesce(some("m_title"), F.nullif(T.first_line(F.col("text")), F.lit("")), F.col("paper_id")),
        "authors": F.coalesce("m_authors", empty),
        "year": F.coalesce(F.left("m_published", F.lit(4)), F.lit("")),
        "abstract": F.coalesce("m_summary", F.lit("")),
        "task": gated("node classification", "node classification"),
        "method_name": gated("attention", "lightweight attention message passing"),
        "contributions": F.array(F.lit("Mock extraction: configure an LLM provider for full contribution extraction.")),
        "research_problem": F.lit("Mock extraction: configure an LLM provider for full analysis."),
        "motivation": F.lit("Mock extraction generated without calling an external API."),
        "methodology": gated("message passing|attention", "The paper proposes a message passing architecture with a lightweight attention mechanism."),
        "datasets": F.col("datasets"), "baselines": F.col("baselines"), "metrics": F.col("metrics"),
        "main_results": F.lit(""), "limitations": F.lit(""), "future_work": F.lit(""), "citation_context": F.lit(""),
        "related_papers": empty,
        "keywords": F.col("keywords"),
        "confidence": F.struct(*[F.when(F.size(c) > 0, 0.7).otherwise(0.0).alias(c) for c in ("datasets", "baselines", "metrics")], F.lit(0.45).alias("methodology")),
    }
    return at.select(*[values[f].alias(f) for f in PAPER_FIELDS])


def dedupe_list(items: Column) -> Column:
    """Trimmed items without blanks; of those equal up to case and white space, the first spelling."""
    trimmed = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), T.collapse_ends), lambda x: x.isNotNull() & (x != ""))
    keyed = F.transform(trimmed, lambda x, k: F.struct(T.casefolded(T.collapse(x)).alias("key"), k.alias("at"), x.alias("item")))
    first = T.let(F.array_sort(keyed), lambda s: F.filter(s, lambda x, k: (k == 0) | (F.get(s, k - 1)["key"] != x["key"])))
    placed = F.array_sort(F.transform(first, lambda x: F.struct(x["at"].alias("at"), x["item"].alias("item"))))
    return F.transform(placed, lambda x: x["item"])


def metadata_seed(papers: DataFrame, metadata: DataFrame) -> DataFrame:
    """A record (pos -1) for each paper_id of `papers`, from its metadata row if there is one."""
    texts, lists = ["arxiv_id", "venue_or_source", "entry_url", "title", "summary", "published"], ["authors", "categories"]
    held = [F.col(c).cast(t).alias(f"m_{c}") if c in metadata.columns else F.lit(None).cast(t).alias(f"m_{c}") for cs, t in ((texts, "string"), (lists, "array<string>")) for c in cs]
    at = papers.select("paper_id").distinct().join(metadata.select("paper_id", *held, F.lit(True).alias("m_any")), "paper_id", "left")
    some = lambda c: F.nullif(F.col(f"m_{c}"), F.lit(""))
    text = lambda c: F.coalesce(F.col(f"m_{c}"), F.lit(""))
    known = {
        "paper_id": F.col("paper_id"),
        "arxiv_id": F.when(F.col("m_any"), F.coalesce(some("arxiv_id"), F.col("paper_id"))).otherwise(F.lit("")),
        "venue_or_source": F.when(F.col("m_any"), F.coalesce(some("venue_or_source"), some("entry_url"), F.lit("arXiv"))).otherwise(F.lit("")),
        "title": text("title"), "year": F.left(text("published"), F.lit(4)), "abstract": text("summary"), "motivation": text("summary"),
        "authors": dedupe_list(F.col("m_authors")), "keywords": dedupe_list(F.col("m_categories")),
        "confidence": F.struct(*[F.lit(0.0).alias(c) for c in CONFIDENCE_FIELDS]),
    }
    empty = lambda f: F.array().cast("array<string>") if f in LIST_FIELDS else F.lit("")
    return at.select(F.lit(-1).cast("long").alias("pos"), *[known.get(f, empty(f)).alias(f) for f in PAPER_FIELDS])


def confidence_of(raw_json: Column) -> Column:
    """Confidence struct of a JSON record; what is no number, or not there, is 0."""
    each = [F.coalesce(F.get_json_object(raw_json, f"$.confidence.{c}").try_cast("double"), F.lit(0.0)).alias(c) for c in CONFIDENCE_FIELDS]
    return F.struct(*each)


def papers_from_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """Adds struct `paper` (PAPER fields) and `invalid` to rows with a JSON record: the schema gate. Absent fields are empty;
    a record without an id, with a text field that is no string or a list field that is no list of strings is invalid."""
    raw = F.col(column)
    at = lambda f: F.get_json_object(raw, f"$.{f}")
    shape = F.schema_of_variant(F.try_parse_json(raw))
    kind = lambda f: F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), f"$.{f}", "variant"))
    wrong = [F.when(~F.startswith(shape, F.lit("OBJECT")) | shape.isNull(), F.lit("no JSON object"))]
    wrong += [F.when(F.coalesce(at("paper_id"), F.lit("")) == "", F.lit("paper_id"))]
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    for f in PAPER_FIELDS:
        fits = kind(f).isin("ARRAY<STRING>", "ARRAY<VOID>") if f in LIST_FIELDS else F.startswith(kind(f), F.lit("OBJECT")) if f == "confidence" else kind(f) == "STRING"
        wrong.append(F.when(F.array_contains(keys, f) & ~F.coalesce(fits, F.lit(False)), F.lit(f)))
    empty = F.array().cast("array<string>")
    values = [F.coalesce(F.from_json(at(f), "array<string>"), empty).alias(f) if f in LIST_FIELDS else confidence_of(raw).alias(f) if f == "confidence" else F.coalesce(at(f), F.lit("")).alias(f) for f in PAPER_FIELDS]
    named = F.array_compact(F.array(*wrong))
    return rows.withColumn("paper", F.struct(*values)).withColumn("invalid", F.when(F.size(named) > 0, F.concat(F.lit("invalid record: "), F.array_join(named, ", "))))


def missing_fields(raw_json: Column) -> Column:
    return F.array_except(F.array(*map(F.lit, PAPER_FIELDS)), F.coalesce(F.json_object_keys(raw_json), F.array().cast("array<string>")))


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """One record a paper from rows of PAPER fields and `pos` (-1: the seed from metadata): of each text
    the longest, the earliest among equals; lists united in order; the largest confidence."""
    bare = lambda f: T.collapse_ends(F.coalesce(f, F.lit("")))
    longest = lambda f: F.max_by(bare(f), F.struct(F.length(bare(f)), -F.col("pos")))
    aggs = [longest(f).alias(f) for f in TEXT_FIELDS if f != "paper_id"]
    aggs += [F.sort_array(F.collect_list(F.struct("pos", F.col(f).alias("v")))).alias(f) for f in LIST_FIELDS]  # a paper's chunks are few
    aggs += [F.struct(*[F.coalesce(F.max(f"confidence.{c}"), F.lit(0.0)).alias(c) for c in CONFIDENCE_FIELDS]).alias("confidence")]
    at = chunks.groupBy("paper_id").agg(*aggs)
    united = {f: dedupe_list(F.flatten(F.transform(f, lambda x: F.coalesce(x["v"], F.array().cast("array<string>"))))) for f in LIST_FIELDS}
    return at.withColumns(united).select(*PAPER_FIELDS)
