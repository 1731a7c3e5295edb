"""Rankings, shared benchmarks, clusters, graph patterns, facets and views."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import collapse_ends
from quillmill.operators.entities import canonical_label, stored
from quillmill.operators.graph import paper_key, with_degree


def _items(papers: DataFrame, field: str) -> DataFrame:
    """paper_id, raw, ord of a list field; ties in rankings go to what was mentioned first."""
    at = papers.select("paper_pos", paper_key().alias("paper_id"), F.posexplode(field).alias("item", "raw"))
    return at.select("paper_id", "raw", F.struct("paper_pos", "item").alias("ord"))


def ranked_values(papers: DataFrame, field: str, limit: int = 25, *, raw: bool = False) -> DataFrame:
    """label and count of mentions, under the default aliases (or as they are written)."""
    spelled = _items(papers, field).groupBy("raw").agg(F.count("*").alias("count"), F.min("ord").alias("ord"))
    at = spelled.withColumn("label", F.col("raw") if raw else canonical_label(F.col("raw"))).where("label <> ''")
    return at.groupBy("label").agg(F.sum("count").alias("count"), F.min("ord").alias("ord")).orderBy(F.desc("count"), "ord").limit(limit).select("label", "count")


def most_connected_papers(nodes: DataFrame, edges: DataFrame, limit: int = 25) -> DataFrame:
    return with_degree(nodes.where("type = 'Paper'"), edges).orderBy(F.desc("degree"), "ord").limit(limit).select("paper_id", F.col("label").alias("title"), "degree")


def shared_benchmarks(papers: DataFrame, limit: int = 25) -> DataFrame:
    """Datasets of more than one paper; paper_count counts mentions. Lists of papers are made for the
    `limit` best only, so that no other dataset's papers are collected."""
    at = _named(_items(papers, "datasets"), "dataset")
    top = at.groupBy("dataset").agg(F.count("*").alias("paper_count"), F.min("paper_id").alias("a"), F.max("paper_id").alias("b"), F.min("ord").alias("ord")).where("a < b").orderBy(F.desc("paper_count"), "ord").limit(limit)
    return _with_papers(at, top, "dataset")


def keyword_clusters(papers: DataFrame, limit: int = 50) -> DataFrame:
    at = _named(_items(papers, "keywords"), "keyword")
    once = at.groupBy("keyword", "paper_id").agg(F.min("ord").alias("ord"))
    top = once.groupBy("keyword").agg(F.count("*").alias("paper_count"), F.min("ord").alias("ord")).orderBy(F.desc("paper_count"), "ord").limit(limit)
    return _with_papers(at, top, "keyword")


def _named(items: DataFrame, name: str) -> DataFrame:
    """Canonical names, made once for each distinct spelling."""
    names = items.select("raw").distinct().withColumn(name, canonical_label(F.col("raw")))
    return items.join(names, "raw").select(name, "paper_id", "ord")


def _with_papers(at: DataFrame, top: DataFrame, name: str) -> DataFrame:
    few = F.broadcast(top.select(name, "paper_count", "ord"))  # at most `limit` rows
    papers = at.join(few, name).groupBy(name, "paper_count", few["ord"].alias("first")).agg(F.sort_array(F.collect_set("paper_id")).alias("papers"))
    return papers.orderBy(F.desc("paper_count"), "first").select(name, "paper_count", "papers")


def list_values(papers: DataFrame, field: str) -> DataFrame:
    column = F.col(field) if dict(papers.dtypes)[field].startswith("array") else F.array(field)
    return papers.select(F.explode(column).alias("value")).select(collapse_ends(F.col("value")).alias("value")).where("value <> ''").distinct().orderBy(F.lower("value"), "value")


def top_datasets(nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    used = edges.where("relation = 'uses'").groupBy("target").agg(F.count("*").alias("n"))  # counted first: a dataset may have very many edges
    named = used.join(nodes.where("type = 'Dataset'").select(F.col("id").alias("target"), F.col("label").alias("dataset")), "target")
    return named.groupBy("dataset").agg(F.sum("n").alias("papers")).orderBy(F.desc("papers"), "dataset").limit(limit)


def keyword_papers(nodes: DataFrame, edges: DataFrame, keyword: str) -> DataFrame:
    hit = nodes.where("type = 'Keyword'").where(F.lower("label").contains(keyword.lower())).select(F.col("id").alias("target"), F.col("label").alias("keyword"))
    papers = nodes.where("type = 'Paper'").select(F.col("id").alias("source"), "paper_id", F.col("label").alias("paper"))
    return edges.where("relation = 'related_to'").join(hit, "target").join(papers, "source").select("paper_id", "paper", "keyword")


def shared_pairs(nodes: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    """The first `limit` pairs by dataset and papers. They lie in the first `limit` datasets with two papers or more,
    among the first `limit` + 1 papers of each, so no others are paired."""
    uses = edges.where("relation = 'uses'").select("source", "target").distinct()
    first = [r[0] for r in uses.groupBy("target").agg(F.count("*").alias("n")).where("n > 1").orderBy("target").limit(limit).select("target").collect()]
    rank = F.row_number().over(Window.partitionBy("target").orderBy("source"))
    few = uses.where(F.col("target").isin(first)).withColumn("k", rank).where(F.col("k") <= limit + 1).drop("k")
    few = sorted(map(tuple, few.select("target", "source").collect()))  # at most `limit` times `limit` + 1 rows
    pairs = [(target, a, b) for target, group in groupby(few, lambda x: x[0]) for a, b in combinations([x[1] for x in group], 2)]
    top = sorted(pairs)[:limit]
    ids = sorted({x for pair in top for x in pair})
    label = {r["id"]: r["label"] for r in nodes.where(F.col("id").isin(ids)).select("id", "label").collect()}
    rows = [tuple(label[x] for x in pair) for pair in top if all(x in label for x in pair)]
    return edges.sparkSession.createDataFrame(rows, "dataset string, paper_a string, paper_b string")


def filter_papers(papers: DataFrame, query: str = "", *, datasets: Sequence[str] = (), baselines: Sequence[str] = (), metrics: Sequence[str] = (), keywords: Sequence[str] = (), tasks: Sequence[str] = ()) -> DataFrame:
    """All of the facets, any of each one's values; none given is no filter. The query is looked for in seven fields
    joined by spaces, where a null field reads `None` and a missing one is empty."""
    out = papers
    if query.strip():
        shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None")) if c in papers.columns else F.lit("")
        seen = F.concat_ws(" ", *map(shown, ("paper_id", "arxiv_id", "title", "abstract", "research_problem", "methodology", "task")))
        out = out.where(F.lower(seen).contains(query.strip().lower()))
    for field, wanted in (("datasets", datasets), ("baselines", baselines), ("metrics", metrics), ("keywords", keywords)):
        if wanted:
            out = out.where(F.arrays_overlap(field, F.array(*map(F.lit, wanted))))
    return out.where(F.col("task").isin(*tasks)) if tasks else out


def papers_to_frame(papers: DataFrame) -> DataFrame:
    joined = lambda f: F.array_join(F.coalesce(f, F.array().cast("array<string>")), ", ").alias(f)
    return papers.select("paper_id", "arxiv_id", "title", "year", "task", F.col("method_name").alias("method"), joined("datasets"), joined("metrics"), joined("keywords"))


def node_view(nodes: DataFrame, edges: DataFrame, *, types: Sequence[str], least_degree: int = 0, keyword: str = "", keyword_papers: DataFrame | None = None, limit: int = 60, literal: bool = False) -> DataFrame:
    at = with_degree(nodes, edges).where(F.col("type").isin(*types)).where(F.col("degree") >= least_degree)
    if keyword:
        hit: Column = F.lower("label").contains(keyword.lower()) if literal else F.col("label").rlike("(?i)" + keyword)
        if keyword_papers is not None:
            at = at.join(keyword_papers.select("paper_id", F.lit(True).alias("has")).distinct(), "paper_id", "left")
            hit = hit | F.coalesce("has", F.lit(False))
        at = at.where(hit)
    return at.orderBy(F.desc("degree"), "label", "id").limit(limit)


def edge_view(edges: DataFrame, shown: DataFrame) -> DataFrame:
    ids = stored(shown.select("id"))  # a view's nodes are few, and found once
    if ids.isEmpty():
        return edges
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def graph_analysis(nodes: DataFrame, edges: DataFrame, papers: DataFrame) -> dict[str, DataFrame]:
    """The six lists of the analysis document, each of bounded size."""
    return {
        "most_used_datasets": ranked_values(papers, "datasets"),
        "most_common_metrics": ranked_values(papers, "metrics"),
        "most_common_keywords": ranked_values(papers, "keywords"),
        "most_connected_papers": most_connected_papers(nodes, edges),
        "shared_benchmark_papers": shared_benchmarks(papers),
        "keyword_clusters": keyword_clusters(papers),
    }


def ranking_frame(analysis: dict[str, DataFrame], key: str) -> DataFrame | None:
    """One list of an analysis; None if it has no such list."""
    return analysis.get(key)


def metadata_grid(metadata: DataFrame) -> DataFrame:
    return metadata.select("paper_id", "arxiv_id", "title", "published", "pdf_path")


def metadata_only(texts: DataFrame, metadata: DataFrame) -> DataFrame:
    """Texts that a metadata row's pdf_path names; all of them if there is no metadata at all."""
    stem = F.regexp_replace(F.element_at(F.split("pdf_path", "/"), -1), r"\.[^.]*$", "")
    held = metadata.where("pdf_path <> ''").select(stem.alias("paper_id"))
    return texts if metadata.isEmpty() else texts.join(held, "paper_id", "left_semi")


def paper_details(papers: DataFrame, quality: DataFrame) -> DataFrame:
    """What a detail view shows: the paper with its quality row; the motivation stands in for a missing abstract."""
    text = lambda f: F.coalesce(f, F.lit("")).alias(f)
    listed = lambda f: F.coalesce(f, F.array().cast("array<string>")).alias(f)
    shown = F.coalesce(F.nullif("abstract", F.lit("")), "motivation", F.lit("")).alias("abstract")
    scores = quality.select("paper_id", "quality_score", "warning_count")
    texts = ["arxiv_id", "year", "research_problem", "methodology", "main_results", "limitations", "future_work", "task", "method_name", "citation_context"]
    lists = ["authors", "contributions", "datasets", "baselines", "metrics", "related_papers", "keywords"]
    count = F.coalesce("warning_count", F.lit(0)).alias("warning_count")
    title = F.coalesce("title", F.lit("Untitled")).alias("title")
    return papers.join(scores, "paper_id", "left").select("paper_id", title, shown, *map(text, texts), *map(listed, lists), "quality_score", count)


def counters(**tables: DataFrame) -> dict[str, int]:
    """Rows of each table."""
    return {name: df.count() for name, df in tables.items()}
