"""Registered queries of the literature engine and their SQL.

The driver's tables hold no papers, so orders with their lines and parts stand in for them: a paper an
order, its datasets the brands, baselines the types, keywords the names and metrics the return flags.
Documents stand in for paper texts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import analytics, entities, extract, graph, quality, sections
from quillmill.plans import record_queries
from quillmill.plans.runmeta import run_metadata
from quillmill.schema import KNOWN_DATASETS


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAPER-like rows with paper_pos. One shuffle by order; parts are joined as Spark sees fit."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", "p_name")
    held = lines.join(parts, "l_partkey").repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey"))  # no sort before the shuffle: an order's lines lie apart
    held = held.agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "p_brand", "p_type", "p_name"))).alias("i"))  # an order's lines are few
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    at = held.join(orders, "o_orderkey")
    key = F.col("o_orderkey").cast("string")
    empty = F.lit("")
    return at.select(
        F.col("o_orderkey").alias("paper_pos"), key.alias("paper_id"), empty.alias("arxiv_id"), F.concat(F.lit("Order "), key).alias("title"), F.year("o_orderdate").cast("string").alias("year"),
        empty.alias("abstract"), F.col("o_orderpriority").alias("task"), empty.alias("method_name"), empty.alias("methodology"), empty.alias("research_problem"), empty.alias("main_results"), empty.alias("limitations"),
        F.col("i.p_brand").alias("datasets"), F.col("i.p_type").alias("baselines"), F.col("i.p_name").alias("keywords"), F.col("i.l_returnflag").alias("metrics"),
    )


def _graph(spark: SparkSession, sf_dir: str, fuzzy: bool = False) -> tuple[DataFrame, DataFrame]:
    """SQL can't say the fuzzy merge: the queries with SQL are of the graph before it, those named _merged after it."""
    return graph.build_graph(entities.stored(order_papers(spark, sf_dir)), fuzzy=fuzzy)


def rank_datasets(spark, sf_dir):
    return analytics.ranked_values(order_papers(spark, sf_dir), "datasets")


def rank_metrics(spark, sf_dir):
    return analytics.ranked_values(order_papers(spark, sf_dir), "metrics")


def rank_keywords(spark, sf_dir):
    return analytics.ranked_values(order_papers(spark, sf_dir), "keywords")


def rank_raw_baselines(spark, sf_dir):
    return analytics.ranked_values(order_papers(spark, sf_dir), "baselines", raw=True)


def most_connected(spark, sf_dir, fuzzy=False):
    return analytics.most_connected_papers(*_graph(spark, sf_dir, fuzzy))


def shared_benchmarks(spark, sf_dir):
    return analytics.shared_benchmarks(order_papers(spark, sf_dir)).select("dataset", "paper_count", F.array_join("papers", ",").alias("papers"))


def keyword_clusters(spark, sf_dir):
    return analytics.keyword_clusters(order_papers(spark, sf_dir)).select("keyword", "paper_count", F.array_join("papers", ",").alias("papers"))


def graph_nodes(spark, sf_dir, fuzzy=False):
    return _graph(spark, sf_dir, fuzzy)[0].select("id", "label", "type", "paper_id", "year", "color")


def graph_edges(spark, sf_dir, fuzzy=False):
    return _graph(spark, sf_dir, fuzzy)[1].select("source", "target", "relation")


def node_degrees(spark, sf_dir, fuzzy=False):
    return graph.with_degree(*_graph(spark, sf_dir, fuzzy)).select("id", "degree")


def nodes_by_type(spark, sf_dir, fuzzy=False):
    return _graph(spark, sf_dir, fuzzy)[0].groupBy("type").agg(F.count("*").alias("n"))


def list_values(spark, sf_dir):
    spaced = F.transform("keywords", lambda x: F.concat(F.lit("\t "), x, F.lit(" \n")))
    return analytics.list_values(order_papers(spark, sf_dir).withColumn("keywords", spaced), "keywords")


def filter_papers(spark, sf_dir):
    found = analytics.filter_papers(order_papers(spark, sf_dir), "order 1", metrics=["R"], tasks=["1-URGENT", "2-HIGH"])
    return found.select("paper_id", "title", "task")


def papers_to_frame(spark, sf_dir):
    return analytics.papers_to_frame(order_papers(spark, sf_dir)).select("paper_id", "title", "year", "task", "method", "datasets")


def node_view(spark, sf_dir, fuzzy=False):
    nodes, edges = _graph(spark, sf_dir, fuzzy)
    return analytics.node_view(nodes, edges, types=["Dataset", "Keyword", "Baseline"], least_degree=2, keyword="b", limit=40).select("id", "label", "type", "degree")


def edge_view(spark, sf_dir, fuzzy=False):
    nodes, edges = _graph(spark, sf_dir, fuzzy)
    shown = analytics.node_view(nodes, edges, types=["Paper", "Dataset", "Metric"], least_degree=12, limit=200)
    return analytics.edge_view(edges, shown).select("source", "target", "relation")


def top_datasets(spark, sf_dir, fuzzy=False):
    return analytics.top_datasets(*_graph(spark, sf_dir, fuzzy))


def keyword_papers(spark, sf_dir, fuzzy=False):
    return analytics.keyword_papers(*_graph(spark, sf_dir, fuzzy), "BOLT")


def shared_pairs(spark, sf_dir, fuzzy=False):
    papers = order_papers(spark, sf_dir)
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("paper_pos")).agg(F.sort_array(F.collect_set(F.concat(F.lit("part "), F.col("l_partkey").cast("string")))).alias("datasets"))
    return analytics.shared_pairs(*graph.build_graph(entities.stored(papers.drop("datasets").join(lines, "paper_pos")), fuzzy=fuzzy))


def _docs(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def known_terms(spark, sf_dir):
    text = F.regexp_replace(F.regexp_replace("text", " the ", " CIFAR-100 and cora "), " que ", " F1-score BERT, ")
    at = _docs(spark, sf_dir).select("doc_id", text.alias("text"))
    found = T.known_terms(F.col("text"), ["Cora", "CIFAR-10", "CIFAR-100", "F1", "BERT"])
    return at.select("doc_id", F.array_join(found, ",").alias("terms"))


def builtin_keywords(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(extract.keywords_of(F.col("text")), "|").alias("keywords"))


def builtin_records(spark, sf_dir):
    at = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("paper_id"), F.concat(F.lit("\n On Attention \nCora"), F.lit(" "), "text").alias("text"))
    return extract.builtin_extract(at).select("paper_id", "title", "method_name", F.array_join("datasets", ",").alias("datasets"), F.col("confidence.datasets").alias("confidence"))


def dehyphenate(spark, sf_dir):
    text = F.regexp_replace("text", "([a-z])t([a-z])", "$1t-\n$2")
    return _docs(spark, sf_dir).select("doc_id", T.dehyphenate(text).alias("text"))


def page_number_lines(spark, sf_dir):
    """Of all lines of each text and some that are made up."""
    made = F.array(F.lit("- 12 -"), F.lit("123"), F.lit("12345"), F.lit("— 7"), F.concat(F.lit(" "), (F.col("doc_id") % 20000).cast("string"), F.lit("\t")))
    at = _docs(spark, sf_dir).select("doc_id", F.explode(F.concat(made, T.lines_of(F.coalesce("text", F.lit(""))))).alias("line"))
    return at.where(T.is_page_number(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("n"))


def truncate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.truncate(F.col("text"), 1000).alias("text"))


def safe_filename(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.safe_filename(F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("a"), F.lit("/")), 60).alias("name"))


def first_sentence(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.first_sentence(F.col("text"), 80).alias("sentence"))


def canonical_keys(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", T.canonical_key(F.concat(F.lit("  "), "p_name", F.lit(" -- "), "p_brand", F.lit(" ."))).alias("key"), T.node_id(F.lit("Dataset"), F.col("p_type")).alias("id"))


def alias_labels(spark, sf_dir):
    aliases = entities.alias_map({"brand#1": "One"}, {"Dataset": {"brand#2": "Two"}, "Metric": {"brand#1": "no"}})
    return _table(spark, sf_dir, "part").select("p_partkey", entities.canonical_label(F.col("p_brand"), F.lit("Dataset"), aliases).alias("label"))


def fuzzy_labels(spark, sf_dir):
    return graph.resolved_counts(order_papers(spark, sf_dir))


def merged_chunks(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("paper_id"), F.col("turn").alias("pos"), "role", F.col("text"))
    from quillmill.schema import LIST_FIELDS, PAPER_FIELDS

    values = {"paper_id": F.col("paper_id"), "title": F.concat(F.lit("\n \t"), "text", F.repeat(F.lit("\n"), F.col("pos").cast("int") % 7)), "datasets": F.array("role"), "confidence": F.struct(*[(F.length("text") / 1000.0).alias(c) for c in ("datasets", "baselines", "metrics", "methodology")])}
    at = rows.select("pos", *[values.get(f, F.array().cast("array<string>") if f in LIST_FIELDS else F.lit("")).alias(f) for f in PAPER_FIELDS])
    return extract.merge_chunks(at).select("paper_id", "title", F.size("datasets").alias("n_datasets"), F.col("confidence.metrics").alias("confidence"))


def missing_fields(spark, sf_dir):
    raw = F.concat(F.lit('{"paper_id": 1, "title": null'), F.when(F.col("doc_id") % 2 == 0, F.lit(', "year": "1"')).otherwise(F.lit("")), F.lit("}"))
    return _docs(spark, sf_dir).select("doc_id", F.size(extract.missing_fields(raw)).alias("n_missing"))


def _graded(spark, sf_dir):
    papers = order_papers(spark, sf_dir)
    few = papers.withColumn("datasets", F.when(F.col("paper_pos") % 3 == 0, F.array().cast("array<string>")).otherwise(F.col("datasets"))).withColumn("methodology", F.when(F.col("paper_pos") % 2 == 0, F.lit("one two three four five six seven eight")).otherwise(F.lit("too short")))
    filled = {c: F.lit("") for c in ("venue_or_source", "motivation", "future_work", "citation_context")} | {c: F.array().cast("array<string>") for c in ("authors", "contributions", "related_papers")}
    return few.withColumns(filled).withColumn("confidence", F.struct(F.lit(0.7).alias("datasets"), F.lit(0.7).alias("baselines"), F.lit(0.0).alias("metrics"), F.lit(0.45).alias("methodology")))


def quality_warnings(spark, sf_dir):
    return quality.quality_warnings(_graded(spark, sf_dir))


def quality_report(spark, sf_dir):
    return quality.quality_report(_graded(spark, sf_dir)).select("paper_id", "quality_score", "warning_count", "extracted_field_count", "total_field_count")


def section_spans(spark, sf_dir):
    text = F.concat(F.lit("ahead\n1. Introduction\n"), "text", F.lit("\nMethods:\n"), F.reverse("text"), F.lit("\nReferences\n[1]\nConclusion\nend"))
    at = _docs(spark, sf_dir).select(F.col("doc_id").alias("paper_id"), text.alias("text"))
    return sections.sections(at).select("paper_id", "pos", "section_name", F.length("text").cast("long").alias("n_chars"))


def section_chunks(spark, sf_dir):
    at = _docs(spark, sf_dir).select(F.col("doc_id").alias("paper_id"), F.lit(0).cast("long").alias("pos"), F.lit("Full Paper").alias("section_name"), F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return sections.chunks(at, 1500).select("paper_id", "part", "section_name", F.length("text").cast("long").alias("n_chars"))


def page_noise(spark, sf_dir):
    """The whole text in pages of 200 characters, at least four."""
    head, foot = F.lit("Journal of Things\n"), F.lit("\n12")
    last = F.greatest(F.lit(3), F.ceil(F.length("text") / 200).cast("int") - 1)
    pages = F.transform(F.sequence(F.lit(0), last), lambda k: F.concat(head, F.substring("text", 1 + 200 * k, F.lit(200)), foot))
    left = _docs(spark, sf_dir).where("text is not null").select("doc_id", F.array_join(T.drop_page_noise(pages), "\n").alias("left"))
    lines = left.select("doc_id", F.filter(F.split("left", "\n"), lambda x: x != "").alias("lines"))
    return lines.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.md5(F.encode(F.array_join("lines", "\n"), "UTF-8")).alias("digest"))


def clean_texts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.clean_text(F.concat(F.lit("Abstract:\r\n"), F.replace("text", F.lit(" "), F.lit("  ")))).alias("text"))


def metadata_only(spark, sf_dir):
    index = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return _docs(spark, sf_dir).join(index, "doc_id", "left_semi").select("doc_id")


def pending_texts(spark, sf_dir):
    return _docs(spark, sf_dir).join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id")


def run_stamp(spark, sf_dir):
    return run_metadata(spark, provider="mock", model="mock", prompt="extract", now="2020-01-01T00:00:00Z")


_QUERIES = [
    rank_datasets, rank_metrics, rank_keywords, rank_raw_baselines, most_connected, shared_benchmarks, keyword_clusters, graph_nodes, graph_edges, node_degrees, nodes_by_type, list_values, filter_papers, papers_to_frame,
    node_view, edge_view, top_datasets, keyword_papers, shared_pairs, known_terms, builtin_keywords, builtin_records, dehyphenate, page_number_lines, truncate, safe_filename, first_sentence, canonical_keys, alias_labels,
    fuzzy_labels, merged_chunks, missing_fields, quality_warnings, quality_report, section_spans, section_chunks, page_noise, clean_texts, metadata_only, pending_texts, run_stamp,
]
_OF_GRAPH = [most_connected, graph_nodes, graph_edges, node_degrees, nodes_by_type, node_view, edge_view, top_datasets, keyword_papers, shared_pairs]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES} | record_queries.queries() | {f"{f.__name__}_merged": partial(f, fuzzy=True) for f in _OF_GRAPH}


_LINES = """WITH l AS (SELECT o_orderkey AS pos, CAST(o_orderkey AS VARCHAR) AS pid, CAST(year(o_orderdate) AS VARCHAR) AS year, o_orderpriority AS task, p_brand, p_type, p_name, l_returnflag,
  row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS item
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey)"""
_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '_')"
_EDGES = _LINES + f""", m AS (SELECT pid, 'Dataset' AS type, 'uses' AS relation, p_brand AS label FROM l UNION ALL SELECT pid, 'Baseline', 'compares_with', p_type FROM l
  UNION ALL SELECT pid, 'Metric', 'evaluated_by', l_returnflag FROM l UNION ALL SELECT pid, 'Keyword', 'related_to', p_name FROM l),
e AS (SELECT DISTINCT 'paper:' || pid AS source, lower(type) || ':' || {_SLUG.format("label")} AS target, relation, pid, label, type FROM m),
n AS (SELECT DISTINCT target AS id, label, type, '' AS paper_id, '' AS year FROM e UNION ALL SELECT DISTINCT 'paper:' || pid, 'Order ' || pid, 'Paper', pid, year FROM l),
d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY id),
nd AS (SELECT n.*, coalesce(degree, 0) AS degree FROM n LEFT JOIN d USING (id))"""
_RANK = _LINES + " SELECT {0} AS label, count(*) AS count FROM l GROUP BY {0} ORDER BY count DESC, min(pos * 1000 + item) LIMIT 25"


def oracle_sql() -> dict[str, str]:
    color = "CASE type WHEN 'Paper' THEN '#4C78A8' WHEN 'Dataset' THEN '#F58518' WHEN 'Baseline' THEN '#E45756' WHEN 'Metric' THEN '#72B7B2' ELSE '#B279A2' END"
    term = lambda t: f"CASE WHEN regexp_matches(t, '(?i)(^|[^A-Za-z0-9-]){t}($|[^A-Za-z0-9-])') THEN '{t}' END"
    return record_queries.oracle_sql() | {
        "rank_datasets": _RANK.format("p_brand"),
        "rank_metrics": _RANK.format("l_returnflag"),
        "rank_keywords": _RANK.format("p_name"),
        "rank_raw_baselines": _RANK.format("p_type"),
        "most_connected": _EDGES + " SELECT paper_id, label AS title, degree FROM nd WHERE type = 'Paper' ORDER BY degree DESC, CAST(paper_id AS BIGINT) LIMIT 25",
        "shared_benchmarks": _LINES + " SELECT p_brand AS dataset, count(*) AS paper_count, array_to_string(list_sort(list(DISTINCT pid)), ',') AS papers FROM l GROUP BY p_brand HAVING count(DISTINCT pid) > 1 ORDER BY paper_count DESC, min(pos * 1000 + item) LIMIT 25",
        "keyword_clusters": _LINES + " SELECT p_name AS keyword, count(DISTINCT pid) AS paper_count, array_to_string(list_sort(list(DISTINCT pid)), ',') AS papers FROM l GROUP BY p_name ORDER BY paper_count DESC, min(pos * 1000 + item) LIMIT 50",
        "graph_nodes": _EDGES + f" SELECT id, label, type, paper_id, year, {color} AS color FROM n",
        "graph_edges": _EDGES + " SELECT source, target, relation FROM e",
        "node_degrees": _EDGES + " SELECT id, degree FROM nd",
        "nodes_by_type": _EDGES + " SELECT type, count(*) AS n FROM n GROUP BY type",
        "list_values": _LINES + " SELECT DISTINCT trim(p_name) AS value FROM l",
        "filter_papers": _LINES + " SELECT pid AS paper_id, 'Order ' || pid AS title, task FROM l GROUP BY pid, task HAVING bool_or(l_returnflag = 'R') AND task IN ('1-URGENT', '2-HIGH') AND contains(lower(pid || '  Order ' || pid || '    ' || task), 'order 1')",
        "papers_to_frame": _LINES + " SELECT pid AS paper_id, 'Order ' || pid AS title, year, task, '' AS method, string_agg(p_brand, ', ' ORDER BY item) AS datasets FROM l GROUP BY pid, year, task",
        "node_view": _EDGES + " SELECT id, label, type, degree FROM nd WHERE type IN ('Dataset', 'Keyword', 'Baseline') AND degree >= 2 AND contains(lower(label), 'b') ORDER BY degree DESC, label, id LIMIT 40",
        "edge_view": _EDGES + ", s AS (SELECT id FROM nd WHERE type IN ('Paper', 'Dataset', 'Metric') AND degree >= 12 ORDER BY degree DESC, label, id LIMIT 200) SELECT source, target, relation FROM e WHERE source IN (SELECT id FROM s) AND target IN (SELECT id FROM s)",
        "top_datasets": _EDGES + " SELECT label AS dataset, count(*) AS papers FROM e WHERE relation = 'uses' GROUP BY label ORDER BY papers DESC, dataset LIMIT 20",
        "keyword_papers": _EDGES + " SELECT pid AS paper_id, 'Order ' || pid AS paper, label AS keyword FROM e WHERE relation = 'related_to' AND contains(lower(label), 'bolt')",
        "shared_pairs": "WITH u AS (SELECT DISTINCT 'paper:' || CAST(l_orderkey AS VARCHAR) AS s, CAST(l_orderkey AS VARCHAR) AS p, 'dataset:part_' || CAST(l_partkey AS VARCHAR) AS t, 'part ' || CAST(l_partkey AS VARCHAR) AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey) SELECT a.d AS dataset, 'Order ' || a.p AS paper_a, 'Order ' || b.p AS paper_b FROM u a JOIN u b ON a.t = b.t AND a.s < b.s ORDER BY a.t, a.s, b.s LIMIT 50",
        "known_terms": "WITH d AS (SELECT doc_id, replace(replace(text, ' the ', ' CIFAR-100 and cora '), ' que ', ' F1-score BERT, ') AS t FROM documents) SELECT doc_id, concat_ws(',', " + ", ".join(term(t) for t in ("Cora", "CIFAR-10", "CIFAR-100", "F1", "BERT")) + ") AS terms FROM d",
        "builtin_keywords": r"WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: length(w) > 5) AS w FROM documents) SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(w, lambda x: trim(lower(x), '.,:;()[]{}'))[1:200]))[1:8], '|') AS keywords FROM d",
        "builtin_records": "WITH d AS (SELECT doc_id, 'Cora ' || text AS t FROM documents) SELECT CAST(doc_id AS VARCHAR) AS paper_id, 'On Attention' AS title, 'lightweight attention message passing' AS method_name, concat_ws(',', " + ", ".join(map(term, KNOWN_DATASETS)) + ") AS datasets, 0.7::DOUBLE AS confidence FROM d",
        "dehyphenate": r"SELECT doc_id, regexp_replace(regexp_replace(text, '([a-z])t([a-z])', '\1t-' || chr(10) || '\2', 'g'), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g') AS text FROM documents",
        "page_number_lines": r"WITH x AS (SELECT doc_id, unnest(['- 12 -', '123', '12345', '— 7', ' ' || CAST(doc_id % 20000 AS VARCHAR)] || string_split(coalesce(text, ''), chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS n FROM x WHERE regexp_full_match(trim(line), '[-–—]?\s*[0-9]{1,4}\s*[-–—]?') GROUP BY doc_id",
        "truncate": "SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text ELSE left(text, 700) || chr(10) || chr(10) || '[... middle content truncated ...]' || chr(10) || chr(10) || right(text, 300) END AS text FROM documents",
        "safe_filename": r"SELECT doc_id, left(coalesce(nullif(trim(regexp_replace(trim(regexp_replace(replace(replace(text, chr(10), ' '), 'a', '/'), '[^\p{L}\p{N}_\s.-]', '', 'g')), '\s+', '_', 'g'), '._'), ''), 'untitled'), 60) AS name FROM documents",
        "first_sentence": r"WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), s AS (SELECT doc_id, coalesce(nullif(regexp_extract(t, '^(.+?[.!?])\s', 1), ''), t) AS s FROM c) SELECT doc_id, CASE WHEN length(s) > 80 THEN rtrim(left(s, 77)) || '...' ELSE s END AS sentence FROM s",
        "canonical_keys": "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' -- ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS key, 'dataset:' || trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS id FROM part",
        "alias_labels": "SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'One' WHEN 'Brand#2' THEN 'Two' ELSE p_brand END AS label FROM part",
        "merged_chunks": r"SELECT CAST(conv_id AS VARCHAR) AS paper_id, arg_max(regexp_replace(text, '^\s+|\s+$', '', 'g'), length(regexp_replace(text, '^\s+|\s+$', '', 'g')) * 1000000 - turn) AS title, CAST(count(DISTINCT role) AS INTEGER) AS n_datasets, max(length(text) / 1000.0) AS confidence FROM conversations GROUP BY conv_id",
        "missing_fields": "SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 20 ELSE 21 END AS INTEGER) AS n_missing FROM documents",
        "quality_warnings": _LINES + ", p AS (SELECT DISTINCT pos, pid FROM l) SELECT pid AS paper_id, 'datasets' AS field, 'No datasets were extracted.' AS warning FROM p WHERE pos % 3 = 0 UNION ALL SELECT pid, 'methodology', 'Methodology is shorter than 8 words.' FROM p WHERE pos % 2 = 1",
        "quality_report": _LINES + ", p AS (SELECT DISTINCT pos, pid, CAST(pos % 3 = 0 AS INT) + CAST(pos % 2 = 1 AS INT) AS w FROM l) SELECT pid AS paper_id, round((5 + CAST(pos % 3 <> 0 AS INT)) / 9.0::DOUBLE * 0.75 + (0.7 + 0.7 + 0.0 + 0.45)::DOUBLE / 4 * 0.25 - least(0.35, w * 0.08), 3) AS quality_score, CAST(w AS INTEGER) AS warning_count, CAST(9 + CAST(pos % 3 <> 0 AS INT) AS INTEGER) AS extracted_field_count, CAST(23 AS INTEGER) AS total_field_count FROM p",
        "metadata_only": "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
        "pending_texts": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "run_stamp": "SELECT 'paper_extraction.v1' AS schema_version, sha256('extract') AS prompt_sha256, '' AS prompt_path, 'mock' AS provider, 'mock' AS model, '2020-01-01T00:00:00Z' AS created_at",
    }
