"""Registered queries of sources, records and views, and their SQL; other tables stand in for papers and catalogues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import analytics, extract, graph, quality, sections
from quillmill.schema import LIST_FIELDS, PAPER_FIELDS
from quillmill.sources import literature
from quillmill.sources.files import ranked


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _results(spark, sf_dir):
    """Parts as rows of a catalogue."""
    none = F.array().cast("array<string>")
    key, day = F.col("p_partkey").cast("string"), F.lit("2020-01-01")
    texts = [key.alias("arxiv_id"), F.col("p_name").alias("title"), none.alias("authors"), F.col("p_type").alias("summary")]
    rest = [day.alias("published"), day.alias("updated"), none.alias("categories"), F.lit("").alias("entry_url"), F.lit("").alias("pdf_url")]
    return literature.TableCatalogue(_table(spark, sf_dir, "part").select(*texts, *rest))


def catalogue_search(spark, sf_dir):
    return literature.search(_results(spark, sf_dir), "BRASS widget", max_results=30).select("arxiv_id", "title")


def catalogue_lookup(spark, sf_dir):
    return literature.lookup(_results(spark, sf_dir), ["77", " 3", "", "150"]).select("arxiv_id", "title")


def download_rows(spark, sf_dir):
    at = literature.with_paths(_results(spark, sf_dir).rows, "pdfs")
    kind = F.col("paper_id").cast("long") % 3
    content, mime = F.when(kind == 1, F.lit(b"%PDF-1.4")).otherwise(F.lit(b"<html>")), F.when(kind == 2, F.lit("application/PDF"))
    return at.select("paper_id", "pdf_path", literature.looks_like_pdf(content, mime).alias("is_pdf"))


def escaped_texts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(T.html_escape(F.col("text")), "UTF-8")).alias("digest"))


def json_objects(spark, sf_dir):
    fenced = F.concat(F.lit('as asked ```json\n{"a": '), F.col("doc_id").cast("string"), F.lit("}\n``` {done}"))
    raw = F.when(F.col("doc_id") % 3 == 0, fenced).when(F.col("doc_id") % 3 == 1, F.lit('so: {"b": {"c": 1}} ok')).otherwise(F.lit("} none {"))
    return _table(spark, sf_dir, "documents").select("doc_id", T.json_object_in(raw).alias("json"))


def metadata_seeds(spark, sf_dir):
    at = _table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    short = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("m"), key)).otherwise(F.lit(""))
    notes = at.where("c_custkey % 2 = 0 or c_custkey % 3 <> 0")
    notes = notes.select(key.alias("paper_id"), short.alias("arxiv_id"), F.col("c_name").alias("title"), F.lit("2020-05-06").alias("published"), F.col("c_mktsegment").alias("summary"))
    return extract.metadata_seed(at.select(key.alias("paper_id")), notes).select("paper_id", "arxiv_id", "venue_or_source", "title", "year", "motivation")


def schema_gate(spark, sf_dir):
    metrics = F.when(F.col("p_partkey") % 8 == 4, F.lit("0.25")).otherwise(F.lit('"bad"'))
    good = F.concat(F.lit('{"paper_id": "a", "authors": ["x"], "confidence": {"metrics": '), metrics, F.lit("}}"))
    kind = F.col("p_partkey") % 4
    raw = F.when(kind == 1, F.lit('{"paper_id": "a", "title": 5}')).when(kind == 2, F.lit('{"title": "t"}')).when(kind == 3, F.lit('{"paper_id": "a", "keywords": "k"}')).otherwise(good)
    gated = extract.papers_from_json(_table(spark, sf_dir, "part").select("p_partkey", raw.alias("json")))
    return gated.select("p_partkey", "invalid", F.col("paper.confidence.metrics").alias("metrics"))


def quality_lookup(spark, sf_dir):
    value = F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")
    at = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("paper_id"), value.alias("pos"), value.alias("quality"))
    return quality.quality_by_paper(at)


def paper_details(spark, sf_dir):
    at = _table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string").alias("paper_id")
    given = ("paper_id", "abstract", "motivation", "confidence")
    empty = [(F.array().cast("array<string>") if f in LIST_FIELDS else F.lit("")).alias(f) for f in PAPER_FIELDS if f not in given]
    abstract = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.lit("")).alias("abstract")
    scores = at.where("o_orderkey % 5 = 0").select(key, F.col("o_totalprice").alias("quality_score"), F.lit(2).alias("warning_count"))
    shown = analytics.paper_details(at.select(key, abstract, F.lit("why").alias("motivation"), *empty), scores)
    return shown.select("paper_id", "abstract", "quality_score", "warning_count")


def text_ranks(spark, sf_dir):
    return ranked(_table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), "name", "rank")


def method_edges(spark, sf_dir):
    """Methods named by the first sentence of what is told about them."""
    empty = F.array().cast("array<string>")
    told = F.concat(F.lit("We use "), F.col("o_orderpriority"), F.lit(". Then more of it."))
    key = F.col("o_orderkey").cast("string")
    text = [F.lit("").alias(f) for f in ("title", "year", "arxiv_id", "task", "method_name")]
    lists = [empty.alias(f) for f in ("datasets", "baselines", "metrics", "keywords")]
    papers = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_pos"), key.alias("paper_id"), told.alias("methodology"), *text, *lists)
    nodes, edges = graph.build_graph(papers, fuzzy=False)
    return edges.where("relation = 'proposes'").join(nodes.select(F.col("id").alias("target"), F.col("label").alias("name")), "target").select("source", "target", F.col("name").alias("label"))


def folded_lists(spark, sf_dir):
    items = F.array(F.concat(F.lit("\n"), "p_name"), F.upper("p_name"), F.lit(" "), F.col("p_brand"), F.replace("p_name", F.lit(" "), F.lit(" \t ")), F.lower("p_brand"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(extract.dedupe_list(items), "|").alias("items"))


def heading_names(spark, sf_dir):
    lines = ["III. Proposed Method", "7 Acknowledgments:", " 2.1. Future work -", "Evaluation.", "Our method", "12"]
    k = (F.col("o_orderkey") % 6).cast("int")
    line = F.element_at(F.array(*map(F.lit, lines)), k + 1)
    return _table(spark, sf_dir, "orders").select(k.alias("k"), sections.heading_name(line).alias("name")).groupBy("k", "name").agg(F.count("*").alias("n"))


_QUERIES = [catalogue_search, catalogue_lookup, download_rows, escaped_texts, json_objects, metadata_seeds, schema_gate, quality_lookup, paper_details, text_ranks, method_edges, folded_lists, heading_names]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_HITS = "CAST(contains(lower(p_name || ' ' || p_type), 'brass') AS INT) + CAST(contains(lower(p_name || ' ' || p_type), 'widget') AS INT)"
_NOTED = "c_custkey % 2 = 0 OR c_custkey % 3 <> 0"
#: Lines of pages of 200 characters, without those that repeat at the pages' edges and without page numbers.
PAGE_NOISE = r"""
WITH g AS (SELECT doc_id, k, 'Journal of Things' || chr(10) || substring(text, 1 + 200 * k, 200) || chr(10) || '12' AS page
  FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(3, CAST(ceil(length(text) / 200.0) AS BIGINT) - 1))) AS k FROM documents WHERE text IS NOT NULL)),
l AS (SELECT doc_id, k, unnest(string_split(page, chr(10))) AS line, generate_subscripts(string_split(page, chr(10)), 1) AS i FROM g),
s AS (SELECT doc_id, k, i, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS a, count(*) OVER (PARTITION BY doc_id, k) AS n FROM s WHERE line <> ''),
e AS (SELECT doc_id, line FROM r WHERE a <= 3 UNION ALL SELECT doc_id, line FROM r WHERE a >= greatest(1, n - 2)),
np AS (SELECT doc_id, count(*) AS pages FROM g GROUP BY doc_id),
noise AS (SELECT doc_id, line FROM e JOIN np USING (doc_id) GROUP BY doc_id, line, pages
  HAVING count(*) >= greatest(3, CAST(floor(pages * 0.35) AS INTEGER)) AND length(line) <= 140),
kept AS (SELECT r.doc_id, r.k, r.i, r.line FROM r ANTI JOIN noise USING (doc_id, line) WHERE NOT regexp_full_match(r.line, '[-–—]?\s*[0-9]{1,4}\s*[-–—]?'))
SELECT d.doc_id, count(line) AS n_lines, md5(coalesce(string_agg(line, chr(10) ORDER BY k, i), '')) AS digest
FROM documents d LEFT JOIN kept USING (doc_id) WHERE d.text IS NOT NULL GROUP BY d.doc_id"""
CLEAN_TEXTS = r"""
WITH a AS (SELECT doc_id, regexp_replace(replace(text, ' ', '  '), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM a)
SELECT doc_id, regexp_replace(regexp_replace('ABSTRACT:' || chr(10) || chr(10) || regexp_replace(t, '^\n+', ''), '\n{3,}', chr(10) || chr(10), 'g'), '\s+$', '') AS text FROM b"""
SECTION_SPANS = r"""
WITH s AS (SELECT doc_id, 0 AS pos, 'Front Matter' AS name, 'ahead' AS t FROM documents UNION ALL SELECT doc_id, 1, 'Introduction', text FROM documents
  UNION ALL SELECT doc_id, 2, 'Method', reverse(text) FROM documents),
b AS (SELECT doc_id, pos, name, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM s)
SELECT doc_id AS paper_id, CAST(pos AS BIGINT) AS pos, name AS section_name, length(t) AS n_chars FROM b WHERE t <> ''"""


def oracle_sql() -> dict[str, str]:
    return {
        "catalogue_search": f"SELECT arxiv_id, title FROM (SELECT CAST(p_partkey AS VARCHAR) AS arxiv_id, p_name AS title, {_HITS} AS hits FROM part) WHERE hits > 0 ORDER BY hits DESC, arxiv_id LIMIT 30",
        "catalogue_lookup": "SELECT CAST(p_partkey AS VARCHAR) AS arxiv_id, p_name AS title FROM part WHERE p_partkey IN (3, 77, 150)",
        "download_rows": "SELECT CAST(p_partkey AS VARCHAR) AS paper_id, 'pdfs/' || p_partkey || '_' || replace(p_name, ' ', '_') || '.pdf' AS pdf_path, p_partkey % 3 <> 0 AS is_pdf FROM part",
        "escaped_texts": "SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;')) AS digest FROM documents",
        "json_objects": """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{"a": ' || doc_id || '}' WHEN 1 THEN '{"b": {"c": 1}}' END AS json FROM documents""",
        "metadata_seeds": f"""SELECT CAST(c_custkey AS VARCHAR) AS paper_id, CASE WHEN c_custkey % 2 = 0 THEN 'm' || c_custkey WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS arxiv_id,
          CASE WHEN {_NOTED} THEN 'arXiv' ELSE '' END AS venue_or_source, CASE WHEN {_NOTED} THEN c_name ELSE '' END AS title, CASE WHEN {_NOTED} THEN '2020' ELSE '' END AS year,
          CASE WHEN {_NOTED} THEN c_mktsegment ELSE '' END AS motivation FROM customer""",
        "schema_gate": """SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN 'invalid record: title' WHEN 2 THEN 'invalid record: paper_id' WHEN 3 THEN 'invalid record: keywords' END AS invalid,
          CASE WHEN p_partkey % 8 = 4 THEN 0.25 ELSE 0.0 END::DOUBLE AS metrics FROM part""",
        "quality_lookup": "SELECT CAST(l_orderkey AS VARCHAR) AS paper_id, max(l_linenumber * 1000000 + l_partkey) AS quality FROM lineitem GROUP BY l_orderkey",
        "paper_details": """SELECT CAST(o_orderkey AS VARCHAR) AS paper_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'why' END AS abstract,
          CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice END AS quality_score, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 0 END AS INTEGER) AS warning_count FROM orders""",
        "text_ranks": "SELECT p_name AS name, row_number() OVER (ORDER BY p_name) - 1 AS rank FROM (SELECT DISTINCT p_name FROM part)",
        "method_edges": """SELECT 'paper:' || o_orderkey AS source, 'method:we_use_' || trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_') AS target,
          'We use ' || o_orderpriority AS label FROM orders""",
        "folded_lists": "SELECT p_partkey, p_name || '|' || p_brand AS items FROM part",
        "heading_names": """SELECT CAST(o_orderkey % 6 AS INTEGER) AS k, CASE o_orderkey % 6 WHEN 0 THEN 'Method' WHEN 1 THEN 'References' WHEN 2 THEN 'Conclusion' WHEN 3 THEN 'Experiments' END AS name,
          count(*) AS n FROM orders GROUP BY o_orderkey % 6""",
        "page_noise": PAGE_NOISE,
        "clean_texts": CLEAN_TEXTS,
        "section_spans": SECTION_SPANS,
    }
