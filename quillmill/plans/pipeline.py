"""Whole run: catalogue and PDF files to texts, texts to records, quality, graph, analytics and exports.

Tables between steps are Parquet under `data_dir`/tables and `output_dir`/tables; the documents that people read are
single files beside them.
"""

from __future__ import annotations

import logging
import os
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import analytics, extract, graph, providers, quality
from quillmill.plans.runmeta import graph_metadata, run_metadata
from quillmill.schema import PAPER_FIELDS
from quillmill.sinks import exports
from quillmill.sources import files, literature

LOGGER = "quillmill.run"


@dataclass
class Summary:
    downloaded: int = 0
    parsed: int = 0
    texts: int = 0
    papers: int = 0
    failures: int = 0
    warnings: int = 0
    nodes: int = 0
    edges: int = 0


def run_logger(path: str, console: bool = True) -> logging.Logger:
    """Logger of runs, with a file and the console; handlers of an earlier run are replaced."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    log = logging.getLogger(LOGGER)
    log.setLevel(logging.INFO)
    log.propagate = False
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    made = [logging.FileHandler(path, encoding="utf-8"), *([logging.StreamHandler()] if console else [])]
    for k, handler in enumerate(made):
        handler.setFormatter(logging.Formatter("%(levelname)s | %(message)s" if k else "%(asctime)s | %(levelname)s | %(message)s"))
        log.addHandler(handler)
    return log


def storing(spark: SparkSession, folder: str) -> Callable[[DataFrame, str], DataFrame]:
    """A function that writes a table under `folder` and reads it again."""

    def store(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    return store


def extract_step(spark: SparkSession, texts: DataFrame, output_dir: str, *, provider: str = "mock", model: str | None = None, template: str = "", metadata: DataFrame | None = None, only_metadata: bool = False, **how) -> tuple[DataFrame, DataFrame]:
    """Stored papers (PAPER fields, paper_pos) and failures (paper_id, text_path, error) of texts."""
    store = storing(spark, f"{output_dir}/tables")
    if only_metadata and metadata is not None:
        texts = analytics.metadata_only(texts, metadata)
    if provider == "mock":
        papers, failures = extract.builtin_extract(texts, metadata), spark.createDataFrame([], "paper_id string, text_path string, error string")
    else:
        papers, failures = providers.extract_papers(texts, providers.provider_for(provider, model), template, store, metadata=metadata, **how)
    held = store(papers.select(*PAPER_FIELDS).join(texts.select("paper_id", "paper_pos"), "paper_id"), "papers_in_order")
    return held, store(failures, "failures")


def write_extraction(spark: SparkSession, papers: DataFrame, failures: DataFrame, folder: str, *, provider: str = "mock", model: str | None = None, template: str = "") -> None:
    """papers.json and .csv, failures, warnings and quality as documents."""
    in_order = papers.orderBy("paper_pos").select(*PAPER_FIELDS)
    about = run_metadata(spark, provider=provider, model=providers.model_for(provider, model), prompt=template).first().asDict()
    exports.write_json_document(in_order, f"{folder}/papers.json", run_metadata=about)
    exports.write_single_csv(in_order, f"{folder}/papers.csv")
    exports.write_json_document(failures.orderBy("paper_id"), f"{folder}/failed_papers.json")
    exports.write_json_document(quality.quality_warnings(papers.orderBy("paper_pos")), f"{folder}/extraction_warnings.json")
    exports.write_json_document(quality.quality_report(papers), f"{folder}/extraction_quality_report.json")


def graph_step(spark: SparkSession, papers: DataFrame, output_dir: str, *, aliases: dict[str, str] | None = None, source: dict | None = None, fuzzy: bool = True, connect=None) -> tuple[DataFrame, DataFrame]:
    """Stored nodes and edges and the ten documents of a graph; with `connect` also the upsert into a database."""
    store = storing(spark, f"{output_dir}/tables")
    # mentions are resolved once and stored: nodes and edges both read them
    named = store(graph.named_mentions(papers, aliases=aliases, fuzzy=fuzzy), "mentions")
    nodes, edges = (store(df, name) for df, name in zip(graph.graph_of(papers, named), ("nodes", "edges")))
    os.makedirs(output_dir, exist_ok=True)
    exports.write_node_link(nodes, edges, f"{output_dir}/graph.json")
    exports.write_analysis(analytics.graph_analysis(nodes, edges, papers), f"{output_dir}/graph_analysis.json", run_metadata=graph_metadata(source or {}))
    exports.write_gexf(nodes, edges, f"{output_dir}/graph.gexf")
    exports.write_graphml(nodes, edges, f"{output_dir}/graph.graphml")
    exports.write_single_csv(exports.nodes_table(nodes, edges), f"{output_dir}/nodes.csv")
    exports.write_single_csv(exports.edges_table(edges), f"{output_dir}/edges.csv")
    exports.write_cypher_file(nodes, edges, f"{output_dir}/neo4j_import.cypher")
    exports.write_cypher_examples(f"{output_dir}/neo4j_example_queries.cypher")
    exports.write_html(nodes, edges, f"{output_dir}/graph.html")
    exports.write_html(nodes, edges, f"{output_dir}/graph_interactive.html")
    if connect is not None:
        exports.upsert_graph(nodes, edges, connect)
    return nodes, edges


def search_step(spark: SparkSession, catalogue: literature.Catalogue, fetch, data_dir: str, **what) -> tuple[DataFrame, DataFrame]:
    """Metadata and failures of papers that are found and fetched; PDF files are written by the driver, one at a time."""
    store, folder = storing(spark, f"{data_dir}/tables"), f"{data_dir}/raw_pdfs"
    os.makedirs(folder, exist_ok=True)
    here = spark.createDataFrame([(f"{folder}/{name}",) for name in os.listdir(folder)], "pdf_path string")
    metadata, failures, pdfs = literature.download(literature.find(spark, catalogue, **what), folder, here, fetch, store)
    metadata = store(metadata, "metadata")
    for r in pdfs.toLocalIterator():
        with open(r["pdf_path"], "wb") as f:
            f.write(r["content"])
    exports.write_json_document(metadata, f"{data_dir}/metadata/arxiv_metadata.json")
    exports.write_single_csv(metadata, f"{data_dir}/metadata/arxiv_metadata.csv")
    exports.write_json_document(failures, f"{data_dir}/metadata/arxiv_download_failures.json")
    return metadata, failures


def parse_step(spark: SparkSession, pdf_dir: str, text_dir: str, *, overwrite: bool = False, pages_of=files.pages_by_library) -> int:
    """Text files of PDF files; the number of PDF files, parsed before or now."""
    os.makedirs(text_dir, exist_ok=True)
    done = spark.createDataFrame([(name[:-4],) for name in os.listdir(text_dir) if name.endswith(".txt")], "paper_id string")
    texts, counts = files.parsed_texts(files.pdf_directory(spark, pdf_dir), done, pages_of, overwrite=overwrite)
    found = counts.first()
    if found["pending"]:
        exports.write_texts(texts, text_dir)
    return found["found"]


def run(
    spark: SparkSession, input_dir: str | None = None, output_dir: str = "outputs", *, data_dir: str = "data", query: str | None = None, paper_ids: Sequence[str] | None = None, id_file: str | None = None,
    max_results: int = 5, sort_by: str = "relevance", catalogue: literature.Catalogue | None = None, fetch=None, provider: str = "mock", model: str | None = None, template: str = "", max_chars: int = 25_000,
    retries: int = 3, metadata_only: bool = False, overwrite_parse: bool = False, alias_text: str | None = None, fuzzy: bool = True, connect=None, log_path: str | None = None,
    skip_search: bool = True, skip_parse: bool = True, skip_extract: bool = False, skip_graph: bool = False,
) -> Summary:
    """Steps that aren't skipped, in order; each reads what the ones before left in the folders."""
    log, done = run_logger(log_path) if log_path else logging.getLogger(LOGGER), Summary()
    input_dir = input_dir or f"{data_dir}/text"
    log.info("run: provider=%s model=%s query=%s ids=%s", provider, providers.model_for(provider, model), query or "", len(paper_ids or []))
    metadata = None
    if not skip_search:
        if catalogue is None or fetch is None:
            raise ValueError("a search needs a catalogue and a function that fetches")
        metadata, failed = search_step(spark, catalogue, fetch, data_dir, query=query, ids=paper_ids, id_file=id_file, max_results=max_results, sort_by=sort_by)
        done.downloaded = metadata.count()
        log.info("search: %s papers, %s failures", done.downloaded, failed.count())
    elif os.path.isdir(f"{data_dir}/tables/metadata"):
        metadata = spark.read.parquet(f"{data_dir}/tables/metadata")
    if not skip_parse:
        done.parsed = parse_step(spark, f"{data_dir}/raw_pdfs", input_dir, overwrite=overwrite_parse)
        log.info("parse: %s files", done.parsed)
    if not skip_extract:
        texts = files.text_directory(spark, input_dir)
        how = {} if provider == "mock" else {"max_chars": max_chars, "attempts": retries}
        papers, failures = extract_step(spark, texts, output_dir, provider=provider, model=model, template=template, metadata=metadata, only_metadata=metadata_only, **how)
        write_extraction(spark, papers, failures, f"{data_dir if data_dir != 'data' else output_dir}/extracted", provider=provider, model=model, template=template)
        done.texts, done.papers, done.failures = texts.count(), papers.count(), failures.count()
        done.warnings = quality.quality_warnings(papers).count()
        log.info("extract: %s papers, %s failures, %s warnings", done.papers, done.failures, done.warnings)
    if not skip_graph:
        papers = spark.read.parquet(f"{output_dir}/tables/papers_in_order")
        about = run_metadata(spark, provider=provider, model=providers.model_for(provider, model), prompt=template).first().asDict()
        nodes, edges = graph_step(spark, papers, output_dir, aliases=files.aliases_from(alias_text), source=about, fuzzy=fuzzy, connect=connect)
        done.nodes, done.edges = nodes.count(), edges.count()
        log.info("graph: %s nodes, %s edges", done.nodes, done.edges)
    log.info("done: %s", asdict(done))
    return done


def papers_from(spark: SparkSession, path: str, output_dir: str) -> None:
    """Take a paper document as the stored papers of `output_dir`, so that a run can start at its graph."""
    papers, _ = files.papers_document(spark, path)
    storing(spark, f"{output_dir}/tables")(papers.withColumn("paper_pos", F.col("paper_pos").cast("long")), "papers_in_order")
