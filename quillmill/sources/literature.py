"""Catalogues of papers: search, lookup by id, and fetching of their PDF files with dead-letter rows.

A catalogue is an object with `search` and `by_ids` that give RESULT rows. `TableCatalogue` answers from a
DataFrame; one over the network is given by the user, as its client and address are theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators.providers import with_retries
from quillmill.sources.files import paper_ids

RESULT = "arxiv_id string, title string, authors array<string>, summary string, published string, updated string, categories array<string>, entry_url string, pdf_url string"
# Orders of a search.
SORT_FIELDS = {"relevance": None, "submittedDate": "published", "lastUpdatedDate": "updated"}


class Catalogue(Protocol):
    def search(self, query: str, max_results: int, sort_by: str) -> DataFrame: ...

    def by_ids(self, ids: Sequence[str]) -> DataFrame: ...


class TableCatalogue:
    """Catalogue over a table of RESULT rows. Relevance is the number of the query's words in title and summary."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def search(self, query: str, max_results: int, sort_by: str = "relevance") -> DataFrame:
        words = [w for w in query.lower().split() if w]
        seen = F.lower(F.concat_ws(" ", "title", "summary"))
        hits = sum((F.contains(seen, F.lit(w)).cast("int") for w in words), F.lit(0))
        found = self.rows.withColumn("hits", hits).where(F.col("hits") > 0)
        field = SORT_FIELDS[sort_by]
        return found.orderBy(F.desc(field) if field else F.desc("hits"), "arxiv_id").limit(max_results).drop("hits")

    def by_ids(self, ids: Sequence[str]) -> DataFrame:
        wanted = self.rows.sparkSession.createDataFrame([(k, i) for k, i in enumerate(ids)], "pos int, arxiv_id string")
        return self.rows.join(F.broadcast(wanted), "arxiv_id").orderBy("pos").drop("pos")


def search(catalogue: Catalogue, query: str, *, max_results: int = 10, sort_by: str = "relevance") -> DataFrame:
    if sort_by not in SORT_FIELDS:
        raise ValueError(f"sort_by is one of {', '.join(SORT_FIELDS)}")
    return catalogue.search(query, max_results, sort_by)


def lookup(catalogue: Catalogue, ids: Sequence[str]) -> DataFrame:
    wanted = [i.strip() for i in ids if i and i.strip()]
    if not wanted:
        raise ValueError("no ids are given")
    return catalogue.by_ids(wanted)


def requested_ids(spark: SparkSession, ids: Sequence[str] | None, id_file: str | None) -> list[str]:
    """Ids that are given, then those of a file."""
    listed = [r["paper_id"] for r in paper_ids(spark, id_file).orderBy("pos").collect()] if id_file else []
    return [*(ids or []), *listed]


def find(spark: SparkSession, catalogue: Catalogue, *, query: str | None = None, ids: Sequence[str] | None = None, id_file: str | None = None, max_results: int = 10, sort_by: str = "relevance") -> DataFrame:
    """By ids, if there are any, else by a query."""
    wanted = requested_ids(spark, ids, id_file)
    if wanted:
        return lookup(catalogue, wanted)
    if not query:
        raise ValueError("a query or ids are needed")
    return search(catalogue, query, max_results=max_results, sort_by=sort_by)


def looks_like_pdf(content: Column, content_type: Column) -> Column:
    return (F.substring(content, 1, 4) == F.lit(b"%PDF")) | F.coalesce(F.lower(content_type).contains("pdf"), F.lit(False))


def with_paths(results: DataFrame, folder: str) -> DataFrame:
    """Results with paper_id and pdf_path: what metadata rows hold."""
    name = F.concat(T.safe_filename(F.col("arxiv_id")), F.lit("_"), T.safe_filename(F.col("title"), 80), F.lit(".pdf"))
    summary = T.collapse_ends(F.replace("summary", F.lit("\n"), F.lit(" ")))
    return results.withColumn("paper_id", T.safe_filename(F.col("arxiv_id"))).withColumn("summary", summary).withColumn("pdf_path", F.concat(F.lit(folder.rstrip("/") + "/"), name))


METADATA = ["paper_id", "arxiv_id", "title", "authors", "summary", "published", "updated", "categories", "entry_url", "pdf_url", "pdf_path"]


def fetched(pending: DataFrame, fetch: Callable[[str], tuple[bytes, str]], *, attempts: int = 3, sleep_seconds: float = 0.0) -> DataFrame:
    """Adds content and error to rows with a pdf_url. `fetch` gives content and content type; what doesn't look like a
    PDF file is an error. Store the result before reading it twice."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            content, error = [], []
            for url in batch["pdf_url"]:

                def once(_: str, url=url) -> dict:
                    body, kind = fetch(url)
                    if "pdf" not in (kind or "").lower() and not body.startswith(b"%PDF"):
                        raise ValueError(f"what came does not look like a PDF file: {url}")
                    return {"body": body}

                try:
                    content.append(with_retries(once, attempts=attempts, sleep_seconds=sleep_seconds)["body"])
                    error.append(None)
                except RuntimeError as e:
                    content.append(None)
                    error.append(str(e))
            yield batch.assign(content=content, error=error)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pending.schema.fields)
    return pending.mapInPandas(work, f"{kinds}, content binary, error string")


def download(
    results: DataFrame, folder: str, existing: DataFrame, fetch: Callable[[str], tuple[bytes, str]], store: Callable[[DataFrame, str], DataFrame], **how,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metadata, failures, files: pdf_path and content) of results. Files in `existing` (pdf_path) aren't fetched again;
    a failed one is no metadata row. `store` (table, name) writes a table and reads it again."""
    at = with_paths(results, folder)
    here = existing.select("pdf_path").distinct()
    tried = store(fetched(at.join(here, "pdf_path", "left_anti").select(*METADATA), fetch, **how), "fetched")
    failures = tried.where("error is not null").select("paper_id", "title", "pdf_url", "error")
    good = tried.where("error is null")
    metadata = at.join(here, "pdf_path", "left_semi").select(*METADATA).unionByName(good.select(*METADATA))
    return metadata, failures, good.select("pdf_path", "content")
