"""Extraction by a model provider: row-level retries with error feedback, and dead-letter rows."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import extract, quality, sections
from quillmill.schema import PAPER_FIELDS


class Provider(Protocol):
    def complete(self, prompt: str) -> str: ...


#: Makers of providers by name; a worker makes one provider for a partition. `register` adds more.
_MAKERS: dict[str, Callable[[str], Provider]] = {}
# Models that a run uses if it names none.
DEFAULT_MODELS = {"mock": "mock", "openrouter": "openai/gpt-4o-mini", "gemini": "gemini-1.5-flash"}


def register(name: str, make: Callable[[str], Provider]) -> None:
    """`make` gets the model's name; it must be picklable and read its key from the worker's environment."""
    _MAKERS[name] = make


def provider_for(name: str, model: str | None = None) -> Callable[[], Provider]:
    """Maker of the named provider's clients."""
    if name not in _MAKERS:
        raise ValueError(f"no provider is registered as {name!r}")
    make, chosen = _MAKERS[name], model_for(name, model)
    return lambda: make(chosen)


def model_for(provider: str, model: str | None = None) -> str:
    return "mock" if provider == "mock" else model or DEFAULT_MODELS.get(provider, "default")


def object_in(raw: str) -> dict:
    fenced = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", raw, re.S)
    text = fenced[1] if fenced else raw[raw.find("{") : raw.rfind("}") + 1] if "{" in raw else ""
    if not text:
        raise ValueError("no JSON object in the answer")
    return json.loads(text)


def with_retries(operation: Callable[[str], dict], *, attempts: int = 3, sleep_seconds: float = 0.0) -> dict:
    """Calls `operation` with the last error's text until it succeeds; waits longer after each failure."""
    error = ""
    for k in range(1, max(1, attempts) + 1):
        try:
            return operation(error)
        except Exception as e:  # noqa: BLE001 - any failure of a row is kept as its error
            error = str(e)
            if k < attempts and sleep_seconds:
                time.sleep(sleep_seconds * k)
    raise RuntimeError(f"failed after {attempts} attempts: {error}")


SLOTS = ("paper_id", "metadata_json", "paper_text", "section_name", "extraction_mode", "previous_error")


def fill(template: str, **values: str) -> str:
    """The prompt of a template; slots that aren't given are empty."""
    return template.format(**{slot: values.get(slot, "") for slot in SLOTS})


def ask_for_records(rows: DataFrame, make_provider: Callable[[], Provider], template: str, *, attempts: int = 3, sleep_seconds: float = 0.0, all_fields: bool = True) -> DataFrame:
    """paper_id, pos, json, error of each row (paper_id, pos, section_name, text; also metadata_json, mode, suffix and
    reason, if given). Store the result before reading it twice: a call may cost money and need not answer alike again."""
    have = [c if c in rows.columns else F.lit("").alias(c) for c in ("metadata_json", "mode", "suffix", "reason")]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make_provider()
        for batch in batches:
            out = []
            for r in batch.itertuples():

                def once(error: str, r=r) -> dict:
                    values = {"paper_id": r.paper_id, "section_name": r.section_name, "paper_text": r.text, "metadata_json": r.metadata_json, "extraction_mode": r.mode}
                    held = object_in(provider.complete(fill(template, **values, previous_error=error or r.reason) + r.suffix))
                    held.setdefault("paper_id", r.paper_id)
                    if all_fields and (gone := [f for f in PAPER_FIELDS if f not in held]):
                        raise ValueError("missing fields: " + ", ".join(gone))
                    return held

                try:
                    out.append((r.paper_id, r.pos, json.dumps(with_retries(once, attempts=attempts, sleep_seconds=sleep_seconds), ensure_ascii=False), None))
                except RuntimeError as e:
                    out.append((r.paper_id, r.pos, None, str(e)))
            yield pd.DataFrame(out, columns=["paper_id", "pos", "json", "error"])

    kinds = "paper_id string, pos long, json string, error string"
    return rows.select("paper_id", "pos", "section_name", "text", *have).mapInPandas(ask, kinds)


def extract_with(chunks: DataFrame, make_provider: Callable[[], Provider], template: str, *, attempts: int = 3, sleep_seconds: float = 0.0, all_fields: bool = True) -> DataFrame:
    """paper_id, pos, json, error for each chunk (paper_id, pos, section_name, text)."""
    return ask_for_records(chunks, make_provider, template, attempts=attempts, sleep_seconds=sleep_seconds, all_fields=all_fields)


def _merged(records: DataFrame, seed: DataFrame) -> DataFrame:
    """One record a paper from seeds and records (paper_id, pos, paper)."""
    rows = records.select("pos", F.col("paper_id").alias("of"), "paper.*").withColumn("paper_id", F.col("of")).drop("of")
    return extract.merge_chunks(seed.unionByName(rows.select(*seed.columns)))


def _error_of(records: DataFrame) -> DataFrame:
    """paper_id and the first error (by pos) of papers with a failed or invalid record."""
    wrong = F.coalesce("error", "invalid")
    return records.where(wrong.isNotNull()).groupBy("paper_id").agg(F.min_by(wrong, "pos").alias("error"))


def extract_papers(
    texts: DataFrame, make_provider: Callable[[], Provider], template: str, store: Callable[[DataFrame, str], DataFrame], *, metadata: DataFrame | None = None,
    max_chars: int = 25_000, attempts: int = 3, sleep_seconds: float = 0.0,
) -> tuple[DataFrame, DataFrame]:
    """(papers, failures) of texts (paper_id, text_path, text). Sections are asked for one by one and merged over the
    metadata's seed; a paper with warnings is asked for once more as a whole. A paper fails if any of its answers does.

    `store` (table, name) must write a table and read it again, since providers' answers can't be made twice.
    """
    spark = texts.sparkSession
    whole = texts.select("paper_id", F.coalesce("text", F.lit("")).alias("text"))
    if metadata is None:
        metadata = spark.createDataFrame([], "paper_id string")
    notes = metadata.select("paper_id", F.to_json(F.struct(*metadata.columns)).alias("metadata_json"))
    noted = lambda df: df.join(notes, "paper_id", "left").withColumn("metadata_json", F.coalesce("metadata_json", F.lit("{}")))
    cut = lambda c: T.truncate(F.col(c), max_chars).alias("text")
    order = F.row_number().over(sections.by_paper("pos", "part")).cast("long")
    chunks = sections.chunks(sections.sections(whole), max_chars).select("paper_id", order.alias("pos"), "section_name", cut("text"), F.lit("section_chunk").alias("mode"))
    how = {"sleep_seconds": sleep_seconds}
    asked = store(ask_for_records(noted(chunks), make_provider, template, attempts=attempts, **how), "answers")
    gated = extract.papers_from_json(asked)
    failed = _error_of(gated)
    seed = extract.metadata_seed(whole.join(failed, "paper_id", "left_anti"), metadata)
    merged = store(_merged(gated.join(failed, "paper_id", "left_anti"), seed), "merged")
    warned = merged.withColumn("w", quality.warnings_of()).where(F.size("w") > 0)
    again = warned.select("paper_id", F.lit(1).cast("long").alias("pos"), F.lit("Targeted Retry").alias("section_name"), F.lit("targeted_retry").alias("mode"), F.array_join("w.warning", "; ").alias("reason"), _retry_note().alias("suffix"))
    again = again.join(whole.select("paper_id", cut("text")), "paper_id")
    tries = max(1, min(2, attempts))
    retried = extract.papers_from_json(store(ask_for_records(noted(again), make_provider, template, attempts=tries, **how), "retries"))
    failed_again = _error_of(retried)
    base = merged.withColumn("pos", F.lit(0).cast("long")).select(F.col("pos"), *PAPER_FIELDS)
    first = extract.metadata_seed(merged, metadata).unionByName(base)
    papers = store(_merged(retried.join(failed_again, "paper_id", "left_anti"), first.join(failed_again, "paper_id", "left_anti")), "papers")
    failures = texts.select("paper_id", "text_path").join(failed.unionByName(failed_again), "paper_id")
    return papers, failures


def _retry_note() -> Column:
    """What a targeted retry's prompt ends with: the record so far, and what to improve."""
    record = F.to_json(F.struct(*PAPER_FIELDS))
    fields = F.array_join(F.array_sort(F.array_distinct("w.field")), ", ")
    # Fixed text of the prompt.
    return F.concat(
        F.lit("\n\nCurrent merged extraction:\n"), record, F.lit("\n\nTarget fields to improve: "), fields,
        F.lit(".\nReturn the full JSON schema again, preserving reliable existing values and only changing fields that the text supports."),
    )


def split_failures(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with and without an `error`: (good ones, without the column; failed ones: paper_id, text_path, error)."""
    return rows.where("error is null").drop("error"), rows.where("error is not null").select("paper_id", "text_path", "error")
