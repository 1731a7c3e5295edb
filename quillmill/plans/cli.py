"""Command line: `python -m quillmill.plans.cli` runs all steps or some; settings come from a YAML file, then options.

Catalogues and providers are the user's: `--setup module:function` names a function that registers providers and gives
(catalogue, fetch), or None for no search.
"""

from __future__ import annotations

import argparse
import importlib
import os
import sys
from collections.abc import Sequence

from quillmill.sources import files

STEPS = ("search", "parse", "extract", "graph")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillmill", description="Mines literature and builds a graph of it.")
    p.add_argument("--config", default="config.yaml", help="YAML file of settings")
    p.add_argument("--query")
    p.add_argument("--paper-id", dest="paper_ids", action="append", help="id to look up; may be repeated")
    p.add_argument("--id-file")
    p.add_argument("--max-results", type=int)
    p.add_argument("--sort-by", choices=["relevance", "submittedDate", "lastUpdatedDate"])
    for name in ("data-dir", "input-dir", "output-dir", "log-path", "provider", "model"):
        p.add_argument(f"--{name}")
    p.add_argument("--max-chars", type=int)
    p.add_argument("--retries", type=int)
    p.add_argument("--metadata-only", action="store_true", default=None)
    p.add_argument("--overwrite-parse", action="store_true", default=None)
    for step in STEPS:
        p.add_argument(f"--skip-{step}", action="store_true")
    p.add_argument("--only", choices=STEPS, help="run one step only")
    p.add_argument("--sample", action="store_true", help="texts are here already: neither search nor parse")
    p.add_argument("--papers", help="paper document to build the graph of, instead of extraction")
    p.add_argument("--prompt", help="file of the prompt template")
    p.add_argument("--aliases", help="YAML file of aliases")
    p.add_argument("--setup", help="module:function that registers providers and gives (catalogue, fetch)")
    return p


def settings(arguments: Sequence[str]) -> tuple[dict, argparse.Namespace]:
    """Settings of a run, and all options."""
    given = parser().parse_args(arguments)
    text = None
    if os.path.exists(given.config):
        with open(given.config, encoding="utf-8") as f:
            text = f.read()
    return files.run_config(text, vars(given)), given


def skipped(given: argparse.Namespace) -> dict[str, bool]:
    out = {f"skip_{s}": getattr(given, f"skip_{s}") or (given.only not in (None, s)) for s in STEPS}
    if given.sample or given.papers:
        out |= {"skip_search": True, "skip_parse": True}
    if given.papers:
        out["skip_extract"] = True
    return out


def main(arguments: Sequence[str] | None = None, spark=None) -> None:
    from quillmill.plans import pipeline

    config, given = settings(sys.argv[1:] if arguments is None else arguments)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("quillmill").getOrCreate()
    catalogue = fetch = None
    if given.setup:
        module, _, name = given.setup.partition(":")
        catalogue, fetch = getattr(importlib.import_module(module), name)() or (None, None)
    read = lambda path: files.prompt_template(path) if path else None
    if given.papers:
        pipeline.papers_from(spark, given.papers, config["output_dir"])
    steps = skipped(given)
    if not steps["skip_search"] and not (config["query"] or config["paper_ids"] or config["id_file"]):
        raise SystemExit("a search needs --query, --paper-id or --id-file; or give --skip-search")
    done = pipeline.run(spark, template=read(given.prompt) or "", alias_text=read(given.aliases), catalogue=catalogue, fetch=fetch, **config, **steps)
    print(done)


if __name__ == "__main__":
    main()
