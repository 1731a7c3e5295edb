"""File sources: text folders, id lists, metadata, paper documents, aliases and configurations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions.text import clean_pages
from quillmill.operators.entities import alias_map
from quillmill.schema import DEFAULT_ALIASES, PAPER

# Known settings of a run and what they are by default.
DEFAULTS = {
    "query": None, "paper_ids": None, "id_file": None, "max_results": 5, "sort_by": "relevance", "data_dir": "data", "input_dir": None, "output_dir": "outputs",
    "log_path": "outputs/pipeline.log", "provider": "mock", "model": None, "max_chars": 25000, "retries": 3, "metadata_only": False, "overwrite_parse": False,
}
CONFIG_KEYS = list(DEFAULTS)


def text_directory(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """paper_id (file name without its end), text_path, text and paper_pos (rank of the file name, from ranges
    of names that are ranked in parallel). Bytes that aren't UTF-8 are dropped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)

    @F.udf("string", useArrow=True)
    def decoded(content: bytes) -> str:
        return bytes(content).decode("utf-8", "ignore")

    name = F.element_at(F.split("path", "/"), -1)
    at = files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("paper_id"), F.col("path").alias("text_path"), decoded("content").alias("text"))
    return at.join(ranked(at.select("paper_id"), "paper_id", "paper_pos"), "paper_id")


def ranked(names: DataFrame, name: str, rank: str) -> DataFrame:
    """Distinct names with their place in order, from 0: ranges of names are counted, then ranked on their own."""
    parts = names.distinct().repartitionByRange(name).withColumn("part", F.spark_partition_id())
    parts = parts.select(name, "part")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a range
    inside = F.row_number().over(Window.partitionBy("part").orderBy(name)) - 1
    return parts.withColumn("k", inside).join(F.broadcast(before.select("part", "before")), "part").select(name, (F.col("k") + F.col("before")).cast("long").alias(rank))


def paper_ids(spark: SparkSession, path: str) -> DataFrame:
    """pos and paper_id of an id file: JSON strings or objects (arxiv_id, paper_id or id), or lines without blanks and # lines."""
    if path.endswith(".json"):
        text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file
        found = []
        for x in json.loads(text):
            if not isinstance(x, (str, dict)):
                raise ValueError("an id file holds strings or objects")
            value = x if isinstance(x, str) else next((x[k] for k in ("arxiv_id", "paper_id", "id") if x.get(k)), "")
            found.append(str(value).strip())
        return spark.createDataFrame([(k, v) for k, v in enumerate(v for v in found if v)], "pos int, paper_id string")
    lines = [r[0].strip() for r in spark.read.text(path).collect()]
    return spark.createDataFrame([(k, v) for k, v in enumerate(x for x in lines if x and not x.startswith("#"))], "pos int, paper_id string")


def metadata_index(rows: DataFrame) -> DataFrame:
    """One row a key: the stem of pdf_path and paper_id both find a row; later rows (by pos) win."""
    stem = F.regexp_replace(F.element_at(F.split(F.coalesce("pdf_path", F.lit("")), "/"), -1), r"\.[^.]*$", "")
    keyed = rows.withColumn("key", F.explode(F.array(stem, F.coalesce("paper_id", F.lit(""))))).where("key <> ''")
    whole = F.struct(*[c for c in rows.columns if c != "pos"])
    return keyed.groupBy("key").agg(F.max_by(whole, "pos").alias("row"))


def papers_document(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Papers (PAPER fields, paper_pos) and run metadata of a bare list or a {run_metadata, papers} document."""
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
    kind = text.select(F.trim(F.left(F.ltrim("text"), F.lit(1)))).first()[0]
    if kind == "[":
        papers, meta = F.from_json("text", f"array<{PAPER}>"), {}
    elif kind == "{":
        shape = text.select(F.left(F.ltrim(F.get_json_object("text", "$.papers")), F.lit(1)), F.get_json_object("text", "$.run_metadata")).first()
        if shape[0] not in (None, "["):
            raise ValueError("a paper document holds a list of papers")
        papers = F.from_json("text", f"struct<papers:array<{PAPER}>>")["papers"]
        meta = json.loads(shape[1]) if shape[1] and shape[1].lstrip().startswith("{") else {}
    else:
        raise ValueError("a paper document is a list, or an object with a list of papers")
    rows = text.select(F.posexplode(papers).alias("paper_pos", "p")).select("paper_pos", "p.*")
    return rows, meta


def aliases_from(text: str | None) -> dict[str, str]:
    """Alias map of a YAML text over the defaults: `aliases`, `types`, or a bare mapping."""
    out = alias_map(DEFAULT_ALIASES)
    if not text:
        return out
    import yaml

    held = yaml.safe_load(text) or {}
    if not isinstance(held, dict):
        raise ValueError("an alias file holds a mapping")
    general = held.get("aliases", {} if "types" in held else held) or {}
    types = held.get("types") or {}
    if not isinstance(general, dict) or not isinstance(types, dict):
        raise ValueError("aliases and types are mappings")
    more = alias_map({str(k): str(v) for k, v in general.items()}, {t: {str(k): str(v) for k, v in m.items()} for t, m in types.items()}) if general or types else {}
    return out | more


def config_from(text: str, overrides: dict | None = None) -> dict:
    """Known settings of a YAML text (its `pipeline` section, or the root); overrides that are None don't count."""
    import yaml

    held = yaml.safe_load(text) or {}
    held = held.get("pipeline", held)
    if not isinstance(held, dict):
        raise ValueError("a configuration is a mapping")
    out = {k: v for k, v in held.items() if k in CONFIG_KEYS}
    return out | {k: v for k, v in (overrides or {}).items() if k in CONFIG_KEYS and v is not None}


def run_config(text: str | None, overrides: dict | None = None) -> dict:
    """All settings of a run: defaults, then a YAML text's (if there is one), then overrides that aren't None."""
    return DEFAULTS | config_from(text or "{}", overrides)


def prompt_template(path: str) -> str:
    """The text of a template with slots in braces."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def json_or_default(path: str, default=None):
    """A JSON file's value; a default (an empty list) if there is no such file."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return [] if default is None else default


def csv_or_empty(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; an empty table if there is no such file."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("header", True).option("inferSchema", True).option("escape", '"').option("multiLine", True).csv(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return spark.createDataFrame([], "struct<>")
        raise


def unwrapped(document, field: str):
    """The list `papers` of a document (or a bare list, else nothing), or the mapping `analysis` (or the whole mapping, else
    nothing). Never an error."""
    kind = list if field == "papers" else dict
    if field == "papers" and isinstance(document, list):
        return document
    if isinstance(document, dict) and isinstance(document.get(field), kind):
        return document[field]
    return document if field != "papers" and isinstance(document, dict) else kind()


def pdf_directory(spark: SparkSession, folder: str) -> DataFrame:
    """paper_id, pdf_path and content of the PDF files of a folder; an empty table if there is no such folder."""
    from pyspark.errors import AnalysisException

    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], "path string, content binary")
    return files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("paper_id"), F.col("path").alias("pdf_path"), "content")


def pages_by_library(content: bytes) -> list[str]:
    """Text of each page, if a PDF library is installed."""
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the optional package PyMuPDF") from e
    with fitz.open(stream=content, filetype="pdf") as document:
        return [page.get_text("text", sort=True) for page in document]


def parsed_texts(pdfs: DataFrame, done: DataFrame, pages_of=pages_by_library, *, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """(texts to write: paper_id, text; counts: found, pending) of PDF files. Files whose text is in `done` (paper_id) are
    skipped unless `overwrite`, but counted as found."""
    here = done.select("paper_id", F.lit(not overwrite).alias("here")).distinct()
    flagged = pdfs.join(here, "paper_id", "left").withColumn("pending", ~F.coalesce("here", F.lit(False)))
    pending = flagged.where("pending")

    @F.udf("array<string>", useArrow=True)
    def pages(content: bytes) -> list[str]:
        return pages_of(bytes(content))

    texts = clean_pages(pending.select("paper_id", pages.asNondeterministic()("content").alias("pages"))).select("paper_id", "text")
    counts = flagged.drop("content").agg(F.count("*").alias("found"), F.count_if("pending").alias("pending"))
    return texts, counts
