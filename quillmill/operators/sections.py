"""Sections of papers: headings, spans between them, and chunks of bounded length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.schema import SECTION_ALIASES, STOP_SECTIONS


#: Longer lines are no headings: 80 characters of a name with a number, marks and white space around it.
MAX_HEADING = 400


def heading_name(line: Column) -> Column:
    """Canonical section of a heading line, `References` for the ones that end a paper, else null."""
    bare = F.regexp_replace(T.collapse_ends(line), r"(?iU)^\s*(?:\d+(?:\.\d+)*\.?|[ivxlc]+\.)\s+", "")
    bare = F.lower(F.btrim(bare, F.lit(" .:-\t")))
    out = F.when((bare == "") | (F.length(bare) > 80), F.lit(None).cast("string")).when(bare.isin(STOP_SECTIONS), F.lit("References"))
    for name, aliases in SECTION_ALIASES.items():
        out = out.when(bare.isin(aliases), F.lit(name))
    return out


def by_paper(*order: str) -> Window:
    return Window.partitionBy("paper_id").orderBy(*order)


def sections(texts: DataFrame) -> DataFrame:
    """paper_id, pos, section_name, text: what stands before the first heading is Front Matter; the first
    References heading ends the paper; a paper without headings or bodies is Full Paper. Spans are cut within a
    row: heading lines are numbered, the lines between two of them are a slice."""
    whole = texts.select("paper_id", F.coalesce("text", F.lit("")).alias("text"))
    full = F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit("Full Paper").alias("section_name"), F.col("text").alias("text")))
    return whole.select("paper_id", F.inline(F.coalesce(T.let(T.lines_of(F.col("text")), _spans), full)))


def _spans(lines: Column) -> Column:
    """Sections of a text's lines, as array<struct<pos, section_name, text>>; null if there are none."""
    named = F.transform(lines, lambda x, k: F.struct(k.alias("n"), F.when(F.length(x) <= MAX_HEADING, heading_name(x)).alias("name")))
    return T.let(F.filter(named, lambda x: x["name"].isNotNull()), lambda heads: _between(lines, heads))


def _between(lines: Column, heads: Column) -> Column:
    last = F.try_element_at(F.filter(heads, lambda x: x["name"] == "References"), F.lit(1))["n"]
    end = F.coalesce(last, F.size(lines))
    front = F.array(F.struct(F.lit(-1).alias("n"), F.lit("Front Matter").alias("name")))

    def cut(held: Column, stop: Column) -> Column:
        def span(x: Column, k: Column) -> Column:
            size = F.coalesce(F.get(held, k + 1)["n"], stop) - x["n"] - 1
            body = T.collapse_ends(F.array_join(F.slice(lines, x["n"] + 2, F.greatest(F.lit(0), size)), "\n"))
            return F.struct(k.cast("long").alias("pos"), x["name"].alias("section_name"), body.alias("text"))

        return F.when(F.size(heads) > 0, F.filter(F.transform(held, span), lambda s: s["text"] != ""))

    before = lambda stop: F.concat(front, F.filter(heads, lambda x: x["n"] < stop))
    found = T.let(end, lambda stop: T.let(before(stop), lambda held: cut(held, stop)))
    return T.let(found, lambda f: F.when(F.size(f) > 0, f))


def chunks(parts: DataFrame, most: int = 25_000) -> DataFrame:
    """Sections split at blank lines into chunks of about `most` characters; one long paragraph stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("size"), F.lit(False).alias("any"))

    def step(a: Column, p: Column) -> Column:
        cost = F.length(p) + 2
        full = a["any"] & (a["size"] + cost > most)
        return F.struct(
            F.when(full, F.array_append(a["done"], a["cur"])).otherwise(a["done"]).alias("done"),
            F.when(full | ~a["any"], p).otherwise(F.concat(a["cur"], F.lit("\n\n"), p)).alias("cur"),
            F.when(full, cost).otherwise(a["size"] + cost).alias("size"),
            F.lit(True).alias("any"),
        )

    paragraphs = F.filter(F.transform(F.split("text", r"(?U)\n\s*\n"), T.collapse_ends), lambda x: x != "")
    split = F.aggregate(paragraphs, start, step, lambda a: F.when(a["any"], F.array_append(a["done"], a["cur"])).otherwise(a["done"]))
    many = F.when(F.length("text") <= most, F.array("text")).otherwise(split)
    at = parts.withColumn("parts", many).select("paper_id", "pos", "section_name", F.size("parts").alias("n"), F.posexplode("parts").alias("part", "text"))
    return at.select("paper_id", "pos", "part", F.when(F.col("n") > 1, F.concat("section_name", F.lit(" part "), (F.col("part") + 1).cast("string"))).otherwise(F.col("section_name")).alias("section_name"), "text")
