"""Text functions as Column expressions. Patterns use (?U), so that word, digit and space classes are Unicode."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillmill.schema import CLEANER_HEADINGS

LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
WHITE = r"(?U)[\s\x1c-\x1f]"
#: Characters whose case folding is not their lower case, with the folding.
FOLDINGS = {c: c.casefold() for c in "ßŉſǰẖẗẘẙẚẞﬀﬁﬂﬃﬄﬅﬆ"}


@F.udf(StringType(), useArrow=True)
def nfkc(text: str) -> str:
    """Unicode NFKC; Spark has no function for it."""
    return None if text is None else unicodedata.normalize("NFKC", text)


@F.udf(ArrayType(StringType()), useArrow=True)
def nfkc_each(texts: list[str]) -> list[str]:
    return None if texts is None else [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]


nfkc_each = nfkc_each.asNondeterministic()  # so that its result is made once and not inside other expressions


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once; inside lambdas, Spark would compute it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WHITE + "+", " "))


def dehyphenate(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")


def lines_of(text: Column) -> Column:
    """Lines as Python's splitlines gives them: a last empty line doesn't count."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def is_page_number(line: Column) -> Column:
    return collapse(line).rlike(r"(?U)^[-–—]?\s*\d{1,4}\s*[-–—]?$")


def is_heading(line: Column) -> Column:
    bare = F.regexp_replace(F.lower(collapse_ends(line)), r"(?U)^\d+(\.\d+)*\s*", "")
    return F.btrim(bare, F.lit(".: ")).isin(CLEANER_HEADINGS)


def collapse_ends(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(F.regexp_replace(text, rf"^{WHITE}+", ""), rf"{WHITE}+$", "")


def normalize_headings(text: Column) -> Column:
    shown = F.transform(lines_of(text), lambda x: F.when(is_heading(x), F.concat(F.lit("\n"), F.upper(collapse_ends(x)), F.lit("\n"))).otherwise(x))
    return F.array_join(shown, "\n")


def clean_text(text: Column, *, unicode: bool = True) -> Column:
    out = dehyphenate(nfkc(text) if unicode else text)
    out = F.regexp_replace(F.replace(out, F.lit("\r"), F.lit("\n")), r"[ \t]+", " ")
    out = normalize_headings(F.regexp_replace(out, r"\n{3,}", "\n\n"))
    return collapse_ends(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def drop_page_noise(pages: Column, edge_lines: int = 3) -> Column:
    """Pages without lines that repeat at their edges and without page numbers; fewer than three pages stay."""
    def edges_of(filled: Column) -> Column:
        return F.flatten(F.transform(filled, lambda x: F.concat(F.slice(x, 1, edge_lines), F.slice(x, F.greatest(F.lit(1), F.size(x) - (edge_lines - 1)), edge_lines))))

    def noise_in(edges: Column, n_pages: Column) -> Column:
        least = F.greatest(F.lit(3), F.floor(n_pages * F.lit(0.35)).cast("int"))
        often = let(F.array_sort(edges), lambda s: F.array_distinct(F.filter(s, lambda x, k: F.get(s, k + least - 1) == x)))
        return F.filter(often, lambda x: (F.length(x) <= 140) & ~is_heading(x))

    def without(filled: Column, noise: Column) -> Column:
        return F.transform(filled, lambda p: F.array_join(F.filter(p, lambda x: ~F.array_contains(noise, x) & ~is_page_number(x)), "\n"))

    filled = F.transform(pages, lambda p: F.filter(F.transform(lines_of(p), collapse_ends), lambda x: x != ""))
    kept = let(filled, lambda f: let(let(edges_of(f), lambda e: noise_in(e, F.size(f))), lambda noise: without(f, noise)))
    return F.when(F.size(pages) < 3, pages).otherwise(kept)


def clean_pages(rows: DataFrame, pages: str = "pages", text: str = "text") -> DataFrame:
    """Adds the cleaned text of an array of pages: NFKC of each page, then page noise, then `clean_text`."""
    held = f"{pages}_nfkc"
    at = rows.withColumn(held, nfkc_each(pages))
    whole = F.array_join(drop_page_noise(F.col(held)), "\n\n")
    return at.withColumn(text, clean_text(whole, unicode=False)).drop(held)


TRUNCATED = "\n\n[... middle content truncated ...]\n\n"


def truncate(text: Column, most: int = 25_000, marker: str = TRUNCATED) -> Column:
    head, tail = int(most * 0.7), int(most * 0.3)
    end = F.right(text, F.lit(tail)) if tail else text
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(marker), end))


def safe_filename(value: Column, most: int = 120) -> Column:
    out = F.regexp_replace(value, r"(?U)[^\w\s.-]", "")
    out = F.btrim(F.regexp_replace(collapse_ends(out), WHITE + "+", "_"), F.lit("._"))
    return F.left(F.when(out == "", F.lit("untitled")).otherwise(out), F.lit(most))


def first_line(text: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(F.transform(lines_of(text), collapse_ends), lambda x: x != ""), F.lit(1)), F.lit(""))


def normalize_entity(value: Column) -> Column:
    return F.btrim(collapse(value), F.lit(" .,:;"))


def casefolded(value: Column) -> Column:
    for c, to in FOLDINGS.items():
        value = F.replace(value, F.lit(c), F.lit(to))
    return F.lower(value)


def canonical_key(value: Column) -> Column:
    return F.btrim(F.regexp_replace(casefolded(normalize_entity(value)), "[^a-z0-9]+", " "), F.lit(" "))


def node_id(kind: Column, label: Column) -> Column:
    slug = F.btrim(F.regexp_replace(F.lower(normalize_entity(label)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.concat(F.lower(kind), F.lit(":"), slug)


def first_sentence(value: Column, most: int = 100) -> Column:
    text = collapse(value)
    found = F.regexp_extract(text, r"(?U)^(.+?[.!?])\s", 1)
    sentence = F.when(found != "", found).otherwise(text)
    return F.when(F.length(sentence) > most, F.concat(F.rtrim(F.left(sentence, F.lit(most - 3))), F.lit("..."))).otherwise(sentence)


def html_escape(value: Column) -> Column:
    for c, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(c), F.lit(to))
    return value


def json_object_in(raw: Column) -> Column:
    """The object in a fence, else from the first brace to the last; null if there is none."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(bare, F.lit("")))


def has_term(text: Column, term: str) -> Column:
    return text.rlike(r"(?i)(?<![A-Za-z0-9-])\Q" + term + r"\E(?![A-Za-z0-9-])")


def known_terms(text: Column, terms: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(has_term(text, t), F.lit(t)) for t in terms]))
