"""Token counts by a map-side two-tier lookup, and token ids through the same worker cache.

The unit of lookup is a pre-token: a run of white space with the run of other characters after it.
Both tokenizers cut every text at the ends of these units, whatever stands around them, so counts
and ids of a text are those of its units in order. Special strings hold no white space, so they stay
whole inside a unit, which the library encodes by its own rules.

Tier 1 is a broadcast table of the lengths of frequent pre-tokens (at most `table_size` entries),
found in a bounded sample of documents; it is a cache only and never changes a count. Tier 2 is a
cache of each Python worker, filled by the library itself, in two generations of bounded size. No pre-token of the
corpus is ever shuffled; only the short per-task summaries of the sample (about SAMPLE_DOCS documents) are.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); long units are encoded but not
cached; repeated rows are counted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as the tokenizers see it; Python's \s also has the four separators \x1c-\x1f.
UNIT = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
TABLE_SIZE = 30_000
SAMPLE_DOCS = 3_000
CACHE_SIZE = 80_000
SLICE = 500
CACHED_LENGTH = 48


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class UnitCache(dict):
    """pre-token -> made(ids); asks the library for what it lacks. Bounded: when full, it becomes the older
    generation, from which what is asked for again comes back."""

    def __init__(self, encode: Callable[[str], object], first: dict | None = None, size: int = CACHE_SIZE):
        super().__init__(first or {})
        self.encode, self.first, self.most = encode, first or {}, size + len(first or {})
        self.older: dict = {}

    def __missing__(self, unit: str):
        made = self.older.get(unit)
        if made is None:
            made = self.encode(unit)
        if len(unit) <= CACHED_LENGTH:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
                self.update(self.first)
            self[unit] = made
        return made


def frequent_units(docs: DataFrame, text: str = "text", *, sample_docs: int = SAMPLE_DOCS, table_size: int = TABLE_SIZE, seed: int = 11) -> list[str]:
    """Frequent pre-tokens of about `sample_docs` documents, at most `table_size`."""
    n = docs.count()
    if not n:
        return []

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(u for u in UNIT.findall(t) if len(u) <= CACHED_LENGTH)
            if len(seen) > 20 * table_size:
                seen = Counter(dict(seen.most_common(4 * table_size)))
        top = seen.most_common(table_size)
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64())], ["unit", "n"])

    sample = docs.where(F.col(text).isNotNull()).select(text).sample(min(1.0, sample_docs / n), seed)
    merged = sample.mapInArrow(summaries, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")).where("n > 1")
    return [r["unit"] for r in merged.orderBy(F.desc("n"), "unit").limit(table_size).collect()]


def count_tokens(docs: DataFrame, tokenizer_path: str, *, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """key, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text."""
    units = frequent_units(docs, text)
    library = load_tokenizer(tokenizer_path)
    table = docs.sparkSession.sparkContext.broadcast({u: len(e.ids) for u, e in zip(units, library.encode_batch(units, add_special_tokens=False))})
    parts = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(tokenizer_path)
        lengths = UnitCache(lambda u: len(tokenizer.encode(u, add_special_tokens=False).ids), table.value)
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            texts = batch.column(1)
            n = [sum(map(lengths.__getitem__, UNIT.findall(t))) for t in texts.to_pylist()]
            size = pa.compute.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], [key, "n_bytes", "n_tokens", "over_limit"])

    return parts.mapInArrow(count, f"{key} {parts.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
