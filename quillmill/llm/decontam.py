"""Benchmark decontamination by latent semantic retrieval and a check of the words in order.

1. Benchmark items are cut into passages. Document frequencies of the benchmark's words are counted
   over the whole corpus and give the TF-IDF weights.
2. A randomised SVD of the passage-by-word matrix, distributed over the benchmark's rows (every power
   step sums the tasks' products), gives `rank` latent directions.
3. Every window of every document is folded in and compared by cosine with every passage; all windows
   at or above `cosine` are candidates. The index is broadcast (words x rank), the corpus only mapped.
4. A candidate is confirmed if it has at least `paraphrase` of the item's IDF weight, and the longest
   common subsequence of words with the item is at least `verbatim` of it, or at least `paraphrase` of
   it and the item's answer (the column `answer`, else its last sentence) is there to `answered`.

The broadcast index is bounded: a benchmark with more than `max_words` distinct words is dealt into
blocks of items. Blocks are read, indexed, broadcast and searched one after the other, each with a
pass over the corpus for frequencies and one for the search; results are the union.

Defined cases: null or empty texts are kept; very long texts are searched whole, some windows at a time;
items without words are never found; items that share an id are searched each and found under it;
equal shares need no order, item_ids are sorted; repeated rows are judged alike; an empty benchmark
keeps everything; an empty table gives an empty result; extra columns are ignored, or carried in `row`.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.base import written

WINDOW, STRIDE = 64, 32
RANK, OVERSAMPLE, POWER_STEPS = 128, 16, 2
COSINE, VERBATIM, PARAPHRASE, ANSWERED = 0.5, 0.7, 0.5, 0.8
MAX_WORDS = 100_000
SUM_ROWS = 2_048
#: Blocks of STRIDE words that are folded in at a time.
FOLD_BLOCKS = 128
#: Neither letters, digits nor white space.
NEITHER = r"[^\p{L}\p{N}\p{Z}\s\x0b\x1c-\x1f\x{85}]+"
#: Windows that are first checked as one.
TOGETHER = 8
SLICE = 500
#: Cosines that are held at a time.
COSINES = 2_000_000


def split_words(texts: pa.Array) -> pa.ListArray:
    """Words as they are compared: lower case, letters and digits only. Empty ones are to be left out."""
    return pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), NEITHER, ""))


def words(text: str | None) -> list[str]:
    return [w for w in split_words(pa.array([text or ""])).flatten().to_pylist() if w]


def answer_of(text: str) -> str:
    return re.split(r"(?<=[.!?])\s+", text.strip())[-1]


class Ids:
    """Rows of the index of every word of texts; 0 for words that the benchmark lacks."""

    def __init__(self, rows: dict[str, int]):
        self.known = pa.array(["", *rows])  # rows are numbered from 1, in their order

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        listed = split_words(texts)
        at = pc.index_in(listed.flatten(), value_set=self.known.cast(listed.type.value_type))
        ids = at.fill_null(0).to_numpy()
        whole = at.is_null().to_numpy(zero_copy_only=False) | (ids > 0)  # not an empty one
        lengths = pc.list_value_length(listed).to_numpy(zero_copy_only=False)
        ends = np.r_[0, np.cumsum(whole)][np.r_[0, np.cumsum(lengths)]]
        ids = ids[whole]
        return [ids[x:y] for x, y in zip(ends[:-1], ends[1:])]


def windows_of(n: int) -> list[tuple[int, int]]:
    """Windows over n words; the last one ends with them."""
    if n <= WINDOW:
        return [(0, n)]
    starts = list(range(0, n - WINDOW, STRIDE)) + [n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


@dataclass
class Index:
    rows: dict[str, int]
    idf: np.ndarray
    vectors: np.ndarray  # (words + 1) x rank, TF-IDF weights included; row 0 is zero
    passages: np.ndarray  # passages x rank, of length 1
    item_of: np.ndarray
    items: list[tuple[int, np.ndarray, np.ndarray]]  # id, words, words of the answer


def _document_frequencies(docs: DataFrame, rows: dict[str, int]) -> np.ndarray:
    """Documents that hold each of the benchmark's words, over the whole corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found = Ids(shared.value), np.zeros(len(shared.value) + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for own in ids.of(batch.column(0).slice(at, SLICE)):
                    found[np.unique(own)] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["row", "n"])

    counted = docs.where(F.col("text").isNotNull()).select("text").mapInArrow(count, "row long, n long").groupBy("row").agg(F.sum("n").alias("n"))
    df = np.zeros(len(rows) + 1, np.int64)
    for r in counted.collect():  # at most one row for each of the benchmark's words
        df[r["row"]] = r["n"]
    return df


def _tfidf(ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(ids[ids > 0], return_counts=True)
    weights = n * idf[at]
    return at, weights / max(1e-12, float(np.linalg.norm(weights)))


def latent_directions(items: DataFrame, rows: dict[str, int], idf: np.ndarray, *, rank: int, seed: int = 23) -> np.ndarray:
    """Right singular vectors ((words + 1) x rank) of the items' passages: a randomised range finder with
    power steps. Each step, tasks form their rows' share of A'(A Q) and Spark adds the shares up."""
    wide = min(rank + OVERSAMPLE, len(rows) + 1)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(rows) + 1, wide)))[0]
    context = items.sparkSession.sparkContext

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float64) for x in part["share"])
        return pd.DataFrame({"chunk": part["chunk"].iloc[:1], "share": [total.tobytes()]})

    for _ in range(POWER_STEPS):
        shared = context.broadcast((rows, idf, q))

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, idf, q = shared.value
            ids, total = Ids(rows), np.zeros_like(q)
            for batch in batches:
                for whole in ids.of(batch.column(0)):
                    for a, b in windows_of(len(whole)):
                        at, w = _tfidf(whole[a:b], idf)
                        total[at] += np.outer(w, w @ q[at])
            chunks = [k for k in range(0, len(total), SUM_ROWS) if total[k : k + SUM_ROWS].any()]
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([total[k : k + SUM_ROWS].tobytes() for k in chunks], pa.binary())], ["chunk", "share"])

        z = np.zeros_like(q)
        for r in items.select("text").mapInArrow(product, "chunk long, share binary").groupBy("chunk").applyInPandas(add, "chunk long, share binary").collect():
            part = np.frombuffer(r["share"], np.float64).reshape(-1, wide)
            z[r["chunk"] : r["chunk"] + len(part)] = part
        q, values, _ = np.linalg.svd(z, full_matrices=False)
    return q[:, : min(rank, int((values > 1e-9 * max(values.max(initial=0), 1e-30)).sum()))]


Item = tuple[int | None, str, str]


def blocks_of(items: DataFrame, max_words: int) -> Iterator[list[Item]]:
    """Items (id, text, answer) with words, in blocks of at most `max_words` distinct words (an item of its own may have
    more). The driver holds one block at a time."""
    held, seen = [], set()
    for r in items.where("text is not null").orderBy("item_id", "text").toLocalIterator():
        own = set(words(r["text"]))
        if held and len(seen | own) > max_words:
            yield held
            held, seen = [], set()
        if own:
            held.append((r["item_id"], r["text"], r["answer"]))
            seen |= own
    if held:
        yield held


def build_index(docs: DataFrame, items: list[Item], n_docs: int, *, rank: int = RANK) -> Index:
    """The index of one block of items; one pass over `docs` (text) for document frequencies."""
    held = [(item, words(text), words(answer) or words(answer_of(text))) for item, text, answer in items]
    rows = {w: k + 1 for k, w in enumerate(sorted({w for _, text, _ in held for w in text}))}
    idf = np.log((1 + n_docs) / (1 + _document_frequencies(docs, rows))) + 0.05
    spark = docs.sparkSession
    directions = latent_directions(spark.createDataFrame([(text,) for _, text, _ in items], "text string"), rows, idf, rank=rank)
    vectors = np.ascontiguousarray(directions * idf[:, None], np.float32)
    vectors[0] = 0
    listed, passages, item_of = [], [], []
    for k, (item, text, answer) in enumerate(held):
        ids = np.array([rows[w] for w in text], np.int32)
        listed.append((item, ids, np.array([rows.get(w, 0) for w in answer], np.int32)))
        for a, b in windows_of(len(ids)):
            passages.append(vectors[ids[a:b]].sum(0))
            item_of.append(k)
    p = np.array(passages, np.float32)
    return Index(rows, idf, vectors, p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9), np.array(item_of), listed)


class Search:
    """An index with what looking things up in it needs, made once for each task."""

    def __init__(self, index: Index, *, cosine: float, verbatim: float, paraphrase: float, answered: float):
        self.index, self.ids, self.cosine = index, Ids(index.rows), cosine
        self.verbatim, self.paraphrase, self.answered = verbatim, paraphrase, answered
        self.longest = max(len(wanted) for _, wanted, _ in index.items)
        self.words = np.zeros((len(index.items), self.longest), np.int32)  # of each item, padded with 0
        for k, (_, wanted, _) in enumerate(index.items):
            self.words[k, : len(wanted)] = wanted
        self.weights = np.where(self.words > 0, index.idf[self.words], 0)
        self.least = paraphrase * self.weights.sum(1)
        self.masks: list[dict[int, int] | None] = [None] * len(index.items)
        self.stamp, self.now = np.zeros(len(index.rows) + 1, np.int64), 0

    def candidates(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the windows and of the items whose passage has a large enough cosine with them."""
        n, vectors = len(own), self.index.vectors
        if n <= WINDOW:
            folded = vectors[own].sum(0, keepdims=True)
        else:  # a window is two blocks of STRIDE words, but for the last, which ends with the text
            whole, one = n // STRIDE, np.ones((1, STRIDE), np.float32)
            sums = np.empty((whole, vectors.shape[1]), np.float32)
            for k in range(0, whole, FOLD_BLOCKS):
                part = own[k * STRIDE : min(whole, k + FOLD_BLOCKS) * STRIDE]
                sums[k : k + FOLD_BLOCKS] = (one @ vectors.take(part, axis=0).reshape(-1, STRIDE, vectors.shape[1]))[:, 0]
            full = len(range(0, n - WINDOW, STRIDE))
            folded = np.concatenate([sums[:full] + sums[1 : full + 1], vectors[own[n - WINDOW :]].sum(0, keepdims=True)])
        least = self.cosine * np.maximum(np.sqrt(np.einsum("ij,ij->i", folded, folded)), 1e-9)[:, None]
        found, step = [], max(1, COSINES // len(self.index.passages))
        for k in range(0, len(folded), step):
            at, passage = np.nonzero(folded[k : k + step] @ self.index.passages.T >= least[k : k + step])
            found.append((at + k, self.index.item_of[passage]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def weight(self, span: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Weight of each item's words that are in the span."""
        self.now += 1
        self.stamp[span] = self.now
        return ((self.stamp[self.words[items]] == self.now) * self.weights[items]).sum(1)

    def leaks(self, own: np.ndarray) -> dict[int, float]:
        """Items found in the words of a text, with the share of their words found in order."""
        found: dict[int, float] = {}
        if not (own > 0).any():
            return found
        at, items = self.candidates(own)
        spans, group = windows_of(len(own)), at // TOGETHER
        ends = np.flatnonzero(np.diff(group, append=-1)) + 1
        for low, high in zip([0, *ends[:-1].tolist()], ends.tolist()):
            # chance meets are of common words, which weigh little; a wider span bounds every item's own one
            a, b, some = spans[at[low]][0], spans[at[high - 1]][1], items[low:high]
            heavy = self.weight(own[max(0, a - self.longest) : b + self.longest], some) >= self.least[some] * (1 - 1e-9)
            for i, k in zip(at[low:high][heavy].tolist(), some[heavy].tolist()):
                a, b = spans[i]
                item, wanted, answer = self.index.items[k]
                span = own[max(0, a - len(wanted)) : b + len(wanted)]
                if found.get(item, 0) >= 1 or self.weight(span, np.array([k]))[0] < self.least[k]:
                    continue
                if self.masks[k] is None:
                    self.masks[k] = masks_of(wanted)
                share = common_subsequence(wanted, span, self.masks[k]) / len(wanted)
                if share >= self.verbatim or (share >= self.paraphrase and len(answer) and common_subsequence(answer, span) >= self.answered * len(answer)):
                    found[item] = max(found.get(item, 0), share)
        return found


def masks_of(a: np.ndarray) -> dict[int, int]:
    """Places of each word of `a`, as bits; 0 is no word."""
    masks: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << k
    masks.pop(0, None)
    return masks


def common_subsequence(a: np.ndarray, b: np.ndarray, masks: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, bit-parallel over `a`; 0 matches nothing."""
    masks = masks_of(a) if masks is None else masks
    v = full = (1 << len(a)) - 1
    for m in filter(None, map(masks.get, b.tolist())):
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def leaks_in(text: Column, index: Index, **how: float) -> Column:
    """struct<item_ids, share> of the items of one block that are found in a text."""
    shared = SparkSession.active().sparkContext.broadcast(index)

    def look(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        search = Search(shared.value, **how)
        for batch in texts:
            for at in range(0, len(batch), SLICE):
                ids, shares = [], []
                for own in search.ids.of(pc.fill_null(batch.slice(at, SLICE), "")):
                    found = search.leaks(own)
                    ids.append(sorted(found, key=lambda x: (x is not None, x)))
                    shares.append(max(found.values(), default=0.0))
                yield pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int64())), pa.array(shares, pa.float64())], ["item_ids", "share"])

    return F.arrow_udf(look, "struct<item_ids:array<long>,share:double>").asNondeterministic()(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, carry: bool = False, rank: int = RANK, cosine: float = COSINE, verbatim: float = VERBATIM, paraphrase: float = PARAPHRASE, answered: float = ANSWERED, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, item_ids (found in it), share (best share of an item's words) and kept (none found);
    with `carry` also the whole row, as struct `row`."""
    given = F.col("answer") if "answer" in benchmark.columns else F.lit(None)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"), given.cast("string").alias("answer"))
    how = {"cosine": cosine, "verbatim": verbatim, "paraphrase": paraphrase, "answered": answered}
    texts, n = docs.select(F.col("text").alias("text")), docs.count()
    row = [F.struct("*").alias("row")] if carry else []
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    blocks = blocks_of(items, max_words)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        none = F.struct(F.array().cast("array<long>").alias("item_ids"), F.lit(0.0).alias("share"))
        found = leaks_in(F.col("text"), build_index(texts, first, n, rank=rank), **how) if first else none
        at = docs.select(doc_id, found.alias("f"), *row).select("doc_id", *["row" for _ in row], "f.*")
    else:  # one block's index is broadcast at a time; what is found is small
        held = written(docs.select(F.monotonically_increasing_id().alias("row_no"), doc_id, F.col("text").alias("text"), *row), "texts")
        tables = []
        for block in itertools.chain([first, second], blocks):
            one = held.select("row_no", leaks_in(F.col("text"), build_index(texts, block, n, rank=rank), **how).alias("f")).select("row_no", "f.*")
            tables.append(written(one.where(F.size("item_ids") > 0), "found"))
        whole = reduce(DataFrame.unionByName, tables).groupBy("row_no").agg(F.array_sort(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), F.max("share").alias("share"))
        at = held.join(whole, "row_no", "left").select("doc_id", *["row" for _ in row], F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("share", F.lit(0.0)).alias("share"))
    return at.withColumn("kept", F.size("item_ids") == 0)
