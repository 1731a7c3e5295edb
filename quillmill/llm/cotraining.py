"""Quality classifier by co-training of a text view and a metadata view.

The text view sees words only: log-odds of a lexicon (distinct words and bare words, as 32-bit hashes)
and how words repeat, in a logistic regression. The metadata view sees the columns lang, source and
n_chars only, nothing that is read from the text: naive Bayes over hashed values and size classes.

Over `rounds` rounds each view labels every unlabelled document of the corpus that it is sure of
(chance of at least SURE) for the other one. The metadata counts are taken again with the text view's
labels; lexicon and regression are fitted again with the metadata view's. Pseudo-labels of a class
weigh at most as much as its own labels. Rounds end early when neither view's labels change. Then both
views are calibrated on one fold of labelled rows and combined by a logistic regression of their
logits; `accuracy`, `text_accuracy` and `meta_accuracy` are of another fold, which nothing is fitted on.

A document is bad if labelled with quality 0 or as toxic. Bounds: `max_labelled` labelled documents fit
the model (those of least hash of the id); every unlabelled one takes part in the exchange and every
document is scored, from its whole text. A word counts from MIN_DOCS labelled documents on; the
LEXICON words of the most certain odds among the 5 * LEXICON most frequent ones are the lexicon.

Every text is cut into words once; the hashes are stored and serve counts, rounds and scores.

Defined cases: a null or empty text has no words and is scored as such; very long texts are taken whole; a
null source, language or length is a value of its own, a missing column is null; without labels, or
with labels of one class, everything is kept with score 1; labels of a document that disagree count as
bad; rows that share a doc_id share its label, and one of them (the least by content) is fitted on;
repeated rows score alike; equal certainties go to the least hash; an empty table gives an empty result; extra
columns are ignored, or carried whole in `row`.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.base import dropped, written

MAX_LABELLED = 20_000
MIN_DOCS, LEXICON = 10, 20_000
ROUNDS, SURE = 3, 0.98
FOLDS, CALIBRATED_ON, TESTED_ON = 5, 3, 4
#: Values that language, source and size are hashed or cut to; one more for null.
LANGS, SOURCES, SIZES = 64, 1024, 64
N_TEXT = 8
SLICE = 500
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
FACTORS = ("lang_no", "source_no", "size_no")


@dataclass
class Model:
    """Lexicon (sorted hashes, log-odds), weights of the views and of their combination; text None keeps everything."""

    lexicon: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int32), np.zeros(0))
    text: np.ndarray | None = None
    meta: list[np.ndarray] = field(default_factory=list)
    bias: float = 0.0
    calibrated: tuple[np.ndarray, np.ndarray] | None = None
    joint: np.ndarray | None = None
    accuracy: float = float("nan")
    text_accuracy: float = float("nan")
    meta_accuracy: float = float("nan")
    exchanged: list[tuple[int, int]] = field(default_factory=list)


class Hashes(dict):
    """Word -> hashes of itself and of its bare word."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= 60_000:
            self.clear()
        bare = word.strip(MARKS)
        h = zlib.crc32(word.encode())
        made = self[word] = (h, zlib.crc32(bare.encode()) if bare and bare != word else h)
        return made


def words_in(text: Column) -> Column:
    """struct<tokens, repeats>: hashes of the distinct words and bare words; shares of distinct words, of words
    like the one before, and of the most frequent one."""

    def cut(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = Hashes()
        for batch in texts:
            for at in range(0, len(batch), SLICE):
                tokens, repeats = [], []
                for t in batch.slice(at, SLICE).to_pylist():
                    words = (t or "").lower().split()
                    seen, n = Counter(words), max(1, len(words))
                    both = np.array([*map(hashes.__getitem__, seen)], np.uint32)
                    tokens.append(np.unique(both).view(np.int32))
                    repeats.append([len(seen) / n, sum(map(eq, words, words[1:])) / n, max(seen.values(), default=0) / n])
                ends = pa.array(np.cumsum([0, *map(len, tokens)]), pa.int32())
                listed = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *tokens])))
                yield pa.StructArray.from_arrays([listed, pa.array(repeats, pa.list_(pa.float64()))], ["tokens", "repeats"])

    return F.arrow_udf(cut, "struct<tokens:array<int>,repeats:array<double>>").asNondeterministic()(text)


def featured(docs: DataFrame, known: DataFrame | None = None, *, carry: bool = False) -> DataFrame:
    """doc_id, tokens, repeats, numbers of the metadata values, bad (1, 0, else null) and fold; with `carry` also
    the whole row, as struct `row`. `known` (doc_id, bad) has at most `max_labelled` rows."""
    column = lambda c: F.col(c) if c in docs.columns else F.lit(None)
    hashed = lambda c, n: F.when(column(c).isNull(), n).otherwise(F.pmod(F.xxhash64(column(c).cast("string")), F.lit(n))).cast("int")
    n_chars = column("n_chars").cast("double")
    size = F.when(n_chars.isNull(), SIZES).otherwise(F.least(F.lit(SIZES - 1), F.floor(2 * F.log2(1 + F.greatest(n_chars, F.lit(0.0)))))).cast("int")
    row = [F.struct("*").alias("row")] if carry else []
    at = docs.select(F.col("doc_id").alias("doc_id"), words_in(F.col("text")).alias("w"), hashed("lang", LANGS).alias("lang_no"), hashed("source", SOURCES).alias("source_no"), size.alias("size_no"), *row)
    at = at.select("doc_id", "w.tokens", "w.repeats", *FACTORS, F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold"), *["row" for _ in row])
    return at.withColumn("bad", F.lit(None).cast("int")) if known is None else at.join(F.broadcast(known), "doc_id", "left")


def text_view(tokens: pa.Array, repeats: pa.Array, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Mean of the log-odds of the known words, the three largest, the share above 1, and `repeats`."""
    if len(tokens) > SLICE:
        return np.concatenate([text_view(tokens.slice(k, SLICE), repeats.slice(k, SLICE), lexicon) for k in range(0, len(tokens), SLICE)])
    hashes, odds = lexicon
    flat = tokens.flatten().to_numpy(zero_copy_only=False)
    lengths = tokens.value_lengths().to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(hashes, flat), max(0, len(hashes) - 1))
    w = np.where(hashes[at] == flat, odds[at], 0.0) if len(hashes) else np.zeros(len(flat))
    owner, n = np.repeat(np.arange(len(lengths)), lengths), np.maximum(1, lengths)
    out = np.zeros((len(lengths), N_TEXT))
    out[:, 0] = np.bincount(owner, w, len(lengths)) / n
    ordered, ends = w[np.lexsort((w, owner))], np.cumsum(lengths)
    for k in (1, 2, 3):
        some = lengths >= k
        out[some, k] = ordered[ends[some] - k]
    out[:, 4] = np.bincount(owner, w > 1.0, len(lengths)) / n
    out[:, 5:] = repeats.flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
    return out


def meta_view(model: Model, *numbers: pa.Array) -> np.ndarray:
    """Log-odds of being bad by the metadata."""
    return model.bias + sum((w[x.to_numpy(zero_copy_only=False)] for w, x in zip(model.meta, numbers)), np.zeros(len(numbers[0])))


def logits(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def newton_sums(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and negative Hessian of the log-likelihood."""
    p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
    return z.T @ (y - p), (z * (p * (1 - p))[:, None]).T @ z


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, more=None) -> np.ndarray:
    """Newton steps on standardised columns; weights for the raw ones, the bias last. `more(mean, scale, w)`
    gives the sums of further rows, which stay with the tasks."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = np.inf
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, keep = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(30):
        gradient, curve = newton_sums(z, y, w)
        if more is not None:
            g, c = more(mean, scale, w)
            gradient, curve = gradient + g, curve + c
        step = np.linalg.solve(curve + np.diag(keep), gradient - keep * w)
        w += step
        if np.abs(step).max() < (1e-6 if more is None else 1e-3):
            break
    return np.r_[w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum()]


def shrunk_odds(bad: np.ndarray, good: np.ndarray, n_bad: float, n_good: float, deviations: float = 2.0) -> np.ndarray:
    """Log-odds, moved to zero by their standard error."""
    ratio = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    return np.sign(ratio) * np.maximum(0, np.abs(ratio) - deviations * np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5)))


def token_counts(rows: DataFrame) -> pd.DataFrame:
    """Documents by label and fold (columns n<label><fold>) of each token of `rows` (tokens, bad, fold)."""
    sums = [F.sum(F.when((F.col("bad") == b) & (F.col("fold") == k), 1).otherwise(0)).alias(f"n{b}{k}") for b in (1, 0) for k in range(FOLDS)]
    counted = rows.select(F.explode("tokens").alias("token"), "bad", "fold").groupBy("token").agg(*sums, F.count("*").alias("n"))
    return counted.where(F.col("n") >= MIN_DOCS).orderBy(F.desc("n"), "token").limit(5 * LEXICON).toPandas()


def lexicon_of(counts: pd.DataFrame, sizes: np.ndarray, folds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The lexicon that these folds give. sizes: documents by label and fold."""
    bad, good = (counts[[f"n{b}{k}" for k in folds]].to_numpy(float).sum(1) for b in (1, 0))
    sure = shrunk_odds(bad, good, sizes[1, folds].sum(), sizes[0, folds].sum())
    tokens = counts["token"].to_numpy(np.int32)
    best = np.lexsort((tokens, -np.abs(sure)))[:LEXICON]
    best = best[sure[best] != 0]
    best = best[np.argsort(tokens[best], kind="stable")]
    return tokens[best], sure[best]


class Trainer:
    """Rounds of co-training over a stored table of `featured`."""

    def __init__(self, features: DataFrame, sure: float):
        self.rows, self.sure = features, sure
        self.context = features.sparkSession.sparkContext
        one = F.min(F.struct("repeats", "tokens", *FACTORS, "bad", "fold")).alias("x")
        labelled = features.where("bad is not null and doc_id is not null").groupBy("doc_id").agg(one).select("x.*")
        self.labelled = written(labelled, "labelled")
        at = self.labelled.toArrow().combine_chunks()
        self.at = {c: at[c].combine_chunks() for c in at.column_names}
        self.y, self.fold = (self.at[c].to_numpy(zero_copy_only=False).astype(int) for c in ("bad", "fold"))
        self.sizes = np.array([[((self.y == b) & (self.fold == k)).sum() for k in range(FOLDS)] for b in (0, 1)], float)
        self.fitted = (self.fold != CALIBRATED_ON) & (self.fold != TESTED_ON)

    def close(self) -> None:
        dropped(self.labelled)

    def fit_text(self, model: Model, given: DataFrame | None = None, n_given: tuple[int, int] = (0, 0)) -> None:
        """Lexicon and text weights; `given` (tokens, repeats, bad, fold) are the other view's labels."""
        used = [k for k in range(FOLDS) if k not in (CALIBRATED_ON, TESTED_ON)]
        weigh = [min(1.0, self.sizes[b, used].sum() / n) if n else 0.0 for b, n in enumerate(n_given)]
        counts, sizes = token_counts(self.labelled.select("tokens", "bad", "fold")).set_index("token"), self.sizes
        if given is not None:
            more = token_counts(given.select("tokens", "bad", "fold")).set_index("token")
            columns = [c for c in counts.columns if c != "n"]
            counts = counts[columns].add(more[columns].mul([weigh[int(c[1])] for c in columns]), fill_value=0)
            sizes = sizes + np.array(weigh)[:, None] * np.array(n_given)[:, None] / FOLDS
        counts = counts.reset_index()
        left_out = [lexicon_of(counts, sizes, [j for j in used if j != k]) for k in range(FOLDS)]
        x = self.text_rows(self.at, self.fold, left_out)
        model.lexicon = lexicon_of(counts, sizes, list(range(FOLDS)))
        more = self.sums_of(given, left_out, weigh) if given is not None else None
        model.text = fit_logistic(x[self.fitted], self.y[self.fitted].astype(float), more=more[0] if more else None)
        if more:
            dropped(more[1])
        self.x = x

    @staticmethod
    def text_rows(at: dict, fold: np.ndarray, left_out: list) -> np.ndarray:
        """The text view, each row by the lexicon that its fold has no part in."""
        x = np.zeros((len(fold), N_TEXT))
        for k in range(FOLDS):
            if (own := np.flatnonzero(fold == k)).size:
                for some in np.array_split(own, -(-len(own) // SLICE)):
                    x[some] = text_view(at["tokens"].take(pa.array(some)), at["repeats"].take(pa.array(some)), left_out[k])
        return x

    def sums_of(self, given: DataFrame, left_out: list, weigh: list[float]):
        """Newton sums of the rows of `given`, which are stored as their text view."""
        shared = self.context.broadcast(left_out)

        def view(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = {c: batch.column(c) for c in ("tokens", "repeats")}
                x = Trainer.text_rows(at, batch.column("fold").to_numpy(zero_copy_only=False), shared.value)
                listed = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_TEXT).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([listed, batch.column("bad")], ["x", "bad"])

        rows = written(given.select("tokens", "repeats", "fold", "bad").mapInArrow(view, "x array<double>, bad int"), "given")

        def more(mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros((N_TEXT + 1, N_TEXT + 2))
                for batch in batches:
                    x = batch.column(0).flatten().to_numpy().reshape(-1, N_TEXT)
                    y = batch.column(1).to_numpy(zero_copy_only=False)
                    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
                    for b in (0, 1):
                        gradient, curve = newton_sums(z[y == b], y[y == b].astype(float), w)
                        total += weigh[b] * np.column_stack([gradient, curve])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["k", "v"])

            total = np.zeros((N_TEXT + 1) * (N_TEXT + 2))
            for r in rows.mapInArrow(add, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
                total[r["k"]] = r["v"]
            total = total.reshape(N_TEXT + 1, N_TEXT + 2)
            return total[:, 0], total[:, 1:]

        return more, rows

    def fit_meta(self, model: Model, given: dict[tuple[int, int, int], int] | None = None) -> None:
        """Naive Bayes of the metadata. given: documents by (factor, value, label of the text view)."""
        given, fit = given or {}, self.fitted
        own = [(self.y[fit] == b).sum() for b in (0, 1)]
        extra = [sum(n for (f, _, label), n in given.items() if f == 0 and label == b) for b in (0, 1)]
        weigh = [min(1.0, own[b] / extra[b]) if extra[b] else 0.0 for b in (0, 1)]
        total = [own[b] + weigh[b] * extra[b] for b in (0, 1)]
        model.meta = []
        for f, (name, size) in enumerate(zip(FACTORS, (LANGS, SOURCES, SIZES))):
            values = self.at[name].to_numpy(zero_copy_only=False)[fit]
            n = [np.bincount(values[self.y[fit] == b], minlength=size + 1).astype(float) for b in (0, 1)]
            for (factor, value, label), k in given.items():
                if factor == f:
                    n[label][value] += weigh[label] * k
            model.meta.append(shrunk_odds(n[1], n[0], total[1], total[0]))
        model.bias = float(np.log((total[1] + 0.5) / (total[0] + 0.5)))

    def labelled_by(self, model: Model) -> DataFrame:
        """Unlabelled documents with the labels that the text view (by_text) and the metadata view (by_meta) are sure of."""
        shared, sure = self.context.broadcast(model), float(np.log(self.sure / (1 - self.sure)))

        def label(tokens: pa.Array, repeats: pa.Array, *numbers: pa.Array) -> pa.Array:
            m = shared.value
            out = []
            for z in (logits(m.text, text_view(tokens, repeats, m.lexicon)), meta_view(m, *numbers)):
                out.append(pa.array(np.where(z >= sure, 1, 0), pa.int32(), mask=np.abs(z) < sure))
            return pa.StructArray.from_arrays(out, ["by_text", "by_meta"])

        made = F.arrow_udf(label, "struct<by_text:int,by_meta:int>", F.ArrowUDFType.SCALAR).asNondeterministic()
        free = self.rows.where("bad is null").select("tokens", "repeats", "fold", *FACTORS)
        return free.withColumn("g", made("tokens", "repeats", *FACTORS)).select("*", "g.*").drop("g")

    def run(self, rounds: int) -> Model:
        model = Model()
        self.fit_text(model)
        self.fit_meta(model)
        last = None
        for _ in range(rounds):
            marked = self.labelled_by(model)
            each = F.explode(F.array(*[F.struct(F.lit(k).alias("factor"), F.col(c).alias("value")) for k, c in enumerate(FACTORS)])).alias("x")
            counted = marked.select(each, "by_text", "by_meta").groupBy("x.factor", "x.value", "by_text", "by_meta").agg(F.count("*").alias("n")).collect()
            by_text, by_meta = Counter(), [0, 0]
            for r in counted:  # at most 9 rows for each of the metadata's values
                if r["by_text"] is not None:
                    by_text[r["factor"], r["value"], r["by_text"]] += r["n"]
                if r["by_meta"] is not None and r["factor"] == 0:
                    by_meta[r["by_meta"]] += r["n"]
            model.exchanged.append((sum(n for k, n in by_text.items() if k[0] == 0), sum(by_meta)))
            if (by_text, by_meta) == last:
                break
            changed = by_meta != (last[1] if last else [0, 0])
            last = (by_text, by_meta)
            if changed:
                given = marked.where("by_meta is not null").select("tokens", "repeats", "fold", F.col("by_meta").alias("bad"))
                self.fit_text(model, given if sum(by_meta) else None, tuple(by_meta))
            self.fit_meta(model, by_text)
        self.combine(model)
        return model

    def combine(self, model: Model) -> None:
        numbers = [self.at[c] for c in FACTORS]
        views = logits(model.text, self.x), meta_view(model, *numbers)
        some = self.fold == CALIBRATED_ON
        if not {0, 1} <= set(self.y[some].tolist()):
            some = np.full(len(self.y), True)
        model.calibrated = tuple(fit_logistic(v[some, None], self.y[some].astype(float), 0.01) for v in views)
        z = np.column_stack([logits(c, v[:, None]) for c, v in zip(model.calibrated, views)])
        model.joint = fit_logistic(z[some], self.y[some].astype(float), 0.1)
        test = self.fold == TESTED_ON
        if test.any():
            right = lambda v: float(((v[test] > 0) == (self.y[test] == 1)).mean())
            model.accuracy, model.text_accuracy, model.meta_accuracy = right(logits(model.joint, z)), right(z[:, 0]), right(z[:, 1])


def known_labels(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, bad) of at most `max_labelled` documents of the table."""
    bad = F.max(F.when((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1), 1).otherwise(0)) if "toxic" in labels.columns else F.max(F.when(F.col("quality") == 0, 1).otherwise(0))
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(bad.alias("bad"))
    ids = docs.select(F.col("doc_id").alias("doc_id"))
    return known.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)


def co_train(features: DataFrame, *, rounds: int = ROUNDS, sure: float = SURE) -> Model:
    """The model of a stored table of `featured`."""
    trainer = Trainer(features, sure)
    model = trainer.run(rounds) if {0, 1} <= set(trainer.y[trainer.fitted].tolist()) else Model()
    trainer.close()
    return model


def scored(features: DataFrame, model: Model) -> DataFrame:
    """doc_id, p_text, p_meta and score (chances of being good, by each view and by both) and kept
    (score >= 0.5), also `row` if it is there."""
    shared = features.sparkSession.sparkContext.broadcast(model)

    def rate(tokens: pa.Array, repeats: pa.Array, *numbers: pa.Array) -> pa.Array:
        m = shared.value
        if m.text is None:
            p = [np.ones(len(tokens))] * 3
        else:
            views = logits(m.text, text_view(tokens, repeats, m.lexicon)), meta_view(m, *numbers)
            z = [logits(c, v[:, None]) for c, v in zip(m.calibrated, views)]
            p = [1 / (1 + np.exp(v)) for v in (*z, logits(m.joint, np.column_stack(z)))]
        return pa.StructArray.from_arrays(list(map(pa.array, p)), ["p_text", "p_meta", "score"])

    made = F.arrow_udf(rate, "struct<p_text:double,p_meta:double,score:double>", F.ArrowUDFType.SCALAR).asNondeterministic()
    at = features.withColumn("p", made("tokens", "repeats", *FACTORS))
    return at.select("doc_id", *[c for c in ("row",) if c in features.columns], "p.*", (F.col("p.score") >= 0.5).alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, carry: bool = False) -> DataFrame:
    """Train on documents and their labels and score all of them; columns as of `scored`."""
    features = written(featured(docs, known_labels(docs, labels, max_labelled), carry=carry), "features")
    return scored(features, co_train(features, rounds=rounds))


def train(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> Model:
    features = written(featured(docs, known_labels(docs, labels, max_labelled)), "features")
    model = co_train(features, rounds=rounds)
    dropped(features)
    return model


def score(docs: DataFrame, model: Model, *, carry: bool = False) -> DataFrame:
    """`scored` for any documents."""
    return scored(featured(docs, carry=carry), model)
