r"""Quality rules as a learned decision list, in DataFrame functions only.

Statistics come from whole texts by built-in functions. Sequential covering on labelled statistics
grows threshold conjunctions by FOIL gain, prunes each on held-out rows and keeps it only if its
precision there suffices; the ordered list becomes one Spark CASE expression.

The fit reads at most `max_labelled` labelled rows (those of least hash), a documented bound; counts
and verdicts cover every row. The labelled statistics of that bounded sample are the only rows that
reach the driver.

Defined cases: a null text has no words, so it fails the base rule (n_words < 20) like an empty one;
without labels, or with labels of one class, there are no rules and `kept` is `not base_failed`;
labels of one document count once, with the lowest quality; repeated rows are judged alike; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.base import words_of

WINDOW = 8
MAX_LABELLED = 20_000
FEATURES = ("symbols_per_word", "shouts_per_word", "repeat_share", "dup_lines_per_word", "mean_word", "distinct_share")


@dataclass(frozen=True)
class Rule:
    """All of `conditions` (feature, "<=" or ">", threshold) reject; precision is on held-out rows."""

    conditions: tuple[tuple[str, str, float], ...]
    precision: float
    covered: int


def text_statistics(docs: DataFrame, *, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """Base counts and features of every text; with `carry` also the whole row, as struct `row`.

    Each select names what the next one refers to often, so that Catalyst keeps it as a column instead
    of repeating it inside lambdas. The one-row generator at the end keeps later filters from being
    pushed below, where they would repeat all of it.
    """
    row = F.struct("*") if carry else F.lit(None)
    at = docs.select(F.struct(F.col(key).alias("doc_id"), row.alias("row")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    at = at.select("id", "text", words_of(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    at = at.select(
        "id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.replace(F.col("text"), F.lit("!")))).cast("long").alias("n_shouts"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    at = at.withColumn("n_distinct", F.size(F.array_distinct("hashes")))
    def doubled(name: str, step: int) -> Column:  # hashes of runs twice as long; those past the end are cut off below
        return F.zip_with(name, F.slice(name, step + 1, F.size("hashes")), lambda a, b: F.xxhash64(a, b))

    for name, of, step in (("pairs", "hashes", 1), ("fours", "pairs", 2), ("windows", "fours", 4)):
        at = at.withColumn(name, doubled(of, step))
    at = at.withColumn("windows", F.when(F.col("n_words") > WINDOW, F.slice("windows", F.lit(1), F.size("windows") - (WINDOW - 1)))).drop("hashes", "pairs", "fours")
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    at = at.withColumn("placed", F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))))).drop("windows")
    twice = F.filter("placed", lambda x, k: F.coalesce(x["h"] == F.get("placed", k + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("placed", k - 1)["h"], F.lit(False)))
    at = at.withColumn("twice", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("placed")
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate("twice", none, lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"])
    at = at.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("twice")
    n = F.col("n_words").cast("double")
    features = {
        "symbols_per_word": F.col("n_symbols") / n,
        "shouts_per_word": F.col("n_shouts") / n,
        "repeat_share": F.col("n_repeat_words") / n,
        "dup_lines_per_word": F.col("n_dup_lines") / n,
        "mean_word": F.col("word_chars") / n,
        "distinct_share": F.col("n_distinct") / n,
    }
    stats = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[F.when(n > 0, v).alias(k) for k, v in features.items()])
    return at.select("id.*", F.inline(F.array(stats))).drop(*[] if carry else ["row"])


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def labelled_sample(labels: DataFrame, max_labelled: int) -> DataFrame:
    """doc_id and quality of at most `max_labelled` labelled documents, the same ones each time."""
    seen = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("doc_id"), F.col("quality").alias("quality"))
    return seen.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)


def learn_rules(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, min_precision: float = 0.95, max_rules: int = 12) -> list[Rule]:
    """Decision list that rejects documents labelled with quality 0, from those that pass the base rule."""
    sample = F.broadcast(labelled_sample(labels, max_labelled))  # at most max_labelled rows of two numbers
    picked = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).join(sample, "doc_id")
    stats = text_statistics(picked).where(~base_failed())
    rows = stats.join(sample, "doc_id").select("doc_id", "quality", *FEATURES).collect()
    if not rows:
        return []
    x = np.array([[r[f] for f in FEATURES] for r in sorted(rows, key=lambda r: r["doc_id"])], dtype=float)
    y = np.array([r["quality"] == 0 for r in sorted(rows, key=lambda r: r["doc_id"])])
    return cover(x, y, min_precision=min_precision, max_rules=max_rules)


def cover(x: np.ndarray, y: np.ndarray, *, min_precision: float = 0.95, max_rules: int = 12, max_conditions: int = 4, seed: int = 5) -> list[Rule]:
    """Sequential covering: rules for the rows with y, in order of discovery."""
    rules: list[Rule] = []
    held = np.random.default_rng(seed).random(len(y)) < 1 / 3
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 201))) for f in range(x.shape[1])] if len(y) else []
    cuts = [(c[1:] + c[:-1]) / 2 for c in cuts]
    left = np.ones(len(y), bool)
    while len(rules) < max_rules and (y & left & ~held).any():
        grow, prune = left & ~held, left & held
        conditions = _grown(x, y, grow, cuts, max_conditions)
        conditions = _pruned(x, y, prune, conditions)
        if not conditions:
            break
        hit = _fits(x, conditions)
        right, n = int((hit & prune & y).sum()), int((hit & prune).sum())
        if n < 3 or right / n < min_precision:
            break
        rules.append(Rule(tuple((FEATURES[f], "<=" if d < 0 else ">", float(t)) for f, d, t in conditions), right / n, n))
        left &= ~hit
    return rules


def _fits(x: np.ndarray, conditions: list[tuple[int, int, float]]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, d, t in conditions:
        hit &= x[:, f] <= t if d < 0 else x[:, f] > t
    return hit


def _grown(x, y, rows, cuts, max_conditions):
    """Conditions added by FOIL gain until no wrong row is covered."""
    conditions: list[tuple[int, int, float]] = []
    at = rows.copy()
    while len(conditions) < max_conditions:
        p, n = int((at & y).sum()), int((at & ~y).sum())
        if not p or not n:
            break
        best = None
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            low = np.searchsorted(c, x[at, f])  # index of the first cut that the value doesn't exceed
            yes, no = (np.bincount(low[y[at] == k], minlength=len(c) + 1)[: len(c)].cumsum() for k in (True, False))
            for d, ps, ns in ((-1, yes, no), (1, p - yes, n - no)):
                gain = np.where(ps > 0, ps * (np.log2(np.maximum(ps, 1) / np.maximum(ps + ns, 1)) - np.log2(p / (p + n))), -1.0)
                k = int(gain.argmax())
                if best is None or gain[k] > best[0]:
                    best = (float(gain[k]), f, d, float(c[k]))
        if best is None or best[0] <= 1e-9:
            break
        conditions.append(best[1:])
        at &= _fits(x, conditions[-1:])
    return conditions


def _pruned(x, y, rows, conditions):
    """The first conditions that do best on held-out rows."""

    def worth(k: int) -> tuple[float, int]:
        hit = _fits(x, conditions[:k]) & rows
        p, n = int((hit & y).sum()), int((hit & ~y).sum())
        return ((p - n) / (p + n) if p + n else -1.0, -k)

    return conditions[: max(range(1, len(conditions) + 1), key=worth)] if conditions else []


def rejects(rules: list[Rule]) -> Column:
    """The decision list as one ordered CASE expression."""
    out = None
    for rule in rules:
        fits = F.lit(True)
        for feature, side, cut in rule.conditions:
            fits = fits & (F.col(feature) <= F.lit(cut) if side == "<=" else F.col(feature) > F.lit(cut))
        out = F.when(fits, F.lit(True)) if out is None else out.when(fits, F.lit(True))
    return F.lit(False) if out is None else out.otherwise(F.lit(False))


def judge_quality(docs: DataFrame, rules: list[Rule], *, carry: bool = False) -> DataFrame:
    """Base counts, features, base_failed and kept of every document; with `carry` also the whole row, as struct `row`."""
    return text_statistics(docs, carry=carry).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(rejects(rules), F.lit(False)))
