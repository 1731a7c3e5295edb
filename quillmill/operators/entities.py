"""Entity names: aliases and the order-dependent fuzzy merge."""

from __future__ import annotations

import tempfile
import uuid
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.schema import DEFAULT_ALIASES, FUZZY_RATIO

#: Alias lists up to this length become a map literal; longer ones are joined.
MAX_ALIAS_LITERALS = 5_000


def _python_key(value: str) -> str:
    import re

    bare = " ".join(value.split()).strip(" .,:;").casefold()
    return re.sub("[^a-z0-9]+", " ", bare).strip()


def alias_map(aliases: dict[str, str] | None = None, types: dict[str, dict[str, str]] | None = None) -> dict[str, str]:
    """Keys canonicalised; those for one node type start with `type::`. None or nothing: the defaults."""
    out = {_python_key(k): " ".join(v.split()).strip(" .,:;") for k, v in (aliases or {}).items()}
    out |= {f"{t.lower()}::{_python_key(k)}": " ".join(v.split()).strip(" .,:;") for t, m in (types or {}).items() for k, v in m.items()}
    return out or {k: v for k, v in DEFAULT_ALIASES.items() if _python_key(k) == k}


def canonical_label(value: Column, kind: Column | None = None, aliases: dict[str, str] | None = None) -> Column:
    """The alias for the node type, else the general one, else the normalised name."""
    held = aliases or alias_map()
    if len(held) > MAX_ALIAS_LITERALS:
        raise ValueError("alias lists of this length are joined by `canonical_labels`")
    pairs = F.create_map(*[F.lit(x) for pair in sorted(held.items()) for x in pair])
    key = T.canonical_key(value)
    typed = F.try_element_at(pairs, F.concat(F.lower(kind), F.lit("::"), key)) if kind is not None and any("::" in k for k in held) else F.lit(None)
    return F.coalesce(typed, F.try_element_at(pairs, key), T.normalize_entity(value))


def canonical_labels(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """The same by joins, for alias tables (key, target) of any length; `mentions` has type and raw."""
    keyed = mentions.withColumn("key", T.canonical_key(F.col("raw"))).withColumn("typed_key", F.concat(F.lower("type"), F.lit("::"), "key"))
    one = aliases.groupBy("key").agg(F.max("target").alias("target"))
    at = keyed.join(one.select(F.col("key").alias("typed_key"), F.col("target").alias("by_type")), "typed_key", "left").join(one.withColumnRenamed("target", "by_name"), "key", "left")
    return at.withColumn("label", F.coalesce("by_type", "by_name", T.normalize_entity(F.col("raw")))).drop("key", "typed_key", "by_type", "by_name")


def stored(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept as a table in the checkpoint folder, which driver and executors share. Spark knows its size."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(path or f"file://{tempfile.gettempdir()}/quillmill-shared")
    path = f"{spark.sparkContext.getCheckpointDir()}/quillmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def allowed(ratio: float, total: Column) -> Column:
    """Characters that two keys of this ratio and `total` characters may lack of each other, both counted."""
    return F.floor((1 - ratio) * total + 1e-6)


def cut_pairs(keys: DataFrame, ratio: float) -> DataFrame:
    """Pairs (a, b with ord) of keys that may lack one or two characters of each other and that are alike when as many are
    left out: one or two of the longer key, or one of each. A key is met by the keys that it is near to, not by others."""
    n, letter = F.length("key"), F.sequence(F.lit(1), F.length("key"))
    one = lambda key, i: F.concat(F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, F.length(key)))
    two = F.flatten(F.transform(letter, lambda i: F.transform(F.filter(letter, lambda j: j < i), lambda j: one(one(F.col("key"), i), j))))
    ones = F.array_distinct(F.transform(letter, lambda i: one(F.col("key"), i)))
    cut = lambda x: keys.select("type", "key", "ord", F.explode(x).alias("cut"))
    longer = cut(F.when(allowed(ratio, 2 * n - 1).isin(1, 2), ones)).union(cut(F.when(allowed(ratio, 2 * n - 2) == 2, F.array_distinct(two))))
    end = lambda df, name: df.select("type", "cut", F.col("key").alias(name), F.col("ord").alias(f"{name}_ord"))
    uneven = end(longer, "a").join(end(keys.withColumn("cut", F.col("key")), "b"), ["type", "cut"])
    same = cut(F.when(allowed(ratio, 2 * n) == 2, ones))
    even = end(same, "a").join(end(same, "b"), ["type", "cut"]).where("a < b")
    sides = ["type", "a", "a_ord", "b", "b_ord"]
    return uneven.select(*sides).union(even.select(*sides).distinct())


def rare_grams(keys: DataFrame, ratio: float, least: int = 1) -> DataFrame:
    """(type, gram, key, ord, n) of so many of a key's rarest grams that two keys of this ratio or more share one.

    A ratio bounds the characters that one key lacks of the other, and each of them changes at most `width`
    grams; so many grams and one more can't all be missing. Repeated grams of a key are numbered. Keys
    too short to be near any other that lacks `least` characters, both counted, have none."""
    width = 2 if ratio >= 0.9 else 1  # below that, two short keys need not share a pair of characters
    n = F.length("key")
    longest = F.floor(n * ((2 - ratio) / ratio) + 1e-6)
    cut = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.substring("key", i, F.lit(width)))
    at = keys.select("type", "key", "ord", n.alias("n")).where((1 - ratio) * (n + longest) >= least - 1e-6).withColumn("cut", cut)
    each = F.transform(F.array_distinct("cut"), lambda g: F.transform(F.sequence(F.lit(1), F.size(F.filter("cut", lambda x: x == g))), lambda k: F.concat(g, k.cast("string"))))
    grams = at.select("type", "key", "ord", "n", F.explode(F.flatten(each)).alias("gram"))
    known = grams.groupBy("type", "gram").agg(F.count("*").alias("seen")).where("seen > 1")
    ranked = grams.join(known, ["type", "gram"], "left").withColumn("k", F.row_number().over(Window.partitionBy("type", "key").orderBy(F.coalesce("seen", F.lit(1)), "gram")))
    most = F.floor(F.col("n") * (width * (2 - 2 * ratio) / (2 - ratio)) + 1e-6) + 1
    return ranked.where((F.col("k") <= most) & F.col("seen").isNotNull()).select("type", "gram", "key", "ord", "n")


def gram_pairs(keys: DataFrame, ratio: float) -> DataFrame:
    """Pairs (a, b with ord) of keys that may lack three characters or more of each other, that share a rare gram and whose lengths allow it."""
    grams = stored(rare_grams(keys, ratio, least=3))
    side = lambda name: grams.select("type", "gram", F.col("key").alias(name), F.col("ord").alias(f"{name}_ord"), F.col("n").alias(f"{name}_n"))
    lengths = ratio * (F.col("a_n") + F.col("b_n")) <= 2 * F.least("a_n", "b_n") + 1e-6
    pairs = side("a").join(side("b"), ["type", "gram"]).where(lengths & (allowed(ratio, F.col("a_n") + F.col("b_n")) >= 3) & (F.col("a") < F.col("b")))
    return pairs.select("type", "a", "a_ord", "b", "b_ord").distinct()


def near_keys(keys: DataFrame, ratio: float) -> DataFrame:
    """(type, earlier, later, ord, later_ord) of different keys of a type whose ratio is at least `ratio`; `ord` is the earlier one's.
    Keys that may lack up to two characters of each other are found by what is left without them, others by rare grams."""

    @F.pandas_udf("boolean")
    def near(later: pd.Series, earlier: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(later, earlier):
            m = SequenceMatcher(None, x, y)  # the order of arguments matters to the ratio
            out.append((len(x) + len(y) < 40 or m.real_quick_ratio() >= ratio and m.quick_ratio() >= ratio) and m.ratio() >= ratio)
        return pd.Series(out, dtype=bool)

    pairs = cut_pairs(keys, ratio).union(gram_pairs(keys, ratio))
    first = F.struct("a_ord", "a") < F.struct("b_ord", "b")
    ends = [F.when(first, F.col(x)).otherwise(F.col(y)).alias(name) for name, x, y in (("earlier", "a", "b"), ("later", "b", "a"), ("ord", "a_ord", "b_ord"), ("later_ord", "b_ord", "a_ord"))]
    return pairs.select("type", *ends).where(near("later", "earlier"))


#: So many pairs that are left are settled on the driver.
LAST_PAIRS = 100_000


def merged_keys(keys: DataFrame, ratio: float) -> DataFrame:
    """(type, key, into) of the keys that an earlier one stands for: the first of those near it that stands for itself.

    In a round, keys with no earlier one near stand for themselves and those near them are merged; pairs with a
    merged key go. Rounds end when at most LAST_PAIRS pairs are left; those are settled in order at once."""
    pairs = stored(near_keys(keys, ratio))
    left, merged = pairs, []
    while left.count() > LAST_PAIRS:
        waiting = left.select("type", F.col("later").alias("earlier")).distinct()
        merged.append(stored(left.join(waiting, ["type", "earlier"], "left_anti").select("type", F.col("later").alias("key")).distinct()))
        for end in ("earlier", "later"):
            left = left.join(merged[-1].withColumnRenamed("key", end), ["type", end], "left_anti")
        left = stored(left)
    gone = set()
    for kind, later, earlier in sorted((r[0], (r[2], r[1]), r[3]) for r in left.select("type", "later", "later_ord", "earlier").collect()):
        if (kind, earlier) not in gone:
            gone.add((kind, later[1]))
    merged.append(keys.sparkSession.createDataFrame(sorted(gone), "type string, key string"))
    gone = reduce(DataFrame.union, merged)
    if len(merged) > 1:
        gone = stored(gone)
    own = pairs.join(gone.withColumnRenamed("key", "earlier"), ["type", "earlier"], "left_anti").join(gone.withColumnRenamed("key", "later"), ["type", "later"], "left_semi")
    return own.groupBy("type", F.col("later").alias("key")).agg(F.min_by("earlier", F.struct("ord", "earlier")).alias("into"))


def resolved_labels(labels: DataFrame, *, ratio: float = FUZZY_RATIO, fuzzy: bool = True) -> tuple[DataFrame, DataFrame]:
    """(type, label, resolved) of labels that aren't empty, with their first mention `ord`, and (type, empty_label, empty_ord) of the
    first label of each type whose key is empty. Labels of one key resolve alike each time, so only distinct keys are compared."""
    labels = labels.where("label <> ''").withColumn("key", T.canonical_key(F.col("label")))
    keys = labels.groupBy("type", "key").agg(F.min("ord").alias("ord"), F.min_by("label", F.struct("ord", "label")).alias("first"))
    if fuzzy:
        keys = stored(keys)
        into = merged_keys(keys.select("type", "key", "ord"), ratio)
        at = keys.join(into, ["type", "key"], "left").withColumn("into", F.coalesce("into", "key"))
        heads = keys.select("type", F.col("key").alias("into"), F.col("first").alias("resolved"))
        keys = at.join(heads, ["type", "into"]).select("type", "key", "resolved")
    else:
        keys = keys.select("type", "key", F.col("first").alias("resolved"))
    found = labels.select("type", "label", "key").join(keys, ["type", "key"])
    empty = labels.where("key = ''").groupBy("type").agg(F.min_by("label", "ord").alias("empty_label"), F.min("ord").alias("empty_ord"))
    return found.select("type", "label", "resolved"), empty


def resolve(mentions: DataFrame, *, ratio: float = FUZZY_RATIO, fuzzy: bool = True) -> DataFrame:
    """Adds `resolved` and its node `target` to mentions (type, label, ord): the first earlier label of the type whose key is
    close enough, else the label; an empty label takes the first label with an empty key that came before
    it, else it is null. The fuzzy merge runs jobs at once."""
    found, empty = resolved_labels(mentions.where("label <> ''").groupBy("type", "label").agg(F.min("ord").alias("ord")), ratio=ratio, fuzzy=fuzzy)
    found = found.withColumn("near", T.node_id(F.col("type"), F.col("resolved")))
    empty = empty.withColumn("empty_target", T.node_id(F.col("type"), F.col("empty_label")))
    at = mentions.join(found, ["type", "label"], "left").join(F.broadcast(empty), "type", "left")  # one row a node type
    late = F.col("empty_ord") < F.col("ord")
    at = at.withColumn("resolved", F.when(F.col("label") == "", F.when(late, F.col("empty_label"))).otherwise(F.col("resolved")))
    return at.withColumn("target", F.when(F.col("label") == "", F.when(late, F.col("empty_target"))).otherwise(F.col("near"))).drop("empty_label", "empty_ord", "empty_target", "near")
