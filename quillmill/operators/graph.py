"""The typed graph of papers and entities as node and edge DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators.entities import canonical_label, resolved_labels, stored
from quillmill.schema import NODE_COLORS, RELATIONS


def paper_key() -> Column:
    return F.coalesce(F.nullif("paper_id", F.lit("")), F.nullif("title", F.lit("")), F.lit("unknown"))


def mentions(papers: DataFrame, *, by_source: bool = False) -> DataFrame:
    """paper_id, source (node of the paper), type, relation, raw, ord of all names. `by_source` deals the papers by their node
    first, so that edges need no shuffle of mentions."""
    method = F.coalesce(F.nullif(T.collapse_ends(F.coalesce("method_name", F.lit(""))), F.lit("")), T.first_sentence(F.coalesce("methodology", F.lit(""))))
    values = {"method": F.array(method)} | {f: F.coalesce(f, F.array().cast("array<string>")) for f in RELATIONS if f != "method"}
    at = papers.select("paper_pos", paper_key().alias("paper_id"), *[v.alias(f) for f, v in values.items()])
    at = at.withColumn("source", T.node_id(F.lit("Paper"), F.col("paper_id")))
    if by_source:  # in as many parts as the session's shuffles: lists are short beside the mentions that they become
        at = at.repartition(int(papers.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source")
    each = F.array(*[F.struct(F.lit(k).alias("field"), F.lit(t).alias("type"), F.lit(r).alias("relation"), F.col(f).alias("items")) for k, (f, (t, r)) in enumerate(RELATIONS.items())])
    at = at.select("paper_pos", "paper_id", "source", F.inline(each))
    at = at.select("paper_pos", "paper_id", "source", "field", "type", "relation", F.posexplode("items").alias("item", "raw"))
    order = F.struct(F.col("paper_pos").cast("long").alias("paper"), F.col("field").alias("field"), F.col("item").alias("item"))
    return at.select("paper_id", "source", "type", "relation", "raw", order.alias("ord"))


def ord_number(order: Column) -> Column:
    """`ord` as a number of the same order: Spark finds the least of numbers without sorting rows."""
    within = order["field"].cast("long") * 10_000_000_000 + order["item"]
    return order["paper"].cast("decimal(19,0)") * F.lit(100_000_000_000).cast("decimal(12,0)") + within


def ord_of(number: Column) -> Column:
    within = F.pmod(number, F.lit(100_000_000_000).cast("decimal(12,0)")).cast("long")
    paper = F.call_function("div", number - within, F.lit(100_000_000_000).cast("decimal(12,0)"))
    return F.struct(paper.alias("paper"), F.floor(within / 10_000_000_000).cast("int").alias("field"), (within % 10_000_000_000).cast("int").alias("item"))


def names(papers: DataFrame, *, aliases: dict[str, str] | None = None, fuzzy: bool = True) -> DataFrame:
    """A stored row for each distinct spelling: type, raw, n (mentions), first and last (numbers of their order), resolved, target and
    `after`: where it isn't null, only mentions after that number have the name. `resolved` is null for names that are dropped."""
    seen = mentions(papers).where("raw is not null").select("type", "raw", ord_number(F.col("ord")).alias("k"))
    at = seen.groupBy("type", "raw").agg(F.count("*").alias("n"), F.min("k").alias("first"), F.max("k").alias("last"))
    at = at.withColumn("label", canonical_label(F.col("raw"), F.col("type"), aliases))
    at = at.withColumn("after", F.lit(None).cast(dict(at.dtypes)["first"]))
    if fuzzy:
        at = stored(at)
        found, empty = resolved_labels(at.groupBy("type", "label").agg(F.min("first").alias("ord")))
        at = at.drop("after").join(found, ["type", "label"], "left").join(F.broadcast(empty), "type", "left")  # one row a node type
        late = (F.col("label") == "") & (F.col("empty_ord") < F.col("last"))
        at = at.withColumn("resolved", F.when(late, F.col("empty_label")).otherwise(F.col("resolved"))).withColumn("after", F.when(late, F.col("empty_ord")))
        at = at.withColumn("first", F.when(late, F.col("last")).otherwise(F.col("first")))  # later than `after` is all that matters
    else:
        at = at.withColumn("resolved", F.nullif("label", F.lit("")))
    return stored(at.withColumn("target", T.node_id(F.col("type"), F.col("resolved"))).select("type", "raw", "n", "first", "last", "resolved", "target", "after"))


#: Up to so many names are sent to every executor.
MAX_BROADCAST_NAMES = 50_000
#: A name with more mentions than this, and than this share of all, is dealt to several tasks.
HOT_MENTIONS, HOT_SHARE = 10_000, 1e-4


def _with_names(papers: DataFrame, held: DataFrame) -> DataFrame:
    """Mentions with resolved and target of their names. Where names are too many to be sent to every executor, those
    of many mentions are dealt to several tasks."""
    held = held.where("resolved is not null")
    about = held.agg(F.count("*").alias("names"), F.sum("n").alias("mentions")).first()
    few = about["names"] <= MAX_BROADCAST_NAMES
    at = mentions(papers, by_source=few)
    if few:
        at = at.join(F.broadcast(held.drop("n", "first", "last")), ["type", "raw"])
    else:
        most = max(HOT_MENTIONS, int(about["mentions"] * HOT_SHARE))
        parts = F.ceil(F.col("n") / most).cast("int")
        hot = F.broadcast(held.where(F.col("n") > most).select("type", "raw", parts.alias("parts")))  # at most 1 / HOT_SHARE rows
        at = at.join(hot, ["type", "raw"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("source"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
        at = at.join(held.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n", "first", "last"), ["type", "raw", "part"]).drop("part")
    return at.where(F.col("after").isNull() | (ord_number(F.col("ord")) > F.col("after"))).drop("after")


def named_mentions(papers: DataFrame, *, aliases: dict[str, str] | None = None, fuzzy: bool = True) -> DataFrame:
    """Mentions with the names that they resolve to. Nodes and edges both read it, so large ones are best stored. Names are
    normalised and resolved once for each distinct spelling, in jobs that run at once."""
    return _with_names(papers, names(papers, aliases=aliases, fuzzy=fuzzy))


def resolved_counts(papers: DataFrame) -> DataFrame:
    """type, resolved and its number of mentions after the fuzzy merge; null for those that are dropped."""
    held = names(papers)
    late = held.where("after is not null")
    counted = held.where("after is null").select("type", "resolved", "n")
    if not late.isEmpty():
        seen = mentions(papers).join(late.select("type", "raw", F.col("resolved").alias("late"), "after"), ["type", "raw"])
        counted = counted.unionByName(seen.select("type", F.when(ord_number(F.col("ord")) > F.col("after"), F.col("late")).alias("resolved"), F.lit(1).cast("long").alias("n")))
    return counted.groupBy("type", "resolved").agg(F.sum("n").alias("n"))


def build_graph(papers: DataFrame, *, aliases: dict[str, str] | None = None, fuzzy: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). `papers` has PAPER fields and paper_pos, their order, and is read more than once. Names are resolved at once."""
    held = names(papers, aliases=aliases, fuzzy=fuzzy)
    return _nodes(papers, held.where("resolved is not null")), _edges(_with_names(papers, held))


def graph_of(papers: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of papers and their named mentions."""
    held = named.select("target", "type", "resolved", ord_number(F.col("ord")).alias("k")).groupBy("target", "type", "resolved").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    return _nodes(papers, held), _edges(named)


def _nodes(papers: DataFrame, held: DataFrame) -> DataFrame:
    order = F.struct(F.col("paper_pos").cast("long").alias("paper"), F.lit(-1).alias("field"), F.lit(0).alias("item"))
    text = lambda f: F.coalesce(f, F.lit("")).alias(f)
    own = papers.select(paper_key().alias("paper_id"), T.normalize_entity(F.coalesce(F.nullif("title", F.lit("")), paper_key())).alias("label"), text("year"), text("arxiv_id"), text("task"), text("method_name"), order.alias("ord"))
    own = own.withColumn("id", T.node_id(F.lit("Paper"), F.col("paper_id"))).repartition("id")  # papers of one id are few: no sort before the shuffle
    own = own.groupBy("id").agg(F.max_by(F.struct("label", "paper_id", "year", "arxiv_id", "task", "method_name"), "ord").alias("a"), F.min("ord").alias("ord"))
    own = own.select("id", "a.label", F.lit("Paper").alias("type"), "a.paper_id", "a.year", "a.arxiv_id", "a.task", "a.method_name", "ord")
    rest = held.groupBy(F.col("target").alias("id")).agg(F.max_by("resolved", "last").alias("label"), F.max_by("type", "last").alias("type"), F.min("first").alias("first"))
    rest = rest.select("id", "label", "type", *[F.lit("").alias(f) for f in ("paper_id", "year", "arxiv_id", "task", "method_name")], ord_of(F.col("first")).alias("ord"))
    color = F.lit(None).cast("string")
    for kind, value in NODE_COLORS.items():
        color = F.when(F.col("type") == kind, F.lit(value)).otherwise(color)
    return own.unionByName(rest).withColumn("color", color)


def _edges(named: DataFrame) -> DataFrame:
    """A target's relation is that of its field, so the field's number is a key and no row is sorted for it."""
    edges = named.groupBy("source", "target", F.col("ord.field").alias("field")).agg(F.min("ord").alias("ord"))
    relation = F.element_at(F.array(*[F.lit(r) for _, r in RELATIONS.values()]), F.col("field") + 1)
    return edges.select("source", "target", relation.alias("relation"), relation.alias("label"), "ord")


def with_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
