"""URL verdicts from allow and block rules: a broadcast trie with longest-match precedence.

The trie's edges are reversed host labels, then path segments. A rule fits its host and every
subdomain if the URL's path starts with the rule's path. Of several that fit, the one with the most
host labels wins, then the one with the longest path; of equal rules, block wins over allow.

Defined cases: a null URL or one without `://` has an empty host and path and fits no rule; a URL
that no rule fits gets `default`; an empty rule list is allowed; an empty table gives an empty
result; repeated rows are judged alike; extra input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (action, host, path)
Rule = tuple[str, str, str]
#: Rules up to this number are broadcast as a trie; more are joined by host.
MAX_BROADCAST_RULES = 500_000
END = ""


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Nested dicts: host labels from the right, then END, then whole path segments.

    At a path node, `tails` holds the rules that end inside the next segment, longest first; a rule
    whose path ends with a slash has the empty tail.
    """

    def __init__(self, rules: Sequence[Rule]):
        self.root: dict = {}
        for action, host, path in sorted(rules, key=lambda r: r[0] == "block"):
            node, labels = self.root, host.lower().split(".")
            if not all(labels):
                raise ValueError(f"a rule's host has an empty label: {host!r}")
            for label in reversed(labels):
                node = node.setdefault(label, {})
            node = node.setdefault(END, {"next": {}, "tails": {}})
            *whole, tail = path.split("/")
            for segment in whole:
                node = node["next"].setdefault(segment, {"next": {}, "tails": {}})
            node["tails"][tail] = (host.lower() + path, action)

    def judge(self, host: str, path: str) -> tuple[str, str] | None:
        node, ends = self.root, []
        for label in reversed(host.split(".")):
            node = node.get(label) if label else None
            if node is None:
                break
            if END in node:
                ends.append(node[END])
        segments = path.split("/")
        for start in reversed(ends):
            found, at = None, start
            for k, segment in enumerate(segments):
                fits = [tail for tail in at["tails"] if segment.startswith(tail)]
                if fits:
                    found = at["tails"][max(fits, key=len)]
                at = at["next"].get(segment) if k + 1 < len(segments) else None
                if at is None:
                    break
            if found:
                return found
        return None


def judge_urls(pages: DataFrame, rules: Sequence[Rule], *, key: str = "page_id", url: str = "url", default: str = "allow", max_broadcast_rules: int = MAX_BROADCAST_RULES) -> DataFrame:
    """`key`, host, path, rule (host and path of the rule, else null), verdict for every row."""
    parts = pages.select(F.col(key).alias(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if len(rules) > max_broadcast_rules:
        return _judge_joined(parts, rules, key, default)
    trie = parts.sparkSession.sparkContext.broadcast(Trie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = trie.value
        for batch in batches:
            found = [tree.judge(h, p) or (None, default) for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist())]
            more = [pa.array([f[k] for f in found], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [key, "host", "path", "rule", "verdict"])

    return parts.mapInArrow(judge, f"{key} {parts.schema[key].dataType.simpleString()}, host string, path string, rule string, verdict string")


def _judge_joined(parts: DataFrame, rules: Sequence[Rule], key: str, default: str) -> DataFrame:
    """For rule lists too long to broadcast: distinct URLs meet the rules by each suffix of their host."""
    spark = parts.sparkSession
    listed = spark.createDataFrame([(a, h.lower(), p) for a, h, p in rules], "action string, rule_host string, rule_path string")
    urls = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hits = urls.withColumn("rule_host", F.explode(suffix)).join(listed, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rank = F.struct(F.size(F.split("rule_host", r"\.")), F.length("rule_path"), F.col("action"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "action"), rank).alias("best"))
    return parts.join(best, ["host", "path"], "left").select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
