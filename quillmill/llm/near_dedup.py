"""MinHash near-dedup with verified links and components by alternating large-star and small-star.

1. A document's set holds 64-bit hashes of its distinct word shingles; words are runs other than
   ASCII white space, A-Z lower-cased. Documents of equal sets are a class at once (hash aggregate),
   which the row of its smallest doc_id stands for.
2. Classes get a signature, the minima of many universal hashes. It is cut into bands; classes with
   an equal band share a bucket.
3. Each class of a bucket is a pair with the bucket's hub, its smallest class, so there are no more
   pairs than memberships. Pairs are verified on signatures (`least_share`: a pair at the threshold
   fails with a chance below 1e-5), then confirmed on full sets. Components of these links follow.
4. Buckets whose classes are still in different components are open. Of open buckets with the same
   classes one is left. A bucket is cut into blocks by size of set (sizes that can't meet the
   threshold never meet) and hash; two blocks are a task, in which pairs of classes from different
   components are verified on signatures and confirmed on full sets. A task returns at most a spanning
   forest of links. A pair in several buckets is compared in the one of the first band it shares.
5. Components of all links end at the smallest document.

A pair at the threshold shares no band with a chance below 1e-5 (`bands_for`), and higher
similarities far more rarely; nothing else is lost. Keys with many rows (hubs of star rounds, buckets, exact
copies) are dealt to several tasks. Work in an open bucket grows with the square of its classes that are alike but
under the threshold; rows shipped for it grow with that square over `block`.

Defined cases: a text without words, or null, has the empty set and is linked with nothing; with
fewer words than a shingle has, the whole sequence is the only one; equal texts and repeated rows
fall in one class; rows that share a doc_id but not their words are in the classes of their words (which
are one node where the id stands for both); a null doc_id is linked with nothing; very long texts are taken whole, one at a time; extra columns are ignored, or
carried whole in `row`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.base import dropped, hot_rows, made_so_far, parts_of, remove_since, spread_join, written

#: Classes a block of an open bucket; bytes of sets in a group of small open buckets.
BLOCK, GROUP_BYTES = 256, 1_000_000
BROADCAST_IDS = 2_000_000
COLUMNS = 8_192
SLICE = 200
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def bands_for(threshold: float, miss: float = 1e-5) -> tuple[int, int]:
    """Rows a band and bands, so that a pair at the threshold shares no band with a chance below `miss`."""
    rows = 5 if threshold >= 0.8 else 4 if threshold >= 0.7 else 3
    return rows, int(np.ceil(np.log(miss) / np.log(1 - threshold**rows)))


def least_share(threshold: float, minima: int) -> float:
    """Share of equal minima that a pair at the threshold falls below with a chance under 1e-5 (4.3 deviations)."""
    return threshold - 4.3 * float(np.sqrt(threshold * (1 - threshold) / minima))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(words: list[bytes], hashes: dict, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = max(0, len(h) - width + 1) or min(1, len(h))
    s = np.full(k, len(h) if len(h) < width else 0, np.uint64)  # a short sequence is unlike any part of a longer one
    for j in range(min(width, len(h))):
        s += (h[j : j + k] ^ (h[j : j + k] >> np.uint64(31))) * MIX[j % len(MIX)]
        if j >= len(MIX):
            s *= MIX[0]
    s ^= s >> np.uint64(29)
    return np.unique(s * MIX[-1])


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper halves of the minima of the universal hashes a x + b."""
    low = np.full(len(a), 2**64 - 1, np.uint64)
    for k in range(0, len(s), 512):
        np.minimum(low, (s[k : k + 512, None] * a + b).min(0), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def sets_of(text: Column, *, width: int, minima: int, seed: int = 17) -> Column:
    """struct<n, hi, lo, set, sig>: size, 128-bit hash and hashes of a text's set, and its signature."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, minima, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, minima, dtype=np.uint64)
    names = ["n", "hi", "lo", "set", "sig"]

    def make(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        hashes = WordHashes()
        for batch in texts:
            for at in range(0, len(batch), SLICE):
                n, hi, lo, sets, sigs = [], [], [], [], []
                for words in batch.slice(at, SLICE).cast(pa.binary()).to_pylist():
                    s = shingle_set((words or b"").lower().split(), hashes, width)
                    both = xxhash.xxh3_128_intdigest(s.tobytes())
                    n.append(len(s))
                    hi.append((both >> 64) - 2**63)
                    lo.append((both & (2**64 - 1)) - 2**63)
                    sets.append(s.view(np.int64))
                    sigs.append(signature(s, a, b).tobytes())
                ends = pa.array(np.cumsum([0, *n]), pa.int32())
                listed = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
                columns = [pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), listed, pa.array(sigs, pa.binary())]
                yield pa.StructArray.from_arrays(columns, names)

    made = F.arrow_udf(make, "struct<n:long,hi:long,lo:long,set:array<long>,sig:binary>")
    return made.asNondeterministic()(text)  # so that no filter makes Spark compute it twice


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """Stored (node, root) of every node of `edges` (a, b): the smallest node that it is connected with.

    Large-star links each greater neighbour of a node to the node's least neighbour, small-star each
    smaller one; alternating them leaves stars. Every round is stored in the shared folder. Nodes with
    many neighbours are dealt to several tasks.
    """
    at = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(at)
    for _ in range(max_rounds):
        most = hot_rows(mark[0])
        both = at.select("u", "v").union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        hub = low.select("u", F.least("u", "m").alias("m"))
        large = spread_join(both, hub, "u", parts_of(low, "u", "n", most), F.col("v")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, low.select("u", "m"), "u", parts_of(low, "u", "n", most), F.col("v"))
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        new = written(small.select(F.explode(pairs).alias("e")).select("e.*").where("u <> v").distinct(), "edges", 2 * mark[0])
        now = _mark(new)
        dropped(at)
        at = new
        if now == mark:
            stars = at.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out = written(stars.union(at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots", 2 * mark[0])
            dropped(at)
            return out
        mark = now
    raise RuntimeError(f"no fixed point of the stars after {max_rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Boolean matrix: 100 * intersection >= percent * union, on full sets, by matrix products over
    the hashes that occur more than once."""
    sizes = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    values, index = np.unique(np.concatenate(left + right), return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), np.concatenate(sizes))
    shared = np.bincount(index, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    index, owner = column[index[shared[index]]], owner[shared[index]]
    order = np.argsort(index, kind="stable")
    index, owner = index[order], owner[order]
    both = np.zeros((len(left), len(right)), np.float64)
    for at in range(0, int(shared.sum()), COLUMNS):
        k, e = np.searchsorted(index, (at, at + COLUMNS))
        dense = np.zeros((len(left) + len(right), min(COLUMNS, int(shared.sum()) - at)), np.float32)
        dense[owner[k:e], index[k:e] - at] = 1
        both += dense[: len(left)] @ dense[len(left) :].T
    both = np.rint(both)
    return 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)


def links_between(left: pd.DataFrame, right: pd.DataFrame, band: int, rows: int, least: float, percent: int) -> list[tuple[int, int]]:
    """Links (rep, rep) between two blocks of a bucket of `band`: a spanning forest of the components that
    they connect. Columns: rep, comp, sig, set."""
    sig = [np.frombuffer(b"".join(x["sig"]), "<u4").reshape(len(x), -1) for x in (left, right)]
    comp = left["comp"].to_numpy(), right["comp"].to_numpy()
    n = left["set"].map(len).to_numpy(), right["set"].map(len).to_numpy()
    hit = np.zeros((len(left), len(right)), bool)
    for i in range(len(left)):
        alike = (comp[1] != comp[0][i]) & (100 * np.minimum(n[0][i], n[1]) >= percent * np.maximum(n[0][i], n[1]))
        if not (at := np.flatnonzero(alike)).size:
            continue
        equal = sig[1][at] == sig[0][i]
        shared = equal.reshape(len(at), -1, rows).all(2)
        hit[i, at] = (equal.mean(1) >= least) & shared.any(1) & (shared.argmax(1) == band)
    some = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    if not some[0].size:
        return []
    sets = [[s.view(np.uint64) if s.dtype == np.int64 else s for s in x["set"].to_numpy()[k]] for x, k in zip((left, right), some)]
    hit = hit[np.ix_(*some)] & linked(*sets, percent)
    reps = left["rep"].to_numpy()[some[0]], right["rep"].to_numpy()[some[1]]
    comp = comp[0][some[0]], comp[1][some[1]]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(hit)):
        x, y = find(int(comp[0][i])), find(int(comp[1][j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(reps[0][i]), int(reps[1][j])))
    return out


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, block: int = BLOCK, broadcast_ids: int = BROADCAST_IDS, carry: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) of every document. With `carry` only
    kept rows come, as struct `row`: one of those that repeat a doc_id with the same set, all without a set or id."""
    rows, bands = bands_for(percent / 100)
    before = made_so_far()
    row = [F.struct("*").alias("row")] if carry else []
    at = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").cast("long").alias("doc_id"), sets_of(F.col("text"), width=width, minima=rows * bands).alias("s"), *row)
    sets = written(at.select("row_no", "doc_id", "s.*", *["row" for _ in row]), "sets")
    known = sets.where("n > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "row_no"))
    classes = known.groupBy("hi", "lo").agg(first.alias("f"), F.count("*").alias("copies"))
    classes = written(classes.select("hi", "lo", "copies", F.col("f.doc_id").alias("rep"), F.col("f.row_no").alias("cid")), "classes")
    members, held = _candidates(known, classes, rows, bands, broadcast_ids)
    links = written(_star_links(members, held, percent, rows * bands), "links")
    roots = components(links)
    more = written(_open_links(members, held, roots, rows, least_share(percent / 100, rows * bands), percent, block), "links")
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    remove_since(docs.sparkSession, before, sets, classes, roots)
    ends = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    if carry:
        kept = ends.where("root = rep").select(F.col("cid").alias("row_no"))
        alone = sets.where("n = 0 or doc_id is null")
        names = ("doc_id", F.col("n").alias("n_shingles"), "row")
        return sets.select("row_no", *names).join(kept, "row_no", "left_semi").select("doc_id", "n_shingles", "row").unionByName(alone.select(*names)).withColumn("component_id", F.col("doc_id")).withColumn("kept", F.lit(True))
    key = F.struct("hi", "lo")
    n = classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = parts_of(classes.select(key.alias("key"), "copies"), "key", "copies", hot_rows(n))
    out = spread_join(sets.select("row_no", "doc_id", F.col("n").alias("n_shingles"), key.alias("key")), ends.select(key.alias("key"), "root"), "key", hot, F.col("row_no"), "left")
    linked_up = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = written(out.select("doc_id", "n_shingles", F.when(linked_up, F.col("root")).otherwise(F.col("doc_id")).alias("component_id")), "components")
    dropped(sets, classes, roots)
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def _candidates(known: DataFrame, classes: DataFrame, rows: int, bands: int, broadcast_ids: int) -> tuple[DataFrame, DataFrame]:
    """Stored (key, band, cid, low, size) of the buckets with more than one class, `low` being the hub, and
    stored (cid, rep, n, sig, set) of the classes in them."""
    heads = known.select(F.col("row_no").alias("cid"), "sig").join(classes.select("cid"), "cid", "left_semi")
    cut = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.struct(k.alias("band"), F.xxhash64(F.substring("sig", k * (4 * rows) + 1, F.lit(4 * rows)), k).alias("key")))
    buckets = written(heads.select("cid", F.inline(cut)), "buckets")
    shared = buckets.groupBy("key").agg(F.min("cid").alias("low"), F.max("cid").alias("high"), F.count("*").alias("size")).where("low < high").drop("high")
    shared = written(shared, "shared")
    n = shared.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    members = written(spread_join(buckets, shared, "key", parts_of(shared, "key", "size", hot_rows(n)), F.col("cid")), "members")
    dropped(buckets, shared)
    ids = members.select("cid").distinct()
    ids = F.broadcast(ids) if ids.count() <= broadcast_ids else ids
    held = known.select(F.col("row_no").alias("cid"), F.col("doc_id").alias("rep"), "n", "sig", "set").join(ids, "cid", "left_semi")
    return members, written(held, "held")


def _star_links(members: DataFrame, held: DataFrame, percent: int, minima: int) -> DataFrame:
    """(a, b): confirmed links of classes with the hubs of their buckets."""
    pairs = written(members.where("cid <> low").select(F.col("low").alias("a"), F.col("cid").alias("b")).distinct(), "pairs")
    counted = pairs.groupBy("a").agg(F.count("*").alias("n"))
    hot = parts_of(counted, "a", "n", hot_rows(pairs.count()))
    side = lambda end, *columns: held.select(F.col("cid").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
    at = spread_join(pairs.join(side("b", "rep", "n", "sig"), "b"), side("a", "rep", "n", "sig"), "a", hot, F.col("b"))
    words = lambda end: F.transform(F.sequence(F.lit(0), F.lit(minima - 1)), lambda k: F.substring(f"sig_{end}", 4 * k + 1, F.lit(4)))
    equal = F.size(F.filter(F.zip_with(words("a"), words("b"), lambda x, y: x == y), lambda x: x))
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    alike = at.where((F.col("rep_a") != F.col("rep_b")) & sizes & (equal >= least_share(percent / 100, minima) * minima)).drop("sig_a", "sig_b")
    whole = spread_join(alike.join(side("b", "set"), "b"), side("a", "set"), "a", hot, F.col("b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return whole.where(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def _open_links(members: DataFrame, held: DataFrame, roots: DataFrame, rows: int, least: float, percent: int, block: int) -> DataFrame:
    """(a, b): links that connect different components within buckets, as in steps 4 and 5."""
    named = held.select("cid", "rep", "n").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("cid", "n", F.coalesce("root", "rep").alias("comp"))
    placed = members.select("key", "band", "cid").join(named, "cid")
    same = [F.bit_xor(F.xxhash64("cid", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
    seen = placed.groupBy("key").agg(F.min("band").alias("band"), F.count("*").alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.sum("n").alias("hashes"), *same).where("c0 < c1")
    units = written(seen.groupBy("x0", "x1", "size").agg(F.min(F.struct("band", "key", "hashes")).alias("u")).select("u.*", "size"), "units")
    total, small = units.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("size") <= block, F.col("hashes"))), F.lit(0))).first()
    groups = max(1, -(-small * 8 // GROUP_BYTES))
    step = float(np.log(100 / percent))  # sets whose sizes differ by more than one step can't be linked
    inside = spread_join(placed.drop("band"), units.drop("hashes"), "key", parts_of(units, "key", "size", hot_rows(total)), F.col("cid"))
    inside = written(inside.withColumn("level", F.floor(F.log("n") / step).cast("int")), "inside")
    none = F.lit(None).cast("struct<level:int,part:int>")
    whole = inside.where(F.col("size") <= block).select("key", "band", "cid", "comp", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("long").alias("task"), none.alias("low"), none.alias("high"), F.lit(0).alias("side"))
    large = inside.where(F.col("size") > block)
    parts = large.groupBy("key", "level").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    cut = large.join(F.broadcast(parts) if total // block < BROADCAST_IDS else parts, ["key", "level"]).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).drop("parts")
    near = parts.select("key", F.explode(F.array(*[(F.col("level") + k).alias("x") for k in (-1, 0, 1)])).alias("level"), F.col("level").alias("other"), "parts")
    own, other = F.struct("level", "part"), F.struct(F.col("other").alias("level"), F.col("p").alias("part"))
    paired = cut.join(F.broadcast(near) if total // block < BROADCAST_IDS else near, ["key", "level"]).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    paired = paired.select("key", "band", "cid", "comp", F.least(own, other).alias("low"), F.greatest(own, other).alias("high"), F.when(own == other, 0).when(own < other, 1).otherwise(2).alias("side"))
    paired = paired.withColumn("task", F.xxhash64("key", "low", "high"))
    tasks = whole.unionByName(paired.select(*whole.columns)).join(held.select("cid", "rep", "sig", "set"), "cid")

    def confirm(group: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, one in group.groupby(["key", "low_level", "low_part", "high_level", "high_part"], sort=True, dropna=False):
            sides = [x for _, x in one.groupby("side", sort=True)]
            if one["side"].iloc[0] and len(sides) < 2:
                continue
            found += links_between(sides[0], sides[-1], int(one["band"].iloc[0]), rows, least, percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    flat = tasks.select("task", "key", "band", "cid", "comp", "side", "rep", "sig", "set", *[F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("low", "high") for c in ("level", "part")])
    return flat.groupBy("task").applyInPandas(confirm, "a long, b long")
