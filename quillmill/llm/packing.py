"""Packing of token sequences by a configuration linear program over the length histogram.

Pieces of `capacity` tokens are whole sequences. For the shorter ones the program "fewest sequences
such that each length is covered" has a variable for each configuration (multiset of lengths that
fits). Rounds of a knapsack dynamic program over the lengths still open find configurations worth
most, until every length is covered. If that takes over 0.1% (GAP) more than a proven lower bound,
lengths in configurations with slack are priced higher and it is done again, three times in all;
then the best answer stands, whole but maybe with a larger gap. The fractional answer is rounded
down; what is left is packed best fit by length, also into the slack of configurations.
All of this works on the histogram (at most `capacity` lengths), whatever the number of documents.

Pieces are then numbered within their length and look up their place in a broadcast table of slots
(length, first number, sequence, offset), whose size is bounded by the histogram's, not by the data.

Defined cases: a null text is empty and has the end id alone; repeated rows are packed as often as
they come; a document longer than `capacity` is cut into pieces of that size, the last one shorter;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.base import written
from quillmill.llm.tokens import UnitCache, load_tokenizer

WORD = re.compile(r"[\S\x1c-\x1f]+")
#: Plain characters are printable ASCII without apostrophes (contractions) and < (special strings) and the letters of
#: Latin-1; PIECE cuts text of them in lower case.
PLAIN = re.compile(r"[!-&(-;=-~À-ÖØ-öø-ÿ]+")
#: Finds what is neither plain nor ASCII white space.
ODD = re.compile(r"[^\t-\r !-&(-;=-~À-ÖØ-öø-ÿ]")
PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\s]+")
CAPACITY = 4096
#: Pieces and words that a generation of each of a worker's two caches holds (there are two generations).
WORDS_KEPT = 150_000
SLICE = 500
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of one length are numbered in groups of about so many.
GROUP_ROWS = 50_000
#: The program's answer may exceed its lower bound by this share.
GAP = 0.001


def plain_marks(tokenizer) -> dict[int, str] | None:
    """What the tokenizer's model sees in place of each plain character in lower case, or None where the tokenizer
    does not cut plain text as PIECE does, tried on all pairs of plain characters."""

    def cut(text: str) -> list[str]:
        text = tokenizer.normalizer.normalize_str(text) if tokenizer.normalizer else text
        return [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)] if tokenizer.pre_tokenizer else [text]

    plain = [chr(c) for c in range(33, 256) if PLAIN.match(chr(c))]
    marks = {ord(c): "".join(cut(c)) for c in plain if c == c.lower()}
    tried = "".join(a + b for a in plain for b in plain)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    same = cut(tried) == [p.translate(marks) for p in PIECE.findall(tried.lower())]
    return marks if same and all(map(ODD.search, special)) else None


@lru_cache(maxsize=1)
def text_encoder(tokenizer_path: str, words_kept: int = WORDS_KEPT) -> Callable[[str], bytes]:
    """Text -> its ids as bytes; the Python worker keeps it, with its caches, from task to task.

    Plain text is cut here and only the model is asked, once for each piece; a text with other characters is cut
    into words, and the words that have them go through the library whole."""
    tokenizer = load_tokenizer(tokenizer_path)
    model, marks = tokenizer.model, plain_marks(tokenizer)

    def stored(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    piece = UnitCache(lambda p: stored([t.id for t in model.tokenize(p.translate(marks))]), size=words_kept)

    def encode_plain(text: str) -> bytes:
        return b"".join(map(piece.__getitem__, PIECE.findall(text.lower())))

    def encode_word(word: str) -> bytes:
        if marks and PLAIN.fullmatch(word):
            return encode_plain(word)
        return stored(tokenizer.encode(word, add_special_tokens=False).ids)

    words = UnitCache(encode_word, size=words_kept)

    def encode(text: str) -> bytes:
        if marks and not ODD.search(text):
            return encode_plain(text)
        return b"".join(map(words.__getitem__, WORD.findall(text)))

    return encode


def pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int = 1, words_kept: int = WORDS_KEPT) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every document's pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(tokenizer_path, words_kept)
        end, step = int(end_id).to_bytes(4, "little"), 4 * capacity
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            out: list[list] = [[], [], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole = encode(text) + end
                for k, at in enumerate(range(0, len(whole), step)):
                    part = whole[at : at + step]
                    for column, value in zip(out, (key, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, PIECES)


def best_values(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: for each room the most that lengths (ascending) in it are worth, and a length of that choice."""
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    worth_of = np.full(capacity + 1, -np.inf)
    worth_of[lengths] = worth
    for c in range(int(lengths[0]), capacity + 1):
        values = worth_of[1 : c + 1] + best[c - 1 :: -1]
        j = int(values.argmax())
        best[c], pick[c] = values[j], j + 1
    return best, pick


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> float:
    """Most that dual prices 1 (over capacity - k), length / capacity or 0 (under k) prove, over all k: no program needs less."""
    prices = (np.where(lengths > capacity - k, 1.0, np.where(lengths >= k, lengths / capacity, 0.0)) for k in range(capacity // 2 + 1))
    return max((float(p @ counts) for p in prices), default=0.0)


def cover_all(lengths: np.ndarray, counts: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[dict[tuple, float], float]:
    """Configuration -> copies, such that each length is covered exactly, and the bound that these prices prove.

    A pricing round takes, for each open length from the longest, the configuration worth most that has it,
    as often as the lengths in it last; each use closes a length, so there are at most as many rounds."""
    left, uses, bound = counts.astype(float), defaultdict(float), 0.0
    at = np.zeros(capacity + 1, dtype=np.int64)
    at[lengths] = np.arange(len(lengths))
    while len(still := np.flatnonzero(left > 0)):
        best, pick = best_values(lengths[still], worth[still], capacity)
        bound = bound or float(worth @ counts) / best[capacity]  # in the first round all lengths are priced
        for i in still[::-1]:
            config: dict[int, int] = defaultdict(int, {int(i): 1})
            c = capacity - int(lengths[i])
            while pick[c]:
                config[int(at[pick[c]])] += 1
                c -= int(pick[c])
            most = min(left[k] / n for k, n in config.items())
            if most > 0:
                uses[tuple(sorted(config.items()))] += most
                for k, n in config.items():
                    left[k] = left[k] - n * most if left[k] > n * most + 1e-9 else 0.0
    return uses, bound


def solve_fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, *, rounds: int = 3, gap: float = GAP) -> tuple[dict[tuple, float], float]:
    """Copies of configurations that cover each length, and their sum's distance from a proven bound, as a share of it."""
    worth, bound, best, value = (lengths / capacity) ** 1.3, lower_bound(lengths, counts, capacity), {}, np.inf
    for _ in range(rounds):
        uses, proven = cover_all(lengths, counts, worth, capacity)
        bound = max(bound, proven)
        if sum(uses.values()) < value:
            best, value = uses, sum(uses.values())
        if value <= (1 + gap) * bound:
            break
        lost = np.zeros(len(lengths))
        for config, x in uses.items():
            for i, n in config:
                lost[i] += n * x * (1 - sum(int(lengths[k]) * m for k, m in config) / capacity)
        worth = worth * np.exp(lost / counts)
    return best, value / bound - 1


def solve_program(lengths: np.ndarray, counts: np.ndarray, capacity: int, **program) -> list[tuple[dict[int, int], int]]:
    """(configuration by index of length, copies): the fractional answer, rounded down."""
    uses, _ = solve_fractional(lengths, counts, capacity, **program)
    left, out = counts.copy(), []
    for key, x in sorted(uses.items(), key=lambda item: -item[1]):
        copies = min([int(x + 1e-6), *(int(left[i] // n) for i, n in key)])
        if copies:
            out.append((dict(key), copies))
            for i, n in key:
                left[i] -= n * copies
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, **program) -> tuple[np.ndarray, int]:
    """Slots (length, first number, copies, first sequence, offset) and the number of sequences."""
    lengths = np.array(sorted(x for x in histogram if x < capacity), dtype=np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    groups: list[list] = [[[int(lengths[i]) for i, n in sorted(config.items(), reverse=True) for _ in range(n)], copies] for config, copies in (solve_program(lengths, counts, capacity, **program) if len(lengths) else [])]
    left = {int(x): int(n) for x, n in zip(lengths, counts)}
    for held, copies in groups:
        for x in held:
            left[x] -= copies
    by_room: list[list[list]] = [[] for _ in range(capacity + 1)]
    is_open = np.zeros(capacity + 1, dtype=bool)

    def put(g: list) -> None:
        room = capacity - sum(g[0])
        by_room[room].append(g)
        is_open[room] = True

    for g in groups:
        put(g)
    for x in sorted(left, reverse=True):  # best fit: the open sequences with the least room that suffices
        while left[x]:
            room = x + int(is_open[x:].argmax())
            if not is_open[room]:
                per = min(capacity // x, left[x])
                g = [[x] * per, left[x] // per]
                groups.append(g)
                left[x] -= per * g[1]
            else:
                g = by_room[room].pop()
                is_open[room] = bool(by_room[room])
                if left[x] < g[1]:  # some of these sequences get the piece, the others stay as they are
                    rest = [list(g[0]), g[1] - left[x]]
                    groups.append(rest)
                    put(rest)
                    g[1] = left[x]
                g[0].append(x)
                left[x] -= g[1]
            put(g)
    if histogram.get(capacity):
        groups.append([[capacity], histogram[capacity]])
    slots, used, sequence = [], defaultdict(int), 0
    for held, copies in groups:
        offset = 0
        for x in held:
            slots.append((x, used[x], copies, sequence, offset))
            used[x] += copies
            offset += x
        sequence += copies
    return np.array(sorted(slots), dtype=np.int64).reshape(-1, 5), sequence


def pack(cut: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces. `cut` must be stored: it is read more than once."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots, _ = plan(counts, capacity)
    spark = cut.sparkSession
    groups = spark.createDataFrame([(x, -(-n // GROUP_ROWS)) for x, n in counts.items()], "length long, groups long")
    salted = cut.join(F.broadcast(groups), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("groups"))).drop("groups")
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = before.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    numbered = salted.withColumn("number", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    numbered = numbered.join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("before")).alias("number"))
    table = spark.sparkContext.broadcast(slots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = table.value
        keys = (at[:, 0] << 46) + at[:, 1]
        for batch in batches:
            number = batch.column(5).to_numpy(zero_copy_only=False)
            k = np.searchsorted(keys, (batch.column(3).to_numpy(zero_copy_only=False) << 46) + number, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(at[k, 3] + number - at[k, 1]), pa.array(at[k, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int = 1, words_kept: int = WORDS_KEPT) -> DataFrame:
    cut = pieces(docs, tokenizer_path, capacity=capacity, end_id=end_id, words_kept=words_kept)
    return pack(written(cut, "pieces"), capacity=capacity)
