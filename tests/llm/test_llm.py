"""Operators against brute force, exact round trips and held-out accuracy; with nulls, ties and empty tables."""

import collections
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmill.llm import base, chat, cotraining, decontam, main_text, near_dedup, packing, quality_rules, tokens, url_filter, warc
from quillmill.llm.queries import URL_RULES, vocabulary

LONG = " ".join(f"w{k % 997}" for k in range(20_000))
RNG = random.Random(7)
WORDS = [f"word{k}" for k in range(300)]


def sentence(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def base_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    marked = {i + j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked)


def test_quality_statistics(docs):
    texts = [None, "", " \n\t ", "a b c", "é ü\xa0x ## | <b>", LONG, "x\ny\nx\n\n \nx", " ".join(["the"] * 40), (sentence(30) + "\n") * 3, "a b c d e f g h " * 2 + "a b c d e f g"]
    rows = {r["doc_id"]: r for r in quality_rules.judge_quality(docs(*texts), []).collect()}
    for k, t in enumerate(texts):
        assert tuple(rows[k][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base_counts(t), k
        n, _, _, _, again = base_counts(t)
        assert rows[k]["base_failed"] == (n < 20 or 100 * again > 30 * n) and rows[k]["kept"] == (not rows[k]["base_failed"])


def test_decision_list_is_learned(spark, docs):
    good = [sentence(40) for _ in range(60)]
    bad = [" ".join(w + RNG.choice(["***", "%%%"]) for w in sentence(40).split()) for _ in range(40)]
    at = docs(*good, *bad)
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(100)] + [(None, 0), (5, None)], "doc_id long, quality int")
    rules = quality_rules.learn_rules(at, labels)
    kept = {r["doc_id"] for r in quality_rules.judge_quality(at, rules, carry=True).where("kept").select("row.doc_id").collect()}
    assert rules and kept == set(range(60))
    assert quality_rules.learn_rules(at, labels.limit(0)) == [] and quality_rules.judge_quality(at.limit(0), rules).count() == 0


def components_by_force(texts, width, percent):
    sets = {}
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[k] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    root = dict(zip(sets, sets))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


@pytest.mark.parametrize("block", [256, 4])
def test_near_duplicates(docs, block):
    base = sentence(120).split()
    texts = [None, "", "one", "ONE", "two words", "Two  Words", LONG, LONG + " more", sentence(50)]
    for k in range(24):
        copy = list(base)
        for _ in range(k % 7):
            copy[RNG.randrange(len(copy))] = RNG.choice(WORDS)
        texts.append(" ".join(copy))
    want = components_by_force(texts, 3, 85)
    rows = near_dedup.near_duplicates(docs(*texts), width=3, percent=85, block=block).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_duplicates_of_nothing(docs):
    assert near_dedup.near_duplicates(docs("a").limit(0)).count() == 0


def test_links_between_blocks_by_force():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2**63, 100, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, 100, dtype=np.uint64)
    base = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    sets = [np.unique(np.r_[base[: 400 - k], rng.integers(0, 2**63, k).astype(np.uint64)]) for k in (0, 5, 30, 60, 120, 200) for _ in range(3)]
    block = pd.DataFrame({"rep": range(len(sets)), "comp": [k % 4 for k in range(len(sets))], "set": sets, "sig": [near_dedup.signature(s, a, b).tobytes() for s in sets]})
    root = list(range(4))
    for band in range(20):
        for x, y in near_dedup.links_between(block, block, band, 5, near_dedup.least_share(0.85, 100), 85):
            x, y = sorted((root[x % 4], root[y % 4]))
            root = [x if r == y else r for r in root]
    want = list(range(4))
    for x in range(len(sets)):
        for y in range(x):
            both = len(np.intersect1d(sets[x], sets[y]))
            if 100 * both >= 85 * (len(sets[x]) + len(sets[y]) - both):
                p, q = sorted((want[x % 4], want[y % 4]))
                want = [p if r == q else r for r in want]
    assert root == want


def test_recall_at_the_threshold():
    """Pairs just at 0.85: none of 300 fails to share a band or falls below the signatures' bound."""
    rows, bands = near_dedup.bands_for(0.85)
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 2**63, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, rows * bands, dtype=np.uint64)
    for _ in range(300):
        both, own = rng.integers(0, 2**63, 170).astype(np.uint64), rng.integers(0, 2**63, (2, 15)).astype(np.uint64)
        x, y = (near_dedup.signature(np.unique(np.r_[both, o]), a, b) for o in own)
        assert (x == y).reshape(bands, rows).all(1).any() and (x == y).mean() >= near_dedup.least_share(0.85, rows * bands)


def test_hot_keys_are_dealt(spark):
    left = spark.createDataFrame([(k % 7 if k > 50 else 0, k) for k in range(100)], "key long, v long")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(5)], "key long, name string")
    counted = left.groupBy("key").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        out = base.spread_join(left, right, "key", base.parts_of(counted, "key", "n", 10), F.col("v"), how)
        assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, left.join(right, "key", how).collect()), key=str)


def test_pipeline_keeps_one_row_of_each_group(spark):
    a, b = sentence(80), sentence(80)
    near = a + " more"
    rows = [(4, a), (4, a), (4, a), (9, near), (9, near), (2, b), (7, b), (None, a), (None, a), (None, None), (11, ""), (11, ""), (12, "one"), (13, sentence(50))]
    docs = spark.createDataFrame([(i, t, "en", "src0", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    named = sorted((i, t) for i, t in rows if i is not None and t)
    groups = components_by_force([t for _, t in named], 5, 80)  # by place, so that the root has the smallest id
    want = [named[k] for k, (_, root) in groups.items() if k == root] + [(i, t) for i, t in rows if i is None or not t]
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert collections.Counter((r["doc_id"], r["text"]) for r in out.collect()) == collections.Counter(want)


def test_stars_reach_the_smallest(spark):
    chain = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 150), (99, 150), (7, 7)]
    got = {r["node"]: r["root"] for r in near_dedup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(31)) and all(got[k] == 99 for k in (99, 100, 101, 150))


TRICKY = [None, "", "a  b\n\n c\t\td", "x\x1cy \x1d z", "<|endoftext|> a  <|endoftext|>b", "don't  I'LL\u00a0é e\u0301", "数据 数据\u3000数", "!!! ???", LONG, "a" * 5000, "Σας ΣΑΣ"]


def test_token_counts(docs):
    library = tokens.load_tokenizer(vocabulary("byte_bpe_50k.json"))
    rows = {r["doc_id"]: r for r in tokens.count_tokens(docs(*TRICKY), vocabulary("byte_bpe_50k.json")).collect()}
    for k, t in enumerate(TRICKY):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (rows[k]["n_bytes"], rows[k]["n_tokens"], rows[k]["over_limit"]) == (len((t or "").encode()), n, n > 1024), k


def test_packing(docs):
    library = tokens.load_tokenizer(vocabulary("word_bpe_49k.json"))
    texts = TRICKY + [sentence(RNG.randint(5, 900)) for _ in range(40)]
    rows = packing.pack_documents(docs(*texts), vocabulary("word_bpe_49k.json")).collect()
    want = {}
    for k, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 4096):
            part = ids[at : at + 4096]
            want[k, at // 4096] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    held = collections.defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096
    assert len(held) <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_texts_as_the_library():
    library, encode = tokens.load_tokenizer(vocabulary("word_bpe_49k.json")), packing.text_encoder(vocabulary("word_bpe_49k.json"))
    assert packing.plain_marks(library) and not packing.plain_marks(tokens.load_tokenizer(vocabulary("byte_bpe_50k.json")))
    plain = [c for c in map(chr, range(32, 256)) if c in " \t\n" or packing.PLAIN.match(c)]
    odd = [*map(chr, range(1, 256)), *"’ıİſẞŸΣς中\u0308\u2003", "<|endoftext|>", "<|STARTOFTEXT|>", "'s ", "'RE"]
    for marks in (plain, odd, plain + odd):
        for _ in range(3000):
            text = "".join(RNG.choice(marks) for _ in range(RNG.randint(0, 30)))
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(encode(text), "<u4").tolist() == want, text


def test_program_is_near_the_bound():
    rng = np.random.default_rng(1)
    counts = collections.Counter(int(x) for x in np.clip(rng.lognormal(6, 1, 30_000), 1, 4096))
    slots, sequences = packing.plan(dict(counts), rounds=20)
    assert sequences <= 1.01 * -(-sum(k * n for k, n in counts.items()) // 4096)
    used = collections.Counter()
    for length, _, copies, _, _ in slots:
        used[length] += copies
    assert used == counts


def test_program_covers_every_length():
    rng = np.random.default_rng(2)
    for capacity, size in ((4096, 300), (256, 40_000)):  # few pieces; many
        counts = collections.Counter(int(x) for x in np.clip(rng.lognormal(np.log(capacity) - 3, 1, size), 1, capacity - 1))
        lengths, n = np.array(sorted(counts)), np.array([counts[k] for k in sorted(counts)])
        uses, gap = packing.solve_fractional(lengths, n, capacity)
        covered = np.zeros(len(n))
        for config, x in uses.items():
            assert sum(lengths[i] * k for i, k in config) <= capacity
            for i, k in config:
                covered[i] += k * x
        bound = sum(k * m for k, m in counts.items()) / capacity
        assert np.allclose(covered, n) and 0 <= gap and sum(uses.values()) <= 1.02 * bound + 1
        placed = sum(lengths[i] * k * m for config, m in packing.solve_program(lengths, n, capacity) for i, k in config.items())
        assert 0 < placed <= lengths @ n and (size < 1000 or placed > 0.9 * lengths @ n)


def test_program_bounds_by_force():
    assert packing.lower_bound(np.array([30, 60]), np.array([5, 4]), 100) == 4 and packing.lower_bound(np.array([50]), np.array([3]), 100) == 1.5
    assert packing.solve_fractional(np.array([60]), np.array([7]), 100)[1] == 0


def test_warc_round_trip(spark):
    rows = [(5, "http://b.example/x?q=1", "same"), (3, "https://www.a.example/", "same"), (9, None, None), (8, "http://a.example/é ü", ""), (7, "http://a.example/", "é" * 9), (7, "http://a.example/", "é" * 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(pages).collect()}
    d = lambda t: warc.digest_of(t.encode())
    assert got == {5: (4, d("same"), "revisit", 3), 3: (4, d("same"), "response", None), 9: (0, d(""), "revisit", 8), 8: (0, d(""), "response", None), 7: (18, d("é" * 9), "response", None)}
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_rows_that_share_a_page_id(spark):
    rows = [(1, "u", "a"), (2, "u", "b"), (5, "u", "a"), (5, "u", "own"), (6, "u", "a"), (6, "u", "b")]
    got = collections.Counter((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    d = lambda t: warc.digest_of(t.encode())
    want = [(1, d("a"), "response", None), (2, d("b"), "response", None), (5, d("a"), "revisit", 1), (5, d("own"), "response", None), (6, d("a"), "revisit", 1), (6, d("b"), "revisit", 2)]
    assert got == collections.Counter(want)


def test_loser_tree_merges():
    runs = [sorted((RNG.randrange(50), k) for _ in range(RNG.randrange(9))) for k in range(7)]
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r) and list(warc.LoserTree([])) == []


def test_index_order(spark):
    rows = [(k, f"http://h{k % 3}.example/{RNG.randrange(9)}", f"t{k}") for k in range(60)]
    captures = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)))
    at = warc.merge_index(captures, range_rows=7).orderBy("range_no", "place").collect()
    keys = [(r["url_key"], r["captured"], r["page_id"]) for r in at]
    assert len(keys) == 60 and keys == sorted(keys) and len({r["range_no"] for r in at}) > 3


PAGE = """<html><head><title>no</title><script>var t="</p>";</script></head><body class="has-sidebar"><nav><ul><li><a href=x>Menu</a></li></ul></nav><div class="ad">Buy this thing right now, it is a very long advert text indeed</div>
<article><h1>Head &amp; line</h1><p>First <b>para</b>\n graph.<br>More<p>Second &lt;one&gt; &#233;.<!-- hidden --></p><aside>aside text of some length</aside><form>mail</form></article>
<div id="comments"><p>I like this article a lot, thank you for writing it</p></div><footer>&copy; site</footer></body></html>"""


def test_main_text(spark):
    assert main_text.main_text(PAGE) == "Head & line\nFirst para graph. More\nSecond <one> é."
    rows = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>" * 5000)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in main_text.extract_main_text(rows).collect()}
    assert got[2] == got[3] == got[4] == ("", 0) and got[1][1] == len(got[1][0])


def test_min_cut_by_force():
    for _ in range(60):
        n = RNG.randint(1, 7)
        scores = [RNG.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, RNG.uniform(0, 2)) for a in range(n) for b in range(a) if RNG.random() < 0.5]
        cost = lambda keep: sum(-s if k and s < 0 else s if not k and s > 0 else 0 for s, k in zip(scores, keep)) + sum(c for a, b, c in edges if keep[a] != keep[b])  # noqa: E731, B023
        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(2**n))
        assert abs(cost(main_text.min_cut(scores, edges)) - best) < 1e-6


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://net", "http://net/", "HTTP://A.B.NET/x", "http://x.example.net/en/1", "http://x.example.net/en", "http://notexample.com/de/", "https://a.example.com/de/?q", "http://org/fr/", "http://u@org/fr/", "http://a.org/fr?x/", "http://a.org#/fr/", "x://y://net/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    plain = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, URL_RULES).collect()}
    joined = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, URL_RULES, max_broadcast_rules=0).collect()}
    assert plain == joined
    assert [plain[k][0] for k in range(len(urls))] == [None, None, None, None, "net/", "net/", "example.net/en/", "net/", None, "example.com/de/", "org/fr/", None, None, None, None]


def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", "a\\", "</turn>\n", "\\\\x\\n", "### user: x", None, "", "plain: text", "<", "</turn", "\\"]
    rows = [(1, k, RNG.choice(["user", "assistant", "system", "User", "to:ol%3A", None, "</turn>\n"]), t) for k, t in enumerate(texts)] + [(2, 0, "user", "x"), (2, 0, "user", "x"), (None, 1, "assistant", "y")]
    out = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [(r or "", t or "") for c, _, r, t in rows if c == 1]
    assert len(out[2]["turns"]) == 2 and len(out[None]["turns"]) == 1


def test_decontamination(spark, docs):
    RNG.seed(11)
    items = [(k, sentence(30) + ". " + sentence(8) + ".") for k in range(12)] + [(50, None), (51, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    w = items[3][1].split()
    para = " ".join(x for k, x in enumerate(w) if k % 4 or k >= 30)
    texts = [None, "", sentence(100), sentence(70) + " " + items[2][1].upper() + " " + sentence(70), sentence(20) + " " + para + " " + sentence(20), LONG + " " + items[5][1], items[0][1]]
    got = {r["doc_id"]: (r["item_ids"], r["kept"]) for r in decontam.decontaminate(docs(*texts), bench).collect()}
    assert got == {0: ([], True), 1: ([], True), 2: ([], True), 3: ([2], False), 4: ([3], False), 5: ([5], False), 6: ([0], False)}
    assert decontam.decontaminate(docs(*texts), bench.limit(0)).where("not kept").count() == 0
    assert decontam.decontaminate(docs(*texts).limit(0), bench).count() == 0


def test_common_subsequence():
    for _ in range(50):
        a, b = ([RNG.randint(1, 5) for _ in range(RNG.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontam.common_subsequence(np.array(a, int), np.array(b, int)) == t[-1][-1]


def test_cotraining(spark, docs):
    RNG.seed(13)
    good = [sentence(60) for _ in range(120)]
    bad = [" ".join([w + "!!" for w in sentence(60).upper().split()]) if k % 2 else sentence(59) + " awfulword" for k in range(80)]
    at = docs(*good, *bad, None, "")
    labels = spark.createDataFrame([(k, int(k < 120 or k % 2 == 0), int(k >= 120 and k % 2 == 0)) for k in range(200) if k % 5], "doc_id long, quality int, toxic int")
    model = cotraining.train(at, labels)
    rows = {r["doc_id"]: r["kept"] for r in cotraining.score(at, model).collect()}
    assert len(rows) == 202 and sum(rows[k] == (k < 120) for k in range(200)) >= 190
    none = cotraining.train(at, labels.limit(0))
    assert cotraining.score(at, none, carry=True).where("kept").count() == 202 and cotraining.score(at.limit(0), model).count() == 0
