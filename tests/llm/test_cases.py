"""Defined cases of the operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import chat, cotraining, decontam, main_text, near_dedup, packing, quality_rules, tokens, url_filter, warc
from quillmill.llm.queries import URL_RULES, vocabulary

RNG = random.Random(3)
WORDS = [f"term{k}" for k in range(200)]


def sentence(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


LONG = " ".join(f"w{k % 1009}" for k in range(30_000))
CLASH = ["row_no", "n", "set", "sig", "hi", "lo", "cid", "rep", "kept", "row", "bad", "fold", "tokens", "piece", "length", "html", "digest", "share"]


def clashing(df):
    return df.select("*", *[F.lit(7).alias(c) for c in CLASH if c not in df.columns])


@pytest.fixture(scope="module")
def rows(spark):
    """A null row, empty and long texts, repeated rows, and columns named like those that operators make."""
    text = sentence(60)
    held = [(None, None), (1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, text), (5, text), (6, text), (7, "one")]
    df = spark.createDataFrame([(i, t, "en" if k % 2 else None, None if k == 3 else "s", k) for k, (i, t) in enumerate(held)], "doc_id long, text string, lang string, source string, n_chars long")
    return clashing(df)


def test_near_duplicates_cases(rows):
    got = collections.Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(rows, width=3, percent=85).collect())
    assert got == collections.Counter([(None, None, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (5, 5, True), (6, 5, False), (7, 7, True)])


def test_near_duplicates_of_an_id_with_two_texts(spark):
    a, b = sentence(50), sentence(50)
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (4, sentence(50))], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()} == {(1, 1), (2, 1), (2, 2), (3, 2), (4, 4)}


def test_decontamination_cases(rows, spark):
    bench = spark.createDataFrame([(None, sentence(20)), (9, rows.where("doc_id = 5").first()["text"]), (9, None), (8, "")], "item_id long, text string")
    got = collections.Counter((r["doc_id"], tuple(r["item_ids"])) for r in decontam.decontaminate(rows, bench, carry=True).select("doc_id", "item_ids", "row.n_chars").collect())
    assert got == collections.Counter({(None, ()): 1, (1, ()): 1, (2, ()): 1, (3, ()): 1, (4, ()): 1, (5, (9,)): 2, (6, (9,)): 1, (7, ()): 1})
    few = decontam.decontaminate(rows, bench, max_words=10)
    assert {r["doc_id"] for r in few.where("not kept").collect()} == {5, 6} and few.count() == rows.count()


def test_paraphrases_are_found(spark, docs):
    """Items with a seventh of their words replaced and neighbours swapped, between other words: nine of ten are found."""
    items = [(k, sentence(40) + ". Answer " + sentence(5) + ".") for k in range(60)]
    texts = []
    for _, text in items:
        w = text.split()
        for k in range(0, 40, 7):
            w[k] = RNG.choice(WORDS)
        w[10], w[11] = w[11], w[10]
        texts.append(sentence(90) + " " + " ".join(w) + " " + sentence(60))
    clean = [sentence(150) for _ in range(60)]
    got = {r["doc_id"]: r["item_ids"] for r in decontam.decontaminate(docs(*texts, *clean), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum(k in got[k] for k in range(60)) >= 54 and not any(got[k] for k in range(60, 120))


def test_latent_directions_against_an_exact_decomposition(spark):
    items = [(k, sentence(30)) for k in range(25)]
    held = [decontam.words(t) for _, t in items]
    names = {w: k + 1 for k, w in enumerate(sorted({w for h in held for w in h}))}
    idf = np.linspace(0.5, 2, len(names) + 1)
    matrix = np.zeros((len(items), len(names) + 1))
    for k, h in enumerate(held):
        at, w = decontam._tfidf(np.array([names[x] for x in h]), idf)
        matrix[k, at] = w
    made = decontam.latent_directions(spark.createDataFrame(items, "id long, text string").repartition(3), names, idf, rank=24)
    want = np.linalg.svd(matrix, full_matrices=False)[2][:24].T
    assert np.linalg.norm(matrix @ made) >= 0.999 * np.linalg.norm(matrix @ want)


def test_cotraining_cases(rows, spark):
    labels = spark.createDataFrame([(4, 1, None), (5, 0, 0), (5, 1, 0), (6, 1, 0), (None, 1, 1), (1, None, 1)], "doc_id long, quality int, toxic int")
    out = cotraining.classify(rows, labels, carry=True)
    assert out.count() == rows.count() and "n_chars" in out.select("row.*").columns
    assert cotraining.classify(rows.limit(0), labels).count() == 0


def test_cotraining_gains_from_the_exchange(spark):
    """Labelled texts are of one topic, unlabelled ones of another; only the source tells the view of words about the other topic."""
    def doc(bad, topic):
        return " ".join(RNG.choice([f"{'bad' if bad else 'good'}{topic}{RNG.randrange(25)}", RNG.choice(WORDS)]) for _ in range(30))

    made = [(k, doc(k % 2, "x"), "en" if k % 2 else "de", "junk" if k % 2 else "fine", 200 + k % 50, k % 2) for k in range(600)]
    made += [(k, doc(k % 2, "y"), "en" if k % 2 else "de", "junk" if k % 2 else "fine", 200 + k % 50, None) for k in range(600, 1000)]
    made += [(k, doc(k % 2, "y"), "fr", "new", 200 + k % 50, None) for k in range(1000, 1200)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, bad int")
    labels = df.where("bad is not null").select("doc_id", (1 - F.col("bad")).alias("quality"), F.lit(0).alias("toxic"))
    right = []
    for rounds in (0, 3):
        out = cotraining.classify(df, labels, rounds=rounds).where("doc_id >= 1000").collect()
        right.append(sum(r["kept"] == (r["doc_id"] % 2 == 0) for r in out))
    assert right[1] >= 190 and right[1] > right[0] + 20, right


def test_token_counts_cases(rows):
    got = tokens.count_tokens(rows, vocabulary("byte_bpe_50k.json")).collect()
    assert len(got) == rows.count() and {r["n_tokens"] for r in got if r["doc_id"] in (None, 1, 2)} == {0}
    assert len({r["n_tokens"] for r in got if r["doc_id"] == 5}) == 1 and tokens.count_tokens(rows.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def test_packing_cases(rows):
    got = packing.pack_documents(rows, vocabulary("word_bpe_49k.json")).collect()
    assert {(r["length"], r["offset"] + r["length"] <= 4096) for r in got if r["doc_id"] in (1, 2, 3)} == {(1, True)}
    assert sum(r["doc_id"] == 5 for r in got) == 2 and sum(r["doc_id"] is None for r in got) == 1
    places = [(r["sequence_id"], r["offset"]) for r in got]
    assert len(set(places)) == len(places) and packing.pack_documents(rows.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_quality_rules_cases(rows, spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_rules.judge_quality(rows, quality_rules.learn_rules(rows, labels), carry=True)
    assert out.count() == rows.count() and not out.where("row.doc_id in (1, 2, 3, 7) and kept").count()


def test_url_filter_cases(spark):
    df = clashing(spark.createDataFrame([(1, "http://a.net/" + "x" * 50_000), (1, "http://a.net/" + "x" * 50_000), (None, None)], "page_id long, url string"))
    got = url_filter.judge_urls(df, URL_RULES)
    assert sorted(r["verdict"] for r in got.collect()) == ["allow", "block", "block"] and url_filter.judge_urls(df.limit(0), URL_RULES).count() == 0


def test_chat_cases(spark):
    long = "x " * 50_000 + "</turn>"
    rows = [(1, 0, "user", None), (1, 1, "assistant", long), (1, 1, "assistant", long), (2, 0, None, ""), (3, None, "assistant", "\\a ### b")]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    chats = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chats.collect()}
    for conv, texts in ((1, [long, long]), (2, []), (3, ["\\a ### b"])):
        held = [got[conv]["formatted"][s["start"] - 1 : s["start"] - 1 + s["length"]] for s in got[conv]["loss_mask"]]
        assert len(held) == len(texts) and all("</turn>" not in h for h in held)
    digests = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.chat_digests(chats).collect()}
    assert digests == {1: (3, 2 * len(long)), 2: (1, 0), 3: (1, 8)} and chat.format_chats(df.limit(0)).count() == 0


P = "A paragraph of the story with so many words that nobody takes it for a label of a menu."


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<div id="content" class="no-sidebar"><p>{P}</p></div>', P),
        (f'<div class="article-body has-tags"><p>{P}</p></div>', P),
        (f'<article data-role="banner" data-id="ad"><p title="hidden gems" data-x=hidden>{P}</p></article>', P),
        (f"<article><p>{P} <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p></article>", P + " x=2"),
        (f'<main><h1>Head</h1><p>{P}</p><div class="ad-slot"><p>{P}</p></div><section id="comments"><p>{P}</p></section><p hidden>{P}</p></main>', "Head\n" + P),
        (f'<div class="sidebar"><p>{P}</p></div><div role="dialog">{P}</div><form><p>{P}</p></form><div><p>{P}</p></div>', P),
        ("just text &amp; more of it, without any tag at all in it.", "just text & more of it, without any tag at all in it."),
        ("a < b and c", ""),
    ],
)
def test_main_text_cases(page, want):
    assert main_text.main_text(page) == want


def test_the_cut_moves_blocks():
    page = f"<div><div>{P}</div><div>So it was</div><div>{P}</div></div><nav><div>Read all of our other long and wonderful stories here</div></nav>"
    blocks, costs = main_text.blocks_of(page), main_text.Costs()
    scores = [costs.score(b) for b in blocks]
    kept = main_text.min_cut(scores, main_text.smoothness(blocks))
    assert scores[1] < 0 and kept == [True, True, True, False]


def test_costs_are_learned(spark):
    """Names that no list holds: learned where landmarks stand around them, used where none do."""
    seen = [(k, "u", f'<article><div class="prose">{sentence(8)}</div></article><nav><div class="zubehoer">{sentence(9)}</div></nav>') for k in range(60)]
    pages = spark.createDataFrame(seen, "page_id long, url string, html string")
    costs = main_text.learn_costs(pages)
    assert costs.weights["n:prose"] > 0.2 and costs.weights["n:zubehoer"] < -0.1
    assert main_text.learn_costs(pages.limit(0)).weights == pytest.approx(main_text.PRIOR)


def test_main_text_is_linear_in_odd_pages():
    import time

    began = time.time()
    for piece in ("<p ", "<svg>", '<p "', "<p>x", "<!-- "):
        main_text.main_text(piece * 20_000)
    assert time.time() - began < 60


def test_index_is_the_whole_history(spark):
    rows = [(k if k % 9 else None, f"http://h{k % 3}.example/{k % 5}", f"t{k % 40}") for k in range(300)]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6))
    captures = warc.written(warc.read_archives(warc.write_archives(pages)), "captures")
    got = warc.merge_index(captures, range_rows=30).orderBy("range_no", "place").collect()
    key = lambda r: (r["url_key"], r["captured"], -(2**63) if r["page_id"] is None else r["page_id"])
    assert [key(r) for r in got] == sorted(key(r) for r in captures.collect()) and len({r["range_no"] for r in got}) > 4
    assert warc.merge_index(captures.limit(0)).count() == 0


def test_segments_hold_records_of_any_size():
    payloads = [b"", b"x" * 100_000, RNG.randbytes(70_000), b"\r\n\r\n"]
    whole = b"".join(warc.record(k, "u", p, None) for k, p in enumerate(payloads))
    assert [block for *_, block in warc.records_in(whole)] == payloads
