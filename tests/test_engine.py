import hashlib
import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import analytics, entities, extract, graph, providers, quality, sections
from quillmill.plans import catalogue, pipeline
from quillmill.schema import CLEANER_HEADINGS, PAPER_FIELDS, SECTION_ALIASES
from quillmill.sinks import exports
from quillmill.sources import files

PAPER_ROWS = "paper_pos int, paper_id string, title string, year string, arxiv_id string, task string, method_name string, methodology string, datasets array<string>, baselines array<string>, metrics array<string>, keywords array<string>"


def papers(spark, *rows):
    base = {"title": "", "year": "2020", "arxiv_id": "", "task": "", "method_name": "", "methodology": "", "datasets": [], "baselines": [], "metrics": [], "keywords": []}
    return spark.createDataFrame([{**base, "paper_pos": k, "paper_id": f"p{k}", **r} for k, r in enumerate(rows)], PAPER_ROWS)


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t"))).first()[0]


def test_vocabularies():
    assert (len(CLEANER_HEADINGS), len(PAPER_FIELDS), sum(map(len, SECTION_ALIASES.values()))) == (16, 23, 22)


def test_graph_counts_and_method_from_first_sentence(spark):
    df = papers(spark, {"title": "A", "methodology": "We propose X. Then more.", "datasets": ["Cora", "PubMed"], "baselines": ["GCN"], "metrics": ["F1"], "keywords": ["graph", "node"]})
    nodes, edges = graph.build_graph(df)
    assert (nodes.count(), edges.count()) == (8, 7)
    assert nodes.where("type = 'Method'").first()["label"] == "We propose X"


def test_aliases_merge_and_are_typed(spark):
    df = papers(spark, {"datasets": ["CIFAR10"], "metrics": ["F1 score"]}, {"datasets": ["CIFAR-10"], "metrics": ["F1"]})
    assert graph.build_graph(df)[0].count() == 4
    held = entities.alias_map(None, {"Dataset": {"coco val": "COCO"}})
    nodes = graph.build_graph(papers(spark, {"datasets": ["COCO val"], "method_name": "COCO val"}), aliases=held)[0]
    assert {(r["type"], r["label"]) for r in nodes.collect()} >= {("Dataset", "COCO"), ("Method", "COCO val")}


def greedy(labels, ratio=0.94):
    held, out = [], []
    for label in labels:
        k = entities._python_key(label)
        hit = next((o for o in held if entities._python_key(o) == k or SequenceMatcher(None, k, entities._python_key(o)).ratio() >= ratio), None)
        if hit is None and label:
            held.append(label)
            hit = label
        out.append(hit)
    return out


def test_fuzzy_merge_of_many_near_labels(spark):
    """Runs of labels each near the next, in any order, short, long and repeated, against the sequential merge."""
    rng = random.Random(5)
    letters = "abcdefgh 12"
    pool = []
    for size in [4, 8, 9, 17, 18, 34, 35, 50, 120, 230] * 2:
        word = "".join(rng.choice(letters) for _ in range(size))
        for _ in range(9):
            pool.append(word)
            at = rng.randrange(1, len(word)) if len(word) > 1 else 0
            word = word[:at] + rng.choice(["", rng.choice(letters), rng.choice(letters) + word[at : at + 1]]) + word[at + 1 :]
    pool += [x.upper() for x in pool[::7]] + ["--", "!!"]
    rng.shuffle(pool)
    for ratio in (0.94, 0.8):
        rows = [("Keyword", x, (k, 0, 0)) for k, x in enumerate(pool)]
        df = spark.createDataFrame(rows, "type string, label string, ord struct<paper:long,field:int,item:int>").withColumn("target", F.lit(""))
        got = {r["ord"]["paper"]: r["resolved"] for r in entities.resolve(df, ratio=ratio).collect()}
        want = greedy(pool, ratio)
        assert [got[k] for k in range(len(pool))] == want
        assert len({x for x in want}) < len({entities._python_key(x) for x in pool})


def test_fuzzy_merge_is_first_match_in_order(spark):
    rng = random.Random(3)
    pool = ["CIFAR-10", "CIFAR-100", "cifar 10", "数据", "数据集", "", "old bolt", "cold bolt", "ImageNet", "Image Net 1", "nation 1", "nation 12", "nation 123"]
    for _ in range(4):
        seen = [rng.choice(pool) for _ in range(25)]
        rows = [("Dataset", label, (k, 0, 0)) for k, label in enumerate(seen)]
        df = spark.createDataFrame(rows, "type string, label string, ord struct<paper:long,field:int,item:int>")
        got = {r["ord"]["paper"]: r["resolved"] for r in entities.resolve(df.withColumn("target", F.lit(""))).collect()}
        assert [got[k] for k in range(25)] == greedy(seen)


def test_registered_graph_is_merged(spark, tmp_path):
    names = ["old widget", "cold widget", "red bolt", "old widget", "cold widget"]
    spark.createDataFrame([(k, 1, k, 1, 1.0, "R") for k in range(5)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, "Brand#1", "T", x) for k, x in enumerate(names)], "p_partkey long, p_brand string, p_type string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("SELECT id AS o_orderkey, DATE '2020-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(5)").write.parquet(f"{tmp_path}/orders.parquet")
    ask = lambda name: catalogue.queries()[name](spark, str(tmp_path))
    want = greedy(names)
    assert {r["label"] for r in ask("graph_nodes_merged").where("type = 'Keyword'").collect()} == set(want) == {"old widget", "red bolt"}
    edges = {(r["source"], r["target"]) for r in ask("graph_edges_merged").where("relation = 'related_to'").collect()}
    assert edges == {(f"paper:{k}", "keyword:" + x.replace(" ", "_")) for k, x in enumerate(want)}
    assert {r["id"]: r["degree"] for r in ask("node_degrees_merged").collect()}["keyword:old_widget"] == 4
    assert ask("graph_nodes").where("type = 'Keyword'").count() == 3


def test_registered_shared_pairs_are_merged(spark, tmp_path):
    parts = [123, 1230, 77, 123, 1239]
    spark.createDataFrame([(k, 1, x, 1, 1.0, "R") for k, x in enumerate(parts)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(x, "Brand#1", "T", "n") for x in set(parts)], "p_partkey long, p_brand string, p_type string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("SELECT id AS o_orderkey, DATE '2020-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(5)").write.parquet(f"{tmp_path}/orders.parquet")
    for name, labels in (("shared_pairs", [f"part {x}" for x in parts]), ("shared_pairs_merged", greedy([f"part {x}" for x in parts]))):
        want = sorted((d, f"Order {a}", f"Order {b}") for a, d in enumerate(labels) for b, e in enumerate(labels) if d == e and a < b)
        assert sorted(map(tuple, catalogue.queries()[name](spark, str(tmp_path)).collect())) == want and want


def test_rankings_and_benchmarks(spark):
    df = papers(spark, {"datasets": ["Cora", "cora", "Cora"]}, {"datasets": ["Cora", "image net"]}, {"datasets": ["ImageNet"]})
    assert [tuple(r) for r in analytics.ranked_values(df, "datasets").collect()] == [("Cora", 3), ("ImageNet", 2), ("cora", 1)]
    assert [(r[0], r[1], r[2]) for r in analytics.shared_benchmarks(df).collect()] == [("Cora", 3, ["p0", "p1"]), ("ImageNet", 2, ["p1", "p2"])]


def test_text_functions(spark):
    assert one(spark, "é-\né a-\nb", T.dehyphenate) == "éé ab"
    assert one(spark, "Intro\r\nABSTRACT\nx", T.clean_text).count("ABSTRACT") == 1
    assert one(spark, "  Weird / name?.pdf ", T.safe_filename) == "Weird__name.pdf".replace("__", "_") and one(spark, "???", T.safe_filename) == "untitled"
    assert one(spark, "STRASSE ß.", T.canonical_key) == "strasse ss"
    assert one(spark, "It uses CIFAR-100 and cora", lambda t: T.known_terms(t, ["CIFAR-10", "CIFAR-100", "Cora"])) == ["CIFAR-100", "Cora"]
    assert one(spark, 'x ```json\n{"a": 1}\n``` y', T.json_object_in) == '{"a": 1}' and one(spark, "none", T.json_object_in) is None


def python_noise(pages):
    lines = [[x.strip() for x in p.splitlines() if x.strip()] for p in pages]
    edges = [x for p in lines for x in p[:3] + p[-3:]]
    least = max(3, int(len(pages) * 0.35))
    noise = {x for x in edges if edges.count(x) >= least and len(x) <= 140}
    page = re.compile(r"[-–—]?\s*\d{1,4}\s*[-–—]?")
    return ["\n".join(x for x in p if x not in noise and not page.fullmatch(x)) for p in lines]


def test_page_noise_against_python(spark):
    rng = random.Random(5)
    for _ in range(6):
        pages = ["\n".join(rng.choice(["Head", "foot", "12", "- 3 -", "body a", "body b", "", "body c"]) for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(3, 7))]
        got = spark.createDataFrame([(pages,)], "p array<string>").select(T.drop_page_noise(F.col("p"))).first()[0]
        assert got == python_noise(pages)


def test_page_noise_reads_whole_texts(spark, tmp_path):
    texts = ["x" * 1950 + " Journal y", "z " * 2000, "short", "", "a" * 795 + "Journal"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_lines"], r["digest"]) for r in catalogue.page_noise(spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        kept = python_noise([f"Journal of Things\n{t[200 * i : 200 * i + 200]}\n12" for i in range(max(4, -(-len(t) // 200)))])
        lines = [x for p in kept for x in p.split("\n") if x]
        assert got[k] == (len(lines), hashlib.md5("\n".join(lines).encode()).hexdigest()), k
    assert got[3][0] == 0 and got[0][0] > 0


def test_lines_and_names_of_whole_texts(spark, tmp_path):
    texts = ["some words\n- 3 -\nmore\n 44 \n55555", "?" * 400 + "name", None, "no number"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n"] for r in catalogue.page_number_lines(spark, str(tmp_path)).collect()}
    assert got == {0: 6, 1: 4, 2: 4, 3: 4}
    assert {r["doc_id"]: r["name"] for r in catalogue.safe_filename(spark, str(tmp_path)).collect()}[1] == "nme"


def test_sections_and_chunks(spark):
    text = "\nAbstract\nWe study.\n1. Introduction\nHello\n\nthere\nIV. Methods\nm\nResults:\nr\nReferences\n[1] x\nConclusion\nno"
    df = sections.sections(spark.createDataFrame([("a", text), ("b", "plain\ntext"), ("c", None)], "paper_id string, text string"))
    rows = [(r["paper_id"], r["section_name"], r["text"]) for r in df.orderBy("paper_id", "pos").collect()]
    assert rows == [("a", "Abstract", "We study."), ("a", "Introduction", "Hello\n\nthere"), ("a", "Method", "m"), ("a", "Experiments", "r"), ("b", "Full Paper", "plain\ntext"), ("c", "Full Paper", "")]
    long = spark.createDataFrame([("a", 0, "Method", "aaaa\n\nbbbb\n\ncccc")], "paper_id string, pos long, section_name string, text string")
    assert [(r["section_name"], r["text"]) for r in sections.chunks(long, 12).orderBy("part").collect()] == [("Method part 1", "aaaa\n\nbbbb"), ("Method part 2", "cccc")]


def test_lists_and_merge(spark):
    got = spark.createDataFrame([([" Cora", "PubMed", "cora ", "", "Pub  Med", "Citeseer"],)], "x array<string>").select(extract.dedupe_list(F.col("x"))).first()[0]
    assert got == ["Cora", "PubMed", "Pub  Med", "Citeseer"]


def test_quality(spark):
    df = extract.builtin_extract(spark.createDataFrame([("a", "T\nnothing here")], "paper_id string, text string"))
    assert {r["field"] for r in quality.quality_warnings(df).collect()} == {"datasets", "methodology"}
    row = quality.quality_report(df).first()
    assert (row["warning_count"], row["total_field_count"]) == (2, 23)


def test_provider_rows_fail_alone(spark):
    class Scripted:
        def complete(self, prompt):
            if "bad" in prompt:
                raise ValueError("no")
            return '```json\n{"title": "ok"}\n```'

    df = spark.createDataFrame([("a", 0, "x", "good"), ("b", 0, "x", "bad")], "paper_id string, pos long, section_name string, text string")
    rows = {r["paper_id"]: r for r in providers.extract_with(df, Scripted, "{paper_id} {section_name} {paper_text} {previous_error}", all_fields=False).collect()}
    assert rows["a"]["error"] is None and "ok" in rows["a"]["json"] and "failed after 3 attempts" in rows["b"]["error"]


def test_whole_run_and_exports(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "s1.txt").write_text("Title of it\n\nAttention for node classification on Cora with GCN and accuracy.")
    summary = pipeline.run(spark, str(src), str(tmp_path / "out"))
    nodes, edges = spark.read.parquet(str(tmp_path / "out/tables/nodes")), spark.read.parquet(str(tmp_path / "out/tables/edges"))
    assert (summary.papers, summary.nodes - 1) == (1, summary.edges)
    lines = [r[0] for r in exports.cypher_lines(nodes, edges).collect()]
    assert lines[2].startswith('MERGE (n:KGNode:Paper {id: "paper:s1"}) SET n += {id: "paper:s1", label: "Title of it", type: "Paper", paper_id: "s1"') and lines[-1].startswith("MATCH (a:KGNode")
    for write, name in ((exports.write_graphml, "g.graphml"), (exports.write_gexf, "g.gexf"), (exports.write_node_link, "g.json"), (exports.write_html, "g.html")):
        write(nodes, edges, str(tmp_path / name))
        assert (tmp_path / name).stat().st_size > 100


def test_documents_and_id_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"paper_id": "x", "datasets": ["Cora"]}]')
    (tmp_path / "b.json").write_text('{"run_metadata": {"model": "m"}, "papers": [{"paper_id": "x"}]}')
    assert files.papers_document(spark, str(tmp_path / "a.json"))[0].first()["datasets"] == ["Cora"]
    assert files.papers_document(spark, str(tmp_path / "b.json"))[1] == {"model": "m"}
    (tmp_path / "ids.txt").write_text("# no\n 1 \n\n2\n")
    assert [r["paper_id"] for r in files.paper_ids(spark, str(tmp_path / "ids.txt")).orderBy("pos").collect()] == ["1", "2"]
    assert files.config_from("pipeline:\n  query: a\n  other: b\n", {"query": None, "retries": 2}) == {"query": "a", "retries": 2}


ORD = "type string, key string, ord struct<paper:long,field:int,item:int>"


def test_near_keys_are_found_without_comparing_all(spark):
    """Numbered keys are all alike in their pairs of characters; few of them are near each other."""
    rng = random.Random(2)
    numbers = [f"part {x}" for x in rng.sample(range(30_000), 1500)] + ["part 7", "part 77", "part 777", "part 7777"]
    words = ["".join(rng.choice("ab1 ") for _ in range(n)).strip() for n in (7, 8, 9, 15, 16, 17, 18, 24, 25, 26, 27) for _ in range(3)]
    words += [w[:k] + x + w[k + 1 :] for w in words for k in (0, 3, len(w) - 1) for x in ("", "c", "cd")]
    for ratio, pool in ((0.94, numbers), (0.94, words), (0.8, words)):
        held = list(dict.fromkeys(pool))
        rng.shuffle(held)
        keys = spark.createDataFrame([("Dataset", x, (k, 1, 0)) for k, x in enumerate(held)], ORD)
        got = {(r["earlier"], r["later"]) for r in entities.near_keys(keys, ratio).collect()}
        want = {(a, b) for k, b in enumerate(held) for a in held[:k] if abs(len(a) - len(b)) < 9 and SequenceMatcher(None, b, a).ratio() >= ratio}
        assert got == want and want
    keys = spark.createDataFrame([("Dataset", x, (k, 1, 0)) for k, x in enumerate(numbers)], ORD)
    assert entities.cut_pairs(keys, 0.94).count() < 3 * len(numbers) and entities.gram_pairs(keys, 0.94).count() == 0


def test_merge_in_rounds_and_at_once(spark, monkeypatch):
    rng = random.Random(4)
    held = [f"part {x}" for x in rng.sample(range(3000), 700)]
    keys = spark.createDataFrame([("Dataset", x, (k, 1, 0)) for k, x in enumerate(held)], ORD)
    at_once = {tuple(r) for r in entities.merged_keys(keys, 0.94).collect()}
    monkeypatch.setattr(entities, "LAST_PAIRS", 0)
    assert {tuple(r) for r in entities.merged_keys(keys, 0.94).collect()} == at_once
    assert at_once == {("Dataset", x, y) for x, y in zip(held, greedy(held)) if x != y}


def test_names_are_joined_alike_in_every_way(spark, monkeypatch):
    """Few names, many names, and names of many mentions; papers of one id; names that are empty or null."""
    rows = [{"paper_id": f"p{k % 30}", "datasets": ["Cora", "cora", ""][: k % 4], "keywords": ["数据", "", None, "old bolt", "cold bolt"][k % 3 :], "metrics": ["F1"]} for k in range(40)]
    df = papers(spark, *rows)

    def found(fuzzy):
        nodes, edges = graph.build_graph(df, fuzzy=fuzzy)
        assert "hashpartitioning(type" not in edges._jdf.queryExecution().executedPlan().toString() or graph.MAX_BROADCAST_NAMES == 0
        other = graph.graph_of(df, graph.named_mentions(df, fuzzy=fuzzy))
        assert all(sorted(map(str, x.collect())) == sorted(map(str, y.collect())) for x, y in zip((nodes, edges), other))
        return sorted(map(str, nodes.collect())), sorted(map(str, edges.collect()))

    few = found(True), found(False)
    monkeypatch.setattr(graph, "MAX_BROADCAST_NAMES", 0)
    monkeypatch.setattr(graph, "HOT_MENTIONS", 3)
    assert (found(True), found(False)) == few
    seen = [x for k in range(40) for x in rows[k]["keywords"] if x is not None]
    want = greedy(seen)
    got = {r["resolved"]: r["n"] for r in graph.resolved_counts(df).where("type = 'Keyword'").collect()}
    assert got == {x: want.count(x) for x in set(want)}


def test_order_as_a_number(spark):
    values = [(0, 0, 0), (-3, 4, 2**31 - 1), (2**63 - 1, 4, 2**31 - 1), (-(2**63), 0, 5), (7, 1, 0)]
    df = spark.createDataFrame([(x,) for x in values], "ord struct<paper:long,field:int,item:int>").withColumn("k", graph.ord_number(F.col("ord")))
    assert all(r["ord"] == r["back"] for r in df.withColumn("back", graph.ord_of(F.col("k"))).collect())
    assert [tuple(r["ord"]) for r in df.orderBy("k").collect()] == sorted(values)


def test_patterns_of_the_merged_graph(spark):
    df = papers(spark, {"datasets": ["Cora", "PubMed"], "keywords": ["old bolt"]}, {"datasets": ["Cora"], "keywords": ["cold bolt"]}, {"datasets": ["Cora", "PubMed"]})
    nodes, edges = graph.build_graph(df)
    assert [tuple(r) for r in analytics.top_datasets(nodes, edges).collect()] == [("Cora", 3), ("PubMed", 2)]
    assert sorted(tuple(r) for r in analytics.keyword_papers(nodes, edges, "bolt").collect()) == [("p0", "p0", "old bolt"), ("p1", "p1", "old bolt")]
    assert [tuple(r) for r in analytics.shared_pairs(nodes, edges).collect()] == [("Cora", "p0", "p1"), ("Cora", "p0", "p2"), ("Cora", "p1", "p2"), ("PubMed", "p0", "p2")]
    shown = analytics.node_view(nodes, edges, types=["Paper", "Dataset"], least_degree=3)
    assert [tuple(r) for r in analytics.edge_view(edges, shown).select("source", "target").collect()] == [("paper:p0", "dataset:cora")]
