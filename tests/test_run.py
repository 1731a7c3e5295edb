"""Provider path, sources, whole runs and command line; functions that a golden value or brute force decides."""

import json
import os
import random
import sys
import unicodedata

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import analytics, extract, providers, quality
from quillmill.plans import cli, pipeline
from quillmill.schema import CONFIDENCE_FIELDS, LIST_FIELDS, PAPER, PAPER_FIELDS
from quillmill.sinks import exports
from quillmill.sources import files, literature

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not see this module
RNG = random.Random(2)


def papers_of(spark, *rows):
    """Rows of PAPER fields and paper_pos; what isn't given is empty."""
    empty = {f: [] if f in LIST_FIELDS else dict.fromkeys(CONFIDENCE_FIELDS, 0.0) if f == "confidence" else "" for f in PAPER_FIELDS}
    held = [(k, json.dumps(empty | r)) for k, r in enumerate(rows)]
    return spark.createDataFrame(held, "paper_pos long, j string").select("paper_pos", F.from_json("j", PAPER).alias("p")).select("paper_pos", "p.*")


def test_clean_pages(spark, tmp_path):
    pages = [f"ﬁrst Journal\nBody {k} exam-\nple text {k}\nAbstract\nmore {k}\n{k}" for k in range(3)]
    pages[1] = pages[1].replace("ﬁrst", "first")
    spark.createDataFrame([(1, pages), (2, ["one page\n1"]), (3, None), (4, [])], "id long, pages array<string>").write.parquet(f"{tmp_path}/p")
    for at in (spark.read.parquet(f"{tmp_path}/p"), spark.createDataFrame([(1, pages)], "id long, pages array<string>")):
        got = {r["id"]: r["text"] for r in T.clean_pages(at).collect()}
        assert "ournal" not in got[1] and got[1].count("example text") == 3 and got[1].count("ABSTRACT") == 3 and "\n2" not in got[1]
    got = {r["id"]: r["text"] for r in T.clean_pages(spark.read.parquet(f"{tmp_path}/p")).collect()}
    assert got[2] == "one page\n1" and got[3] is None and got[4] == ""


def test_lists_fold_case(spark):
    def force(items):
        seen, out = set(), []
        for x in items:
            x = x.strip()
            if x and (k := " ".join(x.split()).casefold()) not in seen:
                seen.add(k)
                out.append(x)
        return out

    rows = [(k, [RNG.choice(["Straße", "STRASSE", " a  b", "A B\t", "ﬁne", "FINE", "", "\n", "z"]) for _ in range(RNG.randrange(12))]) for k in range(60)] + [(99, [])]
    got = {r["k"]: r["v"] for r in spark.createDataFrame(rows, "k long, x array<string>").select("k", extract.dedupe_list(F.col("x")).alias("v")).collect()}
    assert all(got[k] == force(x) for k, x in rows)


def test_merge_takes_the_longest_bare_text(spark):
    rows = [{"paper_id": "p", "title": "\n" * 9 + "short" + "\t"}, {"paper_id": "p", "title": "longer text"}, {"paper_id": "p", "title": "also longer"}]
    chunks = papers_of(spark, *rows).withColumnRenamed("paper_pos", "pos")
    assert extract.merge_chunks(chunks).first()["title"] == "longer text"


def test_filter_reads_missing_fields(spark):
    rows = [{"paper_id": "1", "title": "T", "abstract": "x"}, {"paper_id": "2", "title": "U"}]
    df = papers_of(spark, *rows).withColumn("arxiv_id", F.lit(None).cast("string")).drop("methodology")
    ids = lambda q, **k: [r[0] for r in analytics.filter_papers(df, q, **k).select("paper_id").collect()]
    assert ids("none t") == ["1"] and ids("1 none") == ["1"] and ids("u   ") == ["2"] and ids("") == ["1", "2"] and ids("x  ") == ["1"]


def test_papers_of_one_id_share_warnings(spark):
    rows = [{"paper_id": "a", "datasets": ["x"]}, {"paper_id": "a", "methodology": "one two three four five six seven eight"}, {"paper_id": "b"}]
    got = [(r["paper_id"], r["warning_count"], [w["field"] for w in r["warnings"]]) for r in quality.quality_report(papers_of(spark, *rows)).collect()]
    assert sorted(got) == [("a", 2, ["methodology", "datasets"])] * 2 + [("b", 2, ["datasets", "methodology"])]


def test_ranks_of_names(spark):
    names = [(f"n{RNG.randrange(500):03d}",) for _ in range(300)]
    got = {r["x"]: r["k"] for r in files.ranked(spark.createDataFrame(names, "x string").repartition(5), "x", "k").collect()}
    assert got == {x: k for k, x in enumerate(sorted({n for n, in names}))}


def record(**more):
    empty = {f: [] if f in LIST_FIELDS else "" for f in PAPER_FIELDS} | {"confidence": {"datasets": 0.5, "metrics": "bad"}}
    return json.dumps(empty | more)


def test_schema_gate(spark):
    raw = [record(paper_id="a", datasets=["Cora"]), record(paper_id="b", title=3), record(paper_id="c", keywords="word"), "[1]", "no", record(paper_id=""), json.dumps({"paper_id": "d"})]
    got = [(r["invalid"], r["paper"]) for r in extract.papers_from_json(spark.createDataFrame([(x,) for x in raw], "json string").coalesce(1)).collect()]
    assert [x is None for x, _ in got] == [True, False, False, False, False, False, True]
    assert got[0][1]["datasets"] == ["Cora"] and got[0][1]["confidence"]["datasets"] == 0.5 and got[0][1]["confidence"]["metrics"] == 0.0
    assert "title" in got[1][0] and "keywords" in got[2][0] and got[6][1]["authors"] == []


def test_provider_path(spark, tmp_path):
    class Answers:
        """Sections give part of a record; the targeted retry gives the rest; paper `bad` never answers."""

        def complete(self, prompt):
            if "id=bad" in prompt:
                return "sorry"
            if "Target fields" in prompt:
                assert "datasets, methodology" in prompt and "No datasets" in prompt and '"arxiv_id":"m1"' in prompt.replace(" ", "")
                return "```json\n" + record(paper_id="x", datasets=["Cora"], methodology="a b c d e f g h i") + "\n```"
            return record(paper_id="x", title="From " + prompt.split("section=")[1].split(";")[0], keywords=["k"])

    text = "Title\nAbstract\nshort\nMethods\nlong text\nReferences\n[1]"
    texts = spark.createDataFrame([("good", "/t/good.txt", text), ("bad", "/t/bad.txt", text)], "paper_id string, text_path string, text string")
    notes = spark.createDataFrame([("good", "m1", "Given title", ["Keys"], "2021-03-04", "about")], "paper_id string, arxiv_id string, title string, categories array<string>, published string, summary string")
    providers.register("answers", lambda model: Answers())
    template = "id={paper_id} section={section_name}; {metadata_json} {extraction_mode} {previous_error} {paper_text}"
    papers, failures = providers.extract_papers(texts, providers.provider_for("answers"), template, pipeline.storing(spark, str(tmp_path)), metadata=notes, attempts=2)
    r = papers.first()
    assert papers.count() == 1 and (r["paper_id"], r["arxiv_id"], r["year"], r["abstract"], r["motivation"]) == ("good", "m1", "2021", "about", "about")
    assert r["title"] == "From Front Matter" and r["datasets"] == ["Cora"] and r["methodology"] == "a b c d e f g h i" and r["keywords"] == ["Keys", "k"]
    assert [tuple(x) for x in failures.collect()] == [("bad", "/t/bad.txt", "failed after 2 attempts: no JSON object in the answer")]
    with pytest.raises(ValueError):
        providers.provider_for("unknown")


RESULTS = [
    ("1706.1", "Graph networks", ["A"], "about\ngraphs ", "2019-01-01", "2020-01-01", ["cs"], "e1", "u1"),
    ("1801.2", "Other: things?", ["B", "C"], "graph graph", "2018-01-01", "2021-01-01", [], "e2", "u2"),
    ("1901.3", "Neither", [], "nothing", "2017-01-01", "2022-01-01", [], "e3", "u3"),
]


def test_catalogue_and_download(spark, tmp_path):
    def fetch(url):
        return {"u1": (b"%PDF-1", "text/html"), "u2": (b"<html>", "text/html"), "u3": (b"x", "application/PDF")}[url]

    table = literature.TableCatalogue(spark.createDataFrame(RESULTS, literature.RESULT))
    ids = lambda df: [r["arxiv_id"] for r in df.collect()]
    assert ids(literature.search(table, "graph networks")) == ["1706.1", "1801.2"] and ids(literature.search(table, "graph", sort_by="lastUpdatedDate", max_results=1)) == ["1801.2"]
    (tmp_path / "ids.txt").write_text("# some\n 1901.3\n\n")
    assert ids(literature.find(spark, table, query="graph", ids=["1801.2"], id_file=str(tmp_path / "ids.txt"))) == ["1801.2", "1901.3"]
    for wrong in (lambda: literature.search(table, "x", sort_by="size"), lambda: literature.lookup(table, [" "]), lambda: literature.find(spark, table)):
        with pytest.raises(ValueError):
            wrong()
    here = spark.createDataFrame([("pdfs/1901.3_Neither.pdf",)], "pdf_path string")
    metadata, failures, pdfs = literature.download(table.rows, "pdfs/", here, fetch, pipeline.storing(spark, str(tmp_path / "t")), attempts=1)
    assert {(r["paper_id"], r["summary"], r["pdf_path"]) for r in metadata.collect()} == {("1706.1", "about graphs", "pdfs/1706.1_Graph_networks.pdf"), ("1901.3", "nothing", "pdfs/1901.3_Neither.pdf")}
    assert [(r["paper_id"], r["title"], "look like" in r["error"]) for r in failures.collect()] == [("1801.2", "Other: things?", True)] and pdfs.count() == 1
    shown = spark.createDataFrame([(b"%PDF", None), (b"x", "application/pdf"), (b"x", None)], "c binary, t string").select(literature.looks_like_pdf(F.col("c"), F.col("t"))).collect()
    assert [r[0] for r in shown] == [True, True, False]


def test_pdf_directory(spark, tmp_path):
    def two_pages(content):
        return [content.decode() + "\nﬁrst page", "second page"]

    pdfs, texts = tmp_path / "pdf", tmp_path / "text"
    assert pipeline.parse_step(spark, str(pdfs), str(texts)) == 0
    pdfs.mkdir()
    for name in ("a", "b"):
        (pdfs / f"{name}.pdf").write_bytes(name.encode())
    (texts / "a.txt").write_text("old")
    assert pipeline.parse_step(spark, str(pdfs), str(texts), pages_of=two_pages) == 2
    assert (texts / "a.txt").read_text() == "old" and (texts / "b.txt").read_text() == "b\nfirst page\n\nsecond page"
    pipeline.parse_step(spark, str(pdfs), str(texts), overwrite=True, pages_of=two_pages)
    assert (texts / "a.txt").read_text().startswith("a\n")


def test_lenient_loaders(spark, tmp_path):
    assert files.json_or_default(str(tmp_path / "no.json")) == [] and files.json_or_default(str(tmp_path / "no.json"), {}) == {}
    assert files.csv_or_empty(spark, str(tmp_path / "no.csv")).count() == 0
    (tmp_path / "x.csv").write_text("a,b\n1,q\n")
    assert files.csv_or_empty(spark, str(tmp_path / "x.csv")).first()["a"] == 1
    assert files.unwrapped([1], "papers") == [1] and files.unwrapped({"papers": [2]}, "papers") == [2] and files.unwrapped({"papers": 3}, "papers") == []
    assert files.unwrapped({"analysis": {"a": 1}}, "analysis") == {"a": 1} and files.unwrapped({"a": 1}, "analysis") == {"a": 1} and files.unwrapped(4, "analysis") == {}


def test_command_line(spark, tmp_path):
    config, given = cli.settings(["--config", str(tmp_path / "none"), "--paper-id", "a", "--paper-id", "b", "--retries", "5", "--sample"])
    assert config == files.DEFAULTS | {"paper_ids": ["a", "b"], "retries": 5} and cli.skipped(given) == {"skip_search": True, "skip_parse": True, "skip_extract": False, "skip_graph": False}
    (tmp_path / "c.yaml").write_text("pipeline:\n  max_results: 9\n  unknown: 1\n  provider: mock\n")
    assert cli.settings(["--config", str(tmp_path / "c.yaml")])[0] == files.DEFAULTS | {"max_results": 9}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p1.txt").write_text("A Study\nWe test BERT on Cora and MNIST by Accuracy with attention.")
    out, log = str(tmp_path / "out"), str(tmp_path / "log" / "run.log")
    cli.main(["--config", "none", "--sample", "--input-dir", str(tmp_path / "in"), "--output-dir", out, "--log-path", log], spark)
    found = json.loads(open(f"{out}/extracted/papers.json").read())
    assert found["papers"][0]["datasets"] == ["Cora", "MNIST"] and found["run_metadata"]["provider"] == "mock"
    made = {"graph.json", "graph_analysis.json", "graph.gexf", "graph.graphml", "nodes.csv", "edges.csv", "neo4j_import.cypher", "neo4j_example_queries.cypher", "graph.html", "graph_interactive.html"}
    assert made <= set(os.listdir(out)) and "papers" in open(log).read()
    analysis = json.loads(open(f"{out}/graph_analysis.json").read())["analysis"]
    assert [x["label"] for x in analysis["most_used_datasets"]] == ["Cora", "MNIST"] and analysis["most_connected_papers"][0]["paper_id"] == "p1" and len(analysis) == 6
    assert 'title="type"' in open(f"{out}/graph.gexf").read() and "<attvalue" in open(f"{out}/graph.gexf").read()
    assert open(f"{out}/nodes.csv").read().startswith("id,label,type,paper_id,year,color,degree\npaper:p1,A Study,Paper,p1,")
    again = str(tmp_path / "again")
    cli.main(["--config", "none", "--papers", f"{out}/extracted/papers.json", "--output-dir", again], spark)
    assert open(f"{again}/edges.csv").read() == open(f"{out}/edges.csv").read()
    with pytest.raises(SystemExit):
        cli.main(["--config", "none"], spark)


def test_views(spark):
    papers = papers_of(spark, {"paper_id": "a", "motivation": "why"}, {"paper_id": "b", "abstract": "what", "title": "B"})
    report = spark.createDataFrame([(0, "a", 0.1, 3), (1, "a", 0.2, 1)], "pos long, paper_id string, quality_score double, warning_count int")
    got = {r["paper_id"]: (r["abstract"], r["quality_score"], r["warning_count"]) for r in analytics.paper_details(papers, quality.quality_by_paper(report)).collect()}
    assert got == {"a": ("why", 0.2, 1), "b": ("what", None, 0)} and analytics.counters(papers=papers) == {"papers": 2}
    notes = spark.createDataFrame([("a", "x/a.pdf")], "paper_id string, pdf_path string")
    assert analytics.metadata_only(papers, notes).count() == 1 and analytics.metadata_only(papers, notes.limit(0)).count() == 2


def test_graph_upsert_sends_nodes_then_edges(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "A", "Paper", "a", ""), ("b", "B", "Dataset", "", "")], "id string, label string, type string, paper_id string, year string").coalesce(1)
    edges = spark.createDataFrame([("a", "b", "uses")], "source string, target string, relation string").coalesce(1)
    log = str(tmp_path / "sent")

    def connect():
        def run(statement, rows):
            with open(log, "a") as f:
                f.write(f"{statement.split()[4]} {len(rows)} {'RELATED' in statement}\n")

        return run

    exports.upsert_graph(nodes, edges, connect)
    assert [x.split()[1:] for x in open(log).read().splitlines()] == [["2", "False"], ["1", "True"]]
    with pytest.raises(RuntimeError):
        exports.graph_database("x", "y", "z")


def test_shared_pairs_by_force(spark):
    uses = [(f"p{RNG.randrange(40):02d}", f"d{RNG.randrange(6)}") for _ in range(150)]
    edges = spark.createDataFrame([(a, b, "uses") for a, b in uses], "source string, target string, relation string")
    nodes = spark.createDataFrame([(x, x) for x in sorted({e for u in uses for e in u})], "id string, label string")
    want = sorted({(d, a, b) for a, d in uses for b, e in uses if d == e and a < b})
    for limit in (3, 50):
        assert sorted(map(tuple, analytics.shared_pairs(nodes, edges, limit).collect())) == want[:limit]


def test_nfkc_of_pages_matches_python(spark):
    texts = ["ﬁ ½ Å", "é", None]
    got = spark.createDataFrame([(texts,)], "x array<string>").select(T.nfkc_each("x")).first()[0]
    assert got == [unicodedata.normalize("NFKC", t) if t else None for t in texts]
