"""Exports: tables as CSV, documents as JSON, graphs as Cypher, GraphML, GEXF, node-link JSON and HTML.

Line formats (CSV, Cypher) are written by Spark in parallel. Single documents are streamed to the
driver row by row and are meant for reports of bounded size; large results belong in Parquet.
"""

from __future__ import annotations

import html
import json
import math
import os
from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.operators.graph import with_degree

NODE_COLUMNS = ["id", "label", "type", "paper_id", "year", "color", "degree"]
EDGE_COLUMNS = ["source", "target", "relation", "label"]
# Fixed text: example queries, as they must be written.
CYPHER_EXAMPLES = """// Most used datasets
MATCH (p:Paper)-[:USES]->(d:Dataset)
RETURN d.label AS dataset, count(p) AS papers
ORDER BY papers DESC
LIMIT 20;

// Papers connected to a keyword
MATCH (p:Paper)-[:RELATED_TO]->(k:Keyword)
WHERE toLower(k.label) CONTAINS toLower($keyword)
RETURN p.paper_id, p.label, k.label;

// Shared benchmarks between papers
MATCH (p1:Paper)-[:USES]->(d:Dataset)<-[:USES]-(p2:Paper)
WHERE p1.id < p2.id
RETURN d.label AS dataset, p1.label AS paper_a, p2.label AS paper_b
LIMIT 50;
"""


def flat(df: DataFrame) -> DataFrame:
    """Lists joined by `; `, structs as JSON: what a CSV file can hold."""
    return df.select(*[F.array_join(c, "; ").alias(c) if t.startswith("array<string") else F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_rows(df: DataFrame) -> Iterator[dict]:
    for r in df.toLocalIterator():
        yield r.asDict(recursive=True)


def write_json_document(df: DataFrame, path: str, *, run_metadata: dict | None = None, field: str = "papers") -> None:
    """A list of objects, or {run_metadata, field: list}."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    rows = list(json_rows(df))
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows if run_metadata is None else {"run_metadata": run_metadata, field: rows}, f, indent=2, ensure_ascii=False)


def nodes_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return with_degree(nodes, edges).orderBy("ord").select(*NODE_COLUMNS)


def edges_table(edges: DataFrame) -> DataFrame:
    return edges.orderBy("ord").select(*EDGE_COLUMNS)


def _quoted(value: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def cypher_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """line and its order: the constraint, then nodes, then edges."""
    head = nodes.sparkSession.createDataFrame([(0, "// Run in Neo4j Browser or cypher-shell."), (1, "CREATE CONSTRAINT kg_node_id IF NOT EXISTS FOR (n:KGNode) REQUIRE n.id IS UNIQUE;")], "k long, line string")
    kind = F.regexp_replace("type", "[^A-Za-z0-9_]", "")
    props = F.concat_ws(", ", *[F.concat(F.lit(f"{p}: "), _quoted(F.coalesce(p, F.lit("")))) for p in ("id", "label", "type", "paper_id", "year")])
    made = F.concat(F.lit("MERGE (n:KGNode:"), kind, F.lit(" {id: "), _quoted(F.col("id")), F.lit("}) SET n += {"), props, F.lit("};"))
    relation = F.upper(F.regexp_replace("relation", "[^A-Za-z0-9_]", "_"))
    joined = F.concat(F.lit("MATCH (a:KGNode {id: "), _quoted(F.col("source")), F.lit("}), (b:KGNode {id: "), _quoted(F.col("target")), F.lit("}) MERGE (a)-[:"), relation, F.lit("]->(b);"))
    none = F.struct(F.lit(-1).cast("long").alias("paper"), F.lit(-1).alias("field"), F.lit(0).alias("item"))
    order = lambda c: F.struct(*[F.col(f"{c}.{x}").alias(x) for x in ("paper", "field", "item")])
    rows = head.select(F.lit(0).alias("part"), none.alias("o"), "k", "line")
    rows = rows.unionByName(nodes.select(F.lit(1).alias("part"), order("ord").alias("o"), F.lit(0).cast("long").alias("k"), made.alias("line")))
    return rows.unionByName(edges.select(F.lit(2).alias("part"), order("ord").alias("o"), F.lit(0).cast("long").alias("k"), joined.alias("line"))).orderBy("part", "o", "k").select("line")


def write_cypher(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    cypher_lines(nodes, edges).write.mode("overwrite").text(path)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    keys = ["label", "type", "paper_id", "year", "color"]
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        f.writelines(f'  <key id="{k}" for="node" attr.name="{k}" attr.type="string"/>\n' for k in keys)
        f.write('  <key id="relation" for="edge" attr.name="relation" attr.type="string"/>\n  <graph edgedefault="directed">\n')
        for r in nodes.orderBy("ord").toLocalIterator():
            f.write(f"    <node id={quoteattr(r['id'])}>" + "".join(f'<data key="{k}">{html.escape(str(r[k] or ""), quote=False)}</data>' for k in keys) + "</node>\n")
        for r in edges.orderBy("ord").toLocalIterator():
            f.write(f"    <edge source={quoteattr(r['source'])} target={quoteattr(r['target'])}><data key=\"relation\">{html.escape(r['relation'], quote=False)}</data></edge>\n")
        f.write("  </graph>\n</graphml>\n")


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        keys = ["type", "paper_id", "year", "color"]
        f.write('<?xml version="1.0" encoding="utf-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">\n  <graph defaultedgetype="directed">\n    <attributes class="node">\n')
        f.writelines(f'      <attribute id="{n}" title="{k}" type="string"/>\n' for n, k in enumerate(keys))
        f.write('    </attributes>\n    <attributes class="edge"><attribute id="0" title="relation" type="string"/></attributes>\n    <nodes>\n')
        for r in nodes.orderBy("ord").toLocalIterator():
            values = "".join(f'<attvalue for="{n}" value={quoteattr(str(r[k] or ""))}/>' for n, k in enumerate(keys))
            f.write(f"      <node id={quoteattr(r['id'])} label={quoteattr(r['label'])}><attvalues>{values}</attvalues></node>\n")
        f.write("    </nodes>\n    <edges>\n")
        for k, r in enumerate(edges.orderBy("ord").toLocalIterator()):
            f.write(f'      <edge id="{k}" source={quoteattr(r["source"])} target={quoteattr(r["target"])} label={quoteattr(r["relation"])}><attvalues><attvalue for="0" value={quoteattr(r["relation"])}/></attvalues></edge>\n')
        f.write("    </edges>\n  </graph>\n</gexf>\n")


def write_node_link(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    doc = {"directed": True, "multigraph": False, "graph": {}, "nodes": list(json_rows(nodes.orderBy("ord").drop("ord"))), "edges": list(json_rows(edges.orderBy("ord").drop("ord")))}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(doc, f, indent=2, ensure_ascii=False)


def write_html(nodes: DataFrame, edges: DataFrame, path: str, *, most: int = 250) -> None:
    """A still picture of the `most` nodes of highest degree, on a circle by type."""
    shown = with_degree(nodes, edges).orderBy(F.desc("degree"), "id").limit(most).orderBy("type", "id").collect()
    at = {r["id"]: (600 + 480 * math.cos(2 * math.pi * k / max(1, len(shown))), 400 + 300 * math.sin(2 * math.pi * k / max(1, len(shown)))) for k, r in enumerate(shown)}
    ids = edges.sparkSession.createDataFrame([(i,) for i in at], "id string")
    lines = edges.join(F.broadcast(ids.withColumnRenamed("id", "source")), "source", "left_semi").join(F.broadcast(ids.withColumnRenamed("id", "target")), "target", "left_semi").collect() if at else []
    parts = ['<!DOCTYPE html><html><head><meta charset="utf-8"><title>Knowledge graph</title></head><body>']
    if not at:
        parts.append("<p>No nodes.</p>")
    else:
        parts.append('<svg width="1200" height="800" xmlns="http://www.w3.org/2000/svg">')
        parts += ['<line x1="{:.1f}" y1="{:.1f}" x2="{:.1f}" y2="{:.1f}" stroke="#bbb"/>'.format(*at[e["source"]], *at[e["target"]]) for e in lines]
        for r in shown:
            x, y = at[r["id"]]
            parts.append(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="{24 if r["type"] == "Paper" else 18}" fill="{r["color"]}"/><text x="{x:.1f}" y="{y:.1f}" font-size="10">{html.escape(r["label"] or "")[:36]}</text>')
        parts.append("</svg>")
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join([*parts, "</body></html>\n"]))


def write_single_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for reports of bounded size; no rows give an empty file."""
    import csv

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = None
        for r in flat(df).toLocalIterator():
            if out is None:
                out = csv.writer(f)
                out.writerow(df.columns)
            out.writerow(["" if x is None else x for x in r])


def write_document(value, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False)


def write_analysis(analysis: dict[str, DataFrame], path: str, *, run_metadata: dict | None = None) -> None:
    """The lists of an analysis as one document; each list is of bounded size."""
    lists = {name: list(json_rows(df)) for name, df in analysis.items()}
    write_document(lists if run_metadata is None else {"run_metadata": run_metadata, "analysis": lists}, path)


def write_cypher_file(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The script of `cypher_lines` as one file."""
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(r["line"] + "\n" for r in cypher_lines(nodes, edges).toLocalIterator())


def write_cypher_examples(path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(CYPHER_EXAMPLES)


def write_texts(texts: DataFrame, folder: str) -> None:
    """{paper_id}.txt files (rows: paper_id, text) in a folder that driver and user share."""
    os.makedirs(folder, exist_ok=True)
    for r in texts.toLocalIterator():
        with open(os.path.join(folder, f"{r['paper_id']}.txt"), "w", encoding="utf-8") as f:
            f.write(r["text"])


def upsert_graph(nodes: DataFrame, edges: DataFrame, connect, *, batch: int = 1_000) -> None:
    """Nodes, then edges, into a graph database. `connect()` gives, in each task, a function that runs a statement with
    parameters; statements are upserts, so a task that runs again changes nothing."""
    node = "UNWIND $rows AS r MERGE (n:KGNode {id: r.id}) SET n += r"
    edge = "UNWIND $rows AS r MATCH (a:KGNode {id: r.source}), (b:KGNode {id: r.target}) MERGE (a)-[x:RELATED {relation: r.relation}]->(b)"

    def send(statement: str):
        def work(rows) -> None:
            run, held = None, []
            for r in rows:
                run = run or connect()
                held.append(r.asDict())
                if len(held) >= batch:
                    run(statement, rows=held)
                    held = []
            if held:
                run(statement, rows=held)

        return work

    nodes.select("id", "label", "type", "paper_id", "year").foreachPartition(send(node))
    edges.select("source", "target", "relation").foreachPartition(send(edge))


def graph_database(uri: str, user: str, password: str, database: str | None = None):
    """`connect` for `upsert_graph`, if the optional client is installed."""
    try:
        import neo4j
    except ImportError as e:
        raise RuntimeError("writing to a graph database needs the optional package neo4j") from e

    def connect():
        session = neo4j.GraphDatabase.driver(uri, auth=(user, password)).session(database=database)
        return lambda statement, **values: session.run(statement, **values).consume()

    return connect
