"""Graphs and tables as text: one row of text for each node and edge, joined only for small outputs.

`*_lines` give ordered lines that can be written in parallel; `*_text` gather them,
for drawings, which are small by nature.
"""

from __future__ import annotations

import html
import json
import os
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def _ordered(rank: int, order, line) -> list:
    return [F.lit(rank).alias("rank"), order.alias("key"), line.alias("line")]


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    shape = F.when(F.col("type") == "repository", "box3d").when(F.col("type") == "package", "folder").otherwise("box")
    q = lambda c: F.replace(c, F.lit('"'), F.lit('\\"'))
    n = nodes.select(*_ordered(1, F.col("id"), F.format_string('  %s [label="%s", shape=%s];', X.graph_id("node_", F.col("id")), q(F.col("name")), shape)))
    e = edges.select(*_ordered(2, F.col("id"), F.format_string('  %s -> %s [label="%s"];', X.graph_id("node_", F.col("src")), X.graph_id("node_", F.col("dst")), F.col("kind"))))
    return n.unionByName(e)


def mermaid_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    q = F.replace(F.col("name"), F.lit('"'), F.lit("'"))
    n = nodes.select(*_ordered(1, F.col("id"), F.format_string('  %s["%s"]', X.graph_id("id_", F.col("id")), q)))
    e = edges.select(*_ordered(2, F.col("id"), F.format_string("  %s -->|%s| %s", X.graph_id("id_", F.col("src")), F.col("kind"), X.graph_id("id_", F.col("dst")))))
    return n.unionByName(e)


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    x = X.xml_escape
    n = nodes.select(*_ordered(1, F.col("id"), F.format_string('    <node id="%s"><data key="name">%s</data></node>', x(F.col("id")), x(F.col("name")))))
    e = edges.select(*_ordered(2, F.col("id"), F.format_string('    <edge source="%s" target="%s"><data key="kind">%s</data></edge>', x(F.col("src")), x(F.col("dst")), x(F.col("kind")))))
    return n.unionByName(e)


def json_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select(*_ordered(1, F.col("id"), F.to_json(F.struct(*nodes.columns))))
    return n.unionByName(edges.select(*_ordered(2, F.col("id"), F.to_json(F.struct(*edges.columns)))))


_FRAMES = {
    "dot": (dot_lines, "digraph G {\n", "\n}\n"),
    "mermaid": (mermaid_lines, "flowchart TD\n", "\n"),
    "graphml": (graphml_lines, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n  <graph edgedefault="directed">\n', "\n  </graph>\n</graphml>\n"),
    "json": (json_lines, "", "\n"),
}


def graph_text(nodes: DataFrame, edges: DataFrame, form: str) -> str:
    lines, head, foot = _FRAMES[form]
    return head + "\n".join(r.line for r in lines(nodes, edges).orderBy("rank", "key", "line").select("line").toLocalIterator()) + foot


def drawing_sample(nodes: DataFrame, edges: DataFrame, most_nodes: int = 50, most_edges: int = 100) -> tuple[DataFrame, DataFrame]:
    """The first nodes and edges by id, for a drawing."""
    return nodes.orderBy("id").limit(most_nodes), edges.orderBy("id").limit(most_edges)


def diagram(nodes: DataFrame, edges: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """dependency: packages and depends_on, imports; call: symbols and calls; else a drawing sample."""
    if kind == "dependency":
        return nodes.where("type = 'package'"), edges.where("kind in ('depends_on', 'imports')")
    if kind == "call":
        return nodes.where("type = 'symbol'"), edges.where("kind = 'calls'")
    return drawing_sample(nodes, edges)


#: A drawing's columns, the size of a box, and the gaps between boxes.
COLUMNS, WIDTH, HEIGHT, GAP_X, GAP_Y = 4, 180, 50, 60, 80


def placed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with x, y; edges with x1, y1, x2, y2) of a drawing sample, boxes in rows of four by id.

    The window without a partition runs over the sample alone.
    """
    few, lines = drawing_sample(nodes, edges)
    i = F.row_number().over(Window.orderBy("id")) - 1
    at = few.withColumn("_i", i).withColumns(
        {"x": GAP_X + F.col("_i") % COLUMNS * (WIDTH + GAP_X), "y": (GAP_Y + F.floor(F.col("_i") / COLUMNS) * (HEIGHT + GAP_Y)).cast("int")}
    )
    end = lambda c, x, y, dy: at.select(F.col("id").alias(c), (F.col("x") + WIDTH // 2).alias(x), (F.col("y") + dy).alias(y))
    return at.drop("_i"), lines.join(end("src", "x1", "y1", HEIGHT), "src").join(end("dst", "x2", "y2", 0), "dst")


def svg_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Elements of an SVG drawing of a sample: lines below, then boxes with their names."""
    at, lines = placed(nodes, edges)
    x = X.xml_escape
    drawn = F.format_string('<line x1="%d" y1="%d" x2="%d" y2="%d" class="edge"/>', "x1", "y1", "x2", "y2")
    box = F.format_string(
        '<rect x="%d" y="%d" width="180" height="50" class="node"/><text x="%d" y="%d">%s</text>', "x", "y", F.col("x") + 90, F.col("y") + 30, x(F.col("name"))
    )
    return lines.select(*_ordered(1, F.col("id"), drawn)).unionByName(at.select(*_ordered(2, F.col("id"), box)))


def svg(nodes: DataFrame, edges: DataFrame) -> str:
    """A whole SVG drawing of a sample."""
    n = min(nodes.limit(50).count(), 50)
    rows = max(1, -(-n // COLUMNS))
    box = f"0 0 {COLUMNS * (WIDTH + GAP_X) + GAP_X} {rows * (HEIGHT + GAP_Y) + GAP_Y}"
    style = "<style>.node{fill:#fff;stroke:#333}.edge{stroke:#36c}text{text-anchor:middle;font:13px sans-serif}</style>"
    body = "\n".join(r.line for r in svg_lines(nodes, edges).orderBy("rank", "key").collect())  # at most 150 elements
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="{box}">{style}\n{body}\n</svg>\n'


def interactive(nodes: DataFrame, edges: DataFrame, title: str = "Graph") -> str:
    """A page with the drawing of a sample, whose nodes can be searched; its data stands in it as JSON."""
    few, lines = drawing_sample(nodes, edges)
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731 -- a sample
    data = json.dumps({"nodes": rows(few), "edges": rows(lines)}, default=str).replace("</", "<\\/")
    script = (
        "document.getElementById('find').oninput=e=>document.querySelectorAll('svg text').forEach("
        "t=>t.style.opacity=t.textContent.toLowerCase().includes(e.target.value.toLowerCase())?1:0.2)"
    )
    return (
        f"<!doctype html><title>{html.escape(title)}</title><input id='find'>{svg(nodes, edges)}"
        f"<script type='application/json' id='data'>{data}</script><script>{script}</script>"
    )


def _quoted(c: Column) -> Column:
    """A value between double quotes, as YAML, TOML and JSON read it."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), text, F.lit('"'))


def yaml_items(df: DataFrame) -> DataFrame:
    """(item): each row as an item of a YAML list; nulls are null."""
    pairs = [F.concat(F.lit(f"{c}: "), F.when(F.col(c).isNull(), "null").otherwise(_quoted(F.col(c)))) for c in df.columns]
    return df.select(F.concat(F.lit("- "), F.concat_ws("\n  ", *pairs)).alias("item"))


def toml_items(df: DataFrame, table: str = "row") -> DataFrame:
    """(item): each row as an entry of a TOML array of tables; nulls are left out."""
    pairs = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c} = "), _quoted(F.col(c)))) for c in df.columns]
    return df.select(F.concat_ws("\n", F.lit(f"[[{table}]]"), *pairs).alias("item"))


def table_lines(df: DataFrame, gap: int = 3) -> DataFrame:
    """(rank, line) of a console table: upper-case heads, a rule, and rows padded to their columns' widest value."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]
    rows = df.select(*text)
    width = rows.agg(*[F.greatest(F.coalesce(F.max(F.length(c)), F.lit(0)), F.lit(len(c) + 2)).alias(f"_w{i}") for i, c in enumerate(df.columns)])
    cells = lambda values: F.rtrim(F.concat(*[F.rpad(v, F.col(f"_w{i}") + gap, F.lit(" ")) for i, v in enumerate(values)]))
    head = width.select(F.lit(0).alias("rank"), cells([F.lit(c.upper()) for c in df.columns]).alias("line"))
    rule = width.select(F.lit(1).alias("rank"), cells([F.lit("-" * (len(c) + 2)) for c in df.columns]).alias("line"))
    body = rows.join(F.broadcast(width)).select(F.lit(2).alias("rank"), cells([F.col(c) for c in df.columns]).alias("line"))
    return head.unionByName(rule).unionByName(body)


def write_table(df: DataFrame, path: str, form: str, overwrite: bool = False) -> None:
    """csv with a header, json, parquet, xml, yaml or toml; an existing folder is an error unless `overwrite`."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    {
        "csv": lambda: writer.option("header", True).csv(path),
        "json": lambda: writer.json(path),
        "parquet": lambda: writer.parquet(path),
        "xml": lambda: writer.format("xml").option("rowTag", "row").save(path),
        "yaml": lambda: yaml_items(df).write.mode("overwrite" if overwrite else "errorifexists").text(path),
        "toml": lambda: toml_items(df).write.mode("overwrite" if overwrite else "errorifexists").text(path),
    }[form]()


def markdown(title: str, sections: list[tuple[str, DataFrame]], most_rows: int = 100) -> str:
    """A report of small tables."""
    out = [f"# {title}", ""]
    for name, df in sections:
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(str(v).replace("|", "\\|") for v in r) + " |" for r in df.limit(most_rows).collect()] + [""]
    return "\n".join(out)


def html_report(title: str, sections: list[tuple[str, DataFrame]], most_rows: int = 100) -> str:
    e = lambda x: html.escape(str(x))
    out = [f"<!doctype html><title>{e(title)}</title><h1>{e(title)}</h1>"]
    for name, df in sections:
        head = "".join(f"<th>{e(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{e(v)}</td>" for v in r) + "</tr>" for r in df.limit(most_rows).collect())
        out.append(f"<h2>{e(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "\n".join(out)


def write_text(path: str, text: str, overwrite: bool = False) -> None:
    """Write a small text at once: to a file beside it, then renamed."""
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    fd, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(fd, "w") as f:
        f.write(text)
    os.replace(part, path)
