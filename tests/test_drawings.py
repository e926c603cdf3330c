"""Drawings, lists and tables of small frames."""

import json
import re
import tomllib

from plexmill.sinks import export


def graph(spark, n=60):
    nodes = spark.createDataFrame([(f"n{k:02}", "package", f"name <{k}>") for k in range(n)], "id string, type string, name string")
    edges = spark.createDataFrame([(f"e{k:02}", f"n{k:02}", f"n{(k * 7) % n:02}", "calls") for k in range(n)], "id string, src string, dst string, kind string")
    return nodes, edges


def test_svg_draws_a_sample(spark):
    text = export.svg(*graph(spark))
    assert text.count("<rect") == 50 and 'viewBox="0 0 1020 1770"' in text and "name &lt;49&gt;" in text and "name &lt;50&gt;" not in text
    assert text.count("<line") == sum(k < 50 and (k * 7) % 60 < 50 for k in range(60))
    assert 'x="300" y="80"' in text  # the second box of the first row
    empty = export.svg(*(df.limit(0) for df in graph(spark)))
    assert "<rect" not in empty and empty.startswith("<svg")


def test_page_holds_its_data(spark):
    text = export.interactive(*graph(spark, 3), title="A & B")
    data = json.loads(re.search(r"<script type='application/json' id='data'>(.*?)</script>", text).group(1))
    assert [n["id"] for n in data["nodes"]] == ["n00", "n01", "n02"] and len(data["edges"]) == 3 and "A &amp; B" in text


def test_yaml_and_toml_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b" \\ c\nd', None), (2, None, "x")], "id int, name string, note string").coalesce(1)
    items = [r.item for r in export.toml_items(df).collect()]
    assert tomllib.loads("\n".join(items)) == {"row": [{"id": "1", "name": 'a "b" \\ c\nd'}, {"id": "2", "note": "x"}]}
    assert [r.item for r in export.yaml_items(df).collect()] == ['- id: "1"\n  name: "a \\"b\\" \\\\ c\\nd"\n  note: null', '- id: "2"\n  name: null\n  note: "x"']
    for form in ("yaml", "toml"):
        export.write_table(df, str(tmp_path / form), form)
        assert any(p.suffix == ".txt" for p in (tmp_path / form).iterdir())


def test_table_is_aligned(spark):
    df = spark.createDataFrame([("long value", 1), (None, 22)], "a string, count int")
    lines = [r.line for r in export.table_lines(df).orderBy("rank", "line").collect()]
    assert lines == ["A            COUNT", "---          -------", "             22", "long value   1"]
