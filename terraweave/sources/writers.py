"""Outputs. Every sink is a distributed write; a document made of many lines is a
folder of text parts whose name order is the line order."""

from __future__ import annotations

import json
import logging
import os
import subprocess

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicon as lx

log = logging.getLogger(__name__)

# Colours by entity kind, link and constraint type.
KIND_FILL = {"place": "#eef5ff", "deictic": "#fff2cc", "person_locus": "#ffe6e6", "common_locus": "#eaeaea"}
KIND_COLOR = {"place": "#4a90e2", "deictic": "#f5a623", "person_locus": "#d0021b", "common_locus": "#9b9b9b"}
LINK_COLOR = {"QSLINK": "#1f77b4", "OLINK": "#d62728"}
TYPE_COLOR = {
    "near": "#27ae60", "far": "#e67e22", "north_of": "#8e44ad", "south_of": "#8e44ad", "east_of": "#8e44ad",
    "west_of": "#8e44ad", "across": "#2980b9", "distance_approx": "#f39c12", "co_occurrence": "#bdc3c7",
    "in_region": "#16a085", "on_coast": "#1abc9c",
}


def _color(c: Column, table: dict, other: str) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(other)


def write_jsonl(df: DataFrame, path: str, overwrite: bool = True, partition_by: list[str] | None = None) -> None:
    """JSON lines with nulls kept; without ``overwrite`` an existing output is left alone."""
    writer = df.write.mode("overwrite" if overwrite else "ignore").option("ignoreNullFields", False)
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def write_model(fixed: DataFrame, latent: DataFrame, constraints: DataFrame, path: str,
                origin: tuple[float, float]) -> None:
    """Constraint model as three tables and a one-row coordinate system."""
    from ..operators.constraints import params_map
    spec = constraints.select("constraint_id", "type", F.array_compact(F.array("e1", "e2")).alias("entities"),
                              params_map(constraints).alias("params"), "weight", "source_relation_id")
    for name, df in (("fixed_entities", fixed), ("latent_entities", latent), ("constraints", spec)):
        write_jsonl(df, os.path.join(path, name))
    system = fixed.sparkSession.createDataFrame(
        [("equirectangular", *map(float, origin), "km")], "projection string, origin_lat double, origin_lon double, units string")
    write_jsonl(system, os.path.join(path, "coordinate_system"))


def write_small_json(value: dict, path: str) -> None:
    """A report of bounded size (counts, top-k) as one indented file on the driver."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        json.dump(value, out, indent=2, ensure_ascii=False)


def write_lines(lines: DataFrame, path: str) -> None:
    """Sort ``(section, key, line)`` over the cluster and write the line column."""
    lines.orderBy("section", "key", "line").select("line").write.mode("overwrite").text(path)


def _fixed(like: DataFrame, section: int, rows: list[str]) -> DataFrame:
    values = [(section, f"{i:04d}", r) for i, r in enumerate(rows)]
    return like.sparkSession.createDataFrame(values, "section int, key string, line string")


def _row(section: int, key: Column, line: Column) -> list[Column]:
    return [F.lit(section).alias("section"), key.alias("key"), line.alias("line")]


def _edge_key() -> Column:
    return F.concat_ws("\u0001", "location_1", "location_2", "sentence_id", "indicator")


def _label() -> Column:
    return lx.edge_label(*[F.col(c) for c in ("rcc8", "cdc", "distance_value", "distance_unit", "indicator")])


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Graphviz source, one statement per line."""
    esc = lambda c: F.replace(F.replace(c, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" "))
    q = lambda c: F.concat(F.lit('"'), esc(c), F.lit('"'))
    node = F.concat(
        F.lit("  "), q(F.col("entity")), F.lit(' [label="'), esc(F.col("entity")), F.lit("\\n("),
        F.col("mention_count").cast("string"), F.lit(')", fillcolor="'),
        _color(F.col("entity_kind"), KIND_FILL, "#eef5ff"), F.lit('", tooltip="kind='),
        F.coalesce(F.nullif(F.col("entity_kind"), F.lit("")), F.lit("—")), F.lit('"];'))
    edge = F.concat(
        F.lit("  "), q(F.col("location_1")), F.lit(" -> "), q(F.col("location_2")), F.lit(" [label="), q(_label()),
        F.lit(', color="'), _color(F.col("link"), LINK_COLOR, "#d62728"), F.lit('", tooltip='), q(F.col("indicator")), F.lit("];"))
    head = ["digraph terraweave {", "  layout=dot; ranksep=0.8; bgcolor=white;",
            '  node [style="filled,rounded" shape=box fontsize=12];', "  edge [arrowsize=0.7 fontsize=9];"]
    return (_fixed(nodes, 0, head).unionByName(nodes.select(*_row(1, F.col("entity"), node)))
            .unionByName(edges.select(*_row(2, _edge_key(), edge))).unionByName(_fixed(nodes, 3, ["}"])))


NODE_KEYS = {"iso_space_type": "string", "mention_count": "long", "entity_kind": "string"}
EDGE_KEYS = {"iso_space_link": "string", "rcc8": "string", "cdc": "string", "distance_value": "string",
             "distance_unit": "string", "indicator": "string", "semantic_type": "string", "sentence_id": "string"}


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GraphML; missing values are empty strings."""
    def xml(c):
        out = F.coalesce(c.cast("string"), F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    data = lambda key, c: F.concat(F.lit(f'<data key="{key}">'), xml(c), F.lit("</data>"))
    n_cols = {"iso_space_type": F.lit("SpatialEntity"), "mention_count": F.col("mention_count"), "entity_kind": F.col("entity_kind")}
    e_cols = {k: F.col({"iso_space_link": "link"}.get(k, k)) for k in EDGE_KEYS}
    e_cols["semantic_type"] = F.array_join("semantic_type", ",")
    node = F.concat(F.lit('    <node id="'), xml(F.col("entity")), F.lit('">'),
                    *[data(f"n_{k}", c) for k, c in n_cols.items()], F.lit("</node>"))
    edge = F.concat(F.lit('    <edge source="'), xml(F.col("location_1")), F.lit('" target="'), xml(F.col("location_2")),
                    F.lit('">'), *[data(f"e_{k}", c) for k, c in e_cols.items()], F.lit("</edge>"))
    keys = [f'  <key id="{p}_{k}" for="{target}" attr.name="{k}" attr.type="{t}"/>'
            for p, target, table in (("n", "node", NODE_KEYS), ("e", "edge", EDGE_KEYS)) for k, t in table.items()]
    head = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">',
            *keys, '  <graph edgedefault="directed">']
    return (_fixed(nodes, 0, head).unionByName(nodes.select(*_row(1, F.col("entity"), node)))
            .unionByName(edges.select(*_row(2, _edge_key(), edge)))
            .unionByName(_fixed(nodes, 3, ["  </graph>", "</graphml>"])))


def html_lines(nodes: DataFrame, edges: DataFrame, title: str = "Spatial graph") -> DataFrame:
    """A page that draws the graph; every node and edge is one ``push`` line."""
    call = lambda fn, s: F.concat(F.lit(f"{fn}("), F.replace(F.to_json(s), F.lit("<"), F.lit("\\u003c")), F.lit(");"))
    node = call("node", F.struct(
        F.col("entity").alias("id"), F.col("mention_count").alias("value"),
        F.coalesce(F.nullif(F.col("entity_kind"), F.lit("")), F.lit("—")).alias("kind"),
        _color(F.col("entity_kind"), KIND_COLOR, "#4a90e2").alias("color")))
    dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("—")).alias(c)
    edge = call("edge", F.struct(
        F.col("location_1").alias("from"), F.col("location_2").alias("to"), _label().alias("label"), "link",
        dash("rcc8"), dash("cdc"), "indicator", "sentence_id", _color(F.col("link"), LINK_COLOR, "#d62728").alias("color")))
    head = [f"<!-- {title} -->", f"<!doctype html><meta charset=utf-8><title>{title}</title>",
            "<svg id=g width=1200 height=1200 viewBox='-600 -600 1200 1200'></svg><script>",
            "const N=new Map(),E=[];function node(n){N.set(n.id,n)}function edge(e){E.push(e)}"]
    tail = ["const S='http://www.w3.org/2000/svg',g=document.getElementById('g');",
            "[...N.values()].forEach((n,i)=>{const a=2*Math.PI*i/N.size;n.x=560*Math.cos(a);n.y=560*Math.sin(a)});",
            "function put(tag,at,tip){const e=document.createElementNS(S,tag);for(const k in at)e.setAttribute(k,at[k]);"
            "const t=document.createElementNS(S,'title');t.textContent=tip;e.append(t);g.append(e)}",
            "E.forEach(e=>{const a=N.get(e.from),b=N.get(e.to);put('line',{x1:a.x,y1:a.y,x2:b.x,y2:b.y,stroke:e.color},"
            "`${e.from} ${e.label} ${e.to} (${e.link}, ${e.indicator}, ${e.sentence_id})`)});",
            "N.forEach(n=>put('circle',{cx:n.x,cy:n.y,r:3+Math.sqrt(n.value),fill:n.color},`${n.id}: ${n.value}, ${n.kind}`));",
            "</script>"]
    return (_fixed(nodes, 0, head).unionByName(nodes.select(*_row(1, F.col("entity"), node)))
            .unionByName(edges.select(*_row(2, _edge_key(), edge))).unionByName(_fixed(nodes, 3, tail)))


def constraint_plot_lines(pairs: DataFrame) -> DataFrame:
    """Undirected constraint graph as Graphviz source."""
    line = F.concat(F.lit('  "'), F.col("a"), F.lit('" -- "'), F.col("b"), F.lit('" [label="'), F.col("type"),
                    F.lit('", color="'), _color(F.col("type"), TYPE_COLOR, "#95a5a6"), F.lit('", penwidth='),
                    F.col("width").cast("string"), F.lit("];"))
    return (_fixed(pairs, 0, ["graph Constraints {"]).unionByName(pairs.select(*_row(1, F.concat_ws(" ", "a", "b"), line)))
            .unionByName(_fixed(pairs, 2, ["}"])))


def summary_dict(summary: DataFrame, top: DataFrame) -> dict:
    """The summary report; its rows are the label sets plus the top k, so few."""
    out = {"nodes": 0, "edges": 0, "rcc8_distribution": {}, "cdc_distribution": {}, "entity_kind_distribution": {}}
    for r in summary.collect():
        if r["section"] in ("nodes", "edges"):
            out[r["section"]] = r["n"]
        else:
            out[f"{r['section']}_distribution"][r["key"]] = r["n"]
    out["top_connected"] = [r.asDict() for r in top.orderBy("rank").drop("rank").collect()]
    return out


def render_svg(dot_file: str, svg_file: str) -> bool:
    """Render one DOT file with Graphviz when it is installed."""
    try:
        subprocess.run(["dot", "-Tsvg", dot_file, "-o", svg_file], check=True)
        return True
    except (OSError, subprocess.CalledProcessError) as exc:
        log.warning("graphviz not available (%s); no SVG written", exc)
        return False


def render_f1_chart(scores: list[dict], path: str) -> bool:
    """Bar chart of F1 per model and scheme, when the plotting package is installed."""
    try:
        import matplotlib
        matplotlib.use("Agg")
        import matplotlib.pyplot as plt
    except ImportError:
        log.warning("matplotlib not installed; no chart written")
        return False
    models = sorted({s["model"] for s in scores})
    fig, ax = plt.subplots()
    for i, scheme in enumerate(("strict", "lenient")):
        f1 = {s["model"]: s["f1"] for s in scores if s["scheme"] == scheme}
        ax.bar([x + 0.35 * i for x in range(len(models))], [f1.get(m, 0.0) for m in models], 0.35, label=scheme)
    ax.set_xticks(range(len(models)), models)
    ax.set_ylim(0, 1)
    ax.legend()
    fig.savefig(path)
    plt.close(fig)
    return True
