"""SQL counterparts of stream_queries."""

from __future__ import annotations

from . import sql_parts as P
from ..sources.writers import EDGE_KEYS, KIND_COLOR, KIND_FILL, LINK_COLOR, NODE_KEYS

_dot_label = "coalesce(nullif(concat_ws(' / ', rcc8, cdc), ''), indicator)"

_data = lambda key, x: f"""'<data key="{key}">' || coalesce(({x})::VARCHAR, '') || '</data>'"""
_node_cols = {"iso_space_type": "'SpatialEntity'", "mention_count": "mention_count", "entity_kind": "entity_kind"}
_edge_cols = {**{k: k for k in EDGE_KEYS}, "iso_space_link": "CASE WHEN cdc IS NULL THEN 'QSLINK' ELSE 'OLINK' END",
              "semantic_type": f"coalesce({P.infer_type('indicator')}, '')"}
_head = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">',
         *[f'  <key id="n_{k}" for="node" attr.name="{k}" attr.type="{t}"/>' for k, t in NODE_KEYS.items()],
         *[f'  <key id="e_{k}" for="edge" attr.name="{k}" attr.type="{t}"/>' for k, t in EDGE_KEYS.items()],
         '  <graph edgedefault="directed">']
_fixed_rows = " ".join(f"UNION ALL SELECT {s}, '{i:04d}', {P.q(line)}" for s, rows in ((0, _head), (3, ["  </graph>", "</graphml>"]))
                       for i, line in enumerate(rows))

SQL = {
    "s14_graphml_lines": f"""WITH {P.EDGES}, l AS (
      SELECT 1 AS section, entity AS key, '    <node id="' || entity || '">' ||
        {' || '.join(_data(f'n_{k}', v) for k, v in _node_cols.items())} || '</node>' AS line FROM nd
      UNION ALL SELECT 2, concat_ws(chr(1), location_1, location_2, sentence_id, indicator), '    <edge source="' || location_1 ||
        '" target="' || location_2 || '">' || {' || '.join(_data(f'e_{k}', v) for k, v in _edge_cols.items())} || '</edge>' FROM ed
      {_fixed_rows})
      SELECT section, key, line, count(*) AS n FROM l GROUP BY 1, 2, 3""",
    "t04_stream_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "t03_stream_first_seen": "SELECT DISTINCT user_id, event_type FROM events",
    "t06_stream_recent": "SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 20",
    "d08_stream_buffers": """WITH b AS (SELECT 'duration' AS buffer, * FROM events UNION ALL SELECT 'relation', * FROM events WHERE event_type = 'purchase'
        UNION ALL SELECT 'error', * FROM events WHERE event_type = 'error'),
      r AS (SELECT *, row_number() OVER (PARTITION BY buffer ORDER BY ts DESC, event_id DESC) AS i FROM b)
      SELECT buffer, event_id, event_type, value FROM r WHERE i <= CASE buffer WHEN 'relation' THEN 8 WHEN 'error' THEN 20 ELSE 100 END""",
    "t05_stream_follow": "SELECT event_type, count(*) AS n, 'complete' AS status FROM events GROUP BY 1",
    "t01_stream_triples": f"""WITH {P.windows(3, 3)}, {P.hits('wins', 'doc_id, window_id')}
      SELECT doc_id, window_id, ord, location_1, spatial_indicator, location_2 FROM trips""",
    "s12_jsonl_round_trip": f"""WITH {P.EDGES} SELECT sentence_id, location_1, indicator AS spatial_indicator, location_2, count(*) AS n
      FROM ed GROUP BY 1, 2, 3, 4""",
    "s15_dot_lines": f"""WITH {P.EDGES}, l AS (
      SELECT 1 AS section, entity AS key, '  "' || entity || '" [label="' || entity || '\\n(' || mention_count || ')", fillcolor="' ||
        {P.case('entity_kind', KIND_FILL)} || '", tooltip="kind=' || entity_kind || '"];' AS line FROM nd
      UNION ALL SELECT 2, concat_ws(chr(1), location_1, location_2, sentence_id, indicator), '  "' || location_1 || '" -> "' || location_2 || '" [label="' ||
        {_dot_label} || '", color="' || CASE WHEN cdc IS NULL THEN '{LINK_COLOR['QSLINK']}' ELSE '{LINK_COLOR['OLINK']}' END ||
        '", tooltip="' || indicator || '"];' FROM ed
      UNION ALL SELECT 0, '0000', 'digraph terraweave {{'
      UNION ALL SELECT 0, '0001', '  layout=dot; ranksep=0.8; bgcolor=white;'
      UNION ALL SELECT 0, '0002', '  node [style="filled,rounded" shape=box fontsize=12];'
      UNION ALL SELECT 0, '0003', '  edge [arrowsize=0.7 fontsize=9];'
      UNION ALL SELECT 3, '0000', '}}')
      SELECT section, key, line, count(*) AS n FROM l GROUP BY 1, 2, 3""",
    "s16_html_lines": f"""WITH {P.EDGES}, l AS (
      SELECT 1 AS section, entity AS key, 'node(' || replace(to_json({{'id': entity, 'value': mention_count, 'kind': entity_kind,
        'color': {P.case('entity_kind', KIND_COLOR)}}})::VARCHAR, '<', '\\u003c') || ');' AS line FROM nd
      UNION ALL SELECT 2, concat_ws(chr(1), location_1, location_2, sentence_id, indicator), 'edge(' || replace(to_json({{
        'from': location_1, 'to': location_2, 'label': {_dot_label}, 'link': CASE WHEN cdc IS NULL THEN 'QSLINK' ELSE 'OLINK' END,
        'rcc8': coalesce(rcc8, '—'), 'cdc': coalesce(cdc, '—'), 'indicator': indicator, 'sentence_id': sentence_id,
        'color': CASE WHEN cdc IS NULL THEN '{LINK_COLOR['QSLINK']}' ELSE '{LINK_COLOR['OLINK']}' END}})::VARCHAR, '<', '\\u003c') || ');' FROM ed)
      SELECT section, key, line, count(*) AS n FROM l GROUP BY 1, 2, 3""",
}
