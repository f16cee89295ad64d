"""SQL counterparts of text_queries."""

from __future__ import annotations

from . import sql_parts as P
from .text_queries import HEAD, PHRASES, TAIL, UNITS


def _printf(template: str) -> str:
    body = P.q(template).replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '")
    return body.replace("%d", "' || doc_id || '")


def _slug(x: str) -> str:
    flat = rf"regexp_replace(strip_accents({x}), '[^\x{{0}}-\x{{7F}}]', '', 'g')"
    joined = f"trim(regexp_replace(lower({flat}), '[^a-z0-9]+', '_', 'g'), '_')"
    return f"coalesce(nullif({joined}, ''), 'doc')"


TITLE = "regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"
_lines = P.sentence_list(P.tidy("text"), 1)
_pick = lambda values, c: f"list_extract([{', '.join(map(P.q, values))}], (({c}) % {len(values)} + 1)::INT)"
_trip_cols = "doc_id, window_id, ord, location_1, spatial_indicator, location_2"
_turns = lambda size, stride, tail, body: f"""
WITH placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
                       count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
starts AS (SELECT conv_id, unnest(range(0, max(n) {'' if tail else f'- {size} + 1'}, {stride})) AS s FROM placed GROUP BY conv_id)
SELECT p.conv_id, s.s // {stride} AS window_id, string_agg(turn::VARCHAR, ',' ORDER BY pos) AS turns,
       {P.strip(f"string_agg({body}, ' ' ORDER BY pos)")} AS sentence
FROM placed p JOIN starts s ON p.conv_id = s.conv_id AND pos >= s.s AND pos < s.s + {size} GROUP BY p.conv_id, s.s"""
_tokens = rf"len(list_filter(regexp_split_to_array(text, '{P.SPACE}+'), lambda w: w <> ''))"
_dist = lambda c: f"WITH {P.EDGES} SELECT coalesce({c}, '—') AS {c}, count(*) AS n FROM ed GROUP BY 1"

SQL = {
    "p03_clean_text": f"""SELECT doc_id, c AS clean, length(c)::BIGINT AS n FROM (
        SELECT doc_id, {P.tidy(P.strip_licence('t'))} AS c FROM (
          SELECT doc_id, {_printf(HEAD)} || text || {_printf(TAIL)} AS t FROM documents))""",
    "p05_clean_text_legacy": f"""SELECT conv_id, turn, c AS clean, {P.fold('c')} AS folded FROM (
        SELECT conv_id, turn, {P.tidy('text', False)} AS c FROM conversations)""",
    "p01_slugs": f"""SELECT page_id, {_slug(TITLE)} AS title_slug, {_slug('url')} AS url_slug,
        regexp_replace({_slug("'The ' || " + TITLE)}, '^the_', '') AS doc_slug,
        translate(url, ':/', '__') AS tag, translate({TITLE}, ' /', '__') AS file_name FROM pages""",
    "w01_sentence_segment": f"""WITH {P.SENTS} SELECT doc_id, sent_idx,
        doc_id || '_sent_' || sent_idx AS sentence_id, text FROM sents""",
    "d01_dedup_consecutive": f"""WITH l AS (SELECT conv_id, turn, {_lines} AS a FROM conversations),
        x AS (SELECT conv_id, turn, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS i FROM l),
        z AS (SELECT *, lag(line) OVER (PARTITION BY conv_id ORDER BY turn, i) AS p FROM x)
        SELECT conv_id, turn, i, line FROM z WHERE p IS NULL OR p <> line""",
    "d02_dedup_all": f"""WITH docs AS (SELECT doc_id, {P.tidy('text', False)} AS t FROM documents),
        lists AS (SELECT doc_id, {P.sentence_list('t')} AS l FROM docs),
        listed AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS i FROM lists)
        SELECT doc_id, min(i) AS sent_idx, doc_id || '_sent_' || min(i) AS sentence_id, text
        FROM listed GROUP BY doc_id, text""",
    "w03_windows_fixed": f"WITH {P.windows(3, 3)} SELECT doc_id, window_id, sentence_ids, sentence FROM wins",
    "w03_windows_overlap": f"WITH {P.windows(3, 2)} SELECT doc_id, window_id, sentence_ids, sentence FROM wins",
    "w03_windows_of_turns": _turns(3, 2, False, P.strip("replace(text, chr(10), ' ')")),
    "w04_chunks_of_turns": _turns(6, 4, True, "text"),
    "w04_chunks_overlap": f"WITH {P.chunks()} SELECT doc_id, chunk_id, sentence_ids, sentence FROM chunks",
    "w05_token_chunks": f"""WITH RECURSIVE {P.SENTS},
        c AS (SELECT doc_id, sent_idx, {_tokens} AS n FROM sents),
        f AS (SELECT doc_id, sent_idx, n, 0 AS chunk, n AS used FROM c WHERE sent_idx = 0
          UNION ALL SELECT c.doc_id, c.sent_idx, c.n, CASE WHEN f.used + c.n > 60 THEN f.chunk + 1 ELSE f.chunk END,
            CASE WHEN f.used + c.n > 60 THEN c.n ELSE f.used + c.n END
          FROM f JOIN c ON c.doc_id = f.doc_id AND c.sent_idx = f.sent_idx + 1)
        SELECT doc_id, chunk::BIGINT AS chunk, min(sent_idx) AS first_idx, count(*) AS n_sents,
          sum(n)::BIGINT AS n_tokens FROM f GROUP BY doc_id, chunk""",
    "w06_token_windows": f"""WITH RECURSIVE {P.SENTS},
        c AS (SELECT doc_id, sent_idx, {_tokens} AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM sents),
        r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY sent_idx) AS upto FROM c),
        e AS (SELECT a.doc_id, a.sent_idx AS s, max(a.total) AS total,
                greatest(count(b.sent_idx), 1) AS len,
                coalesce(max(b.upto), 0) AS up, min(a.upto - a.n) AS before, min(a.n) AS own
              FROM r a LEFT JOIN r b ON a.doc_id = b.doc_id AND b.sent_idx >= a.sent_idx
                AND b.upto - (a.upto - a.n) <= 80 GROUP BY a.doc_id, a.sent_idx),
        w AS (SELECT doc_id, 0 AS win, s, len, total, greatest(up - before, own) AS tokens FROM e WHERE s = 0
          UNION ALL SELECT e.doc_id, w.win + 1, e.s, e.len, e.total, greatest(e.up - e.before, e.own) FROM w JOIN e
            ON e.doc_id = w.doc_id AND e.s = w.s + greatest(1, w.len - 2) WHERE w.s + w.len < w.total)
        SELECT doc_id, win::BIGINT AS win, s AS first_pos, len AS n_sents, tokens::BIGINT AS n_tokens FROM w""",
    "w07_draw_windows": f"""WITH {P.windows(3, 3)},
        h AS (SELECT *, md5('42:' || doc_id || ':' || window_id) AS h FROM wins),
        d AS (SELECT *, row_number() OVER (ORDER BY h) - 1 AS i FROM h ORDER BY h LIMIT 100)
        SELECT 'ann_' || lpad(i::VARCHAR, 3, '0') AS annotation_id, doc_id, window_id, sentence FROM d""",
    "x06_extract_triples": f"""WITH {P.windows(3, 3)}, {P.hits('wins', 'doc_id, window_id')},
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, window_id, {P.fold('location_1')},
          {P.fold('spatial_indicator')}, {P.fold('location_2')} ORDER BY ord) AS rn FROM trips)
        SELECT {_trip_cols}, coalesce({P.infer_type('spatial_indicator')}, '') AS semantic_type FROM r WHERE rn = 1""",
    "f03_validate_triples": f"""WITH {P.windows(3, 3)}, {P.hits('wins', 'doc_id, window_id, sentence')},
        v AS (SELECT *, {P.infer_type('spatial_indicator')} AS semantic_type, {P.fold('sentence')} AS ft,
          {P.fold('location_1')} AS fa, {P.fold('location_2')} AS fb,
          {P.fold('spatial_indicator')} AS fc FROM trips)
        SELECT {_trip_cols}, semantic_type FROM v WHERE semantic_type IS NOT NULL AND fa <> fb
          AND contains(ft, fa) AND contains(ft, fb) AND contains(ft, fc)
          AND NOT list_bool_or(list_transform([{', '.join(map(P.q, P.lx.METAPHORS))}],
            lambda m: contains(ft, m) AND contains(fc || ' ' || fb, m)))""",
    "m01_cue_mapping": f"""WITH c AS (SELECT l_orderkey, l_linenumber, (l_quantity / 2)::VARCHAR || ' ' ||
            {_pick(UNITS, 'l_partkey')} || ' ' || upper({_pick(PHRASES, 'l_suppkey')}) AS cue FROM lineitem),
        k AS (SELECT *, {P.strip('lower(cue)')} AS k FROM c),
        m AS (SELECT l_orderkey, l_linenumber, cue, {P.topology('k')} AS rcc8, {P.direction('k')} AS cdc,
          {P.distance_value('k')} AS distance_value, {P.distance_unit('k')} AS distance_unit,
          {P.infer_type(P.fold('cue'))} AS semantic_type FROM k)
        SELECT *, CASE WHEN cdc IS NULL THEN 'QSLINK' ELSE 'OLINK' END AS link,
          coalesce(nullif(concat_ws(' / ', rcc8, cdc, distance_value::VARCHAR || distance_unit), ''), cue) AS label FROM m""",
    "a05_graph_edges": f"""WITH {P.EDGES} SELECT *, CASE WHEN cdc IS NULL THEN 'QSLINK' ELSE 'OLINK' END AS link,
        coalesce({P.infer_type('indicator')}, '') AS semantic_type,
        coalesce(nullif(concat_ws(' / ', rcc8, cdc, distance_value::VARCHAR || distance_unit), ''), indicator) AS label FROM ed""",
    "a05_graph_nodes": f"WITH {P.EDGES} SELECT * FROM nd",
    "d06_top_connected": f"""WITH {P.EDGES} SELECT *, row_number() OVER (ORDER BY degree DESC, mention_count DESC, entity) AS rank
        FROM nd ORDER BY rank LIMIT 10""",
    "a02_rcc8_distribution": _dist("rcc8"),
    "a03_cdc_distribution": _dist("cdc"),
    "a04_kind_distribution": f"WITH {P.EDGES} SELECT entity_kind, count(*) AS n FROM nd GROUP BY 1",
    "a01_graph_summary": f"""WITH {P.EDGES}
        SELECT 'edges' AS section, '' AS key, count(*) AS n FROM ed
        UNION ALL SELECT 'nodes', '', count(*) FROM nd
        UNION ALL SELECT 'rcc8', coalesce(rcc8, '—'), count(*) FROM ed GROUP BY 2
        UNION ALL SELECT 'cdc', coalesce(cdc, '—'), count(*) FROM ed GROUP BY 2
        UNION ALL SELECT 'entity_kind', entity_kind, count(*) FROM nd GROUP BY 2""",
    "v07_two_hop_neighbours": f"""WITH {P.EDGES},
        roots AS (SELECT entity AS root FROM nd ORDER BY degree DESC, mention_count DESC, entity LIMIT 3),
        li AS (SELECT location_1 AS a, location_2 AS b FROM ed UNION SELECT location_2, location_1 FROM ed),
        h1 AS (SELECT DISTINCT root, b AS entity FROM roots JOIN li ON a = root),
        h2 AS (SELECT DISTINCT root, b AS entity FROM h1 JOIN li ON a = entity),
        u AS (SELECT root, root AS entity, 0 AS hop FROM roots UNION ALL SELECT root, entity, 1 FROM h1
              UNION ALL SELECT root, entity, 2 FROM h2)
        SELECT root, entity, min(hop)::BIGINT AS hop FROM u GROUP BY 1, 2""",
}
