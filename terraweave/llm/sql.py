"""SQL of those queries that SQL can express over whole tables."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"

_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
              lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
                lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_field(v) for v in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


SQL = {
    "op1_quality_rules": rf"""WITH w AS (
        SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS ws FROM documents),
      l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
      d AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l
            WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
      p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8),
      c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 7], ' ')) AS n FROM p),
      x AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM c WHERE n > 1),
      r AS (SELECT doc_id, sum(least(8, coalesce(j - i, 8)))::BIGINT AS n FROM x GROUP BY doc_id),
      m AS (SELECT w.doc_id, t, ws, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
              length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
              coalesce(n_lines, 0) AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
            FROM w LEFT JOIN d ON w.doc_id = d.doc_id LEFT JOIN r ON w.doc_id = r.doc_id),
      f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
              10 * n_symbols > n_words OR length(t) < 3 * n_words OR length(t) > 16 * n_words
              OR 10 * len(list_filter(ws, lambda w: NOT regexp_matches(w, '\p{{L}}'))) > 3 * n_words
              OR 10 * n_dup_lines > 3 * n_lines OR 2 * length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) > length(t) AS bad FROM m)
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
      FROM f""",
    "op4_line_dedup": f"""WITH s AS (SELECT doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
      l AS (SELECT doc_id, source, text, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM s),
      b AS (SELECT *, trim(line, {_BLANKS}) AS bare FROM l),
      n AS (SELECT source, count(DISTINCT text) + max((text IS NULL)::INTEGER) AS total FROM documents GROUP BY 1),
      k AS (SELECT b.source, bare FROM b JOIN n ON b.source IS NOT DISTINCT FROM n.source WHERE bare <> ''
            GROUP BY b.source, bare HAVING count(DISTINCT text) >= 5 AND count(DISTINCT text) > 0.1 * any_value(total)),
      g AS (SELECT b.*, k.bare IS NOT NULL AS gone FROM b LEFT JOIN k ON b.source IS NOT DISTINCT FROM k.source AND b.bare = k.bare),
      o AS (SELECT doc_id, source, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
              coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS t FROM g GROUP BY doc_id, source)
      SELECT doc_id, source, n_dropped, length(t)::BIGINT AS n_chars, md5(t) AS text_md5 FROM o""",
    "op5_ngram_join": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
          translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}+') AS ws FROM documents),
      s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (
              SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
      n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
      j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
      e AS (SELECT j.a, j.b FROM j JOIN n x ON x.doc_id = j.a JOIN n y ON y.doc_id = j.b
            WHERE 100 * j.c >= 80 * (x.c + y.c - j.c)),
      r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
      SELECT r.a AS doc_id, coalesce(any_value(n.c), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
      FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a""",
    "op6_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
      d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
      f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
      SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f""",
    "op11_merkle_manifest": f"""WITH RECURSIVE l AS (
        SELECT doc_id, lang, {_leaf('n_chars')} AS leaf,
          CASE WHEN {_CRC32} % 7 = 0 THEN {_leaf('n_chars + 1')} ELSE {_leaf('n_chars')} END AS claimed FROM documents),
      p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
              count(*) OVER (PARTITION BY lang) AS n FROM l),
      t AS (SELECT lang, 0 AS lvl, i, leaf AS h, n FROM p UNION ALL
            SELECT lang, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM t WHERE n > 1
            GROUP BY lang, lvl, i // 2),
      r AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
      u AS (SELECT 0 AS lvl, i, subroot AS h, n FROM r UNION ALL
            SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, i // 2),
      f AS (SELECT doc_id, lang, leaf, 0 AS lvl, i, n, claimed AS h, '' AS proof FROM p UNION ALL
            SELECT f.doc_id, f.lang, f.leaf, f.lvl + 1, f.i // 2, (f.n + 1) // 2,
              sha256(CASE WHEN f.i % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END), f.proof || coalesce(s.h, '')
            FROM f LEFT JOIN t s ON s.lang IS NOT DISTINCT FROM f.lang AND s.lvl = f.lvl AND s.i = xor(f.i, 1) WHERE f.n > 1),
      g AS (SELECT f.doc_id, f.leaf, r.subroot, 0 AS lvl, r.i, r.n, f.h, f.proof
            FROM f JOIN r ON f.lang IS NOT DISTINCT FROM r.lang WHERE f.n = 1 UNION ALL
            SELECT g.doc_id, g.leaf, g.subroot, g.lvl + 1, g.i // 2, (g.n + 1) // 2,
              sha256(CASE WHEN g.i % 2 = 1 THEN s.h || g.h ELSE g.h || coalesce(s.h, '') END), g.proof || coalesce(s.h, '')
            FROM g LEFT JOIN u s ON s.lvl = g.lvl AND s.i = xor(g.i, 1) WHERE g.n > 1)
      SELECT doc_id, leaf, subroot, o.h AS root, sha256(proof) AS proof_sha256, g.h AS folded_root, g.h = o.h AS verified
      FROM g, (SELECT h FROM u WHERE n = 1) o WHERE g.n = 1""",
    "op12_hard_negatives": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v,
          CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
            FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id IS DISTINCT FROM b.vec_id),
      p AS (SELECT anchor_id, id, score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id NULLS LAST) <= 5)
      SELECT p.anchor_id, p.id AS positive_id,
        row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id NULLS LAST)::INTEGER AS rank,
        s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score
      QUALIFY rank <= 10""",
    "op13_chat_format": r"""WITH c AS (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i)),
      t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
              replace(replace(replace(coalesce(role, ''), '\', '\\'), '<', '\l'), '>', '\g') AS role_out,
              replace(replace(replace(coalesce(text, ''), '\', '\\'), '<turn', '\lturn'), '</turn', '\l/turn') AS text_out FROM c)
      SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
        sum(length('<turn >' || role_out || chr(10) || text_out || chr(10) || '</turn>' || chr(10)))::BIGINT AS formatted_chars
      FROM t GROUP BY conv_id""",
}
