"""Building blocks of the comparison SQL (DuckDB dialect)."""

from __future__ import annotations

from ..functions import lexicon as lx
from ..functions.text import SPACE, SPACES, SURFACE_FORMS
from ..operators.extract import cue_pattern
from ..operators.graph import DEICTIC, DETERMINER


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {q(SPACES)})"


def fold(x: str) -> str:
    return strip(f"regexp_replace(lower({x}), '{SPACE}+', ' ', 'g')")


def tidy(x: str, ellipsis: bool = True) -> str:
    out = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    out = rf"regexp_replace({out}, '[\x{{0}}-\x{{8}}\x{{B}}\x{{C}}\x{{E}}-\x{{1F}}\x{{7F}}]', '', 'g')"
    out = rf"regexp_replace({out}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    out = f"translate({out}, '’‘“”–', '''''\"\"-')"
    out = f"replace({out}, '—', '--')"
    return f"replace({out}, '…', '...')" if ellipsis else out


def strip_licence(x: str) -> str:
    head = r"(?is)^.*?\*{3}\s*START OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*?\*{3}"
    foot = r"(?is)\*{3}\s*END OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*"
    return strip(f"regexp_replace(regexp_replace({x}, '{head}', ''), '{foot}', '')")


def sentence_list(x: str, min_chars: int = 10) -> str:
    marked = rf"regexp_replace({x}, '([.!?]){SPACE}+', '\1' || chr(1), 'g')"
    return (f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')}), "
            f"lambda s: length(s) >= {min_chars})")


# sents(doc_id, sent_idx, text): cleaned, segmented, runs of equal sentences dropped
SENTS = f"""
docs AS (SELECT doc_id, {tidy(strip_licence('text'))} AS t FROM documents),
lists AS (SELECT doc_id, {sentence_list('t')} AS l FROM docs),
listed AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS i FROM lists),
lagged AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM listed),
sents AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS sent_idx, text
          FROM lagged WHERE prev IS NULL OR prev <> text)"""


def windows(size: int, stride: int, name: str = "wins") -> str:
    """Full windows over the sentences of 20 characters or more."""
    return f"""{SENTS},
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx) - 1 AS pos,
                count(*) OVER (PARTITION BY doc_id) AS n FROM sents WHERE length(text) >= 20),
starts AS (SELECT doc_id, unnest(range(0, max(n) - {size} + 1, {stride})) AS s FROM kept GROUP BY doc_id),
{name} AS (SELECT k.doc_id, s.s // {stride} AS window_id,
         string_agg(k.doc_id || '_sent_' || k.sent_idx, ',' ORDER BY pos) AS sentence_ids,
         arg_min(k.doc_id || '_sent_' || k.sent_idx, pos) AS sentence_id,
         {strip(f"string_agg({strip('replace(k.text, chr(10), chr(32))')}, ' ' ORDER BY pos)")} AS sentence
  FROM kept k JOIN starts s ON k.doc_id = s.doc_id AND k.pos >= s.s AND k.pos < s.s + {size}
  GROUP BY k.doc_id, s.s)"""


def chunks(size: int = 6, overlap: int = 2) -> str:
    stride = max(1, size - overlap)
    return f"""{SENTS},
sized AS (SELECT doc_id, count(*) AS n FROM sents GROUP BY doc_id),
starts AS (SELECT doc_id, unnest(range(0, n, {stride})) AS s FROM sized),
chunks AS (SELECT k.doc_id, s.s // {stride} AS chunk,
         k.doc_id || '_chunk_' || lpad((s.s // {stride})::VARCHAR, greatest(4, length((s.s // {stride})::VARCHAR))::INT, '0') AS chunk_id,
         string_agg(k.doc_id || '_sent_' || k.sent_idx, ',' ORDER BY sent_idx) AS sentence_ids,
         string_agg(k.text, ' ' ORDER BY sent_idx) AS sentence
  FROM sents k JOIN starts s ON k.doc_id = s.doc_id AND k.sent_idx >= s.s AND k.sent_idx < s.s + {size}
  GROUP BY k.doc_id, s.s)"""


def hits(source: str, keys: str, name: str = "trips", bare: bool = False) -> str:
    """(keys, ord, location_1, spatial_indicator, location_2) found in source.sentence."""
    p = q(r"(?i)(?:^|[^\p{L}])" + cue_pattern(bare).removeprefix("(?i)"))
    return f"""{name}_m AS (SELECT {keys}, unnest(m) AS m, generate_subscripts(m, 1) - 1 AS ord
  FROM (SELECT {keys}, regexp_extract_all(sentence, {p}, 0) AS m FROM {source})),
{name} AS (SELECT {keys}, ord::BIGINT AS ord, regexp_extract(m, {p}, 1) AS location_1,
  lower(regexp_extract(m, {p}, 2)) AS spatial_indicator, regexp_extract(m, {p}, 3) AS location_2 FROM {name}_m)"""


def case(x: str, table: dict) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + " END"


def infer_type(x: str) -> str:
    near = " ".join(
        f"WHEN contains({x}, {q(p)}) OR contains({q(p)}, {x}) THEN {q(lx.CUE_TYPES[p])}"
        for p in sorted(lx.CUE_TYPES, key=len, reverse=True))
    return f"coalesce({case(x, lx.CUE_TYPES)}, CASE {near} END)"


def topology(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {q(p)}) THEN {q(v)}" for p, v in lx.TOPOLOGY) + " END"


def direction(x: str) -> str:
    arms = []
    for p, v in lx.DIRECTION:
        if v in "NS":
            word = f"regexp_extract({x}, {q(p)}, 0)"
            arms.append(f"WHEN regexp_matches({x}, {q(p)}) THEN CASE WHEN contains({word}, 'east') THEN '{v}E' "
                        f"WHEN contains({word}, 'west') THEN '{v}W' ELSE '{v}' END")
        else:
            arms.append(f"WHEN regexp_matches({x}, {q(p)}) THEN '{v}'")
    return "CASE " + " ".join(arms) + " END"


def distance_value(x: str) -> str:
    return f"nullif(regexp_extract({x}, {q(lx.DISTANCE)}, 1), '')::DOUBLE"


def distance_unit(x: str) -> str:
    return f"nullif(regexp_extract({x}, {q(lx.DISTANCE)}, 2), '')"


def entity_kind(x: str) -> str:
    bare = strip(x)
    key = f"lower(regexp_replace({bare}, {q(DETERMINER)}, ''))"
    words = ", ".join(map(q, DEICTIC))
    return (f"CASE WHEN {key} = '' THEN 'common_locus' WHEN {key} IN ({words}) THEN 'deictic' "
            rf"WHEN regexp_matches({bare}, '^\p{{Lu}}') AND NOT contains({bare}, ' ') THEN 'person_locus' "
            "ELSE 'common_locus' END")


def surface_lookup(x: str) -> str:
    return f"coalesce({case(x, SURFACE_FORMS)}, {x})"


def canonical(x: str) -> str:
    name = surface_lookup(strip(x))
    return (f"(SELECT CASE WHEN nm = lower(nm) AND length(nm) > 2 THEN array_to_string(list_transform(range(1, length(nm) + 1), "
            rf"lambda i: CASE WHEN i > 1 AND regexp_matches(substr(nm, i - 1, 1), '^\p{{L}}$') THEN substr(nm, i, 1) "
            f"WHEN substr(nm, i, 1) = 'ß' THEN 'Ss' ELSE upper(substr(nm, i, 1)) END), '') ELSE nm END FROM (SELECT {name} AS nm))")


EDGES = f"""{windows(3, 3)},
{hits('wins', 'doc_id, window_id, sentence_id, sentence')},
ed AS (SELECT doc_id, window_id, ord, sentence_id, location_1, location_2, spatial_indicator AS indicator,
  {topology('spatial_indicator')} AS rcc8, {direction('spatial_indicator')} AS cdc,
  {distance_value('spatial_indicator')} AS distance_value, {distance_unit('spatial_indicator')} AS distance_unit
  FROM trips),
ends AS (SELECT location_1 AS entity, 0 AS i, 1 AS o FROM ed UNION ALL SELECT location_2, 1, 0 FROM ed),
nd AS (SELECT entity, count(*) AS degree, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree,
  count(*) AS mention_count, {entity_kind('entity')} AS entity_kind FROM ends GROUP BY entity)"""
