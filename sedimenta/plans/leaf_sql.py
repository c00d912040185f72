"""The leaves of documents in SQL: the same packing as a recursive query, written from the rules and not from the fold."""

from __future__ import annotations

from ..functions import text as T
from . import sqltext as S
from .queries import _RANKED, SQL

_TOKENS = f"regexp_extract_all(text, {S.quoted(T.NOT_SPACE + '+')})"
_GAPS = f"regexp_extract_all(text, {S.quoted(T.SPACE + '+')})"


def _leaf(kind: str, section: str, ids: str, n: str, text: str, a: str = "NULL::INTEGER", b: str = "NULL::INTEGER") -> str:
    return f"struct_pack(kind := {kind}, section := {section}, ids := {ids}, n := {n}, text := {text}, a := {a}, b := {b})"


_STRUCT = 'STRUCT(kind VARCHAR, section VARCHAR, ids VARCHAR[], n BIGINT, "text" VARCHAR, a INTEGER, b INTEGER)'
_PACK = 'STRUCT(id VARCHAR, n BIGINT, "text" VARCHAR)[]'
_LEAVES = f"""r0 AS ({_RANKED}), nest AS (SELECT DISTINCT doc_id, parent_block_id AS block_id, CASE WHEN type = 'table_row' THEN 'table' ELSE 'table_cell' END AS type FROM r0 WHERE type IN ('table_row', 'table_cell') AND parent_block_id <> ''),
    r1 AS (SELECT r0.doc_id, r0.block_id, r0.type, r0.text, array_to_string(section_path, ' / ') AS section, rank FROM r0 LEFT JOIN nest n ON n.doc_id = r0.doc_id AND n.block_id = r0.block_id AND n.type = r0.type AND (r0.type = 'table' OR r0.parent_block_id <> '') WHERE n.doc_id IS NULL),
    big AS (SELECT doc_id, block_id, text, tok, len(tok) AS n, list_transform(range(1, len(tok) + 1), lambda i: off + coalesce(list_sum(list_transform(tok[1:i - 1], lambda w: length(w))), 0)::INTEGER + coalesce(list_sum(list_transform(gap[1:i - 1], lambda w: length(w))), 0)::INTEGER) AS pos
    FROM (SELECT doc_id, block_id, text, tok, CASE WHEN off > 0 THEN gap[2:] ELSE gap END AS gap, off FROM (SELECT doc_id, block_id, text, {_TOKENS} AS tok, {_GAPS} AS gap, length(regexp_extract(text, {S.quoted('^' + T.SPACE + '+')})) AS off FROM r1 WHERE type = 'paragraph' AND len({_TOKENS}) > 512))),
    ends AS (SELECT doc_id, block_id, e, row_number() OVER (PARTITION BY doc_id, block_id ORDER BY e) AS k FROM (SELECT doc_id, block_id, unnest(list_filter(range(1, n + 1), lambda i: i = n OR right(tok[i], 1) IN ('.', '!', '?'))) AS e FROM big)),
    sp AS (SELECT doc_id, block_id, 0::BIGINT AS k, 0::BIGINT AS start, 0::BIGINT AS begins, []::BIGINT[] AS cuts FROM big UNION ALL SELECT doc_id, block_id, k, CASE WHEN e - s1 > 512 THEN s1 + 512 * ((e - s1 - 1) // 512) ELSE s1 END, e, list_concat(cuts, CASE WHEN s1 > start THEN [s1] ELSE [] END, list_transform(range(1, (e - s1 - 1) // 512 + 1), lambda j: s1 + 512 * j))
    FROM (SELECT x.doc_id, x.block_id, x.k, x.e, sp.start, sp.cuts, CASE WHEN x.e - sp.start > 512 AND sp.begins > sp.start THEN sp.begins ELSE sp.start END AS s1 FROM sp JOIN ends x ON x.doc_id = sp.doc_id AND x.block_id = sp.block_id AND x.k = sp.k + 1)),
    cut AS (SELECT doc_id, block_id, list_concat([0], arg_max(cuts, k)) AS cuts FROM sp GROUP BY 1, 2), part AS (SELECT big.doc_id, big.block_id, list_transform(list_zip(cuts, list_append(cuts[2:], n)), lambda c: struct_pack(a := pos[c[1] + 1], b := pos[c[2]] + length(tok[c[2]]), n := c[2] - c[1])) AS parts FROM big JOIN cut USING (doc_id, block_id)),
    r2 AS (SELECT r1.doc_id, r1.block_id, r1.type, r1.text, r1.section, row_number() OVER (PARTITION BY r1.doc_id ORDER BY rank) AS k, {S.trimmed("coalesce(r1.text, '')")} <> '' AS filled, coalesce({S.n_tokens('r1.text')}, 0) AS n, parts FROM r1 LEFT JOIN part USING (doc_id, block_id)),
    rows_in AS (SELECT doc_id, block_id, type, text, section, k, filled, n, CASE WHEN type = 'paragraph' AND filled AND n > 512 THEN list_transform(parts, lambda p: {_leaf("'part'", 'section', '[block_id]', 'p.n', 'substr(text, p.a + 1, p.b - p.a)', 'p.a', 'p.b')}) WHEN filled AND type IN ('table', 'table_row', 'table_cell', 'figure', 'caption', 'code', 'formula', 'list', 'speech_turn', 'slide') THEN [{_leaf('type', 'section', '[block_id]', 'n', 'text')}] ELSE [] END AS fresh FROM r2
    UNION ALL SELECT doc_id, NULL, 'heading', NULL, NULL, max(k) + 1, false, 0, [] FROM r2 GROUP BY 1),
    st AS (SELECT doc_id, 0::BIGINT AS k, []::{_PACK} AS pack, NULL::VARCHAR AS psec, NULL::{_STRUCT} AS last, []::{_STRUCT}[] AS done FROM r2 GROUP BY 1
    UNION ALL SELECT doc_id, k, CASE WHEN adds THEN list_append(pack1, struct_pack(id := block_id, n := n, "text" := text)) ELSE pack1 END, CASE WHEN adds AND len(pack1) = 0 THEN section ELSE psec END, CASE WHEN len(fresh) > 0 THEN fresh[-1] ELSE last1 END, list_concat(out1, CASE WHEN len(fresh) > 0 THEN list_concat(CASE WHEN last1 IS NULL THEN [] ELSE [last1] END, fresh[1:len(fresh) - 1]) ELSE [] END)
    FROM (SELECT *, CASE WHEN flush AND NOT merges AND last IS NOT NULL THEN [last] ELSE [] END AS out1, CASE WHEN flush THEN [] ELSE pack END AS pack1, CASE WHEN NOT flush THEN last WHEN merges THEN {_leaf("last.kind", 'last.section', 'list_concat(last.ids, list_transform(pack, lambda p: p.id))', 'last.n + pn', "last.text || chr(10) || chr(10) || ptext")} ELSE {_leaf("'prose'", 'psec', 'list_transform(pack, lambda p: p.id)', 'pn', 'ptext')} END AS last1
    FROM (SELECT *, flush AND pn < 100 AND coalesce(last.kind = 'prose' AND last.section = psec AND last.n + pn <= 512, false) AS merges FROM (SELECT x.*, st.pack, st.psec, st.last, coalesce(list_sum(list_transform(st.pack, lambda p: p.n)), 0)::BIGINT AS pn, array_to_string(list_transform(st.pack, lambda p: p."text"), chr(10) || chr(10)) AS ptext, x.type = 'paragraph' AND x.filled AND x.n <= 512 AS adds,
    len(st.pack) > 0 AND (x.type = 'heading' OR x.type IN ('table', 'table_row', 'table_cell', 'figure', 'caption', 'code', 'formula', 'list', 'speech_turn', 'slide') OR (x.type = 'paragraph' AND x.filled AND (x.n > 512 OR st.psec <> x.section OR coalesce(list_sum(list_transform(st.pack, lambda p: p.n)), 0) + x.n > 256))) AS flush
    FROM st JOIN rows_in x ON x.doc_id = st.doc_id AND x.k = st.k + 1)))),
    made AS (SELECT doc_id, k, 0 AS z, unnest(done) AS l, generate_subscripts(done, 1) AS p FROM st UNION ALL SELECT doc_id, k + 1, 1, last, 1 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) AS e FROM st) WHERE e = 1 AND last IS NOT NULL),
    leaves AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, z, p) - 1)::INTEGER AS leaf, l.kind AS kind, l.section AS section, l.ids AS block_ids, l.n::INTEGER AS n_tokens, l."text" AS text, l.a AS span_start, l.b AS span_end FROM made)"""


_ID = "'chk_' || left(sha256(concat_ws(chr(31), {parts})), 24)"
_OF_LEAF = _ID.format(parts="doc_id, 'leaf', array_to_string(block_ids, ','), coalesce(span_start::VARCHAR, ''), text, section")
_OF_SECTION, _OF_DOCUMENT = _ID.format(parts="doc_id, 'section', section"), _ID.format(parts="doc_id, 'document'")

SQL["leaf_chunks"] = f"WITH RECURSIVE {_LEAVES} SELECT doc_id, leaf, kind, section, block_ids, n_tokens, text, coalesce(span_start, -1) AS span_start, coalesce(span_end, -1) AS span_end FROM leaves"
SQL["chunk_tree"] = f"""WITH RECURSIVE {_LEAVES}, low AS (SELECT doc_id, 'leaf' AS level, {_OF_LEAF} AS chunk_id, CASE WHEN section <> '' THEN {_OF_SECTION} ELSE {_OF_DOCUMENT} END AS parent_id, 0::BIGINT AS n_children, n_tokens::BIGINT AS n_tokens, section FROM leaves),
    mid AS (SELECT doc_id, 'section' AS level, parent_id AS chunk_id, {_OF_DOCUMENT} AS parent_id, count(*)::BIGINT AS n_children, sum(n_tokens)::BIGINT AS n_tokens FROM low WHERE section <> '' GROUP BY doc_id, low.parent_id),
    inner_levels AS (SELECT doc_id, level, chunk_id, parent_id, n_children, n_tokens FROM low UNION ALL SELECT * FROM mid)
    SELECT * FROM inner_levels UNION ALL SELECT doc_id, 'document', {_OF_DOCUMENT}, NULL, sum(CASE WHEN parent_id = {_OF_DOCUMENT} THEN 1 ELSE 0 END)::BIGINT, sum(CASE WHEN level = 'leaf' THEN n_tokens ELSE 0 END)::BIGINT FROM inner_levels GROUP BY doc_id"""
