"""SQL for the queries that SQL can express, as DuckDB runs it."""

from __future__ import annotations

from quillprint.llm.chat import END, MARKS_SAMPLE, TURN

# The control strings of chat.CONTROLS, for an engine without lookahead.
_CONTROLS = r"<⁠*(?:\|turn\|>|\|end\|>|/?s>|<SYS>>|</SYS>>)|\[⁠*/?INST\]".replace(r"⁠", "⁠")

# CRC-32 by its polynomial: a table of 256 steps, then a fold over the bytes of a text.
_CRC_TABLE = """steps AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(
    list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS crc_step)"""


def _crc32(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda o: ('0x' || o)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(crc_step[(xor(c, b) & 255) + 1], c >> 8)))"


def _framed(column: str, value: str | None = None) -> str:
    text = f"CAST({value or column} AS VARCHAR)"
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END"


def _leaf(text: str | None = None) -> str:
    return "sha256(" + " || ".join([*map(_framed, ("doc_id", "source", "lang", "n_chars")), _framed("text", text)]) + ")"


def _tree(name: str, group: str, levels: int) -> str:
    """CTEs ``<name>_beside<k>`` with the siblings on each level, and ``<name>_node<levels>`` with what remains.

    ``<name>_node0`` is ``(group, pos, n, node)``.
    """
    out = []
    for k in range(levels):
        over = f"OVER (PARTITION BY {group}, pos // 16 ORDER BY pos ROWS BETWEEN"
        out.append(f"""{name}_beside{k} AS (SELECT *,
            coalesce(string_agg(node, '') {over} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lefts,
            coalesce(string_agg(node, '') {over} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rights FROM {name}_node{k}),
        {name}_node{k + 1} AS (SELECT {group}, pos // 16 AS pos, CASE WHEN n = 1 THEN 1 ELSE (n + 15) // 16 END AS n,
            CASE WHEN n = 1 THEN node ELSE sha256(node || rights) END AS node FROM {name}_beside{k} WHERE pos % 16 = 0)""")
    return ", ".join(out)


def _walk(name: str, join: str, start: str, levels: int) -> str:
    """CTEs ``<name>_walk<k>``: ``start`` with ``proof`` and ``fold`` carried up the levels of ``_tree``."""
    out, source = [], start
    for k in range(levels):
        out.append(f"""{name}_walk{k} AS (SELECT w.* EXCLUDE (proof, fold, place), place // 16 AS place,
            CASE WHEN b.n > 1 THEN proof || lefts || rights ELSE proof END AS proof,
            CASE WHEN b.n > 1 THEN sha256(lefts || fold || rights) ELSE fold END AS fold
            FROM {source} w JOIN {name}_beside{k} b ON {join} AND b.pos = w.place)""")
        source = f"{name}_walk{k}"
    return ", ".join(out)


ORACLE = {
    "op1_chat_format": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '{MARKS_SAMPLE}'
            UNION ALL SELECT -1, 1, 'assistant', '{MARKS_SAMPLE}'
        ), said AS (
            SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss,
                string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS lines, count(*) AS n_turns,
                sum({len(TURN + END) + 2} + length(url_encode(role)) + length(text)
                    + len(regexp_extract_all(text, '{_CONTROLS}'))) AS formatted_chars
            FROM turns GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
            sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
        FROM said""",
    "op3_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), grams AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3
                THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words
        ), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        pairs AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
            FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM pairs JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
            WHERE 100 * shared >= 90 * (s.n + t.n - shared)
        ), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT a, b FROM ways UNION SELECT r.a, l.b FROM reach r JOIN ways l ON r.b = l.a)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles,
            least(d.doc_id, coalesce(lowest, d.doc_id)) AS component_id
        FROM documents d LEFT JOIN sizes USING (doc_id)
        LEFT JOIN (SELECT a AS doc_id, min(b) AS lowest FROM reach GROUP BY a) USING (doc_id)""",
    "op7_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0
        ), links AS (
            SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id != y.vec_id
            WHERE list_cosine_similarity(x.e, y.e) >= 0.9
        ), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        found AS (SELECT a AS vec_id, least(a, min(b)) AS lowest FROM reach GROUP BY a),
        counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(lowest, vec_id) AS component_id,
            vec_id = coalesce(lowest, vec_id) AS kept
        FROM embeddings LEFT JOIN found USING (vec_id) LEFT JOIN counts USING (vec_id)""",
    "op11_fill_in_middle": r"""
        WITH hashed AS (
            SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h,
                regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units FROM documents
        ), drawn AS (
            SELECT doc_id, t, units, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS x,
                ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS y, ('0x' || h[25:32])::BIGINT % 100 < 50 AS suffix_first FROM hashed
        ), parts AS (
            SELECT *, array_to_string(units[1:least(x, y)], '') AS pre,
                array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS mid,
                array_to_string(units[greatest(x, y) + 1:n], '') AS suf,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                    WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form FROM drawn
        )
        SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(pre) END AS prefix_chars,
            CASE WHEN form != 'plain' THEN length(mid) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
        FROM parts""",
    "op12_sharding": f"""
        WITH {_CRC_TABLE}, rows AS (
            SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, {_crc32("coalesce(text, '')")} AS text_crc32 FROM documents, steps
        ), placed AS (
            SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                AS before, sum(size) OVER () AS whole, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) AS place FROM rows
        ), cut AS (SELECT *, CAST((2 * before + size) * 40 // (2 * whole) AS INT) AS shard FROM placed)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, place - min(place) OVER (PARTITION BY shard) AS slot,
            CAST(NULL AS INT) AS grown_shard FROM cut""",
    "op13_merkle_manifest": f"""
        WITH {_CRC_TABLE}, leaves AS (
            SELECT doc_id, source, {_leaf()} AS leaf, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN
                {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS shown FROM documents, steps
        ), docs_placed AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                count(*) OVER (PARTITION BY source) AS n FROM leaves
        ), doc_node0 AS (SELECT source, pos, n, leaf AS node FROM docs_placed), {_tree("doc", "source", 6)},
        src_placed AS (
            SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM doc_node6
        ), src_node0 AS (SELECT 0 AS one, pos, n, subroot AS node FROM src_placed), {_tree("src", "one", 4)},
        doc_start AS (SELECT doc_id, source, leaf, pos AS place, '' AS proof, coalesce(shown, leaf) AS fold FROM docs_placed),
        {_walk("doc", "b.source IS NOT DISTINCT FROM w.source", "doc_start", 6)},
        src_start AS (
            SELECT w.* EXCLUDE (place), p.subroot, p.pos AS place FROM doc_walk5 w JOIN src_placed p ON p.source IS NOT DISTINCT FROM w.source
        ), {_walk("src", "b.one = 0", "src_start", 4)}
        SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = node AS verified
        FROM src_walk3, src_node4""",
}
