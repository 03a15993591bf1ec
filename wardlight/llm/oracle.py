"""SQL twins of the operators' queries, where SQL can express them."""

from __future__ import annotations

OP1_QUALITY_RULES = r"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), lines AS (
    SELECT doc_id, count(*) AS n_lines, count(DISTINCT line) AS n_distinct
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), windows AS (
    SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM t WHERE len(ws) > 8)
), repeated AS (
    SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1
), reach AS (
    SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM repeated
), rep AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM reach GROUP BY doc_id),
c AS (
    SELECT t.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
           length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           length(text) - length(regexp_replace(text, '!', '', 'g')) AS n_bang,
           length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS n_capitals,
           coalesce(n_lines, 0) AS n_lines, coalesce(n_lines - n_distinct, 0) AS n_dup_lines,
           coalesce(rep.n, 0) AS n_repeat_words
    FROM t LEFT JOIN lines ON lines.doc_id = t.doc_id LEFT JOIN rep ON rep.doc_id = t.doc_id
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 10 * n_dup_lines > 3 * n_lines OR 5 * n_bang > n_words OR 10 * n_capitals > 3 * word_chars) AS kept
FROM b
"""

OP3_SUFFIX_DEDUP = r"""
WITH t AS (
    SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS x FROM documents
), win AS (
    SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 200)) AS k
    FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS i FROM t WHERE n >= 100)
), hit AS (
    SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1
), flagged AS (
    SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 100 THEN 0 ELSE 1 END AS fresh
    FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
    SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM flagged
), span AS (SELECT doc_id, span, min(i) AS s, max(i) + 100 AS e FROM numbered GROUP BY doc_id, span),
cuts AS (
    SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS b FROM span
    UNION ALL SELECT t.doc_id, coalesce(m.e, 0), t.n FROM t LEFT JOIN
        (SELECT doc_id, max(e) AS e FROM span GROUP BY doc_id) m ON m.doc_id = t.doc_id
), kept AS (
    SELECT cuts.doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS x, sum(b - a) AS n
    FROM cuts JOIN t ON t.doc_id = cuts.doc_id GROUP BY cuts.doc_id
), spans AS (SELECT doc_id, count(*) AS c FROM span GROUP BY doc_id)
SELECT t.doc_id, t.n AS n_bytes, CAST(t.n - kept.n AS BIGINT) AS n_removed,
       coalesce(spans.c, 0) AS n_spans, sha256(unhex(kept.x)) AS kept_sha256
FROM t JOIN kept ON kept.doc_id = t.doc_id LEFT JOIN spans ON spans.doc_id = t.doc_id
"""

OP4_WARC = """
WITH p AS (
    SELECT page_id, sha256(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages
), f AS (SELECT d, min(page_id) AS first_page FROM p GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_page THEN first_page END AS refers_to
FROM p JOIN f ON p.d = f.d
"""

OP5_CHAT = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
    SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS escaped,
           replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS escaped_role FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(escaped) + length(escaped_role) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


OP7_MINHASH = r"""
WITH RECURSIVE t AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM t WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
classes AS (
    SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS rep
    FROM (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id)
), r AS (SELECT s.doc_id, g, n FROM s JOIN n USING (doc_id) JOIN classes USING (doc_id) WHERE rep = doc_id),
common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS xn, any_value(b.n) AS yn
    FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id
        AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2
), e AS (
    SELECT x, y FROM common WHERE 100 * c >= 85 * (xn + yn - c)
), both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (
    SELECT x AS node, x AS seen FROM both_ways
    UNION SELECT reach.node, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.seen
), comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles,
       coalesce(comp.component, classes.rep, d.doc_id) AS component_id,
       d.doc_id = coalesce(comp.component, classes.rep, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN classes ON classes.doc_id = d.doc_id
LEFT JOIN comp ON comp.node = classes.rep
"""


OP8_RECOMPRESSION = r"""
WITH t AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
    SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM t WHERE len(ws) >= 13)
), repeated AS (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY k) < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM repeated),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM t),
kept AS (
    SELECT word.doc_id, string_agg(w, ' ' ORDER BY i) AS left_text, count(*) AS n
    FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY word.doc_id
)
SELECT t.doc_id, len(ws) AS n_words, len(ws) - coalesce(kept.n, 0) AS n_removed,
       sha256(coalesce(left_text, '')) AS kept_sha256
FROM t LEFT JOIN kept ON kept.doc_id = t.doc_id
"""


OP12_INFILLING = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
           sha256('42:' || CAST(doc_id AS VARCHAR)) AS x
    FROM documents
), h AS (
    SELECT *, len(units) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
           CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d
), c AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                     OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
    SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
           array_to_string(units[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def _merkle_sql(source_levels: int = 6, top_levels: int = 4) -> str:
    """Both trees level by level; a level has rows only where the one below has several nodes."""

    def written(column: str) -> str:
        return f"coalesce(CAST(strlen(CAST({column} AS VARCHAR)) AS VARCHAR) || ':' || {column}, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(map(written, ('doc_id', 'source', 'lang', 'n_chars', text)))})"

    def tree(name: str, levels: int) -> list[str]:
        parts = []
        for k in range(levels):
            # Every node of a level that goes on, with what its run has before and after it.
            parts.append(
                f"{name}{k}s AS (SELECT *, i // 16 AS run, count(*) OVER (PARTITION BY g) AS size,"
                f" coalesce(string_agg(d, '') OVER (PARTITION BY g, i // 16 ORDER BY i"
                f" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,"
                f" coalesce(string_agg(d, '') OVER (PARTITION BY g, i // 16 ORDER BY i"
                f" ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name}{k})"
            )
            parts.append(
                f"{name}{k + 1} AS (SELECT g, run AS i, sha256(string_agg(d, '' ORDER BY i)) AS d"
                f" FROM {name}{k}s WHERE size > 1 GROUP BY g, run)"
            )
        ends = " UNION ALL ".join(f"SELECT g, d FROM {name}{k}s WHERE size = 1" for k in range(levels))
        return [*parts, f"{name}_end AS ({ends})"]

    def climb(name: str, levels: int) -> list[str]:
        return [
            f"{name}{k}s x{name}{k} ON x{name}{k}.g = {'n.g' if name == 's' else '0'} AND x{name}{k}.size > 1"
            f" AND x{name}{k}.i = {'n.i' if name == 's' else 'n.g'} // {16**k}"
            for k in range(levels)
        ]

    steps = [f"x{name}{k}" for name, levels in (("s", source_levels), ("t", top_levels)) for k in range(levels)]
    proof = " || ".join(f"coalesce({x}.before || {x}.after, '')" for x in steps)
    folds, at = [], "f0"
    for number, x in enumerate(steps):
        folds.append(
            f"f{number + 1} AS (SELECT * EXCLUDE (v), CASE WHEN {x}_b IS NULL THEN v"
            f" ELSE sha256({x}_b || v || {x}_a) END AS v FROM {at})"
        )
        at = f"f{number + 1}"
    sides = ", ".join(f"{x}.before AS {x}_b, {x}.after AS {x}_a" for x in steps)
    joins = " ".join(f"LEFT JOIN {j}" for j in [*climb("s", source_levels), *climb("t", top_levels)])
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH {_CRC32}, l AS (
    SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, {leaf("text")} AS d,
           CASE WHEN crc.value % 5 = 0 THEN {leaf(lowered)} ELSE {leaf("text")} END AS changed
    FROM documents LEFT JOIN crc ON crc.id = doc_id
), n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS i FROM l),
s0 AS (SELECT g, i, d FROM n), {", ".join(tree("s", source_levels))},
t0 AS (SELECT 0 AS g, g AS i, d FROM s_end), {", ".join(tree("t", top_levels))},
f0 AS (
    SELECT n.doc_id, n.d AS leaf, s_end.d AS subroot, t_end.d AS root, sha256({proof}) AS proof_sha256,
           n.changed AS v, {sides}
    FROM n JOIN s_end ON s_end.g = n.g JOIN t_end ON t_end.g = 0 {joins}
), {", ".join(folds)}
SELECT doc_id, leaf, subroot, root, proof_sha256, v AS folded_root, v = root AS verified FROM {at}
"""


#: `crc` (id, value): the CRC-32 of every document's id in decimal, by the table of its 256 bytes.
_CRC32 = """bytes AS (
    SELECT list(list_reduce(list_concat([i], range(8)),
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM range(256) r(i)
), crc AS (
    SELECT doc_id AS id, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(s) + 1),
           lambda i: CAST(ascii(s[i]) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS value
    FROM (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents), bytes
)"""

def llm_oracle():
    return {
        "op1_quality_rules": OP1_QUALITY_RULES,
        "op3_suffix_dedup": OP3_SUFFIX_DEDUP,
        "op4_warc": OP4_WARC,
        "op5_chat": OP5_CHAT,
        "op7_minhash": OP7_MINHASH,
        "op8_recompression": OP8_RECOMPRESSION,
        "op12_infilling": OP12_INFILLING,
        "op13_merkle": _merkle_sql(),
    }
