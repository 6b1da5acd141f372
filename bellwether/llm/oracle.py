"""DuckDB SQL of the queries that SQL can express."""

WORDS = r"""[x FOR x IN string_split_regex({text}, '[\x20\x09-\x0D]+') IF x <> '']"""
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LINE = (
    "trim(regexp_replace(regexp_replace(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))"
)

ORACLE = {
    "op1_minhash_near_dedup": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, {WORDS.format(text=LOWER)} AS ws FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
                WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                ELSE list_distinct([concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2])
                    FOR i IN range(1, len(ws) - 1)]) END AS sh FROM w
        ), n AS (SELECT doc_id, len(sh) AS n FROM s),
        f AS (SELECT doc_id, unnest(sh) AS g FROM s),
        common AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
            FROM f x JOIN f y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
            WHERE 100 * c >= 85 * (p.n + q.n - c)
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM n
            UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
        ), least_id AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM n JOIN least_id USING (doc_id)
    """,
    "op10_exact_top_k": """
        WITH v AS (
            SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op3_quality_rules": f"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
                {WORDS.format(text="coalesce(text, '')")} AS ws,
                string_split(coalesce(text, ''), chr(10)) AS ls
            FROM documents
        ), win AS (
            SELECT r, i, concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2]) AS g
            FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) > 2)
        ), twice AS (
            SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1
        ), rep AS (
            SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r
        ), line AS (
            SELECT r, source, l, len({WORDS.format(text="l")}) AS n,
                {LINE.format(text="l")} AS key
            FROM (SELECT r, source, unnest(ls) AS l FROM d)
        ), own AS (SELECT * FROM line WHERE n > 0),
        dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM own GROUP BY r),
        per_doc AS (SELECT r, source, key, sum(n) AS n FROM own GROUP BY r, source, key),
        content AS (
            SELECT d.source, d.r, string_agg(key, chr(10) ORDER BY key) AS c
            FROM d LEFT JOIN own USING (r) GROUP BY d.source, d.r
        ), one AS (SELECT source, min(r) AS r FROM content GROUP BY source, c),
        host AS (SELECT source, count(*) AS docs FROM one GROUP BY source),
        common AS (
            SELECT p.source, p.key FROM per_doc p JOIN one ON one.r = p.r
            JOIN host h ON h.source IS NOT DISTINCT FROM p.source
            GROUP BY p.source, p.key, docs HAVING count(*) > greatest(5.0, docs * 0.002)
        ), removed AS (
            SELECT p.r, sum(p.n) AS n FROM per_doc p
            JOIN common c ON c.key = p.key AND c.source IS NOT DISTINCT FROM p.source GROUP BY p.r
        ), f AS (
            SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
                CAST(coalesce(list_sum([length(w) FOR w IN ws]), 0) AS BIGINT) AS word_chars,
                CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
                CAST(coalesce(removed.n, 0) AS BIGINT) AS n_common_words
            FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN removed USING (r)
        )
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
            NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
                AND 100 * n_common_words <= 50 * n_words AS kept
        FROM f
    """,
    "op7_suffix_array_dedup": """
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), w AS (
            SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS g
            FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d)
        ), hit AS (
            SELECT r, i FROM w SEMI JOIN (SELECT g FROM w GROUP BY g HAVING count(*) > 1) t USING (g)
        ), edge AS (
            SELECT r, i, i > 200 + lag(i, 1, -1000) OVER (PARTITION BY r ORDER BY i) AS starts FROM hit
        ), part AS (
            SELECT r, i, sum(CAST(starts AS INT)) OVER (PARTITION BY r ORDER BY i) AS p FROM edge
        ), span AS (SELECT r, p, min(i) AS s, max(i) + 200 AS e FROM part GROUP BY r, p),
        gap AS (
            SELECT r, e AS s, lead(s) OVER (PARTITION BY r ORDER BY s) AS e FROM span
            UNION ALL SELECT r, 0, min(s) FROM span GROUP BY r
        ), left_over AS (
            SELECT r, string_agg(substr(h, 2 * s + 1, 2 * (coalesce(e, len(h) // 2) - s)), '' ORDER BY s) AS h
            FROM gap JOIN d USING (r) GROUP BY r
        ), total AS (SELECT r, sum(e - s) AS n, count(*) AS c FROM span GROUP BY r)
        SELECT doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
            CAST(coalesce(c, 0) AS BIGINT) AS n_spans,
            sha256(unhex(CASE WHEN c IS NULL THEN d.h ELSE left_over.h END)) AS kept_sha256
        FROM d LEFT JOIN total USING (r) LEFT JOIN left_over USING (r)
    """,
}
