"""DuckDB SQL of the registered queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op3_chat_format"] = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length('<|turn|>' || chr(10) || '<|end|>' || chr(10))
        + length(replace(replace(replace(role, '<', '<\'), '[', '[\'), chr(10), '[n'))
        + length(replace(replace(text, '<', '<\'), '[', '[\'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

SQL["op10_decontaminate"] = r"""
WITH words AS (
    SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    UNION ALL
    SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), item_windows AS (
    SELECT DISTINCT id AS item, least(10, len(w)) AS size, list_slice(w, s, s + least(10, len(w)) - 1) AS win
    FROM (SELECT id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS s FROM words WHERE side = 'b' AND len(w) > 0)
), doc_windows AS (
    SELECT id, size, s, list_slice(w, s, s + size - 1) AS win
    FROM (SELECT id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS s FROM words, (SELECT DISTINCT size FROM item_windows) WHERE side = 'd' AND len(w) >= size)
), hits AS (
    SELECT DISTINCT d.id, d.s, d.size, i.item FROM doc_windows d JOIN item_windows i ON d.size = i.size AND d.win = i.win
), covered AS (
    SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(generate_series(s, s + size - 1)) AS p FROM hits) GROUP BY id
), named AS (
    SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS item FROM hits) GROUP BY id
)
SELECT w.id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
    sha256(coalesce(n.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN covered c ON w.id = c.id LEFT JOIN named n ON w.id = n.id WHERE w.side = 'd'
"""

SQL["op11_lexical_search"] = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL
), n AS (
    SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0
), corpus AS (
    SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n
), tf AS (
    SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM n) GROUP BY doc_id, n, term
), items AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL
), weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), corpus
), scores AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
    FROM items JOIN weights USING (term) JOIN tf USING (term), corpus GROUP BY item_id, doc_id
), ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

SQL["op8_jaccard_join"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) END AS shingles FROM words
), sizes AS (
    SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n FROM sets
), held AS (
    SELECT doc_id, unnest(shingles) AS shingle FROM sets
), shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM held x JOIN held y USING (shingle) WHERE x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM shared s JOIN sizes p ON p.doc_id = s.a JOIN sizes q ON q.doc_id = s.b WHERE 100 * s.n >= 85 * (p.n + q.n - s.n)
), steps AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
    SELECT a AS doc_id, b AS other FROM steps UNION SELECT r.doc_id, s.b FROM reached r JOIN steps s ON s.a = r.other
)
SELECT s.doc_id, s.n AS n_shingles, least(s.doc_id, coalesce(r.other, s.doc_id)) AS component_id
FROM sizes s LEFT JOIN (SELECT doc_id, min(other) AS other FROM reached GROUP BY doc_id) r ON r.doc_id = s.doc_id
"""
