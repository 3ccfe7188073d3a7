"""DuckDB statements that give the same rows as the queries of this package, where SQL can express them.

The others need trained models, a tokenizer or a hash that SQL lacks; their tests compare them with
brute-force versions.
"""

SQL: dict[str, str] = {}

SQL["op1_url_filters"] = r"""
WITH rules(rule_host, rule_path, action) AS (
    VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
           ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), parts AS (
    SELECT page_id,
        CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), hosts AS (
    SELECT row_number() OVER () AS r, page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw_host, coalesce(rest, '') AS rest
    FROM parts
), urls AS (
    SELECT r, page_id,
        translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path
    FROM hosts
), fits AS (
    SELECT r, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
        arg_max(action, length(rule_host || rule_path)) AS action
    FROM urls JOIN rules
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM urls LEFT JOIN fits USING (r)
"""

SQL["op2_revisits"] = r"""
WITH p AS (
    SELECT page_id AS k, url, 1700000000 + page_id * 7919 % 2592000 AS moment,
        '"' || md5(coalesce(html, '')) || '"' AS tag, 'day ' || (page_id * 31 % 997) AS day,
        regexp_replace(url, '#.*$', '') AS plain
    FROM pages
), q AS (
    SELECT *, regexp_extract(plain, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?]*)(.*)$', ['s', 'h', 'p', 'q']) AS u,
        moment + 3600 + k * 31 % 86400 AS later
    FROM p
), c AS (
    SELECT *, CASE WHEN u.s = '' THEN plain ELSE lower(u.s) || '://' || lower(u.h)
        || CASE WHEN u.p = '' THEN '/' ELSE u.p END || u.q END AS canon
    FROM q
), responses AS (
    SELECT k * 4 AS id, canon, moment, tag, day FROM c
), asked AS (
    SELECT k * 4 + 1 AS id, canon, later AS moment,
        CASE WHEN k % 3 = 0 THEN 'W/' || tag ELSE tag END AS tag, NULL AS day, 1 AS n FROM c
    UNION ALL
    SELECT k * 4 + 2, canon, later + 60, CASE WHEN k % 5 = 0 THEN '"other"' END,
        CASE WHEN k % 5 <> 1 THEN day END, 2 FROM c
    UNION ALL
    SELECT k * 4 + 3, canon, moment - CASE WHEN k % 7 = 0 THEN 60 ELSE -60 END, tag, NULL, 3 FROM c
), found AS (
    SELECT a.id, max((r.moment, r.id)) AS best FROM asked a JOIN responses r ON a.canon = r.canon AND r.moment < a.moment
    GROUP BY a.id
), joined AS (
    SELECT a.*, r.id AS response_id, r.tag AS r_tag, r.day AS r_day,
        CASE WHEN r.id IS NULL THEN 'no_response'
            WHEN a.tag IS NULL AND a.day IS NULL THEN 'no_validator'
            WHEN a.tag IS NOT NULL AND replace(a.tag, 'W/', '') = r.tag THEN 'resolved'
            WHEN a.tag IS NULL AND a.day = r.day THEN 'resolved' ELSE 'mismatch' END AS status
    FROM asked a LEFT JOIN found f ON a.id = f.id LEFT JOIN responses r ON r.id = f.best[2]
)
SELECT id AS record_id, canon AS url, moment, response_id, status,
    CASE WHEN status = 'resolved' THEN
        CASE n WHEN 2 THEN 'cache-control: no-cache' || chr(10) ELSE '' END || 'content-type: text/html'
        || CASE n WHEN 1 THEN chr(10) || 'date: later' ELSE '' END
        || chr(10) || 'etag: ' || coalesce(tag, r_tag)
        || chr(10) || 'last-modified: ' || coalesce(day, r_day)
    ELSE CASE n
        WHEN 1 THEN 'content-length: 0' || chr(10) || 'date: later' || chr(10) || 'etag: ' || tag
        WHEN 2 THEN 'cache-control: no-cache' || coalesce(chr(10) || 'etag: ' || tag, '')
            || coalesce(chr(10) || 'last-modified: ' || day, '')
        ELSE 'etag: ' || tag END
    END AS headers
FROM joined
"""

SQL["op10_repeats"] = r"""
WITH w AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), windows AS (
    SELECT r, i, array_to_string(words[i:i + 34], ' ') AS body
    FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35)
), again AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY body) AS n FROM windows) WHERE n > 1
), covered AS (
    SELECT DISTINCT r, j FROM (SELECT r, unnest(range(i, i + 35)) AS j FROM again)
), places AS (
    SELECT r, words[j] AS word, j FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS j FROM w)
), kept AS (
    SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS body
    FROM places ANTI JOIN covered USING (r, j) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, len(words) - coalesce(n, 0) AS n_removed,
    sha256(coalesce(body, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""

#: CRC-32 of a short ASCII text, bit by bit: `{text}` stands for it.
CRC32 = r"""xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({text}, ''),
    lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""


def _field(name: str, value: str | None = None) -> str:
    text = f"({value or name})::VARCHAR"
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END"


def _tree(leaves: str, name: str, levels: int = 40) -> str:
    """Steps of every leaf (g, i, d, n) to its group's top, as recursive SQL: `name`(g, lvl, i, d, n)."""
    return f"""{name} AS (
    SELECT g, 0 AS lvl, i, d, n FROM {leaves}
    UNION ALL
    SELECT g, lvl + 1, i // 2, sha256(d || coalesce(after, '')), (n + 1) // 2
    FROM (SELECT *, lead(d) OVER (PARTITION BY g, lvl ORDER BY i) AS after FROM {name} WHERE n > 1 AND lvl < {levels})
    WHERE i % 2 = 0
)"""


SQL["op13_merkle"] = f"""
WITH RECURSIVE base AS (
    SELECT doc_id, lang, {CRC32.format(text="doc_id::VARCHAR")} % 7 = 0 AS tampered,
        {" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))} AS body,
        {" || ".join([*(_field(c) for c in ("doc_id", "source", "lang")), _field("n_chars", "n_chars + 1"), _field("text")])} AS other
    FROM documents
), digests AS (
    SELECT doc_id, CASE WHEN lang IS NULL THEN 'n' ELSE 'v' || lang END AS g, sha256(body) AS leaf,
        sha256(CASE WHEN tampered THEN other ELSE body END) AS changed FROM base
), leaves AS (
    SELECT *, leaf AS d, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
        count(*) OVER (PARTITION BY g) AS n
    FROM digests
), {_tree("leaves", "low")}, subroots AS (
    SELECT g AS lang_key, d AS subroot, '' AS g, d, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n
    FROM low WHERE n = 1
), {_tree("subroots", "high")}, walk AS (
    SELECT l.g, l.i AS leaf_i, 0 AS lvl, l.i AS spot, l.n, l.changed AS fold, '' AS proof FROM leaves l
    UNION ALL
    SELECT w.g, leaf_i, w.lvl + 1, spot // 2, (w.n + 1) // 2,
        sha256(CASE WHEN spot % 2 = 1 THEN s.d || fold ELSE fold || coalesce(s.d, '') END), proof || coalesce(s.d, '')
    FROM walk w LEFT JOIN low s ON s.g = w.g AND s.lvl = w.lvl AND s.i = xor(w.spot, 1) WHERE w.n > 1
), climb AS (
    SELECT w.g, leaf_i, 0 AS lvl, s.i AS spot, s.n, fold, proof FROM walk w JOIN subroots s ON s.lang_key = w.g WHERE w.n = 1
    UNION ALL
    SELECT c.g, leaf_i, c.lvl + 1, spot // 2, (c.n + 1) // 2,
        sha256(CASE WHEN spot % 2 = 1 THEN s.d || fold ELSE fold || coalesce(s.d, '') END), proof || coalesce(s.d, '')
    FROM climb c LEFT JOIN high s ON s.lvl = c.lvl AND s.i = xor(c.spot, 1) WHERE c.n > 1
)
SELECT doc_id, leaf, subroot, top.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = top.d AS verified
FROM leaves l JOIN climb c ON c.g = l.g AND c.leaf_i = l.i AND c.n = 1
JOIN subroots s ON s.lang_key = l.g, (SELECT d FROM high WHERE n = 1) top
"""

SQL["op11_trie"] = f"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id
            ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || chr(0) || coalesce(text, ''))) AS j
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base, {CRC32.format(text="conv_id::VARCHAR")} % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
    SELECT c.conv_id, 0 AS part, j, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND j <= h
    UNION ALL
    SELECT c.conv_id, 1, j, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND j > h
), placed AS (
    SELECT conv_id, text, strlen(text) AS bytes, row_number() OVER w AS depth,
        list(sha256(strlen(role) || ':' || role || text)) OVER (w ROWS UNBOUNDED PRECEDING) AS hashes
    FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, j)
), prefixes AS (
    SELECT conv_id, depth, bytes, sha256(array_to_string(hashes, '')) AS id,
        CASE WHEN depth = 1 THEN '' ELSE sha256(array_to_string(hashes[:-2], '')) END AS parent,
        depth = max(depth) OVER (PARTITION BY conv_id) AS ends
    FROM placed
    UNION ALL
    SELECT conv_id, 0, 0, '', NULL, NOT EXISTS (SELECT 1 FROM placed p WHERE p.conv_id = c.conv_id) FROM convs c
), nodes AS (
    SELECT id, any_value(parent) AS parent, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM prefixes GROUP BY id, depth
), kids AS (
    SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), owned AS (
    -- Each node once, by its least member, whose prefixes are the node and what is above it.
    SELECT n.conv_id, n.depth, (n_convs - 1) * bytes AS saved, (k.n IS NULL)::BIGINT AS leaf
    FROM nodes n LEFT JOIN kids k ON k.parent = n.id
), sums AS (
    SELECT p.id, sum(o.saved)::BIGINT AS saved_tokens, sum(o.leaf)::BIGINT AS n_leaves
    FROM prefixes p JOIN owned o ON o.conv_id = p.conv_id AND o.depth >= p.depth GROUP BY p.id
)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, n_leaves,
    saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (id) LEFT JOIN kids k ON k.parent = n.id LEFT JOIN nodes up ON up.id = n.parent
"""

SQL["op12_suffixes"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
    SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS body
    FROM (SELECT r, doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE doc_id IS NOT NULL)
), gone AS (
    SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY body) AS m FROM windows) WHERE m < doc_id
), marked AS (
    SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM gone
), numbered AS (
    SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS span FROM marked
), spans AS (
    SELECT r, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY r, span
), gaps AS (
    SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS lo, a AS hi FROM spans
    UNION ALL
    SELECT r, coalesce(max(b), 0), max(length(h)) // 2 FROM d LEFT JOIN spans USING (r) GROUP BY r
), kept AS (
    SELECT r, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS body, count(*) - 1 AS n
    FROM gaps JOIN d USING (r) GROUP BY r
)
SELECT doc_id, length(h) // 2 AS n_bytes, (length(h) - length(body)) // 2 AS n_removed, n AS n_spans,
    sha256(unhex(body)) AS kept_sha256
FROM d JOIN kept USING (r)
"""
