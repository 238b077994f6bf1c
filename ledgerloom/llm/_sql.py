"""SQL for DuckDB that several oracles share."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes: bit by bit, each byte followed by seven zeros that only shift."""
    code = f"hex(encode({text}))"
    byte = f"CAST(concat('0x', substr({code}, CAST(k // 8 * 2 + 1 AS BIGINT), 2)) AS BIGINT)"
    bits = f"list_transform(range(0, strlen({text}) * 8), lambda k: CASE WHEN k % 8 = 0 THEN {byte} ELSE CAST(0 AS BIGINT) END)"
    step = "CASE WHEN xor(c, b) % 2 = 1 THEN xor(xor(c, b) // 2, CAST(3988292384 AS BIGINT)) ELSE xor(c, b) // 2 END"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda c, b: {step}), CAST(4294967295 AS BIGINT))"


def variants_sql() -> str:
    """What op11_spelling_variants returns."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), '{upper}', '{lower}') AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY 1, 2),
h AS (SELECT run, n, h FROM (SELECT run, n, {crc32_sql("key")} AS h FROM (SELECT run, n, concat(doc_id, ':', run) AS key FROM d) k) x),
w AS (SELECT CASE WHEN h % 97 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
p AS (SELECT word, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v) x),
pairs AS (SELECT a.word, b.word AS other FROM p a JOIN p b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT p.word, v.word FROM p JOIN v ON v.word = p.less UNION SELECT v.word, p.word FROM p JOIN v ON v.word = p.less),
best AS (SELECT pairs.word, count(*) AS n_near, arg_min(other, (-o.n, other)) AS other, max(o.n) AS other_n FROM pairs JOIN v o ON o.word = pairs.other GROUP BY 1),
t AS (SELECT v.word, v.n, coalesce(best.n_near, 0) AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form, CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n FROM v LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root, 0 AS step FROM t UNION ALL SELECT up.word, t.form, step + 1 FROM up JOIN t ON t.word = up.root WHERE t.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, step) AS root FROM up GROUP BY 1)
SELECT t.word, t.form, roots.root, t.n, t.n_near, t.form_n FROM t JOIN roots USING (word)"""


def trie_sql() -> str:
    """What op12_conversation_trie returns."""
    return f"""WITH o AS (SELECT conv_id, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS d, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS w,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i FROM conversations),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS head, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM conversations) x),
r AS (SELECT c.conv_id, o.i, o.d, o.w FROM c JOIN o ON o.conv_id = c.head AND o.i < c.h UNION ALL SELECT c.conv_id, o.i, o.d, o.w FROM c JOIN o ON o.conv_id = c.conv_id AND o.i >= c.h),
p AS (SELECT conv_id, w, row_number() OVER own AS depth, string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path FROM r WINDOW own AS (PARTITION BY conv_id ORDER BY i)),
m AS (SELECT conv_id, depth, path, w FROM p UNION ALL SELECT conv_id, 0, '', 0 FROM c),
size AS (SELECT conv_id, max(depth) AS size FROM m GROUP BY 1),
n AS (SELECT path, depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w, coalesce(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) FILTER (WHERE size.size = depth), '') AS ends
  FROM m JOIN size USING (conv_id) GROUP BY 1, 2),
up AS (SELECT path, substr(path, 1, CAST(32 * depth - 32 AS BIGINT)) AS above FROM n WHERE depth > 0),
kids AS (SELECT above AS path, count(*) AS n_children FROM up GROUP BY 1),
below AS (SELECT substr(n.path, 1, CAST(32 * e AS BIGINT)) AS path, (n_convs - 1) * w AS saved, n_children IS NULL AS leaf FROM (SELECT n.*, kids.n_children, unnest(range(0, depth + 1)) AS e FROM n LEFT JOIN kids USING (path)) n),
sums AS (SELECT path, CAST(sum(saved) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE leaf) AS n_leaves FROM below GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n_children, 0) AS n_children, sums.n_leaves, sums.saved_tokens, sha256(n.ends) AS ends_sha256
FROM n LEFT JOIN up USING (path) LEFT JOIN n a ON a.path = up.above LEFT JOIN kids ON kids.path = n.path JOIN sums ON sums.path = n.path"""


def substrings_sql() -> str:
    """What op13_substring_dedup returns."""
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
h1 AS (SELECT doc_id, i, word AS a1 FROM each),
h2 AS (SELECT *, md5(concat(a1, ' ', lead(a1, 1) OVER o)) AS a2 FROM h1 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h4 AS (SELECT *, md5(concat(a2, lead(a2, 2) OVER o)) AS a4 FROM h2 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h8 AS (SELECT *, md5(concat(a4, lead(a4, 4) OVER o)) AS a8 FROM h4 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h16 AS (SELECT *, md5(concat(a8, lead(a8, 8) OVER o)) AS a16 FROM h8 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h32 AS (SELECT *, md5(concat(a16, lead(a16, 16) OVER o)) AS a32 FROM h16 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i, h FROM (SELECT doc_id, i, md5(concat(a32, lead(a16, 32) OVER o, lead(a2, 48) OVER o)) AS h, lead(i, 49) OVER o AS last FROM h32 WINDOW o AS (PARTITION BY doc_id ORDER BY i)) x WHERE last IS NOT NULL),
f AS (SELECT h, min(doc_id) AS first FROM k GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM k JOIN f USING (h) WHERE first < doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""
