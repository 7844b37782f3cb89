"""DuckDB SQL for the queries of this folder that SQL can express."""

from alertloom.llm.decontaminate import WINDOW
from alertloom.llm.jaccard import PERCENT, SHINGLE
from alertloom.llm.license_texts import KNOWN, SPELLINGS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _jaccard() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    next_words = ", ".join(f"lead(x, {k}) OVER own" if k else "x" for k in range(SHINGLE))
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS w FROM documents),
parts AS (
  SELECT doc_id, len(w) AS n, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM w),
grams AS (
  SELECT doc_id, n, i, concat_ws(' ', {next_words}) AS gram FROM parts
  WINDOW own AS (PARTITION BY doc_id ORDER BY i)),
sets AS (
  SELECT w.doc_id, coalesce(g.s, []) AS s FROM w LEFT JOIN (
    SELECT doc_id, list_sort(list(DISTINCT hash(gram))) AS s FROM grams
    WHERE i <= greatest(1, n - {SHINGLE - 1}) GROUP BY doc_id) g USING (doc_id)),
nodes AS (SELECT s, min(doc_id) AS node, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT node, n, t FROM (SELECT node, n, unnest(s) AS t FROM nodes)
           QUALIFY count(*) OVER (PARTITION BY t) > 1),
pairs AS (
  SELECT a.node AS a, b.node AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.node <> b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
reach AS (
  SELECT node AS a, node AS b FROM nodes
  UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT x.doc_id, CAST(len(x.s) AS BIGINT) AS n_shingles,
       coalesce(l.component_id, x.doc_id) AS component_id
FROM sets x LEFT JOIN nodes ON x.s = nodes.s LEFT JOIN least l ON nodes.node = l.a"""


def _contamination() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH item_words AS (SELECT item_id, {words} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, len(list_slice(w, s, s + {WINDOW - 1})) AS m,
         array_to_string(list_slice(w, s, s + {WINDOW - 1}), ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - {WINDOW - 1}))) AS s
        FROM item_words WHERE len(w) > 0)),
doc_words AS (SELECT doc_id, {words} AS w FROM documents),
sizes AS (SELECT DISTINCT m FROM windows),
starts AS (
  SELECT doc_id, m, s, array_to_string(list_slice(w, s, s + m - 1), ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS s
        FROM doc_words, sizes WHERE len(w) >= m)),
found AS (SELECT doc_id, s, starts.m, item_id FROM starts JOIN windows USING (m, win)),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(s, s + m - 1)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _licenses() -> str:
    def canonical(text: str) -> str:
        bare = (rf"regexp_replace({text}, '(?im)^[ \t*#/;-]*((copyright|\(c\))[^\n]*([0-9]{{4}}|<year>|\[year\])|"
                r"copyright[ \t]*(\(c\)|©)|©|all rights reserved)[^\n]*$', ' ', 'g')")
        bare = rf"' ' || trim(regexp_replace(lower({bare}), '[^\p{{L}}\p{{N}}]+', '  ', 'g')) || ' '"
        for variant, usual in SPELLINGS:
            variant, usual = (f" {words} ".replace(" ", "  ")[1:-1] for words in (variant, usual))
            bare = f"replace({bare}, '{variant}', '{usual}')"
        return f"trim(replace({bare}, '  ', ' '))"

    def digest(text: str) -> str:
        return f"CASE WHEN {canonical(text)} <> '' THEN sha256({canonical(text)}) END"

    known = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in KNOWN.items())
    return f"""
WITH known AS (
  SELECT {digest('body')} AS dig, min(license_id) AS license_id
  FROM (VALUES {known}) AS t(license_id, body) GROUP BY 1),
found AS (
  SELECT doc_id, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS notices
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) l
  JOIN known k ON {digest('line')} = k.dig GROUP BY doc_id)
SELECT d.doc_id, d.text_digest, k.license_id, coalesce(f.notices, '') AS notices
FROM (SELECT doc_id, {digest('text')} AS text_digest FROM documents) d
LEFT JOIN known k ON d.text_digest = k.dig LEFT JOIN found f USING (doc_id)"""


def _spelling() -> str:
    # crc32 (reflected polynomial 0xEDB88320) byte by byte over a table of 256 entries.
    step = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    rounds = "SELECT i, 0 AS k, CAST(i AS BIGINT) AS v FROM range(256) t(i)"
    return rf"""
WITH RECURSIVE bits AS ({rounds} UNION ALL SELECT i, k + 1, {step} FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
hexed AS (SELECT id, run, c, hex(encode(id || ':' || run)) AS hx FROM runs),
hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(0, length(hx) // 2),
      lambda b: CAST('0x' || substr(hx, 2 * b + 1, 2) AS BIGINT))),
    lambda s, b: xor(s >> 8, tab[CAST(xor(s, b) & 255 AS BIGINT) + 1]))) AS h
  FROM hexed, crc),
damaged AS (
  SELECT c, CASE WHEN h % 31 = 0
    THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7
          GROUP BY word HAVING sum(c) >= 2),
holes AS (
  SELECT word, n, substr(word, 1, i) AS head, substr(word, i + 2) AS tail
  FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM holes a
    JOIN holes b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM holes a JOIN words b ON a.head || a.tail = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM holes a JOIN words b ON a.head || a.tail = b.word),
best AS (
  SELECT word, count(*) OVER (PARTITION BY word) AS n_near,
         CASE WHEN near_n >= 10 * n THEN near END AS form,
         CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
  FROM pairs QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
chain AS (
  SELECT word, word AS place, 0 AS k FROM words
  UNION ALL SELECT c.word, b.form, k + 1 FROM chain c JOIN best b ON c.place = b.word AND b.form IS NOT NULL),
last AS (SELECT word, max_by(place, k) AS root FROM chain GROUP BY word)
SELECT w.word, b.form, l.root, w.n, coalesce(b.n_near, 0) AS n_near, b.form_n
FROM words w JOIN last l USING (word) LEFT JOIN best b USING (word)"""


def _negatives() -> str:
    return """
WITH vecs AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
         CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM vecs a JOIN vecs r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER own AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON p.anchor_id = n.anchor_id AND NOT n.same
  AND 80 * p.score <= 100 * n.score AND n.score <= p.score
WINDOW own AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER own <= 5"""


def llm_oracle() -> dict[str, str]:
    return {"op1_jaccard": _jaccard(), "op5_decontaminate": _contamination(), "op6_licenses": _licenses(),
            "op11_spelling": _spelling(), "op12_negatives": _negatives()}
