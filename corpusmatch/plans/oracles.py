"""The same results as plain SQL, for checking the queries against another engine."""

from __future__ import annotations

from corpusmatch.plans.roles import PATHS

# White space as the strip functions of the library see it.
_WS = "(' ' || " + " || ".join(
    f"chr({c})" for c in [9, 10, 11, 12, 13, 28, 29, 30, 31, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
) + ")"


def _strip(x: str) -> str:
    return f"trim({x}, {_WS})"


_ITEMS = """items AS (
  SELECT item_id AS pattern_id, 'item_' || item_id AS name, text AS description,
         list_filter(w, lambda x, i: list_position(w, x) = i)[1:3] AS indicators
  FROM (SELECT *, regexp_extract_all(lower(text), '[a-z]{7,}') AS w FROM benchmark))"""

_LABELS = """label_patterns AS (
  SELECT l.label::BIGINT AS pattern_id, 'label_' || l.label AS name, embedding,
         CASE l.label % 3 WHEN 0 THEN [] WHEN 1 THEN string_split(lower(description), ' ')[1:3] ELSE indicators END AS indicators
  FROM (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) l
  LEFT JOIN items ON items.pattern_id = l.label)"""


def _whole_word(text: str, indicators: str) -> str:
    word, other = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
    # a boundary: beside a word character there is none, beside another character there is one
    left = f"CASE WHEN regexp_matches(w, '^{word}') THEN '(^|{other})' ELSE '{word}' END"
    right = f"CASE WHEN regexp_matches(w, '{word}$') THEN '($|{other})' ELSE '{word}' END"
    return (
        f"(coalesce(len({indicators}), 0) = 0 OR len(list_filter({indicators}, lambda w: "
        f"w <> '' AND regexp_matches({text}, '(?i)' || {left} || regexp_escape(w) || {right}))) > 0)"
    )


_KEYWORD = """keyword_hits AS (
  SELECT pattern_id, name AS pattern_name, doc_id AS symbol_id, source AS repo_id, 'keyword' AS match_kind,
         'matched: ' || string_agg(DISTINCT w, ', ' ORDER BY w) AS reason, sha256(text) AS snippet_hash
  FROM documents, (SELECT pattern_id, name, unnest(indicators) AS w FROM items) i
  WHERE w <> '' AND contains(lower('doc_' || lang || ' ' || text), lower(w))
  GROUP BY pattern_id, name, doc_id, source, text)"""

_SEMANTIC = f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY score DESC, symbol_id) AS rn
  FROM (SELECT p.pattern_id, p.name AS pattern_name, vec_id AS symbol_id, coalesce(source, 'vectors') AS repo_id,
               coalesce('doc_' || lang, '') AS doc_name, coalesce(text, '') AS text, indicators,
               list_dot_product(p.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score
        FROM label_patterns p, embeddings e LEFT JOIN documents ON doc_id = vec_id)
  WHERE score >= 0.1),
semantic_hits AS (
  SELECT pattern_id, pattern_name, symbol_id, repo_id, 'semantic' AS match_kind,
         printf('semantic=%.2f', score) AS reason, sha256(left(text, 8000)) AS snippet_hash, score
  FROM ranked
  WHERE rn <= 50 AND {_whole_word("doc_name || ' ' || text || ' ' || text", "indicators")})"""

_HIT = "pattern_id, pattern_name, symbol_id, repo_id, match_kind, reason, snippet_hash"

_LINES = """doc_lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l)))::INT AS ordinal
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""

_PATH = "CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PATHS)) + " END"
_LANG_BY_NUMBER = [
    "python", "ipynb", "markdown", "markdown", "text", "yaml", "dockerfile", "requirements", "ini", "unknown", "yaml", "ini",
]
_LANG = "CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_LANG_BY_NUMBER)) + " END"
_DOC_FILES = f"""doc_files AS (
  SELECT doc_id, source AS repo_id, 'd' || doc_id || '/' || {_PATH} AS rel_path, {_LANG} AS file_lang, text FROM documents),
whole_files AS (
  SELECT *, CASE WHEN file_lang IN ('markdown', 'text') THEN 'doc' ELSE 'config' END AS kind
  FROM doc_files WHERE file_lang NOT IN ('python', 'ipynb', 'unknown'))"""


# --- embeddable texts and the hashed vectors ----------------------------------------------------

_TEXTS = f"""texts AS (
  SELECT *, sha256(txt) AS text_hash
  FROM (SELECT doc_id AS symbol_id, source AS repo_id,
               {_strip("concat_ws(chr(10), 'doc', 'doc_' || lang, nullif(text, ''), nullif(left(text, 1500), ''))")} AS txt
        FROM documents WHERE 2 * length(text) >= 120))"""

_CACHE = """old_cache AS (
  SELECT text_hash, min(symbol_id)::INT AS mark FROM texts WHERE symbol_id % 2 = 0 GROUP BY text_hash)"""


def _hashed(name: str, source: str, key: str, text: str) -> str:
    """CTEs ``{name}`` (key, bucket, weight) and ``{name}_dense`` (key, v) of the texts of ``source``."""
    return f"""{name}_counts AS (
  SELECT {key}, bucket, count(*) AS n
  FROM (SELECT {key}, ('0x' || substr(md5(word), 1, 4))::INT % 256 AS bucket
        FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9_]+')) AS word FROM {source}))
  GROUP BY {key}, bucket),
{name} AS (
  SELECT c.{key}, bucket::INT AS bucket, (n / norm)::FLOAT AS weight
  FROM {name}_counts c JOIN (SELECT {key}, sqrt(sum(n * n)) AS norm FROM {name}_counts GROUP BY {key}) USING ({key})),
{name}_dense AS (
  SELECT k.{key}, list(coalesce(weight, 0)::DOUBLE ORDER BY b) AS v
  FROM (SELECT {key}, b FROM {source}, range(256) r(b)) k LEFT JOIN {name} w ON w.{key} = k.{key} AND w.bucket = k.b
  GROUP BY k.{key})"""


# --- generated sources --------------------------------------------------------------------------

_PART_SYMBOLS = """part_files AS (
  SELECT p_partkey, p_type AS repo, 'parts/p' || p_partkey || '.py' AS rel_path,
         'def size(self, n, /, m, *args, unit=''cm'', **kw):' || chr(10) || '        ''''''' || p_type || ''''''''
           || chr(10) || '        return ' || p_size AS size_source,
         'class Inner:' || chr(10) || '        async def run(self): pass' AS inner_source,
         'def make_' || p_partkey || '(a, b=1):' || chr(10) || '    def hidden(): pass' || chr(10)
           || '    return ''' || p_brand || chr(233) || '''' AS make_source,
         'class Part' || p_partkey || ':' || chr(10) || '    \"\"\"' || p_name || chr(10) || chr(10) || '      in stock' || chr(10)
           || '    \"\"\"' || chr(10) || '    ' AS class_head,
         chr(10) || chr(10) || '    if True:' || chr(10) || '        def guarded(self, *, x): pass' AS class_tail,
         p_name || chr(10) || chr(10) || 'in stock' AS class_doc, p_type
  FROM part),
part_symbols AS (
  SELECT p_partkey, repo, rel_path, s.*
  FROM part_files, LATERAL (VALUES
    (0, 'class', 'Part' || p_partkey, 2, 15, NULL, class_doc, NULL,
     class_head || size_source || chr(10) || chr(10) || '    ' || inner_source || class_tail),
    (1, 'method', 'size', 7, 9, '(m, *args, unit, **kw)', p_type, 'Part' || p_partkey, size_source),
    (2, 'function', 'size', 7, 9, '(m, *args, unit, **kw)', p_type, NULL, size_source),
    (3, 'class', 'Inner', 11, 12, NULL, NULL, NULL, inner_source),
    (4, 'method', 'run', 12, 12, '(self)', NULL, 'Inner', 'async def run(self): pass'),
    (5, 'function', 'run', 12, 12, '(self)', NULL, NULL, 'async def run(self): pass'),
    (6, 'function', 'guarded', 15, 15, '(self, x)', NULL, NULL, 'def guarded(self, *, x): pass'),
    (7, 'function', 'make_' || p_partkey, 17, 19, '(a, b)', NULL, NULL, make_source)
  ) s(ordinal, kind, name, lineno, end_lineno, signature, docstring, parent_name, source)
  WHERE p_partkey % 10 <> 0)"""

_CELLS = f"""cells AS (
  SELECT conv_id || '-' || turn AS file_id, 'chat' || conv_id % 5 AS repo, 'nb/' || conv_id || '-' || turn || '.ipynb' AS rel_path,
         s.*
  FROM conversations, LATERAL (VALUES
    (0, 'cell_0_' || CASE WHEN role = 'assistant' THEN 'code' ELSE 'markdown' END, '# turn' || chr(10) || text),
    (2, 'cell_2_raw', text),
    (3, 'cell_3_', '["' || role || '"]')
  ) s(number, name, source)
  WHERE conv_id % 7 <> 0 AND {_strip("s.source")} <> ''),
cell_symbols AS (
  SELECT *, (row_number() OVER (PARTITION BY file_id ORDER BY number) - 1)::INT AS ordinal,
         CASE WHEN name = 'cell_0_code' THEN 'notebook_code' ELSE 'notebook_markdown' END AS kind
  FROM cells)"""

# --- the catalogue sheet ------------------------------------------------------------------------


def _sheet(name: str, condition: str) -> str:
    return f"""{name} AS (
  SELECT 'Item ' || item_id % 20 AS name, {_strip("text")} AS description,
         CASE WHEN item_id % 3 = 0 THEN 'why' ELSE '' END AS motivation,
         ' sub ' || item_id AS sub_category, 'https://x.example/' || item_id AS link
  FROM benchmark WHERE item_id % 13 <> 12 AND {condition}
  QUALIFY row_number() OVER (PARTITION BY item_id % 20 ORDER BY item_id DESC) = 1)"""


def _ws_class() -> str:
    return r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


# --- the whole ingest ---------------------------------------------------------------------------

_INGESTED = f"""stored AS (
  SELECT *, sha256('https://git.example.org/' || repo || '.git') AS repo_id
  FROM (SELECT repo_id AS repo, rel_path, 0 AS ordinal, kind, rel_path AS name, NULL AS docstring, text AS source
        FROM whole_files WHERE doc_id % 12 <> 8
        UNION ALL SELECT repo, rel_path, ordinal, kind, name, docstring, source FROM part_symbols
        UNION ALL SELECT repo, rel_path, ordinal, kind, name, NULL, source FROM cell_symbols)),
embedded AS (
  SELECT *, sha256(sha256(repo_id || chr(0) || rel_path) || chr(0) || ordinal) AS symbol_id,
         {_strip("concat_ws(chr(10), kind, name, nullif(docstring, ''), nullif(left(source, 1500), ''))")} AS txt
  FROM stored WHERE coalesce(length(docstring), 0) + length(source) >= 120),
texts AS (SELECT DISTINCT txt FROM embedded),
pattern_texts AS (
  SELECT sha256(name) AS pattern_id, name AS pattern_name, indicators,
         {_strip("concat_ws(' | ', name, nullif(description, ''))")} AS txt
  FROM items),
{_hashed("sym", "texts", "txt", "txt")},
{_hashed("pat", "pattern_texts", "txt", "txt")},
best AS (
  SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY score DESC, symbol_id) AS rn
  FROM (SELECT p.*, e.*, list_dot_product(pd.v, sd.v) AS score
        FROM pattern_texts p JOIN pat_dense pd ON pd.txt = p.txt, embedded e JOIN sym_dense sd ON sd.txt = e.txt)
  WHERE score >= 0.45)"""

_HOSTS = "regexp_extract(url, '^(https?://[^/]+)', 1)"

ORACLES = {
    "semantic_topk": f"""WITH {_ITEMS}, {_LABELS}, {_SEMANTIC}
SELECT pattern_id, pattern_name, symbol_id, repo_id, round(score, 6) AS score FROM ranked WHERE rn <= 50""",
    "semantic_match": f"""WITH {_ITEMS}, {_LABELS}, {_SEMANTIC}
SELECT {_HIT}, round(score, 6) AS score FROM semantic_hits""",
    "semantic_hashed": f"""WITH {_hashed("item", "benchmark", "item_id", "text")}, {_hashed("doc", "documents", "doc_id", "text")}
SELECT pattern_id, pattern_name, symbol_id, source AS repo_id, round(score, 6) AS score
FROM (SELECT item_id AS pattern_id, 'item_' || item_id AS pattern_name, doc_id AS symbol_id,
             list_dot_product(i.v, d.v) AS score
      FROM item_dense i, doc_dense d) JOIN documents ON doc_id = symbol_id
WHERE score >= 0.45
QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY score DESC, symbol_id) <= 50""",
    "cosine_pairs": f"""WITH {_ITEMS}, {_LABELS}
SELECT vec_id, label, round(list_dot_product(e.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS score, -1.0::DOUBLE AS misfit
FROM embeddings e JOIN label_patterns p ON p.pattern_id = e.label""",
    "keyword_scan": f"WITH {_ITEMS}, {_KEYWORD} SELECT {_HIT} FROM keyword_hits",
    "keyword_contains": """SELECT doc_id AS symbol_id, contains(lower('doc_' || lang || ' ' || text), 'tion') AS has_tion,
       contains(lower('doc_' || lang || ' ' || text), lower(source)) AS has_source, false AS has_nothing
FROM documents""",
    "wholeword_gate": f"""WITH {_ITEMS}, {_KEYWORD}
SELECT k.pattern_id, k.symbol_id, {_whole_word("'doc_' || lang || ' ' || text || ' ' || text", "i.indicators")} AS passes,
       true AS passes_empty, false AS passes_blank
FROM keyword_hits k JOIN items i ON i.pattern_id = k.pattern_id JOIN documents ON doc_id = symbol_id""",
    "hits_dedup": f"""WITH {_ITEMS}, {_KEYWORD}, numbered AS (
  SELECT '0-' || lpad(symbol_id::VARCHAR, 19, '0') || '-' || lpad(pattern_id::VARCHAR, 19, '0') AS id, * FROM keyword_hits
  UNION ALL
  SELECT '1-' || lpad(symbol_id::VARCHAR, 19, '0') || '-' || lpad(pattern_id::VARCHAR, 19, '0') AS id, * FROM keyword_hits)
SELECT id, {_HIT} FROM numbered
QUALIFY row_number() OVER (PARTITION BY pattern_id, snippet_hash, repo_id ORDER BY id) = 1""",
    "insert_ignore": f"""WITH {_ITEMS}, {_LABELS}, {_KEYWORD}, {_SEMANTIC}, everything AS (
  SELECT 0 AS prio, NULL::DOUBLE AS falling, * REPLACE ('kept' AS reason) FROM keyword_hits WHERE pattern_id < 5
  UNION ALL SELECT 1, NULL, * FROM keyword_hits
  UNION ALL SELECT 2, -score, * EXCLUDE (score) FROM semantic_hits)
SELECT {_HIT} FROM everything
QUALIFY row_number() OVER (PARTITION BY pattern_id, snippet_hash, repo_id ORDER BY prio, falling, symbol_id) = 1""",
    "hash_backfill": """SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'given' WHEN doc_id % 11 <> 0 THEN sha256(text)
                                       WHEN doc_id % 3 = 1 THEN '' END AS snippet_hash
FROM documents""",
    "hits_enriched": f"""WITH {_ITEMS}, {_KEYWORD}
SELECT {_HIT}, 'name of ' || repo_id AS repo_name, 'https://git.example.org/team/' || repo_id || '.git' AS repo_url
FROM keyword_hits WHERE repo_id <> 'src3'""",
    "cascade_delete": f"""WITH {_LINES}, left_files AS (SELECT doc_id FROM documents WHERE source NOT IN ('src1', 'src2'))
SELECT doc_id || ':' || ordinal AS key, kept FROM doc_lines JOIN left_files USING (doc_id), (VALUES ('hit'), ('symbol')) v(kept)
UNION ALL SELECT doc_id::VARCHAR, 'file' FROM left_files""",
    "snippet_hash": """SELECT doc_id, sha256(left(text, 8000)) AS head_hash, length(left(text, 8000))::INT AS head_chars,
       sha256(text) AS full_hash, sha256('') AS null_hash
FROM documents""",
    "symbol_text": f"""SELECT doc_id AS symbol_id, length(t)::INT AS chars, sha256(t) AS hash
FROM (SELECT doc_id, {_strip('''concat_ws(chr(10), CASE WHEN doc_id % 3 <> 0 THEN 'doc' END, 'doc_' || lang,
        CASE WHEN doc_id % 2 = 0 THEN nullif(text, '') END, nullif(left(text, 1500), ''))''')} AS t FROM documents)""",
    "pattern_text": f"""WITH {_sheet("sheet", "true")}
SELECT name, {_strip("concat_ws(' | ', name, nullif(description, ''), nullif(motivation, ''))")} AS text,
       concat_ws(' | ', nullif(description, ''), nullif(motivation, ''), name) AS load_text
FROM sheet""",
    "clean_name": f"""SELECT item_id, {_strip(f"regexp_replace(regexp_replace(raw, '[[(]{_ws_class()}*[0-9]+[a-zA-Z]*{_ws_class()}*[])]', '', 'g'), '{_ws_class()}{{2,}}', ' ', 'g')")} AS name
FROM (SELECT item_id, {_strip("left(text, 30) || '  [ 7b]' || chr(9) || ' (12 ) [x1] ' || item_id")} AS raw FROM benchmark)""",
    "repo_name": """SELECT page_id, replace(string_split(rtrim(u, '/'), '/')[-1], '.git', '') AS name
FROM (SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '.git//' ELSE '.github.git' END AS u FROM pages)""",
    "list_lines": f"""WITH {_LINES}
SELECT doc_id AS file_id, ordinal, length(t)::INT AS chars, sha256(t) AS hash
FROM (SELECT doc_id, ordinal, {_strip("line")} AS t FROM doc_lines WHERE ordinal % 5 <> 0)
WHERE t <> '' AND NOT starts_with(t, '#')""",
    "line_slice": """SELECT doc_id, length(cut)::INT AS chars, sha256(cut) AS hash
FROM (SELECT doc_id, CASE WHEN a IN (0, 5) OR a + doc_id % 9 - 1 = 0 THEN ''
                          ELSE coalesce(array_to_string(string_split(text, chr(10))[a : a + doc_id % 9 - 1], chr(10)), '') END AS cut
      FROM (SELECT *, doc_id % 6 AS a FROM documents))""",
    "min_len_gate": f"""WITH {_LINES}
SELECT doc_id || ':' || ordinal AS id, length(line)::INT AS chars FROM doc_lines WHERE length(line) >= 120
UNION ALL SELECT doc_id::VARCHAR, length(text)::INT FROM documents WHERE length(lang) + length(text) >= 120""",
    "json_indicators": f"""WITH {_ITEMS}, lists AS (
  SELECT 'item' || pattern_id AS key, CASE WHEN pattern_id % 5 IN (0, 4) THEN indicators ELSE [] END AS l FROM items
  UNION ALL SELECT 'event' || event_id, [] FROM events)
SELECT key, len(l)::INT AS n, coalesce(array_to_string(l, '|'), '') AS words FROM lists""",
    "detect_lang": f"""WITH {_DOC_FILES}
SELECT url || '/' || ['.py', 'a.PY', '..py', 'x.tar.json', 'readme.md', 'README.md', 'Dockerfile.txt', 'a.', '.json'][page_id % 9 + 1] AS path,
       ['unknown', 'unknown', 'python', 'json', 'markdown', 'markdown', 'text', 'unknown', 'unknown'][page_id % 9 + 1] AS lang
FROM pages
UNION ALL SELECT rel_path, file_lang FROM doc_files""",
    "path_filter": f"WITH {_DOC_FILES} SELECT rel_path FROM doc_files WHERE doc_id % 12 <> 8",
    "sha256_files": f"""WITH {_DOC_FILES}
SELECT '/corpus/' || repo_id || '/' || rel_path AS path, sha256(text) AS sha256 FROM doc_files""",
    "decode_text": """SELECT doc_id AS file_id, length(t)::INT AS chars, sha256(t) AS hash
FROM (SELECT doc_id, '(' || text || chr(10) || 'a' || chr(65533) || 'b' || chr(10) AS t FROM documents)""",
    "files_index": f"""WITH {_DOC_FILES}
SELECT repo_id, '/corpus/' || repo_id || '/' || rel_path AS path, rel_path, file_lang AS lang, sha256(text) AS sha256
FROM doc_files WHERE file_lang <> 'unknown' AND doc_id % 12 <> 8""",
    "read_tree": f"""WITH {_DOC_FILES}
SELECT repo_id, rel_path, file_lang AS lang, sha256(text) AS sha256
FROM doc_files WHERE file_lang <> 'unknown' AND doc_id % 12 <> 8""",
    "symbols_index": f"""WITH {_DOC_FILES}, {_PART_SYMBOLS}, {_CELLS}
SELECT 'doc' || doc_id AS file_id, repo_id, kind, 1::BIGINT AS n FROM whole_files
UNION ALL SELECT 'part' || p_partkey, repo, kind, count(*) FROM part_symbols GROUP BY ALL
UNION ALL SELECT 'chat' || file_id, repo, kind, count(*) FROM cell_symbols GROUP BY ALL""",
    "whole_file_symbols": f"""WITH {_DOC_FILES}
SELECT doc_id AS file_id, 0::INT AS ordinal, kind, rel_path AS name, NULL::INT AS lineno, NULL::INT AS end_lineno,
       NULL::VARCHAR AS signature, NULL::VARCHAR AS docstring, NULL::VARCHAR AS parent_name, sha256(text) AS source_hash
FROM whole_files""",
    "py_symbols": f"""WITH {_PART_SYMBOLS}
SELECT p_partkey AS file_id, ordinal, kind, name, lineno, end_lineno, signature, docstring, parent_name, sha256(source) AS source_hash
FROM part_symbols""",
    "notebook_cells": f"""WITH {_CELLS}
SELECT file_id, ordinal, kind, name, NULL::INT AS lineno, NULL::INT AS end_lineno, NULL::VARCHAR AS signature,
       NULL::VARCHAR AS docstring, NULL::VARCHAR AS parent_name, sha256(source) AS source_hash
FROM cell_symbols""",
    "extract_errors": """SELECT p_partkey AS file_id, p_type AS repo_id, 'parts/p' || p_partkey || '.py' AS rel_path, 'SyntaxError' AS error
FROM part WHERE p_partkey % 10 = 0""",
    "symbols_files_join": f"""WITH {_LINES}
SELECT doc_id || ':' || ordinal AS symbol_id, doc_id AS file_id, source AS repo_id, ordinal FROM doc_lines JOIN documents USING (doc_id)""",
    "symbols_of_repo": f"""WITH {_LINES}
SELECT doc_id || ':' || ordinal AS symbol_id, doc_id AS file_id, source AS repo_id FROM doc_lines JOIN documents USING (doc_id)
WHERE source = 'src3'""",
    "repo_of_symbol": """SELECT DISTINCT doc_id || ':0' AS symbol_id, source AS repo_id FROM labels JOIN documents USING (doc_id)
WHERE source <> 'src3'""",
    "repo_of_symbol_missing": """SELECT DISTINCT doc_id || ':none' AS symbol_id FROM labels
UNION ALL SELECT DISTINCT doc_id || ':0' FROM labels l
WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND source <> 'src3')""",
    "l2_normalize": """SELECT vec_id, round(u[1], 5) + 0 AS first, round(u[64], 5) + 0 AS last, round(list_dot_product(u, u), 5) AS length
FROM (SELECT vec_id, list_transform(s, lambda x: CASE WHEN n > 0 THEN x / n ELSE x END)::FLOAT[]::DOUBLE[] AS u
      FROM (SELECT vec_id, s, sqrt(list_dot_product(s, s)) AS n
            FROM (SELECT vec_id, list_transform(embedding, lambda x: x * (vec_id % 5)::FLOAT)::DOUBLE[] AS s FROM embeddings)))""",
    "json_vectors": "SELECT vec_id, 64::INT AS dim, true AS same FROM embeddings WHERE vec_id % 10 NOT IN (1, 2, 3)",
    "embed_hashed": f"""WITH {_hashed("doc", "documents", "doc_id", "text")}
SELECT doc_id, bucket, round(weight::DOUBLE, 6) AS weight FROM doc""",
    "cache_hits": f"WITH {_TEXTS}, {_CACHE} SELECT text_hash, mark FROM old_cache",
    "cache_misses": f"""WITH {_TEXTS}, {_CACHE}
SELECT DISTINCT text_hash, length(txt)::INT AS chars FROM texts
WHERE NOT EXISTS (SELECT 1 FROM old_cache c WHERE c.text_hash = texts.text_hash)""",
    "cache_merge": f"""WITH {_TEXTS}, {_CACHE}, new AS (
  SELECT text_hash, -max(symbol_id)::INT AS mark FROM texts WHERE symbol_id % 3 = 0 GROUP BY text_hash)
SELECT coalesce(new.text_hash, old_cache.text_hash) AS text_hash, coalesce(new.mark, old_cache.mark)::INT AS mark
FROM old_cache FULL JOIN new USING (text_hash)""",
    "embed_attach": f"""WITH {_TEXTS}, {_CACHE}
SELECT doc_id AS symbol_id, mark FROM documents LEFT JOIN texts ON symbol_id = doc_id LEFT JOIN old_cache USING (text_hash)""",
    "embed_coverage": f"""WITH {_TEXTS}, {_CACHE}
SELECT repo_id, count(*) AS total, count(mark) AS cached, count(*) - count(mark) AS newly_embedded
FROM texts LEFT JOIN old_cache USING (text_hash) GROUP BY repo_id""",
    "embed_incremental": f"""WITH {_TEXTS}, {_CACHE}, {_hashed("sym", "texts", "symbol_id", "txt")},
weights AS (SELECT symbol_id, count(*) AS nonzero, max(weight) AS largest FROM sym GROUP BY symbol_id)
SELECT doc_id AS symbol_id, text_hash, text_hash IS NOT NULL AND mark IS NULL AS is_new,
       CASE WHEN mark IS NOT NULL THEN (mark <> 0)::INT ELSE nonzero::INT END AS nonzero,
       round(coalesce(mark::DOUBLE, largest::DOUBLE), 5) AS largest
FROM documents LEFT JOIN texts ON texts.symbol_id = doc_id LEFT JOIN old_cache USING (text_hash)
LEFT JOIN weights ON weights.symbol_id = doc_id""",
    "pattern_catalog": f"""WITH {_sheet("sheet", "true")}
SELECT *, '' AS solution, '' AS alias, '' AS category, '' AS resources, '' AS ptype, '' AS comments FROM sheet""",
    "catalog_file": f"""SELECT 'Doc ' || doc_id // 2 AS name, sha256({_strip("coalesce(text, '')")}) AS description_hash, source AS link,
       doc_id::VARCHAR AS comments
FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id // 2 ORDER BY doc_id DESC) = 1""",
    "upsert_patterns": f"""WITH {_sheet("old", "item_id % 2 = 0")}, {_sheet("new", "item_id >= 10")}
SELECT CASE WHEN old.name IS NULL THEN 'new ' || new.name ELSE 'old ' || old.name END AS pattern_id,
       coalesce(new.name, old.name) AS name, coalesce(new.description, old.description) AS description,
       coalesce(new.motivation, old.motivation) AS motivation, coalesce(new.link, old.link) AS link,
       coalesce(new.sub_category, old.sub_category) AS sub_category
FROM old FULL JOIN new ON old.name = new.name""",
    "upsert_repos": f"""WITH entries AS (SELECT {_HOSTS} AS url, page_id FROM pages), per_url AS (
  SELECT url, max(page_id) FILTER (page_id % 2 = 0) AS old, min(page_id) FILTER (page_id % 2 = 1) AS first_new,
         max(page_id) FILTER (page_id % 2 = 1) AS last_new
  FROM entries GROUP BY url)
SELECT url, 'r' || coalesce(old, first_new) AS repo_id, 'name' || coalesce(old, first_new) AS name,
       '/repos/' || coalesce(last_new, old) AS local_path,
       CASE WHEN coalesce(last_new, old) % 4 <> 3 THEN 'main' END AS default_branch, coalesce(last_new, old) AS last_sync_ts
FROM per_url""",
    "collect_urls": f"""SELECT {_HOSTS} AS url, (page_id % 3)::INT AS source_rank, page_id AS pos FROM pages
QUALIFY row_number() OVER (PARTITION BY {_HOSTS} ORDER BY page_id % 3, page_id) = 1""",
    "replace_by_repo": f"""WITH {_DOC_FILES}
SELECT doc_id::VARCHAR AS file_id, repo_id, CASE WHEN repo_id IN ('src4', 'src5') THEN 'new/' ELSE '' END || rel_path AS rel_path
FROM doc_files WHERE repo_id <> 'src6'""",
    "ingest_e2e": f"""WITH {_DOC_FILES}, {_PART_SYMBOLS}, {_CELLS}, found AS (
  SELECT repo_id AS repo, 'file ' || file_lang AS what FROM doc_files WHERE file_lang <> 'unknown' AND doc_id % 12 <> 8
  UNION ALL SELECT repo, 'file python' FROM part_files
  UNION ALL SELECT 'chat' || conv_id % 5, 'file ipynb' FROM conversations
  UNION ALL SELECT repo_id, 'symbol ' || kind FROM whole_files WHERE doc_id % 12 <> 8
  UNION ALL SELECT repo, 'symbol ' || kind FROM part_symbols
  UNION ALL SELECT repo, 'symbol ' || kind FROM cell_symbols
  UNION ALL SELECT repo_id, 'vector' FROM whole_files WHERE doc_id % 12 <> 8 AND length(text) >= 120
  UNION ALL SELECT repo, 'vector' FROM part_symbols WHERE coalesce(length(docstring), 0) + length(source) >= 120
  UNION ALL SELECT repo, 'vector' FROM cell_symbols WHERE length(source) >= 120
  UNION ALL SELECT repo, 'error' FROM part_files WHERE p_partkey % 10 = 0
  UNION ALL SELECT DISTINCT repo_id, 'repo' FROM doc_files
  UNION ALL SELECT DISTINCT repo, 'repo' FROM part_files
  UNION ALL SELECT DISTINCT 'chat' || conv_id % 5, 'repo' FROM conversations)
SELECT repo, what, count(*) AS n FROM found GROUP BY repo, what""",
    "ingest_semantic_hits": f"""WITH {_ITEMS}, {_DOC_FILES}, {_PART_SYMBOLS}, {_CELLS}, {_INGESTED}
SELECT pattern_name, repo AS repo_name, 'https://git.example.org/' || repo || '.git' AS repo_url,
       printf('semantic=%.2f', score) AS reason, sha256(left(source, 8000)) AS snippet_hash
FROM best
WHERE rn <= 50 AND {_whole_word("name || ' ' || coalesce(docstring, '') || ' ' || source", "indicators")}
QUALIFY row_number() OVER (PARTITION BY pattern_id, sha256(left(source, 8000)), repo_id ORDER BY score DESC, symbol_id) = 1""",
}

ORACLES["semantic_standing"] = ORACLES["semantic_topk"]
