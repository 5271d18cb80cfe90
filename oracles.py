"""DuckDB SQL stating each registered query's result independently of the Spark code."""

from __future__ import annotations

# Bound parameters of the single-query searches; they always run over whole tables.
QUERY_VECTOR_ID = 7
TEXT_QUERIES = [
    (1, "der die"),
    (2, "de la"),
    (3, "les un"),
    (4, "in the"),
    (5, "the"),
    (6, "The of, and THE with"),
    (7, "la"),
]

TRIM = r"^[\s\x1c-\x1f\p{Z}]+|[\s\x1c-\x1f\p{Z}]+$"
WORDS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"

CORPUS = """corpus AS (
  SELECT d.doc_id AS id, split_part(d.text, chr(10), 1) AS title, d.text AS content,
         d.lang AS namespace, d.source AS contributors, e.embedding
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""

ALPHABET = "string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' ')"


def letter_vector(text: str) -> str:
    """How often each of the letters a to z occurs; null if none does."""
    counts = f"list_transform({ALPHABET}, lambda c: length({text}) - length(replace({text}, c, '')))"
    return f"CASE WHEN regexp_matches({text}, '[a-z]') THEN {counts} END"


LETTER_CORPUS = CORPUS.replace("e.embedding", f"{letter_vector('d.text')} AS embedding").replace(
    " LEFT JOIN embeddings e ON e.vec_id = d.doc_id", ""
)

TEXT_QUERY_ROWS = "asked AS (SELECT * FROM (VALUES {}) v(query_id, query_text))".format(
    ", ".join(f"({i}, '{q}')" for i, q in TEXT_QUERIES)
)
BENCHMARK_ROWS = "asked AS (SELECT item_id AS query_id, text AS query_text FROM benchmark)"
ALL_TEXT_ROWS = (
    TEXT_QUERY_ROWS.replace("asked AS (", "asked AS (")[:-1]
    + " UNION ALL SELECT item_id + 1000, text FROM benchmark)"
)
ONE_TEXT_ROW = "asked AS (SELECT 1 AS query_id, 'in the' AS query_text)"


def distances(pairs: str) -> str:
    """``near(query_id, id, dist, r)`` over all pairs of a query vector and a document vector."""
    return f"""queryvec AS ({pairs}),
scored AS (
  SELECT q.query_id, c.id, 1 - greatest(-1, least(1,
           list_inner_product(c.embedding::DOUBLE[], q.vec::DOUBLE[])
           / (sqrt(list_inner_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]))
              * sqrt(list_inner_product(q.vec::DOUBLE[], q.vec::DOUBLE[]))))) AS dist
  FROM queryvec q, corpus c WHERE c.embedding IS NOT NULL),
near AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS r FROM scored)"""


ONE_VECTOR = f"SELECT 1 AS query_id, embedding AS vec FROM embeddings WHERE vec_id = {QUERY_VECTOR_ID}"
BENCHMARK_VECTORS = (
    "SELECT item_id AS query_id, embedding AS vec FROM benchmark JOIN embeddings ON vec_id = item_id"
)


def positions(weighted: bool) -> str:
    """``occurrence(id, lexeme, pos, w, doc_length)``, one row per word."""
    if not weighted:
        return f"""words AS (
  SELECT id, {WORDS.format("title || ' ' || content")} AS tokens FROM corpus),
occurrence AS (
  SELECT id, unnest(tokens) AS lexeme, generate_subscripts(tokens, 1) AS pos, 0.1::DOUBLE AS w,
         len(tokens) AS doc_length FROM words)"""
    return f"""words AS (
  SELECT id, {WORDS.format("title")} AS t, {WORDS.format("content")} AS c FROM corpus),
occurrence AS (
  SELECT id, unnest(t) AS lexeme, generate_subscripts(t, 1) AS pos, 1.0::DOUBLE AS w,
         len(t) + len(c) AS doc_length FROM words
  UNION ALL
  SELECT id, unnest(c), len(t) + generate_subscripts(c, 1), 0.1::DOUBLE, len(t) + len(c) FROM words)"""


HITS = f"""terms AS (
  SELECT query_id, unnest(list_distinct(words)) AS lexeme, len(list_distinct(words)) AS n_terms
  FROM (SELECT query_id, {WORDS.format("query_text")} AS words FROM asked)),
found AS (SELECT t.query_id, o.*, t.n_terms FROM occurrence o JOIN terms t USING (lexeme)),
matched AS (
  SELECT query_id, id, any_value(n_terms) AS n_terms, any_value(doc_length) AS doc_length FROM found
  GROUP BY query_id, id HAVING count(DISTINCT lexeme) = any_value(n_terms)),
hits AS (
  SELECT f.query_id, f.id, f.lexeme, f.pos, f.w, f.n_terms, f.doc_length
  FROM found f JOIN matched m USING (query_id, id))"""

FREQUENCY = """single AS (
  SELECT query_id, id, sum(w / (j * j)) / 1.64493406685 AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY pos) AS j
        FROM hits WHERE n_terms = 1) GROUP BY query_id, id),
per_term AS (
  SELECT query_id, id, lexeme, count(*) AS n FROM hits WHERE n_terms > 1 GROUP BY query_id, id, lexeme),
pairs AS (
  SELECT query_id, id, (sum(n) * sum(n) - sum(n * n)) / 2 AS n_pairs FROM per_term GROUP BY query_id, id),
close AS (
  SELECT query_id, id, count(*) AS n_close,
         sum(CASE WHEN c < 1e-6 THEN -c ELSE ln(1 - c) END) AS miss
  FROM (
    SELECT a.query_id, a.id,
           sqrt(a.w * b.w / (1.005 + 0.05 * exp(abs(a.pos - b.pos) / 1.5 - 2))) AS c
    FROM hits a JOIN hits b ON a.query_id = b.query_id AND a.id = b.id AND a.lexeme < b.lexeme
         AND abs(a.pos - b.pos) <= 100 WHERE a.n_terms > 1)
  GROUP BY query_id, id),
logs AS (
  SELECT query_id, id,
         coalesce(miss, 0) - (n_pairs - coalesce(n_close, 0)) * 0.1::DOUBLE * 1e-15::DOUBLE AS x
  FROM pairs LEFT JOIN close USING (query_id, id)),
several AS (
  SELECT query_id, id, CASE WHEN x < -1e-5 THEN 1 - exp(x) ELSE -x - x * x / 2 END AS rank FROM logs),
rated AS (
  SELECT query_id, id, rank::FLOAT::DOUBLE AS rank
  FROM (SELECT * FROM single UNION ALL SELECT * FROM several))"""

COVER_DENSITY = """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY pos, lexeme) AS i,
         sum(1 / w) OVER (PARTITION BY query_id, id ORDER BY pos, lexeme ROWS UNBOUNDED PRECEDING) AS cum
  FROM hits),
latest AS (
  SELECT n.query_id, n.id, n.i,
         max(CASE WHEN n.lexeme = t.lexeme THEN n.i END)
           OVER (PARTITION BY n.query_id, n.id, t.lexeme ORDER BY n.i) AS seen, n.n_terms
  FROM numbered n JOIN terms t ON t.query_id = n.query_id),
spans AS (
  SELECT query_id, id, i AS e, min(seen) AS s FROM latest
  GROUP BY query_id, id, i HAVING count(seen) = any_value(n_terms)),
covers AS (SELECT query_id, id, s, min(e) AS e FROM spans GROUP BY query_id, id, s),
measured AS (
  SELECT c.query_id, c.id, c.e - c.s + 1 AS n, b.cum - a.cum + 1 / a.w AS inverse,
         (b.pos - a.pos) - (c.e - c.s) AS gap, a.doc_length
  FROM covers c
  JOIN numbered a ON a.query_id = c.query_id AND a.id = c.id AND a.i = c.s
  JOIN numbered b ON b.query_id = c.query_id AND b.id = c.id AND b.i = c.e),
rated AS (
  SELECT query_id, id,
         (sum(n / inverse / (1 + CASE WHEN gap < 0 THEN (n - 1) // 2 ELSE gap END))
          / ln(any_value(doc_length) + 1))::FLOAT::DOUBLE AS rank
  FROM measured GROUP BY query_id, id)"""

PLACED = """texts AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, id) AS r FROM rated)"""


def text_search(asked: str, method: str) -> str:
    weighted = method == COVER_DENSITY
    return ", ".join([CORPUS, asked, positions(weighted), HITS, method, PLACED])


RANKS = "SELECT query_id, id, round(rank, 6) AS rank FROM rated"
TOP_TEXTS = "SELECT query_id, id, round(rank, 6) AS rank, r FROM texts WHERE r <= 20"
SNIPPET = "CASE WHEN length({0}) >= 500 THEN substr({0}, 1, 500) || '...' ELSE {0} END"


def hybrid(asked: str, vectors: str, method: str) -> str:
    """Unified hybrid search with both weights one half."""
    return f"""WITH {text_search(asked, method)}, {distances(vectors)},
fusion AS (
  SELECT query_id, id, sum(score) AS total_score FROM (
    SELECT query_id, id, 0.5::DOUBLE * (1 - dist / 2) AS score FROM near WHERE r <= 60
    UNION ALL
    SELECT query_id, id, 1::DOUBLE / (60 + r) * 61 * 0.5::DOUBLE FROM texts
    WHERE r <= 60 AND query_id IN (SELECT query_id FROM queryvec)) GROUP BY query_id, id),
best AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total_score DESC, id) AS place FROM fusion)
SELECT b.query_id, b.id, c.title, {SNIPPET.format('c.content')} AS content_snippet,
       round(greatest(0, least(1, b.total_score)) * 100, 6) AS similarity_percent,
       round(b.total_score, 6) AS total_score
FROM best b JOIN corpus c USING (id) WHERE place <= 20"""


def single_mode(ctes: str, source: str, score: str, dist: str, candidates: int = 50, shown: int = 20) -> str:
    return f"""WITH {ctes},
scored_hits AS (SELECT query_id, id, {score} AS total_score, {dist} AS dist FROM {source} WHERE r <= {candidates}),
best AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total_score DESC, id) AS place
  FROM scored_hits)
SELECT b.query_id, b.id, c.title, {SNIPPET.format('c.content')} AS content_snippet,
       round((2 - b.dist) / 2 * 100, 6) AS similarity_percent, round(b.total_score, 6) AS total_score
FROM best b JOIN corpus c USING (id) WHERE place <= {shown}"""


def dispatched() -> str:
    """Each benchmark passage in its own mode: id % 4 = 0 text only, 2 vectors only, else both."""
    return f"""WITH {text_search(BENCHMARK_ROWS, COVER_DENSITY)}, {distances(BENCHMARK_VECTORS)},
setting AS (
  SELECT item_id AS query_id, item_id IN (SELECT query_id FROM queryvec) AND item_id % 4 <> 0 AS by_vector,
         item_id % 4 <> 2 AS by_text, greatest(1, item_id % 30) AS max_hits,
         greatest(0, least(1, (item_id % 11) / 8::DOUBLE - 0.1::DOUBLE)) AS kw FROM benchmark),
part AS (
  SELECT query_id, id, dist, (1 - kw) * (1 - dist / 2) AS score, by_text AS is_unified
  FROM near JOIN setting USING (query_id) WHERE by_vector AND r <= CASE WHEN by_text THEN 60 ELSE 50 END
  UNION ALL
  SELECT query_id, id, NULL, kw * 61 * CASE WHEN by_vector THEN 1::DOUBLE / (60 + r) ELSE 1 / (60 + rank) END,
         by_vector
  FROM texts JOIN setting USING (query_id) WHERE by_text AND r <= CASE WHEN by_vector THEN 60 ELSE 50 END),
fusion AS (
  SELECT query_id, id, sum(score) AS total_score, coalesce(max(dist), 1) AS dist, any_value(is_unified) AS is_unified
  FROM part GROUP BY query_id, id),
best AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total_score DESC, id) AS place FROM fusion)
SELECT b.query_id, b.id, c.title, {SNIPPET.format('c.content')} AS content_snippet,
       round(CASE WHEN is_unified THEN greatest(0, least(1, total_score)) ELSE (2 - dist) / 2 END * 100, 6)
         AS similarity_percent,
       round(total_score, 6) AS total_score
FROM best b JOIN corpus c USING (id) JOIN setting USING (query_id) WHERE place <= max_hits"""


def fusion_parts(k: int) -> str:
    return f"""WITH {text_search(ONE_TEXT_ROW, FREQUENCY)}, {distances(ONE_VECTOR)},
vector_part AS (SELECT id, 0.5::DOUBLE * (1 - dist / 2) AS score, dist FROM near WHERE r <= {k}),
text_part AS (SELECT id, r, 1::DOUBLE / (60 + r) * 61 * 0.5::DOUBLE AS score FROM texts WHERE r <= {k})"""


def letters(text: str) -> str:
    return ", ".join(
        f"(length({text}) - length(replace({text}, '{c}', '')))::INT AS count_{c}" for c in "aez"
    )


SOURCE_CONFIG = """SELECT 'source.' || source AS key, {value}::VARCHAR AS value
  FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE {flag} = 1) USING (doc_id) GROUP BY source"""
TITLE = "split_part(text, chr(10), 1)"
TURN_VECTORS = """SELECT conv_id * 100 + turn AS query_id, embedding AS vec
  FROM conversations JOIN embeddings ON vec_id = conv_id WHERE role = 'user'"""


def confirmed(query: str, title: str, content: str) -> str:
    return f"""CASE WHEN length({query}) > 50 THEN true
  WHEN length({query}) <= 30
    THEN contains(lower({title}), lower({query})) OR contains(lower({content}), lower({query}))
  ELSE len(list_filter(string_split_regex(lower({query}), '\\s+'), lambda w: length(w) > 1
    AND (contains(lower({title}), w) OR contains(lower({content}), w)))) > 0 END"""


def oracle_sql() -> dict[str, str]:
    vector_batch = f"""WITH {CORPUS}, {distances(BENCHMARK_VECTORS)}
SELECT query_id, id, round(dist, 6) AS dist, r FROM near WHERE r <= 20"""
    matches = f"""WITH {CORPUS}, {ALL_TEXT_ROWS}, {positions(False)}, {HITS}
SELECT query_id, id, n_terms FROM matched"""
    cover_ranks = f"WITH {text_search(TEXT_QUERY_ROWS, COVER_DENSITY)} {RANKS}"
    limit = "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 150"
    tags = "list_transform(string_split_regex(trimmed, '\\s+'), lambda w: regexp_replace(w, '^#', ''))"
    token = "string_split(text, ' ')[2]"
    percent = "greatest(0, least(100, (2 - greatest(0, least(2, dist))) / 2 * 100))"
    cut = "text"
    stored = f"SELECT doc_id AS id, {TITLE} AS title, length(text) AS content_length, lang AS namespace, {letters(cut)} FROM documents"
    found = {
        "doc_source_normalised": """SELECT
  CASE WHEN l.quality IS NOT NULL THEN split_part(text, chr(10), 1) ELSE '' END AS title,
  CASE WHEN lang <> 'fr' THEN text ELSE '' END AS text,
  l.quality::VARCHAR AS namespace, source AS contributors
FROM documents d LEFT JOIN labels l USING (doc_id)""",
        "doc_source_split_select": """SELECT '' AS title, text, NULL::VARCHAR AS namespace,
  NULL::VARCHAR AS contributors FROM documents""",
        "doc_source_limit": limit,
        "doc_source_limit_range": """SELECT '' AS title, text, NULL::VARCHAR AS namespace,
  NULL::VARCHAR AS contributors FROM documents ORDER BY doc_id LIMIT 150""",
        "doc_sink_append": f"""SELECT doc_id AS id, {TITLE} AS title, lang AS namespace,
  source AS contributors, 2 AS copies, length(text) AS content_length, 2 AS stamped FROM documents""",
        "doc_count": "SELECT count(*) AS n_documents FROM documents",
        "config_lookup": f"""WITH stored AS ({SOURCE_CONFIG.format(value='max(doc_id)', flag='toxic')})
SELECT k.key, s.value FROM (SELECT DISTINCT 'source.' || source AS key FROM documents) k
LEFT JOIN stored s USING (key)""",
        "config_prefix": f"""WITH stored AS ({SOURCE_CONFIG.format(value='max(doc_id)', flag='quality')})
SELECT key, value FROM stored WHERE key LIKE 'source.src_%'""",
        "config_seed_if_absent": f"""WITH stored AS ({SOURCE_CONFIG.format(value='max(doc_id)', flag='toxic')}),
seeds AS ({SOURCE_CONFIG.format(value='min(doc_id)', flag='quality')})
SELECT key, value FROM stored UNION ALL
SELECT key, value FROM seeds WHERE key NOT IN (SELECT key FROM stored)""",
        "embed_batch": f"""SELECT doc_id AS id, {TITLE} AS title, 26 AS dim, {letters(cut)}
FROM documents""",
        "embed_truncate": """SELECT doc_id, least(length(text), 8192) AS text_length,
  substr(text, 1, 512) AS query_for_embedding, length(text) AS unlimited_length FROM documents""",
        "embed_dimension_check": f"""WITH {CORPUS}
SELECT coalesce(len(embedding), 0)::INT AS dim, count(*) AS n_documents FROM corpus GROUP BY 1""",
        "embed_reused": f"""WITH chosen AS (SELECT min(source) AS source FROM documents),
part AS (
  SELECT 0 AS run, text FROM documents WHERE source = (SELECT source FROM chosen)
  UNION ALL SELECT 1, text FROM documents UNION ALL SELECT 2, text FROM documents),
firsts AS (SELECT text, min(run) AS run FROM part GROUP BY text),
made AS (SELECT run, count(*) AS n FROM firsts GROUP BY run),
counted AS (SELECT run, text, {letters('text')} FROM part)
SELECT c.run, coalesce(any_value(m.n), 0) AS n_embedded, count(*) AS n_vectors, sum(count_a)::BIGINT AS sum_a,
       sum(count_e)::BIGINT AS sum_e, sum(count_z)::BIGINT AS sum_z
FROM counted c LEFT JOIN made m USING (run) GROUP BY c.run""",
        "embed_distinct_queries": f"""SELECT doc_id AS query_id, {letters('text')}
FROM documents""",
        "vector_topk": f"""WITH {CORPUS}, {distances(ONE_VECTOR)}
SELECT c.id, c.title, length(c.content) AS content_length, round(n.dist, 6) AS dist
FROM near n JOIN corpus c USING (id) WHERE r <= 20""",
        "vector_topk_batch": vector_batch,
        "vector_topk_batch_blocks": vector_batch,
        "vector_ivf_search": vector_batch,
        "vector_ivf_search_blocks": vector_batch,
        "vector_ivf_recall": f"""WITH {CORPUS}, {distances(BENCHMARK_VECTORS)}
SELECT count(*) AS n_hits, true AS nine_in_ten_found FROM near WHERE r <= 20""",
        "similarity_percent": f"""WITH {CORPUS}, {distances(ONE_VECTOR)},
placed AS (SELECT c.id, n.dist, coalesce({percent}, 0) AS percent FROM corpus c LEFT JOIN near n USING (id))
SELECT id, round(dist, 6) AS dist, round(percent, 6) AS percent,
       format('{{:.1f}}', round(percent, 6)) AS shown FROM placed""",
        "tokenise_simple": f"""WITH {CORPUS}, {positions(False)}
SELECT id, len(tokens)::INT AS n_tokens, array_to_string(tokens, ' ') AS words FROM words""",
        "postings_build": f"""WITH {CORPUS}, {positions(True)}
SELECT lexeme, id, CASE WHEN w = 1 THEN 'title' ELSE 'content' END AS field,
       string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions
FROM occurrence GROUP BY lexeme, id, w""",
        "postings_weighted": f"""WITH {CORPUS}, {positions(True)}
SELECT id, CASE WHEN w = 1 THEN 'A' ELSE 'D' END AS weight, max(doc_length) AS doc_length,
       count(DISTINCT lexeme) AS n_lexemes, count(*) AS n_positions, max(pos)::INT AS last_position
FROM occurrence GROUP BY id, w""",
        "postings_backfill": f"""WITH {CORPUS}, {positions(True)}
SELECT id, max(doc_length) AS doc_length, count(*) AS n_positions FROM occurrence GROUP BY id""",
        "fts_match_all": matches,
        "fts_match_all_indexed": matches,
        "fts_match_all_spaces": spaced(f"""WITH {CORPUS}, {TEXT_QUERY_ROWS}, {positions(False)}, {HITS}
SELECT query_id, id, n_terms FROM matched"""),
        "fts_rank_single": f"WITH {text_search(TEXT_QUERY_ROWS, FREQUENCY)} {RANKS} "
        "WHERE query_id IN (SELECT query_id FROM terms WHERE n_terms = 1)",
        "fts_rank_and": f"WITH {text_search(TEXT_QUERY_ROWS, FREQUENCY)} {RANKS} "
        "WHERE query_id IN (SELECT query_id FROM terms WHERE n_terms > 1)",
        "fts_rank_cd": cover_ranks,
        "fts_rank_cd_indexed": cover_ranks,
        "fts_topk": f"WITH {text_search(TEXT_QUERY_ROWS, COVER_DENSITY)} {TOP_TEXTS}",
        "fts_topk_scan": f"WITH {text_search(TEXT_QUERY_ROWS, FREQUENCY)} {TOP_TEXTS}",
        "fts_topk_batch": f"WITH {text_search(BENCHMARK_ROWS, COVER_DENSITY)} {TOP_TEXTS}",
        "fts_topk_batch_scan": f"WITH {text_search(BENCHMARK_ROWS, FREQUENCY)} {TOP_TEXTS}",
        "rrf_score": fusion_parts(60) + " SELECT id, r, round(score, 6) AS score FROM text_part",
        "fusion_union_sum": fusion_parts(60)
        + """ SELECT id, round(sum(score), 6) AS total_score
FROM (SELECT id, score FROM vector_part UNION ALL SELECT id, score FROM text_part) GROUP BY id""",
        "hybrid_merge_outer": fusion_parts(50)
        + """ SELECT id, round(coalesce(v.score, 0) + coalesce(t.score, 0), 6) AS total_score,
  round(coalesce(v.dist, 1), 6) AS dist FROM vector_part v FULL OUTER JOIN text_part t USING (id)""",
        "hybrid_unified": hybrid(ONE_TEXT_ROW, ONE_VECTOR, FREQUENCY),
        "hybrid_unified_indexed": hybrid(ONE_TEXT_ROW, ONE_VECTOR, COVER_DENSITY),
        "hybrid_unified_batch": hybrid(BENCHMARK_ROWS, BENCHMARK_VECTORS, COVER_DENSITY),
        "hybrid_mode_dispatch": dispatched(),
        "hybrid_vector_only": single_mode(
            f"{CORPUS}, {distances(BENCHMARK_VECTORS)}", "near", "0.5::DOUBLE * ((2 - dist) / 2)", "dist"
        ),
        "hybrid_text_only": single_mode(
            text_search(ONE_TEXT_ROW, FREQUENCY), "texts", "0.5::DOUBLE * (1 / (60 + rank)) * 61", "1::DOUBLE"
        ),
        "hybrid_vector_only_100": single_mode(
            f"{CORPUS}, {distances(BENCHMARK_VECTORS)}", "near", "0.5::DOUBLE * ((2 - dist) / 2)", "dist", 100, 100
        ),
        "hybrid_text_only_100": single_mode(
            text_search(ONE_TEXT_ROW, FREQUENCY), "texts", "0.5::DOUBLE * (1 / (60 + rank)) * 61", "1::DOUBLE", 100, 100
        ),
        "hybrid_text_only_position": single_mode(
            text_search(ONE_TEXT_ROW, FREQUENCY), "texts", "1::DOUBLE / (60 + r) * 61 * 0.5::DOUBLE", "1::DOUBLE"
        ),
        "semantic_search": f"""WITH {CORPUS}, {distances(TURN_VECTORS)},
turns AS (
  SELECT conv_id * 100 + turn AS query_id, regexp_replace(text, '{TRIM}', '', 'g') AS q
  FROM conversations WHERE role = 'user')
SELECT n.query_id, n.id, c.title,
       CASE WHEN length(c.content) <= 500 THEN c.content
            ELSE substr(c.content, 1, 500) || '...' END AS content_snippet,
       round((2 - n.dist) / 2 * 100, 6) AS similarity_percent
FROM near n JOIN corpus c USING (id) JOIN turns t USING (query_id)
WHERE n.r <= 20 AND (2 - n.dist) / 2 * 100 >= 55 AND {confirmed('t.q', 'c.title', 'c.content')}""",
        "lexical_confirm_filter": f"""WITH sentences AS (
  SELECT conv_id, turn, unnest(parts) AS query, generate_subscripts(parts, 1) - 1 AS sentence
  FROM (SELECT conv_id, turn, string_split_regex(text, '[.]\\s*') AS parts FROM conversations)),
trimmed AS (SELECT *, regexp_replace(query, '{TRIM}', '', 'g') AS q FROM sentences)
SELECT conv_id, turn, sentence::INT AS sentence, query
FROM trimmed JOIN documents ON doc_id = conv_id
WHERE q <> '' AND {confirmed('q', TITLE, 'text')}""",
        "param_clamp": """SELECT conv_id, turn, greatest(1, least(100, length(text) - 100))::INT AS max_hits,
  round(greatest(0, least(1, length(text) / 200.0::DOUBLE - 0.5::DOUBLE)), 6) AS keyword_weight
FROM conversations""",
        "keyword_tokens": f"""WITH cleaned AS (
  SELECT conv_id, turn,
         regexp_replace(' \t#' || replace(text, ', ', ' ## #') || '　', '{TRIM}', '', 'g') AS trimmed
  FROM conversations),
listed AS (
  SELECT conv_id, turn, list_filter({tags}, lambda w: w <> '') AS tokens FROM cleaned),
numbered AS (
  SELECT conv_id, turn, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM listed),
firsts AS (SELECT conv_id, turn, token, min(i) AS i FROM numbered GROUP BY conv_id, turn, token)
SELECT conv_id, turn, string_agg(token, '|' ORDER BY i) AS tokens FROM firsts GROUP BY conv_id, turn""",
        "query_remove_token": f"""SELECT conv_id, turn,
  CASE WHEN len(string_split(text, ' ')) < 2 OR {token} = '' THEN text ELSE
  trim(regexp_replace(regexp_replace(text, '\\s*' || regexp_escape({token}) || '\\s*', ' ', 'g'),
                      '\\s+', ' ', 'g')) END AS query
FROM conversations""",
        "snippet_plain": """SELECT doc_id, CASE WHEN length(text) <= 500 THEN text
  ELSE substr(text, 1, 500) || '...' END AS snippet FROM documents""",
        "snippet_hybrid": f"SELECT doc_id, {SNIPPET.format('text')} AS snippet FROM documents",
        "humanise_count": """WITH counted AS (SELECT doc_id, n_chars * (doc_id + 1) AS n FROM documents)
SELECT doc_id, CASE
  WHEN n >= 1000000 THEN ((n + 50000) // 1000000)::VARCHAR || '.' || ((n + 50000) // 100000 % 10)::VARCHAR || 'M'
  WHEN n >= 1000 THEN ((n + 50) // 1000)::VARCHAR || '.' || ((n + 50) // 100 % 10)::VARCHAR || 'k'
  ELSE n::VARCHAR END AS shown FROM counted""",
        "ingest_totals": "SELECT count(*) AS rows_read, count(*) AS inserted FROM documents",
        "ingest_batch": stored,
        "stream_ingest": stored,
        "ingest_claimed_ids": """SELECT 2 * count(*) AS n_documents, 2 * count(*) AS n_ids,
  (2 * sum(length(text)))::BIGINT AS content_length FROM documents""",
        "run_history": """WITH best AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
part AS (
  SELECT CASE WHEN quality IS NULL THEN 2 WHEN quality = 1 THEN 0 ELSE 1 END AS batch_id
  FROM documents LEFT JOIN best USING (doc_id)),
counted AS (SELECT batch_id, count(*) AS n FROM part GROUP BY batch_id)
SELECT batch_id::BIGINT AS batch_id, (sum(n) OVER (ORDER BY batch_id))::BIGINT AS rows_read,
       (sum(n) OVER (ORDER BY batch_id))::BIGINT AS inserted FROM counted""",
        "run_status_failed": """SELECT 'ERROR' AS status, '오류' AS label, count(*) AS rows_read,
       count(*) AS inserted, true AS failed
FROM documents SEMI JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1) USING (doc_id)""",
        "run_status_reset": """SELECT 'IDLE' AS status, '대기' AS label, 0::BIGINT AS rows_read, 0::BIGINT AS inserted,
       false AS failed, count(*) AS n_documents FROM documents""",
        "millis_to_instant": """SELECT doc_id, strftime(epoch_ms(doc_id * 86400000 + n_chars), '%Y-%m-%d %H:%M:%S.%g') AS at
FROM documents""",
        "run_status": """SELECT 'DONE' AS status, '완료' AS label, count(*) AS rows_read, count(*) AS inserted,
       NULL::VARCHAR AS error_message FROM documents""",
    }
    # without a stored index the words are ranked by frequency
    found["stream_ingest_postings"] = found["postings_build"]
    found["doc_source_local_path"] = found["doc_source_split_select"]
    found["semantic_search_signed"] = found["semantic_search"]
    by_text = {
        "stream_ingest_search": vector_batch,
        "stream_ingest_hybrid": hybrid(BENCHMARK_ROWS, BENCHMARK_VECTORS, COVER_DENSITY),
        "semantic_search_text": found["semantic_search"],
        "hybrid_search_text": hybrid(BENCHMARK_ROWS, BENCHMARK_VECTORS, FREQUENCY),
    }
    return found | {name: on_letters(sql) for name, sql in by_text.items()}


def spaced(sql: str) -> str:
    """A text search whose words are what spaces part."""
    return sql.replace(r"'[^\p{L}\p{N}]+'", r"'[\s\x1c-\x1f\p{Z}]+'")


def on_letters(sql: str) -> str:
    """A search over given vectors as one over letter counts of documents and query texts."""
    turns = f"""SELECT conv_id * 100 + turn AS query_id, {letter_vector('text')} AS vec
  FROM conversations WHERE role = 'user' AND regexp_matches(text, '[a-z]')"""
    passages = f"SELECT item_id AS query_id, {letter_vector('text')} AS vec FROM benchmark WHERE regexp_matches(text, '[a-z]')"
    return sql.replace(CORPUS, LETTER_CORPUS).replace(TURN_VECTORS, turns).replace(BENCHMARK_VECTORS, passages)
