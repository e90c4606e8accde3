"""The expected result of each registered query, as one DuckDB statement each.

The statements are written from the definitions, not from the Spark plans:
brute-force distances over all pairs, sequential string tests, plain windows.
"""

from __future__ import annotations

from shelfmark.checks.fixtures import DUCK_CATALOG, DUCK_SEARCHES
from shelfmark.checks.registry import (
    BUCKET,
    CELLS,
    DIM,
    EXTRA_BUCKETS,
    FETCH,
    PQ,
    LEAVES,
    PROBES,
    SAMPLE,
    SMALL_FETCH,
    STEPS,
    K,
)
from shelfmark.operators import lsh
from shelfmark.options import HybridWeights, LshOptions, StoreSearchOptions
from shelfmark.plans.taxonomy import STARTER_CATEGORIES

ORACLE: dict[str, str] = {}

# RE2 spellings of the patterns.
SPACE = r"\s\p{Z}\x0b\x1c-\x1f\x85"
SPACES = f"[{SPACE}]+"
NOT_KEPT = rf"""[^\p{{L}}\p{{N}}_{SPACE}.,;:!?()\[\]{{}}"'-]""".replace("'", "''")
NUMBER = r"(\d+(?:\.\d+)?)"
GAP = f"[{SPACE}]*"
RANGE = rf"\${NUMBER}{GAP}-{GAP}\$?{NUMBER}"
UPPER = rf"(?i)(?:under|less than|below|cheaper than|at most|no more than){GAP}\$?{NUMBER}"
LOWER = (
    rf"(?i)(?:over|more than|above|at least|exceeding|min|minimum|starting at){GAP}\$?{NUMBER}"
)
BRAND = rf"brand:?{GAP}([a-zA-Z0-9_{SPACE}]+)"
RATING = rf"{NUMBER}\+?{GAP}stars?"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SPACES}'), lambda w: w <> '')"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACES}|{SPACES}$', '', 'g')"


def cut(text: str, pattern: str) -> str:
    return strip(f"regexp_replace({text}, '{pattern}', '', 'g')")


def number(text: str, pattern: str, group: int = 1) -> str:
    return f"CAST(nullif(regexp_extract({text}, '{pattern}', {group}), '') AS DOUBLE)"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


def price(text: str) -> str:
    bare = f"regexp_replace({text}, '[$,]', '', 'g')"
    shape = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    return f"CASE WHEN {has(bare, shape)} THEN TRY_CAST(trim({bare}) AS DOUBLE) END"


def special_free(text: str) -> str:
    return f"regexp_replace({text}, '{NOT_KEPT}', '', 'g')"


def squared(left: str, right: str) -> str:
    pair = "(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))"
    return f"list_sum(list_transform(list_zip({left}, {right}), lambda p: {pair} * {pair}))"


def statement(parts: dict[str, str], final: str) -> str:
    named = ",\n".join(f"{name} AS MATERIALIZED (\n{text}\n)" for name, text in parts.items())
    return f"WITH {named}\n{final}" if parts else final


# Common parts

RAW = {"catalog": DUCK_CATALOG}
PRODUCTS = {**RAW, "products": f"SELECT * REPLACE ({price('price')} AS price) FROM catalog"}
SEARCHES = {"searches": DUCK_SEARCHES}
VECTORS = {
    "vectors": "SELECT vec_id AS product_id, embedding, CAST(label AS BIGINT) AS cell FROM embeddings"
}
ASKED = {
    **SEARCHES,
    **VECTORS,
    "asked": """SELECT s.query_id, s.query_text, e.embedding
FROM searches s JOIN embeddings e ON e.vec_id = s.query_id % (SELECT count(*) FROM embeddings)""",
}


def ranked_pairs(cost: str, limit: int, source: str, order: str = "cost") -> str:
    return f"""SELECT query_id, product_id, cost FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, product_id) AS nth
  FROM (SELECT q.query_id, v.product_id, {cost} AS cost FROM {source})
) WHERE nth <= {limit}"""


def nearest(limit: int) -> dict[str, str]:
    found = ranked_pairs(squared("q.embedding", "v.embedding"), limit, "asked q, vectors v")
    return {**ASKED, "found": found}


NEIGHBOURS = "SELECT query_id, product_id, round(cost, 6) AS distance FROM found"

HINTS = f"""SELECT query_id, query_text,
  {number('query_text', RANGE, 1)} AS min_price, {number('query_text', RANGE, 2)} AS max_price,
  CASE WHEN {has('lower(query_text)', BRAND)}
       THEN {strip(f"regexp_extract(lower(query_text), '{BRAND}', 1)")} END AS brand_hint,
  {number('lower(query_text)', RATING)} AS min_rating
FROM searches"""

CANDIDATES = {
    **PRODUCTS,
    **nearest(FETCH),
    "hints": HINTS,
    "candidates": """SELECT f.query_id, f.cost AS distance, p.*, h.query_text,
  h.min_price, h.max_price, h.brand_hint, h.min_rating
FROM found f JOIN products p USING (product_id) JOIN hints h USING (query_id)""",
}

TAXONOMY = "SELECT * FROM (VALUES\n" + ",\n".join(
    f"({at}, '{category}', {place}, '{keyword}', {len(keyword.split())})"
    for at, (category, keywords) in enumerate(STARTER_CATEGORIES.items())
    for place, keyword in enumerate(keywords)
) + ") AS t(cat_pos, category, kw_pos, keyword, n_words)"

DETECTED = {
    "taxonomy": TAXONOMY,
    "detected": f"""SELECT s.query_id, t.* FROM (
  SELECT query_id, lower(query_text) AS text, {words('lower(query_text)')} AS tokens FROM searches
) s, taxonomy t
WHERE contains(s.text, t.keyword)
  AND (list_contains(s.tokens, t.keyword) OR list_contains(s.tokens, t.keyword || 's')
       OR starts_with(s.text, t.keyword || ' ') OR ends_with(s.text, ' ' || t.keyword))""",
    "chosen": """SELECT query_id, max(category) FILTER (nth = 1) AS primary_category,
  max(category) FILTER (nth = 2) AS secondary_category
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_words DESC, cat_pos, kw_pos) AS nth
      FROM detected)
GROUP BY query_id""",
}


def scored(source: str) -> dict[str, str]:
    """Category score of each candidate, and the candidates the category keeps."""
    return {
        "worded": f"""SELECT product_id, text, {words("text")} AS tokens
FROM (SELECT DISTINCT product_id, lower(coalesce(title, '')) AS text FROM {source})""",
        "titled": f"""SELECT c.query_id, c.product_id, c.distance, w.text, w.tokens
FROM {source} c JOIN worded w USING (product_id)""",
        "pairs": """SELECT c.*, t.keyword, t.category = h.primary_category AS first_choice
FROM titled c JOIN chosen h USING (query_id)
JOIN taxonomy t ON t.category = h.primary_category OR t.category = h.secondary_category
WHERE contains(c.text, t.keyword)""",
        "summed": """SELECT query_id, product_id,
  sum(CASE WHEN first_choice THEN
      CASE WHEN list_contains(tokens, keyword) OR list_contains(tokens, keyword || 's')
           THEN 3 ELSE 1 END END) AS category_score,
  bool_or(NOT first_choice) AS second
FROM pairs GROUP BY query_id, product_id""",
        "scored": """SELECT c.query_id, c.product_id, c.distance,
  coalesce(s.category_score, 0) AS category_score, coalesce(s.second, false) AS second
FROM titled c LEFT JOIN summed s USING (query_id, product_id)""",
        "kept": """SELECT * FROM (
  SELECT *, bool_or(category_score > 0) OVER (PARTITION BY query_id) AS any_first,
            bool_or(second) OVER (PARTITION BY query_id) AS any_second FROM scored)
WHERE CASE WHEN any_first THEN category_score > 0 WHEN any_second THEN second ELSE true END""",
    }


# Sources and sinks

ORACLE["csv_texts"] = """SELECT doc_id + 9007199254740993 AS product_id, nullif(text, '') AS title
FROM documents"""
ORACLE["fmt_decimals"] = """SELECT l_orderkey, l_linenumber,
  printf('$%.2f', l_extendedprice * 0.0625) AS price_label,
  printf('%.1f ★', l_extendedprice * 0.0625 / 1000) AS stars_label
FROM lineitem"""
ORACLE["csv_roundtrip"] = statement(RAW, "SELECT * FROM catalog")
ORACLE["union_scan"] = statement(RAW, "SELECT * FROM catalog")
ORACLE["fallback_scan"] = statement(RAW, "SELECT asin, title, price FROM catalog")
FIRST_ASIN = """SELECT * EXCLUDE (nth) FROM (
  SELECT *, row_number() OVER (PARTITION BY asin ORDER BY product_id) AS nth FROM catalog)
WHERE nth = 1"""
ORACLE["landed_catalog"] = statement(
    {**RAW, "first": FIRST_ASIN}, "SELECT product_id, asin, title FROM first"
)
ORACLE["embedding_scan"] = """SELECT vec_id AS product_id, CAST(pos - 1 AS INTEGER) AS pos,
  CAST(embedding[pos] AS DOUBLE) AS value
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)"""
ORACLE["index_metadata"] = f"""SELECT 'IVF' AS index_type, CAST(max(len(embedding)) AS INTEGER) AS dimension,
  count(*) AS num_vectors, 'l2' AS metric, CAST({CELLS} AS INTEGER) AS nlist,
  CAST({PROBES} AS INTEGER) AS nprobe FROM embeddings"""

# Cleaning

ORACLE["validate_catalog"] = statement(
    RAW,
    "SELECT '' AS missing_columns, count(*) = 0 AS is_empty, count(*) > 0 AS is_valid FROM catalog",
)
ORACLE["dedup_asin"] = statement(
    {**RAW, "first": FIRST_ASIN}, "SELECT product_id, asin FROM first"
)
UNIQUE = {
    **RAW,
    "first": FIRST_ASIN,
    "uniq": """SELECT * EXCLUDE (nth) FROM (
  SELECT *, row_number() OVER (PARTITION BY title ORDER BY product_id) AS nth FROM first)
WHERE nth = 1""",
}
ORACLE["dedup_title"] = statement(UNIQUE, "SELECT product_id, asin, title FROM uniq")
ORACLE["dedup_documents"] = "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text"
ORACLE["drop_null_critical"] = statement(
    RAW,
    """SELECT product_id, price FROM catalog
WHERE asin IS NOT NULL AND title IS NOT NULL AND price IS NOT NULL""",
)
ORACLE["fill_defaults"] = statement(
    RAW,
    "SELECT product_id, coalesce(reviews, 0) AS reviews, coalesce(stars, 0) AS stars FROM catalog",
)
ORACLE["parse_price"] = statement(
    RAW, f"SELECT product_id, price AS price_text, {price('price')} AS price FROM catalog"
)
ORACLE["median_impute"] = statement(
    {
        **RAW,
        "parsed": f"SELECT product_id, {price('price')} AS p FROM catalog WHERE price IS NOT NULL",
    },
    "SELECT product_id, coalesce(p, (SELECT median(p) FROM parsed)) AS price FROM parsed",
)
ORACLE["normalize_text"] = "SELECT doc_id, lower(text) AS text FROM documents"
ORACLE["strip_special"] = f"SELECT doc_id, {special_free('text')} AS text FROM documents"
ORACLE["truncate_tokens"] = (
    f"SELECT doc_id, array_to_string({words('text')}[1:512], ' ') AS text FROM documents"
)
ORACLE["clean_stats"] = statement(
    {
        **UNIQUE,
        "sizes": """SELECT (SELECT count(*) FROM catalog) AS original,
  (SELECT count(*) FROM uniq) AS uniques,
  (SELECT count(*) FROM uniq WHERE asin IS NOT NULL AND title IS NOT NULL AND price IS NOT NULL) AS final""",
    },
    """SELECT original AS original_rows, 11 AS original_columns,
  original - uniques AS duplicate_rows_removed, uniques - final AS missing_rows_removed,
  'title' AS columns_cleaned, final AS final_rows, 11 AS final_columns,
  original - final AS rows_removed, round(final / original * 100, 2) AS percent_data_retained
FROM sizes""",
)


def cleaned(
    dedup: bool = True, missing: bool = True, normalize: bool = True, special: bool = True
) -> dict[str, str]:
    parts = dict(UNIQUE) if dedup else dict(RAW)
    rows = "uniq" if dedup else "catalog"
    title = "lower(title)" if normalize else "title"
    title = special_free(title) if special else title
    if missing:
        parts["complete"] = f"""SELECT * REPLACE ({price('price')} AS price) FROM {rows}
WHERE asin IS NOT NULL AND title IS NOT NULL AND price IS NOT NULL"""
        parts["cleaned"] = f"""SELECT * REPLACE (
  coalesce(price, (SELECT median(price) FROM complete)) AS price, {title} AS title,
  coalesce(reviews, 0) AS reviews, coalesce(stars, 0) AS stars) FROM complete"""
    else:
        parts["cleaned"] = (
            f"SELECT * REPLACE ({price('price')} AS price, {title} AS title) FROM {rows}"
        )
    return parts


ORACLE["clean_catalog"] = statement(cleaned(), "SELECT * FROM cleaned")
ORACLE["clean_no_dedup"] = statement(cleaned(dedup=False), "SELECT * FROM cleaned")
ORACLE["clean_no_missing"] = statement(cleaned(missing=False), "SELECT * FROM cleaned")
ORACLE["clean_no_normalize"] = statement(cleaned(normalize=False), "SELECT * FROM cleaned")
ORACLE["clean_no_special"] = statement(cleaned(special=False), "SELECT * FROM cleaned")

TAGGED = "title || ' category:' || coalesce(CAST(category_id AS VARCHAR), 'nan')"
EMBEDDED = f"array_to_string({words(TAGGED)}[1:512], ' ') AS embedding_text"
ORACLE["embedding_text"] = statement(RAW, f"SELECT product_id, {EMBEDDED} FROM catalog")
ORACLE["prepare_embeddings"] = statement(
    cleaned(), f"SELECT product_id, title, {EMBEDDED} FROM cleaned"
)
ORACLE["catalog_build"] = statement(cleaned(), f"SELECT *, {EMBEDDED} FROM cleaned")

# Embeddings


def bucket(word: str) -> str:
    return f"CAST('0x' || substr(md5({word}), 1, 8) AS BIGINT) % {DIM}"


ORACLE["hashed_embeddings"] = f"""SELECT doc_id, CAST(b AS INTEGER) AS pos, CAST(count(*) AS DOUBLE) AS value
FROM (SELECT doc_id, {bucket('word')} AS b
      FROM (SELECT doc_id, unnest({words('text')}) AS word FROM documents))
GROUP BY doc_id, b"""
ORACLE["encode_udf"] = " UNION ALL ".join(
    f"""SELECT doc_id, CAST({at} AS INTEGER) AS pos,
  CAST(length(text) - length(replace(text, '{letter}', '')) AS DOUBLE) AS value FROM documents"""
    for at, letter in enumerate("abcde")
)
ORACLE["embedding_summary"] = """SELECT CAST(max(len(embedding)) AS INTEGER) AS embedding_dim,
  count(*) AS num_products, CAST(32 AS INTEGER) AS batch_size, 'embedding_text' AS input_column
FROM embeddings"""
ORACLE["sample_rows"] = statement(
    RAW,
    f"""SELECT product_id, title FROM catalog
ORDER BY md5(CAST(product_id AS VARCHAR) || ':42'), product_id LIMIT {SAMPLE}""",
)

# Nearest neighbours

ORACLE["knn_l2"] = statement(nearest(K), NEIGHBOURS)
ORACLE["knn_blocks"] = ORACLE["knn_l2"]
ORACLE["ivf_probe_all"] = ORACLE["knn_l2"]
DOT = (
    "list_sum(list_transform(list_zip(q.embedding, v.embedding),"
    " lambda p: CAST(p[1] AS DOUBLE) * CAST(CAST(p[2] * (v.cell + 1) AS FLOAT) AS DOUBLE)))"
)
ORACLE["knn_ip"] = statement(
    {**ASKED, "found": ranked_pairs(DOT, K, "asked q, vectors v", "cost DESC")},
    "SELECT query_id, product_id, round(cost, 6) AS similarity FROM found",
)
ORACLE["knn_batch"] = statement(
    {
        **VECTORS,
        "asked": f"""SELECT product_id AS query_id, embedding FROM vectors
ORDER BY md5(CAST(product_id AS VARCHAR) || ':42'), product_id LIMIT {SAMPLE}""",
        "found": ranked_pairs(squared("q.embedding", "v.embedding"), K, "asked q, vectors v"),
    },
    NEIGHBOURS,
)
ORACLE["knn_overfetch"] = statement(
    nearest(200 * K),
    """SELECT query_id, count(*) AS candidates, round(max(cost), 6) AS farthest
FROM found GROUP BY query_id""",
)
ORACLE["candidate_join"] = statement(
    {**PRODUCTS, **nearest(K)},
    """SELECT query_id, product_id, title, price, round(cost, 6) AS distance
FROM found JOIN products USING (product_id)""",
)

ELEMENTS = {
    **VECTORS,
    "elements": """SELECT product_id, cell, pos - 1 AS pos, CAST(embedding[pos] AS DOUBLE) AS x
FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS pos FROM vectors)""",
    "centres": """SELECT cell, pos, CAST(CAST(avg(x) AS FLOAT) AS DOUBLE) AS c
FROM elements GROUP BY cell, pos""",
    "centroids": "SELECT cell, list(c ORDER BY pos) AS centre FROM centres GROUP BY cell",
}
ORACLE["ivf_label_cells"] = statement(
    ELEMENTS, "SELECT cell, CAST(pos AS INTEGER) AS pos, round(c, 6) AS value FROM centres"
)
ORACLE["ivf_label_assign"] = statement(
    ELEMENTS,
    f"""SELECT product_id, cell FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY d, cell) AS nth FROM (
    SELECT v.product_id, c.cell, {squared('v.embedding', 'c.centre')} AS d
    FROM vectors v, centroids c))
WHERE nth = 1""",
)
ORACLE["ivf_probe"] = statement(
    {
        **ASKED,
        **ELEMENTS,
        "probed": f"""SELECT query_id, cell FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, cell) AS nth FROM (
    SELECT q.query_id, c.cell, {squared('q.embedding', 'c.centre')} AS d
    FROM asked q, centroids c))
WHERE nth <= {PROBES}""",
        "found": ranked_pairs(
            squared("q.embedding", "v.embedding"),
            K,
            "asked q JOIN probed p USING (query_id) JOIN vectors v ON v.cell = p.cell",
        ),
    },
    NEIGHBOURS,
)
ORACLE["ivf_roundtrip"] = ORACLE["ivf_probe"]

LEAF_CENTRES = {
    **ELEMENTS,
    "leaf_centres": f"""SELECT cell * {LEAVES} + product_id % {LEAVES} AS leaf, pos, CAST(avg(x) AS FLOAT) AS c
FROM elements GROUP BY leaf, pos""",
    "leaves": f"SELECT leaf, leaf // {LEAVES} AS cell, list(c ORDER BY pos) AS centre FROM leaf_centres GROUP BY leaf",
}


def nearest_few(key: str, cell: str, cost: str, source: str, few: int) -> str:
    return f"""SELECT {key}, {cell} FROM (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY d, {cell}) AS nth FROM (
    SELECT {key}, {cell}, {cost} AS d FROM {source}))
WHERE nth <= {few}"""


ORACLE["ivf_tree_label"] = statement(
    {
        **ASKED,
        **LEAF_CENTRES,
        "kept": nearest_few("query_id", "cell", squared("embedding", "centre"), "asked, centroids", PROBES),
        "probed": nearest_few(
            "query_id", "leaf", squared("embedding", "centre"),
            "asked JOIN kept USING (query_id) JOIN leaves USING (cell)", 2 * PROBES,
        ),
        "found": ranked_pairs(
            squared("q.embedding", "v.embedding"),
            K,
            f"""asked q JOIN probed p USING (query_id)
JOIN vectors v ON v.cell * {LEAVES} + v.product_id % {LEAVES} = p.leaf""",
        ),
    },
    NEIGHBOURS,
)
ORACLE["ivf_tree_assign"] = statement(
    {
        **LEAF_CENTRES,
        "bare": "SELECT product_id, embedding FROM vectors",
        "kept": nearest_few("product_id", "cell", squared("embedding", "centre"), "bare, centroids", 1),
        "found": nearest_few(
            "product_id", "leaf", squared("embedding", "centre"),
            "bare JOIN kept USING (product_id) JOIN leaves USING (cell)", 1,
        ),
    },
    "SELECT product_id, leaf AS cell FROM found",
)


def product(left: str, right: str) -> str:
    pair = "CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)"
    return f"list_sum(list_transform(list_zip({left}, {right}), lambda p: {pair}))"


SCALED = """SELECT vec_id AS product_id, CAST(label AS BIGINT) AS cell,
  list_transform(embedding, lambda x: CAST(x * (label + 1) AS FLOAT)) AS embedding FROM embeddings"""
BEST_CELL = f"""SELECT product_id, cell, embedding FROM (
  SELECT v.product_id, v.embedding, c.cell, row_number() OVER (
    PARTITION BY v.product_id ORDER BY {product('v.embedding', 'c.centre')} DESC, c.cell) AS nth
  FROM vectors v, centroids c)
WHERE nth = 1"""
ORACLE["ivf_probe_ip"] = statement(
    {
        **ASKED,
        **ELEMENTS,
        "vectors": SCALED,
        "assigned": BEST_CELL,
        "probed": f"""SELECT query_id, cell FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, cell) AS nth FROM (
    SELECT q.query_id, c.cell, {product('q.embedding', 'c.centre')} AS d
    FROM asked q, centroids c))
WHERE nth <= {PROBES}""",
        "found": ranked_pairs(
            product("q.embedding", "v.embedding"),
            K,
            "asked q JOIN probed p USING (query_id) JOIN assigned v ON v.cell = p.cell",
            "cost DESC",
        ),
    },
    "SELECT query_id, product_id, round(cost, 6) AS similarity FROM found",
)

BUCKETED = f"CAST(floor(list_sum(list_transform(list_zip(v.embedding, c.centre), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / {BUCKET}) AS BIGINT)"
ORACLE["lsh_label_buckets"] = statement(
    ELEMENTS,
    f"""SELECT product_id, CAST(c.cell AS INTEGER) AS line, {BUCKETED} AS bucket
FROM vectors v, centroids c""",
)
ORACLE["lsh_label_knn"] = statement(
    {
        **ASKED,
        **ELEMENTS,
        "buckets": f"""SELECT product_id, c.cell AS line, {BUCKETED} AS bucket
FROM vectors v, centroids c""",
        "asked_buckets": f"""SELECT query_id, c.cell AS line, {BUCKETED} AS bucket
FROM asked v, centroids c""",
        "near": """SELECT DISTINCT a.query_id, b.product_id
FROM asked_buckets a JOIN buckets b ON a.line = b.line AND a.bucket = b.bucket""",
        "found": ranked_pairs(
            squared("q.embedding", "v.embedding"),
            K,
            "asked q JOIN near n USING (query_id) JOIN vectors v ON v.product_id = n.product_id",
        ),
    },
    NEIGHBOURS,
)

CODED = {
    **ELEMENTS,
    "codes": f"""SELECT product_id, subspace, code FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id, subspace ORDER BY d, code) AS nth FROM (
    SELECT e.product_id, e.pos // {DIM // 8} AS subspace, c.cell AS code,
           sum((e.x - c.c) * (e.x - c.c)) AS d
    FROM elements e JOIN centres c ON e.pos = c.pos
    GROUP BY e.product_id, subspace, code))
WHERE nth = 1""",
}
ORACLE["pq_label_codes"] = statement(
    CODED,
    "SELECT product_id, CAST(subspace AS INTEGER) AS subspace, CAST(code AS INTEGER) AS code FROM codes",
)
ORACLE["pq_label_knn"] = statement(
    {
        **ASKED,
        **CODED,
        "decoded": f"""SELECT product_id, list(c.c ORDER BY c.pos) AS embedding
FROM codes k JOIN centres c ON c.cell = k.code AND c.pos // {DIM // 8} = k.subspace
GROUP BY product_id""",
        "found": ranked_pairs(squared("q.embedding", "v.embedding"), K, "asked q, decoded v"),
    },
    NEIGHBOURS,
)



def first_vectors(number: int, source: str = "vectors") -> str:
    return f"""SELECT product_id, embedding FROM {source}
ORDER BY md5(CAST(product_id AS VARCHAR) || ':42'), product_id LIMIT {number}"""


def trained(steps: int, number: int, rows: str, width: int) -> dict[str, str]:
    """Centres after some steps of k-means in every slice of ``width`` components; the parts end in ``trained``."""
    parts = {
        "trained_on": f"SELECT e.* FROM elements e JOIN ({rows}) USING (product_id)",
        "centres_0": f"""SELECT row_number() OVER (PARTITION BY e.pos ORDER BY e.product_id) - 1 AS code, e.pos, e.x AS c
FROM elements e JOIN ({first_vectors(number, f"({rows})")}) USING (product_id)""",
    }
    for i in range(steps):
        parts[f"nearest_{i}"] = nearest_codes("trained_on", f"centres_{i}", width)
        parts[f"centres_{i + 1}"] = f"""SELECT o.code, o.pos, coalesce(n.c, o.c) AS c FROM centres_{i} o LEFT JOIN (
  SELECT k.code, e.pos, CAST(CAST(CAST(sum(CAST(floor(e.x * 1048576 + 0.5) AS BIGINT)) AS DOUBLE) / 1048576 / count(*) AS FLOAT) AS DOUBLE) AS c
  FROM trained_on e JOIN nearest_{i} k ON e.product_id = k.product_id AND e.pos // {width} = k.subspace
  GROUP BY k.code, e.pos) n ON o.code = n.code AND o.pos = n.pos"""
    return parts | {"trained": f"SELECT * FROM centres_{steps}"}


def nearest_codes(elements: str, centres: str, width: int) -> str:
    return f"""SELECT product_id, subspace, code FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id, subspace ORDER BY d, code) AS nth FROM (
    SELECT e.product_id, e.pos // {width} AS subspace, c.code, sum((e.x - c.c) * (e.x - c.c)) AS d
    FROM {elements} e JOIN {centres} c ON e.pos = c.pos
    GROUP BY e.product_id, subspace, c.code))
WHERE nth = 1"""


ALL_VECTORS = "SELECT product_id, embedding FROM vectors"
ORACLE["ivf_assign"] = statement(
    {
        **ELEMENTS,
        **trained(STEPS, CELLS, ALL_VECTORS, DIM),
        "assigned": nearest_codes("elements", "trained", DIM),
    },
    "SELECT product_id, code AS cell FROM assigned",
)
ORACLE["ivf_knn"] = statement(
    {
        **ASKED,
        **ELEMENTS,
        **trained(STEPS, CELLS, first_vectors(4 * SAMPLE), DIM),
        "assigned": nearest_codes("elements", "trained", DIM),
        "learned": "SELECT code AS cell, list(c ORDER BY pos) AS centre FROM trained GROUP BY code",
        "probed": f"""SELECT query_id, cell FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, cell) AS nth FROM (
    SELECT q.query_id, c.cell, {squared('q.embedding', 'c.centre')} AS d
    FROM asked q, learned c))
WHERE nth <= {PROBES}""",
        "found": ranked_pairs(
            squared("q.embedding", "v.embedding"),
            K,
            """asked q JOIN probed p USING (query_id) JOIN assigned a ON a.code = p.cell
JOIN vectors v ON v.product_id = a.product_id""",
        ),
    },
    NEIGHBOURS,
)
LEARNED_CODES = {
    **ELEMENTS,
    **trained(PQ.iterations, 1 << PQ.bits, ALL_VECTORS, DIM // PQ.subspaces),
    "codes": nearest_codes("elements", "trained", DIM // PQ.subspaces),
}
ORACLE["pq_encode"] = statement(
    LEARNED_CODES,
    "SELECT product_id, CAST(subspace AS INTEGER) AS subspace, CAST(code AS INTEGER) AS code FROM codes",
)
ORACLE["pq_knn"] = statement(
    {
        **ASKED,
        **LEARNED_CODES,
        "decoded": f"""SELECT product_id, list(c.c ORDER BY c.pos) AS embedding
FROM codes k JOIN trained c ON c.code = k.code AND c.pos // {DIM // PQ.subspaces} = k.subspace
GROUP BY product_id""",
        "found": ranked_pairs(squared("q.embedding", "v.embedding"), K, "asked q, decoded v"),
    },
    NEIGHBOURS,
)
# The hashed index's directions are parameters: seeded random numbers, written out.
LINES = ", ".join(
    f"({at}, {[float(x) for x in line]})" for at, line in enumerate(lsh.directions(DIM, LshOptions()))
)
IN_BUCKET = (
    "CAST(floor(list_sum(list_transform(list_zip(v.embedding, c.direction),"
    f" lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / {LshOptions.bucket_length}) AS BIGINT)"
)
ORACLE["lsh_knn"] = statement(
    {
        **ASKED,
        "lines": f"SELECT * FROM (VALUES {LINES}) AS l(line, direction)",
        "buckets": f"SELECT product_id, c.line, {IN_BUCKET} AS bucket FROM vectors v, lines c",
        "asked_buckets": f"SELECT query_id, c.line, {IN_BUCKET} AS bucket FROM asked v, lines c",
        "near": """SELECT DISTINCT a.query_id, b.product_id
FROM asked_buckets a JOIN buckets b ON a.line = b.line AND a.bucket = b.bucket""",
        "found": ranked_pairs(
            squared("q.embedding", "v.embedding"),
            K,
            "asked q JOIN near n USING (query_id) JOIN vectors v ON v.product_id = n.product_id",
        ),
    },
    NEIGHBOURS,
)

ORACLE["lsh_roundtrip"] = ORACLE["lsh_knn"]
PLACE = IN_BUCKET.removeprefix("CAST(floor(").removesuffix(") AS BIGINT)")
ORACLE["lsh_probe"] = statement(
    {
        **ASKED,
        "lines": f"SELECT * FROM (VALUES {LINES}) AS l(line, direction)",
        "buckets": f"SELECT product_id, c.line, {IN_BUCKET} AS bucket FROM vectors v, lines c",
        "places": f"SELECT query_id, c.line, {PLACE} AS place FROM asked v, lines c",
        "beside": f"""SELECT query_id, line, bucket FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY away, line, bucket) AS nth FROM (
    SELECT query_id, line, CAST(floor(place) AS BIGINT) - 1 AS bucket, place - floor(place) AS away FROM places
    UNION ALL
    SELECT query_id, line, CAST(floor(place) AS BIGINT) + 1, 1 - (place - floor(place)) FROM places))
WHERE nth <= {EXTRA_BUCKETS}""",
        "asked_buckets": """SELECT query_id, line, CAST(floor(place) AS BIGINT) AS bucket FROM places
UNION ALL SELECT * FROM beside""",
        "near": """SELECT DISTINCT a.query_id, b.product_id
FROM asked_buckets a JOIN buckets b ON a.line = b.line AND a.bucket = b.bucket""",
        "found": ranked_pairs(
            squared("q.embedding", "v.embedding"),
            K,
            "asked q JOIN near n USING (query_id) JOIN vectors v ON v.product_id = n.product_id",
        ),
    },
    NEIGHBOURS,
)
ORACLE["pq_roundtrip"] = ORACLE["pq_label_knn"]

# Query understanding

NO_RANGE = f"NOT {has('query_text', RANGE)}"
PARSED = f"""SELECT query_id, query_text,
  CASE WHEN {NO_RANGE} THEN {number('query_text', LOWER)} ELSE {number('query_text', RANGE, 1)} END AS min_price,
  CASE WHEN {NO_RANGE} THEN {number('query_text', UPPER)} ELSE {number('query_text', RANGE, 2)} END AS max_price,
  CASE WHEN {has('query_text', RANGE)} THEN {cut('query_text', RANGE)}
       WHEN {has('query_text', LOWER)} THEN {cut('query_text', LOWER)}
       WHEN {has('query_text', UPPER)} THEN {cut('query_text', UPPER)}
       ELSE query_text END AS cleaned_query
FROM searches"""
SQUEEZED = f"array_to_string({words('lower(query_text)')}, ' ')"
PROCESSED = (
    f"CASE WHEN {has(SQUEEZED, RANGE)} THEN {cut(SQUEEZED, RANGE)} ELSE {SQUEEZED} END"
)


def over_searches(columns: str) -> str:
    return statement(SEARCHES, f"SELECT query_id, {columns} FROM searches")


ORACLE["price_range"] = over_searches(
    f"{number('query_text', RANGE, 1)} AS min_price, {number('query_text', RANGE, 2)} AS max_price"
)
ORACLE["price_upper"] = over_searches(
    f"CASE WHEN {NO_RANGE} THEN {number('query_text', UPPER)} END AS max_price"
)
ORACLE["price_lower"] = over_searches(
    f"CASE WHEN {NO_RANGE} THEN {number('query_text', LOWER)} END AS min_price"
)
ORACLE["parse_price_filters"] = statement(
    {**SEARCHES, "parsed": PARSED}, "SELECT * EXCLUDE (query_text) FROM parsed"
)
ORACLE["price_override"] = statement(
    {**SEARCHES, "parsed": PARSED},
    """SELECT query_id, coalesce(min_price, 10.0) AS min_price,
  coalesce(max_price, 1000.0) AS max_price FROM parsed""",
)
ORACLE["preprocess_query"] = over_searches(f"{PROCESSED} AS processed_query")
ORACLE["extract_brand"] = statement(
    {**SEARCHES, "hints": HINTS}, "SELECT query_id, brand_hint FROM hints"
)
ORACLE["extract_rating"] = statement(
    {**SEARCHES, "hints": HINTS}, "SELECT query_id, min_rating FROM hints"
)
ORACLE["extract_filters"] = statement(
    {**SEARCHES, "hints": HINTS},
    f"""SELECT query_id, {PROCESSED} AS processed_query, min_price, max_price, brand_hint, min_rating
FROM hints""",
)
ORACLE["detect_categories"] = statement(
    {**SEARCHES, **DETECTED}, "SELECT query_id, category, keyword, n_words FROM detected"
)
ORACLE["primary_category"] = statement({**SEARCHES, **DETECTED}, "SELECT * FROM chosen")

# Filters


def filtered(condition: str) -> str:
    return statement(
        CANDIDATES, f"SELECT query_id, product_id FROM candidates WHERE {condition}"
    )


ORACLE["filter_valid_price"] = filtered("price >= 1.0")
ORACLE["filter_price"] = filtered(
    "(min_price IS NULL OR price >= min_price) AND (max_price IS NULL OR price <= max_price)"
)
ORACLE["filter_rating"] = filtered("min_rating IS NULL OR min_rating <= 0 OR stars >= min_rating")
ORACLE["filter_bestseller"] = filtered("min_price IS NOT NULL OR isBestSeller")
ORACLE["filter_brand"] = filtered("brand_hint IS NULL OR contains(lower(brand), brand_hint)")
ORACLE["displayable"] = filtered("price IS NOT NULL AND price >= 1.0")

CATEGORISED = {**CANDIDATES, **DETECTED, **scored("candidates")}
ORACLE["category_score"] = statement(
    CATEGORISED,
    "SELECT query_id, product_id, CAST(category_score AS INTEGER) AS category_score FROM scored",
)
ORACLE["filter_category"] = statement(CATEGORISED, "SELECT query_id, product_id FROM kept")
ORACLE["rank_category"] = statement(
    CATEGORISED,
    f"""SELECT query_id, product_id, CAST(category_score AS INTEGER) AS category_score,
  CAST(nth AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY category_score DESC, distance, product_id) AS nth FROM kept)
WHERE nth <= {K}""",
)

# Ranking

ORDERS = {
    "distance": "distance, product_id",
    "reviews": "reviews DESC NULLS LAST, distance, product_id",
    "price": "price ASC NULLS LAST, distance, product_id",
    "hybrid": "hybrid_score DESC NULLS LAST, distance, product_id",
}


def place(order: str, name: str = "rank") -> str:
    return f"CAST(row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS INTEGER) AS {name}"


def with_scores(source: str) -> dict[str, str]:
    weights = HybridWeights()
    spread = lambda c: f"max({c}) OVER w > min({c}) OVER w"
    share = lambda c: f"({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w)"
    return {
        "parts": f"""SELECT *, 1 - distance / nullif(max(distance) OVER w, 0) AS relevance_score,
  CASE WHEN {spread('stars')} THEN {share('stars')} ELSE 1.0 END AS rating_score,
  CASE WHEN {spread('price')} THEN 1 - {share('price')} ELSE 1.0 END AS price_score
FROM {source} WINDOW w AS (PARTITION BY query_id)""",
        "hybrid": f"""SELECT *, {weights.relevance}::DOUBLE * relevance_score
  + {weights.rating}::DOUBLE * rating_score + {weights.price}::DOUBLE * price_score AS hybrid_score
FROM parts""",
    }


for _method in ("distance", "reviews", "price"):
    ORACLE[f"rank_{_method}"] = statement(
        CANDIDATES, f"SELECT query_id, product_id, {place(ORDERS[_method])} FROM candidates"
    )
ORACLE["rank_fallback"] = ORACLE["rank_distance"]
ORACLE["rank_hybrid"] = statement(
    {**CANDIDATES, **with_scores("candidates")},
    f"""SELECT query_id, product_id, round(relevance_score, 6) AS relevance_score,
  round(rating_score, 6) AS rating_score, round(price_score, 6) AS price_score,
  round(hybrid_score, 6) AS hybrid_score, {place(ORDERS['hybrid'])} FROM hybrid""",
)
ORACLE["topk_two_stage"] = statement(
    {
        **CANDIDATES,
        "first": f"""SELECT * FROM (
  SELECT *, {place(ORDERS['distance'], 'nth')} FROM candidates WHERE price >= 1.0) WHERE nth <= 15""",
    },
    f"""SELECT query_id, product_id, rank FROM (
  SELECT query_id, product_id, {place(ORDERS['price'])} FROM first) WHERE rank <= 3""",
)

# Formatting

PRICE_LABEL = "CASE WHEN price >= 1.0 THEN printf('$%.2f', price) ELSE 'N/A' END"
STAR_ICONS = """CASE WHEN stars IS NULL THEN 'N/A'
  ELSE repeat('★', CAST(floor(stars) AS INTEGER)) || CASE WHEN stars % 1 >= 0.5 THEN '½' ELSE '' END END"""
REVIEW_LABEL = "CASE WHEN reviews IS NULL THEN 'N/A' ELSE format('{:,}', reviews) || ' reviews' END"


def over_products(columns: str) -> str:
    return statement(PRODUCTS, f"SELECT product_id, {columns} FROM products")


ORACLE["fmt_price"] = over_products(f"{PRICE_LABEL} AS price_formatted")
ORACLE["fmt_stars_icons"] = over_products(f"{STAR_ICONS} AS rating_stars")
ORACLE["fmt_reviews"] = over_products(f"{REVIEW_LABEL} AS reviews_formatted")
ORACLE["fmt_stars"] = over_products("printf('%.1f ★', stars) AS stars_formatted")
ORACLE["fmt_links"] = over_products(
    """productURL AS url, imgUrl AS image_url, productURL AS other_url,
  CAST(NULL AS VARCHAR) AS no_image"""
)
RESULT = f"""coalesce(title, 'Unknown Product') AS title,
  CASE WHEN price >= 1.0 THEN price END AS price, {PRICE_LABEL} AS price_formatted,
  stars AS rating, {STAR_ICONS} AS rating_stars, reviews, {REVIEW_LABEL} AS reviews_formatted,
  productURL AS url, imgUrl AS image_url, coalesce(isBestSeller, false) AS is_bestseller,
  category_id AS category"""
ORACLE["result_projection"] = statement(
    {**PRODUCTS, **nearest(K)},
    f"""SELECT query_id, product_id, {RESULT}, round(cost, 6) AS relevance_score
FROM found JOIN products USING (product_id)""",
)

# Searches


def store_search(found: dict[str, str], options: StoreSearchOptions) -> dict[str, str]:
    """``found`` has the parts ``products`` and ``found`` (query_id, product_id, cost)."""
    return {
        **found,
        "parsed": PARSED,
        "bounds": f"""SELECT query_id, query_text, coalesce(min_price, {options.price_min}) AS min_price,
  coalesce(max_price, {options.price_max}) AS max_price FROM parsed""",
        "passed": f"""SELECT f.query_id, f.product_id, f.cost AS distance FROM found f
JOIN products p USING (product_id) JOIN bounds b USING (query_id)
WHERE p.price >= {options.min_valid_price} AND p.price BETWEEN b.min_price AND b.max_price""",
        "nearer": f"""SELECT * FROM (SELECT *, {place(ORDERS['distance'], 'nth')} FROM passed)
WHERE nth <= {options.category_multiplier * options.top_k}""",
        "closest": "SELECT n.query_id, n.distance, n.nth, p.* FROM nearer n JOIN products p USING (product_id)",
        **DETECTED,
        **scored("closest"),
        "final": f"""SELECT * FROM (
  SELECT query_id, product_id, CAST(row_number() OVER (PARTITION BY query_id
    ORDER BY category_score DESC, distance, product_id) AS INTEGER) AS rank FROM kept)
WHERE rank <= {options.top_k}""",
        "results": f"""SELECT query_id, product_id, {RESULT}, round(distance, 6) AS relevance_score, rank
FROM final JOIN closest USING (query_id, product_id)""",
    }


def histogram(text: str) -> str:
    """How many tokens fall into each bucket, as a map; every token is hashed once."""
    return f"list_histogram(list_transform({words(text)}, lambda w: {bucket('w')}))"


def hashed(counts: str) -> str:
    value = f"coalesce(map_extract({counts}, i)[1], 0)"
    return f"list_transform(range({DIM}), lambda i: CAST({value} AS DOUBLE))"


TEXT_DISTANCE = "2 * -list_inner_product(q.vec, v.vec) + q.norm + v.norm"
TEXT_FOUND = {
    **cleaned(),
    "products": f"SELECT *, {EMBEDDED} FROM cleaned",
    **SEARCHES,
    "texts": PARSED,
    "asked_counts": f"SELECT query_id, {histogram('cleaned_query')} AS h FROM texts",
    "asked_vec": f"SELECT query_id, {hashed('h')} AS vec FROM asked_counts",
    "asked": "SELECT *, list_inner_product(vec, vec) AS norm FROM asked_vec",
    "item_counts": f"SELECT product_id, {histogram('embedding_text')} AS h FROM products",
    "item_vec": f"SELECT product_id, {hashed('h')} AS vec FROM item_counts",
    "items": "SELECT *, list_inner_product(vec, vec) AS norm FROM item_vec",
    "found": ranked_pairs(
        TEXT_DISTANCE,
        StoreSearchOptions.top_k * StoreSearchOptions.fetch_multiplier,
        "asked q, items v",
    ),
}
ORACLE["search_catalog"] = statement(
    store_search(TEXT_FOUND, StoreSearchOptions()), "SELECT * FROM results"
)
# A search of all cells finds what an exact one does.
ORACLE["search_catalog_ivf"] = ORACLE["search_catalog"]
# Filtering first: every pair is a candidate.
ALL_PAIRS = 1 << 40
TEXT_ALL = {**TEXT_FOUND, "found": ranked_pairs(TEXT_DISTANCE, ALL_PAIRS, "asked q, items v")}
ORACLE["search_pre"] = statement(
    store_search(TEXT_ALL, StoreSearchOptions()), "SELECT * FROM results"
)
ORACLE["one_pass_queries_held"] = ORACLE["one_pass_vectors_held"] = statement(
    {
        **TEXT_FOUND,
        "texts": "SELECT query_id, query_text AS cleaned_query FROM searches",
        "found": ranked_pairs(TEXT_DISTANCE, 200 * K, "asked q, items v"),
    },
    """SELECT query_id, count(*) AS candidates, CAST(round(max(cost), 6) AS DOUBLE) AS farthest
FROM found GROUP BY query_id""",
)
ORACLE["knn_large"] = statement(
    {
        **cleaned(),
        "products": f"SELECT *, {EMBEDDED} FROM cleaned",
        **SEARCHES,
        "asked_counts": f"SELECT query_id, {histogram('query_text')} AS h FROM searches",
        "asked_vec": f"SELECT query_id, {hashed('h')} AS vec FROM asked_counts",
        "asked": "SELECT *, list_inner_product(vec, vec) AS norm FROM asked_vec",
        "item_counts": f"SELECT product_id, {histogram('embedding_text')} AS h FROM products",
        "item_vec": f"SELECT product_id, {hashed('h')} AS vec FROM item_counts",
        "items": "SELECT *, list_inner_product(vec, vec) AS norm FROM item_vec",
        "found": ranked_pairs(TEXT_DISTANCE, K, "asked q, items v"),
    },
    NEIGHBOURS,
)
SMALL = store_search(
    {**PRODUCTS, **nearest(SMALL_FETCH.top_k * SMALL_FETCH.fetch_multiplier)}, SMALL_FETCH
)
ORACLE["search_vectors"] = statement(SMALL, "SELECT * FROM results")
ORACLE["search_summary"] = statement(
    SMALL,
    """SELECT query_id, query_text, coalesce(n, 0) AS n_results,
  printf('$%.2f', min_price) || ' - ' || printf('$%.2f', max_price) AS price_range,
  coalesce(n, 0) = 0 AS no_match
FROM asked JOIN bounds USING (query_id, query_text)
LEFT JOIN (SELECT query_id, count(*) AS n FROM results WHERE price >= 1.0 GROUP BY query_id)
USING (query_id)""",
)

ORACLE["knn_matching"] = statement(
    {
        **PRODUCTS,
        **ASKED,
        "hints": HINTS,
        "found": ranked_pairs(
            squared("q.embedding", "v.embedding"),
            K,
            """asked q JOIN hints h USING (query_id), vectors v JOIN products p USING (product_id)
WHERE p.price >= 1.0 AND (h.min_price IS NULL OR p.price BETWEEN h.min_price AND h.max_price)
  AND (h.brand_hint IS NULL OR contains(lower(p.brand), h.brand_hint))
  AND (h.min_rating IS NULL OR h.min_rating <= 0 OR p.stars >= h.min_rating)
  AND (q.query_id % 11 <> 0 OR p.isBestSeller)""",
        ),
    },
    NEIGHBOURS,
)

RANKED_TOP, RANKED_FETCH = 50, 150
RANKED = {
    **PRODUCTS,
    **nearest(RANKED_FETCH),
    "hints": HINTS,
    "matching": """SELECT f.query_id, f.cost AS distance, p.*
FROM found f JOIN products p USING (product_id) JOIN hints h USING (query_id)
WHERE (h.min_price IS NULL OR p.price BETWEEN h.min_price AND h.max_price)
  AND (h.brand_hint IS NULL OR contains(lower(p.brand), h.brand_hint))
  AND (h.min_rating IS NULL OR p.stars >= h.min_rating)""",
    **with_scores("matching"),
}
for _method, _order in ORDERS.items():
    ORACLE[f"search_ranked_{_method}"] = statement(
        RANKED,
        f"""SELECT query_id, product_id, rank, printf('$%.2f', price) AS price_formatted,
  printf('%.1f ★', stars) AS stars_formatted, round(distance, 6) AS distance
FROM (SELECT *, {place(_order)} FROM hybrid) WHERE rank <= {RANKED_TOP}""",
    )
ORACLE["search_ranked_pre"] = statement(
    {
        **{name: part for name, part in RANKED.items() if name not in ("found", "matching", "parts", "hybrid")},
        "matching": f"""SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, product_id) AS nth FROM (
    SELECT q.query_id, {squared('q.embedding', 'v.embedding')} AS distance, p.*
    FROM asked q JOIN hints h USING (query_id), vectors v JOIN products p USING (product_id)
    WHERE (h.min_price IS NULL OR p.price BETWEEN h.min_price AND h.max_price)
      AND (h.brand_hint IS NULL OR contains(lower(p.brand), h.brand_hint))
      AND (h.min_rating IS NULL OR p.stars >= h.min_rating)))
WHERE nth <= {RANKED_FETCH}""",
    },
    f"""SELECT query_id, product_id, rank, printf('$%.2f', price) AS price_formatted,
  printf('%.1f ★', stars) AS stars_formatted, round(distance, 6) AS distance
FROM (SELECT *, {place(ORDERS['price'])} FROM matching) WHERE rank <= {RANKED_TOP}""",
)
ORACLE["search_ranked_ivf"] = statement(
    {
        **PRODUCTS,
        **ASKED,
        **ELEMENTS,
        "probed": f"""SELECT query_id, cell FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, cell) AS nth FROM (
    SELECT q.query_id, c.cell, {squared('q.embedding', 'c.centre')} AS d
    FROM asked q, centroids c))
WHERE nth <= {PROBES}""",
        "found": ranked_pairs(
            squared("q.embedding", "v.embedding"),
            RANKED_FETCH,
            "asked q JOIN probed p USING (query_id) JOIN vectors v ON v.cell = p.cell",
        ),
        **{name: RANKED[name] for name in ("hints", "matching")},
        **with_scores("matching"),
    },
    f"""SELECT query_id, product_id, rank, printf('$%.2f', price) AS price_formatted,
  printf('%.1f ★', stars) AS stars_formatted, round(distance, 6) AS distance
FROM (SELECT *, {place(ORDERS['distance'])} FROM hybrid) WHERE rank <= {RANKED_TOP}""",
)

LINES = {
    **PRODUCTS,
    **nearest(15),
    "matching": """SELECT f.query_id, f.cost AS distance, p.*
FROM found f JOIN products p USING (product_id)
WHERE p.price BETWEEN 5.0 AND 800.0 AND p.stars >= 1.5""",
    **with_scores("matching"),
    "ranked": f"SELECT * FROM (SELECT *, {place(ORDERS['hybrid'])} FROM hybrid) WHERE rank <= 5",
}
SIMPLE_LINE = """SELECT query_id, rank,
  rank || '. ' || coalesce(title, 'Unknown Product') AS line FROM ranked"""
DETAILED_LINE = """SELECT query_id, rank, rank || '. ' || coalesce(title, 'Unknown Product')
  || coalesce(printf(' - $%.2f', price), '') || coalesce(printf(' - %.1f ★', stars), '')
  || coalesce(' (' || reviews || ' reviews)', '') AS line FROM ranked"""
ORACLE["search_lines_simple"] = statement(LINES, SIMPLE_LINE)
ORACLE["search_lines"] = statement(LINES, DETAILED_LINE)
PLAIN = {
    **PRODUCTS,
    **nearest(K),
    "ranked": f"""SELECT *, {place('cost, product_id')}
FROM found JOIN products USING (product_id)""",
}
ORACLE["format_results_simple"] = statement(PLAIN, SIMPLE_LINE)
ORACLE["format_results"] = statement(PLAIN, DETAILED_LINE)
