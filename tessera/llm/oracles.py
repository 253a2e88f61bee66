"""DuckDB SQL of the operators that SQL can express, for tables whose ids don't repeat."""

from __future__ import annotations

from . import embedding_dedup, line_templates, ngram_join, suffix_dedup

_BLANK = r"[\x20\x09-\x0D]+"


def _components(nodes: str, links: str) -> str:
    """(node, root) of a table of nodes (id) and one of links (a, b) in both directions."""
    return f"""SELECT node, min(start) AS root FROM (
        WITH RECURSIVE reach(start, node) AS (SELECT id, id FROM {nodes} UNION SELECT r.start, l.b FROM reach r JOIN {links} l ON l.a = r.node)
        SELECT start, node FROM reach) GROUP BY node"""


def ngrams(k: int = ngram_join.SHINGLE, percent: int = ngram_join.PERCENT) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH w AS (SELECT doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '{_BLANK}'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' ')) END) AS gram FROM w),
    n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
    o AS (SELECT x.id AS a, y.id AS b, count(*) AS o FROM s x JOIN s y USING (gram) WHERE x.id <> y.id GROUP BY ALL),
    l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * o >= {percent} * (x.n + y.n - o)),
    c AS ({_components("n", "l")})
    SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id FROM documents LEFT JOIN n ON n.id = doc_id LEFT JOIN c ON c.node = doc_id"""


def embeddings(cosine: float = embedding_dedup.COSINE) -> str:
    return f"""WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id <> y.id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= {cosine}),
    d AS (SELECT a, count(*) AS n FROM l GROUP BY a),
    c AS ({_components("v", "l")})
    SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
    FROM embeddings LEFT JOIN d ON d.a = vec_id LEFT JOIN c ON c.node = vec_id"""


def suffixes(window: int = suffix_dedup.WINDOW) -> str:
    return f"""WITH d AS (SELECT doc_id AS id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    p AS (SELECT id, unnest(range(n - {window - 1})) AS p FROM d WHERE n >= {window}),
    m AS (SELECT id, p, md5(substr(h, 2 * p + 1, {2 * window})) AS key FROM p JOIN d USING (id)),
    g AS (SELECT id, p FROM (SELECT id, p, row_number() OVER (PARTITION BY key ORDER BY id, p) AS k FROM m) WHERE k > 1),
    i AS (SELECT id, p, sum(fresh) OVER (PARTITION BY id ORDER BY p) AS run FROM (SELECT id, p, CASE WHEN p - lag(p) OVER (PARTITION BY id ORDER BY p) <= {window} THEN 0 ELSE 1 END AS fresh FROM g)),
    r AS (SELECT id, min(p) AS s, max(p) + {window} AS e FROM i GROUP BY id, run),
    t AS (SELECT id, sum(e - s) AS gone, count(*) AS runs FROM r GROUP BY id),
    b AS (SELECT id, s, coalesce(lag(e) OVER (PARTITION BY id ORDER BY s), 0) AS f FROM (SELECT id, s, e FROM r UNION ALL SELECT id, n, n FROM d)),
    k AS (SELECT id, string_agg(substr(h, 2 * f + 1, 2 * (s - f)), '' ORDER BY s, f) AS kept FROM b JOIN d USING (id) WHERE s > f GROUP BY id)
    SELECT id AS doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(runs, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
    FROM d LEFT JOIN t USING (id) LEFT JOIN k USING (id)"""


def lines(depth: int = line_templates.DEPTH, similarity: float = line_templates.SIMILARITY, min_docs: int = line_templates.MIN_DOCS) -> str:
    return f"""WITH d AS (SELECT doc_id AS id, string_split(coalesce(text, ''), chr(10)) AS ls, coalesce(text, '') AS t FROM documents),
    a AS (SELECT id, unnest(range(len(ls))) AS k, ls FROM d WHERE t <> ''),
    b AS (SELECT id, k, list_transform(list_filter(string_split_regex(ls[k + 1], '{_BLANK}'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN ' ' ELSE x END) AS w FROM a),
    x AS (SELECT id, k, w, {{'n': len(w), 'head': w[1:{depth}]}} AS leaf FROM b WHERE len(w) > 0),
    f AS (SELECT leaf FROM x GROUP BY leaf HAVING count(DISTINCT id) >= {min_docs}),
    y AS (SELECT x.* FROM x SEMI JOIN f USING (leaf)),
    e AS (SELECT leaf, w, count(DISTINCT id) AS docs FROM y GROUP BY leaf, w),
    m AS (SELECT leaf FROM e GROUP BY leaf HAVING count(*) > 1),
    p AS (SELECT leaf, w, docs, unnest(range({depth} + 1, len(w) + 1)) AS pos FROM e SEMI JOIN m USING (leaf)),
    v AS (SELECT leaf, pos, w[pos] AS token, sum(docs) AS docs FROM p GROUP BY ALL),
    z AS (SELECT leaf, pos, token FROM (SELECT *, sum(docs) OVER (PARTITION BY leaf, pos) AS every FROM v) WHERE 2 * docs > every),
    g AS (SELECT p.leaf, p.w FROM p JOIN z ON z.leaf = p.leaf AND z.pos = p.pos AND z.token = p.w[p.pos] GROUP BY p.leaf, p.w HAVING count(*) >= CAST({similarity} AS DOUBLE) * (len(p.w) - {depth})),
    q AS (SELECT id, k, leaf, CASE WHEN g.w IS NULL THEN y.w END AS own FROM y LEFT JOIN g USING (leaf, w)),
    r AS (SELECT leaf, own, min({{'id': id, 'k': k}}) AS first FROM q GROUP BY leaf, own HAVING count(DISTINCT id) >= {min_docs}),
    c AS (SELECT q.id, q.k FROM q JOIN r ON r.leaf = q.leaf AND r.own IS NOT DISTINCT FROM q.own WHERE {{'id': q.id, 'k': q.k}} <> r.first),
    o AS (SELECT id, string_agg(ls[k + 1], chr(10) ORDER BY k) AS text FROM a ANTI JOIN c USING (id, k) GROUP BY id),
    u AS (SELECT id, count(*) AS n FROM c GROUP BY id)
    SELECT d.id AS doc_id, coalesce(o.text, '') AS text, CASE WHEN t = '' THEN 0 ELSE len(ls) END AS n_lines, coalesce(u.n, 0) AS n_dropped
    FROM d LEFT JOIN o ON o.id = d.id LEFT JOIN u ON u.id = d.id"""
