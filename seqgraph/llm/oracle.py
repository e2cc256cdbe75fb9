"""DuckDB SQL for the queries of this subpackage that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from .queries import MIX_SEED, WEIGHTS

OP3 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 33, 1))) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM rep, range(35) t(j)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w)
    ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
"""


def _weights(level: str) -> str:
    return "CASE name " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in WEIGHTS[level].items()) + " ELSE 1::DOUBLE END"


def _level(name: str, level: str, keys: str, parent: str | None) -> str:
    """Water filling of one level of the tree: `keys` are the level's columns, the last one its own name."""
    over = ", ".join(keys.split(", ")[:-1]) or "1"
    own = keys.split(", ")[-1]
    budget = f"JOIN {parent} p USING ({over})" if parent else "CROSS JOIN total p"
    return f"""
{name}_c AS (SELECT *, CASE WHEN weight > 0 THEN capacity / weight ELSE 'inf'::DOUBLE END AS full_at FROM (SELECT {keys}, {_weights(level).replace('name', own, 1)} AS weight, CAST(sum(n_tokens) * 2 AS DOUBLE) AS capacity FROM leaves GROUP BY {keys})),
{name}_o AS (SELECT c.*, p.budget, coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_, sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward
    FROM {name}_c c {budget} WINDOW w AS (PARTITION BY {over} ORDER BY full_at, {own})),
{name}_f AS (SELECT *, weight > 0 AND before_ + full_at * onward <= budget AS is_full FROM {name}_o),
{name} AS (SELECT {keys}, CASE WHEN is_full THEN capacity ELSE least(capacity, CASE WHEN sum(weight) FILTER (NOT is_full) OVER w > 0
    THEN (budget - coalesce(sum(capacity) FILTER (is_full) OVER w, 0)) * weight / sum(weight) FILTER (NOT is_full) OVER w ELSE 0 END) END AS budget FROM {name}_f WINDOW w AS (PARTITION BY {over}))"""


def _op10() -> str:
    return rf"""
WITH rows_ AS (SELECT doc_id, 'd' || CAST(CAST('0x' || substr(md5(coalesce(source, '')), 1, 7) AS BIGINT) % 3 AS VARCHAR) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS n_tokens FROM rows_ GROUP BY ALL),
total AS (SELECT CAST(floor(sum(n_tokens) * 0.6) AS DOUBLE) AS budget FROM leaves),
{_level('a', 'domain', 'domain', None)},
{_level('b', 'lang', 'domain, lang', 'a')},
{_level('c', 'source', 'domain, lang, source', 'b')},
alloc AS (SELECT domain, lang, source, n_tokens, CAST(floor(budget + 1e-6) AS BIGINT) AS allot FROM leaves JOIN c USING (domain, lang, source)),
ep AS (SELECT *, CASE WHEN n_tokens > 0 THEN least(2, allot // n_tokens) ELSE 1 END AS epochs FROM alloc),
placed AS (SELECT r.*, e.epochs, CASE WHEN e.epochs < 2 THEN e.allot - e.epochs * e.n_tokens ELSE 0 END AS room, md5('{MIX_SEED}:' || (e.epochs + 1) || ':' || r.doc_id) AS place FROM rows_ r JOIN ep e USING (domain, lang, source)),
upto AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) AS t FROM placed),
times AS (SELECT *, epochs + CASE WHEN room > 0 AND t <= room THEN 1 ELSE 0 END AS times FROM upto)
SELECT doc_id, domain, lang, source, n_tokens, CAST(e AS INTEGER) AS epoch FROM (SELECT *, unnest(range(1, CAST(times + 1 AS BIGINT))) AS e FROM times)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": OP3, "op6_va_file": OP6, "op10_mixing": _op10()}
