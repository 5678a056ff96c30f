"""Query op13: secrets in all documents."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .secret_scan import ALLOW, ASSIGN, BASE, C_LOG_C, CLASSES, KINDS, NEAR, SHORTEST_VALUE, WINDOW, most_sum, secret_report

NAME = "op13_secrets"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql() -> str:
    lower = f"translate({{}}, '{KINDS['upper']}', '{KINDS['lower']}')"

    def placed(rank: int, kind: str, pattern: str) -> str:
        return f"""SELECT r, {rank} AS rank, '{kind}' AS kind, f[i] AS run, p[i] AS piece, (sum(length(p[i]) + length(f[i])) OVER (PARTITION BY r ORDER BY i) - length(f[i]))::BIGINT AS s
            FROM (SELECT r, f, p, unnest(range(1, len(f) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, {_quoted(pattern)}) AS f, string_split_regex(t, {_quoted(pattern)}) AS p FROM d))"""

    base = " UNION ALL ".join(placed(k, kind, ASSIGN if kind == "assign" else pattern) for k, (kind, pattern) in enumerate(BASE.items()))
    runs = " UNION ALL ".join(placed(len(BASE) + k, kind, f"[{c[0]}]{{{WINDOW},}}") for k, (kind, c) in enumerate(CLASSES.items()))
    high = " OR ".join(
        f"(kind = '{kind}' AND total <= {most_sum(bits)} AND " + " AND ".join(f"regexp_matches(win, '[{KINDS[n]}]')" for n in needs) + ")" for kind, (_, _, _, bits, needs) in CLASSES.items()
    )
    folded = ", ".join(f"'{kind}'" for kind, c in CLASSES.items() if c[2])
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    b AS (SELECT r, rank, kind, s, s + length(run) AS e FROM ({base}) WHERE kind <> 'assign' OR length(regexp_extract(run, {_quoted(ASSIGN)}, 2)) >= {SHORTEST_VALUE}),
    c AS (SELECT r, rank, kind, s, CASE WHEN kind IN ({folded}) THEN {lower.format("run")} ELSE run END AS run FROM ({runs}) WHERE NOT regexp_matches({lower.format(f"right(piece, {NEAR}) || run")}, '{ALLOW}')),
    w AS (SELECT r, rank, kind, s + k AS s, substr(run, (k + 1)::INT, {WINDOW}) AS win FROM (SELECT *, unnest(range(0, length(run) - {WINDOW - 1})) AS k FROM c)),
    n AS (SELECT r, rank, kind, s, win, count(*) AS n FROM (SELECT *, unnest(string_split(win, '')) AS ch FROM w) GROUP BY r, rank, kind, s, win, ch),
    h AS (SELECT r, rank, kind, s FROM (SELECT r, rank, kind, s, win, sum({C_LOG_C}[n + 1]) AS total FROM n GROUP BY ALL) WHERE {high}),
    j AS (SELECT r, rank, kind, s, sum(new) OVER (PARTITION BY r, rank ORDER BY s) AS island FROM (SELECT *, CASE WHEN lag(s) OVER (PARTITION BY r, rank ORDER BY s) + {WINDOW} >= s THEN 0 ELSE 1 END AS new FROM h)),
    m AS (SELECT r, rank, kind, min(s) AS s, max(s) + {WINDOW} AS e FROM j GROUP BY r, rank, kind, island),
    a AS (SELECT * FROM b UNION ALL SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = m.r AND b.s <= m.s AND b.e >= m.e)),
    g AS (SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE rank < {len(BASE)}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM a GROUP BY r)
    SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g ON d.r = g.r"""


SQL = _sql()
