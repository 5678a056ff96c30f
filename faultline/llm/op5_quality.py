"""Query op5: quality rules over all documents."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .quality_rules import MEASURES, PRIOR_ROWS, SIGNIFICANT, SPREADS, quality_report

NAME = "op5_quality_rules"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def _sql() -> str:
    units = {k: f"(({a} * {u}) // greatest({b}, 1))" for k, (a, b, u, _, _) in MEASURES.items()}
    tall = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, {v} - {v} % (1::BIGINT << greatest(length(bin({v}::BIGINT)) - {SIGNIFICANT}, 0)) AS bucket FROM base WHERE NOT base_failed" for k, v in units.items())
    floor = " ".join(f"WHEN '{k}' THEN {v[3]}" for k, v in MEASURES.items())

    def fences(name: str, keys: str) -> str:
        part = f"PARTITION BY {keys}measure"
        return f"""{name}_placed AS (SELECT {keys}measure, bucket, sum(n) OVER ({part} ORDER BY bucket) AS upto, sum(n) OVER ({part}) AS n_rows
            FROM (SELECT {keys}measure, bucket, count(*) AS n FROM tall GROUP BY ALL)),
        {name}_q AS (SELECT {keys}measure, max(n_rows) AS n_rows, min(bucket) FILTER (WHERE upto * 4 >= n_rows) AS q25, min(bucket) FILTER (WHERE upto * 4 >= 3 * n_rows) AS q75 FROM {name}_placed GROUP BY ALL),
        {name} AS (SELECT {keys}measure, n_rows, q25 - {SPREADS} * greatest(q75 - q25, CASE measure {floor} END) AS low, q75 + {SPREADS} * greatest(q75 - q25, CASE measure {floor} END) AS high FROM {name}_q)"""

    def blend(x: str) -> str:
        mid = f"((mid.n_rows * mid.{x} + {PRIOR_ROWS} * whole.{x})::DOUBLE / (mid.n_rows + {PRIOR_ROWS})::DOUBLE)"
        return f"((fine.n_rows * fine.{x} + {PRIOR_ROWS} * {mid}) / (fine.n_rows + {PRIOR_ROWS})::DOUBLE)"

    outside = " OR ".join(f"(f.measure = '{k}' AND ({units[k]} > f.high" + (f" OR {units[k]} < f.low" if v[4] else "") + "))" for k, v in MEASURES.items())
    return f"""
    WITH texts AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM texts),
    win AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
    rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
    cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
    stats AS (SELECT w.r, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov ON w.r = cov.r),
    base AS (SELECT texts.r, doc_id, lang, source, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM texts JOIN stats ON texts.r = stats.r),
    tall AS ({tall}),
    {fences("fine", "lang, source, ")}, {fences("mid", "lang, ")}, {fences("whole", "")},
    f AS (SELECT fine.lang, fine.source, fine.measure, {blend("low")} AS low, {blend("high")} AS high
        FROM fine LEFT JOIN mid ON fine.lang IS NOT DISTINCT FROM mid.lang AND fine.measure = mid.measure LEFT JOIN whole ON fine.measure = whole.measure),
    bad AS (SELECT DISTINCT base.r FROM base JOIN f ON base.lang IS NOT DISTINCT FROM f.lang AND base.source IS NOT DISTINCT FROM f.source WHERE {outside})
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.r IS NULL AS kept FROM base LEFT JOIN bad ON base.r = bad.r"""


SQL = _sql()
