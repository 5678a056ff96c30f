"""Query op12: divergence of the sources of all documents."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .divergence import MIN_DOCS, SCALE, TOP, source_divergence

NAME = "op12_source_divergence"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


SQL = rf"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
    x AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS n FROM x GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}),
    l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT g.lang, g.source, k.term, k.n AS lang_n FROM g JOIN k ON g.lang = k.lang),
    n AS (SELECT x.lang, x.source, x.term, count(*) AS n FROM x JOIN k ON x.lang = k.lang AND x.term = k.term GROUP BY ALL),
    f AS (SELECT c.*, coalesce(n.n, 0) AS n, sum(coalesce(n.n, 0)) OVER (PARTITION BY c.lang, c.source) AS total FROM c LEFT JOIN n ON c.lang = n.lang AND c.source = n.source AND c.term = n.term),
    p AS (SELECT f.lang, f.source, f.term, f.n, 1 + {SCALE}::HUGEINT * (f.n + 2) // (f.total + 2 * l.v) AS p, 1 + {SCALE}::HUGEINT * (f.lang_n + 2) // (l.total + 2 * l.v) AS q FROM f JOIN l ON f.lang = l.lang),
    u AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(u.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN u ON u.lang = a.lang AND u.source = a.source AND u.item = b.source
        UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
    z AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM y)
    SELECT lang, source, part, item, value, rank FROM z WHERE part = 'pair' OR rank <= {TOP}"""
