"""Query op11: the best documents for each benchmark item."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .search import LENGTH_PERCENT, SATURATION, TOP, WEIGHT, ranked_search

NAME = "op11_ranked_search"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _terms(text: str) -> str:
    return rf"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_terms("text")} AS ts FROM documents),
    s AS (SELECT count(*) AS big_n, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
    x AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY ALL),
    i AS (SELECT DISTINCT item_id, unnest({_terms("text")}) AS term FROM benchmark),
    w AS (SELECT term, floor({WEIGHT} * ln((2 * any_value(s.big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM x, s WHERE term IN (SELECT term FROM i) GROUP BY term),
    m AS (SELECT r, doc_id, {100 - LENGTH_PERCENT} + ({LENGTH_PERCENT} * len(ts) * s.big_n) // s.l AS m FROM d, s WHERE len(ts) > 0),
    sc AS (SELECT i.item_id, m.r, m.doc_id, sum(w.w * (({SATURATION} * x.tf) // ({WEIGHT} * x.tf + 8 * m.m)))::BIGINT AS score
        FROM i JOIN w ON i.term = w.term JOIN x ON x.term = i.term JOIN m ON m.r = x.r GROUP BY ALL),
    k AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank FROM sc WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {TOP}"""
