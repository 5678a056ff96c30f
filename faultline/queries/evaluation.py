"""Queries that order tests, score the orderings and compare strategies."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.functions.text import best_label, exact
from faultline.operators import classify, order, split, stats
from faultline.plans import derived, jobs
from faultline.plans.derived import sql
from faultline.sources.shared import staged

from . import query

SEEDS = 30
STRATEGIES = ["Random", "History-based", "Same-Package", "Combined"]
SCORES = {"History-based": "history", "Same-Package": "same_package", "Combined": "same_package + history * 0.1"}
KEYS = ["project", "bug"]


def kept(df):
    """df, written to the shared folder while a query uses it more than once."""
    return staged(df, "kept")


def ranked_sql(name: str, score: str) -> str:
    return f""", {name}_r AS (SELECT project, bug, label, row_number() OVER (PARTITION BY project, bug ORDER BY {score} DESC, test_method, test_class) AS rn FROM f),
    {name} AS (SELECT project, bug, 1 - min(rn) FILTER (WHERE label = 1)::DOUBLE / count(*) + 1.0::DOUBLE / (2 * count(*)) AS apfd, count(*) AS n_tests, sum(label)::BIGINT AS n_trigger_tests FROM {name}_r GROUP BY ALL)"""


def apfd_of(f, score):
    return order.apfd(order.priority_rank(f, F.expr(score)))


@query("W3_priority_rank", sql(" SELECT project, bug, test_class, test_method, row_number() OVER (PARTITION BY project, bug ORDER BY history DESC, test_method, test_class) AS priority FROM f"))
def w3(spark, d):
    ranked = order.priority_rank(derived.features(spark, d), F.col("history"))
    return ranked.select("project", "bug", "test_class", "test_method", F.col("priority").cast("long").alias("priority"))


SHOWN = " SELECT project, bug, round_even(apfd, 10) AS apfd, n_tests, n_trigger_tests FROM r"


def shown(results):
    return results.select(*KEYS, exact(F.col("apfd")).alias("apfd"), "n_tests", "n_trigger_tests")


@query("A1_apfd_history", sql(ranked_sql("r", "history") + SHOWN))
def a1_history(spark, d):
    return shown(apfd_of(derived.features(spark, d), "history"))


@query("A1_apfd_same_package", sql(ranked_sql("r", "same_package") + SHOWN))
def a1_same_package(spark, d):
    return shown(apfd_of(derived.features(spark, d), "same_package"))


@query("A1_apfd_unsorted", sql(ranked_sql("r", "same_package") + SHOWN))
def a1_unsorted(spark, d):
    return shown(order.apfd_unsorted(derived.features(spark, d), order.score_key(F.col("same_package"))))


@query("A2_change_counts", sql(" SELECT project, bug, count(*) AS n_tests, sum(label)::BIGINT AS n_trigger_tests FROM f GROUP BY ALL"))
def a2(spark, d):
    return derived.features(spark, d).groupBy(*KEYS).agg(F.count("*").alias("n_tests"), F.sum("label").alias("n_trigger_tests"))


RANDOM = f""", k AS (SELECT project, bug, label, s.seed, md5(concat_ws(':', s.seed, project, bug, test_class, test_method)) AS key FROM f, (SELECT unnest(range({SEEDS})) AS seed) s),
    kr AS (SELECT project, bug, seed, label, row_number() OVER (PARTITION BY project, bug, seed ORDER BY key) AS rn FROM k),
    ks AS (SELECT project, bug, seed, 1 - min(rn) FILTER (WHERE label = 1)::DOUBLE / count(*) + 1.0::DOUBLE / (2 * count(*)) AS apfd, count(*) AS n_tests, sum(label)::BIGINT AS n_trigger_tests FROM kr GROUP BY ALL),
    rnd AS (SELECT project, bug, avg(apfd) AS apfd, stddev_samp(apfd) AS apfd_std, n_tests, n_trigger_tests FROM ks GROUP BY ALL)"""


@query("X1_random_apfd", sql(RANDOM + " SELECT project, bug, seed::INT AS seed, round_even(apfd, 10) AS apfd, n_tests, n_trigger_tests FROM ks"))
def x1(spark, d):
    f = kept(derived.labelled(spark, d))
    return order.random_apfd(f, SEEDS).withColumn("apfd", exact(F.col("apfd")))


@query("A3_random_summary", sql(RANDOM + " SELECT project, bug, round_even(apfd, 10) AS apfd_mean, round_even(apfd_std, 10) AS apfd_std, n_tests, n_trigger_tests FROM rnd"))
def a3(spark, d):
    f = kept(derived.labelled(spark, d))
    out = order.seed_summary(order.random_apfd(f, SEEDS))
    return out.withColumn("apfd_mean", exact(F.col("apfd_mean"))).withColumn("apfd_std", exact(F.col("apfd_std")))


SUMMARY = "round_even(avg(apfd), 4) AS mean, round_even(median(apfd), 4) AS median, round_even(stddev_samp(apfd), 4) AS std, round_even(min(apfd), 4) AS min, round_even(max(apfd), 4) AS max, count(apfd) AS count"


@query("A4_history_summary", sql(ranked_sql("r", "history") + f" SELECT project, {SUMMARY} FROM r GROUP BY project"))
def a4(spark, d):
    return stats.strategy_summary(apfd_of(derived.features(spark, d), "history"), ["project"])


@query("A4_same_package_overall", sql(ranked_sql("r", "same_package") + f" SELECT {SUMMARY} FROM r"))
def a4_overall(spark, d):
    return stats.strategy_summary(apfd_of(derived.features(spark, d), "same_package"))


SPLIT = """, sp0 AS (SELECT project, bug, q, max(is_trigger) = 1 AS has_trigger FROM t GROUP BY ALL),
    sp AS (SELECT project, bug, q AS fixed_commit_date, has_trigger, CASE WHEN has_trigger AND row_number() OVER (PARTITION BY project, has_trigger ORDER BY q DESC, bug DESC) <= round_even(count(*) OVER (PARTITION BY project, has_trigger) * 0.3::DOUBLE, 0) THEN 'test' ELSE 'train' END AS side FROM sp0)"""


@query("W4_tail_split", sql(SPLIT + " SELECT project, bug, fixed_commit_date, has_trigger, side FROM sp"))
def w4(spark, d):
    return derived.features_and_split(spark, d)[1]


@query("Q8_split_summary", sql(SPLIT + " SELECT project, count(*) AS total, count(*) FILTER (WHERE NOT has_trigger) AS no_trigger, count(*) FILTER (WHERE side = 'train') AS train, count(*) FILTER (WHERE side = 'test') AS test FROM sp GROUP BY ROLLUP (project)"))
def q8(spark, d):
    return split.split_summary(w4(spark, d))


@query("P5_test_side_rows", sql(SPLIT + " SELECT f.project, f.bug, count(*) AS n, sum(label)::BIGINT AS positives FROM f JOIN sp ON f.project = sp.project AND f.bug = sp.bug WHERE side = 'test' GROUP BY ALL"))
def p5(spark, d):
    f, s = derived.features_and_split(spark, d)
    rows = split.on_side(f, s, "test")
    return rows.groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum("label").alias("positives"))


@query("A22_chronology", sql(", d AS (SELECT DISTINCT project, bug, q FROM t), o AS (SELECT project, arg_min(bug, q * 1000000 + bug) AS oldest, arg_max(bug, q * 1000000 + bug) AS newest FROM d GROUP BY ALL) SELECT *, CASE WHEN newest > oldest THEN 'rising' WHEN newest < oldest THEN 'falling' ELSE 'single' END AS direction FROM o"))
def a22(spark, d):
    return split.chronology(derived.dates(spark, d))


LONG = (
    RANDOM
    + "".join(ranked_sql(f"s{i}", s) for i, s in enumerate(SCORES.values()))
    + ", every AS (SELECT 'Random' AS strategy, project, bug, apfd FROM rnd "
    + "".join(f" UNION ALL SELECT '{k}', project, bug, apfd FROM s{i}" for i, k in enumerate(SCORES))
    + ")"
    + SPLIT
    + ", lg AS (SELECT strategy, e.project, e.bug, round_even(apfd, 10) AS apfd FROM every e JOIN sp ON e.project = sp.project AND e.bug = sp.bug WHERE side = 'test')"
)


def long_results(spark, d):
    """strategy, project, bug, apfd (10 places), n_tests, n_trigger_tests of the test side's changes."""
    f, s = derived.features_and_split(spark, d)
    test = kept(split.on_side(f, s, "test"))
    random = order.seed_summary(order.random_apfd(test, SEEDS)).withColumnRenamed("apfd_mean", "apfd").withColumn("strategy", F.lit("Random"))
    scored = order.apfd_by_scores(test, {k: F.expr(s) for k, s in SCORES.items()})
    return random.select(*scored.columns).unionByName(scored).select("strategy", *KEYS, exact(F.col("apfd")).alias("apfd"), "n_tests", "n_trigger_tests")


@query("U1_long_results", sql(LONG + " SELECT strategy, project, bug, apfd FROM lg"))
def u1(spark, d):
    return long_results(spark, d).select("strategy", *KEYS, "apfd")


@query("J1_test_side_results", sql(ranked_sql("r", "history") + SPLIT + " SELECT r.project, r.bug, round_even(apfd, 10) AS apfd FROM r SEMI JOIN (SELECT * FROM sp WHERE side = 'test') x ON r.project = x.project AND r.bug = x.bug"))
def j1(spark, d):
    f, s = derived.features_and_split(spark, d)
    return split.on_side(apfd_of(f, "history"), s, "test").select(*KEYS, exact(F.col("apfd")).alias("apfd"))


@query("P7_undefined_results", sql(ranked_sql("r", "history") + " SELECT project, bug FROM r WHERE apfd IS NULL"))
def p7(spark, d):
    return apfd_of(derived.features(spark, d), "history").where("apfd is null").select(*KEYS)


STATS = "round_even(avg(apfd), 4) AS mean, round_even(median(apfd), 4) AS median, round_even(stddev_samp(apfd), 4) AS std, round_even(min(apfd), 4) AS min, round_even(quantile_cont(apfd, 0.25), 4) AS q25, round_even(quantile_cont(apfd, 0.75), 4) AS q75, round_even(max(apfd), 4) AS max, count(apfd) AS count"


@query("A5_descriptive", sql(LONG + f" SELECT coalesce(project, 'Overall') AS scope, strategy, {STATS} FROM lg GROUP BY GROUPING SETS ((strategy), (project, strategy))"))
def a5(spark, d):
    return stats.describe_by_scope(kept(long_results(spark, d)))


WIDE = LONG + ", wd AS (SELECT project, bug, " + ", ".join(f"max(apfd) FILTER (WHERE strategy = '{s}') AS \"{s}\"" for s in STRATEGIES) + " FROM lg GROUP BY ALL)"


@query("A6_wide", sql(WIDE + " SELECT * FROM wd"))
def a6(spark, d):
    return stats.wide(long_results(spark, d), STRATEGIES)


def _label(largest: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN \"{s}\" = {largest}({', '.join(chr(34) + x + chr(34) for x in STRATEGIES)}) THEN '{s}' END" for s in STRATEGIES) + "], lambda x: x IS NOT NULL), ' / ')"


@query("F9_best_and_worst", sql(WIDE + f" SELECT project, bug, {_label('greatest')} AS best, {_label('least')} AS worst FROM wd"))
def f9(spark, d):
    return stats.best_and_worst(stats.wide(long_results(spark, d), STRATEGIES), STRATEGIES).select(*KEYS, "best", "worst")


@query("A10_best_frequency", sql(WIDE + f" SELECT {_label('greatest')} AS best, count(*) AS n FROM wd GROUP BY ALL"))
def a10(spark, d):
    return stats.wide(long_results(spark, d), STRATEGIES).groupBy(best_label(STRATEGIES).alias("best")).agg(F.count("*").alias("n"))


@query("F10_row_extremes", sql(WIDE + ' SELECT project, bug, greatest("History-based", "Same-Package", "Combined") AS top, least("History-based", "Same-Package", "Combined") AS bottom FROM wd'))
def f10(spark, d):
    w = stats.wide(long_results(spark, d), STRATEGIES)
    return w.select(*KEYS, F.greatest(*[F.col(f"`{s}`") for s in STRATEGIES[1:]]).alias("top"), F.least(*[F.col(f"`{s}`") for s in STRATEGIES[1:]]).alias("bottom"))


IDX = "(CASE strategy " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(STRATEGIES)) + " END)"
PAIRS = LONG + f", ix AS (SELECT *, {IDX} AS i FROM lg), pr AS (SELECT a.strategy AS strategy_a, b.strategy AS strategy_b, a.project, a.bug, a.apfd AS a, b.apfd AS b FROM ix a JOIN ix b ON a.project = b.project AND a.bug = b.bug AND a.i < b.i)"


@query("J11_strategy_pairs", sql(PAIRS + " SELECT * FROM pr"))
def j11(spark, d):
    return stats.pairs(kept(long_results(spark, d)), STRATEGIES)


@query(
    "A7_wins",
    sql(PAIRS + " SELECT strategy_a, strategy_b, count(*) FILTER (WHERE a > b) AS wins_a, count(*) FILTER (WHERE a < b) AS wins_b, count(*) FILTER (WHERE a = b) AS ties, count(*) AS n_pairs, round_even(avg(a), 4) AS mean_a, round_even(avg(b), 4) AS mean_b, count(*) FILTER (WHERE a IS DISTINCT FROM b) = 0 AS identical FROM pr GROUP BY ALL"),
)
def a7(spark, d):
    return stats.wins(stats.pairs(kept(long_results(spark, d)), STRATEGIES))


RANKS = PAIRS + """, df AS (SELECT strategy_a, strategy_b, round_even(a - b, 10) AS d FROM pr), sz AS (SELECT strategy_a, strategy_b, abs(d) AS size, count(*) AS n, count(*) FILTER (WHERE d > 0) AS n_plus FROM df WHERE d <> 0 GROUP BY ALL),
    rk AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY strategy_a, strategy_b ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + (n + 1)::DOUBLE / 2 AS rank FROM sz)"""


@query("W7_average_ranks", sql(RANKS + " SELECT strategy_a, strategy_b, size, n, n_plus, rank FROM rk"))
def w7(spark, d):
    return stats.difference_ranks(stats.pairs(kept(long_results(spark, d)), STRATEGIES)).withColumn("rank", F.col("rank").cast("double"))


@query(
    "A8_signed_ranks",
    sql(
        RANKS
        + """, w AS (SELECT strategy_a, strategy_b, sum(n)::BIGINT AS n, sum(rank * n_plus) AS w_plus, sum(rank * (n - n_plus)) AS w_minus, sum(n::DOUBLE * n * n - n) AS ties FROM rk GROUP BY ALL)
    SELECT strategy_a, strategy_b, n, w_plus, w_minus, least(w_plus, w_minus) AS w, round_even((least(w_plus, w_minus) - n::DOUBLE * (n + 1) / 4) / sqrt((n::DOUBLE * (n + 1) * (2 * n + 1) - ties / 2) / 24), 8) AS z FROM w"""
    ),
)
def a8(spark, d):
    out = stats.signed_ranks(stats.pairs(kept(long_results(spark, d)), STRATEGIES))
    return out.select("strategy_a", "strategy_b", "n", *[F.col(c).cast("double").alias(c) for c in ("w_plus", "w_minus", "w")], exact(F.col("z"), 8).alias("z"))


@query("A9_identical_series", sql(PAIRS + ", again AS (SELECT * FROM pr UNION ALL SELECT strategy, 'Again', project, bug, lg.apfd, g.apfd FROM lg JOIN (SELECT project, bug, apfd FROM lg WHERE strategy = 'Combined') g USING (project, bug)) SELECT strategy_a, strategy_b, bool_and(a IS NOT DISTINCT FROM b) AS identical, count(*) AS n FROM again GROUP BY ALL"))
def a9(spark, d):
    """Each two strategies, and each with a copy of the last one, which is identical to that."""
    long = kept(long_results(spark, d))
    both = long.unionByName(long.where("strategy = 'Combined'").withColumn("strategy", F.lit("Again")))
    return stats.wins(stats.pairs(both, [*STRATEGIES, "Again"])).select("strategy_a", "strategy_b", "identical", F.col("n_pairs").alias("n"))


#: The two-sided normal tail 1 - erf(|z| / sqrt 2), by the series of positive terms x ** (2 n + 1) 2 ** n / (2 n + 1)!!, and z of the signed ranks.
Z = "(least(w_plus, w_minus) - n::DOUBLE * (n + 1) / 4) / sqrt((n::DOUBLE * (n + 1) * (2 * n + 1) - ties / 2) / 24)"
TAIL = "(CASE WHEN z IS NULL THEN NULL ELSE 1 - coalesce(2 / sqrt(pi()) * exp(-z * z / 2) * list_sum(list_transform(range(0, 400), lambda i: exp((2 * i + 1) * ln(greatest(abs(z), 1e-300) / sqrt(2.0)) + (2 * i + 1) * ln(2) - lgamma(2 * i + 3) + lgamma(i + 2)))), 0) END)"
TESTED = RANKS + f""", w AS (SELECT strategy_a, strategy_b, sum(n)::BIGINT AS n, sum(rank * n_plus) AS w_plus, sum(rank * (n - n_plus)) AS w_minus, sum(n::DOUBLE * n * n - n) AS ties FROM rk GROUP BY ALL),
    zz AS (SELECT strategy_a, strategy_b, least(w_plus, w_minus)::DOUBLE AS w, {Z} AS z FROM w), pv AS (SELECT *, {TAIL} AS p_value FROM zz)"""
PLACES = 8


def tall_sql(table: str, keys: str, columns: dict[str, str], source: str) -> str:
    each = ", ".join(f"struct_pack(measure := '{k}', value := ({v})::DOUBLE)" for k, v in columns.items())
    return f"SELECT '{table}' AS tab, k AS key, m.measure AS measure, round_even(m.value, {PLACES}) AS value FROM (SELECT {keys} AS k, unnest([{each}]) AS m FROM {source})"


DESCRIBED = ("mean", "median", "std", "min", "q25", "q75", "max", "count")
PAIRED = ("wins_a", "wins_b", "ties", "n_pairs", "mean_a", "mean_b", "w", "z", "p_value")
CONSOLIDATED = sql(
    TESTED
    + ", wd AS (" + WIDE.rsplit("wd AS (", 1)[1][:-1] + "), ds AS (SELECT coalesce(project, 'Overall') AS scope, strategy, " + STATS + " FROM lg GROUP BY GROUPING SETS ((strategy), (project, strategy)))"
    + ", wn AS (SELECT strategy_a, strategy_b, count(*) FILTER (WHERE a > b) AS wins_a, count(*) FILTER (WHERE a < b) AS wins_b, count(*) FILTER (WHERE a = b) AS ties, count(*) AS n_pairs, round_even(avg(a), 4) AS mean_a, round_even(avg(b), 4) AS mean_b FROM pr GROUP BY ALL)"
    + ", te AS (SELECT wn.*, w, z, p_value FROM wn LEFT JOIN pv USING (strategy_a, strategy_b))"
    + ", bw AS (SELECT " + _label("greatest") + " AS best, count(*) AS n FROM wd GROUP BY ALL) "
    + " UNION ALL ".join([
        tall_sql("long", "strategy || '/' || project || '/' || bug", {"apfd": "apfd"}, "lg"),
        tall_sql("wide", "project || '/' || bug", {s: f'"{s}"' for s in STRATEGIES}, "wd"),
        tall_sql("descriptive", "scope || '/' || strategy", {c: c for c in DESCRIBED}, "ds"),
        tall_sql("best", "best", {"n": "n"}, "bw"),
        tall_sql("pairwise", "strategy_a || '/' || strategy_b", {c: c for c in PAIRED} | {"significant": "coalesce(p_value < 0.05, false)"}, "te"),
    ])
)


@query("Q10_consolidate", CONSOLIDATED)
def q10(spark, d):
    """All tables of the consolidation, as written and read again, one row for each value."""
    found = jobs.consolidate(long_results(spark, d), STRATEGIES)

    def tall(name: str, keys: list[str], columns: list[str]):
        each = F.array(*[F.struct(F.lit(c).alias("measure"), F.bround(F.col(f"`{c}`").cast("double"), PLACES).alias("value")) for c in columns])
        return found[name].select(F.lit(name).alias("tab"), F.concat_ws("/", *keys).alias("key"), F.inline(each))

    out = tall("long", ["strategy", *KEYS], ["apfd"])
    for part in (tall("wide", KEYS, STRATEGIES), tall("descriptive", ["scope", "strategy"], list(DESCRIBED)), tall("best", ["best"], ["n"]), tall("pairwise", ["strategy_a", "strategy_b"], [*PAIRED, "significant"])):
        out = out.unionByName(part)
    return out


@query("A24_coverage", sql(LONG + ", e AS (SELECT project, bug, count(DISTINCT strategy) AS n FROM lg GROUP BY ALL), kk AS (SELECT count(DISTINCT strategy) AS s FROM lg) SELECT max(s) AS strategies, count(*) AS changes, count(*) FILTER (WHERE n = s) AS covered_by_all, count(*) = count(*) FILTER (WHERE n = s) AS complete FROM e, kk"))
def a24(spark, d):
    return stats.coverage(kept(long_results(spark, d)))


BOX = LONG + """, sc AS (SELECT 'Overall' AS scope, strategy, apfd FROM lg UNION ALL SELECT project, strategy, apfd FROM lg),
    qt AS (SELECT scope, strategy, count(*) AS n, avg(apfd) AS mean, quantile_cont(apfd, 0.25) AS q1, quantile_cont(apfd, 0.5) AS median, quantile_cont(apfd, 0.75) AS q3 FROM sc WHERE apfd IS NOT NULL GROUP BY ALL)
    SELECT scope, strategy, n, round_even(any_value(mean), 8) AS mean, round_even(any_value(q1), 8) AS q1, round_even(any_value(median), 8) AS median, round_even(any_value(q3), 8) AS q3,
        min(apfd) FILTER (WHERE apfd >= q1 - 1.5 * (q3 - q1) AND apfd <= q3 + 1.5 * (q3 - q1)) AS whisker_low, max(apfd) FILTER (WHERE apfd >= q1 - 1.5 * (q3 - q1) AND apfd <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
        count(*) FILTER (WHERE NOT (apfd >= q1 - 1.5 * (q3 - q1) AND apfd <= q3 + 1.5 * (q3 - q1))) AS n_outliers
    FROM sc JOIN qt USING (scope, strategy) WHERE apfd IS NOT NULL GROUP BY scope, strategy, n"""


@query("Q14_boxplot", sql(BOX))
def q14(spark, d):
    box = stats.boxplot(kept(long_results(spark, d)))
    return box.select("scope", "strategy", "n", *[exact(F.col(c), 8).alias(c) for c in ("mean", "q1", "median", "q3")], "whisker_low", "whisker_high", "n_outliers")


@query("O2_strategies_by_mean", sql(LONG + f" SELECT strategy, round_even(avg(apfd), 4) AS mean, row_number() OVER (ORDER BY round_even(avg(apfd), 4) DESC, {IDX}) AS place FROM lg GROUP BY strategy"))
def o2(spark, d):
    means = long_results(spark, d).groupBy("strategy").agg(exact(F.avg("apfd"), 4).alias("mean"))
    index = F.array_position(F.array(*map(F.lit, STRATEGIES)), F.col("strategy"))
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), index)).cast("long"))  # one row for each strategy


SCORED = ", sf AS (SELECT *, same_package + history * 0.5::DOUBLE AS score, (same_package + history * 0.5::DOUBLE >= 0.5)::INT AS predicted FROM f)"


def scored(spark, d):
    score = F.col("same_package") + F.col("history") * 0.5
    return derived.features(spark, d).withColumn("score", score).withColumn("predicted", (score >= 0.5).cast("int"))


CONFUSION = """SELECT coalesce(project, 'Overall') AS scope, count(*) FILTER (WHERE predicted = 0 AND label = 0) AS tn, count(*) FILTER (WHERE predicted = 1 AND label = 0) AS fp, count(*) FILTER (WHERE predicted = 0 AND label = 1) AS fn,
    count(*) FILTER (WHERE predicted = 1 AND label = 1) AS tp, sum(label)::BIGINT AS positives, count(*) AS rows, count(DISTINCT (project, bug)) AS changes FROM sf GROUP BY GROUPING SETS ((), (project))"""


@query("A11_confusion", sql(SCORED + CONFUSION))
def a11(spark, d):
    return classify.confusion(scored(spark, d))


@query("A12_precision_recall", sql(SCORED + f", cf AS ({CONFUSION}) SELECT scope, round_even(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 4) AS precision, round_even(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 4) AS recall, round_even(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM cf"))
def a12(spark, d):
    return classify.scores_of(classify.confusion(scored(spark, d))).select("scope", "precision", "recall", "f1")


@query("K11_sums_to_overall", sql(SCORED + f", cf AS ({CONFUSION}) SELECT m AS measure, max(v) FILTER (WHERE scope = 'Overall')::BIGINT AS overall, sum(v) FILTER (WHERE scope <> 'Overall')::BIGINT AS by_project, max(v) FILTER (WHERE scope = 'Overall') = sum(v) FILTER (WHERE scope <> 'Overall') AS ok FROM (UNPIVOT cf ON tn, fp, fn, tp INTO NAME m VALUE v) GROUP BY m"))
def k11(spark, d):
    return classify.sums_to_overall(classify.confusion(scored(spark, d)), ["tn", "fp", "fn", "tp"])


AUC = "sum(p * (below + n::DOUBLE / 2)) / (sum(p)::DOUBLE * sum(n))"


def _auc_sql(by: str) -> str:
    key = by + ", " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f", sc AS (SELECT {key}score, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM sf GROUP BY ALL), cm AS (SELECT *, coalesce(sum(n) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below FROM sc) SELECT {key}round_even({AUC}, 10) AS auc, sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives FROM cm" + (f" GROUP BY {by}" if by else "")


@query("A13_auc", sql(SCORED + _auc_sql("")))
def a13(spark, d):
    return classify.auc(scored(spark, d)).withColumn("auc", exact(F.col("auc")))


@query("W8_auc_by_project", sql(SCORED + _auc_sql("project")))
def w8(spark, d):
    return classify.auc(scored(spark, d), by=["project"]).withColumn("auc", exact(F.col("auc")))


FOLDS = ", fs AS (SELECT project, bug, count(*) AS size FROM f GROUP BY ALL), fr AS (SELECT *, row_number() OVER (ORDER BY size DESC, project, bug) - 1 AS r FROM fs), fd AS (SELECT project, bug, size, (CASE WHEN (r // 5) % 2 = 1 THEN 4 - r % 5 ELSE r % 5 END)::INT AS fold FROM fr)"


@query("W10_group_folds", sql(FOLDS + " SELECT * FROM fd"))
def w10(spark, d):
    return classify.group_folds(derived.features(spark, d))


@query("A14_fold_auc", sql(FOLDS + SCORED.replace("FROM f", "FROM (SELECT f.*, fold FROM f JOIN fd ON f.project = fd.project AND f.bug = fd.bug)") + ", au AS (SELECT fold, auc FROM (WITH " + _auc_sql("fold").removeprefix(", ") + ")) SELECT round_even(avg(auc), 4) AS mean, round_even(stddev_pop(auc), 4) AS std FROM au"))
def a14(spark, d):
    f = kept(scored(spark, d))
    rows = f.join(classify.group_folds(f).select(*KEYS, "fold"), KEYS)
    return classify.fold_summary(classify.auc(rows, by=["fold"]))


@query("A15_constant_features", sql(", ct AS (SELECT project, bug, count(DISTINCT history) AS history, count(DISTINCT same_package) AS same_package, count(DISTINCT modified_classes_count) AS modified_classes_count FROM f GROUP BY ALL) SELECT feature, count(*) FILTER (WHERE n = 1) AS constant_changes, count(*) AS changes, count(*) FILTER (WHERE n <> 1) = 0 AS always FROM (UNPIVOT ct ON history, same_package, modified_classes_count INTO NAME feature VALUE n) GROUP BY feature"))
def a15(spark, d):
    return classify.constant_within_change(derived.features(spark, d), ["history", "same_package", "modified_classes_count"])


@query("A16_ablation_summary", sql(WIDE + ' SELECT strategy, round_even(avg(apfd), 4) AS mean, round_even(median(apfd), 4) AS median, round_even(stddev_samp(apfd), 4) AS std, count(apfd) AS n_bugs FROM (UNPIVOT wd ON "Random", "History-based", "Same-Package", "Combined" INTO NAME strategy VALUE apfd) GROUP BY strategy'))
def a16(spark, d):
    w = stats.wide(long_results(spark, d), STRATEGIES)
    tall = w.unpivot(KEYS, [f"`{s}`" for s in STRATEGIES], "strategy", "apfd")
    return stats.strategy_summary(tall, ["strategy"]).select("strategy", "mean", "median", "std", F.col("count").alias("n_bugs"))


@query("J10_variants_with_baselines", sql(ranked_sql("v", "same_package + history * 0.1") + ranked_sql("b", "history") + " SELECT v.project, v.bug, round_even(v.apfd, 10) AS variant, round_even(b.apfd, 10) AS baseline FROM v LEFT JOIN (SELECT * FROM b WHERE bug % 2 = 0) b ON v.project = b.project AND v.bug = b.bug"))
def j10(spark, d):
    f = kept(derived.features(spark, d))
    v, b = apfd_of(f, SCORES["Combined"]), apfd_of(f, "history").where("bug % 2 = 0")
    return v.select(*KEYS, exact(F.col("apfd")).alias("variant")).join(b.select(*KEYS, exact(F.col("apfd")).alias("baseline")), KEYS, "left")


@query("Q7_random_baseline", sql(RANDOM + f" SELECT project, {SUMMARY} FROM rnd GROUP BY project"))
def q7(spark, d):
    f = kept(derived.labelled(spark, d))
    return stats.strategy_summary(order.seed_summary(order.random_apfd(f, SEEDS)).withColumnRenamed("apfd_mean", "apfd"), ["project"])


@query("P1_renamed_metric", sql(ranked_sql("r", "same_package") + ' SELECT project, bug, round_even(apfd, 10) AS "Same-Package" FROM r WHERE apfd IS NOT NULL'))
def p1(spark, d):
    results = apfd_of(derived.features(spark, d), "same_package").where("apfd is not null")
    return results.select(*KEYS, exact(F.col("apfd")).alias("apfd")).withColumnRenamed("apfd", "Same-Package")


@query("P6_scope_filter", sql(ranked_sql("r", "history") + f" SELECT 'MACHINERY' AS scope, {SUMMARY} FROM r WHERE project = 'MACHINERY'"))
def p6(spark, d):
    rows = apfd_of(derived.features(spark, d).where("project = 'MACHINERY'"), "history")
    return stats.strategy_summary(rows).select(F.lit("MACHINERY").alias("scope"), "*")


@query("O1_sorted_results", sql(ranked_sql("r", "history") + " SELECT project, bug, n_tests, n_trigger_tests FROM r ORDER BY project, bug"))
def o1(spark, d):
    return apfd_of(derived.features(spark, d), "history").select(*KEYS, "n_tests", "n_trigger_tests").orderBy(*KEYS)


@query("X1_numpy_orders")
def x1_numpy(spark, d):
    """The random strategy with numpy's own permutations of each change's tests in their stored order."""
    return order.numpy_random_apfd(derived.features(spark, d), SEEDS)


@query("X2_two_sided_p", sql(TESTED + f" SELECT strategy_a, strategy_b, round_even(z, {PLACES}) AS z, round_even(p_value, {PLACES}) AS p_value FROM pv"))
def x2(spark, d):
    ranks = stats.signed_ranks(stats.pairs(kept(long_results(spark, d)), STRATEGIES))
    return ranks.select("strategy_a", "strategy_b", exact(F.col("z"), PLACES).alias("z"), exact(stats.two_sided_p("z"), PLACES).alias("p_value"))


@query("A23_outliers", sql(BOX.split("SELECT scope, strategy, n, round_even")[0] + " SELECT scope, strategy, project, bug, apfd FROM (SELECT 'Overall' AS scope, strategy, project, bug, apfd FROM lg UNION ALL SELECT project, strategy, project, bug, apfd FROM lg) x JOIN qt USING (scope, strategy) WHERE NOT (apfd >= q1 - 1.5 * (q3 - q1) AND apfd <= q3 + 1.5 * (q3 - q1))"))
def a23(spark, d):
    long = kept(long_results(spark, d))
    return stats.outliers(long).select("scope", "strategy", *KEYS, "apfd")
