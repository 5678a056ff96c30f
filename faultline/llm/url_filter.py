"""URL filters: rules first, then trust and distrust that spread over the host graph.

Host edges come from the pages' absolute links, counted before they are shuffled. Two personalised PageRanks run
over them as joins and sums: trust starts at hosts with allowed pages and follows links; distrust starts at
hosts with blocked pages and follows links backwards, to the hosts that link there. Mass at hosts without
a way on returns to the seeds. Masses are counted in whole seeds: a host's
rank, times the sum of all seeds' strengths, over the part of a seed's own mass that stays with it. That is the sum over all chains of links from seeds of strength times damping, so
it doesn't change with pages that no chain joins to the host. The rounds go on until no more than TOLERANCE whole seeds can still move, anywhere. A host is blocked if its distrust is over MARGIN times its trust and over LEAST; its pages that no rule fits get
that verdict. A seed's strength is the share of the host's own pages that a rule blocks or allows, so that a rule for one path
of a host doesn't condemn the rest of it.

Rules are (host, path prefix, verdict); a rule fits its host and all subdomains if the url's path starts with its path;
the longest (host and path) wins, then the longest host.

Defined results: a null url, or one without ://, has host and path empty and is allowed unless a rule says otherwise (none fits an empty host);
null html has no links; long urls and pages are read whole; of rules of equal length the one with the longer host wins; repeated rows are judged each, and count each as a seed; hosts without links are judged by
their own pages only; an empty table gives an empty result; other columns of the input don't matter.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, small_or_not, staged

#: (host, path, verdict). Fixed values.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DAMPING = 0.85
#: Whole seeds that may be left where more rounds would move them, in all.
TOLERANCE = 0.001
MARGIN = 2.0
LEAST = 0.1
BROADCAST_HOSTS = 100_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host and path, its verdict) of the longest rule that fits; null if none does."""
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    fits = [((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)) for h, p, _ in order]
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for fit, (h, p, v) in reversed(list(zip(fits, order, strict=True))):
        name, verdict = F.when(fit, F.lit(h + p)).otherwise(name), F.when(fit, F.lit(v)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: the links from pages of one host to another host."""
    links = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'>\s]+)"""), 1)
    found = pages.select("host", F.explode(links).alias("link")).select(F.col("host").alias("src"), ascii_lower(F.col("link")).alias("dst"))
    return found.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def spread(seeds: DataFrame, edges: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING, total: float | None = None) -> DataFrame:
    """(host, rank) of a personalised PageRank from staged seeds (host, seed), which sum to 1, over staged edges (src, dst, share), whose shares sum to 1 for each src.

    With total, the sum of the seeds' strengths, ranks and tolerance are in whole seeds, whatever returns to the seeds from hosts without a way on.
    """
    if edges.isEmpty():
        return seeds.select("host", (F.col("seed") * (total or 1.0)).alias("rank"))
    none = F.lit(0.0)
    ways = staged(edges.select(F.col("src").alias("host"), none.alias("rank"), none.alias("before"), F.lit(1).alias("way")).distinct(), "ways")
    ranks = staged(_added(seeds.select("host", F.col("seed").alias("rank"), none.alias("before"), F.lit(0).alias("way")).unionByName(ways)), "ranks")
    moved = ranks.agg(F.sum(F.when(F.col("way") > 0, F.col("rank")))).first()[0] or 0.0  # one number
    for k in count():
        on = ranks.where("rank > 0").join(edges, ranks["host"] == edges["src"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share") * damping).alias("rank"))
        on = on.select(F.col("dst").alias("host"), "rank", none.alias("before"), F.lit(0).alias("way"))
        back = seeds.select("host", (F.col("seed") * (1 - damping * moved)).alias("rank"), none.alias("before"), F.lit(0).alias("way"))
        old = ranks.select("host", none.alias("rank"), F.col("rank").alias("before"), "way")
        ranks = staged(_added(on.unionByName(back).unionByName(old)), f"ranks-{k}")
        moved, change = ranks.agg(F.coalesce(F.sum(F.when(F.col("way") > 0, F.col("rank"))), none), F.coalesce(F.sum(F.abs(F.col("rank") - F.col("before"))), none)).first()
        unit = total / (1 - damping * moved) if total else 1.0
        if change * damping / (1 - damping) * unit <= tolerance:
            return ranks.where("rank > 0").select("host", (F.col("rank") * unit).alias("rank"))


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("before").alias("before"), F.max("way").alias("way"))


def _shares(edges: DataFrame, src: str, dst: str) -> DataFrame:
    out = edges.groupBy(src).agg(F.sum("weight").alias("all")).withColumnRenamed(src, "of")
    return edges.join(out, F.col(src) == F.col("of")).select(F.col(src).alias("src"), F.col(dst).alias("dst"), (F.col("weight") / F.col("all")).alias("share"))


def host_verdicts(judged: DataFrame, edges: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust and distrust in whole seeds, and blocked, for staged pages (host, ruled) and staged edges (src, dst, weight)."""
    hosts = judged.where("host <> ''").groupBy("host").agg(*[F.avg(F.coalesce((F.col("ruled") == v).cast("double"), F.lit(0.0))).alias(v) for v in ("allow", "block")])
    hosts = staged(hosts, "hosts")
    sums = hosts.agg(F.sum("allow").alias("a"), F.sum("block").alias("b")).first()

    def rank(v: str, total: float | None, src: str, dst: str) -> DataFrame:
        if not total:
            return hosts.limit(0).select("host", F.lit(0.0).alias(v))
        seeds = staged(hosts.where(F.col(v) > 0).select("host", (F.col(v) / total).alias("seed")), "seeds")
        return spread(seeds, staged(_shares(edges, src, dst), "shares"), tolerance, total=total).withColumnRenamed("rank", v)

    trust = rank("allow", sums["a"], "src", "dst").select("host", F.col("allow").alias("trust"))
    distrust = rank("block", sums["b"], "dst", "src").select("host", F.col("block").alias("distrust"))
    out = hosts.join(trust, "host", "left").join(distrust, "host", "left").na.fill(0.0, ["trust", "distrust"])
    blocked = (F.col("distrust") > MARGIN * F.col("trust")) & (F.col("distrust") > LEAST)
    return out.select("host", "trust", "distrust", blocked.alias("blocked"))


def url_report(pages: DataFrame, rules=RULES, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule, verdict of each row."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    placed = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    edges = staged(host_edges(placed), "edges")
    judged = staged(placed.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled")), "judged")
    blocked = staged(host_verdicts(judged, edges, tolerance).where("blocked").select(F.col("host").alias("bad_host")), "blocked")
    rest = F.when(F.col("bad_host").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.join(small_or_not(blocked, BROADCAST_HOSTS), F.col("host") == F.col("bad_host"), "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", rest).alias("verdict"))
