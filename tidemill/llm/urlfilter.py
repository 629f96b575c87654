"""URL verdicts: rules where one fits, else trust and distrust carried along links between hosts.

Both are personalised PageRank over the links from one host to another. Trust starts at the hosts with allowed pages
and follows links, shared out among the links of a host. Distrust starts at the hosts with blocked pages and goes
against the links, shared out among the hosts that link to a host. A host's seed is the share of its pages that the
rules allow, or block; scores are in these units, so that they add up to the sum of the seeds, and a host without
links around it keeps its own. What arrives where no link leads on goes back to the seeds. The verdict is one per
host. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import lower_ascii, remove, scratch, stored

#: (verdict, rule): host and path prefix, as one string.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Hosts named by absolute and protocol-relative links.
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; null and URLs without :// have the empty host."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(verdict, rule) of the longest rule that fits the host or a parent domain and starts the path; else nulls."""
    verdict = rule = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        verdict, rule = F.when(fits, kind).otherwise(verdict), F.when(fits, text).otherwise(rule)
    return verdict, rule


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, by_src, by_dst): links from a host to another, as shares of those that leave src and that reach dst."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1))
    away = pages.select(F.col("host").alias("src"), F.explode(found).alias("dst")).select("src", lower_ascii(F.col("dst")).alias("dst")).where("src <> dst")
    counted = stored(away.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")), "url-links")
    sums = lambda end: counted.groupBy(F.col(end).alias(f"_{end}")).agg(F.sum("n").alias(f"all_{end}"))
    both = counted.join(sums("src"), F.col("src") == F.col("_src")).join(sums("dst"), F.col("dst") == F.col("_dst"))
    return both.select("src", "dst", (F.col("n") / F.col("all_src")).alias("by_src"), (F.col("n") / F.col("all_dst")).alias("by_dst"))


def propagate(hosts: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 150, settled: float = 1e-4) -> DataFrame:
    """(host, trust, distrust) from stored tables (host, allowed, blocked: shares of its pages) and ``host_edges``.

    Five rounds are one job, whose scores are written to the shared folder; the driver sees four numbers of it. Rounds
    end when the last one moved the scores by ``settled`` of the seeds at most, all hosts taken together. Raises if
    ``rounds`` are not enough. What is lost where no link leads on comes back by scaling at the end, which is the
    same as giving it to the seeds in every round. Hosts that are only linked to have seeds of zero.
    """
    spark = hosts.sparkSession
    linked = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct().select("host", F.lit(0.0).alias("allowed"), F.lit(0.0).alias("blocked"))
    nodes = stored(hosts.select("host", "allowed", "blocked").unionByName(linked).groupBy("host").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked")), "url-nodes")
    seeds = [x or 0.0 for x in nodes.agg(F.sum("allowed"), F.sum("blocked")).first()]
    step, path = nodes.select("*", *[((1 - damping) * F.col(c)).alias(n) for c, n in (("allowed", "trust"), ("blocked", "distrust"))]), None
    for _ in range(0, rounds, 5):
        for _ in range(5):
            by = edges.join(step.select(F.col("host").alias("src"), "trust"), "src").groupBy(F.col("dst").alias("_by")).agg(F.sum(F.col("by_src") * F.col("trust")).alias("t"))
            to = edges.join(step.select(F.col("host").alias("dst"), "distrust"), "dst").groupBy(F.col("src").alias("_to")).agg(F.sum(F.col("by_dst") * F.col("distrust")).alias("d"))
            joined = step.join(by, F.col("host") == F.col("_by"), "left").join(to, F.col("host") == F.col("_to"), "left")
            score = lambda seed, got: (1 - damping) * F.col(seed) + damping * F.coalesce(got, F.lit(0.0))
            trust, distrust = score("allowed", "t"), score("blocked", "d")
            moved = [F.abs(trust - F.col("trust")).alias("moved_t"), F.abs(distrust - F.col("distrust")).alias("moved_d")]
            step = joined.select(*nodes.columns, trust.alias("trust"), distrust.alias("distrust"), *moved)
        new = scratch(spark, "url-scores")
        step.write.parquet(new)
        if path:
            remove(spark, path)
        path, step = new, spark.read.schema(step.schema).parquet(new)
        *kept, moved_t, moved_d = [x or 0.0 for x in step.agg(F.sum("trust"), F.sum("distrust"), F.sum("moved_t"), F.sum("moved_d")).first()]
        if moved_t <= settled * seeds[0] and moved_d <= settled * seeds[1]:
            scale = [s / k if k else 0.0 for s, k in zip(seeds, kept)]
            return step.select("host", *[(F.col(c) * x).alias(c) for c, x in zip(("trust", "distrust"), scale)])
        step = step.drop("moved_t", "moved_d")
    raise RuntimeError(f"scores did not settle in {rounds} rounds")


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of ``pages`` (page_id, url, html).

    The longest fitting rule decides. Else a host is blocked if its distrust reaches ``threshold``, as that of a host
    with this share of blocked pages and no links does, and exceeds its trust. A host without seeds around it is
    allowed; the empty host of a null or malformed URL is judged like others. Null html has no links. Repeated rows
    stay.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    verdict, rule = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    share = lambda kind: F.avg(F.when(F.col("by_rule") == kind, 1.0).otherwise(0.0))
    hosts = stored(ruled.groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")), "url-hosts")
    scores = propagate(hosts, stored(host_edges(parsed), "url-edges"))
    decided = scores.select(F.col("host").alias("_host"), "trust", "distrust", F.when((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow").alias("by_host"))
    return ruled.join(decided, F.col("host") == F.col("_host"), "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_host").alias("verdict"), "trust", "distrust")
