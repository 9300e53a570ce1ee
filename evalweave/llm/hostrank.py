"""Link-graph URL filter: trust and distrust spread over host edges, judged per host. DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm.common import shared_path, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Hosts up to which their verdicts are broadcast to the pages (about 60 bytes each).
BROADCAST_HOSTS = 500_000

# Largest change of a host's value in a round, as a share of the value, at which PageRank is done.
TOLERANCE = 1e-6

# Targets of links with a scheme or without one (//host/...).
LINK = r"""(?i)(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, else null. A rule is ``host/path``; it fits the host and its subdomains if the path
    begins with the rule's. Rules are a parameter (a list in the plan)."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):  # the longest is asked first
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def host_edges(pages: DataFrame, html: str) -> DataFrame:
    """(src, dst, weight): links of each host to other hosts, counted. Relative links stay on their host and give no
    edge. ``pages`` has a ``host``."""
    return (
        pages.where(F.col("host") != "")
        .select("host", F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1))).alias("url"))
        .select(
            F.col("host").alias("src"),
            host_of(F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), F.col("url"))).otherwise(F.col("url"))).alias("dst"),
        )
        .where((F.col("dst") != "") & (F.col("dst") != F.col("src")))
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )


def pagerank(hosts: DataFrame, edges: DataFrame, seeds: list[str], alpha: float, rounds: int | None = None) -> DataFrame:
    """(host, *seeds): personalised PageRank, for several seed vectors at once (columns of ``hosts``).

    It goes on until no value changes by more than TOLERANCE of the host's value for the last seed vector, or for ``rounds``.
    The last vector must cover the others: it bounds them, so the changes bound those of shares of it. A wave of mass that is
    small beside one host is as small beside every host it goes on to, as that host has got its part of the rest before.

    Each round sends ``alpha`` of a host's mass along its edges in proportion to their weights and adds ``1 - alpha`` of
    its seed. A host without edges keeps its own mass; without ``rounds`` it gets at once what that comes to, so a graph without
    circles is done after as many rounds as its longest path. Each round is stored, so plans stay short and a lost executor costs
    one round at most.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("all"))
    steps = stored(
        edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("all")).alias("share")), "steps"
    )
    if steps.isEmpty():
        return hosts.select("host", *seeds)
    linked = steps.select(F.col("src").alias("host")).distinct().withColumn("linked", F.lit(True))
    base = stored(hosts.select("host", *[F.col(c).alias(f"seed_{c}") for c in seeds]).join(linked, "host", "left"), "base")
    mass = base.select("host", *[F.col(f"seed_{c}").alias(c) for c in seeds])
    older, done = None, 0
    while rounds is None or done < rounds:
        moved = (
            mass.join(steps, mass["host"] == steps["src"])
            .groupBy("dst")
            .agg(*[F.sum(F.col(c) * F.col("share")).alias(f"got_{c}") for c in seeds])
        )

        def after(c: str) -> Column:
            seed, got, alone = F.col(f"seed_{c}"), F.coalesce(f"got_{c}", F.lit(0.0)), F.col("linked").isNull()
            if rounds is None:
                return F.when(alone, seed + alpha / (1 - alpha) * got).otherwise((1 - alpha) * seed + alpha * got)
            return (1 - alpha) * seed + alpha * (got + F.when(alone, F.col(c)).otherwise(0.0))

        whole = after(seeds[-1])
        change = F.greatest(F.lit(0.0), *[F.abs(after(c) - F.col(c)) for c in seeds])
        path = shared_path(hosts.sparkSession, "mass")
        fresh = (
            base.join(mass, "host")
            .join(moved, base["host"] == moved["dst"], "left")
            .select(base["host"], *[after(c).alias(c) for c in seeds], F.when(whole > 0, change / whole).otherwise(0.0).alias("change"))
        )
        fresh.write.parquet(path)
        mass = hosts.sparkSession.read.schema(fresh.schema).parquet(path)
        if older:
            removed(hosts.sparkSession, older)
        older, done = path, done + 1
        if rounds is None and (mass.agg(F.max("change")).first()[0] or 0.0) <= TOLERANCE:
            break
    return mass.select("host", *seeds)


def removed(spark: SparkSession, path: str) -> None:
    """Delete the folder of an earlier round, so that the disk holds two rounds however many there are."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def host_verdicts(
    pages: DataFrame, html: str, rules: dict[str, str], alpha: float = 0.85, rounds: int | None = None, threshold: float = 0.5
) -> DataFrame:
    """(host, trust, distrust, blocked) per host; ``pages`` has ``host`` and ``rule``.

    Seeds are the pages that a rule allows or blocks. Trust follows the links; distrust follows them backwards (who links to
    bad hosts is suspect). Both are taken as shares of what arrives if all pages are seeds, so they lie between 0 and 1
    whatever a host's size. A host is blocked if its distrust exceeds its trust by more than ``threshold``.
    """
    verdict = by_rule(rules)
    own = (
        pages.where(F.col("host") != "")
        .groupBy("host")
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.count(F.when(verdict == "allow", 1)).alias("allowed"),
            F.count(F.when(verdict == "block", 1)).alias("banned"),
        )
    )
    edges = stored(host_edges(pages, html), "edges")
    ends = edges.select(F.col("dst").alias("host")).distinct()
    hosts = stored(
        own.join(ends, "host", "full").select(
            "host", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("pages", "allowed", "banned")]
        ),
        "hosts",
    )
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")

    def share(seed: str, along: DataFrame, name: str) -> DataFrame:
        mass = pagerank(hosts, along, [seed, "pages"], alpha, rounds)
        return mass.select("host", F.when(F.col("pages") > 0, F.col(seed) / F.col("pages")).otherwise(0.0).alias(name))

    return (
        share("allowed", edges, "trust")
        .join(share("banned", back, "distrust"), "host")
        .withColumn("blocked", F.col("distrust") - F.col("trust") > threshold + 1e-9)
    )


def by_rule(rules: dict[str, str]) -> Column:
    """The verdict of the row's ``rule``, null without one."""
    return reduce(lambda c, r: F.when(F.col("rule") == r, F.lit(rules[r])).otherwise(c), rules, F.lit(None).cast("string"))


def filter_urls(
    pages: DataFrame, page_id: str, url: str, html: str, rules: dict[str, str], alpha: float = 0.85, rounds: int | None = None, threshold: float = 0.5
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every page, by the longest rule or else by the verdict on its host.

    A null url or one without ``://`` has an empty host and path, fits no rule and is allowed. A null html has no
    links. Repeated pages are judged one by one. Other columns are not read.
    """
    judged = pages.select(
        F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html")
    ).withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    hosts = stored(host_verdicts(judged, "html", rules, alpha, rounds, threshold).where("blocked").select("host", "blocked"), "verdicts")
    # Most hosts are not blocked; a large host's pages are not moved if the blocked ones fit a broadcast.
    blocked = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    return (
        judged.drop("html")
        .join(blocked, "host", "left")
        .select(
            "page_id",
            "host",
            "path",
            "rule",
            F.coalesce(by_rule(rules), F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        )
    )
