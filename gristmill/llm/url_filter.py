"""URL filters: rules by longest prefix, and for the rest trust and distrust that flow over the hosts' link graph.

Native: DataFrame functions only. Trust is personalised PageRank from hosts with allowed pages, along the links;
distrust is the same from hosts with blocked pages, against them. Both states live in one table keyed by (host, kind),
so that an iteration is one join and one aggregation over the host graph, not over pages.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import forget, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: The host of an absolute or scheme-relative link.
LINKS = r"""(?i)\bhref\s{0,20}=\s{0,20}["']?\s{0,20}(?:https?:)?//([^/?#"'\s<>]+)"""


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(url, URL_PARTS, k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, else null. Rules of one length: the first given."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(reversed(rules), key=lambda r: len(r.host) + len(r.path)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """Personalised PageRank. ``seeds`` (host, kind, mass), summing to 1 per kind; ``edges`` (kind, src, dst, share),
    the shares of a src summing to 1. Mass of hosts without links goes back to the seeds. Returns (host, kind, score).

    Ends when the scores of all hosts together change by less than ``tolerance``, and each by no more than ``tolerance``
    of itself, so that hosts far from the seeds, or of small score among many, have theirs too. That is met at any size:
    changes shrink by ``damping`` in each round. Empty tables: an empty result.
    """
    edges = written(edges, "edges")
    seeds = state = written(seeds.select("host", "kind", F.col("mass").alias("score")), "seeds")
    while True:
        moved = (
            state.join(edges, (state.host == edges.src) & (state.kind == edges.kind))
            .groupBy(F.col("dst").alias("host"), edges.kind.alias("kind"))
            .agg(F.sum(F.col("score") * F.col("share")).alias("score"))
        )
        kept = moved.groupBy("kind").agg(F.sum("score").alias("kept"))  # a row a kind
        back = (
            seeds.join(F.broadcast(kept), "kind", "left")  # two rows at most
            .select("host", "kind", (F.col("score") * (1 - damping * F.coalesce("kept", F.lit(0.0)))).alias("score"))
        )
        zero = F.lit(0.0)
        parts = (
            back.withColumn("before", zero)
            .unionByName(moved.select("host", "kind", (damping * F.col("score")).alias("score"), zero.alias("before")))
            .unionByName(state.select("host", "kind", zero.alias("score"), F.col("score").alias("before")))
        )
        after = written(parts.groupBy("host", "kind").agg(F.sum("score").alias("score"), F.sum("before").alias("before")), "scores")
        change = F.abs(F.col("score") - F.col("before"))
        total, many = after.agg(F.sum(change), F.count(F.when(change > tolerance * F.greatest("score", "before"), 1))).first()  # a scan
        forget(*[state] * (state is not seeds))
        state = after
        if (total or 0.0) < tolerance and not many:
            return state.drop("before")


def filter_urls(
    pages: DataFrame, rules: Sequence[Rule] = RULES, id_column: str = "page_id", threshold: float = 1.0, floor: float = 0.0
) -> DataFrame:
    """A row for each page: id, host, path, rule, verdict, trust, distrust.

    The rule's verdict holds where one fits. Else the host's: block if its distrust is over ``floor`` and over
    ``threshold`` times its trust, else allow; a host that neither reaches is allowed, as is the empty host. Scores are
    shares of all seeds, so that a ``floor`` over 0 means less on small tables than on large ones.
    Null html has no links; repeated rows are judged alike, and add to their hosts' mass; pages of any length are read
    whole; other columns are left out; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    judged = pages.select(F.col(id_column), host.alias("host"), path.alias("path"), "html")
    judged = judged.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    by_host = written(
        judged.where("host <> ''").groupBy("host").agg(
            F.count(F.when(F.col("fit.verdict") == "allow", 1)).alias("trusted"),
            F.count(F.when(F.col("fit.verdict") == "block", 1)).alias("blocked"),
        ),
        "hosts",
    )
    kinds = by_host.select("host", F.explode(F.create_map(F.lit("trust"), "trusted", F.lit("distrust"), "blocked")).alias("kind", "pages")).where("pages > 0")
    totals = kinds.groupBy("kind").agg(F.sum("pages").alias("total"))
    seeds = kinds.join(F.broadcast(totals), "kind").select("host", "kind", (F.col("pages") / F.col("total")).alias("mass"))  # two rows

    linked = judged.where("host <> ''").select(
        F.col("host").alias("src"),
        F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINKS), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER)))).alias("dst"),
    )
    links = written(linked.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n")), "links")
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    )
    out = both.groupBy(F.col("kind").alias("k"), F.col("src").alias("s")).agg(F.sum("n").alias("total"))
    edges = both.join(out, (F.col("k") == F.col("kind")) & (F.col("s") == F.col("src"))).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share"))

    scores = propagate(seeds, edges).groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("score"))).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("score"))).alias("distrust"),
    )
    scores = written(scores, "host_scores")  # a row a host: broadcast by Spark below its limit, else a skew-aware join
    return judged.drop("html").join(scores, "host", "left").select(
        id_column, "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(
            F.col("fit.verdict"),
            F.when((F.coalesce("distrust", F.lit(0.0)) > floor) & (F.col("distrust") > threshold * F.coalesce("trust", F.lit(0.0))), "block").otherwise("allow"),
        ).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` under the five production rules."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
