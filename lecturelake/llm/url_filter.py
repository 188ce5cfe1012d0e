"""URL verdicts: host and path rules first, then trust and distrust spread over the host graph.

A rule ``host/path`` fits its host and all subdomains where the url's path starts with the rule's path; of
the rules that fit, the longest wins. Pages that no rule fits get their host's verdict: personalised PageRank
spreads trust from hosts with allowed pages along links, and distrust from hosts with blocked pages against
them, both by joins over one pre-aggregated table of host edges. Edges are the absolute links in the pages'
HTML and the bonds between a host and each domain that it is under, down to two labels, so that hosts of one
domain share it even where it has no pages itself. Ranks are spread until nothing that is still on its way
could turn a verdict, however long the chains of links are, or until they converge. A host is blocked where its distrust exceeds its trust by a factor.

A relative link stays on its host, and links of a host to itself say nothing about another one, so only
absolute and ``//`` links are edges.

Defined results: a null url or one without ``://`` has an empty host and path, no rule, and is allowed as
nothing is known about it; null HTML has no links; of equally long rules that fit, the last in order of text
holds; equal trust and distrust leave a host allowed; repeated rows and rows that share a page_id count and
come out one by one; very long pages are read whole; columns other than page_id, url and html may have any
name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lecturelake.llm._spark import discard, hinted, materialize, read_table, table_columns

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


@dataclass(frozen=True)
class UrlParams:
    rules: tuple[tuple[str, str], ...] = RULES
    damping: float = 0.85
    rounds: int = 3
    """Rounds of one plan; ranks are written after them."""
    blocks: int = 4
    """Times that ranks are written between two looks at the verdicts."""
    edges_a_part: int = 100_000
    """Host edges that one task passes ranks along."""
    tolerance: float = 1e-9
    """Ranks are spread until all that they still lack is below this, or can turn no verdict."""
    factor: float = 2.0
    """A host is blocked where distrust > factor * trust."""
    floor: float = 1e-9
    """Least distrust that counts."""


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _parts(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), slash + path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, or null; of equally long ones the last in order of text."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, p = _parts(rule)
        out = F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    return F.when(rule.isin([r for v, r in rules if v == "allow"]), "allow").when(rule.isin([r for v, r in rules if v == "block"]), "block")


def ancestors(host: Column) -> Column:
    """All domains above a host, down to two labels; none for addresses of numbers and names with an empty label."""
    labels = F.split(host, r"\.")
    named = host.rlike(r"^[^.]+(\.[^.]+)*\.[^.\d][^.]*$") & (F.size(labels) > 2)
    return F.when(named, F.transform(F.sequence(F.lit(2), F.size(labels) - 1), lambda n: F.array_join(F.slice(labels, -n, n), "."))).otherwise(F.array().cast("array<string>"))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: links between different hosts, counted, and bonds of subdomains in both directions, which weigh one link a host."""
    links = pages.select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""), F.lit(1)))).alias("to")).select(
        F.col("host").alias("src"), host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))).alias("dst"), F.lit(1.0).alias("weight")
    )
    above = pages.select("host").distinct().select("host", ancestors(F.col("host")).alias("above"))
    bonds = above.select("host", F.explode("above").alias("parent"), (1.0 / F.size("above")).alias("weight"))
    both = bonds.select(F.col("host").alias("src"), F.col("parent").alias("dst"), "weight").unionByName(bonds.select(F.col("parent").alias("src"), F.col("host").alias("dst"), "weight"))
    return links.unionByName(both).filter("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _with_itself(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """kind, host, dst, share: the edges, and for each host one row to itself without a share, which carries what it has."""
    ends = edges.select("kind", F.explode(F.array("src", "dst")).alias("host"))
    hosts = ends.unionByName(seeds.select("kind", "host")).distinct()
    return edges.withColumnRenamed("src", "host").select("kind", "host", "dst", "share").unionByName(hosts.select("kind", "host", F.col("host").alias("dst"), F.lit(None).cast("double").alias("share")))


def personalised(edges: DataFrame, seeds: DataFrame, params: UrlParams, still_open: Callable[[DataFrame, dict[str, float]], tuple[int, int]] | None = None) -> DataFrame:
    """PageRank with restarts in the seeds (kind, host, seed), for each kind by itself. edges: kind, src, dst, share of src's weight.

    A host has a rank and something left to pass on. In a round it adds a part of what is left to its rank and passes the
    rest along its edges, so that ranks only grow and lack at most the sum of what is left, which shrinks by ``damping``
    a round at least. Rounds end where it is below the tolerance, or where no new host is reached and ``still_open``
    (ranks, most that is left by kind -> ranks so far, verdicts that it could turn) finds none.
    """
    if not 0 <= params.damping < 1:
        raise ValueError(f"ranks don't converge with a damping of {params.damping}")
    edges = materialize(_with_itself(edges, seeds), "host-passes")
    parts = max(1, -(-edges.count() // params.edges_a_part))
    # hosts stay where their edges are, so a round is one shuffle of sums; each round ends its tasks, and with them their memory
    hubs = materialize(edges.groupBy("kind", "host").count().filter(F.col("count") > params.edges_a_part).select("kind", "host", F.ceil(F.col("count") / params.edges_a_part).cast("int").alias("pieces")), "host-hubs")
    split = not hubs.isEmpty()
    keys = ["kind", "host", "piece"] if split else ["kind", "host"]
    placed = lambda df: df.repartition(parts, *keys)
    if split:
        # the edges of a hub are dealt over several parts, and its row goes to each of them
        hubs, one = hinted(hubs), F.coalesce("pieces", F.lit(1))
        out_of = placed(edges.join(hubs, ["kind", "host"], "left").withColumn("piece", F.pmod(F.xxhash64("dst"), one).cast("int")).drop("pieces"))
        dealt = lambda df: placed(df.join(hubs, ["kind", "host"], "left").withColumn("piece", F.explode(F.sequence(F.lit(0), one - 1))).drop("pieces"))
    else:
        out_of, dealt = placed(edges), placed
    own, reached = F.col("share").isNull(), 0
    left = {r["kind"]: r["mass"] for r in seeds.groupBy("kind").agg(F.sum("seed").alias("mass")).collect()}  # a row for each kind
    state = seeds.select("kind", "host", F.lit(0.0).alias("rank"), F.col("seed").cast("double").alias("left"))
    blocks = 0
    while True:
        before = state
        for _ in range(params.rounds):
            passed = out_of.join(dealt(state).hint("shuffle_hash"), keys).select(
                "kind",
                F.col("dst").alias("host"),
                F.when(own, F.col("rank") + F.col("left") * (1 - params.damping)).otherwise(0.0).alias("rank"),
                F.when(own, 0.0).otherwise(F.col("left") * F.col("share") * params.damping).alias("left"),
            )
            state = passed.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("left").alias("left"))
        state = materialize(state, "host-rank")
        if blocks:
            discard(before)
        blocks += 1
        left = {kind: most * params.damping**params.rounds for kind, most in left.items()}
        if sum(left.values()) <= params.tolerance:
            return state.select("kind", "host", "rank")
        if still_open and blocks % params.blocks == 0:
            hosts, turning = still_open(state, left)
            if hosts == reached and not turning:
                return state.select("kind", "host", "rank")
            reached = hosts


def _scores(rank: DataFrame) -> DataFrame:
    """host, trust, distrust, and whether each was reached (good, bad)."""
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    has = lambda kind: F.max(F.col("kind") == kind)
    return rank.groupBy("host").agg(of("good").alias("trust"), of("bad").alias("distrust"), has("good").alias("good"), has("bad").alias("bad"))


def _blocked(params: UrlParams, trust: Column, distrust: Column) -> Column:
    return (distrust > params.factor * trust) & (distrust > params.floor)


def verdicts_open(params: UrlParams) -> Callable[[DataFrame, dict[str, float]], tuple[int, int]]:
    """Counts ranks so far, and the hosts whose verdict could turn by what is left if no new host is reached."""

    def count(rank: DataFrame, left: dict[str, float]) -> tuple[int, int]:
        # ranks only grow, by what is left at most; a host that nothing leads to gets nothing
        more = lambda kind: F.when(F.col(kind), left.get(kind, 0.0)).otherwise(0.0)
        sure = _blocked(params, F.col("trust") + more("good"), F.col("distrust"))
        never = ~_blocked(params, F.col("trust"), F.col("distrust") + more("bad"))
        found = _scores(rank).agg(F.sum(F.col("good").cast("long") + F.col("bad").cast("long")), F.count_if(~(sure | never))).first()
        return found[0] or 0, found[1]

    return count


def host_verdicts(pages: DataFrame, params: UrlParams, converged: bool = True) -> DataFrame:
    """host, trust, distrust, blocked for every host with any score. pages: host, html, by_rule (allow, block or null).

    Without ``converged``, scores are followed until no verdict can turn any more.
    """
    edges = materialize(host_edges(pages), "host-edges")
    counts = materialize(pages.filter("host <> ''").groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").alias("good"), F.count_if(F.col("by_rule") == "block").alias("bad")).filter("good + bad > 0"), "host-seeds")

    def shares(source: str, target: str, kind: str) -> DataFrame:
        total = edges.groupBy(F.col(source).alias("s")).agg(F.sum("weight").alias("all"))
        return edges.join(total, edges[source] == F.col("s")).select(F.lit(kind).alias("kind"), F.col(source).alias("src"), F.col(target).alias("dst"), (F.col("weight") / F.col("all")).alias("share"))

    def seeds(kind: str) -> DataFrame:
        return counts.filter(F.col(kind) > 0).select(F.lit(kind).alias("kind"), "host", (F.col(kind) / (F.col("good") + F.col("bad"))).alias("seed"))

    both = materialize(shares("src", "dst", "good").unionByName(shares("dst", "src", "bad")), "host-shares")
    rank = personalised(both, materialize(seeds("good").unionByName(seeds("bad")), "host-kinds"), params, None if converged else verdicts_open(params))
    return _scores(rank).select("host", "trust", "distrust", _blocked(params, F.col("trust"), F.col("distrust")).alias("blocked"))


def url_verdicts(pages: DataFrame, params: UrlParams | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each page."""
    params = params or UrlParams()
    named = table_columns(pages, "page_id", "url", "html").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = named.withColumn("rule", rule_of(F.col("host"), F.col("path"), params.rules)).withColumn("by_rule", verdict_of(F.col("rule"), params.rules))
    blocked = materialize(host_verdicts(ruled.select("host", "html", "by_rule"), params, converged=False).filter("blocked").select("host", F.lit("block").alias("by_host")), "hosts-blocked")
    return ruled.join(hinted(blocked), "host", "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_host", F.lit("allow")).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(read_table(spark, sf_dir, "pages"))
