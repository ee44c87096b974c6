"""URL verdicts: explicit rules, then trust and distrust propagated over the host graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Absolute and scheme-relative links; relative ones stay on their host.
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/"'?#\s>]+)"""


#: Links of one host that one task of a round takes.
HUB_ROWS = 10_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the end.
    Null or without ://: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of (host, path, verdict) rules that fits, as struct(n, rule, verdict), else null. A rule fits its host
    and all subdomains when the path starts with the rule's. Of equal rules block wins. Rules are a parameter: a few
    hundred at most become one expression."""
    if len(rules) > 500:
        raise ValueError("over 500 rules: match in several calls and keep the longest")
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith("/" + p), F.struct(F.lit(len(h) + len(p) + 1).alias("n"), F.lit(f"{h}/{p}").alias("rule"), F.lit(verdict).alias("verdict")))
        for h, p, verdict in rules
    ]
    return F.greatest(*fits) if len(fits) > 1 else fits[0] if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def host_links(pages: DataFrame, html_col: str = "html", host_col: str = "host") -> DataFrame:
    """(src, dst, n): pages of src that link to dst, another host, added up before the shuffle."""
    targets = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), F.lit(1)))
    found = pages.filter(F.col(host_col) != "").select(F.col(host_col).alias("src"), F.explode(targets).alias("dst"))
    return found.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).filter("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def domain_links(hosts: DataFrame, host_col: str = "host") -> DataFrame:
    """(src, dst, n): every host and each domain above it, down to two labels, point at each other once. Addresses in
    digits have no domain. A port is no part of a name."""
    name = F.regexp_replace(host_col, ":[0-9]*$", "")
    labels = F.split(name, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    chain = hosts.select(host_col).distinct().filter(~F.col(host_col).rlike(r"^[0-9.:\[\]a-f]*$") & (F.size(labels) > 2)).select(F.col(host_col).alias("host"), F.concat(F.array(host_col), F.slice(above, 2, F.size(labels))).alias("c"))
    steps = chain.select(F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("s")).select("s.a", "s.b").distinct()
    return steps.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*", F.lit(1).cast("long").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, ws: Workspace, damping: float = 0.85, tolerance: float = 1e-6, max_rounds: int = 1000) -> DataFrame:
    """seeds (host, trust, distrust: weights) -> (host, trust, distrust): personalised PageRank from the trusted seeds
    along links, and from the blocked seeds against them.

    Both walks go in one table keyed by kind and host, so a round is one join and one aggregation. Mass at hosts
    without a way out returns to the seeds. Every round is written to the shared folder; rounds stop when no host's score
    moved by more than tolerance times itself, which a host that is first reached does, so the size of the graph and
    the way to the seeds don't matter. An error is raised when that takes over max_rounds. Scores keep ten significant
    digits. A hub's links are dealt to HUB_ROWS a task by salting its key.
    """
    both = links.select(F.lit("t").alias("kind"), F.col("src"), F.col("dst"), "n").unionByName(links.select(F.lit("d").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all"), (1 + F.floor(F.count(F.lit(1)) / HUB_ROWS)).cast("int").alias("salts"))
    edges = ws.save(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share"), "salts", F.pmod(F.xxhash64("dst"), F.col("salts")).cast("int").alias("salt")), "edges")
    hosts = seeds.select("host").unionByName(links.select(F.col("src").alias("host"))).unionByName(links.select(F.col("dst").alias("host"))).distinct()
    sums = seeds.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d"))
    seeded = hosts.join(seeds, "host", "left").crossJoin(F.broadcast(sums))  # one row
    part = lambda c, total: F.coalesce(F.col(c) / F.nullif(F.col(total), F.lit(0)), F.lit(0.0))
    start = seeded.select("host", F.explode(F.array(F.struct(F.lit("t").alias("kind"), part("trust", "t").alias("seed")), F.struct(F.lit("d").alias("kind"), part("distrust", "d").alias("seed")))).alias("x")).select("x.kind", "host", "x.seed")
    ways_out = edges.select("kind", F.col("src").alias("host"), "salts").distinct()
    start = ws.save(start.join(ways_out, ["kind", "host"], "left").select("kind", "host", "seed", "salts", F.col("seed").alias("score"), F.lit(0.0).alias("moved")), "rank0")
    rank = start
    if edges.limit(1).count():  # without links the walks stay at their seeds
        for k in range(1, max_rounds + 1):
            sent = rank.filter("salts is not null and score > 0").select("kind", F.col("host").alias("src"), "score", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
            flow = sent.join(edges.drop("salts"), ["kind", "src", "salt"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("flow"))
            lost = rank.groupBy("kind").agg(F.sum(F.when(F.col("salts").isNull(), F.col("score")).otherwise(0.0)).alias("lost"))  # two rows
            new = (1 - damping) * F.col("seed") + damping * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") * F.col("seed"))
            step = rank.join(flow, ["kind", "host"], "left").join(F.broadcast(lost), "kind")
            rank = ws.save(step.select("kind", "host", "seed", "salts", new.alias("score"), F.abs(new - F.col("score")).alias("moved")), f"rank{k}")
            ws.drop(f"rank{k - 1}")
            if k % 2 == 0 and (rank.filter("score > 0").agg(F.max(F.col("moved") / F.col("score"))).first()[0] or 0.0) < tolerance:
                break
        else:
            raise RuntimeError(f"trust and distrust still move by more than {tolerance} of a host's score after {max_rounds} rounds")
    by_kind = lambda kind: F.format_string("%.9e", F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0))).cast("double")
    return rank.groupBy("host").agg(by_kind("t").alias("trust"), by_kind("d").alias("distrust"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", block_share: float = 0.5, damping: float = 0.85, domains: bool = True) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, trust, distrust.

    Seeds: hosts weigh as many as their pages that a rule allows (trust) or blocks (distrust). Host edges are the pages'
    links to other hosts and, with `domains`, those between a host and the domains above it. A page without a rule
    is blocked when distrust is above block_share of its host's trust and distrust together, else allowed; so are
    pages whose host is in no walk, empty hosts and null urls. All trust adds up to 1, and so does all distrust: at 0.5 a
    host is blocked when it has more of all distrust than of all trust, however many pages the rules allow or block.
    Null html has no links; long urls and html are read whole. Of rules that fit equally the longer one counts, then the
    later by name, then block. Repeated rows are judged alike (and are seeds and links again).
    An empty table gives an empty result. Other columns are not read.
    """
    ws = Workspace(pages.sparkSession, "url-filter")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    host, path = host_and_path(F.col("url"))
    placed = rows.select("id", host.alias("host"), path.alias("path"), "html").withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules))
    found = host_links(placed)
    if domains:
        found = found.unionByName(domain_links(placed.select("host").unionByName(found.select(F.col("dst").alias("host"))))).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    links = ws.save(found, "links")
    count_if = lambda v: F.sum(F.when(F.col("hit.verdict") == v, 1.0).otherwise(0.0))
    seeds = placed.filter("host <> ''").groupBy("host").agg(count_if("allow").alias("trust"), count_if("block").alias("distrust"))
    scores = propagate(links, seeds, ws, damping)
    judged = placed.drop("html").join(scores, "host", "left")
    both = F.nullif(F.col("trust") + F.col("distrust"), F.lit(0.0))
    bad = F.coalesce(F.round(F.col("distrust") / both, 6) > block_share, F.lit(False))  # as exact as the walks, of masses however small
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
