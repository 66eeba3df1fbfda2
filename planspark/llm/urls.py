"""URL filters: longest rules, and trust and distrust spread over host edges for everything the rules leave open."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import Scope, scope, settle, tidy

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOLERANCE = 1e-4  # of the restart weights
STORED = 4        # rounds until the scores are stored and their movement is measured
LINK = r"(?i)\bhref\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` (allow or block) for ``host`` and its subdomains where the path starts with ``path``."""
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or where ``://`` is missing."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return (_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def longest_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule, both null where none fits; the first listed wins a tie."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """Weighted edges between different hosts: ``src, dst, weight``.

    An absolute link in a page's html counts once for (page's host, linked host). A host and its parent domain (one label
    less, at least two left) vouch for each other with weight 1, which also ties hosts whose pages link only to themselves.
    """
    linked = (
        pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link"))
        .select("src", _lower(F.regexp_extract("link", r"//([^/?#]*)", 1)).alias("dst"))
        .filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    )
    hosts = pages.select("host").union(linked.select("dst")).filter("host <> ''").distinct()
    up = F.array_join(F.slice(F.split("host", r"\."), 2, 1_000), ".")
    chain = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(F.split("host", r"\.")) - 2, F.lit(0))),
        lambda k: F.array_join(F.slice(F.split("host", r"\."), k + 1, 1_000), "."))
    ladder = (hosts.filter(F.size(F.split("host", r"\.")) > 2).select(F.explode(chain).alias("host")).distinct()
              .filter(F.size(F.split("host", r"\.")) > 2).select(F.col("host").alias("a"), up.alias("b")))
    both = ladder.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
                                           F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"))
    return (linked.unionByName(both.select("e.src", "e.dst", F.lit(1).cast("long").alias("weight")))
            .groupBy("src", "dst").agg(F.sum("weight").alias("weight")))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank of ``host, trust, distrust``: trust along the edges, distrust against them.

    ``seeds`` has the restart weights as ``host, trust_seed, distrust_seed``. Every round is one join on the sending host
    and one sum per receiving host, pre-aggregated before the shuffle; every few rounds the scores are stored, until the next are.
    The rounds end when the scores of all hosts together move in a round by at most ``tolerance`` of the restart weights. A round moves them by at
    most ``damping`` times as much as the one before, so they end on every graph.
    """
    with scope(edges.sparkSession) as owner:
        return owner.keep(_propagated(edges, seeds, damping, tolerance, owner))


def _propagated(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float, owner: Scope) -> DataFrame:
    forward = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("weight").alias("f"), F.lit(0).alias("r"))
    back = edges.select(F.col("dst").alias("u"), F.col("src").alias("v"), F.lit(0).alias("f"), F.col("weight").alias("r"))
    steps = forward.union(back).groupBy("u", "v").agg(F.sum("f").alias("f"), F.sum("r").alias("r"))
    out = steps.groupBy("u").agg(F.sum("f").alias("fs"), F.sum("r").alias("rs"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    steps = settle(steps.join(out, "u").select("u", "v", share("f", "fs").alias("f"), share("r", "rs").alias("r")))
    seeds = settle(seeds)
    state = seeds.select("host", F.col("trust_seed").alias("trust"), F.col("distrust_seed").alias("distrust"))
    weight = seeds.agg(F.sum(F.col("trust_seed") + F.col("distrust_seed"))).first()[0] or 0.0
    restart = seeds.select("host", (F.col("trust_seed") * (1 - damping)).alias("trust"), (F.col("distrust_seed") * (1 - damping)).alias("distrust"))

    def sent(scores: DataFrame) -> DataFrame:
        received = scores.join(steps, F.col("host") == F.col("u")).select(
            F.col("v").alias("host"), (F.col("trust") * F.col("f") * damping).alias("trust"), (F.col("distrust") * F.col("r") * damping).alias("distrust"))
        return received.unionByName(restart)

    while True:
        for _ in range(STORED - 1):
            state = sent(state).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        # The scores before come along beside the new ones, so one sum gives the new scores and how far they moved.
        old = state.select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"), F.col("trust").alias("t"), F.col("distrust").alias("d"))
        new = sent(state).withColumns({"t": F.lit(0.0), "d": F.lit(0.0)}).unionByName(old)
        state = settle(new.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("trust", "distrust", "t", "d")]).withColumn(
            "moved", F.abs(F.col("trust") - F.col("t")) + F.abs(F.col("distrust") - F.col("d"))))
        moved = state.agg(F.sum("moved")).first()[0] or 0.0
        state = state.select("host", "trust", "distrust")
        owner.drop_all_but(state, steps, seeds)
        if moved <= tolerance * weight:
            return state


@tidy
def judge(pages: DataFrame, rules: Sequence[UrlRule], neutral: float = 0.5, threshold: float = 0.5,
          damping: float = 0.85, tolerance: float = TOLERANCE) -> DataFrame:
    """A verdict for every page: ``page_id, host, path, rule, verdict, trust, distrust``.

    Rules decide first. Their pages are the seeds: a host starts with trust for its allowed pages (and ``neutral`` for each
    page without a rule) and distrust for its blocked ones, as shares of all pages. A page without a rule is blocked where
    its host's distrust exceeds ``threshold`` of trust and distrust together. Pages without a host have no scores and are
    allowed. Null html has no links; repeated pages count each; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    text, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumns({"rule": text, "ruled": verdict})
    counts = settle(ruled.filter("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ruled") == "allow", 1)).alias("allowed"),
        F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked")))
    total = float(counts.agg(F.sum("n")).first()[0] or 1)
    open_pages = F.col("n") - F.col("allowed") - F.col("blocked")
    seeds = counts.select("host", ((F.col("allowed") + neutral * open_pages) / total).alias("trust_seed"),
                          (F.col("blocked") / total).alias("distrust_seed"))
    scores = propagate(host_edges(parsed), seeds, damping, tolerance)
    trust, distrust = F.coalesce(F.col("trust"), F.lit(0.0)), F.coalesce(F.col("distrust"), F.lit(0.0))
    spread = F.when(distrust > threshold * (trust + distrust), "block").otherwise("allow")
    return (ruled.drop("html").join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", spread).alias("verdict"), trust.alias("trust"), distrust.alias("distrust")))
