"""URL filtering by rules and by trust propagated over the link graph of hosts.

Rules decide the URLs that they fit.  They also seed the graph: a host is trusted by the share of its pages that
rules allow, and distrusted by the share that they block.  Trust follows links forward (personalised PageRank from
the trusted hosts); distrust follows them backward, from a blocked host to every host that links to it, in proportion to
the share of that host's links: a host has as much distrust as a reader would meet who follows its links, however many other
hosts link to the same blocked one.  A host is blocked if its distrust reaches a threshold and exceeds its trust, which
decides all its URLs that no rule fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.store import drop, keep

#: Scores settle in about 57 rounds, and in few more for each tenfold of hosts; far more are an error.
MOST_ROUNDS = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str]  # verdict (allow or block), then host and path as one string, like "example.com/en/"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` or null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _parts(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), slash + path


def decide(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits (null if none does) and its verdict.  Of rules equally long a block goes first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", r[1])):
        if kind not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks; it can't {kind}")
        on, under = _parts(text)
        fits = ((host == on) | F.endswith(host, F.lit(f".{on}"))) & F.startswith(path, F.lit(under))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst, n)``: how many links pages of one host have to another, or within it.  Links without a host stay on
    the page's own; pages without a host have none."""
    own = host_of(F.col("url"))
    href = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))
    kind = F.regexp_extract("link", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    away = F.when(F.startswith("link", F.lit("//")), host_of(F.concat(F.lit("x:"), "link"))).when(F.lower(kind).isin("http", "https"), host_of(F.col("link"))).when(kind == "", F.col("src"))
    links = pages.select(own.alias("src"), F.explode(href).alias("link")).where("src <> ''")
    return links.select("src", away.alias("dst")).where("dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-4) -> DataFrame:
    """``(host, trust, distrust)`` of every host of ``seeds (host, trust, distrust)`` and ``edges (src, dst, n)``.

    A round sends ``damping`` of a host's trust along its links, in proportion to ``n``, and gives it ``damping`` of the
    distrust of the hosts that it links to, in the same proportion; the rest comes from the seeds.  A host without links out
    keeps its own.  It ends once no score moves by more than ``tolerance``, however many rounds that takes, or after ``rounds``
    if they are given.  A round is written to the shared folder; scores never leave the cluster.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    zero = F.lit(0.0)
    base = keep(
        seeds.select("host", "trust", "distrust")
        .union(edges.select(F.explode(F.array("src", "dst")).alias("host"), zero, zero))
        .groupBy("host").agg(F.max("trust").alias("trust"), F.max("distrust").alias("distrust")), "base",
    )
    ends = base.select("host", F.lit(1.0).alias("one"))
    share = keep(edges.join(keep(out, "out"), "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")), "share")
    steps = keep(
        share.select(F.col("src").alias("sender"), F.col("dst").alias("host"), F.col("share").alias("ahead"), zero.alias("back"))
        .union(share.select("dst", "src", zero, "share"))
        .union(ends.join(out, ends["host"] == out["src"], "left_anti").select("host", "host", "one", "one")), "steps",
    )
    now = base
    for _ in range(MOST_ROUNDS if rounds is None else rounds):
        sent = steps.join(now.select(F.col("host").alias("sender"), "trust", "distrust"), "sender")
        gains = sent.select("host", (F.col("ahead") * F.col("trust") * damping).alias("trust"), (F.col("back") * F.col("distrust") * damping).alias("distrust"), zero.alias("was_trust"), zero.alias("was_distrust"))
        rest = base.select("host", F.col("trust") * (1 - damping), F.col("distrust") * (1 - damping), zero, zero)
        last = now.select("host", zero, zero, "trust", "distrust")
        after = keep(gains.union(rest).union(last).groupBy("host").agg(*(F.sum(c).alias(c) for c in ("trust", "distrust", "was_trust", "was_distrust"))), "scores")
        moved = after.agg(F.max(F.greatest(F.abs(F.col("trust") - F.col("was_trust")), F.abs(F.col("distrust") - F.col("was_distrust"))))).first()[0]
        if now is not base:
            drop(now)
        now = after
        if moved is None or moved <= tolerance:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"scores did not settle in {MOST_ROUNDS} rounds")
    return now.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules: list[Rule], damping: float = 0.85, threshold: float = 0.5) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)`` of every row of ``pages (page_id, url, html)``.

    ``rule`` is the longest that fits, else null; ``verdict`` is its, else the host's.  A null url or one without
    ``://`` has an empty host and path and is allowed; null html has no links.  Repeated rows and null ids are kept;
    an empty table gives no rows; other columns are ignored.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rule, said = decide(rules, F.col("host"), F.col("path"))
    ruled = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).select("page_id", "host", "path", rule.alias("rule"), said.alias("said"))
    share = lambda kind: F.avg(F.when(F.col("said") == kind, 1.0).otherwise(0.0))
    seeds = ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = propagate(keep(host_edges(rows), "host-edges"), seeds, damping)
    found = keep(scores, "host-scores")
    blocked = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    method = F.when(F.coalesce(blocked, F.lit(False)), "block").otherwise("allow")
    return ruled.join(found, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "trust", "distrust")
