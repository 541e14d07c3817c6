"""URL filter by redirect equivalence: decisions of allow and block rules spread over redirect and canonical-link edges."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import arrow_map, texts

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one or for null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """What aliases are told apart by: lower-case host, path and query, without scheme and fragment; null for no host."""
    rest = F.regexp_extract(_rest(url), r"^([^#]*)", 1)
    size = F.length(F.regexp_extract(rest, r"^([^/?]*)", 1))
    return F.nullif(F.concat(F.translate(F.substring(rest, F.lit(1), size), _UPPER, _LOWER), F.substring(rest, size + 1, F.length(rest))), F.lit(""))


_tags = re.compile(r"<(?:link|meta)\b[^>]*>", re.I).findall
_value = r"""\s*=\s*["']?\s*"""
_canonical = re.compile(r"^<link\b.*\brel" + _value + "canonical", re.I | re.S).search
_refresh = re.compile(r"^<meta\b.*\bhttp-equiv" + _value + "refresh", re.I | re.S).search
_href = re.compile(r"\bhref" + _value + r"""([^"'\s>]+)""", re.I).search
_target = re.compile(r"""\burl\s*=\s*['"]?([^"'\s>]+)""", re.I).search


def _targets(url: str, html: str) -> list[str]:
    """What a page's canonical links and meta refreshes lead to, as whole urls."""
    found = [m[1] for tag in _tags(html) if (m := (_href(tag) if _canonical(tag) else _target(tag) if _refresh(tag) else None))]
    out = []
    for to in found:
        try:
            out.append(urljoin(url, to))
        except ValueError:  # no url at all, such as http://[
            continue
    return out


def link_edges(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): nodes of a page and of the target of its canonical links and meta refreshes, relative targets resolved."""

    def rows(batches: Iterator) -> Iterator[dict]:
        for batch in batches:
            pairs = [(u, to) for u, h in zip(texts(batch, "url"), texts(batch, "html"), strict=True) for to in _targets(u, h)]
            yield {"url": [u for u, _ in pairs], "target": [to for _, to in pairs]}

    some = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).filter("html rlike '(?i)canonical|refresh'")
    return arrow_map(some, rows, "url string, target string").select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b"))


def match_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, decision) for the distinct places that a rule fits: the longest rule; of equally long ones an allow, then the first by text.

    rules: (rule like ``example.com/en/``, decision allow or block). A rule fits its host and all subdomains.
    """
    rules = rules.filter("rule is not null and decision in ('allow', 'block')").select("rule", "decision", F.regexp_extract("rule", r"^([^/]*)", 1).alias("suffix"), F.regexp_extract("rule", r"^[^/]*(.*)$", 1).alias("start"))
    labels = rules.agg(F.max(F.size(F.split("suffix", r"\.")))).first()[0] or 0
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(parts) - labels + 1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    exploded = places.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("suffix"))
    fits = exploded.join(rules, "suffix").filter("startswith(path, start)")
    order = F.struct(-F.length("rule"), F.col("decision") != "allow", "rule")
    return fits.groupBy("host", "path").agg(F.min_by(F.struct("rule", "decision"), order).alias("best")).select("host", "path", "best.rule", "best.decision")


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame, *, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict (columns of these names are replaced, any others come through).

    A page that a rule fits has that rule's decision. Any other page follows its component over ``edges`` (a, b): allow if a
    rule allows any node of the component, else block if a rule blocks any, else allow. A null url or one without ``://`` has
    empty host and path, is fitted by no rule and belongs to no component: it is allowed. Urls are read whole, however long.
    Repeated rows get equal verdicts; without rules or edges all are allowed; an empty table gives an empty table.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]).alias("page")
    rows = pages.select(rest, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), node_of(F.col(url)).alias("node"))
    placed = rows.filter("host <> ''")
    groups = components(edges)
    lone = groups.select("node", "component", host_of(F.concat(F.lit("x://"), "node")).alias("host"), path_of(F.concat(F.lit("x://"), "node")).alias("path"))
    matched = match_rules(placed.select("host", "path").union(lone.select("host", "path")), rules)
    decided = lone.join(matched, ["host", "path"]).groupBy("component").agg(F.max((F.col("decision") == "allow").cast("int")).alias("allowed"))
    spread = groups.join(decided, "component").select("node", F.when(F.col("allowed") == 1, "allow").otherwise("block").alias("spread"))
    found = placed.join(matched, ["host", "path"], "left").join(spread, "node", "left").select("page", "host", "path", "rule", F.coalesce("decision", "spread", F.lit("allow")).alias("verdict"))
    nowhere = rows.filter("host = ''").select("page", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))  # one key: not joined
    return found.union(nowhere).select("page.*", "host", "path", "rule", "verdict")
