"""URL filters with redirect equivalence.

A rule names a host (with its subdomains) and a path prefix; of the rules that
fit a URL the longest decides. A page's redirect (``<meta http-equiv=refresh>``)
and its canonical link (``<link rel=canonical>``) say that two URLs are one
resource, so they are edges of a graph of URLs. Its connected components are
found by distributed star contraction over the edges alone, and a component's
decisions reach the members without a rule of their own: they are blocked if a
member is blocked by a rule and none is allowed by one; an explicit allow takes
precedence, on the URL itself and in its component. Linked URLs count as
members even if they are no page of the table.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table, ship, stored
from .components import components

# The rules as (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: Keys over which the rows of one URL, or the members of one component, are dealt.
SALTS = 16

#: What the scan of a head stops at; everything between is skipped in one step.
_MARK = re.compile(r"<(?:(!--)|(script|style|noscript|template|title)\b|(body|/head)\b|(link|meta|base)\b)", re.I)
#: One attribute of a tag; the alternatives begin differently, so a tag is read once.
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s=>"'/<]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*)))?""")
_REFRESH = re.compile(r"""^\s*[\d.]+\s*[;,]\s*(?:url\s*=\s*)?["']?\s*([^"']+?)\s*["']?\s*$""", re.I)


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes of a tag from ``at`` on, and the place behind them."""
    found: dict[str, str] = {}
    while match := _ATTRIBUTE.match(page, at):
        name, *values = match.groups()
        found.setdefault(name.lower(), html_lib.unescape(next((v for v in values if v is not None), "")))
        at = match.end()
    return found, at


def links_of(url: str, page: str) -> list[str]:
    """Absolute targets of a page's redirect and canonical links, from its head, in one pass."""
    found, base, at = [], url, 0
    while mark := _MARK.search(page, at):
        at = mark.end()
        comment, skipped, end, tag = mark.groups()
        if end:
            break
        if tag:
            values, at = _attributes(page, at)
            tag = tag.lower()
            if tag == "base" and base == url:
                base = _resolved(url, values.get("href", "")) or url
            elif tag == "link" and "canonical" in values.get("rel", "").lower().split():
                found.append(_resolved(base, values.get("href", "")))
            elif tag == "meta" and values.get("http-equiv", "").strip().lower() == "refresh":
                target = _REFRESH.match(values.get("content", ""))
                found.append(_resolved(base, target[1]) if target else "")
        else:
            close = "-->" if comment else f"</{skipped.lower()}"
            at = _after(page, close, at)
            if at < 0:
                break
    return [t for t in found if t]


def _after(page: str, close: str, at: int) -> int:
    """The place behind the next ``close``, or -1 if the rest of the page has none."""
    if close == "-->":
        at = page.find(close, at)
    else:
        found = re.compile(re.escape(close), re.I).search(page, at)
        at = found.start() if found else -1
    return at + len(close) if at >= 0 else -1


def _resolved(base: str, target: str) -> str:
    """The absolute URL that a link means, empty if it means none."""
    target = target.strip()
    if not target:
        return ""
    try:
        return urljoin(base, target)
    except ValueError:  # such as an open bracket in a host
        return ""


def _lower(value: Column) -> Column:
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (up to ``/``, ``?``, ``#``) and path (up to ``?``, ``#``) behind the first ``://``; empty without one."""
    rest = _behind_scheme(url)
    return _lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)


def _behind_scheme(url: str) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")


def resource(url: str) -> Column:
    """A URL as a node of the graph: scheme and host lowered, no fragment.

    Null without ``://``: such a URL is no resource that others can link to."""
    host, path = host_and_path(url)
    query = F.regexp_extract(_behind_scheme(url), r"^[^?#]*(\?[^#]*)?", 1)
    whole = F.concat(_lower(F.substring_index(url, "://", 1)), F.lit("://"), host, path, query)
    return F.when(F.instr(url, "://") > 0, whole)


def rule_of(host: str, path: str, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (of equal length an allow, then the first), else null."""
    by_length = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow"))
    name = verdict = None
    for decision, rule_host, rule_path in by_length:
        fits = ((F.col(host) == rule_host) | F.col(host).endswith("." + rule_host)) & F.col(path).startswith(rule_path)
        name = F.when(fits, rule_host + rule_path) if name is None else name.when(fits, rule_host + rule_path)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``page`` and ``target`` (URLs) of every redirect and canonical link, one narrow pass."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = []
                for own, page in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    found += [(own, target) for target in links_of(own, page.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)],
                                                 names=["page", "target"])

    asked = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).where("url is not null and html is not null")
    return asked.mapInArrow(run, "page string, target string")


def blocked_aliases(links: DataFrame, rules=RULES) -> DataFrame:
    """``resource``: the linked URLs that no rule fits and that their component blocks.

    ``links`` (``page``, ``target``) may come from anywhere, such as a crawler's
    redirect log. Nulls and links of a resource to itself are ignored; no link
    gives an empty table. A component of any size is decided by two partial
    aggregates, and its members are looked up under ``SALTS`` keys."""
    graph = links.select(resource("page").alias("a"), resource("target").alias("b")).where("a is not null and b is not null")
    host, path = host_and_path("node")
    members = components(graph).withColumns({"host": host, "path": path})
    members = stored(members.select("node", "root", rule_of("host", "path", rules)[1].alias("own")), "linked-urls")
    decided = members.where("own is not null").groupBy("root").agg(F.bool_and(F.col("own") == "block").alias("blocked"))
    blocked = decided.where("blocked").select("root", _every_salt())
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt")
    return (members.where("own is null").select(F.col("node").alias("resource"), "root", salt)
            .join(blocked, ["root", "salt"], "left_semi").select("resource"))


def _every_salt() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")


def judge(pages: DataFrame, links: DataFrame | None = None, rules=RULES, url: str = "url", html: str = "html") -> DataFrame:
    """All columns of ``pages`` but the markup, plus ``host``, ``path``, ``rule`` and ``verdict``.

    ``rule`` is the longest rule that fits the URL, else null; ``verdict`` is
    that rule's, else ``block`` if the URL is an alias of a blocked one and of no
    explicitly allowed one, else ``allow``. ``links`` adds further aliases
    (``page``, ``target``: absolute URLs) to those found in the pages. A null URL,
    or one without ``://``, has an empty host and path, no rule and no alias; a
    null or empty page has no links. Rows that repeat a URL are judged alike, by
    the links of all of them; input columns called like an output are replaced;
    an empty table gives an empty table."""
    names = ["host", "path", "rule", "verdict"]
    kept = ["`" + c.replace("`", "``") + "`" for c in pages.columns if c.lower() not in (*names, html.lower())]
    found = edges(pages, url, html)
    if links is not None:
        found = found.unionByName(links.select("page", "target"))
    blocked = blocked_aliases(stored(found.distinct(), "page-links"), rules)
    blocked = blocked.select(F.col("resource").alias("_resource"), _every_salt().alias("_salt"), F.lit(True).alias("_blocked"))
    host, path = host_and_path("_url")
    rows = pages.select(F.struct(*kept).alias("_row"), F.col(url).alias("_url")).withColumns({"host": host, "path": path})
    rule, verdict = rule_of("host", "path", rules)
    # only URLs without a rule are looked up; rows of one URL are dealt over salts by the partition they come from
    rows = rows.withColumns({"rule": rule, "verdict": verdict}).withColumns({
        "_resource": F.when(F.col("rule").isNull(), resource("_url")),
        "_salt": F.pmod(F.spark_partition_id(), F.lit(SALTS))})
    rows = rows.join(blocked, ["_resource", "_salt"], "left")
    spread = F.when(F.col("_blocked"), "block").otherwise("allow")
    return rows.select("_row.*", "host", "path", "rule", F.coalesce("verdict", spread).alias("verdict"))


def op13_urls(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page."""
    return judge(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("url")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HOST = _LOWER.format(r"regexp_extract(rest, '^[^/?#]*', 0)")

#: Links are read in their usual spelling: double quotes, ``rel`` before ``href``, absolute URLs.
URLS_SQL = rf"""
with recursive heads as (
  select url, regexp_extract(html, '(?is)^.*?(<body|</head|\z)', 0) as head from pages where url is not null
), links as (
  select distinct url as page, unnest(list_concat(
    regexp_extract_all(head, '(?i)<link[^<>]*\brel="canonical"[^<>]*\bhref="([^"]*)"', 1),
    regexp_extract_all(head, '(?i)<meta[^<>]*\bhttp-equiv="refresh"[^<>]*\bcontent="[0-9]+; *url=([^"]*)"', 1))) as target
  from heads
), behind as (
  select raw, case when instr(raw, '://') > 0 then substr(raw, instr(raw, '://') + 3) else '' end as rest
  from (select url as raw from pages union select target from links)
), cut as (
  select raw, rest, {_HOST} as host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) as path from behind
), judged as (
  select raw, host, path,
         case when rest <> '' then {_LOWER.format("split_part(raw, '://', 1)")} || '://' || host || path
              || regexp_extract(rest, '^[^?#]*(\?[^#]*)?', 1) end as resource,
         case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
              when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
              when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
              when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule
  from cut
), edges as (
  select a.resource as x, b.resource as y from links join judged a on a.raw = page join judged b on b.raw = target
  union select b.resource, a.resource from links join judged a on a.raw = page join judged b on b.raw = target
), reach as (
  select x as node, x as other from edges union select reach.node, y from reach join edges on reach.other = edges.x
), spread as (
  select node from reach join judged on other = resource where rule is not null
  group by node having bool_and(rule in ('net/', 'example.com/de/'))
)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule,
       case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
            when node is not null then 'block' else 'allow' end as verdict
from pages left join judged on url = raw left join spread on judged.resource = node
"""
