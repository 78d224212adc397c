"""URL rules spread over redirect and canonical-link aliases, in DataFrame functions only.

A rule (host, path) fits a url whose host is the rule's or below it and whose path starts
with the rule's; the longest fitting rule decides. Pages that name each other by a canonical
link, a refresh redirect or a given redirect are aliases; their connected components carry
block decisions to aliases without a rule of their own. An explicit allow goes first: on a
page its own rule decides, and a component with an allowed member is not blocked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberday.llm.components import components
from emberday.session import release, written

# Up to so many rules are tested inside the scan; more are joined by host.
INLINE_RULES = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Every pattern below takes what it can without giving back, so that hostile pages cost linear time.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|textarea|title|xmp)\b[^>]*+(?:>|\z).*?(?:</\1\b|\z)"
_HINT = r"(?i)canonical|refresh"
_TAG = r"(?i)^(?:link|meta)[\s/]"
_ATTRIBUTE = r"""([^\s"'>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]*+))?|>)"""
_ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|amp|lt|gt|quot|apos);"
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Name of a page: host, path without dot segments, and query. Scheme and fragment make no other page."""
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), _dotless(path_of(url)), _query_of(url)))


def _query_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)", 1)


def _dotless(path: Column) -> Column:
    """``path`` with its ``.`` and ``..`` segments resolved; above the root there is nothing."""
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done)
        .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
        .otherwise(F.array_append(done, part)),
    )
    closed = F.when(path.rlike(r"/\.\.?$"), "/").otherwise("")
    return F.when(path.contains("/."), F.concat(F.array_join(kept, "/"), closed)).otherwise(path)


def _unescaped(text: Column) -> Column:
    """``text`` with numeric character references and the five named ones of XML read once."""

    def read(part: Column) -> Column:
        name = F.regexp_extract(part, _ENTITY, 1)
        hexed = F.conv(F.regexp_extract(name, r"^#[xX](.+)", 1), 16, 10)
        number = F.coalesce(F.regexp_extract(name, r"^#([0-9]+)", 1).try_cast("long"), hexed.try_cast("long"))
        number = F.when(number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF), number)
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        for known, plain in _NAMED.items():
            char = F.when(name == known, plain).otherwise(char)
        return F.coalesce(F.concat(char, F.substring(part, F.length(name) + 2, F.length(part))), F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    tails = F.transform(F.slice(parts, 2, F.size(parts)), read)
    return F.when(text.contains("&"), F.concat(parts[0], F.array_join(tails, ""))).otherwise(text)


def _absolute(links: DataFrame) -> DataFrame:
    """``(u, v)`` of rows (u, href), resolved against the page's url as browsers do.

    A link with a scheme stands alone, ``//`` keeps the page's scheme, ``/`` its host, ``?`` its
    path, ``#`` is the page itself and all else starts at its folder; dot segments are resolved.
    """
    parts = links.where(F.instr("u", "://") > 0).select(
        "u", "href", F.substring_index("u", "://", 1).alias("scheme"),
        host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"),
    )
    root = F.concat("scheme", F.lit("://"), "host")
    folder = F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^.*/", 0)).otherwise("/")
    href = F.col("href")
    full = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat("scheme", F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(root, "path", href))
        .when(href.startswith("#"), F.col("u"))
        .otherwise(F.concat(root, folder, href))
    )
    v = F.col("full")
    plain = F.concat(F.substring_index(v, "://", 1), F.lit("://"), host_of(v), _dotless(path_of(v)), _query_of(v))
    return parts.select("u", full.alias("full")).select("u", F.when(F.instr(v, "://") > 0, plain).otherwise(v).alias("v"))


def with_rule(rows: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Add ``rule`` and ``action`` of the longest rule that fits columns ``host`` and ``path``.

    ``rules`` are (action, host, path). Of equally long rules the one with the longer host
    wins, then the smaller text, then allow. Both are null where none fits.
    """
    if 0 < len(rules) <= INLINE_RULES:
        table = F.array(
            *[F.struct(*map(F.lit, (host, path, f".{host}", host + path, action)))
              for action, host, path in sorted(rules, key=_preference)]
        )
        fitting = F.filter(
            table,
            lambda r: ((F.col("host") == r["col1"]) | F.col("host").endswith(r["col3"]))
            & F.col("path").startswith(r["col2"]),
        )
        first = F.try_element_at(fitting, F.lit(1))
        return rows.withColumn("_rule", first).select(
            *[rows[c] for c in rows.columns], F.col("_rule.col4").alias("rule"), F.col("_rule.col5").alias("action")
        )
    spark = rows.sparkSession
    ranked = [(a, h, p, k) for k, (a, h, p) in enumerate(sorted(rules, key=_preference))]
    table = spark.createDataFrame(ranked, "action string, rule_host string, rule_path string, rank int")
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels)))
    )
    places = rows.select("host", "path").distinct()
    best = (
        places.withColumn("rule_host", F.explode(suffixes)).join(table, "rule_host")
        .where(F.col("path").startswith(F.col("rule_path")))
        .groupBy("host", "path")
        .agg(F.min(F.struct("rank", F.concat("rule_host", "rule_path").alias("rule"), "action")).alias("_rule"))
    )
    return rows.join(best, ["host", "path"], "left").select(
        *[rows[c] for c in rows.columns], F.col("_rule.rule").alias("rule"), F.col("_rule.action").alias("action")
    )


def _preference(rule: tuple[str, str, str]) -> tuple:
    action, host, path = rule
    return (-len(host + path), -len(host), host + path, action)


def _value(attributes: Column, name: str) -> Column:
    """Value of the first attribute of a name, quotes off and references read; null without one."""
    own = F.get(F.filter(attributes, lambda a: a.rlike(rf"(?i)^{name}\s*=")), 0)
    raw = F.regexp_replace(own, r"(?s)^[^=]*+=\s*+", "")
    quoted = raw.rlike(r"""(?s)^(?:".*"|'.*')$""")
    return _unescaped(F.when(quoted, F.substring(raw, 2, F.length(raw) - 2)).otherwise(raw))


def _refresh_target(content: Column) -> Column:
    """The url of a refresh: up to its closing quote if it opens with one."""
    after = F.regexp_extract(content, r"(?is)^[^;,]*+[;,]\s*+url\s*+=\s*+(.*)$", 1)
    inside = F.regexp_extract(after, r"""(?s)^(["'])(.*?)(?:\1|$)""", 2)
    return F.when(after.rlike(r"""^["']"""), inside).otherwise(after)


def _named_by(tag: Column) -> Column:
    """What one ``link`` or ``meta`` tag names as the page's place; null if nothing."""
    found = F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(1))
    end = F.array_position(found, ">")
    attributes = F.when(end > 0, F.slice(found, 1, F.greatest(end - 1, F.lit(0)).cast("int"))).otherwise(found)
    canonical = tag.rlike("(?i)^link") & _value(attributes, "rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)")
    refresh = tag.rlike("(?i)^meta") & _value(attributes, "http-equiv").rlike(r"(?i)^\s*refresh\s*$")
    return F.trim(
        F.when(canonical, _value(attributes, "href")).when(refresh, _refresh_target(_value(attributes, "content")))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """``(u, v)`` urls of pages and of all that their canonical links and refresh redirects name.

    Comments, scripts, styles and other raw text hold no tags. The rest is cut at every ``<``,
    so a tag is looked at once, up to its first ``>`` outside quotes; an unclosed tag ends at
    the next ``<``, as does a value with a ``<`` in it.
    """
    tags = F.filter(F.split(F.regexp_replace("html", _HIDDEN, " "), "<"), lambda t: t.rlike(_TAG))
    found = (
        pages.where(F.col("html").rlike(_HINT))
        .select(F.col("url").alias("u"), F.explode(tags).alias("tag"))
        .select("u", _named_by(F.col("tag")).alias("href"))
    )
    # most pages have no link: the few found are written, so that the html is read once
    hrefs = written(found.where("href <> ''"), "url-hrefs")
    named = written(_absolute(hrefs), "url-named")
    release(hrefs)
    return named


def verdicts(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], redirects: DataFrame | None = None
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, alias_of)`` for every row of ``pages``.

    ``redirects`` may name further aliases in columns ``u`` and ``v``. Without a rule the
    verdict is block if the page's component holds a blocked and no allowed page, else allow.
    ``alias_of`` is the smallest page name of the component, null for pages without links.
    A null url or html has no links; a null or schemeless url is never blocked by a link.
    Repeated rows are judged alike and returned each; no rows give no rows.
    """
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("u", "v"))
    links = written(
        links.select(node_of(F.col("u")).alias("a"), node_of(F.col("v")).alias("b"), "u", "v")
        .where("a is not null and b is not null and a <> b").distinct(),
        "url-links",
    )
    rows = pages.select(
        "page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    judged = with_rule(rows, rules)
    if not links.take(1):
        aliased = judged.withColumn("alias_of", F.lit(None).cast("string")).withColumn("spread", F.lit(None).cast("string"))
    else:
        nodes = components(links)
        urls = links.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("u").alias("url")), F.struct(F.col("b").alias("id"), F.col("v").alias("url")))).alias("n"))
        ruled = with_rule(
            urls.select(F.col("n.id").alias("id"), host_of(F.col("n.url")).alias("host"), path_of(F.col("n.url")).alias("path")).distinct(),
            rules,
        )
        spread = ruled.join(nodes, "id").groupBy("component").agg(F.min("action").alias("spread"))
        known = nodes.join(spread, "component").select(F.col("id").alias("node"), F.col("component").alias("alias_of"), "spread")
        aliased = judged.withColumn("node", node_of(F.col("url"))).join(known, "node", "left")
    # "allow" sorts before "block": the smallest action of a component is its verdict
    return aliased.select(
        "page_id", "host", "path", "rule",
        F.coalesce("action", "spread", F.lit("allow")).alias("verdict"), "alias_of",
    )
