"""URL filters: host and path rules, carried over to the aliases of a page.

Redirects (``<meta http-equiv=refresh>``) and canonical links are edges between
URLs; spellings of one address (scheme, fragment, tracking parameters, closing slash) are too if asked for. Their connected components are found on the cluster. A component with a
blocked URL blocks its URLs that no rule fits, unless a rule allows one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import discard, materialize

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_LINK = r"""(?is)<link\b(?=[^>]*?\bcanonical\b)[^>]*>"""
_HIDDEN = r"""(?is)<!--.*?(?:-->|$)|<(script|style|template|textarea|title)\b.*?(?:</\1\s*>|$)"""
_BASE = r"""(?is)<base\b(?=[^>]*?(?<![\w-])href\s*=)[^>]*>"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*?\bhttp-equiv\s*=\s*["']?\s*refresh\b)[^>]*>"""
_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^"'\s>][^\s>]*))"""
_TO = r"""(?is)^\s*(?:[\d.]*\s*[;,]?\s*url\s*=|[\d.]+\s*[;,\s])\s*(?:"([^"]*)|'([^']*)|([^"'].*))"""
_ENTITY = r"&(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), *_LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def normal_form(url: Column) -> Column:
    """The address that spellings of ``url`` redirect to; null without ``://``."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(r"^(utm_\w+|ref|gclid|fbclid)(=|$)")), "&"
    )
    path = F.regexp_replace(path_of(url), r"/+$", "")
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    return F.when(
        url.contains("://"),
        F.concat(
            F.lit("https://"),
            host,
            F.when(path == "", "/").otherwise(path),
            F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""),
        ),
    )


def _any_group(found: Column, pattern: str) -> Column:
    """What one of the three groups of ``pattern`` holds; empty without a match."""
    return F.concat(*(F.regexp_extract(found, pattern, k) for k in (1, 2, 3)))


def _character(entity: Column) -> Column:
    code = F.when(
        F.lower(F.substring(entity, 3, 1)) == "x", F.conv(F.regexp_extract(entity, "([0-9a-fA-F]+);", 1), 16, 10)
    ).otherwise(F.regexp_extract(entity, "([0-9]+);", 1)).try_cast("int")
    good = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    out = F.when(
        entity.startswith("&#"),
        F.decode(F.unhex(F.lpad(F.hex(F.when(good, code).otherwise(0xFFFD)), 8, "0")), "UTF-32"),
    )
    for name, char in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
        out = out.when(entity == f"&{name};", char)
    return out


def _decoded(value: Column) -> Column:
    """``value`` with its numeric and XML entities as characters."""
    return F.array_join(
        F.zip_with(
            F.split(value, _ENTITY),
            F.regexp_extract_all(value, F.lit(_ENTITY), F.lit(0)),
            lambda t, e: F.concat(t, F.coalesce(_character(e), F.lit(""))),
        ),
        "",
    )


def _attribute(tag: Column, name: str) -> Column:
    return _decoded(_any_group(tag, rf"(?is)(?<![\w-]){name}{_VALUE}"))


def _without_dots(path: Column) -> Column:
    """``path`` from the root, with ``.`` and ``..`` carried out."""
    parts = F.split(path, "/")
    parts = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    return F.array_join(
        F.aggregate(
            parts,
            F.array().cast("array<string>"),
            lambda a, x: F.when(x == ".", a).when(
                x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))
            ).otherwise(F.concat(a, F.array(x))),
        ),
        "/",
    )


def _resolved(target: Column, url: Column) -> Column:
    """An absolute target as it is, others against ``url``; null for an empty one, or another scheme without ``://``."""
    target = F.regexp_replace(F.regexp_replace(target, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")
    scheme, root = F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.regexp_extract(url, r"(?s)^(.*?://)", 1)
    at, rest = F.regexp_extract(target, r"(?s)^[^?#]*", 0), F.regexp_extract(target, r"(?s)^[^?#]*(.*)", 1)
    folder = F.regexp_extract(path_of(url), r"(?s)^.*/", 0)
    return (
        F.when(target == "", F.lit(None))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(target.rlike(r"^[^:]*://"), target))
        .when(~url.contains("://"), F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("#"), F.concat(F.regexp_extract(url, r"(?s)^[^#]*", 0), target))
        .when(target.startswith("?"), F.concat(root, host_of(url), path_of(url), target))
        .when(target.startswith("/"), F.concat(root, host_of(url), _without_dots(at), rest))
        .otherwise(
            F.concat(root, host_of(url), _without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), at)), rest)
        )
    )


def page_edges(pages: DataFrame, url: str = "url", html: str = "html", spellings: bool = False) -> DataFrame:
    """``(src, dst)`` URL pairs: all canonical links and redirects of ``pages``, and with ``spellings`` those of each address.

    Targets have their entities decoded and are resolved against the page's URL, or its first ``<base href>``. ``rel`` is a
    list of words. Tags in comments, scripts, styles and templates are none.
    """
    u = F.col("url")
    all_of = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    shown = pages.select(F.col(url).alias("url"), F.regexp_replace(F.coalesce(F.col(html), F.lit("")), _HIDDEN, " ").alias("text"))
    tags = shown.where("url IS NOT NULL").select(
        "url", all_of(_LINK).alias("links"), all_of(_REFRESH).alias("refreshes"), F.regexp_extract("text", _BASE, 0).alias("base")
    )
    tags = tags.withColumn("base", F.coalesce(_resolved(F.when(F.col("base") != "", _attribute(F.col("base"), "href")), u), u))
    canonical = lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"[ \t\r\n\f]+"), "canonical")
    told = tags.select("url", "base", F.explode(F.concat(
        F.transform(F.filter("links", canonical), lambda t: _attribute(t, "href")),
        F.transform("refreshes", lambda t: _any_group(_attribute(t, "content"), _TO)),
    )).alias("to"))
    direct = told.select("url", _resolved(F.col("to"), F.col("base")).alias("dst"))
    if spellings:
        direct = direct.unionByName(shown.select("url", normal_form(u).alias("dst")))
        direct = direct.unionByName(direct.select(F.col("dst").alias("url"), normal_form(F.col("dst")).alias("dst")))
    return direct.withColumnRenamed("url", "src").where("src <> dst").distinct()


def rule_of_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(url, rule, action)`` of the longest rule that fits each distinct ``url``; no row where none does.

    ``rules`` has ``host, path, action``. A rule fits its host and subdomains where the path starts with the rule's. Of
    equally long rules allow wins, then the first by name. A host meets rules by its endings of as many labels as some
    rule has, whatever its own number of labels.
    """
    dots = lambda host: F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    # a row for each number of labels that rules have, 127 at most for real hosts
    lengths = sorted(
        r[0] for r in rules.select(dots(F.col("host")).alias("n")).where("n IS NOT NULL").distinct().collect()
    )
    if not lengths:
        return urls.select(
            "url", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action")
        ).where("false")
    parts = urls.select("url", host_of(F.col("url")).alias("whole"), path_of(F.col("url")).alias("at"))
    endings = F.array_compact(
        F.array(*(F.when(dots(F.col("whole")) >= n, F.substring_index("whole", ".", -n - 1)) for n in lengths))
    )
    fits = parts.select(
        "url", "at", F.explode(endings).alias("host")
    ).join(rules, "host").where(F.col("at").startswith(F.col("path")))
    name = F.concat("host", "path")
    best = F.min(F.struct((-F.length(name)).alias("n"), F.col("action"), name.alias("rule")))
    return fits.groupBy("url").agg(best.alias("b")).select("url", "b.rule", "b.action")


def _node(url: Column) -> Column:
    """A URL's name among nodes: 128 bits, so that no two URLs of any crawl are taken for one."""
    return F.md5(url.cast("binary"))


def judge_urls(
    pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None, url: str = "url", html: str = "html", spellings: bool = False
) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` (``allow`` or ``block``).

    ``rules``: ``host, path, action``. ``edges``: more ``(src, dst)`` URL pairs, such as a crawl's redirects. A fitting rule
    decides; otherwise the component does: allow if one of its URLs is allowed by a rule, else block if one is blocked,
    else allow. A null URL, or one without ``://``, has an empty host and path, fits no rule, has no aliases and is
    allowed. All canonical links and redirects of a page count; URLs are the same if they are spelled the same, or with
    ``spellings`` if they differ in scheme, port, closing slash, fragment and tracking parameters only. Repeated rows each keep their row, repeated rules
    count once; an empty table gives an empty one, no rules allow all. Columns named like the four new ones are replaced;
    all others are kept, whatever their names.
    """
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict") or c in (url, html)]
    told = page_edges(pages, url, html, spellings)
    if edges is not None:
        told = told.unionByName(edges.select("src", "dst").where("src <> dst")).distinct()
    told = materialize(told, "url-edges")
    urls = pages.select(F.col(f"`{url}`").alias("url")).where("url IS NOT NULL").unionByName(
        told.select(F.explode(F.array("src", "dst")).alias("url"))
    ).distinct()
    ruled = materialize(rule_of_urls(urls, rules.select("host", "path", "action").distinct()), "url-rules")
    joined = materialize(
        components(told.select(_node(F.col("src")).alias("src"), _node(F.col("dst")).alias("dst"))), "url-components"
    )
    decided = ruled.select(
        _node(F.col("url")).alias("node"), "action"
    ).join(joined, "node").groupBy("component").agg(F.min("action").alias("spread"))
    spread = materialize(joined.join(decided, "component").select("node", "spread"), "url-spread")
    discard(told, joined)
    whole = pages.select(
        F.struct(*kept).alias("page"), F.col(f"`{url}`").alias("_url"), _node(F.col(f"`{url}`")).alias("_node")
    )
    out = whole.join(ruled.withColumnRenamed("url", "_url"), "_url", "left").join(
        spread.withColumnRenamed("node", "_node"), "_node", "left"
    )
    verdict = F.coalesce("action", "spread", F.lit("allow")).alias("verdict")
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(
        *(F.col(f"page.`{c}`") for c in names),
        host_of(F.col("_url")).alias("host"),
        path_of(F.col("_url")).alias("path"),
        "rule",
        verdict,
    )
