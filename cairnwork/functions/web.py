"""Addresses of pages and files: normalising, safety, direct links, hosts, and what responses tell of a site."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts and address ranges that are never fetched, segments of paths that belong to institutional data, hosts of
# shared files, signs of log-in pages and challenges, and words of error texts with the outcome that they stand for.
BLOCKED_HOSTS = ("localhost", "metadata.google.internal", "metadata")
PRIVATE = "^(127\\.|10\\.|192\\.168\\.|172\\.(1[6-9]|2\\d|3[01])\\.|169\\.254\\.|0\\.|100\\.(6[4-9]|[7-9]\\d|1[01]\\d|12[0-7])\\.|::1$|fe80:)"
DATA_SEGMENTS = ("cds", "common-data-set", "common_data_set", "institutional-research", "institutional_research", "ir", "oir", "oira", "iro", "irp")
SHARE_LINKS = (
    ("(?i)^(https?://)([^.]+)(?:\\.app)?\\.box\\.com/s/([^/?#]+).*$", "$1$2.box.com/shared/static/$3"),
    ("(?i)^https?://drive\\.google\\.com/file/d/([^/]+).*$", "https://drive.google.com/uc?export=download&id=$1&confirm=t"),
    ("(?i)^https?://drive\\.google\\.com/open\\?id=([^&]+).*$", "https://drive.google.com/uc?export=download&id=$1&confirm=t"),
    ("(?i)^https?://docs\\.google\\.com/spreadsheets/d/([^/]+).*$", "https://docs.google.com/spreadsheets/d/$1/export?format=xlsx"),
    ("(?i)^https?://docs\\.google\\.com/document/d/([^/]+).*$", "https://docs.google.com/document/d/$1/export?format=docx"),
)
STORAGE = {
    "box": "(^|\\.)box\\.com$|\\.box\\.net$", "google_drive": "^(drive|docs|sites)\\.google\\.com$", "sharepoint": "(^|\\.)sharepoint\\.com$", "dropbox": "(^|\\.)dropbox\\.com$",
}
WALLS = {"auth_walled_microsoft": "\\.microsoftonline\\.com$", "auth_walled_okta": "(^|\\.)okta\\.com$", "auth_walled_google": "^(my)?account(s)?\\.google\\.com$"}
ERROR_WORDS = (
    ("auth_walled_microsoft", ("login.microsoftonline.com", "/saml")), ("auth_walled_okta", (".okta.com",)), ("auth_walled_google", ("accounts.google.com",)),
    ("bot_challenge", ("bot challenge", "cloudflare bot", "imperva bot", "just a moment", "cf-mitigated", "cf-chl-", "__cf_chl_", "incapsula incident")),
    ("dead_url", ("http 404", "http 410", "upstream_gone")), ("transient", ("http 5", "timeout", "transient")),
    ("no_pdfs_found", ("no cds found", "no_cds_found", "no anchors")), ("wrong_content_type", ("unsupported", "magic", "content type")), ("blocked_url", ("blocked", "unsafe url")),
)
PAGE_WORDS = (
    ("auth_walled_microsoft", ("login.microsoftonline.com", "sign in to your account", "aadcdn", "samlrequest", "microsoft corporation. all rights reserved")),
    ("auth_walled_google", ("accounts.google.com", "service_login", "google accounts", "google sign in", "identifierid")),
    ("auth_walled_okta", ("okta sign in", "okta-signin", ".okta.com")),
    ("bot_challenge", (
        "cloudflare", "just a moment", "cf-mitigated", "cf-chl-", "__cf_chl_", "captcha", "incapsula incident", "imperva", "perfdrive", "validate.perfdrive.com", "access denied",
        "request unsuccessful",
    )),
    ("wrong_content_type", (
        "404 not found", "404 error", "page not found", "file not found", "the page you requested could not be found", "server error", "temporarily unavailable", "please sign in",
        "single sign-on", "single sign on",
    )),
)
SUBJECT = "common data set|common dataset|\\bcds\\b|first-time, first-year|degree-seeking undergraduate"
AGENTS = (
    ("ai_agent", ("claude", "anthropic", "chatgpt", "openai", "perplexity", "copilot")), ("curl", ("curl/",)), ("python", ("python-requests", "aiohttp")),
    ("node_fetch", ("node-fetch", "undici")), ("browser", ("mozilla/",)),
)


def _has(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _by_words(text: Column, table: Sequence[tuple[str, Sequence[str]]], otherwise: Column) -> Column:
    """The name of the first entry one of whose words stands in the text."""
    return reduce(lambda out, x: F.when(_has(text, x[1]), x[0]).otherwise(out), reversed(table), otherwise)


def seed_url(text: Column) -> Column:
    """The address as given if it has a scheme, else with https; null for blank ones and those without a plain host."""
    bare = F.trim(text)
    full = F.when(bare.rlike("(?i)^https?://"), bare).otherwise(F.concat(F.lit("https://"), F.regexp_replace(bare, "^/+", "")))
    return F.when((bare != "") & full.rlike("(?i)^https?://[^\\s/?#:@]+(:\\d+)?([/?#]\\S*)?$"), full)


def direct_link(url: Column) -> Column:
    """The download address of a shared file; other addresses as they are."""
    return reduce(lambda out, x: F.regexp_replace(out, *x), SHARE_LINKS, url)


def fetchable(url: Column) -> Column:
    """Whether an address is http(s) and its host isn't local, private or a metadata service."""
    host = F.lower(F.regexp_extract(url, "(?i)^https?://(?:[^/@?#]*@)?(\\[[^]]*\\]|[^/:?#]+)", 1))
    host = F.regexp_replace(host, "[\\[\\]]", "")
    return F.coalesce((host != "") & ~host.isin(*BLOCKED_HOSTS) & ~host.endswith(".localhost") & ~host.rlike(PRIVATE), F.lit(False))


def full_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def organisation(url: Column) -> Column:
    """The last two labels of the host; an IPv4 address whole; null without a dot."""
    host = full_host(url)
    return F.when(host.rlike("^\\d+\\.\\d+\\.\\d+\\.\\d+$"), host).when(host.contains("."), F.substring_index(host, ".", -2))


def third_party(url: Column) -> Column:
    """The service that holds a shared file, null for other hosts."""
    host = full_host(url)
    return reduce(lambda out, x: F.when(host.rlike(x[1]), x[0]).otherwise(out), reversed(STORAGE.items()), F.lit(None).cast("string"))


def auth_wall(url: Column) -> Column:
    """The log-in service that an address belongs to, null for others."""
    host = full_host(url)
    return reduce(lambda out, x: F.when(host.rlike(x[1]), x[0]).otherwise(out), reversed(WALLS.items()), F.lit(None).cast("string"))


def cms(headers: Column, url: Column) -> Column:
    """The content system by a map of lower-case header names, else by the address."""

    def head(name: str) -> Column:
        return F.lower(F.coalesce(headers[name], F.lit("")))

    low = F.lower(F.coalesce(url, F.lit("")))
    return (
        F.when(head("x-generator").contains("drupal") | head("server").contains("drupal"), "drupal").when(head("x-generator").contains("wordpress") | head("x-powered-by").contains("wordpress"), "wordpress")
        .when(head("server").contains("microsoft-iis") & head("x-powered-by").contains("asp.net") & F.coalesce(url, F.lit("")).contains("/_layouts/"), "sharepoint")
        .when(low.contains("/wp-content/") | low.contains("/wp-json/"), "wordpress").when(low.contains("/sites/default/files/") | low.contains("/_default_"), "drupal")
        .when(low.contains("/_layouts/") | low.contains("/sitepages/"), "sharepoint").otherwise("unknown")
    )


def waf(headers: Column) -> Column:
    """The service in front of a site by its headers."""
    server = F.lower(F.coalesce(headers["server"], F.lit("")))
    marks = (("aws_cloudfront", "x-amz-cf-id"), ("akamai", "x-akamai-transformed"), ("fastly", "x-fastly-request-id"))
    rest = F.when(server.contains("imperva"), "imperva").otherwise("unknown")
    known = reduce(lambda out, x: F.when(F.coalesce(headers[x[1]], F.lit("")) != "", x[0]).otherwise(out), reversed(marks), rest)
    return F.when((F.coalesce(headers["cf-ray"], F.lit("")) != "") | (server == "cloudflare"), "cloudflare").otherwise(known)


def rendering(length: Column, anchors: Column) -> Column:
    """static_html for a page with links, js_required for a small one without, else unknown."""
    return F.when(anchors > 0, "static_html").when((anchors == 0) & (length > 0) & (length < 50_000), "js_required").otherwise("unknown")


def parent_folders(url: Column, levels: int = 3) -> Column:
    """The folders above a file, nearest first, of which a segment names institutional data."""
    origin = F.regexp_extract(url, "(?i)^(https?://[^/?#]+)", 1)
    path = F.split(F.regexp_extract(url, "(?i)^https?://[^/?#]+([^?#]*)", 1), "/")
    parts = F.filter(path, lambda s: s != "")
    depth = F.size(parts) - 1

    def folder(k: Column) -> Column:
        own = F.slice(parts, F.lit(1), F.greatest(depth - k, F.lit(0)))
        fits = (depth > k) & F.exists(own, lambda s: F.lower(s).isin(*DATA_SEGMENTS))
        return F.when(fits, F.concat(origin, F.lit("/"), F.array_join(own, "/"), F.lit("/")))

    return F.when(origin != "", F.filter(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), folder), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def well_known(url: Column, paths: Sequence[str]) -> Column:
    """The site's address with each of the paths; none for other schemes."""
    origin = F.regexp_extract(url, "(?i)^(https?://[^/?#]+)", 1)
    return F.when(origin != "", F.array(*[F.concat(origin, F.lit(p)) for p in paths])).otherwise(F.array().cast("array<string>"))


def error_outcome(message: Column) -> Column:
    """The outcome that an error text stands for; null for a blank text."""
    low = F.lower(message)
    large = F.when(low.contains("exceeds") & low.contains("bytes"), "file_too_large").otherwise("permanent_other")
    return F.when(message != "", _by_words(low, ERROR_WORDS, large))


def page_outcome(url: Column, text: Column) -> Column:
    """Why a page can't be the document it should be: a log-in or challenge page, an error page, or a page on the subject without tables; null otherwise."""
    low = F.concat_ws("\n", F.coalesce(full_host(url), F.lit("")), F.lower(F.coalesce(text, F.lit(""))))
    tables = low.contains("<table") & (low.contains("<td") | low.contains("<th"))
    return _by_words(low, PAGE_WORDS, F.when(low.rlike(SUBJECT) & ~tables, "wrong_content_type"))


def agent_family(agent: Column) -> Column:
    low = F.lower(F.coalesce(agent, F.lit("")))
    return F.when(low == "", "unknown").when(low == "node", "node_fetch").otherwise(_by_words(low, AGENTS, F.lit("script")))


def client_family(client: Column, agent: Column) -> Column:
    """mcp, cli or integration by the name that a client gives, else by its agent."""
    low, family = F.lower(F.coalesce(client, F.lit(""))), agent_family(agent)
    by_agent = F.when(family.isin("browser", "ai_agent"), family).when(family == "unknown", "unknown").otherwise("script")
    return F.when(low.contains("mcp"), "mcp").when(low.contains("cli"), "cli").when(low != "", "integration").otherwise(by_agent)


def route_kind(path: Column, routes: Sequence[tuple[str, str]], otherwise: str = "other") -> Column:
    """The name of the first route whose pattern the whole path matches."""
    return reduce(lambda out, x: F.when(path.rlike(f"^(?:{x[0]})$"), x[1]).otherwise(out), reversed(routes), F.lit(otherwise))


def storage_class(counts: Mapping[str, Column], own: Column) -> Column:
    """Where a site keeps its files, from the number on its own hosts and on each service: same_origin, a service, mixed or unknown."""
    services = reduce(lambda a, b: a + b, [(c > 0).cast("int") for c in counts.values()])
    one = reduce(lambda out, x: F.when(x[1] > 0, x[0]).otherwise(out), counts.items(), F.lit("unknown"))
    return F.when((services == 0) & (own > 0), "same_origin").when((services > 1) | ((own > 0) & (services > 0)), "mixed").otherwise(one)
