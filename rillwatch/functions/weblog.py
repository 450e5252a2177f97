"""Classifiers for access-log records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillwatch import config

# Patterns of the request classes.
BOT_WORDS = "(?i)bot|crawler|spider|scraper"
SUSPICIOUS = {
    "path_traversal": r"(?i)\.\./\.\.",
    "code_injection": r"(?i)eval\(",
    "sql_injection": r"(?i)union.*select",
    "script_tag": r"(?i)<script",
    "script_url": r"(?i)javascript:",
}
SENSITIVE = {
    "admin_path": r"(?i)^/(admin|phpmyadmin|wp-admin)",
    "file_type": r"(?i)\.(sql|env|config|ini|bak|old|tmp)$",
    "hidden_file": r"/\.",
    "backup_file": r"~$",
}
STATIC_FILE = r"(?i)\.(jpg|jpeg|png|gif|ico|css|js|svg|woff|woff2|ttf|eot)$"
LOGIN_PATH = r"^/(login|signin|auth|authenticate)"
XML_TYPE = r"^(?:application(?:/soap\+|/)|text/)xml"
JSON_TYPE = r"^application/json"


def path_of(uri: Column) -> Column:
    """The request path without its query string."""
    return F.substring_index(uri, "?", 1)


def is_blocked(status: Column) -> Column:
    return F.coalesce(status.isin(403, 429), F.lit(False))


def is_bot(agent: Column) -> Column:
    """Known bot words in any case, or no agent at all."""
    agent = F.coalesce(agent, F.lit(""))
    return agent.rlike(BOT_WORDS) | (agent == "")


def _classes(text: Column, patterns: dict[str, str]) -> Column:
    found = F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in patterns.items()])
    return F.filter(found, lambda n: n.isNotNull())


def suspicious_classes(uri: Column) -> Column:
    return _classes(uri, SUSPICIOUS)


def sensitive_classes(uri: Column) -> Column:
    return _classes(path_of(uri), SENSITIVE)


def route_class(uri: Column) -> Column:
    """Which location answers: patterns are tried before path prefixes."""
    path = path_of(uri)
    return (
        F.when(path.rlike(STATIC_FILE), "static").when(path.rlike(LOGIN_PATH), "login")
        .when(path.startswith("/api/"), "api").when(path.startswith("/health"), "health").otherwise("other")
    )


def rate_zone(uri: Column) -> Column:
    """The request limit that applies, by the same order as ``route_class``; health checks answer before any limit."""
    path = path_of(uri)
    return (
        F.when(path.rlike(STATIC_FILE), "global").when(path.rlike(LOGIN_PATH), "login")
        .when(path.startswith("/api/"), "api").when(~path.startswith("/health"), "global")
    )


def body_kind(content_type: Column) -> Column:
    kind = F.lower(content_type)
    return F.when(kind.rlike(XML_TYPE), "XML").when(kind.rlike(JSON_TYPE), "JSON").otherwise("OTHER")


def audit_relevant(status: Column) -> Column:
    return (status >= 500) & (status <= 599) | (status >= 400) & (status <= 499) & (status != 404)


def limit_breaches(size: Column, args: Column) -> Column:
    """Names of the request limits a request goes over."""
    n_args = F.when(F.coalesce(args, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(args, "&")))
    found = F.array(
        F.when(size > config.MAX_UPLOAD_BYTES, F.lit("body_size")),
        F.when(size > config.MAX_REQUEST_BYTES, F.lit("request_size")),
        F.when(n_args >= config.MAX_ARGUMENTS, F.lit("arguments")),
    )
    return F.filter(found, lambda n: n.isNotNull())


def like_search(term: str, *texts: Column) -> Column:
    """SQL LIKE '%term%' over any of ``texts``, ASCII case ignored, with % and _ in the term as wildcards."""
    hit = F.lit(False)
    for t in texts:
        hit = hit | F.coalesce(t.ilike(f"%{term}%"), F.lit(False))
    return hit
