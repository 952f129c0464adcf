"""Repository references as typed results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OWNER, _REPO = r"^[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?$", r"^[A-Za-z0-9._-]+$"
# First path segments that are pages, not owners.
_RESERVED = ("lore", "explore", "api", "_next")


def _checked(owner: Column, repo: Column, reason: Column) -> Column:
    repo = F.regexp_replace(repo, r"\.git$", "")
    reason = (
        F.when(reason.isNotNull(), reason)
        .when(owner.isNull() | (owner == "") | repo.isNull() | (repo == ""), F.lit("missing-owner-or-repo"))
        .when(~owner.rlike(_OWNER), F.lit("invalid-owner"))
        .when(~repo.rlike(_REPO) | repo.isin(".", ".."), F.lit("invalid-repo"))
    )
    ok = reason.isNull()
    return F.struct(F.when(ok, owner).alias("owner"), F.when(ok, repo).alias("repo"), reason.alias("reason"))


def parse_repository(text: Column) -> Column:
    """struct<owner, repo, reason> of 'owner/repo' or a URL on github.com; reason is null if it could be read."""
    t = F.trim(text)
    parts = F.split(t, "/")
    short = (F.size(parts) == 2) & ~F.element_at(parts, 1).contains(".") & ~t.contains(":") & (F.element_at(parts, 1) != "")
    url = F.when(t.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), t).otherwise(F.concat(F.lit("https://"), t))
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[^:]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.filter(F.split(F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1), "/"), lambda s: s != "")
    reason = (
        F.when(t.isNull() | (t == ""), F.lit("empty"))
        .when(~scheme.isin("http", "https"), F.lit("unsupported-scheme"))
        .when(~host.isin("github.com", "www.github.com"), F.lit("unsupported-host"))
    )
    get = lambda a, i: F.get(a, F.lit(i))
    return F.when(short, _checked(get(parts, 0), get(parts, 1), F.lit(None).cast("string"))).otherwise(_checked(get(path, 0), get(path, 1), reason))


def repository_from_path(segments: Column) -> Column:
    """struct<owner, repo, reason> of percent-encoded path segments that name a repository where a page was expected, with or without a host in front; further segments are ignored."""
    decoded = F.transform(segments, lambda s: F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))))
    first = F.lower(F.get(decoded, F.lit(0)))
    path = F.when(first.isin("github.com", "www.github.com"), F.slice(decoded, F.lit(2), F.greatest(F.size(decoded) - 1, F.lit(0)))).otherwise(decoded)
    reason = (
        F.when(F.exists(decoded, lambda s: s.isNull()), F.lit("undecodable"))
        .when(first.isin(*_RESERVED), F.lit("reserved"))
        .when(F.coalesce(first, F.lit("")).eqNullSafe("") | (F.size(path) < 2), F.lit("missing-owner-or-repo"))
    )
    none = F.lit(None).cast("string")
    return F.when(reason.isNotNull(), F.struct(none.alias("owner"), none.alias("repo"), reason.alias("reason"))).otherwise(parse_repository(F.concat(F.lit("https://github.com/"), F.array_join(path, "/"))))


def http_error(status: Column, remaining: Column) -> Column:
    """What an API's answer means; null for success."""
    return (
        F.when(status.between(200, 299), F.lit(None).cast("string"))
        .when(status == 404, F.lit("not-found"))
        .when(status == 401, F.lit("unauthorized"))
        .when((status == 403) & (remaining == 0), F.lit("rate-limited"))
        .otherwise(F.lit("unknown"))
    )
