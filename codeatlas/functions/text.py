"""Strings, labels and times as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kebab_case(name: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(out == "", F.lit("area")).otherwise(out)


def title_first(text: Column) -> Column:
    """Only the first character is raised."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2**30))


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, F.lit(one)).otherwise(F.lit(many or one + "s")))


def count_phrase(n: Column, one: str, many: str | None = None) -> Column:
    """As plural(), with 'no' for none."""
    return F.when(n == 0, F.lit(f"no {many or one + 's'}")).otherwise(plural(n, one, many))


def join_and(parts: Column) -> Column:
    """'a', 'a and b', 'a, b and c'."""
    n = F.size(parts)
    head = F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 0, F.lit("")).when(n == 1, F.element_at(parts, 1)).otherwise(F.concat(head, F.lit(" and "), F.element_at(parts, -1)))


def path_label(path: Column) -> Column:
    """'/' for the root, else the path with one leading slash."""
    return F.when(path == ".", F.lit("/")).when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def last_segment(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(path)


def initials(name: Column) -> Column:
    """First and last initial, or the first two characters of a single name, in capitals."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    two = F.concat(F.substring(F.element_at(words, 1), 1, 1), F.substring(F.element_at(words, -1), 1, 1))
    return F.upper(F.when(F.size(words) >= 2, two).otherwise(F.substring(F.trim(name), 1, 2)))


def day_key(iso: Column) -> Column:
    """The UTC day of an ISO 8601 string: its first ten characters."""
    return F.substring(iso, 1, 10)


def blob_url(owner: Column, repo: Column, sha: Column, path: Column, line: Column | None = None) -> Column:
    url = F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo, F.lit("/blob/"), sha, F.lit("/"), path)
    return url if line is None else F.concat(url, F.coalesce(F.concat(F.lit("#L"), line.cast("string")), F.lit("")))


def tree_url(owner: Column, repo: Column, sha: Column, path: Column) -> Column:
    return F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo, F.lit("/tree/"), sha, F.when(path == ".", F.lit("")).otherwise(F.concat(F.lit("/"), path)))


def relative_time(seconds_ago: Column) -> Column:
    """'5 minutes ago', 'yesterday', 'last month', ...: whole units, a month of 30 and a year of 365 days."""
    n = lambda unit: F.floor(seconds_ago / unit).cast("long")

    def said(unit: int, word: str, last: str | None) -> Column:
        one = F.lit(last) if last else F.lit(f"1 {word} ago")
        return F.when(n(unit) == 1, one).otherwise(F.concat(n(unit).cast("string"), F.lit(f" {word}s ago")))

    return (
        F.when(seconds_ago >= 31_536_000, said(31_536_000, "year", "last year"))
        .when(seconds_ago >= 2_592_000, said(2_592_000, "month", "last month"))
        .when(seconds_ago >= 86_400, said(86_400, "day", "yesterday"))
        .when(seconds_ago >= 3_600, said(3_600, "hour", None))
        .when(seconds_ago >= 60, said(60, "minute", None))
        .otherwise(F.lit("just now"))
    )


def recency_bucket(at: Column, now: Column) -> Column:
    """'This week' below seven days, 'Earlier this month' in now's month, else month and year."""
    age = F.unix_timestamp(now) - F.unix_timestamp(at)
    return (
        F.when(age < 7 * 86_400, F.lit("This week"))
        .when(F.date_trunc("month", at) == F.date_trunc("month", now), F.lit("Earlier this month"))
        .otherwise(F.date_format(at, "MMMM yyyy"))
    )


def is_stale(analyzed_at: Column, now: Column, seconds: int = 86_400) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(analyzed_at) >= seconds


def is_crawler(agent: Column) -> Column:
    """No agent counts as a crawler. Third-party lists of agents are left out."""
    return agent.isNull() | agent.rlike(r"(?i)bot\b|crawler|spider|crawling")


def first_forwarded(header: Column) -> Column:
    """The client of an X-Forwarded-For header, or 'unknown'."""
    first = F.trim(F.element_at(F.split(header, ","), 1))
    return F.when(header.isNull() | (first == ""), F.lit("unknown")).otherwise(first)


def round_half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity, as scores are rounded."""
    return F.floor(x + 0.5)


def lead_sentence(text: Column, most: int = 89) -> Column:
    """Without closing punctuation; cut at `most` characters with an ellipsis."""
    t = F.regexp_replace(F.trim(text), r"[.!?]+$", "")
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most)), F.lit("…"))).otherwise(t)


def badge_snippets(owner: Column, repo: Column, origin: str) -> Column:
    """Markdown, HTML, reStructuredText and AsciiDoc for a badge that links to a repository's page."""
    page = F.concat(F.lit(f"{origin}/"), F.url_encode(owner), F.lit("/"), F.url_encode(repo))
    image = F.concat(page, F.lit("/badge.svg"))
    return F.struct(
        F.concat(F.lit("[![codeatlas]("), image, F.lit(")]("), page, F.lit(")")).alias("markdown"),
        F.concat(F.lit('<a href="'), page, F.lit('"><img src="'), image, F.lit('" alt="codeatlas"></a>')).alias("html"),
        F.concat(F.lit(".. image:: "), image, F.lit("\n   :target: "), page).alias("rst"),
        F.concat(F.lit("image:"), image, F.lit('[codeatlas,link="'), page, F.lit('"]')).alias("asciidoc"),
    )
