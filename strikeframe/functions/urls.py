"""Addresses of pages: resolved, normalised and classed, and what slugs and free text tell of a fight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strikeframe.functions.names import is_bad_name
from strikeframe.functions.text import norm_space

#: The first two segments of the addresses of events and fights.
SECTION = ["ufc", "ufc-fight-statistics"]
_FORM = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _FORM, n)


def _without_dots(path: Column) -> Column:
    """The path without ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"), lambda done, s: F.when(s == ".", done).when((s == "..") & (F.size(done) > 1), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == "..", done).otherwise(F.concat(done, F.array(s)))
    )
    return F.concat(F.array_join(kept, "/"), F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))


def resolved(base: Column, href: Column) -> Column:
    """The absolute address of a link on a page, as browsers resolve it; null for an empty link."""
    link, path = F.trim(href), _part(base, 3)
    site = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", "")
    tail = F.regexp_extract(link, r"([?#].*)$", 1)
    own = F.regexp_replace(link, r"[?#].*$", "")
    return (
        F.when(link == "", None)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(_part(base, 1), F.lit(":"), link))
        .when(F.startswith(link, F.lit("?")), F.concat(site, path, link))
        .when(F.startswith(link, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .when(F.startswith(link, F.lit("/")), F.concat(site, _without_dots(own), tail))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, own)), tail))
    )


def canonical(url: Column) -> Column:
    """https, without a fragment, the path ending in a slash; null for what has no host."""
    host, path = _part(url, 2), _part(url, 3)
    return F.when(host != "", F.concat(F.lit("https://"), host, F.when(F.endswith(path, F.lit("/")), path).otherwise(F.concat(path, F.lit("/"))), _part(url, 4)))


def in_domain(url: Column, domain: Column | str) -> Column:
    """The host is the domain, or ends with it."""
    wanted = F.lit(domain) if isinstance(domain, str) else domain
    return F.endswith(F.lower(_part(url, 2)), F.lower(wanted))


def segments(url: Column) -> Column:
    return F.filter(F.split(_part(url, 3), "/"), lambda s: s != "")


def kind(url: Column) -> Column:
    """``event``, ``fight`` or ``index`` within the section of fight statistics, else ``other``."""
    s = segments(url)
    section = (F.get(s, F.lit(0)) == SECTION[0]) & (F.get(s, F.lit(1)) == SECTION[1])
    fight = (F.size(s) == 4) & F.lower(F.get(s, F.lit(3))).rlike("-vs?-")
    return F.when(section & (F.size(s) == 3), "event").when(section & fight, "fight").when(section, "index").otherwise("other")


def page_links(html: Column, base: Column, domain: Column | str) -> Column:
    """The canonical addresses of the page's links within the domain, each once, in order."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    whole = F.transform(found, lambda h: canonical(resolved(base, h)))
    return F.array_distinct(F.filter(whole, lambda u: u.isNotNull() & in_domain(u, domain)))


def slug_name(slug: Column) -> Column:
    """A name of a slug: ``039`` stands for an apostrophe, hyphens and underscores for spaces; each part begins with a capital."""
    words = F.split(norm_space(F.regexp_replace(F.replace(slug, F.lit("039"), F.lit("'")), r"[_\-]+", " ")), " ")
    capital = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1_000_000)))
    return F.array_join(F.transform(words, lambda w: F.array_join(F.transform(F.split(w, "'"), capital), "'")), " ")


def sides_of_fight(url: Column) -> Column:
    """The two names of the last segment ``one-v-other``; null if it has another form or a name can't be one."""
    tail = F.element_at(F.split(F.regexp_replace(url, "^/+|/+$", ""), "/"), -1)
    a, b = slug_name(F.regexp_extract(tail, r"^(.*?)-v-(.*)$", 1)), slug_name(F.regexp_extract(tail, r"^(.*?)-v-(.*)$", 2))
    return F.when(F.contains(tail, F.lit("-v-")) & ~is_bad_name(a) & ~is_bad_name(b), F.struct(a.alias("a"), b.alias("b")))


def told_sides(text: Column) -> Column:
    """winner and loser of the first names before ``(Win)`` and ``(Loss)``; a name counts as it is first told of; null without both."""
    told = F.lit(r"(?i)\b([A-Z][A-Za-z.\-'\s]{2,40}?)\s*\((?:Win|Loss)\)")
    names = F.transform(F.regexp_extract_all(text, told, F.lit(1)), norm_space)
    ends = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b[A-Z][A-Za-z.\-'\s]{2,40}?\s*\((Win|Loss)\)"), F.lit(1)), F.lower)
    hits = F.transform(F.arrays_zip(names.alias("n"), ends.alias("e")), lambda x, i: F.struct(x["n"].alias("n"), x["e"].alias("e"), F.lower(x["n"]).alias("k"), i.alias("i")))
    first = F.transform(F.array(hits), lambda hs: F.filter(hs, lambda h: ~F.exists(hs, lambda o: (o["k"] == h["k"]) & (o["i"] < h["i"]))))[0]
    side = lambda e: F.get(F.filter(first, lambda h: h["e"] == e), F.lit(0))["n"]
    return F.when(side("win").isNotNull() & side("loss").isNotNull(), F.struct(side("win").alias("winner"), side("loss").alias("loser")))


def told_result(text: Column) -> Column:
    """method, round and time as free text tells them."""
    has = lambda form: text.rlike(f"(?i){form}")
    found = lambda form: F.nullif(F.regexp_extract(text, form, 1), F.lit(""))
    by = found(r"(?i)\bDecision\b\s*-\s*(Unanimous|Split|Majority)")
    method = F.when(has(r"\bDecision\b"), F.concat(F.lit("Decision"), F.coalesce(F.concat(F.lit(" - "), F.initcap(F.lower(by))), F.lit("")))).when(has(r"\bKO/TKO\b|\bT?KO\b"), "KO/TKO").when(has(r"\bSubmission\b"), "Submission")
    number = F.coalesce(found(r"(?i)\bRound\s*[:\-]?\s*(\d)\b"), found(r"\bR(\d)\b")).try_cast("int")
    time = F.coalesce(found(r"(?i)\bTime\s*[:\-]?\s*(\d{1,2}:\d{2})\b"), found(r"\b(\d{1,2}:\d{2})\b"))
    return F.struct(method.alias("method"), number.alias("round"), time.alias("time"))
