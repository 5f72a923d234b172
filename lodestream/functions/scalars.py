"""Scalar functions over link, name, time and metric columns. All are column expressions; only the references of markup leave the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .markup import unescaped

#: Hosts that many projects share, words too general to name one, path beginnings of articles.
SHARED_DOMAINS = (
    "github.io", "vercel.app", "netlify.app", "huggingface.co", "npmjs.com", "pypi.org", "producthunt.com", "x.com", "twitter.com", "t.co",
    "github.com", "news.ycombinator.com", "ycombinator.com"
)
GENERIC_NAMES = (
    "agent", "agents", "open", "studio", "browser", "desktop", "assistant", "code", "mcp", "ai", "app", "tool", "tools", "sdk", "api"
)
CONTENT_DOMAINS = ("medium.com", "substack.com", "techcrunch.com")
CONTENT_SUFFIXES, CONTENT_PREFIXES = (".medium.com", ".substack.com"), ("blog.", "news.", "newsroom.")
CONTENT_PATHS = (
    "article", "articles", "blog", "blogs", "essay", "essays", "news", "newsletter", "newsletters", "p", "post", "posts", "story",
    "stories", "writing", "writings"
)

GITHUB_LINK = r"https?://github\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)"
LINK = r"https?://[^\s)>\"]+"
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def _none(c: Column) -> Column:
    return F.when(c != "", c)


def github_keys(text: Column) -> Column:
    """Sorted distinct ``github:owner/repo`` keys of all repository links; punctuation at the end of a name stays."""
    found = F.regexp_extract_all(text, F.lit(GITHUB_LINK), F.lit(0))
    return F.array_sort(
        F.array_distinct(
            F.transform(
                found,
                lambda u: F.concat(
                    F.lit("github:"), F.lower(F.regexp_replace(F.regexp_replace(u, r"^https?://github\.com/", ""), r"\.git$", ""))
                )
            )
        )
    )


def github_keys_in_prose(text: Column) -> Column:
    """The same for running text: punctuation after a name is cut, keys stay in the order they are first seen."""
    found = F.regexp_extract_all(text, F.lit(GITHUB_LINK), F.lit(0))
    clean = lambda u: F.regexp_replace(
        F.regexp_replace(F.regexp_replace(u, r"^https?://github\.com/", ""), r"\.git$", ""), r"[.,;:!?)\"\]}']+$", ""
    )
    return F.array_distinct(F.transform(found, lambda u: F.concat(F.lit("github:"), F.lower(F.regexp_replace(clean(u), r"\.git$", "")))))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"^\.+|\.+$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def path_parts(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda p: p != "")


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def registrable_domain(url: Column, keep_subdomain: Column) -> Column:
    """The last two labels of the host (the whole host where ``keep_subdomain``), null for shared hosts and bare names."""
    h = bare_host(url)
    parts = F.split(h, r"\.")
    two = F.concat_ws(".", F.slice(parts, -2, 2))
    return F.when((F.size(parts) >= 2) & ~two.isin(*SHARED_DOMAINS), F.when(keep_subdomain & (F.size(parts) > 2), h).otherwise(two))


def domain_keys(text: Column, keep_subdomain: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(LINK), F.lit(0))
    keys = F.transform(found, lambda u: F.concat(F.lit("domain:"), registrable_domain(u, keep_subdomain)))
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: k.isNotNull())))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def name_key(name: Column) -> Column:
    s = slug(name)
    return F.when((F.length(s) >= 6) & ~s.isin(*GENERIC_NAMES), F.concat(F.lit("name:"), s))


def title_key(title: Column) -> Column:
    return F.concat(F.lit("title:"), F.coalesce(_none(slug(F.trim(F.coalesce(title, F.lit(""))))), F.lit("untitled")))


def story_url(url: Column) -> Column:
    """https form without query and fragment; repository links keep two path parts, shared hosts give null."""
    h, p, parts = bare_host(url), F.regexp_replace(path(url), "/+$", ""), path_parts(url)
    repo = F.when(
        F.size(parts) >= 2,
        F.concat(F.lit("https://github.com/"), F.lower(parts[0]), F.lit("/"), F.regexp_replace(F.lower(parts[1]), r"\.git$", ""))
    )
    other = F.concat(F.lit("https://"), h, p)
    package = (h == "npmjs.com") & p.startswith("/package/")
    return F.when(h == "", None).when(h == "github.com", repo).when(package, other).when(h.isin(*SHARED_DOMAINS), None).otherwise(other)


def page_url(url: Column) -> Column:
    """Scheme and host lower-cased, fragment dropped, query kept, empty path as a slash."""
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    net = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    query = F.regexp_extract(url, r"^[^#?]*(\?[^#]*)", 1)
    return F.concat(scheme, F.lit("://"), net, F.coalesce(_none(path(url)), F.lit("/")), query)


def repo_url_key(url: Column) -> Column:
    """``github:owner/repo`` of links that have exactly these two path parts."""
    parts = path_parts(url)
    ok = host(url).isin("github.com", "www.github.com") & (F.size(parts) == 2) & url.rlike("^https?://")
    return F.when(ok, F.concat(F.lit("github:"), F.lower(parts[0]), F.lit("/"), F.lower(F.regexp_replace(parts[1], r"\.git$", ""))))


def repo_key_of_link(url: Column) -> Column:
    """``owner/repo`` of links with at least two path parts."""
    parts = path_parts(url)
    ok = host(url).isin("github.com", "www.github.com") & (F.size(parts) >= 2)
    return F.when(ok, F.concat(F.lower(parts[0]), F.lit("/"), F.regexp_replace(F.lower(parts[1]), r"\.git$", "")))


def npm_key(url: Column) -> Column:
    parts = path_parts(url)
    ok = host(url).isin("npmjs.com", "www.npmjs.com") & (F.element_at(parts, 1) == "package") & (F.size(parts) > 1)
    return F.when(ok, F.concat(F.lit("npm:"), F.concat_ws("/", F.slice(parts, 2, 99))))


def repository_key(value: Column) -> Column:
    """``github:`` key of a package's repository field: git+, git@, github: and plain links."""
    text = F.regexp_replace(F.trim(value), r"^git\+", "")
    text = F.regexp_replace(text, r"^git@github\.com:", "https://github.com/")
    text = F.regexp_replace(text, r"^github:", "https://github.com/")
    found = F.regexp_extract(text, r"github\.com/([^/\s]+)/([^/\s#?]+)", 0)
    repo = F.regexp_replace(F.regexp_replace(found, r"^github\.com/", ""), r"\.git$", "")
    return F.when(found != "", F.concat(F.lit("github:"), F.lower(repo)))


def key_url(key: Column) -> Column:
    rest = F.regexp_replace(key, "^[a-z]+:", "")
    return F.when(key.startswith("github:"), F.concat(F.lit("https://github.com/"), rest)).when(key.startswith("domain:"), F.concat(F.lit("https://"), rest)).when(
        key.startswith("npm:"), F.concat(F.lit("https://www.npmjs.com/package/"), rest)
    )


def key_strength(key: Column) -> Column:
    return F.when(key.startswith("github:"), 3).when(key.startswith("domain:"), 2).otherwise(1)


def _resolved(text: Column, closed: bool) -> Column:
    """References resolved; ``closed``: only those that end with a semicolon, so the ampersand of others is guarded meanwhile."""
    if not closed:
        return unescaped(text)
    return unescaped(F.regexp_replace(text, OPEN_REFERENCE, "&amp;"))


#: An ampersand that begins no reference with a semicolon at its end.
OPEN_REFERENCE = r"&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)"


def stripped_html(text: Column, closed: bool = False) -> Column:
    """Tags become blanks, all references are resolved (``closed``: those that end with a semicolon), blanks collapse."""
    return F.trim(F.regexp_replace(_resolved(F.regexp_replace(text, "<[^>]+>", " "), closed), f"{_BLANK}+", " "))


#: White space of any script.
_BLANK = r"[ \t\n\r\f\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: What a preview leaves out, in turn, before and after references are resolved.
PREVIEW_MARKUP = (
    (r"(?s)```.*?```", " "),
    (r"(?s)~~~.*?~~~", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"\[\s*!\[[^\]]*\]\s*\]\([^)]*\)", " "),
    (r"\[\s*!\[[^\]]*\]\s*\]\[[^\]]*\]", " "),
    (r"(?d)\[\s*!\[[^\]]*\](?:\[[^\]]*\]|\([^)]*)?.*$", " "),
    (r"(?dm)^\s*\[[^\]]+\]:\s*\S+.*$", " "),
    (r"(?d)!\[[^\]]*$", " "),
    (r"!\[[^\]]*\]\([^)]*\)", " "),
    (r"(?i)<(?:img|source)\b\s+[A-Za-z_:.-]+=[\"']?\s*(?=[^<>]*<)", " "),
    (r"(?di)<(?:img|source)\b[^<>]*$", " "),
    (r"<[^>]+>", " "),
)
PREVIEW_TEXT = (
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"https?://\S+", " "),
    (r"<([^<>]{1,80})>", "$1"),
    (r"(^|\s)#{1,6}\s*", " "),
    (r"(^|\s)>+\s*", " "),
    (r"(^|\s)[*-]\s+", " "),
    (r"[`*]", ""),
)


def preview(text: Column, closed: bool = False) -> Column:
    """Readable excerpt of Markdown: fences, comments, badges, images (broken ones too), tags and bare links go, link texts stay.

    All references are resolved, or, ``closed``, those that end with a semicolon.
    """
    out = text
    for pattern, to in PREVIEW_MARKUP:
        out = F.regexp_replace(out, pattern, to)
    out = _resolved(out, closed)
    for pattern, to in PREVIEW_TEXT:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(F.regexp_replace(out, f"{_BLANK}+", " "))


def digits_only(text: Column) -> Column:
    return _none(F.regexp_replace(text, "[^0-9]", "")).cast("long")


def loose_number(text: Column) -> Column:
    """A number in text, thousands separators and percent signs aside; null if it is none."""
    return F.regexp_replace(F.trim(text), "[,%]", "").try_cast("double")


def level(value: Column, watch: float | None, potential: float | None, high: float | None) -> Column:
    """The highest threshold that the value reaches."""
    out = F.lit("none")
    for name, least in (("watch", watch), ("potential", potential), ("high_potential", high)):
        if least is not None:
            out = F.when(value >= least, name).otherwise(out)
    return out


def level_rank(name: Column) -> Column:
    return F.when(name == "high_potential", 3).when(name == "potential", 2).when(name == "watch", 1).otherwise(0)


def floored_ratio(recent: Column, recent_days: int, base: Column, base_days: int, least: float) -> Column:
    """Recent rate a day over the baseline's, which counts as ``least`` at least."""
    return (recent / recent_days) / F.greatest(base / base_days, F.lit(float(least)))


def compact_number(value: Column) -> Column:
    """1234 as 1.2k (ties up), whole numbers without a decimal point."""
    k = F.regexp_replace(F.concat(F.format_string("%.1f", F.floor(value / 100 + 0.5) / 10), F.lit("k")), r"\.0k$", "k")
    return F.when(F.abs(value) >= 1000, k).when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parsed_time(text: Column) -> Column:
    """ISO 8601 with Z, an offset or none (then UTC); null if it is no time."""
    return F.try_to_timestamp(F.trim(text))


def feed_time(text: Column) -> Column:
    """RFC 2822 times; the name of the day is cut off."""
    return F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3},? *", ""), F.lit("d MMM yyyy HH:mm:ss Z"))


def stable_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(key), 1, 16))


def redacted(text: Column, most: int = 800) -> Column:
    """Bearer values, sk- keys and values after an API key's name are replaced; the result is cut."""
    out = F.regexp_replace(text, r"(?i)bearer\s+[A-Za-z0-9._-]+", "[redacted]")
    out = F.regexp_replace(out, r"(?i)sk-[A-Za-z0-9._-]+", "[redacted]")
    out = F.regexp_replace(out, r"(?i)(api[_-]?key\s*[:=]\s*)[A-Za-z0-9._-]+", "$1[redacted]")
    return F.substring(out, 1, most)


def clamped(value: Column, least: float, most: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(least))), F.lit(float(most)))


def public_http_url(url: Column) -> Column:
    """http(s), a host, and neither a local name nor a private or reserved IPv4 address."""
    h = host(F.trim(url))
    local = (h == "localhost") | h.endswith(".localhost") | h.endswith(".local")
    private = h.rlike(
        r"^(?:0|10|127|22[4-9]|2[3-5][0-9])\.[0-9]+\.[0-9]+\.[0-9]+$"
    ) | h.rlike(r"^169\.254\.[0-9]+\.[0-9]+$") | h.rlike(r"^192\.168\.[0-9]+\.[0-9]+$") | h.rlike(
        r"^172\.(?:1[6-9]|2[0-9]|3[01])\.[0-9]+\.[0-9]+$"
    )
    return F.trim(url).rlike("^https?://") & (h != "") & ~local & ~private


def bounded_strings(values: Column, items: int, chars: int) -> Column:
    """Trimmed, cut, distinct in order, the first ``items``."""
    cut = F.transform(values, lambda v: F.substring(F.trim(v), 1, chars))
    return F.slice(F.array_distinct(F.filter(cut, lambda v: v != "")), 1, items)


def content_domain(domain: Column) -> Column:
    d = F.regexp_replace(F.regexp_replace(F.lower(F.trim(domain)), r"^www\.", ""), r"^\.+|\.+$", "")
    out = d.isin(*CONTENT_DOMAINS)
    for s in CONTENT_SUFFIXES:
        out = out | d.endswith(s)
    for p in CONTENT_PREFIXES:
        out = out | d.startswith(p)
    return out & (d != "")


def content_path(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_element_at(path_parts(url), F.lit(1))).isin(*CONTENT_PATHS), F.lit(False))


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


#: Labels of evidence, the first case that fits counts: source and family (None: any), metrics (none: any),
#: the text before the value, whether the value is made compact, the text after it.
EVIDENCE_LABELS = (
    (None, "github", ("stars_today", "period_stars", "stargazers_delta"), "GH +", True, " stars / 24h"),
    (None, "hn", ("hn_max_points_7d",), "HN max ", True, " pts / 7d"),
    (None, "hn", ("hn_score", "score"), "HN front page, ", False, " pts"),
    ("x_tweets", None, ("x_tier",), "X ", False, ""),
    ("hn_llm_classifier", None, ("hn_projectness",), "HN classifier: ", False, ""),
    ("resolver", None, (), "Resolved ", False, ""),
)
#: Where evidence comes from, the first case that fits: sources, families, origin.
ORIGINS = (
    (("hn_llm_classifier", "x_tweets"), (), "source_classifier"),
    (("resolver",), ("resolver",), "resolver"),
    (("github_api", "github_stargazers", "github_backfill", "npm_downloads", "npm_registry"), (), "backfill"),
    ((), ("cross_source",), "cross_source_rule"),
)


def _first_case(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    return F.coalesce(*[F.when(fits, value) for fits, value in cases], otherwise)


def evidence_label(source: Column, family: Column, metric: Column, value: Column) -> Column:
    compact, cases = compact_number(value.try_cast("double")), []
    for of_source, of_family, metrics, before, short, after in EVIDENCE_LABELS:
        wanted = [c == v for c, v in ((source, of_source), (family, of_family)) if v] + ([metric.isin(*metrics)] if metrics else [])
        fits = wanted[0]
        for w in wanted[1:]:
            fits = fits & w
        cases.append((fits, F.concat(F.lit(before), compact if short else value, F.lit(after))))
    return _first_case(cases, F.concat(family, F.lit(": "), metric, F.lit(" "), value))


def origin_type(source: Column, family: Column) -> Column:
    cases = [(source.isin(*sources) | family.isin(*families), F.lit(origin)) for sources, families, origin in ORIGINS]
    return _first_case(cases, F.lit("deterministic_rule"))


def provenance_badge(origin: Column) -> Column:
    return F.when(
        origin == "source_classifier", "LLM classifier"
    ).when(origin == "cross_source_rule", "cross-source").when(origin == "deterministic_rule", "rule").otherwise(origin)


def canonical_json(text: Column) -> Column:
    """JSON text with the keys of all its objects in order (by UTF-8 bytes), without blanks, whatever its depth; null if it is no JSON.

    A variant keeps the keys of an object sorted, so reading the text into one and writing it out does it. Numbers are in
    one form: no zeros at the end of a fraction, none after the point of a whole number. Numbers written with an exponent, or of
    more than 38 digits, are doubles and are written as doubles are.
    """
    written = F.to_json(F.try_parse_json(text))
    whole = r'("(?:[^"\\]|\\.)*")|(?<![\d.])(-?\d+)\.0(?![\dE])'  # strings as they are, or a whole number with a point
    return F.regexp_replace(written, whole, "$1$2")


def content_hash(text: Column) -> Column:
    """SHA-256 of canonical JSON: one for all ways to write the same content."""
    return F.sha2(canonical_json(text), 256)


def nested(document: Column, path: str) -> Column:
    """The value at a dotted path of JSON text, as text; null if any step is missing. Names may hold blanks and hyphens."""
    return F.get_json_object(document, "$" + "".join(f"['{step}']" for step in path.split(".")))


def canonical_entity_key(key: Column) -> Column:
    """name: and term: keys by the slug of their label, as it stands if that leaves nothing; other keys as they are, trimmed."""
    value = F.trim(F.coalesce(key, F.lit("")))
    kind = F.lower(F.substring(value, 1, 5))
    named = name_key(F.substring(value, 6, 1 << 30))
    term = F.regexp_replace(named, "^name:", "term:")
    return F.when(kind == "name:", F.coalesce(named, value)).when(kind == "term:", F.coalesce(term, value)).otherwise(value)
