"""Column-to-column functions: names, URLs, dates, small normalisers."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, functions as F

# Whitespace as a Unicode-aware text trim sees it: the characters, and a pattern
# whose first test rules out visible ASCII.
WS_CHARS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WS = r"[[^\x21-\x84]&&[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"

# Applicant-tracking providers.
SUPPORTED_PROVIDERS = ("greenhouse", "ashby", "lever")
PROVIDER_ALIASES = {
    "ashbyhq": "ashby",
    "breezy hr": "breezy",
    "hrm direct": "hrm_direct",
    "oracle cloud hcm": "oracle_hcm",
    "zoho recruit": "zoho",
}

# Spellings of employment type, workplace type and salary period.
EMPLOYMENT_TYPES = {
    "fulltime": "full_time",
    "parttime": "part_time",
    "contract": "contract",
    "contractor": "contract",
    "temporary": "temporary",
    "temp": "temporary",
    "intern": "internship",
    "internship": "internship",
    "seasonal": "seasonal",
}
WORKPLACE_TYPES = {
    "remote": "remote",
    "hybrid": "hybrid",
    "onsite": "onsite",
    "onlocation": "onsite",
    "inoffice": "onsite",
    "office": "onsite",
    "flexible": "flexible",
}
SALARY_PERIODS = {
    "hour": "hour",
    "hourly": "hour",
    "day": "day",
    "daily": "day",
    "week": "week",
    "weekly": "week",
    "month": "month",
    "monthly": "month",
    "year": "year",
    "yearly": "year",
    "annual": "year",
    "annually": "year",
}
US_COUNTRY_SPELLINGS = ("united states", "united states of america", "usa", "us", "u.s.")
PLACELESS_LABELS = ("remote", "hybrid", "onsite", "on-site", "anywhere")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def instant(value: Column | datetime | str) -> Column:
    """An ``as_of`` instant as a foldable literal; naive values are UTC."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    return F.expr(f"TIMESTAMP '{value.astimezone(timezone.utc).strftime('%Y-%m-%d %H:%M:%S.%f')}+00:00'")


def day(value: Column | date | str) -> Column:
    return value if isinstance(value, Column) else F.to_date(F.lit(str(value)))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Exact elapsed seconds as DECIMAL, so later rounding is half-up."""
    micros = F.unix_micros(later) - F.unix_micros(earlier)
    return (micros.cast("decimal(20,0)") / F.lit(1000000).cast("decimal(7,0)")).cast("decimal(26,6)")


# --- text -------------------------------------------------------------------


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WS_CHARS))


def collapse(c: Column | str) -> Column:
    return strip(F.regexp_replace(col(c), f"{WS}+", " "))


def text_or_null(c: Column | str) -> Column:
    return F.nullif(strip(col(c).cast("string")), F.lit(""))


def fold(c: Column | str) -> Column:
    """Case-insensitive comparison key; upper first so that 'ß' equals 'ss'."""
    return F.lower(F.upper(col(c)))


def lookup(key: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """A small literal table; the key is computed once."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)
    return found if default is None else F.coalesce(found, default)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also when ``use`` has lambdas over it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strings(c: Column) -> Column:
    """NULL-safe list of strings."""
    return F.coalesce(c, F.array().cast("array<string>"))


def nonblank_items(c: Column) -> Column:
    """Keep list items that are not blank, unchanged."""
    return F.filter(strings(c), lambda x: F.length(strip(x)) > 0)


def unique_trimmed(c: Column) -> Column:
    """Distinct non-blank items in first-seen order, trimmed."""
    return F.array_distinct(F.filter(F.transform(strings(c), strip), lambda x: x != ""))


def unique_collapsed(c: Column) -> Column:
    """Distinct non-blank items in first-seen order, inner whitespace collapsed."""
    return F.array_distinct(F.filter(F.transform(strings(c), collapse), lambda x: x != ""))


# --- providers, URLs, slugs -------------------------------------------------


def provider(c: Column | str) -> Column:
    key = F.lower(strip(F.coalesce(col(c).cast("string"), F.lit(""))))
    return lookup(key, PROVIDER_ALIASES, key)


def provider_stored(c: Column | str) -> Column:
    """The narrower spelling repair used on rows already in the inventory."""
    key = F.lower(F.trim(col(c)))
    return F.when(key == "ashbyhq", F.lit("ashby")).otherwise(key)


def is_supported(c: Column | str) -> Column:
    return F.coalesce(col(c).isin(*SUPPORTED_PROVIDERS), F.lit(False))


def web_url(c: Column | str) -> Column:
    """Trimmed http(s) URL with a host, else NULL."""
    url = text_or_null(c)
    return F.when(url.rlike(r"(?i)^https?://[^/?#]"), url)


def board_slug(url: Column | str) -> Column:
    """First path segment of a URL; NULL when there is none."""
    path = F.regexp_extract(col(url), r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(path, r";[^/]*$", "")
    return F.nullif(F.regexp_extract(path, r"^/*([^/]+)", 1), F.lit(""))


def stored_slug(slug: Column | str, board: Column | str, url: Column | str) -> Column:
    """Slug of a stored row: own slug, else board id, else first URL segment."""
    blank = F.lit("")
    return F.coalesce(
        F.nullif(F.trim(col(slug)), blank),
        F.nullif(F.trim(col(board)), blank),
        F.nullif(F.regexp_extract(col(url), r"^https?://[^/]+/([^/?#]+)", 1), blank),
    )


def inventory_slug(provider_col: Column, url: Column) -> Column:
    """Board slug for supported providers, else a stable hash of the URL."""
    board = F.when(is_supported(provider_col), board_slug(url))
    return F.coalesce(board, F.concat(F.lit("url_"), F.sha2(url, 256)))


def decode_percent(c: Column | str) -> Column:
    """Percent-decoding that leaves malformed text as it is."""
    text = col(c)
    decoded = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    broken = F.contains(decoded, F.lit("\ufffd")) & ~F.contains(F.upper(text), F.lit("%EF%BF%BD"))
    return F.when(decoded.isNull() | broken, text).otherwise(decoded)


# --- normalisers ------------------------------------------------------------


def _squeezed(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(strip(col(c))), "[-_ ]", "")


def employment_type(c: Column | str) -> Column:
    return lookup(_squeezed(c), EMPLOYMENT_TYPES)


def workplace_type(c: Column | str) -> Column:
    return lookup(_squeezed(c), WORKPLACE_TYPES)


def salary_period(c: Column | str) -> Column:
    return lookup(F.replace(F.lower(strip(col(c))), F.lit("_"), F.lit("")), SALARY_PERIODS)


def us_country_code(c: Column | str) -> Column:
    return F.when(F.lower(strip(col(c))).isin(*US_COUNTRY_SPELLINGS), F.lit("US"))


def place_label(c: Column | str) -> Column:
    """A location label unless it only says how, not where, one works."""
    label = collapse(c)
    return F.when((label != "") & ~F.lower(label).isin(*PLACELESS_LABELS), label)


def comma_label(*parts: Column, trimmed: bool = True) -> Column:
    """Non-empty parts joined by ', '; NULL when all are empty."""
    given = F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(given) > 0, F.array_join(F.transform(given, strip) if trimmed else given, ", "))


def nonnegative_int(c: Column | str) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.coalesce(col(c).try_cast("bigint"), F.lit(0).cast("bigint")))


# --- ages, changes, delays --------------------------------------------------


def freshness_hours(seen: Column, as_of: Column) -> Column:
    hours = seconds_between(as_of, seen) / F.lit(3600).cast("decimal(4,0)")
    return F.round(F.greatest(F.lit(0).cast("decimal(32,12)"), hours.cast("decimal(32,12)")), 2)


def days_active(first_seen: Column, removed: Column, as_of: Column) -> Column:
    days = F.floor(seconds_between(F.coalesce(removed, as_of), first_seen) / F.lit(86400).cast("decimal(5,0)"))
    return F.greatest(F.lit(0), days.cast("int"))


def age_bucket(seen: Column, as_of: Column) -> Column:
    age = F.unix_micros(as_of) - F.unix_micros(seen)
    one_day = 86400 * 1000000
    return (
        F.when(age < one_day, "under_24h")
        .when(age < 4 * one_day, "1_3_days")
        .when(age < 8 * one_day, "4_7_days")
        .when(age < 31 * one_day, "8_30_days")
        .otherwise("30_plus_days")
    )


def freshness_source(posted_at: Column, posted_at_source: Column) -> Column:
    return F.when(posted_at.isNotNull(), F.coalesce(posted_at_source, F.lit("posted_at"))).otherwise("first_seen_at")


def hours_old(c: Column, as_of: Column) -> Column:
    hours = (F.unix_micros(as_of) - F.unix_micros(c)) / F.lit(3600000000.0)
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), hours)).otherwise(F.lit(float("inf")))


def on_day(c: Column, the_day: Column) -> Column:
    return F.to_date(c) == the_day


def change_between(current: Column, previous: Column) -> Column:
    """STRUCT(absolute, percent): NULL without a previous value, percent NULL at zero."""
    delta = current - previous
    percent = F.when(
        previous != 0,
        F.round(delta.cast("decimal(20,0)") * 100 / previous.cast("decimal(20,0)"), 2).cast("double"),
    )
    return F.when(previous.isNotNull(), F.struct(delta.alias("absolute"), percent.alias("percent")))


def retry_delay_seconds(attempts: Column, retry_after: Column | None = None) -> Column:
    """Exponential back-off from 30 s, at least what the server asked, at most an hour."""
    # 2^7 * 30 already exceeds the cap, so the exponent never needs to be larger.
    exponent = F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(7))
    wait = F.lit(30.0) * F.pow(F.lit(2.0), exponent)
    asked = F.lit(0.0) if retry_after is None else F.coalesce(retry_after.cast("double"), F.lit(0.0))
    return F.least(F.lit(3600.0), F.greatest(wait, asked))
