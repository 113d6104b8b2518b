"""Fields of a raw provider payload, read from its JSON text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hirelake.functions.scalar import comma_label, strings, unique_trimmed

_POSTAL = "addressLocality: string, addressRegion: string, addressCountry: string"
_ADDRESS = f"struct<postalAddress: struct<{_POSTAL}>, {_POSTAL}>"
# One schema for all providers; values whose shape differs stay JSON text.
PAYLOAD_SCHEMA = (
    f"struct<location: string, address: {_ADDRESS}, "
    f"secondaryLocations: array<struct<location: string, address: {_ADDRESS}>>, "
    "departments: array<struct<name: string>>, offices: array<struct<name: string, location: string>>, "
    "categories: struct<location: string, department: string, team: string, allLocations: array<string>>, "
    "department: string, team: string, "
    "compensation: string, salaryRange: string, salary_range: string, payRange: string, "
    "createdAt: string, updatedAt: string, publishedAt: string, published_at: string>"
)
# Payload keys in order of preference.
SALARY_KEYS = ("compensation", "salaryRange", "salary_range", "payRange")
TIMESTAMP_KEYS = ("createdAt", "updatedAt", "publishedAt", "published_at")
SALARY_MIN_KEYS = ("min", "minimum", "minValue", "minAmount", "lowerBound")
SALARY_MAX_KEYS = ("max", "maximum", "maxValue", "maxAmount", "upperBound")
CURRENCY_KEYS = ("currency", "currencyCode", "currency_code")
PERIOD_KEYS = ("period", "interval", "unit", "timeUnit")


def parse_payload(raw_json: Column) -> Column:
    return F.from_json(raw_json, PAYLOAD_SCHEMA)


def secondary_locations(payload: Column) -> Column:
    found = F.filter(payload["secondaryLocations"], lambda s: s.isNotNull())
    return F.coalesce(found, F.from_json(F.lit("[]"), f"array<struct<location: string, address: {_ADDRESS}>>"))


def _postal(address: Column, field: str) -> Column:
    nested = address["postalAddress"]
    return F.when(nested.isNotNull(), nested[field]).otherwise(address[field])


def address_country(address: Column) -> Column:
    return _postal(address, "addressCountry")


def address_label(address: Column) -> Column:
    """'locality, region, country' of a postal address."""
    return comma_label(*(_postal(address, f) for f in ("addressLocality", "addressRegion", "addressCountry")))


def _given(items: Column) -> Column:
    return F.filter(strings(items), lambda x: x.isNotNull() & (x != ""))


def _greenhouse_places(payload: Column, with_office_names: bool) -> Column:
    offices = payload["offices"]
    name = F.array(F.get_json_object(payload["location"], "$.name"))
    if with_office_names:
        rest = F.flatten(F.transform(offices, lambda o: F.array(o["name"], o["location"])))
    else:
        rest = F.transform(offices, lambda o: o["location"])
    return F.concat(name, strings(rest))


def _lever_places(payload: Column) -> Column:
    categories = payload["categories"]
    return F.concat(F.array(categories["location"]), strings(categories["allLocations"]))


def location_strings(provider: Column, payload: Column) -> Column:
    """Every location text a payload gives, in payload order (used for scope evidence)."""
    ashby = F.concat(F.array(payload["location"]), F.transform(secondary_locations(payload), lambda s: s["location"]))
    return (
        F.when(provider == "greenhouse", _given(_greenhouse_places(payload, True)))
        .when(provider == "ashby", _given(ashby))
        .when(provider == "lever", _given(_lever_places(payload)))
        .otherwise(F.array().cast("array<string>"))
    )


def structured_context(provider: Column, payload: Column) -> Column:
    """STRUCT(departments, teams, locations, offices) of unique trimmed strings."""
    none = F.array().cast("array<string>")
    categories = payload["categories"]
    ashby_places = F.concat(
        F.array(payload["location"], address_label(payload["address"])),
        F.flatten(
            F.transform(secondary_locations(payload), lambda s: F.array(s["location"], address_label(s["address"])))
        ),
    )

    def context(departments: Column, teams: Column, locations: Column, offices: Column) -> Column:
        return F.struct(
            unique_trimmed(departments).alias("departments"),
            unique_trimmed(teams).alias("teams"),
            unique_trimmed(locations).alias("locations"),
            unique_trimmed(offices).alias("offices"),
        )

    return (
        F.when(
            provider == "greenhouse",
            context(
                F.transform(payload["departments"], lambda d: d["name"]),
                none,
                _greenhouse_places(payload, False),
                F.transform(payload["offices"], lambda o: o["name"]),
            ),
        )
        .when(
            provider == "ashby", context(F.array(payload["department"]), F.array(payload["team"]), ashby_places, none)
        )
        .when(
            provider == "lever",
            context(F.array(categories["department"]), F.array(categories["team"]), _lever_places(payload), none),
        )
        .otherwise(context(none, none, none, none))
    )


def first_salary(payload: Column) -> Column:
    """JSON text of the first salary object a payload gives."""
    return F.coalesce(*(payload[k] for k in SALARY_KEYS))


def employer_timestamps(payload: Column) -> Column:
    pairs = F.map_from_arrays(
        F.array(*(F.lit(k) for k in TIMESTAMP_KEYS)), F.array(*(payload[k] for k in TIMESTAMP_KEYS))
    )
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def _first_text(salary: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.get_json_object(salary, f"$.{k}") for k in keys))


def _first_number(salary: Column, keys: tuple[str, ...]) -> Column:
    """Value of the first key present, only if it is a JSON number."""
    numbers = F.from_json(salary, "struct<" + ", ".join(f"{k}: double" for k in keys) + ">")
    out = None
    for k in keys:
        present = F.get_json_object(salary, f"$.{k}").isNotNull()
        out = F.when(present, numbers[k]) if out is None else out.when(present, numbers[k])
    return out


def salary_facts(salary: Column, period) -> Column:
    """STRUCT(salary_min, salary_max, salary_currency, salary_period) of a salary object."""
    return F.struct(
        _first_number(salary, SALARY_MIN_KEYS).alias("salary_min"),
        _first_number(salary, SALARY_MAX_KEYS).alias("salary_max"),
        F.upper(F.nullif(_first_text(salary, CURRENCY_KEYS), F.lit(""))).alias("salary_currency"),
        period(_first_text(salary, PERIOD_KEYS)).alias("salary_period"),
    )


def content_hash(
    title: Column,
    company: Column,
    location: Column,
    employment_type: Column,
    workplace_type: Column,
    description: Column,
    context: Column,
) -> Column:
    """SHA-256 of the posting's seven content fields as JSON in key order."""
    content = F.struct(
        company.alias("company"),
        description.alias("description"),
        employment_type.alias("employment_type"),
        location.alias("location"),
        context.alias("structured_context"),
        title.alias("title"),
        workplace_type.alias("workplace_type"),
    )
    return F.sha2(F.to_json(content, {"ignoreNullFields": "false"}), 256)
