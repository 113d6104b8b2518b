"""Extracted enrichment records: validation, merging with provider facts, projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hirelake.functions.payload import (
    employer_timestamps,
    first_salary,
    parse_payload,
    salary_facts,
    secondary_locations,
    structured_context,
)
from hirelake.functions.scalar import (
    WS,
    collapse,
    employment_type,
    fold,
    instant,
    let,
    lookup,
    nonnegative_int,
    place_label,
    salary_period,
    strip,
    unique_collapsed,
    us_country_code,
    workplace_type,
)
from hirelake.functions.text import compact_descriptions, mentions_citizenship
from hirelake.operators.quality import missing_and_extra
from hirelake.sources.store import last_per_key, upsert

LOCATION = "struct<city: string, state: string, state_code: string, country: string, country_code: string>"
ENTRY = "struct<name: string, requirement: string>"
# Field types of a version-3 record; every key is required and no other is allowed.
RECORD_FIELDS = {
    "standardized_title": "string",
    "job_family": "string",
    "job_subfamily": "string",
    "seniority": "string",
    "skills": f"array<{ENTRY}>",
    "domain_tags": "array<string>",
    "years_experience_min": "int",
    "years_experience_max": "int",
    "education_level": "string",
    "education_fields": "array<string>",
    "certifications": f"array<{ENTRY}>",
    "locations": f"array<{LOCATION}>",
    "workplace_type": "string",
    "employment_type": "string",
    "contract_duration": "string",
    "salary_min": "double",
    "salary_max": "double",
    "salary_currency": "string",
    "salary_period": "string",
    "visa_sponsorship": "string",
    "work_authorization_required": "boolean",
    "citizenship_requirement": "string",
    "security_clearance_required": "boolean",
    "security_clearance_level": "string",
    "offices": "array<string>",
    "confidence": "double",
}
RECORD_SCHEMA = "struct<" + ", ".join(f"{k}: {v}" for k, v in RECORD_FIELDS.items()) + ">"
# Allowed values of the enumerated fields.
ENUMS = {
    "seniority": ("intern", "entry", "mid", "senior", "staff", "principal", "director", "vp", "executive", "unknown"),
    "education_level": (
        "none", "high_school", "associate", "bachelor", "master", "doctorate", "professional", "unknown",
    ),
    "workplace_type": ("remote", "hybrid", "onsite", "flexible", "unknown"),
    "employment_type": (
        "full_time", "part_time", "contract", "temporary", "internship", "seasonal", "unknown",
    ),
    "salary_period": ("hour", "day", "week", "month", "year", "unknown"),
    "visa_sponsorship": ("available", "not_available", "unknown"),
}
# Requirement levels, weakest first.
SKILL_REQUIREMENTS = ("mentioned", "preferred", "required")
CERTIFICATION_REQUIREMENTS = ("preferred", "required")
# Spellings of one skill.
SKILL_ALIASES = {
    "js": "JavaScript",
    "javascript": "JavaScript",
    "nodejs": "Node.js",
    "node.js": "Node.js",
    "postgres": "PostgreSQL",
    "postgresql": "PostgreSQL",
}
LIST_FIELDS = ("domain_tags", "education_fields", "offices")
REQUIRED_LISTS = ("skills", "certifications", "locations", *LIST_FIELDS)
# Required keys of the older version-2 record.
V2_KEYS = (
    "standardized_title", "job_family", "job_subfamily", "related_roles", "role_track", "seniority",
    "leadership_level", "people_management", "role_keywords", "responsibility_tags", "domain_tags",
    "required_skills", "preferred_skills", "programming_languages", "frameworks", "databases", "cloud_platforms",
    "devops_tools", "data_tools", "ml_ai_tools", "analytics_tools", "product_tools", "crm_tools",
    "security_tools", "methodologies", "architecture_patterns", "platform_domains", "soft_skills",
    "years_experience_min", "years_experience_max", "management_experience_required", "management_years_min",
    "industry_experience_required", "education_required", "education_preferred", "education_level",
    "education_fields", "equivalent_experience_allowed", "required_certifications", "preferred_certifications",
    "professional_license_required", "locations", "preferred_locations", "workplace_type", "remote_scope",
    "relocation_available", "employment_type", "schedule_type", "contract_duration", "travel_required",
    "travel_percentage", "on_call_required", "salary_min", "salary_max", "salary_currency", "salary_period",
    "salary_text", "bonus_available", "commission_available", "equity_available", "signing_bonus_available",
    "ote_min", "ote_max", "visa_sponsorship", "work_authorization_required", "citizenship_requirement",
    "security_clearance_required", "security_clearance_level", "export_control_restriction", "departments",
    "teams", "offices", "business_function", "product_area", "required_languages", "preferred_languages",
    "benefits", "confidence",
)


def key_differences(data: Column, schema_version: str = "v3") -> Column:
    """STRUCT(missing, extra) top-level keys of a record against its version's contract."""
    required = tuple(RECORD_FIELDS) if schema_version == "v3" else V2_KEYS
    present = F.coalesce(F.json_object_keys(data), F.array().cast("array<string>"))
    return missing_and_extra(present, F.array(*(F.lit(k) for k in required)))


# --- merging lists inside one record ----------------------------------------


# Stands between the names of a list that are handled as one text; no blank, letter or digit.
_MARK = "\x01"


def _spelled(given: Column, clean, key, respelled: tuple[str, ...]) -> Column:
    """STRUCT(names, keys): the tidy names of a list and what they are compared by.

    The names are tidied and keyed as one text with a mark between them, which
    takes a few calls a list instead of a few a name.  They are handled one by
    one where some name is null or holds the mark, or some key is ``respelled``.
    """
    text = F.trim(F.regexp_replace(F.array_join(given, _MARK, _MARK), f"{WS}+", " "))
    for side in (f" {_MARK}", f"{_MARK} "):
        text = F.replace(text, F.lit(side), F.lit(_MARK))

    def pair(names: Column, keys: Column) -> Column:
        return F.struct(names.alias("names"), keys.alias("keys"))

    def whole(x: Column) -> Column:
        kept = F.size(x["names"]) == F.size(given)
        if respelled:
            kept = kept & ~F.arrays_overlap(x["keys"], F.array(*(F.lit(k) for k in respelled)))
        each = let(F.transform(given, clean), lambda names: pair(names, F.transform(names, lambda n: key(n))))
        return F.when(kept, x).otherwise(each)

    cut = let(text, lambda t: pair(F.split(t, _MARK), F.split(key(t, _MARK), _MARK)))
    return let(cut, whole)


def _merge_entries(entries: Column, clean, key, levels: tuple[str, ...], respelled: tuple[str, ...] = ()) -> Column:
    """One entry per key in first-seen order, the strongest requirement winning.

    Between equally strong entries the earlier one is kept.  Keys are sorted
    with a number that holds strength and place, so a long list costs n log n;
    names are fetched by their places in the end.
    """

    strengths = F.array(*(F.lit(x) for x in levels))

    def place(code: Column) -> Column:
        return code.bitwiseAND(F.lit((1 << 31) - 1))

    def merged(requirements: Column, names: Column, keys: Column) -> Column:
        def row(requirement: Column, i: Column) -> Column:
            strength = F.coalesce(F.array_position(strengths, requirement), F.lit(0).cast("bigint"))
            return F.struct(F.get(keys, i).alias("key"), (i - F.shiftleft(strength, 31)).alias("code"))

        best = let(
            F.sort_array(F.transform(requirements, row)),
            lambda r: F.filter(r, lambda x, i: (i == 0) | ~F.get(r, i - 1)["key"].eqNullSafe(x["key"])),
        )
        seen = F.sort_array(
            F.transform(F.array_distinct(keys), lambda k, i: F.struct(k.alias("key"), i.cast("bigint").alias("turn")))
        )
        # Both lists are in the order of the keys; now in the order of the turns.
        turns = F.sort_array(
            F.zip_with(seen["turn"], best["code"], lambda turn, code: F.shiftleft(turn, 31).bitwiseOR(place(code)))
        )

        def fetched(turn: Column) -> Column:
            at = place(turn).cast("int")
            return F.struct(F.get(names, at).alias("name"), F.get(requirements, at).alias("requirement"))

        return F.transform(turns, fetched)

    def spelled(e: Column) -> Column:
        # The requirements are a variable of a lambda: as a field of the list they would be gathered anew for every use.
        return let(
            e["requirement"],
            lambda r: let(_spelled(e["name"], clean, key, respelled), lambda x: merged(r, x["names"], x["keys"])),
        )

    return let(F.coalesce(entries, F.from_json(F.lit("[]"), f"array<{ENTRY}>")), spelled)


def skill_name(c: Column) -> Column:
    """Proper spelling of a skill."""
    return let(collapse(c), lambda tidy: lookup(F.lower(tidy), SKILL_ALIASES, tidy))


def skill_key(name: Column, kept: str = "") -> Column:
    """Letters and digits (and ``kept``) of the proper spelling, case-folded."""
    return F.regexp_replace(fold(name), rf"[^\p{{L}}\p{{N}}{kept}]+", "")


def merge_skills(entries: Column) -> Column:
    # A name that has another proper spelling has one of these keys.
    respelled = tuple({"".join(filter(str.isalnum, k)): None for k in SKILL_ALIASES})
    return _merge_entries(entries, skill_name, skill_key, SKILL_REQUIREMENTS, respelled)


def merge_certifications(entries: Column) -> Column:
    return _merge_entries(entries, collapse, lambda c, _="": fold(c), CERTIFICATION_REQUIREMENTS)


# --- validation -------------------------------------------------------------

# How the shape of a value is written by schema_of_variant, as patterns.
_ENTRY_SHAPE = "OBJECT<name: STRING, requirement: STRING>"
_PLACE_SHAPE = "OBJECT<" + ", ".join(
    f"{k}: (?:STRING|VOID)" for k in ("city", "country", "country_code", "state", "state_code")
) + ">"
_NUMBER_SHAPE = r"(?:BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))"
_SHAPES = {
    "string": "(?:STRING|VOID)",
    "int": f"(?:{_NUMBER_SHAPE}|VOID)",
    "double": f"(?:{_NUMBER_SHAPE}|VOID)",
    "boolean": "(?:BOOLEAN|VOID)",
    "array<string>": "ARRAY<(?:STRING|VOID)>",
    f"array<{ENTRY}>": f"ARRAY<(?:{_ENTRY_SHAPE}|VOID)>",
    f"array<{LOCATION}>": f"ARRAY<(?:{_PLACE_SHAPE}|VOID)>",
}
# Keys are listed in order, so one pattern describes a whole record.
_RECORD_SHAPE = "^OBJECT<" + ", ".join(f"{k}: {_SHAPES[RECORD_FIELDS[k]]}" for k in sorted(RECORD_FIELDS)) + ">$"
# A key of the contract with another shape, at any depth.
_OFF_SHAPE = "[<,] ?(?:" + "|".join(f"{k}: (?!{_SHAPES[kind]}(?:, |>))" for k, kind in RECORD_FIELDS.items()) + ")"
# Years are read as numbers first: 3.0 is 3, and 3.5 is no number of years.
_YEARS = tuple(k for k, kind in RECORD_FIELDS.items() if kind == "int")
_RAW_SCHEMA = RECORD_SCHEMA.replace(": int", ": double")


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _entry_errors(entries: Column, levels: tuple[str, ...], reserved: tuple[str, ...] = ()) -> Column:
    """True when some entry is null, has a blank or reserved name (of one word), or an unknown requirement."""

    def wrong(e: Column) -> Column:
        name = strip(e["name"])
        bad = F.coalesce(name == "", F.lit(True)) | ~F.coalesce(e["requirement"].isin(*levels), F.lit(False))
        return bad | F.coalesce(F.lower(name).isin(*reserved), F.lit(False)) if reserved else bad

    return F.exists(entries, wrong)


def _shape_rules(shape: Column, data: Column) -> Column:
    """Names of what is wrong with the keys and types of a record."""
    required = F.array(*(F.lit(k) for k in RECORD_FIELDS))
    present = F.coalesce(F.json_object_keys(data), F.array().cast("array<string>"))

    def mistyped(field: str, pattern: str) -> Column:
        return shape.rlike(rf"[<,] ?{field}: ") & ~shape.rlike(rf"[<,] ?{field}: {pattern}(?:, |>)")

    scalars = [mistyped(f, _SHAPES[k]) for f, k in RECORD_FIELDS.items() if not k.startswith("array")]
    lists = [mistyped(f, "ARRAY<.*>") for f in REQUIRED_LISTS]
    items = [mistyped(f, _SHAPES["array<string>"]) & ~mistyped(f, "ARRAY<.*>") for f in LIST_FIELDS]
    entries = {f: _SHAPES[RECORD_FIELDS[f]] for f in ("skills", "certifications", "locations")}
    # One search tells that all keys have their shapes; only where one has not are they looked at one by one.
    off = F.when(
        shape.rlike(_OFF_SHAPE),
        F.array(
            F.when(_any(scalars), "type"),
            F.when(_any(lists), "list"),
            F.when(_any(items), "item_type"),
            *[F.when(mistyped(f, pattern) & ~mistyped(f, "ARRAY<.*>"), f) for f, pattern in entries.items()],
        ),
    )
    rules = F.array(
        F.when(F.size(F.array_except(required, present)) > 0, "missing_keys"),
        F.when(F.size(F.array_except(present, required)) > 0, "extra_keys"),
        F.when(shape.isNull() | ~shape.startswith("OBJECT<"), "not_an_object"),
    )
    return F.array_compact(F.concat(rules, F.coalesce(off, F.array().cast("array<string>"))))


def _value_rules(raw: Column, places: Column) -> list[Column]:
    """Names of the rules that the values of a record break; NULL for the others."""

    def rule(name: str, broken: Column) -> Column:
        return F.when(F.coalesce(broken, F.lit(False)), F.lit(name))

    def out_of(field: str, low: float, high: float | None = None) -> Column:
        value = raw[field]
        return (value < low) | (value > high) if high is not None else value < low

    return [
        *[rule(f"enum_{f}", ~F.coalesce(raw[f].isin(*v), F.lit(False))) for f, v in ENUMS.items()],
        rule("type", _any([raw[f] != F.floor(raw[f]) for f in _YEARS])),
        rule("item_type", _any([F.exists(raw[f], lambda x: x.isNull()) for f in LIST_FIELDS])),
        rule("skills", _entry_errors(raw["skills"], SKILL_REQUIREMENTS, SKILL_REQUIREMENTS)),
        rule("certifications", _entry_errors(raw["certifications"], CERTIFICATION_REQUIREMENTS)),
        rule("locations", F.exists(places, lambda x: x.isNull() | (F.size(x) != 5))),
        rule("years_bounds", _any([out_of(f, 0, 80) for f in _YEARS])),
        rule("salary_bounds", out_of("salary_min", 0) | out_of("salary_max", 0)),
        rule("years_range", raw["years_experience_min"] > raw["years_experience_max"]),
        rule("salary_range", raw["salary_min"] > raw["salary_max"]),
        rule("confidence", F.coalesce(~raw["confidence"].between(0.0, 1.0), F.lit(True))),
    ]


# Order in which the rules a record breaks are listed.
RULES = (
    "not_an_object", "missing_keys", "extra_keys", *(f"enum_{f}" for f in ENUMS), "type", "list", "item_type", "skills",
    "certifications", "locations", "years_bounds", "salary_bounds", "years_range", "salary_range", "confidence",
)


def check_records(extracted: DataFrame, data: str = "data") -> DataFrame:
    """Every row with its typed ``record`` and the ``errors`` it has (none: valid).

    The text is parsed once for its values and once for its shape, each a
    column of its own that the rules refer to.
    """
    kept = [c for c in extracted.columns if c not in ("errors", "record")]
    variant = F.try_parse_json(F.col(data))
    parsed = extracted.select(*kept, F.col(data).alias("_data"), variant.alias("_variant"), F.from_json(data, _RAW_SCHEMA).alias("_raw"))
    parsed = parsed.select(
        *kept,
        "_data",
        "_raw",
        F.schema_of_variant("_variant").alias("_shape"),
        F.try_variant_get("_variant", "$.locations", "array<map<string,string>>").alias("_places"),
    )
    shaped = F.coalesce(F.col("_shape").rlike(_RECORD_SHAPE), F.lit(False))
    values = F.array_compact(F.array(*_value_rules(F.col("_raw"), F.col("_places"))))
    # Most records have the right shape, which one pattern tells.
    shapes = F.when(shaped, F.array().cast("array<string>")).otherwise(
        _shape_rules(F.col("_shape"), F.col("_data"))
    )
    found = parsed.select(*kept, "_raw", shaped.alias("_shaped"), F.array_union(shapes, values).alias("_found"))
    # A shape that no rule names is a wrong type still.
    named = F.when(~F.col("_shaped") & (F.size("_found") == 0), F.array(F.lit("type"))).otherwise(F.col("_found"))
    record = _replace(F.col("_raw"), **{f: F.col(f"_raw.{f}").cast("int") for f in _YEARS})
    listed = F.array_intersect(F.array(*(F.lit(r) for r in RULES)), named)
    return found.select(*kept, record.alias("record"), listed.alias("errors"))


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows with a cleaned ``record``, rejected rows with ``errors``)."""
    kept = [c for c in checked.columns if c not in ("errors", "record")]

    def rows(wanted: Column, column: str) -> DataFrame:
        # A generator of zero or one row, so that no filter moves below the checks and repeats them.
        return checked.select(*kept, F.inline(F.when(wanted, F.array(F.struct(column)))))

    valid = rows(F.size("errors") == 0, "record")
    return valid.withColumn("record", clean_record(F.col("record"))), rows(F.size("errors") > 0, "errors")


def validate_records(extracted: DataFrame, data: str = "data") -> tuple[DataFrame, DataFrame]:
    """``split_checked`` of ``check_records``; settle the latter where both parts are used."""
    return split_checked(check_records(extracted, data))


def _replace(record: Column, **fields: Column) -> Column:
    out = record
    for name, value in fields.items():
        out = out.withField(name, value)
    return out


def clean_record(record: Column) -> Column:
    return _replace(
        record,
        **{f: unique_collapsed(record[f]) for f in LIST_FIELDS},
        skills=merge_skills(record["skills"]),
        certifications=merge_certifications(record["certifications"]),
    )


# --- facts the provider already states --------------------------------------


def deterministic_fields(df: DataFrame) -> DataFrame:
    """Add ``structured_context``, ``salary_json``, ``employer_timestamps`` and ``ats_identifiers``."""
    provider = F.lower(strip(F.coalesce("provider", F.lit(""))))
    staged = df.withColumn("_payload", parse_payload(F.col("raw_payload")))
    payload = F.col("_payload")
    return staged.select(
        *df.columns,
        structured_context(provider, payload).alias("structured_context"),
        first_salary(payload).alias("salary_json"),
        employer_timestamps(payload).alias("employer_timestamps"),
        F.struct(provider.alias("provider"), F.col("external_job_id")).alias("ats_identifiers"),
    )


def _location(city: Column, state: Column, country: Column) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        city.alias("city"),
        state.alias("state"),
        null.alias("state_code"),
        country.alias("country"),
        us_country_code(country).alias("country_code"),
    )


def _no_locations() -> Column:
    return F.from_json(F.lit("[]"), f"array<{LOCATION}>")


def ashby_locations(provider: Column, location: Column, payload: Column) -> Column:
    """Primary and secondary locations of the one provider with postal addresses."""

    def part(address: Column, field: str) -> Column:
        nested = address["postalAddress"]
        return F.when(nested.isNotNull(), nested[field]).otherwise(address[field])

    def located(label: Column, address: Column) -> Column:
        return _location(
            F.coalesce(place_label(label), part(address, "addressLocality")),
            part(address, "addressRegion"),
            part(address, "addressCountry"),
        )

    found = F.concat(
        F.array(located(location, payload["address"])),
        F.transform(secondary_locations(payload), lambda s: located(s["location"], s["address"])),
    )

    def given(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) != ""

    kept = F.filter(found, lambda x: given(x["city"]) | given(x["state"]) | given(x["country"]))
    return F.when(provider == "ashby", kept).otherwise(_no_locations())


def locations_match(a: Column, b: Column) -> Column:
    """Compatible unless both give a different city, state or country."""

    def value(x: Column, field: str) -> Column:
        return F.lower(strip(F.coalesce(x[field], F.lit(""))))

    pairs = [(value(a, f), value(b, f)) for f in ("city", "state", "country")]
    conflict = reduce(lambda p, q: p | q, ((x != "") & (y != "") & (x != y) for x, y in pairs))
    anything = reduce(lambda p, q: p | q, ((x != "") | (y != "") for x, y in pairs))
    return ~conflict & anything


def merge_locations(kept: Column, candidates: Column) -> Column:
    """Append candidates one by one unless they match one already kept."""
    start = F.coalesce(kept, _no_locations())

    def step(acc: Column, x: Column) -> Column:
        known = F.exists(acc, lambda y: locations_match(y, x))
        return F.when(known, acc).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.coalesce(candidates, _no_locations()), start, step)


def trusted_locations(provider: Column, location: Column, payload: Column, context: Column) -> Column:
    null = F.lit(None).cast("string")
    labels = F.filter(F.transform(context["locations"], place_label), lambda x: x.isNotNull())
    cities = F.transform(labels, lambda x: _location(x, null, null))
    return merge_locations(ashby_locations(provider, location, payload), cities)


def merge_trusted_facts(df: DataFrame) -> DataFrame:
    """Let provider facts override or extend the extracted ``record``.

    Input: valid records joined to their job (provider, location,
    employment_type, workplace_type, raw_payload, description_text).
    """
    provider = F.lower(strip(F.coalesce("provider", F.lit(""))))
    # Intermediate columns, so that each list is computed once per record.
    staged = df.withColumn("_payload", parse_payload(F.col("raw_payload")))
    staged = staged.withColumn("_context", structured_context(provider, F.col("_payload"))).withColumn(
        "_salary", salary_facts(first_salary(F.col("_payload")), salary_period)
    )
    staged = staged.withColumn(
        "_places", trusted_locations(provider, F.col("location"), F.col("_payload"), F.col("_context"))
    )
    record, salary = F.col("record"), F.col("_salary")
    merged = _replace(
        record,
        employment_type=F.coalesce(employment_type("employment_type"), record["employment_type"]),
        workplace_type=F.coalesce(workplace_type("workplace_type"), record["workplace_type"]),
        locations=merge_locations(record["locations"], F.col("_places")),
        offices=unique_collapsed(F.concat(record["offices"], F.col("_context.offices"))),
        **{f: F.coalesce(salary[f], record[f]) for f in ("salary_min", "salary_max", "salary_currency", "salary_period")},
        citizenship_requirement=F.when(mentions_citizenship("description_text"), record["citizenship_requirement"]),
    )
    return staged.withColumn("record", merged).select(*df.columns)


# --- projection to table columns --------------------------------------------


def _first_location(locations: Column) -> dict[str, Column]:
    first = F.get(locations, F.lit(0))
    return {f: first[f] for f in ("city", "state", "state_code", "country", "country_code")}


def project_v3(record: Column) -> dict[str, Column]:
    """Table columns of a version-3 record; dimensions it no longer has are empty."""
    none = F.array().cast("array<string>")
    null = F.lit(None).cast("string")

    def skills(requirement: str | None = None) -> Column:
        entries = record["skills"]
        if requirement:
            entries = F.filter(entries, lambda s: s["requirement"] == requirement)
        return F.transform(entries, lambda s: s["name"])

    same = (
        "standardized_title", "job_family", "job_subfamily", "seniority", "years_experience_min",
        "years_experience_max", "education_level", "education_fields", "locations", "workplace_type",
        "employment_type", "salary_min", "salary_max", "salary_currency", "salary_period", "visa_sponsorship",
        "work_authorization_required", "citizenship_requirement", "security_clearance_required",
        "security_clearance_level", "domain_tags", "confidence",
    )
    return {
        **{f: record[f] for f in same},
        **{f: null for f in ("role_track", "leadership_level", "education_required", "education_preferred")},
        **{f: none for f in ("related_roles", "role_keywords", "responsibility_tags", "soft_skills")},
        "preferred_locations": _no_locations(),
        "relocation_available": F.lit(None).cast("boolean"),
        "skills": skills(),
        "required_skills": skills("required"),
        "preferred_skills": skills("preferred"),
        "skill_count": F.size(record["skills"]),
        "certifications": F.transform(record["certifications"], lambda c: c["name"]),
        **_first_location(record["locations"]),
    }


def project_v2(record: Column) -> dict[str, Column]:
    """The combined lists of a version-2 record; its other columns keep their names."""
    skills = unique_collapsed(F.concat(record["required_skills"], record["preferred_skills"], record["soft_skills"]))
    return {
        "skills": skills,
        "skill_count": F.size(skills),
        "certifications": unique_collapsed(
            F.concat(record["required_certifications"], record["preferred_certifications"])
        ),
        **_first_location(record["locations"]),
    }


def project_legacy(record: Column) -> dict[str, Column]:
    """Columns kept on the jobs table for older readers."""
    remote = record["workplace_type"] == "remote"
    return {
        "job_family": record["job_family"],
        "job_subfamily": record["job_subfamily"],
        "related_roles": F.array().cast("array<string>"),
        "skills": F.transform(record["skills"], lambda s: s["name"]),
        "seniority": record["seniority"],
        "years_experience_min": record["years_experience_min"],
        "years_experience_max": record["years_experience_max"],
        "ai_locations": F.transform(
            record["locations"],
            lambda x: F.struct(
                *[x[f].alias(f) for f in ("city", "state", "state_code", "country", "country_code")],
                remote.alias("remote"),
            ),
        ),
        "classification_confidence": record["confidence"],
    }


# Types of the legacy columns of the jobs table.
LEGACY_SCHEMA = {
    "job_family": "string", "job_subfamily": "string", "related_roles": "array<string>", "skills": "array<string>",
    "seniority": "string", "years_experience_min": "int", "years_experience_max": "int",
    "ai_locations": f"array<{LOCATION[:-1]}, remote: boolean>>", "classification_confidence": "double",
}


def apply_legacy(jobs: DataFrame, valid: DataFrame) -> DataFrame:
    """Jobs with the legacy columns of the record of their current content;
    columns the jobs lack are added, other jobs keep theirs."""
    projected = project_legacy(F.col("record"))
    records = valid.select(
        "job_id", "content_hash", *[v.cast(LEGACY_SCHEMA[c]).alias(f"_{c}") for c, v in projected.items()], F.lit(True).alias("_done")
    ).dropDuplicates(["job_id", "content_hash"])
    columns = [*jobs.columns, *(c for c in projected if c not in jobs.columns)]
    joined = jobs.join(records, ["job_id", "content_hash"], "left")

    def value(c: str) -> Column:
        old = F.col(c) if c in jobs.columns else F.lit(None).cast(LEGACY_SCHEMA[c])
        return (F.when(F.col("_done"), F.col(f"_{c}")).otherwise(old) if c in projected else old).alias(c)

    return joined.select(*[value(c) for c in columns])


def enrichment_rows(valid: DataFrame, as_of) -> DataFrame:
    """Rows of the enrichment table for valid records (job_id, content_hash, schema_version, record)."""
    kept = [c for c in ("model", "input_tokens", "output_tokens", "thought_tokens", "cached_tokens", "total_tokens") if c in valid.columns]
    identity = F.concat_ws("\x1f", F.col("job_id").cast("string"), "content_hash", "schema_version")
    return valid.select(
        F.left(F.sha2(identity, 256), F.lit(32)).alias("enrichment_id"),
        "job_id",
        "content_hash",
        "schema_version",
        instant(as_of).alias("created_at"),
        F.to_json("record").alias("data"),
        *[(nonnegative_int(c) if c.endswith("_tokens") else F.col(c)).alias(c) for c in kept],
        *[v.alias(c) for c, v in project_v3(F.col("record")).items()],
    )


def upsert_enrichments(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """Newest record per job, content and schema wins."""
    keys = ["job_id", "content_hash", "schema_version"]
    newest = last_per_key(rows, keys, [F.col("created_at"), F.col("enrichment_id")])
    return upsert(existing, newest, keys)


def current_results(results: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results for the job's current content, stale results)."""
    current = jobs.select("job_id", "content_hash")
    keys = ["job_id", "content_hash"]
    return results.join(current, keys, "left_semi"), results.join(current, keys, "left_anti")


# --- promotion of stored JSON -----------------------------------------------


def json_text(data: Column, *path: str) -> Column:
    """First non-empty text of the paths."""
    return F.coalesce(*(F.nullif(F.get_json_object(data, p), F.lit("")) for p in path))


def json_number(data: Column, path: str, kind: str) -> Column:
    """Unsigned number written in digits, else NULL."""
    pattern = r"^\d+$" if kind == "int" else r"^\d+(\.\d+)?$"
    text = F.get_json_object(data, path)
    return F.when(text.rlike(pattern), text.try_cast(kind))


def json_boolean(data: Column, path: str) -> Column:
    text = F.lower(F.get_json_object(data, path))
    return F.when(text.isin("true", "false"), text == "true")


def json_list(data: Column, *paths: str) -> Column:
    """Concatenated string lists of the paths; a missing one counts as empty."""
    empty = F.array().cast("array<string>")
    return F.concat(*(F.coalesce(F.from_json(F.get_json_object(data, p), "array<string>"), empty) for p in paths))


# Keys of stored records that have a column.
PROMOTED_TEXT = (
    "standardized_title", "job_family", "job_subfamily", "role_track", "seniority", "leadership_level",
    "education_required", "education_preferred", "education_level", "workplace_type", "employment_type",
    "salary_currency", "salary_period", "visa_sponsorship", "citizenship_requirement", "security_clearance_level",
)
PROMOTED_LISTS = (
    "related_roles", "role_keywords", "responsibility_tags", "required_skills", "preferred_skills", "soft_skills",
    "education_fields",
)
PROMOTED_FLAGS = ("relocation_available", "work_authorization_required", "security_clearance_required")


def promote_json(data: Column) -> dict[str, Column]:
    """Typed columns of a stored JSON record."""
    first = "$.locations[0]"
    skills = json_list(data, "$.required_skills", "$.preferred_skills", "$.soft_skills")
    return {
        **{f: json_text(data, f"$.{f}") for f in PROMOTED_TEXT},
        **{f: json_list(data, f"$.{f}") for f in PROMOTED_LISTS},
        **{f: json_boolean(data, f"$.{f}") for f in PROMOTED_FLAGS},
        "skills": skills,
        "skill_count": F.size(skills),
        "certifications": json_list(data, "$.required_certifications", "$.preferred_certifications"),
        "years_experience_min": json_number(data, "$.years_experience_min", "int"),
        "years_experience_max": json_number(data, "$.years_experience_max", "int"),
        "salary_min": json_number(data, "$.salary_min", "decimal(38,10)"),
        "salary_max": json_number(data, "$.salary_max", "decimal(38,10)"),
        "city": json_text(data, f"{first}.city"),
        "state": json_text(data, f"{first}.state", f"{first}.region"),
        "state_code": json_text(data, f"{first}.state_code"),
        "country": json_text(data, f"{first}.country"),
        "country_code": json_text(data, f"{first}.country_code"),
    }


def backfill_columns(enrichments: DataFrame, data: str = "data") -> DataFrame:
    """Fill NULL (or empty-list) columns from the stored JSON; set values stay."""
    out = {}
    for name, value in promote_json(F.col(data)).items():
        if name not in enrichments.columns or name == "skill_count":
            continue
        kind = enrichments.schema[name].dataType
        stored = F.col(name)
        if kind.typeName() == "array":
            out[name] = F.when(F.coalesce(F.size(stored) > 0, F.lit(False)), stored).otherwise(value.cast(kind))
        else:
            out[name] = F.coalesce(stored, value.cast(kind))
    filled = enrichments.select(*[out.get(c, F.col(c)).alias(c) for c in enrichments.columns])
    return filled.withColumn("skill_count", F.size("skills"))


def classifier_payload(df: DataFrame) -> DataFrame:
    """What an extraction model is given: title, company and compacted description."""
    kept = [c for c in ("job_id", "content_hash") if c in df.columns]
    rows = df.select(*kept, F.col("title").alias("original_title"), "company", "description_text")
    return compact_descriptions(rows, "description_text", "description").drop("description_text")
