"""Provider payloads: validation, quarantine and normalisation into postings.

Input is one row per fetched board: ``source_id, crawl_run_id, provider,
board, body`` where ``body`` is the JSON text of the response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hirelake.functions.payload import content_hash, parse_payload, structured_context
from hirelake.functions.scalar import let
from hirelake.functions.unicode import decode_html

POSTING_COLUMNS = (
    "source_id", "crawl_run_id", "pos", "external_job_id", "provider", "company", "title", "location",
    "employment_type", "workplace_type", "posted_at", "posted_at_source", "description_text", "description_html",
    "job_url", "apply_url", "raw_payload",
)


def read_boards(spark: SparkSession, path: str, provider: str) -> DataFrame:
    """One response per file; the file name (without extension) is the board."""
    return spark.read.option("wholetext", True).text(path).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("board"),
        F.lit(provider).alias("provider"),
        F.col("value").alias("body"),
    )


def of_sources(boards: DataFrame, sources: DataFrame, crawl_run_id: int) -> DataFrame:
    """Responses of known boards with their source and the crawl they belong to."""
    known = sources.select("source_id", "provider", F.col("board_id").alias("board"))
    return boards.join(known, ["provider", "board"]).select(
        "source_id", F.lit(crawl_run_id).cast("bigint").alias("crawl_run_id"), "provider", "board", "body"
    )


def posting_list(provider: Column, body: Column) -> Column:
    """JSON text of the postings array of a response, NULL when it has none."""
    listed = F.when(provider == "lever", body).otherwise(F.get_json_object(body, "$.jobs"))
    return let(listed, lambda x: F.when(F.json_array_length(x).isNotNull(), x))


def split_boards(boards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(well-formed boards with ``postings``, quarantined boards with ``error``)."""
    staged = boards.withColumn("postings", posting_list(F.col("provider"), F.col("body")))
    error = F.when(
        F.col("provider") == "lever", F.lit("response must be a list")
    ).otherwise(F.lit("response must be an object with a list of jobs"))
    good = staged.filter(F.col("postings").isNotNull())
    bad = staged.filter(F.col("postings").isNull()).drop("postings").withColumn("error", error)
    return good, bad


def raw_postings(boards: DataFrame) -> DataFrame:
    """One row per posting with its JSON text and position in the response."""
    items = F.from_json(F.col("postings"), "array<string>")
    return boards.drop("body").select(
        *[c for c in boards.columns if c not in ("body", "postings")], F.posexplode(items).alias("pos", "raw_payload")
    )


_GREENHOUSE = "struct<id: string, title: string, company_name: string, location: struct<name: string>, first_published: string, content: string, absolute_url: string>"
_ASHBY = "struct<id: string, title: string, location: string, employmentType: string, workplaceType: string, publishedAt: string, descriptionHtml: string, descriptionPlain: string, jobUrl: string, applyUrl: string>"
_LEVER = "struct<id: string, text: string, categories: struct<location: string, commitment: string>, workplaceType: string, description: string, descriptionPlain: string, hostedUrl: string, applyUrl: string>"


def _greenhouse(p: Column, html: Column) -> dict[str, Column]:
    return {
        "external_job_id": p["id"],
        "company": p["company_name"],
        "title": p["title"],
        "location": p["location"]["name"],
        "posted_at": p["first_published"],
        "posted_at_source": F.when(p.isNotNull(), "greenhouse.first_published"),
        "description_text": html["text"],
        "description_html": html["decoded"],
        "job_url": p["absolute_url"],
    }


def _ashby(p: Column, board: Column) -> dict[str, Column]:
    return {
        "external_job_id": p["id"],
        "company": F.when(p.isNotNull(), board),
        "title": p["title"],
        "location": p["location"],
        "employment_type": p["employmentType"],
        "workplace_type": p["workplaceType"],
        "posted_at": p["publishedAt"],
        "posted_at_source": F.when(p.isNotNull(), "ashby.publishedAt"),
        "description_text": p["descriptionPlain"],
        "description_html": p["descriptionHtml"],
        "job_url": p["jobUrl"],
        "apply_url": p["applyUrl"],
    }


def _lever(p: Column, board: Column) -> dict[str, Column]:
    """This provider gives no posting date."""
    return {
        "external_job_id": p["id"],
        "company": F.when(p.isNotNull(), board),
        "title": p["text"],
        "location": p["categories"]["location"],
        "employment_type": p["categories"]["commitment"],
        "workplace_type": p["workplaceType"],
        "description_text": p["descriptionPlain"],
        "description_html": p["description"],
        "job_url": p["hostedUrl"],
        "apply_url": p["applyUrl"],
    }


_SCHEMAS = {"greenhouse": _GREENHOUSE, "ashby": _ASHBY, "lever": _LEVER}


def normalize_postings(postings: DataFrame, hashed: bool = True) -> DataFrame:
    """Postings of all providers in one shape, with their content hash.

    One pass over the input: each row is parsed with its own provider's schema,
    the other two stay NULL, and every column takes the value that is given.
    """
    staged = postings
    for name, schema in _SCHEMAS.items():
        parsed = F.when(F.col("provider") == name, F.from_json("raw_payload", schema))
        staged = staged.withColumn(f"_{name}", parsed)
    staged = staged.withColumn("_html", decode_html(F.col("_greenhouse.content")))
    board = F.col("board")
    shapes = (
        _greenhouse(F.col("_greenhouse"), F.col("_html")),
        _ashby(F.col("_ashby"), board),
        _lever(F.col("_lever"), board),
    )

    def value(name: str) -> Column:
        if not any(name in shape for shape in shapes):
            return F.col(name)
        given = F.coalesce(*[shape[name] for shape in shapes if name in shape])
        return (given.try_cast("timestamp") if name == "posted_at" else given).alias(name)

    known = staged.filter(F.col("provider").isin(*_SCHEMAS))
    out = known.select(*[value(c) for c in POSTING_COLUMNS])
    return with_content_hash(out) if hashed else out


def split_postings(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(normalised postings of the sources that can be stored whole, one row with
    ``error`` for each source that cannot).

    A posting that is not an object, or has no id or title, fails its source and no
    other; the error names the first such posting of the response.
    """
    is_object = F.coalesce(F.startswith(F.ltrim("raw_payload"), F.lit("{")), F.lit(False))
    flaw = (
        F.when(~is_object, "is not an object")
        .when(F.col("external_job_id").isNull(), "has no id")
        .when(F.col("title").isNull(), "has no title")
    )
    flawed = postings.select("source_id", "pos", flaw.alias("_flaw")).filter("_flaw IS NOT NULL")
    first = F.min(F.struct("pos", "_flaw")).alias("f")
    bad = flawed.groupBy("source_id").agg(first).selectExpr("source_id", "concat('posting ', f.pos, ' ', f._flaw) AS error")
    return postings.join(bad.select("source_id"), "source_id", "left_anti"), bad


def with_context(df: DataFrame) -> DataFrame:
    """Add ``structured_context`` read from the raw payload."""
    return (
        df.withColumn("_payload", parse_payload(F.col("raw_payload")))
        .withColumn("structured_context", structured_context(F.lower("provider"), F.col("_payload")))
        .drop("_payload")
    )


def with_content_hash(df: DataFrame) -> DataFrame:
    hashed = content_hash(
        F.col("title"), F.col("company"), F.col("location"), F.col("employment_type"), F.col("workplace_type"),
        F.col("description_text"), F.col("structured_context"),
    )
    return with_context(df).withColumn("content_hash", hashed).drop("structured_context")
