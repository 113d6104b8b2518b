"""Description compaction: drop company, benefits and legal boilerplate lines.

A description is tidied by a few regular expressions that never rescan a run of
blanks, cut into lines, and each line is marked by a lookup of its heading (few
lines are short enough to be one) or by plain substring searches.  One
possessive match then removes every dropped section.  Each step is a column of
its own, so that none is computed twice, and the cost is linear in the text.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from hirelake.functions.scalar import col, strip

# Headings and phrases that decide what a section is.
BOILERPLATE_HEADINGS = (
    "about us", "about the company", "our company", "our culture", "culture", "what we offer", "benefits",
    "our benefits", "perks", "perks and benefits", "health and wellbeing", "growth and future", "community",
    "equal opportunity", "equal employment opportunity", "diversity and inclusion",
    "diversity, equity and inclusion", "accommodation", "accommodations", "candidate privacy", "privacy notice",
    "our approach to remote work", "how we work with ai",
)
ROLE_ABOUT_HEADINGS = ("about the role", "about the job", "about this role")
RELEVANT_HEADINGS = (
    "about the role", "about the job", "the role", "role overview", "position overview", "what you'll do",
    "what you’ll do", "what you will do", "what you will build", "responsibilities", "your responsibilities",
    "what we're looking for", "what we’re looking for", "what we are looking for", "who we're looking for",
    "who we’re looking for", "who you are", "what you bring", "what you'll bring", "what you’ll bring",
    "your qualifications", "you have", "requirements", "minimum requirements", "minimum qualifications",
    "qualifications", "preferred qualifications", "preferred requirements", "skills", "experience", "education",
    "compensation", "salary", "pay range", "location", "work authorization", "visa sponsorship",
    "security clearance",
)
LEGAL_PHRASES = (
    "equal opportunity employer", "equal employment opportunity", "do not discriminate on the basis",
    "reasonable accommodation", "accommodation is available", "candidate privacy notice", "privacy policy",
    "background check may consist", "successful applicants will be required to complete a background check",
    "artificial intelligence (ai) and machine learning (ml) technologies",
    "assist in the initial screening of employment applications",
)
CITIZENSHIP_PHRASES = (
    "u.s. citizen", "us citizen", "united states citizen", "must be a citizen", "citizenship required",
)
MAX_HEADING_CHARS = 100
MAX_SENTENCE_HEADING_WORDS = 8
MIN_COMPACTED_CHARS = 500

# Marks of lines to drop with their section, to keep, and to drop alone; removed from the input first.
_DROP, _KEEP, _LEGAL = "\x01", "\x02", "\x03"
_MARKS = f"[{_DROP}{_KEEP}{_LEGAL}]"
_DASHES = ":-–—"
# Whitespace within a line, and any.
BLANK = r"[ \t\f\r\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_ANY_BLANK = BLANK.replace(r" \t", r" \t\n")


def _any_of(phrases: tuple[str, ...]) -> str:
    """Alternation of literal phrases, longest first."""
    return "|".join(re.escape(p) for p in sorted(phrases, key=len, reverse=True))


CITIZENSHIP_PATTERN = "(?iu)" + _any_of(CITIZENSHIP_PHRASES)


# --- single lines -----------------------------------------------------------


# Every heading that counts starts with one of these; none has a blank so early.
_STARTS = sorted({h[:3] for h in (*BOILERPLATE_HEADINGS, *RELEVANT_HEADINGS, *ROLE_ABOUT_HEADINGS, "about ")})


def _heading_of(line: Column) -> Column:
    """The lower-cased tidy line without trailing dashes if it may be a heading: it is short
    and starts like one.  Few lines do, so most cost no more than their first letters."""
    bare = F.rtrim(strip(F.lower(line)), F.lit(_DASHES))
    starts = F.left(F.lower(F.left(line, F.lit(3))), F.lit(3)).isin(*_STARTS)
    return F.when(starts & (F.length(line) <= MAX_HEADING_CHARS), strip(F.regexp_replace(bare, f"{_ANY_BLANK}+", " ")))


def _is_sentence(line: Column) -> Column:
    return line.endswith(".") & (F.size(F.split(line, f"{_ANY_BLANK}+")) > MAX_SENTENCE_HEADING_WORDS)


def _is_legal(lowered: Column) -> Column:
    return reduce(or_, (F.contains(lowered, F.lit(p)) for p in LEGAL_PHRASES))


def _parts(line: Column) -> Column:
    """A line with what its tag is told by, each made once."""
    return F.struct(line.alias("line"), F.lower(line).alias("lowered"), _heading_of(line).alias("heading"))


def _tagged(parts: Column) -> Column:
    line, heading = parts["line"], parts["heading"]
    about = heading.startswith("about ")
    drops = F.when(about, ~heading.isin(*ROLE_ABOUT_HEADINGS) & ~_is_sentence(line)).otherwise(
        heading.isin(*BOILERPLATE_HEADINGS)
    )
    return (
        F.when(heading.isNotNull() & drops, "B")
        .when(heading.isNotNull() & heading.isin(*RELEVANT_HEADINGS), "R")
        .when(_is_legal(parts["lowered"]), "L")
        .otherwise("N")
    )


def line_tag(line: Column) -> Column:
    """B(oilerplate heading), R(elevant heading), L(egal) or N of a tidy line."""
    # The parts are a variable of a lambda: as an expression they would be made anew for every use.
    return F.get(F.transform(F.array(_parts(line)), _tagged), 0)


# --- whole descriptions -----------------------------------------------------


def tidy_lines(c: Column | str) -> Column:
    """The text with trimmed non-empty lines and single blanks."""
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\r\n?", "\n")
    # A single blank stays as it is and is no match.
    text = F.regexp_replace(text, r"\t[ \t]*+| [ \t]++", " ")
    # A run of blanks is entered at its first one only, which is told after a blank is met:
    # at most places the next character is a visible one.
    text = F.regexp_replace(text, rf"(?![!-~]){BLANK}(?<!{BLANK}{{2}}){BLANK}*+(?=\n)", "")
    return strip(F.regexp_replace(text, rf"\n{_ANY_BLANK}++", "\n"))


def description_lines(c: Column | str) -> Column:
    return F.filter(F.split(tidy_lines(c), "\n"), lambda x: x != "")


def compact_descriptions(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add ``out``: the description without boilerplate; its full lines if too little is left."""
    marks = {"B": _DROP, "R": _KEEP, "L": _LEGAL}

    def marked(line: Column) -> Column:
        tag = line["tag"]
        mark = reduce(lambda w, m: w.when(tag == m[0], m[1]), marks.items(), F.when(tag.isNull(), "")).otherwise("")
        return F.concat(mark, line["line"])

    staged = df.withColumn("_tidy", tidy_lines(F.regexp_replace(F.coalesce(col(column), F.lit("")), _MARKS, "")))
    staged = staged.withColumn(
        "_lines", F.transform(F.split("_tidy", "\n"), _parts)
    )
    staged = staged.withColumn(
        "_tags", F.transform("_lines", lambda x: F.struct(_tagged(x).alias("tag"), x["line"].alias("line")))
    )
    text = F.array_join(F.transform("_tags", marked), "\n")
    # A dropped heading and every line up to the next heading to keep.
    text = F.regexp_replace(text, rf"(?dm)^{_DROP}[^\n]*+(?:\n(?!{_KEEP})[^\n]*+)*+\n?+", "")
    text = F.regexp_replace(text, rf"(?dm)^{_LEGAL}[^\n]*+\n?+", "")
    staged = staged.withColumn("_kept", strip(F.replace(text, F.lit(_KEEP), F.lit(""))))
    chosen = F.when(F.length("_kept") < MIN_COMPACTED_CHARS, F.col("_tidy")).otherwise(F.col("_kept"))
    return staged.withColumn(out, chosen).drop("_tidy", "_lines", "_tags", "_kept")


def mentions_citizenship(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(CITIZENSHIP_PATTERN), F.lit(False))
