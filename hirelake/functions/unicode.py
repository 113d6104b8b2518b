"""The three Arrow UDFs: Spark SQL has neither Unicode normalisation nor an HTML parser."""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from hirelake.functions.scalar import collapse

# Elements whose text is not page text, and elements without content.
HIDDEN = {"script", "style", "template", "rt", "rp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


def _per_distinct(values: pd.Series, fn) -> pd.Series:
    """Apply ``fn`` once per distinct value of the Arrow batch."""
    table = {v: fn(v) for v in values.dropna().unique()}
    return values.map(table).astype(object).where(values.notna(), None)


def _key(name: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", name).casefold().split())


def _slug(name: str) -> str:
    ascii_name = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    slug = "-".join(re.findall(r"[a-z0-9]+", ascii_name.lower()))
    return slug or "company-" + hashlib.sha256(name.encode()).hexdigest()[:10]


@F.pandas_udf(T.StringType())
def name_key(names: pd.Series) -> pd.Series:
    """Identity key of a company name: NFKC, case-folded, whitespace collapsed."""
    return _per_distinct(names, _key)


@F.pandas_udf(T.StringType())
def name_slug(names: pd.Series) -> pd.Series:
    """URL slug of a company name."""
    return _per_distinct(names, _slug)


class _PageText(HTMLParser):
    """Collects visible text runs, one per stretch between markup."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.runs: list[str] = []
        self.pending: list[str] = []
        self.open: list[str] = []
        self.hidden = 0

    def flush(self) -> None:
        run = "".join(self.pending).strip()
        self.pending.clear()
        if run:
            self.runs.append(run)

    def handle_data(self, data):
        if not self.hidden:
            self.pending.append(data)

    def handle_starttag(self, tag, attrs):
        self.flush()
        if tag not in VOID:
            self.open.append(tag)
            self.hidden += tag in HIDDEN

    def handle_startendtag(self, tag, attrs):
        self.flush()

    def handle_endtag(self, tag):
        self.flush()
        if tag in self.open:
            while True:
                closed = self.open.pop()
                self.hidden -= closed in HIDDEN
                if closed == tag:
                    break

    def handle_comment(self, data):
        self.flush()

    handle_decl = handle_pi = unknown_decl = handle_comment


def _page_text(markup: str) -> str:
    page = _PageText()
    page.feed(markup)
    page.close()
    page.flush()
    return "\n".join(page.runs)


@F.pandas_udf(T.StructType().add("decoded", "string").add("text", "string"))
def decode_html(content: pd.Series) -> pd.DataFrame:
    """Entity-decoded HTML and its visible text, one line per text run."""
    # Empty content has neither markup nor text.
    decoded = [html.unescape(c) if c else None for c in content]
    return pd.DataFrame(
        {"decoded": decoded, "text": [_page_text(d) if d is not None else None for d in decoded]}, dtype=object
    )


def display_name(c: Column) -> Column:
    return collapse(c)


def distinct_slug(slug: Column, key: Column) -> Column:
    """Slug made unique by eight hex digits of the identity key."""
    return F.concat(slug, F.lit("-"), F.left(F.sha2(key, 256), F.lit(8)))
