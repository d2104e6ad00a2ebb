"""Connectors: cached tables, delimited files, JSON, XML, HTML and lexicons."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tidemark.functions.text import c


def cached(spark: SparkSession, path: str, load: Callable[[], DataFrame], required: tuple[str, ...] = (), refresh: bool = False) -> DataFrame:
    """The table at ``path`` if it is there with all required columns, else ``load()`` written there.

    A load that fails falls back to the stored table, whatever its columns.
    """
    old = None
    try:
        old = spark.read.parquet(path)
    except Exception:  # not written yet
        pass
    if old is not None and not refresh and set(required) <= set(old.columns):
        return old
    try:
        new = load()
    except Exception:
        if old is None:
            raise
        return old
    new.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: StructType, required: tuple[str, ...] = ()) -> DataFrame | None:
    """A delimited file with a header read under a schema; None where a required column is missing from it."""
    header = spark.read.option("header", True).csv(path).columns
    if not set(required) <= set(header):
        return None
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select(*((F.col(f.name).try_cast(f.dataType) if f.name in header else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))


def write_csv(df: DataFrame, path: str) -> None:
    """Delimited files without columns a line cannot hold."""
    keep = [f.name for f in df.schema if not isinstance(f.dataType, StructType) and f.dataType.typeName() not in ("array", "map")]
    df.select(*keep).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def jsonp(x: Column | str, schema: str) -> Column:
    """The payload of a JSON or JSONP answer."""
    return F.from_json(F.regexp_extract(c(x), r"(?s)^[^({\[]*\(?\s*([\[{].*[\]}])\s*\)?;?\s*$", 1), schema)


def feed_items(df: DataFrame, xml: str, fields: list[str]) -> DataFrame:
    """One row per <item> of an RSS document, with the text of the given child elements."""
    items = df.select(*[x for x in df.columns if x != xml], F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)(<item\b.*?</item>)"), F.lit(1))).alias("_i"))
    return items.select(*[x for x in df.columns if x != xml], *(F.nullif(F.regexp_extract("_i", rf"(?s)<{f}[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{f}>", 1), F.lit("")).alias(f) for f in fields))


def anchors(df: DataFrame, html: str, least: int = 8, terms: str | None = None) -> DataFrame:
    """(href, label) of the links of a page whose label is long enough and matches."""
    rest = [x for x in df.columns if x != html]
    a = df.select(*rest, F.explode(F.regexp_extract_all(html, F.lit(r"(?is)(<a\b[^>]*href=[^>]*>.*?</a>)"), F.lit(1))).alias("_a"))
    a = a.select(*rest, F.regexp_extract("_a", r"(?is)href=[\"']?([^\"'\s>]+)", 1).alias("href"), F.trim(F.regexp_replace("_a", "<[^>]+>", "")).alias("label"))
    return a.where((F.length("label") >= least) & (F.col("label").rlike(terms) if terms else F.lit(True)))


class _Body(HTMLParser):
    """Paragraph and table texts of a page."""

    SKIP = {"script", "style", "nav", "footer", "header", "aside"}

    def __init__(self) -> None:
        super().__init__()
        self.depth, self.p, self.all, self.rows, self.in_p, self.cell = 0, [], [], [], False, None

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.SKIP
        if tag == "p":
            self.in_p = True
            self.p.append("")
        elif tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.cell = ""

    def handle_endtag(self, tag):
        self.depth -= tag in self.SKIP and self.depth > 0
        if tag == "p":
            self.in_p = False
        elif tag in ("td", "th") and self.cell is not None and self.rows:
            self.rows[-1].append(" ".join(self.cell.split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell += data
        if not self.depth:
            self.all.append(data)
            if self.in_p:
                self.p[-1] += data


def html_body(x: Column | str, least_paragraph: int = 20, least_body: int = 50) -> Column:
    """Paragraphs long enough, or else the whole text if that is; null where neither is."""

    def run(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            if t is None:
                out.append(None)
                continue
            b = _Body()
            b.feed(t)
            p = [" ".join(q.split()) for q in b.p]
            p = [q for q in p if len(q) > least_paragraph]
            whole = " ".join(" ".join(b.all).split())
            out.append("\n".join(p) if p else whole if len(whole) > least_body else None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, StringType())(c(x))


def html_rows(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, row, cells) of the tables of a page."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for k, t in zip(p[key], p[html], strict=True):
                b = _Body()
                b.feed(t or "")
                out += [(k, i, r) for i, r in enumerate(b.rows) if r]
            yield pd.DataFrame(out, columns=[key, "row", "cells"])

    return df.select(key, html).mapInPandas(run, f"`{key}` {kind}, row int, cells array<string>")


def lexicon(df: DataFrame) -> DataFrame:
    """(word, positive, negative) of a lexicon table whose columns are named in any case."""
    by = {x.lower(): x for x in df.columns}
    flag = lambda n: (F.coalesce(F.col(by[n]).try_cast("double"), F.lit(0.0)) > 0).alias(n) if n in by else F.lit(False).alias(n)
    return df.select(F.lower(F.trim(F.col(by["word"]))).alias("word"), flag("positive"), flag("negative")).where("word <> ''")
