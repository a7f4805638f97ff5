"""Readers with declared schemas: CSV (clean and dirty), JSON chains and vocabularies, HTML pages, PDF files, remote queries.

Every reader goes through Spark's own file sources, so any store Spark can open works, and filters and
columns reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions.scalar import let

CHAIN = "array<struct<contractID: string, expiration: string, strike: string, type: string, last: string, mark: string, bid: string, ask: string, volume: string, open_interest: string, implied_volatility: string, delta: string>>"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def read_dirty_csv(spark: SparkSession, path: str) -> DataFrame:
    """(d, value) of date-led lines; preamble, headers and bad numbers are skipped, '.' is null."""
    return parse_dirty_lines(spark.read.text(path))


def parse_dirty_lines(lines: DataFrame) -> DataFrame:
    parts = F.split("value", ",")
    iso, us = F.regexp_extract(F.trim(F.get(parts, F.lit(0))), r"^(\d{4}-\d{2}-\d{2})$", 1), F.trim(F.get(parts, F.lit(0)))
    date = F.coalesce(F.when(iso != "", iso).try_cast("date"), F.try_to_date(us, "M/d/yyyy"))
    last = F.trim(F.element_at(parts, -1))
    rows = lines.where(F.regexp_like("value", F.lit(r"^\s*(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})\s*,")))
    return rows.select(date.alias("d"), last.try_cast("double").alias("x")).where("d IS NOT NULL AND x IS NOT NULL")


def option_chain(payload: Column) -> Column:
    """Rows of a chain payload {"data": [...]}, to be inlined; numbers stay text until cast leniently."""
    return F.from_json(payload, f"struct<data: {CHAIN}>")["data"]


def chain_rows(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    rows = df.select(*keep, F.inline(option_chain(F.col(payload))))
    numbers = [c for c in ("strike", "last", "mark", "bid", "ask", "volume", "open_interest", "implied_volatility", "delta")]
    return rows.withColumns({c: F.col(c).try_cast("double") for c in numbers} | {"expiration": F.col("expiration").try_cast("date")})


def vocabulary_rows(df: DataFrame, payload: str) -> DataFrame:
    """Rows of a JSON map {word: {decision, warm_score, teal_score}}."""
    schema = "map<string, struct<decision: string, warm_score: double, teal_score: double>>"
    return df.select(F.explode(F.from_json(payload, schema)).alias("word", "v")).select("word", "v.*")


# ---- HTML ------------------------------------------------------------------------------------------

_DROP = "(?is)<(script|style|nav|header|footer)[^>]*>.*?</\\1>"


def visible_lines(html: Column, least: int = 5) -> Column:
    """Lines of visible text with at least ``least`` words; navigation, scripts and styles are dropped."""
    text = F.regexp_replace(F.regexp_replace(html, _DROP, ""), "(?i)<(br|p|div|h[1-6]|li|ul|article)[^>]*>", "\n")
    text = F.regexp_replace(text, "<[^>]*>", " ")
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \\t\\r]+", " ")))
    return F.filter(lines, lambda x: F.size(F.split(x, " ")) >= least)


def paragraphs(html: Column) -> Column:
    """Texts of <p> elements."""
    return F.transform(F.regexp_extract_all(html, F.lit("(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), "[ \\t\\r\\n]+", " ")))


def element(html: Column, opening: Column, tag: str) -> Column:
    """What lies between the first occurrence of an opening tag and its closing tag; null where the tag is null or absent."""
    step = lambda p: F.when(F.lower(p).startswith(f"</{tag}"), -1).when(F.lower(p).startswith(f"<{tag}"), 1).otherwise(0)

    def inside(parts: Column) -> Column:
        """Parts from the one whose tag closes the element on are outside it."""
        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))
        merge = lambda s, p: F.when(s["depth"] < 1, s).otherwise(let(s["depth"] + step(p), lambda d: F.struct(d.alias("depth"), (s["n"] + F.when(d > 0, 1).otherwise(0)).alias("n"))))
        return F.array_join(F.slice(parts, 1, F.aggregate(parts, start, merge, lambda s: s["n"])), "")

    def rest(at: Column) -> Column:
        text = F.substring(html, at + F.length(opening), F.length(html))
        return F.when(at > 0, let(F.split(F.regexp_replace(text, f"(?i)<(/?{tag}[\\s>])", "\u0001<$1"), "\u0001"), inside))

    return let(F.instr(html, opening), rest)


#: Markers of the page layouts and of what surrounds a statement's body.
BODY_CLASSES, TITLE_CLASS, BODY_IDS = ("col-xs-12", "col-sm-8"), "heading", ("article", "leftText")
OPENER, FOOTER = "for release at", "(voting (for|against) the fomc)|(^chair(man|woman|person)?[\\s,])"


def statement_container(html: Column) -> Column:
    """The element that holds a statement: the body column that is no title, else the article by id, the left text, an <article>, the whole page."""
    classes = lambda t: F.regexp_extract(t, "(?i)\\sclass\\s*=\\s*[\"']([^\"']*)", 1)
    body = lambda c: F.contains(c, F.lit(BODY_CLASSES[0])) & F.contains(c, F.lit(BODY_CLASSES[1])) & ~F.contains(c, F.lit(TITLE_CLASS))
    named = lambda t, name: F.regexp_like(t, F.lit(f"(?i:\\sid\\s*=\\s*)[\"']?{name}[\"'\\s>]"))
    tests = [lambda t: body(classes(t)), lambda t: named(t, BODY_IDS[0]), lambda t: named(t, BODY_IDS[1])]

    def choose(divs: Column) -> Column:
        return F.coalesce(*[F.get(F.filter(divs, test), F.lit(0)) for test in tests])

    div = let(F.regexp_extract_all(html, F.lit("(?i)<div[^>]*>"), F.lit(0)), choose)
    article = F.get(F.regexp_extract_all(html, F.lit("(?i)<article[^>]*>"), F.lit(0)), F.lit(0))
    return let(div, lambda tag: F.coalesce(F.when(tag.isNotNull(), element(html, tag, "div")).otherwise(let(article, lambda t: element(html, t, "article"))), html))


def statement_text(html: Column, start_words: int = 15, keep_words: int = 3, least: int = 20) -> Column:
    """Body of a statement.

    It ends before the first paragraph of the voting record or of the chair's signature. It begins after the first
    paragraph that tells the time of release, or with the first of ``start_words`` words, whichever comes first.
    Paragraphs of at most ``keep_words`` words are left out; below ``least`` words all paragraphs are the text.
    """
    n = lambda p: F.size(F.filter(F.split(p, " "), lambda w: w != ""))
    first = lambda a, f: F.array_position(F.transform(a, f), True).cast("int")
    opens = lambda p: F.contains(F.lower(p), F.lit(OPENER))

    def before_footer(ps: Column) -> Column:
        return let(first(ps, lambda p: F.regexp_like(F.lower(p), F.lit(FOOTER))), lambda stop: F.when(stop > 0, F.slice(ps, 1, F.greatest(stop - 1, F.lit(0)))).otherwise(ps))

    def body(ahead: Column) -> Column:
        begin = let(first(ahead, lambda p: opens(p) | (n(p) >= start_words)), lambda b: F.when(b > 0, b + F.when(opens(F.get(ahead, b - 1)), 1).otherwise(0)).otherwise(F.size(ahead) + 1))
        return let(begin, lambda b: F.array_join(F.filter(F.slice(ahead, b, F.greatest(F.size(ahead) - b + 1, F.lit(0))), lambda p: n(p) > keep_words), " "))

    def text(ps: Column) -> Column:
        return let(let(before_footer(ps), body), lambda joined: F.when(n(joined) < least, F.array_join(ps, " ")).otherwise(joined))

    return let(F.filter(let(statement_container(html), paragraphs), lambda p: p != ""), text)


def statement_url(template: str, d: Column) -> Column:
    """URL of a day's statement; '{}' stands for yyyyMMdd."""
    return F.replace(F.lit(template), F.lit("{}"), F.date_format(d, "yyyyMMdd"))


def refresh(old: DataFrame, new: DataFrame, at: str, by: list[str] = ()) -> DataFrame:
    """Incremental refresh: old rows strictly before the first new one of their key, then all new rows."""
    by = list(by)
    first = new.groupBy(*by).agg(F.min(at).alias("_first")) if by else new.agg(F.min(at).alias("_first"))
    joined = old.join(first, by, "left") if by else old.crossJoin(F.broadcast(first))
    return joined.where(F.col("_first").isNull() | (F.col(at) < F.col("_first"))).drop("_first").unionByName(new)


def first_available(*tables: DataFrame, on: list[str], value: str) -> DataFrame:
    """Ordered sources: each key's value from the first table that has one, with that table's position as ``source``."""
    ranked = [t.where(F.col(value).isNotNull()).select(*on, value, F.lit(i).alias("source")) for i, t in enumerate(tables)]
    both = ranked[0]
    for t in ranked[1:]:
        both = both.unionByName(t)
    return both.groupBy(*on).agg(F.min_by(value, "source").alias(value), F.min("source").alias("source"))


def observations(lines: DataFrame, line: str, start: str, end: str) -> DataFrame:
    """d and value of 'date,value' lines within [start, end]; '.' is a missing value, other columns stay."""
    parts = F.split(line, ",")
    x = lines.withColumns({"d": F.get(parts, F.lit(0)).try_cast("date"), "value": F.get(parts, F.lit(1)).try_cast("double")}).drop(line)
    return x.where(F.col("d").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def pdf_pages(content: bytes) -> list[str]:
    """Texts of a PDF's pages, if a PDF library is installed; without one it fails when called, not on import."""
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as doc:
        return [page.extract_text() or "" for page in doc.pages]


def pdf_texts(files: DataFrame, pages: Callable[[bytes], list[str]] = pdf_pages) -> DataFrame:
    """(path, n_pages, text): the texts of each file's pages that have any, joined by lines. ``pages`` takes a file's bytes."""

    def run(batches):
        for b in batches:
            read = [pages(c) for c in b.column("content").to_pylist()]
            texts = ["\n".join(t for t in found if t) for found in read]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(list(map(len, read)), pa.int64()), pa.array(texts, pa.string())], names=["path", "n_pages", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, n_pages long, text string")


def read_pdf_texts(spark: SparkSession, path: str, pages: Callable[[bytes], list[str]] = pdf_pages) -> DataFrame:
    return pdf_texts(spark.read.format("binaryFile").load(path), pages)


def read_remote(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """The result of a query that a remote database runs; the database gets the whole query, so its filters and joins stay there."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()
