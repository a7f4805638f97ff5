"""Readers on literal files and pages."""

import datetime as dt
import os

import pytest
from eventide.sources import fred, readers
from pyspark.sql import functions as F

LONG = "The members seek conditions that foster price stability and sustainable growth in output over the coming months and also over all later years."
NEXT = "It also decided to keep the target range for its rate where it was before this meeting took place."


def page(*ps, box='<div class="col-xs-12 col-sm-8 col-md-8">'):
    return f"<html><body><p>Menu of the whole site</p>{box}" + "".join(f"<p>{p}</p>" for p in ps) + "</div><p>Last updated on a day long after the meeting was over and everybody had gone home for good.</p></body></html>"


CASES = [
    # the opener is left out, and the body begins right after it, however short
    (page("For release at 2:00 p.m. EST", "A short line of five", LONG), f"A short line of five {LONG}"),
    # without opener: the first paragraph of fifteen words begins the body; a later opener is text
    (page("Press Release", LONG, "For release at once, they said", NEXT), f"{LONG} For release at once, they said {NEXT}"),
    # an opener of fifteen words and more is still the opener
    (page("For release at 2:00 p.m. on the day after the last of the two days of the meeting", LONG), LONG),
    # the voting record ends it, also in the middle of a paragraph
    (page(LONG, NEXT, "Today, voting for the FOMC monetary policy action were all members", "And more words that come after the record"), f"{LONG} {NEXT}"),
    (page(LONG, "Voting against the FOMC action was one", NEXT), LONG),
    # other votes do not
    (page(LONG, "Voting for peace is not a record of votes"), f"{LONG} Voting for peace is not a record of votes"),
    # the chair's signature ends it
    (page(LONG, NEXT, "Chairman Somebody", NEXT), f"{LONG} {NEXT}"),
    (page(LONG, "Chair, of the board", NEXT), LONG),
    (page(LONG, "Chairs were brought in for all of them"), f"{LONG} Chairs were brought in for all of them"),
    # paragraphs of three words go
    (page(LONG, "Implementation Note issued", NEXT), f"{LONG} {NEXT}"),
    # below twenty words the whole container counts
    (page("Short one here", "For release at noon"), "Short one here For release at noon"),
    # the title column is not the body; inner elements do not end it
    (page("Share it with everybody", box='<div class="heading col-xs-12 col-sm-8"><p>Title</p></div><div id="top" class="col-sm-8 x col-xs-12"><div><p>' + LONG + "</p></div>"), f"{LONG} Share it with everybody"),
    # older pages: by id, then <article>, then the whole page
    (page(LONG, box="<div id='leftText'>"), LONG),
    (page(LONG, box='<div id="articles">').replace("<body>", "<body><article class=x>").replace("</div>", "</article>"), LONG),
    (f"<p>{LONG}</p><p>Chairwoman X</p>", LONG),
    ("no paragraphs", ""),
    (None, None),
]


def test_statement_text(spark):
    df = spark.createDataFrame([(k, html) for k, (html, _) in enumerate(CASES)], "k int, html string")
    got = {r.k: r.text for r in df.select("k", readers.statement_text(df.html).alias("text")).collect()}
    assert {k: (got[k], want) for k, (_, want) in enumerate(CASES) if got[k] != want} == {}


def test_pdf_texts_take_any_page_reader(spark, tmp_path):
    for name, content in (("a", b"one|two||three"), ("b", b"|")):
        (tmp_path / f"{name}.pdf").write_bytes(content)
    out = readers.read_pdf_texts(spark, str(tmp_path), lambda raw: raw.decode().split("|"))
    assert sorted((os.path.basename(r.path), r.n_pages, r.text) for r in out.collect()) == [("a.pdf", 4, "one\ntwo\nthree"), ("b.pdf", 2, "")]


def test_observations_from_folders_files_and_uris(spark, tmp_path):
    folder = tmp_path / "all" / "series=X"
    folder.mkdir(parents=True)
    (folder / "part-0.txt").write_text("DATE,VALUE\n2001-01-02,1.5\n2001-01-03,.\n2003-01-01,9\n")
    (tmp_path / "all" / "_SUCCESS").write_text("")
    (tmp_path / "Y.csv").write_text("2001-01-02,2\nbad,1\n")
    fred.register(spark)
    read = lambda path, **o: sorted(map(tuple, spark.read.format("observations").options(path=path, **o).load().collect()))
    first, second = dt.date(2001, 1, 2), dt.date(2001, 1, 3)
    assert read(f"{tmp_path}/all,file://{tmp_path}/Y.csv", end="2002-01-01") == [("X", first, 1.5), ("X", second, None), ("Y", first, 2.0)]
    assert read(f"file://{tmp_path}/all", start="2002-01-01") == [("X", dt.date(2003, 1, 1), 9.0)]
    assert read(f"{tmp_path}/Y.csv", series="Z") == [("Z", first, 2.0)]


def test_remote_query_runs_in_the_database(spark):
    url, driver = "jdbc:derby:memory:quotes;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    options = {"url": url, "driver": driver}
    quotes = spark.createDataFrame([(1, 100.0, 0.2), (1, 105.0, None), (2, 90.0, 0.3)], "secid int, strike double, iv double")
    try:
        quotes.write.format("jdbc").options(**options, dbtable="quotes").save()
    except Exception as e:
        pytest.skip(f"no embedded database: {e!s:.80}")
    out = readers.read_remote(spark, url, 'SELECT "secid", "strike", ABS("strike" - 101) AS "far" FROM quotes WHERE "iv" IS NOT NULL', driver=driver)
    assert sorted((r[0], r[2]) for r in out.where(F.col("secid") == 1).collect()) == [(1, 1.0)]
