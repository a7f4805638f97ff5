"""Sources and sinks over derived payloads."""

import uuid

from pyspark.sql import functions as F

from eventide.adapters import calendar, macro, panel, series, sql, table, texts
from eventide.catalog import register
from eventide.functions.scalar import r6
from eventide.session import shared_dir
from eventide.sources import readers as R
from eventide.sources.corpus import union_corpus
from eventide.sources.sinks import html_rows


@register("src_csv", sql("macro", "SELECT split_part(line, ',', 1) AS d, CAST(split_part(line, ',', 2) AS DOUBLE) AS value FROM (SELECT CAST(d AS VARCHAR) || ',' || CAST(value AS VARCHAR) AS line FROM macro WHERE series = 'A')"))
def _(spark, d):
    m = macro(spark, d).where("series = 'A'")
    line = F.concat_ws(",", F.col("d").cast("string"), F.col("value").cast("string"))
    return m.select(F.from_csv(line, "d string, value double").alias("r")).select("r.*")


_DIRTY = "SELECT CASE WHEN event_id % 10 = 0 THEN 'Preamble, see notes' WHEN event_id % 10 = 1 THEN strftime(ts, '%Y-%m-%d') || ',.' ELSE strftime(ts, '%Y-%m-%d') || ',' || CAST(user_id AS VARCHAR) END AS line FROM events"


@register("src_csv_dirty", f"SELECT split_part(line, ',', 1) AS day, round(avg(TRY_CAST(split_part(line, ',', 2) AS DOUBLE)), 6) AS x, count(*) AS n FROM ({_DIRTY}) WHERE regexp_matches(line, '^[0-9]{{4}}-') AND TRY_CAST(split_part(line, ',', 2) AS DOUBLE) IS NOT NULL GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    line = F.when(e.event_id % 10 == 0, "Preamble, see notes").when(e.event_id % 10 == 1, F.concat(day, F.lit(",."))).otherwise(F.concat(day, F.lit(","), e.user_id.cast("string")))
    x = R.parse_dirty_lines(e.select(line.alias("value")))
    return x.groupBy(F.col("d").cast("string").alias("day")).agg(r6(F.avg("x")).alias("x"), F.count("*").alias("n"))


@register("src_json_chain", "SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN 'call' ELSE 'put' END AS type, p_retailprice + k AS strike, CASE WHEN k = 0 THEN NULL ELSE p_size / 100.0 END AS iv FROM part, (VALUES (0), (5)) v(k)")
def _(spark, d):
    p = table(spark, d, "part")
    row = lambda k: F.struct(F.when(p.p_partkey % 2 == 0, "call").otherwise("put").alias("type"), (p.p_retailprice + k).cast("string").alias("strike"), (F.lit("-") if k == 0 else (p.p_size / 100.0).cast("string")).alias("implied_volatility"))
    payload = p.select("p_partkey", F.to_json(F.struct(F.array(row(0), row(5)).alias("data"))).alias("payload"))
    return R.chain_rows(payload, "payload", ["p_partkey"]).select("p_partkey", "type", "strike", F.col("implied_volatility").alias("iv"))


@register("src_json_props", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "struct<k: bigint>")["k"].alias("k"))


@register("src_json_vocab", "SELECT p_type AS word, CASE WHEN count(*) % 2 = 0 THEN 'KEEP' ELSE 'DROP' END AS decision, count(*) / 10.0 AS warm_score FROM part GROUP BY 1")
def _(spark, d):
    n = F.col("n")
    v = table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    one = F.to_json(F.create_map("p_type", F.struct(F.when(n % 2 == 0, "KEEP").otherwise("DROP").alias("decision"), (n / 10.0).alias("warm_score"))))
    return R.vocabulary_rows(v.select(one.alias("payload")), "payload").select("word", "decision", "warm_score")


@register("src_ohlc", sql("series", "SELECT tenor, d, CASE WHEN d >= DATE '2000-01-01' THEN px + 1 ELSE px END AS px FROM series WHERE d < DATE '2001-01-01'"), dates="d")
def _(spark, d):
    s = series(spark, d).where("d < DATE '2001-01-01'")
    old = s  # what a cache holds, overlapping the download
    new = s.where("d >= DATE '2000-01-01'").withColumn("px", F.col("px") + 1)
    return R.refresh(old, new, "d", ["tenor"])


_HTML = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?is)<nav[^>]*>.*?</nav>', '', 'g'), '(?is)<header[^>]*>.*?</header>', '', 'g'), '(?is)<footer[^>]*>.*?</footer>', '', 'g'), '(?i)<(br|p|div|h[1-6]|li|ul|article)[^>]*>', chr(10), 'g')"
_LINES = f"list_filter(list_transform(string_split(regexp_replace({_HTML}, '<[^>]*>', ' ', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r]+', ' ', 'g'))), lambda x: len(string_split(x, ' ')) >= 5)"


@register("src_html_speech", f"WITH l AS (SELECT page_id, {_LINES} AS l FROM pages) SELECT page_id, len(l) AS n_lines, sha256(array_to_string(l, ' ')) AS body FROM l WHERE len(string_split(array_to_string(l, ' '), ' ')) >= 100")
def _(spark, d):
    x = texts(spark, d, "pages").select("page_id", R.visible_lines(F.col("html")).alias("l")).withColumn("b", F.array_join("l", " "))
    return x.where(F.size(F.split("b", " ")) >= 100).select("page_id", F.size("l").cast("long").alias("n_lines"), F.sha2("b", 256).alias("body"))


_PS = "list_transform(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')))"


@register("src_html_presser", f"SELECT page_id, len({_PS}) AS n_par, sha256(array_to_string({_PS}, ' ')) AS body FROM pages WHERE len(string_split(array_to_string({_PS}, ' '), ' ')) > 50")
def _(spark, d):
    x = texts(spark, d, "pages").select("page_id", R.paragraphs(F.col("html")).alias("p")).withColumn("b", F.array_join("p", " "))
    return x.where(F.size(F.split("b", " ")) > 50).select("page_id", F.size("p").cast("long").alias("n_par"), F.sha2("b", 256).alias("body"))


_N = "len(list_filter(string_split({}, ' '), lambda w: w <> ''))"


_PAGE_P = _PS.replace("(html,", "(box,")
_STATEMENT = f"""
WITH t AS (SELECT page_id, html, regexp_extract_all(html, '(?i)<div[^>]*>') AS divs, regexp_extract_all(html, '(?i)<article[^>]*>') AS arts FROM pages),
k AS (SELECT page_id, html, unnest([list_filter(divs, lambda x: regexp_matches(regexp_extract(x, '(?i)\\sclass\\s*=\\s*["'']([^"'']*)', 1), 'col-xs-12') AND regexp_matches(regexp_extract(x, '(?i)\\sclass\\s*=\\s*["'']([^"'']*)', 1), 'col-sm-8') AND NOT regexp_matches(regexp_extract(x, '(?i)\\sclass\\s*=\\s*["'']([^"'']*)', 1), 'heading'))[1],
       list_filter(divs, lambda x: regexp_matches(x, '\\s(?i:id\\s*=\\s*)["'']?article["''\\s>]'))[1], list_filter(divs, lambda x: regexp_matches(x, '\\s(?i:id\\s*=\\s*)["'']?leftText["''\\s>]'))[1], arts[1]]) AS opening, unnest([1, 2, 3, 4]) AS rank FROM t),
c AS (SELECT page_id, substr(html, instr(html, opening) + length(opening)) AS rest, CASE WHEN rank = 4 THEN 'article' ELSE 'div' END AS tag FROM k WHERE opening IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY rank) = 1),
cut AS (SELECT page_id, tag, unnest(string_split(regexp_replace(rest, '(?i)<(/?' || tag || '[\\s>])', chr(1) || '<\\1', 'g'), chr(1))) AS part, generate_subscripts(string_split(regexp_replace(rest, '(?i)<(/?' || tag || '[\\s>])', chr(1) || '<\\1', 'g'), chr(1)), 1) AS i FROM c),
deep AS (SELECT *, 1 + sum(CASE WHEN lower(part) LIKE '</' || tag || '%' THEN -1 WHEN lower(part) LIKE '<' || tag || '%' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM cut),
held AS (SELECT *, min(depth) OVER (PARTITION BY page_id ORDER BY i) AS least FROM deep),
boxes AS (SELECT page_id, string_agg(part, '' ORDER BY i) AS box FROM held WHERE least > 0 GROUP BY page_id),
b AS (SELECT p.page_id, CASE WHEN c.page_id IS NULL THEN p.html ELSE coalesce(box, '') END AS box FROM pages p LEFT JOIN c USING (page_id) LEFT JOIN boxes USING (page_id)),
ps AS (SELECT page_id, unnest({_PAGE_P}) AS para, generate_subscripts({_PAGE_P}, 1) AS i FROM b),
para AS (SELECT page_id, para, i, lower(para) AS lo, len(list_filter(string_split(para, ' '), lambda w: w <> '')) AS n FROM ps WHERE para <> ''),
marks AS (SELECT page_id, min(i) FILTER (regexp_matches(lo, 'voting (for|against) the fomc') OR regexp_matches(lo, '^chair(man|woman|person)?[\\s,]')) AS stop,
       min(i) FILTER (lo LIKE '%for release at%') AS released, min(i) FILTER (n >= 15) AS wordy FROM para GROUP BY page_id),
body AS (SELECT page_id, string_agg(para, ' ' ORDER BY i) AS whole, sum(n) AS whole_n,
       string_agg(para, ' ' ORDER BY i) FILTER (inside) AS body, coalesce(sum(n) FILTER (inside), 0) AS body_n
       FROM (SELECT *, n > 3 AND i < coalesce(stop, i + 1) AND (CASE WHEN released <= coalesce(wordy, released) THEN i > released ELSE i >= wordy END) AS inside FROM para JOIN marks USING (page_id)) GROUP BY page_id)
SELECT page_id, sha256(CASE WHEN body_n < 20 THEN coalesce(whole, '') ELSE body END) AS body, CAST(CASE WHEN body_n < 20 THEN coalesce(whole_n, 0) ELSE body_n END AS BIGINT) AS n_words FROM pages LEFT JOIN body USING (page_id)"""


@register("src_html_statement", _STATEMENT.replace("body_n < 20", "coalesce(body_n, 0) < 20"))
def _(spark, d):
    x = texts(spark, d, "pages").select("page_id", R.statement_text(F.col("html")).alias("b"))
    n = F.size(F.filter(F.split("b", " "), lambda w: w != ""))
    return x.select("page_id", F.sha2("b", 256).alias("body"), n.cast("long").alias("n_words"))


def _lines_as_pages(content: bytes) -> list[str]:
    return content.decode("utf-8", "surrogatepass").split("\n")


@register("src_pdf", "SELECT CAST(item_id AS VARCHAR) AS path, len(string_split(text, chr(10))) AS n_pages, array_to_string(list_filter(string_split(text, chr(10)), lambda p: p <> ''), chr(10)) AS text FROM benchmark WHERE text IS NOT NULL")
def _(spark, d):
    """The page text join over files whose page reader is injected: here each line of a text is a page."""
    files = table(spark, d, "benchmark").where("text IS NOT NULL").select(F.col("item_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return R.pdf_texts(files, _lines_as_pages)


@register("src_statement", sql("cal", "SELECT meeting_date, 'https://example.org/statements/' || strftime(meeting_date, '%Y%m%d') || 'a.htm' AS url FROM cal"), dates="meeting_date")
def _(spark, d):
    return calendar(spark, d).select("meeting_date", R.statement_url("https://example.org/statements/{}a.htm", F.col("meeting_date")).alias("url"))


@register("src_corpus_union", "SELECT 'statement' AS doc_type, doc_id AS id, text, lang FROM documents UNION ALL SELECT 'speech', item_id, text, NULL FROM benchmark UNION ALL SELECT 'presser', conv_id, text, NULL FROM conversations WHERE role = 'assistant'")
def _(spark, d):
    return union_corpus(
        statement=texts(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang"),
        speech=table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"),
        presser=texts(spark, d, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("id"), "text"),
    ).select("doc_type", "id", "text", "lang")


@register("src_bloomberg_seam", sql("panel", "SELECT tenor, m, coalesce(CASE WHEN n % 3 = 0 THEN iv END, CASE WHEN n % 3 = 1 THEN rv END, gap) AS value, CASE WHEN n % 3 = 0 THEN 0 WHEN n % 3 = 1 AND rv IS NOT NULL THEN 1 ELSE 2 END AS source FROM panel WHERE n % 3 < 2 AND (n % 3 = 0 OR rv IS NOT NULL) OR gap IS NOT NULL"), dates="m")
def _(spark, d):
    p = panel(spark, d)
    side = lambda cond, c: p.where(cond).select("tenor", "m", F.col(c).alias("value"))
    return R.first_available(side("n % 3 = 0", "iv"), side("n % 3 = 1", "rv"), side("true", "gap"), on=["tenor", "m"], value="value").select("tenor", "m", "value", "source")


@register("src_wrds", "WITH a AS (SELECT o_custkey, o_orderkey, o_totalprice, abs(o_totalprice - (SELECT avg(o_totalprice) FROM orders)) AS dist FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0) SELECT o_custkey, o_orderkey, round(dist, 4) AS dist FROM a QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY dist, o_orderkey) = 1")
def _(spark, d):
    """The remote query's shape (equi-join, scalar subquery, nearest by absolute distance) on local tables."""
    query = """
        WITH a AS (SELECT o_custkey, o_orderkey, abs(o_totalprice - (SELECT avg(o_totalprice) FROM {orders})) AS dist
                   FROM {orders} JOIN {customer} ON c_custkey = o_custkey WHERE c_acctbal > 0)
        SELECT o_custkey, k.o_orderkey, round(k.dist, 4) AS dist
        FROM (SELECT o_custkey, min(struct(dist, o_orderkey)) AS k FROM a GROUP BY o_custkey)"""
    return spark.sql(query, orders=table(spark, d, "orders"), customer=table(spark, d, "customer"))  # no view of the session is touched


@register("snk_html", sql("panel", "SELECT '<tr><td>' || tenor || '</td><td>' || CAST(m AS VARCHAR) || '</td><td>' || coalesce(CAST(n AS VARCHAR), '') || '</td></tr>' AS row_html FROM panel"))
def _(spark, d):
    return panel(spark, d).select(html_rows(F.col("tenor"), F.col("m"), F.col("n")).alias("row_html"))


def _round_trip(spark, df, fmt, **options):
    path = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    df.write.format(fmt).options(**options).save(path)
    return spark.read.format(fmt).options(**options).schema(df.schema).load(path)


@register("snk_parquet", sql("panel", "SELECT tenor, m, iv, rv FROM panel"), dates="m")
def _(spark, d):
    return _round_trip(spark, panel(spark, d).select("tenor", "m", "iv", "rv"), "parquet")


@register("snk_csv", sql("panel", "SELECT tenor, iv, rv FROM panel"))
def _(spark, d):
    return _round_trip(spark, panel(spark, d).select("tenor", "iv", "rv"), "csv", header="true")


@register("src_fred", sql("macro", "SELECT series, d, CASE WHEN month(d) % 5 > 0 THEN value END AS value FROM macro WHERE d BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"), dates="d")
def _(spark, d):
    """Files of lines 'date,value' with '.' for missing, one folder for each series, read through the observation source."""
    from eventide.sources import fred

    m = macro(spark, d)
    lines = m.select("series", F.concat_ws(",", F.col("d").cast("string"), F.when(F.month("d") % 5 > 0, F.col("value").cast("string")).otherwise(".")).alias("line"))
    path = f"{shared_dir(spark)}/observations-{uuid.uuid4().hex}"
    lines.write.partitionBy("series").text(path)
    fred.register(spark)
    return spark.read.format("observations").options(path=path, start="1996-01-01", end="1999-12-31").load()


@register("src_observations", sql("macro", "SELECT series, d, CASE WHEN month(d) % 5 > 0 THEN value END AS value FROM macro WHERE d BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"), dates="d")
def _(spark, d):
    """The same lines as a column, parsed where they are."""
    m = macro(spark, d)
    lines = m.select("series", F.concat_ws(",", F.col("d").cast("string"), F.when(F.month("d") % 5 > 0, F.col("value").cast("string")).otherwise(".")).alias("line"))
    return R.observations(lines, "line", "1996-01-01", "1999-12-31")
