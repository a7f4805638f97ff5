"""Document fingerprints: Merkle trees over paragraphs and sections, in DataFrame functions only.

A text's lines are its paragraphs. A paragraph is cut into leaves where its content says so (after a word that ends in
one of a few letters or marks, or after a sparse character where there are no spaces), so a letter put in
moves boundaries only near itself. A paragraph's node is the SHA-256 of its text. Sections end at blank lines and after paragraphs whose node begins with a small digit (one in eight); a
section's node is the SHA-256 of its paragraphs' nodes, the root that of the sections' nodes.

A fingerprint is the root and the distinct leaves, each as some digits of a hash of its text, and its length. Every node of the tree is a whole
SHA-256, so equal roots mean equal texts as surely as equal SHA-256 of the texts do; only leaves are cut to a few digits, and only
likeness reads them. It follows from two fingerprints alone: twice the code points of leaves that both have over those of all leaves of both. Comparing two
trees from the root down finds the first section and paragraph that differ.

The next document of each is found with one exchange of texts. Rows are dealt to range parts by quantiles of the
identifier; an identifier that many rows share is split by quantiles of the text's hash, and rows that are equal in
both by row number, so that no part grows with a group. The top row of each part also visits the part above it.

Defined results: null text is empty text; two texts without leaves have likeness 1; repeated rows have equal
fingerprints; a null identifier sorts after all others, equal identifiers by the first 53 bits of the XXH64 of their text, descending too;
the only document is its own next; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.base import materialise

#: A leaf has 16 to 96 code points where its paragraph goes on for so long.
LEAF = r"[^\n]{16,95}?[adlr.!?] |[^\n]{32,95}?[aehs059。、，的一是のはを]|[^\n]{1,96}"
_HASH = 12


def leaf_nodes(paragraph: Column) -> Column:
    """array<string>: for each leaf, in order, 12 digits of its MD5 and its length in code points."""
    return F.transform(F.regexp_extract_all(paragraph, F.lit(LEAF), F.lit(0)), lambda x: F.concat(F.substring(F.md5(x), 1, _HASH), F.lpad(F.length(x).cast("string"), 2, "0")))


def tree(text: Column) -> Column:
    """struct<leaves, sections: array<struct<node, paragraphs>>>: distinct leaves in order of their nodes, nodes of sections and of their paragraphs."""
    lines = F.split(text, "\n", -1)
    leaves = F.array_sort(F.array_distinct(F.flatten(F.transform(lines, lambda p: leaf_nodes(p)))))
    return F.struct(leaves.alias("leaves"), F.transform(lines, lambda p: F.sha2(p, 256)).alias("paragraphs"))


#: The node of an empty paragraph: a blank line.
BLANK = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def sections(paragraphs: Column) -> Column:
    """array<struct<node, paragraphs>> from the nodes of all paragraphs."""
    last = F.size(paragraphs)
    ends = F.filter(F.sequence(F.lit(1), last), lambda i: F.substring(F.get(paragraphs, i - 1), 1, 1).isin("0", "1") | (F.get(paragraphs, i - 1) == BLANK) | (i == last))
    slices = F.transform(ends, lambda e, i: F.slice(paragraphs, F.coalesce(F.get(ends, i - 1), F.lit(0)) + 1, e - F.coalesce(F.get(ends, i - 1), F.lit(0))))
    return F.transform(slices, lambda ps: F.struct(F.sha2(F.concat_ws("", ps), 256).alias("node"), ps.alias("paragraphs")))


def root(parts: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(parts, lambda s: s["node"])), 256)


def fingerprint(leaves: Column, parts: Column) -> Column:
    """The published string: 64 digits of the root, then each distinct leaf."""
    return F.concat(root(parts), F.array_join(leaves, ""))


def published_leaves(print_: Column) -> Column:
    return F.regexp_extract_all(F.substring(print_, F.lit(65), F.length(print_)), F.lit(f".{{{_HASH + 2}}}"), F.lit(0))


def _weight(leaves: Column) -> Column:
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda n, x: n + F.substring(x, _HASH + 1, 2).cast("int"))


def leaf_likeness(a: Column, b: Column) -> Column:
    """0 to 1: code points of common leaves, twice, over those of both."""
    both = _weight(a) + _weight(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * _weight(F.array_intersect(a, b)) / both)


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two published fingerprints."""
    return leaf_likeness(published_leaves(a), published_leaves(b))


def first_difference(a: Column, b: Column) -> Column:
    """'section/paragraph' (from 1) of the first differing branch of two lists of sections, null where they are equal."""
    differ = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True)
    nodes = lambda t: F.transform(t, lambda s: s["node"])
    at = differ(nodes(a), nodes(b)).cast("int")
    inside = differ(F.get(a, at - 1)["paragraphs"], F.get(b, at - 1)["paragraphs"])
    return F.when(at > 0, F.concat_ws("/", at, F.greatest(F.coalesce(inside, F.lit(1)), F.lit(1))))


# ---- the next document -----------------------------------------------------------------------------


def _position(x: Column, marks: list[int], inner: Column) -> Column:
    """Place of x among quantiles, 0 to 1: linear between two marks, by ``inner`` (0 to 1) where several marks are x."""
    all_marks, last = F.array(*[F.lit(m) for m in marks]), len(marks) - 1
    below, upto = F.size(F.filter(all_marks, lambda m: m < x)), F.size(F.filter(all_marks, lambda m: m <= x))
    low, high = F.get(all_marks, upto - 1).cast("double"), F.get(all_marks, upto).cast("double")
    between = (upto - 1) + (x.cast("double") - low) / F.greatest(high - low, F.lit(1.0))
    place = F.when(upto - below >= 2, below + (upto - below - 1) * inner).when(upto == 0, F.lit(0.0)).when(upto > last, F.lit(float(last))).otherwise(between)
    return place / max(last, 1)


def _range_part(base: DataFrame, parts: int, marks: int = 256) -> Column:
    """Part of each row, rising with (k, h, r)."""
    at = [i / marks for i in range(marks + 1)]
    (found,) = base.agg(F.percentile_approx("k", at, 10_000)).first()
    hot = sorted({a for a, b in zip(found, found[1:]) if a == b})  # at most as many as marks
    inner = F.lit(0.0)
    if hot:
        (hashes,) = base.where(F.col("k").isin(hot)).agg(F.percentile_approx("h", at, 10_000)).first()
        spread = F.shiftrightunsigned(F.xxhash64("r"), 1).cast("double") / float(1 << 63)
        inner = _position(F.col("h"), hashes, spread if len(set(hashes)) < len(hashes) else F.lit(0.0))
    return F.least(F.floor(_position(F.col("k"), found, inner) * parts), F.lit(parts - 1)).cast("long")


def _guests(tops: DataFrame, run: int = 1024) -> DataFrame:
    """(g_row, g_part): the top row of the next part below, for each part; the top of all for the lowest.

    Parts are ordered in runs, so that no task sorts more than a run of parts, or one row for each run.
    """
    tops = tops.withColumn("run", F.floor(F.col("part") / run))
    runs = tops.groupBy(F.col("run").alias("n_run")).agg(F.max_by("top", "part").alias("highest"))
    order = Window.orderBy(F.desc("n_run"))  # one row for each 1024 parts
    runs = runs.withColumn("carry", F.coalesce(F.lead("highest").over(order), F.first("highest").over(order)))
    inside = F.lead("top").over(Window.partitionBy("run").orderBy(F.desc("part")))
    below = tops.withColumn("below", inside).join(runs, F.col("run") == F.col("n_run"))
    return below.select(F.coalesce("below", "carry")["r"].alias("g_row"), F.col("part").alias("g_part"))


def seated(df: DataFrame, id_col: str, text_col: str, part_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, k, h, r, text, part, guest): all rows in their range part, and each part's guest, dealt by part."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("r"))
    h = F.shiftright(F.xxhash64("text"), 11)  # 53 bits, since quantiles are computed in doubles
    base = materialise(rows.select("*", h.alias("h"), F.octet_length("text").cast("long").alias("n_bytes")), "rows")
    n, total = base.agg(F.count(F.lit(1)), F.sum("n_bytes")).first()
    parts = max(1, -(-((total or 0) + 64 * n) // part_bytes))
    base = base.withColumn("part", _range_part(base, parts) if n else F.lit(0).cast("long"))
    guests = materialise(_guests(base.groupBy("part").agg(F.max(F.struct("k", "h", "r")).alias("top"))), "guests")
    placed = base.join(guests, F.col("r") == F.col("g_row"), "left")  # one row for each part: broadcast while that is small
    seat = lambda part, guest: F.struct(part.alias("part"), F.lit(guest).alias("guest"))
    seats = F.when(F.col("g_part").isNull(), F.array(seat(F.col("part"), 0))).otherwise(F.array(seat(F.col("part"), 0), seat(F.col("g_part"), 1)))
    return placed.select("doc_id", "k", "h", "r", "text", F.explode(seats).alias("seat")).select("doc_id", "k", "h", "r", "text", "seat.part", "seat.guest").repartition(parts, "part")


def following(c: str) -> Column:
    """The column in the next row: within a part its own rows come first, highest first, then the guest."""
    return F.lead(c).over(Window.partitionBy("part").orderBy("guest", F.desc("k"), F.desc("h"), F.desc("r")))


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, text, next_text): the next document by descending identifier, after the last the first."""
    return seated(df, id_col, text_col, part_bytes).withColumn("next_text", following("text")).where("guest = 0").select("doc_id", "text", "next_text")


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, first_edit."""
    rows = seated(df, id_col, text_col, part_bytes).withColumn("t", tree(F.col("text"))).select("*", "t.leaves", "t.paragraphs").drop("t")
    rows = rows.withColumn("next_text", following("text")).withColumn("next_leaves", following("leaves")).where("guest = 0")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    kept, taken = F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 3) as int))"), F.substring("next_text", F.lit(1), F.floor(F.col("n_chars") / 3).cast("int"))
    rows = rows.withColumn("edited", F.concat(kept, taken)).withColumn("e", tree(F.col("edited")))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "leaves", sections(F.col("paragraphs")).alias("s"), F.col("e.leaves").alias("e_leaves"), sections(F.col("e.paragraphs")).alias("e_s"), "next_leaves")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("leaves"), F.col("s")).alias("fingerprint"),
        fingerprint(F.col("e_leaves"), F.col("e_s")).alias("edited_fingerprint"),
        leaf_likeness(F.col("leaves"), F.col("e_leaves")).alias("near_edited"),
        leaf_likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
        first_difference(F.col("s"), F.col("e_s")).alias("first_edit"),
    )


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint and the tree's sections, for storing or comparing elsewhere."""
    t = tree(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), t.alias("t")).select("doc_id", "t.leaves", sections(F.col("t.paragraphs")).alias("sections"))
    return rows.select("doc_id", fingerprint(F.col("leaves"), F.col("sections")).alias("fingerprint"), "sections")


def _oracle() -> str:
    leaf = LEAF.replace("\\n", "\n").replace("'", "''")
    weight = lambda x: f"coalesce(list_sum(list_transform({x}, lambda l: CAST(substr(l, {_HASH + 1}) AS BIGINT))), 0)"
    near = lambda a, b: f"CASE WHEN {weight(a)} + {weight(b)} = 0 THEN 1.0 ELSE 2.0 * {weight(f'list_intersect({a}, {b})')} / ({weight(a)} + {weight(b)}) END"
    cut = lambda t: f"list_transform(string_split({t}, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{leaf}'), lambda x: substr(md5(x), 1, {_HASH}) || lpad(CAST(length(x) AS VARCHAR), 2, '0')))"
    ends = lambda p: f"list_filter(range(1, len({p}) + 1), lambda i: {p}[i] = '{BLANK}' OR {p}[i][1] IN ('0', '1') OR i = len({p}))"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nt FROM d),
    e AS (SELECT *, substr(t, 1, n - n // 3) || substr(nt, 1, n // 3) AS et FROM n),
    c AS (SELECT *, {cut("t")} AS tc, {cut("et")} AS ec, {cut("nt")} AS nc FROM e),
    p AS (SELECT doc_id, n, et, list_sort(list_distinct(flatten(tc))) AS tl, list_sort(list_distinct(flatten(ec))) AS el, list_distinct(flatten(nc)) AS nl,
            list_transform(string_split(t, chr(10)), lambda x: sha256(x)) AS tp, list_transform(string_split(et, chr(10)), lambda x: sha256(x)) AS ep FROM c),
    b AS (SELECT *, {ends("tp")} AS tb, {ends("ep")} AS eb FROM p),
    s AS (SELECT *, list_transform(range(1, len(tb) + 1), lambda i: tp[(CASE WHEN i > 1 THEN tb[i - 1] ELSE 0 END) + 1 : tb[i]]) AS ts,
            list_transform(range(1, len(eb) + 1), lambda i: ep[(CASE WHEN i > 1 THEN eb[i - 1] ELSE 0 END) + 1 : eb[i]]) AS es FROM b),
    f AS (SELECT *, list_transform(ts, lambda x: sha256(array_to_string(x, ''))) AS tn, list_transform(es, lambda x: sha256(array_to_string(x, ''))) AS en FROM s),
    g AS (SELECT *, list_position(list_transform(list_zip(tn, en), lambda z: z[1] IS DISTINCT FROM z[2]), true) AS branch FROM f)
    SELECT doc_id, n AS n_chars, sha256(et) AS edited_sha256, sha256(array_to_string(tn, '')) || array_to_string(tl, '') AS fingerprint,
      sha256(array_to_string(en, '')) || array_to_string(el, '') AS edited_fingerprint, {near("tl", "el")} AS near_edited, {near("tl", "nl")} AS near_next,
      CASE WHEN branch > 0 THEN branch || '/' || greatest(1, coalesce(list_position(list_transform(list_zip(ts[branch], es[branch]), lambda z: z[1] IS DISTINCT FROM z[2]), true), 1)) END AS first_edit
    FROM g"""


ORACLE = _oracle()
