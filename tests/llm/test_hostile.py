"""Nulls in every column, empty and very long texts, ties, repeated rows, empty tables, clashing extra columns."""

import pytest
from eventide.llm import bpe_table, chat, divergence, exact_dedup, langid, line_dedup, merkle, packing, simhash, token_counts, url_rules, warc

LONG = "mot clé " * 120_000  # about a million characters
TEXTS = [(1, "same text"), (1, "same text"), (2, "same text"), (3, None), (4, ""), (5, LONG), (6, "\n" * 5000), (7, "x" * 300_000), (None, "same text"), (None, None), (2**62, "end"), (-5, "a\x00b ퟿")]
#: Names that operators use inside, as extra columns.
CLASH = ["keep_id", "group_size", "digest", "part", "guest", "k", "next_text", "bucket", "length", "start", "fp", "u", "v", "block", "packed", "row", "pos", "term", "seat", "chunks", "key", "held_out", "score", "n", "word"]


def hostile(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    rows = [(i, t, "en" if i and i % 2 else None, None, None, *["clash"] * len(CLASH)) for i, t in TEXTS]
    return spark.createDataFrame(rows, schema)


OPERATORS = {
    "language ID": lambda df: langid.predict(df, langid.train(df)),
    "BPE": lambda df: bpe_table.round_trip_documents(df, block_bytes=100_000),
    "fingerprints": merkle.fingerprint_edits,
    "exact dedup": exact_dedup.exact_dedup,
    "packing": packing.pack,
    "line dedup": line_dedup.dedup_lines,
    "SimHash": simhash.near_dedup,
    "token counts": token_counts.count_tokens,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, name):
    df = hostile(spark)
    out = OPERATORS[name](df)
    rows = out.collect()
    if name == "packing":
        assert sum(r.start == 0 for r in rows) == len(TEXTS)
    else:
        assert len(rows) == len(TEXTS)
    empty = OPERATORS[name](df.where("false"))
    assert empty.schema == out.schema and empty.count() == 0
    again = sorted(map(str, OPERATORS[name](df.repartition(3)).drop("sequence_id", "offset").collect()))
    assert again == sorted(map(str, out.drop("sequence_id", "offset").collect()))


def test_divergence_of_hostile_documents(spark):
    df = hostile(spark).selectExpr("* EXCEPT (source)", "CASE WHEN doc_id = 5 THEN 'long' END AS source")
    rows = divergence.audit(df, min_docs=1, k=3).collect()
    assert {(r.lang, r.source, r.part, r.item) for r in rows} >= {("en", "", "pair", "long"), ("en", "long", "pair", ""), ("en", "long", "term", "clé"), ("en", "long", "term", "mot")}
    assert divergence.audit(df.where("false")).count() == 0


def test_stages_keep_clashing_columns(spark):
    df = hostile(spark)
    for stage in (lambda d: langid.keep_identified(d, langid.train(d), 0.1), exact_dedup.keep_first, simhash.keep_one):
        out = stage(df)
        assert out.schema == df.schema
        ids = [r.doc_id for r in out.collect()]
        assert set(ids) <= {i for i, _ in TEXTS}


def test_exact_dedup_classes(spark):
    got = exact_dedup.exact_dedup(hostile(spark)).collect()
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id in (1, 2)} == {(1, 4)}
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id in (3, 4)} == {(3, 3)}


def test_conversations(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 3, "assistant", LONG), (2, 1, "assistant", "</s>" * 1000), (2, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, position string, message int")
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(chat.message_events(df))).collect()}
    assert {k: r.n_turns for k, r in out.items()} == {1: 3, None: 1, 2: 2}
    assert out[None].loss_chars == len(LONG) and out[2].loss_chars == 4001


def test_pages(spark):
    rows = [(1, None, None), (1, None, None), (2, "http://a.net/" + "p/" * 5000, LONG), (None, "u", LONG), (3, "http://x.org/fr/", "")]
    df = spark.createDataFrame([(*r, "c", "c", "c", "c") for r in rows], "page_id long, url string, html string, kind string, archive string, host string, token string")
    got = sorted(((r.page_id or -1), r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(df)).collect())
    assert got == [(-1, "revisit", 2), (1, "revisit", 3), (1, "revisit", 3), (2, "response", None), (3, "response", None)]
    labels = df.selectExpr("page_id", "url", "case when page_id = 2 then 'block' else 'allow' end AS label")
    out = url_rules.judge(df, [("block", "net/")], url_rules.mine(labels))
    assert sorted((r.page_id or -1, r.rule or "", r.verdict) for r in out.collect())[-2:] == [(2, "net/", "block"), (3, "", "allow")] and out.count() == 5
