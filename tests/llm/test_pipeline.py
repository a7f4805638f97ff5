import hashlib
import os
import random
import re

import corpus_pipeline
import pytest
from eventide.llm import base, bpe, langid, registry
from test_dedup import slow_near

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def survivors(rows, net):
    """The first three stages on plain Python rows."""
    score = langid._predict(net)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [r.doc_id for r in rows], "text": [r.text for r in rows], "held_out": [False] * len(rows)})
    out = next(score(iter([batch]))).to_pylist()
    rows = [r for r, o in zip(rows, out) if o["lang_pred"] != "und" and o["score"] >= corpus_pipeline.MIN_LIFT / len(net.labels)]
    seen, kept = set(), []
    for r in sorted(rows, key=lambda r: r.doc_id):
        norm = re.sub("[\x20\x09-\x0d]+", " ", r.text or "")
        if norm not in seen:
            seen.add(norm)
            kept.append(r)
    chosen, _ = slow_near([(r.doc_id, r.text, "") for r in kept])
    ids = {c[0] for c in chosen}
    return [r for r in kept if r.doc_id in ids]


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = survivors(docs.collect(), langid.train(docs))
    got = corpus_pipeline.run(spark, SF).collect()
    tokens = bpe.encode_texts([r.text or "" for r in want], bpe.default_vocabulary())
    assert {r.doc_id: len(t) + 1 for r, t in zip(want, tokens)} == {r.doc_id: r.doc_tokens for r in got}
    assert sum(r.length for r in got) == sum(len(t) + 1 for t in tokens)
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema == docs.schema
        assert stage(spark, docs.where("false"), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), SF).count() == 0


def test_every_operator_query_runs_and_op6_and_op10_agree_with_each_other(spark):
    results = {name: f(spark, SF) for name, f in registry.QUERIES.items()}
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_language_id", "op3_bpe_roundtrip", "op5_merkle_fingerprints", "op6_exact_dedup", "op9_line_dedup", "op10_simhash"):
        assert results[name].count() == n, name
    both = results["op6_exact_dedup"].join(results["op10_simhash"], "doc_id")
    assert both.groupBy("text_sha256").agg({"component_id": "min"}).count() == both.select("text_sha256", "component_id").distinct().count()


def test_intermediate_tables_can_be_dropped(spark):
    df = base.materialise(spark.range(3).toDF("id"), "probe")
    assert df.count() == 3
    path = df.materialised_at
    assert os.path.isdir(path) and base.discard(df) == 1
    assert not os.path.exists(path) and base.discard(df, spark.range(1)) == 0


def test_op2_matches_folded_rows(spark):
    got = {r.conv_id: r for r in registry.QUERIES["op2_chat_format"](spark, SF).collect()}
    probe = "</s>[INST] ok [/INST]"
    said = {-7: [(0, "user", probe), (1, "assistant", probe)]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        said.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    assert set(got) == set(said)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for conv, turns in said.items():
        turns.sort()
        learned = "".join(t for _, role, t in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), sha(learned)) and r.formatted_chars > sum(len(t) for _, _, t in turns)


def test_stages_lose_no_text_of_hostile_rows(spark):
    """Rows without identifier, or with one that others share, survive unless their text is a copy."""
    rng = random.Random(12)
    words = lambda n: " ".join("".join(rng.choice("etaoinsrhld") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    texts = [words(60) for _ in range(30)]
    rows = [(rng.choice([None, 5, 6, k]), t, rng.choice(["en", None]), None, None) for k, t in enumerate(texts)]
    rows += [(None, texts[0], "en", "src", 1), (5, "  ".join(texts[1].split(" ")), "en", None, None), (None, None, None, None, None), (5, "", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.schema == docs.schema
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t)
    assert sorted(norm(r.text) for r in kept.collect()) == sorted(texts)
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert sum(p.start == 0 for p in pieces) == len(texts)
