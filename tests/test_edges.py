"""Queries against their DuckDB twins on small tables with rows that the driver's smallest tables lack."""

import datetime as dt
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from eventide import catalog
from eventide.operators import vectors


def both(spark, folder, name, key, **tables):
    """Rows of the query and of its SQL by key, nulls as None."""
    con = duckdb.connect()
    for t, pdf in tables.items():
        pdf.to_parquet(f"{folder}/{t}.parquet", index=False)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    got, want = catalog.queries()[name](spark, str(folder)).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    plain = lambda df: {r[key]: {c: None if pd.isna(v) else v for c, v in r.items()} for r in df[sorted(want.columns)].to_dict("records")}
    assert len(got) == len(want)
    return plain(got), plain(want)


def test_garman_klass_of_invalid_bars(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    values = {0: [0.0, 5.0, 2.0], 1: [3.0, 9.0, 1.0, 4.0], 2: [0.0], 3: [2.0, 2.0], 4: [1.0, 8.0]}
    rows = [(h * 10 + i, at + dt.timedelta(hours=h, minutes=i), 1, "view", v) for h, vs in values.items() for i, v in enumerate(vs)]
    events = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value"]).astype({"ts": "datetime64[us]"})
    got, want = both(spark, tmp_path, "vol_garman_klass", "ts", events=events)
    assert got == want
    first = got[min(got)]
    assert first["gk"] is None and first["gk_floor"] == 0.0


def test_family_c_rounds_as_its_sql(spark, tmp_path):
    # 11 / 384 and 1 / 300 differ by 0.0253125; as doubles by an ulp less
    text = lambda hits, n: " ".join(["with"] * hits + ["x"] * (n - hits))
    documents = pd.DataFrame([(i, text(h, n), "en", "s", n) for i, (h, n) in enumerate([(11, 384), (1, 300), (11, 384), (0, 5), (1, 640)])], columns=["doc_id", "text", "lang", "source", "n_chars"])
    got, want = both(spark, tmp_path, "txt_family_c", "doc_id", documents=documents)
    assert got == want
    assert got[1]["change"] == -0.025313 and got[2]["change"] == 0.025313


def corpus(n, words, seed):
    """Texts of words drawn by Zipf's law; null and empty texts, and rows without a language."""
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    names = np.array(["".join(letters[[i // 676 % 26, i // 26 % 26, i % 26]]) for i in range(words)])
    share = 1 / np.arange(1, words + 1)
    texts = [" ".join(rng.choice(names, rng.integers(5, 400), p=share / share.sum())) for _ in range(n)]
    texts[3], texts[5], texts[8] = None, "", "1 2 3"
    lang = [[None, "en", "de"][k] for k in rng.choice(3, n, p=[0.1, 0.5, 0.4])]
    return pd.DataFrame({"doc_id": np.arange(n, dtype=np.int64) * 3, "text": texts, "lang": lang, "source": "s", "n_chars": [len(t or "") for t in texts]})


@pytest.mark.parametrize("name,column,digits", [("txt_novelty_window", "novelty", 6), ("txt_novelty_prev", "novelty", 6), ("txt_novelty_z", "z", 4)])
def test_novelty_over_chunks_and_blocks(spark, tmp_path, monkeypatch, name, column, digits):
    monkeypatch.setattr(vectors, "CHUNK", 20_000)
    monkeypatch.setattr(vectors, "BLOCK", 7)
    got, want = both(spark, tmp_path, name, "doc_id", documents=corpus(400, 3000, 1))
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert (got[k][column] is None) == (w[column] is None) and (w[column] is None or abs(got[k][column] - w[column]) <= 1.01 * 10**-digits), k
    plan = catalog.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"(Join|hashpartitioning).*\bterm#", plan)  # vectors travel as rows, not term by term


def test_vocabulary_by_bounds(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 20_000)
    for pdf, bounded in ((corpus(300, 2000, 2), True), (pd.DataFrame({"doc_id": range(300), "text": [" ".join(chr(97 + i % 26) * 2 + chr(97 + i // 26) * 2 + chr(97 + j % 26) * 2 + chr(97 + j // 26) for j in range(60)) for i in range(300)]}), False)):
        pdf = pd.concat([pdf, pdf.assign(doc_id=pdf.doc_id + 100_000)])
        df = spark.createDataFrame(pdf[["doc_id", "text"]].astype({"text": object}).where(pdf[["doc_id", "text"]].notna(), None))
        total, texts = Counter(), Counter()
        for t in pdf.text:
            w = re.findall("[a-z][a-z]+", t) if isinstance(t, str) else []
            terms = Counter(w) + Counter(f"{a} {b}" for a, b in zip(w, w[1:]))
            total.update(terms)
            texts.update(terms.keys())
        best = sorted((t for t in total if texts[t] >= 2), key=lambda t: (-total[t], t))[:50]
        found = vectors.candidates(df, "doc_id", "text", 2, 2, 50)
        assert set(best) <= set(found) and (len(found) < len(total) / 10)
        rows, idf = vectors.tfidf_vectors(df, "doc_id", "text", 2, max_features=50)
        assert {found[k] for k in np.flatnonzero(idf)} == set(best) and rows.count() == len(pdf)
        assert bounded or found == sorted(best)  # nothing stands out: all terms are counted
