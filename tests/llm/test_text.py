import hashlib
import random
import zlib

import numpy as np
import pytest
from eventide.llm import bpe, bpe_table, chat, langid, merkle, packing

TEXTS = [None, "", "a", "<|endoftext|>", "a<|endoftext|>b  <|endoftext|>  c", " lead", "trail  ", "a\n\n b\t\tc", "it's I'LL 's", "½²³ª ǅʰ", "日本語 テスト", "a\x85b\xa0c\xa0\xa0d", "\x1c\x1d a\x1f", "naïve café Ü", "x" * 4000, "word " * 3000, "\ufeffa", "é", "مرحبا 123", "👍🏽 ok"]
DOCS = "doc_id long, text string, ids string, block int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], DOCS)


def library_ids(texts):
    tok = bpe.library_tokenizer(bpe.default_vocabulary())
    return [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_equal_the_library():
    texts = TEXTS + long_texts()
    assert [x.tolist() for x in bpe.encode_texts([t or "" for t in texts], bpe.default_vocabulary())] == library_ids(texts)


def test_fast_path_agrees_on_every_ordinary_character():
    usual = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), 0x20AC] if not bpe._UNUSUAL.search(chr(c))]
    texts = [f for c in usual for f in (f"a{c}b", f" {c} {c}1", f"{c}{c} x{c}", f"!{c}?\n a{c}")]
    assert [x.tolist() for x in bpe.encode_texts(texts, bpe.default_vocabulary())] == library_ids(texts)


def test_word_split_agrees_with_the_library_on_every_ordinary_character():
    tok, path = bpe.library_tokenizer(bpe.default_vocabulary()), bpe.default_vocabulary()
    usual = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), 0x20AC] if not bpe._UNUSUAL.search(chr(c))]
    for c in usual:
        for text in (f"a{c}b", f" {c} {c}1", f"{c}{c} x{c}", f"!{c}?\n a{c}", f"'{c}s 's\t {c}\n\n"):
            assert bpe_table.split_words(text, path) == [text[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(text)], repr(text)


def long_texts():
    """Texts of over a million characters: words, one unbroken word, characters of every kind."""
    rng = random.Random(6)
    return ["".join(rng.choice(["the ", "naïve ", "日本 ", "123 ", "\n\n", "  ", "x'll ", "👍 "]) for _ in range(250_000)), "ab" * 500_000 + " end", " ".join(f"w{i}" for i in range(180_000))]


def test_distinct_word_table_round_trip(spark):
    texts = TEXTS + long_texts()
    want = library_ids(texts)
    for block in (1 << 24, 2000):
        ids = bpe_table.encode_documents(frame(spark, texts), block_bytes=block)
        assert {r.doc_id: r.ids for r in ids.collect()} == dict(enumerate(want))
        assert {r.doc_id: r.decoded for r in bpe_table.decode_documents(ids).collect()} == {i: t or "" for i, t in enumerate(texts)}
        digests = {r.doc_id: r for r in bpe_table.round_trip_documents(frame(spark, texts), block_bytes=block).collect()}
        assert sorted(map(tuple, bpe_table.round_trip_digests(ids).collect())) == sorted(map(tuple, digests.values()))
        for i, x in enumerate(want):
            assert (digests[i].n_tokens, digests[i].ids_sha256) == (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest())
            assert digests[i].decoded_sha256 == hashlib.sha256((texts[i] or "").encode()).hexdigest()
    assert bpe_table.round_trip_documents(frame(spark, [])).count() == 0
    twice = frame(spark, ["same text"]).union(frame(spark, ["same text"]))
    assert [r.n_tokens for r in bpe_table.round_trip_documents(twice).collect()] == [2, 2]


def test_decoding_joins_ids_with_pieces(spark):
    df = spark.createDataFrame(list(enumerate(library_ids(TEXTS))), "doc_id long, ids array<int>")
    out = bpe_table.decode_documents(df)
    assert {r.doc_id: r.decoded for r in out.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    tok = bpe.library_tokenizer(bpe.default_vocabulary())
    odd = [[200, 12], [], [35000, 160, 161, 35000], [160], [None, 12, None], None]
    some = spark.createDataFrame(list(enumerate(odd)), "doc_id long, ids array<int>")
    assert [r.decoded for r in sorted(bpe_table.decode_documents(some).collect())] == [tok.decode([i for i in x or [] if i is not None], skip_special_tokens=False) for x in odd]
    with pytest.raises(Exception, match="vocabulary lacks"):
        bpe_table.decode_documents(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>")).collect()


def check_packs(pieces, texts, max_len):
    ids = [x + [1] for x in library_ids(texts)]
    seen, sequences = {}, {}
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
        seen.setdefault(p.doc_id, []).append((p.start, p.length))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for d, x in enumerate(ids):
        at = 0
        for start, length in sorted(seen[d]):
            assert start == at
            at += length
        assert at == len(x)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= max_len


def test_packing_places_every_id_once(spark):
    texts = TEXTS + [f"text {i} " * (i % 40) for i in range(200)]
    for max_len, buckets in ((64, 3), (2048, 4096)):
        check_packs(packing.pack(frame(spark, texts), max_len=max_len, buckets=buckets).collect(), texts, max_len)
    assert packing.pack(frame(spark, [])).count() == 0


def test_packing_repeated_rows(spark):
    df = frame(spark, ["same words here"]).union(frame(spark, ["same words here"]))
    rows = packing.pack(df).collect()
    assert len(rows) == 2 and len({(r.sequence_id, r.offset) for r in rows}) == 2


def test_shortest_pack_first_keeps_the_histogram():
    rng = random.Random(2)
    hist = {rng.randrange(1, 65): rng.randrange(1, 500) for _ in range(40)}
    back = {}
    for pattern, count in packing.shortest_pack_first(hist, 64):
        assert sum(n * c for n, c in pattern) <= 64 and count > 0
        for n, c in pattern:
            back[n] = back.get(n, 0) + c * count
    assert back == hist


def test_language_id_learns_and_handles_edges(spark):
    rng = random.Random(4)
    stems = {"en": ["the", "and", "thing", "ing"], "de": ["und", "der", "schütz", "keit"], "fr": ["le", "été", "eaux", "que"]}
    make = lambda lang: " ".join(rng.choice(stems[lang]) + rng.choice(["", "s", "a"]) for _ in range(40))
    rows = [(i, make(lang), lang, 0.5) for i, lang in enumerate(["en", "de", "fr"] * 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    net = langid.train(df)
    probes = [(0, make("de")), (1, None), (2, ""), (3, "12 34 !!"), (4, make("fr") * 400), (5, make("en")), (5, make("en"))]
    out = langid.predict(spark.createDataFrame(probes, "doc_id long, text string"), net).collect()
    assert [r.lang_pred for r in sorted(out, key=lambda r: r.doc_id)] == ["de", "und", "und", "und", "fr", "en", "en"]
    assert all(0 <= r.score <= 1 for r in out) and out[0].held_out is False
    assert langid.train(df.where("false")) is None
    assert [r.lang_pred for r in langid.predict(spark.createDataFrame(probes[:1], "doc_id long, text string"), None).collect()] == ["und"]
    assert langid.predict(df.where("false"), net).count() == 0
    kept = langid.keep_identified(spark.createDataFrame([(*p, "z") for p in probes], "doc_id long, text string, lang string"), net, 0.35)
    assert kept.columns == ["doc_id", "text", "lang"] and kept.count() == 4


def slow_probabilities(net, text):
    """The forward pass of a whole text, one window, position and filter at a time."""
    data, total, mean = text.encode(), 0, np.zeros(len(net.labels))
    for at in range(0, max(1, len(data)), net.window):
        part = data[at : at + net.window]
        rows = [net.embedding[c] for c in part] + [net.embedding[256]] * (net.window - len(part))
        best = np.full(net.filters.shape[1], -np.inf)
        for i in range(net.window - 3):
            best = np.maximum(best, np.concatenate(rows[i : i + 4]) @ net.filters)
        z = np.tanh(best + net.filter_bias) @ net.head + net.head_bias
        p = np.exp(z - z.max())
        mean += len(part) * p / p.sum()
        total += len(part)
    return mean / total


def test_language_id_predictions_match_a_plain_loop(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = langid.train(docs)
    texts = [r.text for r in docs.where("text is not null").orderBy("doc_id").limit(25).collect()] + ["a", "é", "word " * 300]
    out = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()
    for r in out:
        p = slow_probabilities(net, texts[r.doc_id])
        if any(c.isalpha() for c in texts[r.doc_id]):
            assert r.score == pytest.approx(p.max(), abs=1e-4) and (r.lang_pred == net.labels[int(p.argmax())] or np.ptp(np.sort(p)[-2:]) < 1e-3)


def test_language_id_of_held_out_documents(spark):
    from eventide.llm import registry

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    out = registry.op1_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    right, n = out.selectExpr("count_if(lang = lang_pred)", "count(*)").first()
    assert n > 200 and right / n >= 0.95


def test_language_id_learns_every_language_and_only_bounded_windows(spark):
    rng = random.Random(5)
    rows = [(f"{chr(97 + k % 26) * 3}{chr(97 + k // 26) * 3} " * rng.randrange(5, 80), f"l{k:02d}") for k in range(80) for _ in range(2)]
    rows += [("copied text " * 30, "l00")] * 500 + [(None, "l01"), ("x", None), ("", "l02")]
    df = spark.createDataFrame(rows, "text string, lang string")
    windows, labels = langid.labelled_windows(df, "text", "lang", 50, 256)
    assert set(labels) == {f"l{k:02d}" for k in range(80)} and max(map(labels.count, set(labels))) <= 100
    every, _ = langid.labelled_windows(df, "text", "lang", 10**6, 256)
    whole = {t.encode()[i : i + 256] for t, lang in rows if t and lang for i in range(0, len(t.encode()), 256)}
    assert set(every) == whole and set(windows) < whole
    assert len(langid.train(df).labels) == 80


@pytest.mark.parametrize("text", ["", "<|im_start|>", "<\\|im_end|>", "</s>[INST] ok [/INST]", "<<SYS>><</SYS>>", "a\\b<s>", "<" * 5 + "s>", "[\\\\INST]", "é\n\n"])
def test_chat_escape_is_reversible(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROL)
    for role in ("user", "we\\ird\nrole<s>"):
        assert chat.parse_turn(chat.render_turn(role, text)[0]) == (role, text)


def test_chat_folds_events(spark):
    log = [
        (1, 2, 0, "open", "assistant", None), (1, 2, 1, "delta", None, "draft"), (1, 2, 2, "regenerate", None, None), (1, 2, 3, "delta", None, "fi"), (1, 2, 4, "delta", None, "nal"),
        (1, 1, 0, "message", "user", "hello"), (1, 1, 9, "edit", None, "hello <s>"), (1, 3, 0, "message", "user", "gone"), (1, 3, 1, "delete", None, None),
        (2, 0, 0, "message", "assistant", None), (2, 0, 0, "message", "assistant", None), (None, None, None, "message", None, "x"),
    ]
    events = spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string")
    turns = chat.format_conversations(events)
    got = {}
    for r in turns.orderBy("conv_id", "message", "ordinal").collect():
        got.setdefault(r.conv_id, []).append(chat.parse_turn(r.formatted))
    assert got == {1: [("user", "hello <s>"), ("assistant", "final")], 2: [("assistant", ""), ("assistant", "")], None: [("", "x")]}
    d = {r.conv_id: r for r in chat.read_back(turns).collect()}
    assert d[1].loss_chars == 5 and d[1].loss_sha256 == hashlib.sha256(b"final").hexdigest() and d[1].n_turns == 2
    assert d[1].turns_sha256 == hashlib.sha256(b"user\nhello <s>\nassistant\nfinal\n").hexdigest()
    assert chat.read_back(chat.format_conversations(events.where("false"))).count() == 0


def test_chat_folds_random_logs_like_a_plain_loop(spark):
    rng = random.Random(9)
    log, want = [], {}
    for conv in (*range(12), None):
        for message in range(rng.randrange(1, 40 if conv == 3 else 6)):
            role, text, alive = rng.choice(["user", "assistant", "sys<s>\n"]), "", True
            log.append((conv, message, 0, "open", role, None))
            for seq in range(1, rng.randrange(1, 9)):
                kind = rng.choice(["delta", "delta", "delta", "edit", "regenerate", "delete" if rng.random() < 0.2 else "delta"])
                part = rng.choice(["a", "</s>", "<|im_", "end|>", "\\", "é\n", None]) if kind in ("delta", "edit") else None
                log.append((conv, message, seq, kind, None, part))
                if alive:
                    text = text + (part or "") if kind == "delta" else (part or "")
                    alive = kind != "delete"
                if not alive:
                    break
            if alive:
                want.setdefault(conv, []).append((role, text))
    rng.shuffle(log)
    turns = chat.format_conversations(spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string"))
    got = {r.conv_id: r for r in chat.read_back(turns).collect()}
    assert set(got) == set(want)
    for conv, said in want.items():
        r, learned = got[conv], "".join(t for role, t in said if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(said), len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in said).encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.render_turn(*t)[0]) for t in said)


def slow_leaves(text):
    import re

    return {hashlib.md5(x.encode()).hexdigest()[:12] + f"{len(x):02d}" for line in text.split("\n") for x in re.findall(merkle.LEAF, line)}


def slow_likeness(a, b):
    a, b = slow_leaves(a), slow_leaves(b)
    weight = lambda s: sum(int(x[12:]) for x in s)
    return 2 * weight(a & b) / (weight(a) + weight(b)) if a or b else 1.0


def test_merkle_edges_and_edit_location(spark):
    texts = {0: "a b c", 1: "first par\nsecond par\n\nthird par", 2: None, 3: "", 4: "p" * 200_000, 5: "first par\nsecond par\n\nthird par", 6: "\n\n\n"}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, k int")
    rows = {r.doc_id: r for r in merkle.fingerprint_edits(df).collect()}
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        t, nxt = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert (rows[d].n_chars, rows[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert rows[d].near_edited == pytest.approx(slow_likeness(t, edited)) and rows[d].near_next == pytest.approx(slow_likeness(t, nxt))
        assert (rows[d].fingerprint == rows[d].edited_fingerprint) == (t == edited)
        assert rows[d].fingerprint[64:] == "".join(sorted(slow_leaves(t)))
    assert rows[1].fingerprint == rows[5].fingerprint and rows[2].fingerprint == rows[3].fingerprint != rows[6].fingerprint
    # the node of "second par" ends a section; the edit begins at the blank line after it
    assert rows[1].first_edit == "2/1" and rows[3].near_edited == 1.0
    assert merkle.fingerprint_edits(df.where("false")).count() == 0
    one = spark.createDataFrame([(None, "only")], "doc_id long, text string")
    assert merkle.fingerprint_edits(one).first().near_next == 1.0


def test_texts_whose_leaves_look_alike_have_different_fingerprints(spark):
    """These pairs agree in the published digits of their only leaf: the roots differ all the same."""
    alike = [("00000000000006920756", "00000000000013147938"), ("00000000000016005617", "00000000000028798719")]
    for a, b in alike:
        assert hashlib.md5(a.encode()).hexdigest()[:12] == hashlib.md5(b.encode()).hexdigest()[:12]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([x for pair in alike for x in pair])], "doc_id long, text string")
    got = [r.fingerprint for r in merkle.fingerprints(df).collect()]
    assert len(set(got)) == 4 and len(set(f[64:] for f in got)) == 2


def test_merkle_likeness_follows_from_fingerprints_and_survives_shifts(spark):
    rng = random.Random(3)
    prose = lambda n, end: "".join("".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randrange(2, 9))) + rng.choice([" ", " ", " ", ". ", end]) for _ in range(n))
    line, page = prose(300, " "), prose(900, "\n")
    cases = [(line, "x" + line, 0.9), (page, page[:2000] + "y" + page[2000:], 0.98), (page, page[: len(page) // 2] + prose(450, "\n"), 0.4), (page, prose(900, "\n"), 0.0), (page, page, 1.0), ("", "", 1.0), ("", page, 0.0)]
    df = spark.createDataFrame([(i, t) for i, (a, b, _) in enumerate(cases) for t in (a, b)], "doc_id long, text string")
    prints = {}
    for r in merkle.fingerprints(df.select("doc_id", "text").withColumn("doc_id", df.doc_id)).collect():
        prints.setdefault(r.doc_id, []).append(r.fingerprint)
    pairs = spark.createDataFrame([(i, *p) for i, p in prints.items()], "i long, a string, b string")
    got = {r.i: r.near for r in pairs.select("i", merkle.likeness(pairs.a, pairs.b).alias("near")).collect()}
    for i, (a, b, least) in enumerate(cases):
        assert got[i] == pytest.approx(slow_likeness(a, b)) and got[i] >= least and (least or got[i] < 0.05)
    sections = merkle.fingerprints(df).where("doc_id = 1").first().sections
    assert len(sections) > 3


@pytest.mark.parametrize("ids", [[i * i * i for i in range(200)], [None] * 150 + list(range(50)), [7] * 100 + [None] * 60 + [9, 9, 11], [5] * 120])
def test_merkle_next_document_over_many_parts(spark, ids):
    texts = [f"t{i % 40 if i % 3 else 0}" for i in range(len(ids))]  # a third of the texts is one text
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    from pyspark.sql import functions as F

    keyed = [(r.doc_id, r.text, r.h) for r in df.select("*", F.shiftright(F.xxhash64("text"), 11).alias("h")).collect()]
    down = sorted(keyed, key=lambda r: (r[0] is not None, r[0] or 0, r[2]), reverse=True)
    want = sorted(str((a[0], a[1], b[1])) for a, b in zip(down, down[1:] + down[:1]))
    for part_bytes in (300, 1 << 20):
        got = merkle.with_next(df.repartition(3), "doc_id", "text", part_bytes=part_bytes)
        assert sorted(str(tuple(r)) for r in got.collect()) == want
    sizes = [r[1] for r in merkle.seated(df, "doc_id", "text", part_bytes=300).groupBy("part").count().collect()]
    assert len(sizes) > 8 and max(sizes) <= 40  # no part grows with the group of one identifier or one text
