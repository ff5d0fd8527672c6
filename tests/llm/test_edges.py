"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns: defined results everywhere."""

from __future__ import annotations

import hashlib
import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, exact_dedup, kneser_ney, language_id, license_scan, near_dedup, packing, secrets, sharding, warc

LONG = "alpha beta gamma delta " * 20_000
ROWS = [
    (1, None, "en", "a", 1), (2, "", "en", "a", 1), (None, "some words that stand here alone today", None, None, 1), (4, "Same text.", "fr", "b", 1),
    (5, "same TEXT.", "fr", "b", 1), (5, "same TEXT.", "fr", "b", 1), (6, LONG, "de", None, 1), (7, "1234 !!", "de", "b", 1), (8, "É accents É.", "fr", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, _norm int"
CLASH = "doc_id long, text string, lang string, source string, gone string, norm string, keep_id int, ids string, _bucket int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clash(spark):
    return spark.createDataFrame([(1, "x y z", "en", "s", "g", "n", 9, "i", 3), (2, "X Y Z", "en", "s", "g", "n", 9, "i", 3), (3, "other words", "en", "s", None, None, None, None, None)], CLASH)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_exact(docs, none, clash):
    rows = exact_dedup.exact_groups(docs).collect()
    assert len(rows) == len(ROWS)
    found = by_id(exact_dedup.exact_groups(docs))
    assert (found[1].keep_id, found[1].group_size, found[1].kept) == (2, 2, False) and found[2].kept
    assert (found[4].keep_id, found[4].group_size, found[4].kept) == (5, 3, False) and found[None].kept and found[None].keep_id is None
    assert found[1].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert sorted(r.doc_id or 0 for r in exact_dedup.drop_exact_copies(docs).collect()) == [0, 2, 5, 6, 7, 8]
    assert exact_dedup.exact_groups(none).count() == exact_dedup.drop_exact_copies(none).count() == 0
    left = exact_dedup.drop_exact_copies(clash)
    assert left.columns == clash.columns and sorted(r.doc_id for r in left.collect()) == [2, 3]


def test_texts_that_share_a_digest_stay_apart(docs, monkeypatch):
    """With a digest of one bit, only content can tell texts apart."""
    real = exact_dedup.F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: exact_dedup.F.substring(real(c, n), 1, 1).substr(1, 0))
    rows = by_id(exact_dedup.exact_groups(docs))
    assert {k: (r.keep_id, r.group_size) for k, r in rows.items()} == {1: (2, 2), 2: (2, 2), None: (None, 1), 4: (5, 3), 5: (5, 3), 6: (6, 1), 7: (7, 1), 8: (8, 1)}


def test_near(docs, none, clash):
    found = by_id(near_dedup.near_duplicates(docs))
    assert found[4].class_id == found[5].class_id == 4 and found[4].kept and not found[5].kept
    assert found[None].class_id is None and found[None].kept and all(found[k].class_id == k for k in (1, 2, 6, 7, 8))
    assert near_dedup.near_duplicates(none).count() == 0
    assert {k: r.class_id for k, r in by_id(near_dedup.near_duplicates(clash)).items()} == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("sizes", [[3000], [2900, 60, 30, 10]])
def test_near_frequencies_look_only_at_shingles_that_may_be_common(spark, monkeypatch, sizes):
    """Also where a task, or the last part of what it holds, has few texts."""
    rng = np.random.default_rng(8)
    own = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 30)) for _ in range(3000)]
    texts = [f"{t} one phrase that some share" if k % 500 == 0 else t for k, t in enumerate(own)]
    parts = [spark.createDataFrame([(t,) for t in own], "text string").coalesce(1) for own in np.split(np.array(texts, object), np.cumsum(sizes)[:-1])]
    docs = parts[0]
    for part in parts[1:]:
        docs = docs.union(part)
    real, looked_at = near_dedup.bitmap_of, []
    monkeypatch.setattr(near_dedup, "HELD", 20_000)
    monkeypatch.setattr(near_dedup, "bitmap_of", lambda bit: looked_at.append(bit.count()) or real(bit))
    monkeypatch.setattr(type(docs), "coalesce", lambda self, n: self)
    weights = near_dedup.inverse_frequencies(docs)
    assert len(weights.keys) == 1 and np.allclose(weights.values, np.log1p(3000 / 6)) and looked_at[0] < 100


def test_workers_hold_little_text_at_once(spark, tmp_path, monkeypatch):
    """Whatever a table's row groups are, texts come to workers in batches of about ``BATCH_BYTES``."""
    seen, real = str(tmp_path), type(spark.range(1)).mapInArrow

    def watched(df, run, schema, *args):
        def noted(batches):
            def each():
                for batch in batches:
                    with open(f"{seen}/{batch.nbytes}", "w"):
                        yield batch

            return run(each())

        return real(df, noted, schema, *args)

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", watched)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    wide = spark.range(0, 1500, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("some words "), F.col("id").cast("string")), 500).alias("text"), F.lit("en").alias("lang"))
    most = 4 << 20  # twice ``BATCH_BYTES``
    for stage in (near_dedup.drop_near_copies, lambda docs: language_id.rows_with_language(docs, language_id.train(docs))):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        assert stage(wide).count() > 0
        sizes = [int(x) for x in os.listdir(seen)]
        assert max(sizes) <= most and min(sizes) < most


def test_language_counts_take_little_memory():
    texts = pa.array([f"some words of text {k}" for k in range(300)])
    tracemalloc.start()
    for lo, hi in language_id._parts(texts):
        language_id.features(texts.slice(lo, hi - lo), language_id.DIMENSIONS)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16e6


def test_near_group_whose_members_differ_among_themselves(spark):
    """A hub with many edited copies, some beyond the threshold: classes as by all pairs."""
    from test_contracts import near_classes

    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 120):
        own = list(base)
        for at in rng.choice(150, 1 + k % 6, replace=False):
            own[at] = f"e{k}x{at}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {k: r.class_id for k, r in by_id(near_dedup.near_duplicates(docs)).items()} == {k: v for (k, _), v in near_classes(rows).items()}


ONE_ID = [
    (3, "alpha beta gamma delta epsilon zeta eta theta"), (5, "alpha beta gamma delta epsilon zeta eta theta!"), (5, "a totally other text of many words that nobody else has"),
    (7, "ALPHA beta gamma delta epsilon zeta eta theta"), (None, "no id and no copy of this text anywhere in here"), (None, "alpha beta gamma delta epsilon zeta eta theta"),
    (7, "words of an item stand in this text"), (7, "nothing stands in this one"), (None, "words of an item stand here too"), (8, None), (8, ""),
]


def test_rows_are_told_by_id_and_text(spark):
    """Of an id with several texts only the copies and the contaminated go; null ids are rows like others."""
    docs = spark.createDataFrame(ONE_ID, "doc_id long, text string")
    got = lambda df: sorted(map(tuple, df.collect()), key=str)
    exact = [r for r in ONE_ID if r not in [(3, ONE_ID[0][1]), (None, ONE_ID[0][1])]]
    left = got(exact_dedup.drop_exact_copies(docs))
    assert [r for r in left if r[0] != 8] == sorted((r for r in exact if r[0] != 8), key=str) and sum(r[0] == 8 for r in left) == 1
    gone = [(5, ONE_ID[1][1]), (7, ONE_ID[3][1])]
    assert got(near_dedup.drop_near_copies(docs)) == sorted((r for r in ONE_ID if r not in gone), key=str)
    items = spark.createDataFrame([("i", "words of an item")], "item_id string, text string")
    assert got(decontaminate.drop_contaminated(docs, items)) == sorted((r for r in ONE_ID if "words of an item" not in (r[1] or "")), key=str)
    assert got(exact_dedup.drop_exact_copies(spark.createDataFrame([(5, "alpha"), (7, "alpha"), (5, "totally other text")], docs.schema))) == [(5, "totally other text"), (7, "alpha")]


def test_stages_of_the_pipeline_stand_edge_cases(spark, clash, none, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([("i", "words of an item")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = spark.createDataFrame([(*r, "en", "s", 0) for r in ONE_ID] * 2, "doc_id long, text string, lang string, source string, n_chars int")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (none, clash, rows):
            out = stage(spark, docs, str(tmp_path))
            n = out.count()
            assert name == "packing" or out.columns == docs.columns
            assert n == 0 if docs is none else n > 0


def test_hot_keys_are_spread(spark):
    from marlstone.llm.shared import spread_join

    rows = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id % 700 as string)) AS k")
    groups = rows.groupBy("k").count()
    for how in ("inner", "left"):
        out = spread_join(rows, groups.filter("count > 5 OR k = 'hot'"), ["k"], "count", ["id"], how, least=100)
        want = rows.join(groups.filter("count > 5 OR k = 'hot'"), "k", how)
        assert sorted(map(tuple, out.select("id", "k", "count").collect())) == sorted(map(tuple, want.select("id", "k", "count").collect()))


def test_bitmaps_hold_all_that_they_were_given(spark):
    from marlstone.llm.shared import bitmap_of, marked, with_likely

    assert np.flatnonzero(marked(bitmap_of(spark.sql("SELECT explode(array(0L, 1L, 32767L, 32768L, 70000L)) AS b")), np.arange(80_000))).tolist() == [0, 1, 32767, 32768, 70000]
    from pyspark.sql import functions as F

    rows, some = spark.range(3000), spark.range(0, 3000, 50)
    likely = {r.id for r in with_likely(rows, [F.col("id")], some, [F.col("id")], "likely").filter("likely").collect()}
    assert likely >= set(range(0, 3000, 50)) and len(likely) < 600


def test_no_shared_folder_on_a_cluster(monkeypatch):
    from marlstone.llm import shared

    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://somewhere:7077"
            getConf = staticmethod(lambda: Session.conf)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session)


def test_weighted_samples_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(0, 1 << 48, 120, dtype=np.uint64))
    w = rng.uniform(0.5, 5, 120)
    w2 = np.where(rng.random(120) < 0.3, w * rng.uniform(0.3, 3, 120), w)
    one, two = (near_dedup.sampled(np.zeros(120, np.int64), keys, x, 3000)[0] for x in (w, w2))
    assert abs((one == two).mean() - np.minimum(w, w2).sum() / np.maximum(w, w2).sum()) < 0.03


def test_packing(docs, none, clash):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.packed(docs, path).collect()
    size = {}
    for r in rows:
        size.setdefault(r.doc_id, [0, 0])
        size[r.doc_id][0] += r.length
        size[r.doc_id][1] = r.doc_tokens
    assert set(size) == {r[0] for r in ROWS} and size[5][0] == 2 * size[5][1] and all(a == b for k, (a, b) in size.items() if k != 5) and size[1] == [1, 1]
    assert packing.packed(none, path).count() == 0 and packing.packed(clash, path).count() >= 3
    wanted = packing.packed(docs, path, shares={"a": 0.5, "b": 0.5}).collect()
    assert sum(r.length for r in wanted) == sum(r.length for r in rows)


def test_windows_have_the_target_shares(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(k, "word " * 99, "abc"[k % 3]) for k in range(600)], "doc_id long, text string, source string")

    def mixtures(shares):
        mix = {}
        for r in packing.packed(docs, path, shares=shares, window=1000, quantum=50).collect():
            mix.setdefault(r.sequence_id, {}).setdefault(r.source, 0)
            mix[r.sequence_id][r.source] += r.length
        assert sum(sum(m.values()) for m in mix.values()) == 60_000 and all(sum(mix[k].values()) == 1000 for k in range(60))
        return [[mix[k].get(x, 0) for x in "abc"] for k in range(60)]

    near = lambda m, want: all(abs(x - y) <= 100 for x, y in zip(m, want, strict=True))
    # half of all is a until it runs out after 40 windows; b and c are like each other throughout
    m = mixtures({"a": 0.5})
    assert all(near(x, (500, 250, 250)) for x in m[:39]) and all(near(x, (0, 500, 500)) for x in m[41:])
    m = mixtures({"a": 0.001, "c": 0.75, "none": 0.1})
    assert all(near(x, (1, 165, 834)) for x in m[:23]) and sum(x[0] for x in m[:40]) < 300
    m = mixtures({"a": 0.0, "b": 0.5, "c": 0.5})
    assert all(near(x, (0, 500, 500)) for x in m[:40]) and all(x == [1000, 0, 0] for x in m[40:])
    m = mixtures({"a": 1.0})
    assert all(x == [1000, 0, 0] for x in m[:20]) and all(near(x, (0, 500, 500)) for x in m[20:])
    for bad in ({"a": -0.1}, {"a": 0.9, "b": 0.2}):
        with pytest.raises(ValueError):
            packing.packed(docs, path, shares=bad)


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    words, plain = packing.words_of(path), Tokenizer.from_file(path)
    texts = ["Hello  World, it's", "", "é 1"]
    assert not words.by_word and [x.tolist() for x in words.encode(pa.array(texts))] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_tokens_word_by_word_are_those_of_whole_texts():
    import public_tokenizers
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, words = Tokenizer.from_file(path), packing.words_of(path)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aAbé.,!?';:-\x01 \n\t1日<|>́"), st.characters(codec="utf-8")), max_size=40), max_size=5))
    def same(texts):
        assert [x.tolist() for x in words.encode(pa.array(texts, pa.string()))] == [whole.encode(t, add_special_tokens=False).ids for t in texts]

    same()


def test_shards(docs, none, clash):
    rows = sharding.interleaved_shards(docs, 4).collect()
    assert len(rows) == len(ROWS) and {r.size for r in rows if r.doc_id in (1, 2)} == {1}
    assert sharding.interleaved_shards(none).count() == 0 and sharding.interleaved_shards(clash).count() == 3


def test_languages(docs, none, clash):
    found = by_id(language_id.train_and_predict(docs))
    assert found[1].lang_pred == found[2].lang_pred == found[7].lang_pred == "und" and found[1].score == 0 and not found[None].held_out
    assert language_id.train_and_predict(none).count() == 0
    assert {r.lang_pred for r in language_id.train_and_predict(clash).collect()} == {"en"}
    unlabelled = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r.lang_pred for r in language_id.train_and_predict(unlabelled).collect()} == {"und"}
    kept = language_id.rows_with_language(clash, language_id.train(clash))
    assert kept.columns == clash.columns and kept.count() == 3


def test_letters_are_those_of_unicode(spark):
    rows = [(k, t, "en" if k % 2 else "fr") for k, t in enumerate(["½ ² Ⅷ ٣", "½", "²", "ª", "日本", "a1", "!? 12", "Ж"])]
    found = by_id(language_id.train_and_predict(spark.createDataFrame(rows + [(k, "some words", "en") for k in range(20, 40)], "doc_id long, text string, lang string")))
    assert [found[k].lang_pred == "und" for k in range(8)] == [True, True, True, False, False, False, True, False]


def test_many_languages_and_a_brute_force_decoder(spark):
    rng = np.random.default_rng(2)
    names = [f"l{k:02}" for k in range(30)]
    words = {x: ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(40)] for x in names}
    rows = [(k, " ".join(rng.choice(words[names[k % 30]], 30)), names[k % 30]) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, most_languages=10)
    assert model.languages == names[:10]  # all are equally common
    model = language_id.train(docs)
    found = by_id(language_id.predict(docs, model))
    for k, text, _ in rows[:50]:
        counts, _ = language_id.features(pa.array([text]), language_id.DIMENSIONS)
        margin = [float(counts[0] @ model.weights[:, b]) / float(counts[0].sum()) ** 0.5 for b in range(model.code.shape[1])]
        loss = {x: sum(model.trust[i, b] * np.log1p(np.exp(-margin[b] * model.code[i, b])) for b in range(len(margin))) for i, x in enumerate(model.languages)}
        best = min(loss, key=loss.get)
        assert found[k].lang_pred == best and abs(found[k].score - 1 / sum(np.exp(loss[best] - v) for v in loss.values())) < 1e-4
    assert sum(found[k].lang_pred == x for k, _, x in rows) > 880


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 7, 30):
        code = language_id.codewords(n)
        assert len(code) == n and min((code[a] != code[b]).sum() for a in range(n) for b in range(a)) >= n // 2 + 1


def test_quality(docs, none, clash, spark):
    trusted = spark.createDataFrame([(4,), (6,), (8,), (None,)], "doc_id long")
    found = by_id(kneser_ney.quality(docs, trusted))
    assert found[1].perplexity is None and found[1].kept and found[None].kept and len(found) == len({r[0] for r in ROWS})
    assert kneser_ney.quality(none, trusted).count() == 0 and kneser_ney.quality(clash, trusted).filter("kept").count() == 3
    assert kneser_ney.quality(docs, trusted.limit(0)).filter("kept").count() == len(ROWS)


def test_licenses(docs, none, clash, spark):
    found = by_id(license_scan.license_labels(license_scan.scan_licenses(docs)))
    assert found[1].n_words == 0 and found[1].first_word is None and found[1].labels == "" and found[1].score == 0 and found[6].n_words == 80_000
    texts = [
        "Licensed under CC-BY-NC 4.0.", "SPDX-License-Identifier: MIT", "the GNU General Public License, version 3", "GNU Lesser General Public License v2.1, all rights reserved",
        "Redistribution and use in source and binary forms", "commit to the limit", "Released under the Apache License, Version 2.0",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = [r.labels for r in license_scan.license_labels(license_scan.scan_licenses(rows)).orderBy("doc_id").collect()]
    assert labels == ["cc-by,cc-by-nc-4.0", "mit", "gpl,gpl-3.0", "gpl,lgpl-2.1,reserved", "bsd", "", "apache-2.0"]
    assert len(license_scan.rules()) > 200 and license_scan.scan_licenses(none).count() == 0 and license_scan.scan_licenses(clash).count() == 3


def test_the_keyword_gate_hides_nothing(spark):
    """Rules on whole texts without a gate find what they find behind it: sample texts, and strings of each rule."""
    import re

    from marlstone.llm import queries as q
    from marlstone.llm.words import PATTERN

    scanner = license_scan.Scanner(license_scan.rules())
    texts = [r.text for r in q.table(spark, "/root/testdata/sf0.001", "documents").collect()]
    for r in scanner.rules:
        full = re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", r.pattern)).replace("[sc]", "s").replace(r"\d\d", "24").replace("[123]", "2").replace(".{1,80}?", "some").replace("?", "")
        short = re.sub(r"\(\?:[^()]*\)\?", "", r.pattern.replace(license_scan.GRANT, "licensed under ").replace(" ?", "")).replace("[sc]", "c").replace("?", "")
        texts += [f"x {full} y", f"x {short} y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, seen = by_id(license_scan.scan_licenses(docs)), set()
    for k, text in enumerate(texts):
        joined = " ".join(re.findall(PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        places, kept = scanner.scan(joined, scanner.keywords)
        assert [(x.start, x.end, x.label) for x in found[k].base] == [x[:3] for x in places]
        assert [(x.start, x.end, x.label) for x in found[k].detections] == [x[:3] for x in kept]
        seen |= {x[3] for x in kept}
    assert len(seen) > 0.8 * len(scanner.rules)


def test_contamination(docs, none, clash, spark):
    items = spark.createDataFrame([(1, "Same text"), (2, None), (3, ""), (4, "words that stand"), (5, "same TEXT!")], "item_id long, text string")
    found = by_id(decontaminate.contaminated_words(decontaminate.contamination(docs, items)))
    assert (found[4].n_hit, found[4].n_items) == (2, 2) and found[4].items_sha256 == hashlib.sha256(b"1,5").hexdigest() and found[None].n_hit == 3
    assert not found[1].contaminated and found[6].n_words == 80_000
    assert decontaminate.contamination(none, items).count() == 0 and decontaminate.contamination(clash, items.limit(0)).filter("size(hits) > 0").count() == 0


def test_index_in_many_blocks(docs, spark, monkeypatch):
    items = spark.createDataFrame([(k, f"item number {k} alpha beta gamma delta alpha beta gamma delta alpha beta") for k in range(5)] + [(9, "gamma delta alpha beta gamma")], "item_id long, text string")
    want = sorted(map(str, decontaminate.contaminated_words(decontaminate.contamination(docs, items)).collect()))
    monkeypatch.setattr(decontaminate, "AT_ONCE", 1000)
    assert sorted(map(str, decontaminate.contaminated_words(decontaminate.contamination(docs, items, block_words=3)).collect())) == want


def test_phrase_and_proximity(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "one two x three four y five six"), (3, "six five four three two one"), (4, "one two"), (5, "three four five six")], "doc_id long, text string")
    items = spark.createDataFrame([("q", "one two three four five six")], "item_id string, text string")
    found = by_id(decontaminate.contamination(docs, items, slop=2))
    assert found[1]["items"] == ["q"] and found[1].hits == [[0, 6]] and found[2]["near_items"] == ["q"] and not found[2].hits
    assert all(not found[k]["items"] and not found[k]["near_items"] for k in (3, 4, 5))


def test_proximity_by_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcdef"), rng.integers(0, 25))) for _ in range(60)]
    items = [" ".join(rng.choice(list("abcdef"), 4)) for _ in range(12)]
    docs, asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = by_id(decontaminate.contamination(docs, asked, slop=1, block_words=200))
    for k, text in enumerate(texts):
        w, near = text.split(), set()
        for i, item in enumerate(items):
            t = item.split()
            exact = any(w[s : s + 4] == t for s in range(len(w)))
            if not exact and any(all(any(0 <= p < len(w) and w[p] == x for p in range(s + o - 1, s + o + 2)) for o, x in enumerate(t)) for s in range(-5, len(w) + 5)):
                near.add(str(i))
        assert set(found[k]["near_items"]) == near


def test_secrets(docs, none, clash, spark):
    model = secrets.train(secrets.labelled_strings(spark, 2000))
    scan = lambda df: by_id(secrets.secret_counts(secrets.find_secrets(df, model)))
    found = scan(docs)
    assert found[1].spans == "" and found[1].base_sha256 == hashlib.sha256(b"").hexdigest() and len(found) == len({r[0] for r in ROWS})
    key = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
    rows = [(1, f"😀 key {key} and getUserAccountSettingsById"), (2, 'x password: "short" token = abcdefghijkl'), (3, "-" * 60 + " " + "a" * 16), (4, "AKIA" + "Q7" * 8), (5, "token=secret:abcdefghijklmnop")]
    found = scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found[1].spans == "random:6:46" and found[2].spans == "assign:20:40" and found[3].spans == "hex:61:77" and found[4].spans == "access:0:20"
    assert found[5].n_assign == 0
    assert secrets.find_secrets(none, model).count() == 0 and secrets.find_secrets(clash, model).count() == 3


def test_secrets_joined_to_ordinary_text(spark):
    model = secrets.train(secrets.labelled_strings(spark))
    rng = np.random.default_rng(7)
    base62 = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    keys = ["".join(rng.choice(base62, 24)) for _ in range(200)]
    before = ["", "services/hooks/incoming/", "customer_account_session_", "api/v1/customers/account/session/", "0123456789abcdef0123/"]
    texts = [f"see {b}{k} there" for b in before for k in keys] + [f"{k}/customer/account/session/{k[::-1]}" for k in keys]
    found = secrets.secret_counts(secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)).collect()
    whole = {r.doc_id: {tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("random")} for r in found}
    for at, b in enumerate(before):
        assert sum((4 + len(b), 28 + len(b)) in whole[200 * at + k] for k in range(200)) >= 195, b
    size = len(texts[-1])
    assert sum({(0, 24), (size - 24, size)} <= whole[1000 + k] for k in range(200)) >= 190
    plain = ["customer_account_session_handler", "api/v1/customers/account/session/2024", "getUserAccountSettingsById", "MAXIMUM_BATCH_SIZE_LIMIT_2024", "-" * 40, "4" * 40]
    found = secrets.secret_counts(secrets.find_secrets(spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string"), model))
    assert found.filter("n_random > 0").count() == 0


def test_secrets_held_out(spark):
    """On names of the standard library, which the samples don't hold, and on other random strings than theirs."""
    import ast
    import base64
    import json
    import sys

    names = set()
    for module in (ast, json, base64, pytest, np, pa, hashlib, sys.modules["asyncio"] if "asyncio" in sys.modules else ast, spark.__class__, __import__("unittest"), __import__("socket"), __import__("ssl"), __import__("pyspark.sql.functions", fromlist=["x"])):
        names |= {n for n in dir(module) if len(n) >= 4}
    names = sorted(names)
    rng = np.random.default_rng(11)
    plain = [n for n in names if len(n) >= 20] + ["_".join(rng.choice(names, 3)) for _ in range(600)] + ["/".join(rng.choice(names, 4)) for _ in range(300)]
    keys = [base64.b64encode(rng.bytes(24)).decode() for _ in range(300)] + [rng.bytes(20).hex().upper() for _ in range(300)] + ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 32)) for _ in range(300)]
    model = secrets.train(secrets.labelled_strings(spark))
    flagged = {r.doc_id for r in secrets.secret_counts(secrets.find_secrets(spark.createDataFrame(list(enumerate(plain + keys)), "doc_id long, text string"), model)).filter("n_random > 0").collect()}
    wrong, right = sum(k < len(plain) for k in flagged), sum(k >= len(plain) for k in flagged)
    print(len(plain), len(keys), wrong, right)
    assert wrong <= 0.03 * len(plain) and right >= 0.95 * len(keys)


def test_warc(spark, tmp_path):
    rows = [(1, "http://a", "x\r\n\r\ny"), (2, None, "x\r\n\r\ny"), (3, "u v\n", None), (4, "b", ""), (5, "c", "WARC/1.1\r\n\r\n"), (9, "http://a", "x\r\n\r\ny"), (9, "http://a", "x\r\n\r\ny"), (10, "z", "é" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.archived_pages(pages).collect()
    assert len(found) == len(rows)
    assert {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in found} == {
        (1, "revisit", 9, 6), (2, "revisit", 9, 6), (9, "response", None, 6), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 12), (10, "response", None, 400_000),
    }
    assert warc.archived_pages(pages.limit(0)).count() == 0
    # what is read can be resolved and written again
    path = str(tmp_path / "w")
    warc.write_archives(warc.resolve_revisits(warc.page_records(pages)), path, records_per_file=2)
    again = warc.read_archives(spark, path, payloads=True)
    assert again.filter("record_type = 'revisit' AND octet_length(payload) = 0").count() == 3
    once = warc.resolve_revisits(again.withColumn("payload_bytes", again.payload_bytes).select("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type"))
    assert once.filter("record_type = 'response'").count() == 5
