"""The queries' results against brute force, on the smallest sample tables."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from marlstone.llm import queries as q

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in q.table(spark, SF, "documents").collect()}


def test_op1(spark, texts):
    kinds = [
        ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16),
    ]
    rows = q.op1_secret_scan(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = sorted((m.start(), k, m.end(), n) for k, (n, p, g, size) in enumerate(kinds) for m in p.finditer(texts[r.doc_id] or "") if len(m.group(g)) >= size)
        text = ",".join(f"{n}:{a}:{b}" for a, _, b, n in found)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(f[3] == k for f in found) for k in ("assign", "access", "hex")]
        assert set(text.split(",")) <= set(r.spans.split(","))


def test_op2(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {k: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for k, x in texts.items()}
    pieces, sequences, mix, size = defaultdict(list), defaultdict(list), defaultdict(Counter), Counter()
    for r in q.op2_mixture_packing(spark, SF).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
        mix[r.sequence_id][r.source] += r.length
        size[r.source] += r.length
    assert set(pieces) == set(ids)
    for k, own in [*((len(ids[d]), p) for d, p in pieces.items()), *((None, s) for s in sequences.values())]:
        at = 0
        for start, length in sorted(own):
            assert start == at and length > 0
            at += length
        assert at == k if k is not None else at <= 4096
    last, all_ = max(sequences), sum(size.values())
    assert sorted(sequences) == list(range(last + 1)) and all(sum(n for _, n in sequences[s]) == 4096 for s in sequences if s < last)
    # no source is further from its share than a quantum at either end of a window
    assert all(abs(mix[s][x] - 4096 * size[x] / all_) <= 2 * 256 for s in mix if s < last for x in size)


def test_op3(spark):
    pages = q.table(spark, SF, "pages").collect()
    groups = defaultdict(list)
    for r in pages:
        groups[(r.html or "").encode()].append(r.page_id)
    want = sorted((i, len(k), base64.b32encode(hashlib.sha1(k).digest()).decode(), "response" if i == max(v) else "revisit", None if i == max(v) else max(v)) for k, v in groups.items() for i in v)
    assert sorted(tuple(r) for r in q.op3_warc_revisits(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == want


def test_op4(spark):
    docs = {r.doc_id: r.lang for r in q.table(spark, SF, "documents").collect()}
    rows = q.op4_language_codes(spark, SF).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) >= 0.95 * len(held)


def test_op5(spark, texts):
    docs = q.table(spark, SF, "documents").collect()
    rows = q.op5_interleaved_shards(spark, SF).collect()
    source = {r.doc_id: r.source for r in docs}
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    shards = defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        shards[r.shard].append(r)
    counts = [len(shards[k]) for k in range(8)]
    assert max(counts) - min(counts) <= 1 and all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    parts = Counter(source.values())
    for own in shards.values():
        mix = Counter(source[r.doc_id] for r in own)
        assert all(abs(mix[s] - parts[s] * len(own) / len(rows)) <= 2 for s in parts)


def test_op7(spark, texts):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    for r in q.op7_license_scan(spark, SF).collect():
        w = words(texts[r.doc_id])
        places = [(i, label) for i in range(len(w)) for p, label in phrases.items() if tuple(w[i : i + len(p)]) == p]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and {x for _, x in places} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def brute_hits(documents, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(str(item))
    out = {}
    for k, text in documents.items():
        w, hit, found = words(text), set(), set()
        for length in {len(x) for x in windows}:
            for i in range(len(w) - length + 1):
                if own := windows.get(tuple(w[i : i + length])):
                    found |= own
                    hit.update(range(i, i + length))
        out[k] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_op8(spark, texts):
    items = [(r.item_id, r.text) for r in q.table(spark, SF, "benchmark").collect()]
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in q.op8_decontamination(spark, SF).collect()}
    assert found == brute_hits(texts, items)


def test_op10(spark, texts):
    groups = defaultdict(list)
    for k, text in texts.items():
        groups[(text or "").translate(UPPER)].append(k)
    want = sorted((k, max(v), len(v), k == max(v), hashlib.sha256(t.encode()).hexdigest()) for t, v in groups.items() for k in v)
    assert sorted(tuple(r) for r in q.op10_exact_dedup(spark, SF).collect()) == want


def near_classes(rows, threshold=0.8, rarest=1e-3):
    """The class of each (id, text) by all pairs, with nothing of the operator's: words, TF-IDF over exact counts, Jaccard."""
    rows = list(rows)
    counts = []
    for _, text in rows:
        w = words(text)
        counts.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    often = Counter(k for c in counts for k in c)
    weight = {k: np.log1p(len(rows) / max(n, rarest * len(rows))) for k, n in often.items()}
    sets = [{k: n * weight[k] for k, n in c.items()} for c in counts]
    sums = [sum(x.values()) for x in sets]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            low = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
            if low and low / (sums[i] + sums[j] - low) >= threshold:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    classes = defaultdict(list)
    for i, r in enumerate(rows):
        classes[find(i)].append(r)
    return {r: min(k for k, _ in v) for v in classes.values() for r in v}


def test_op9(spark, texts):
    found = {r.doc_id: (r.class_id, r.kept) for r in q.op9_near_dedup(spark, SF).collect()}
    assert found == {k: (v, k == v) for (k, _), v in near_classes(texts.items()).items()}


def kneser_ney(texts, order):
    """Probabilities by a dictionary: interpolated modified Kneser-Ney over characters, written from the definition."""
    grams = Counter()
    for text in texts:
        t = " " * (order - 1) + re.sub(r"\s+", " ", text)
        grams.update(t[i : i + order] for i in range(len(t) - order + 1))
    tables = {order: grams}
    for n in range(order - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    discounts, totals, kinds = {}, {}, {}
    for n, table in tables.items():
        c = Counter(min(x, 5) for x in table.values())
        if c[1] and c[2] and c[3]:
            y = c[1] / (c[1] + 2 * c[2])
            discounts[n] = [min(max(k - (k + 1) * y * c[k + 1] / c[k], 0.1), k) for k in (1, 2, 3)]
        else:
            discounts[n] = [0.5, 1.0, 1.5]
        totals[n], kinds[n] = Counter(), defaultdict(float)
        for g, x in table.items():
            totals[n][g[:-1]] += x
            kinds[n][g[:-1]] += min(discounts[n][min(x, 3) - 1], x)

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / (len(tables[1]) + 1)
        if gram[:-1] not in totals[n]:
            return p(gram[1:])
        x = tables[n].get(gram, 0)
        own = x - min(discounts[n][min(x, 3) - 1], x) if x else 0
        return (own + kinds[n][gram[:-1]] * p(gram[1:])) / totals[n][gram[:-1]]

    return p


def test_kneser_ney_is_that_of_the_definition(spark, texts, monkeypatch):
    from marlstone.llm import kneser_ney as kn

    monkeypatch.setattr(kn, "BLOCK_BYTES", 30_000)
    rows = [(k, t, "x" if k % 3 else "y") for k, t in list(texts.items())[:60]] + [(1000, "déjà  vu\u00a0?\x00", "x"), (1001, "", "x"), (1002, None, "x"), (1003, "z", None), (1004, "only", "w"), (1005, "😀 ab", "y")]
    trusted = [k for k, _, _ in rows if k % 2 == 0 and k < 1003]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    blocks = kn.text_blocks(docs, "doc_id", "text", "lang").select("fold", "doc_ids").collect()
    fold = {k: b.fold for b in blocks for k in b.doc_ids}
    assert set(fold.values()) == {0, 1} and len(blocks) > 4
    for order in (2, 4):
        found = {r.doc_id: r for r in kn.quality(docs, spark.createDataFrame([(k,) for k in trusted], "doc_id long"), order=order).collect()}
        models = {(f, lang): kneser_ney([(t or "").replace("\x00", "\ufffd") for k, t, x in rows if k in trusted and fold[k] == f and x == lang], order) for f in (0, 1) for lang in "xy"}
        for k, t, lang in rows:
            t = re.sub(r"\s+", " ", (t or "").replace("\x00", "\ufffd"))
            if not t or lang not in ("x", "y"):
                assert found[k].perplexity is None and found[k].kept
                continue
            padded = " " * (order - 1) + t
            logs = [np.log(models[1 - fold[k], lang](padded[i : i + order])) for i in range(len(t))]
            assert found[k].symbols == len(t) and abs(np.log(found[k].perplexity) + np.mean(logs)) < 1e-5


def test_op6(spark):
    labels = {r.doc_id: r.quality for r in q.table(spark, SF, "labels").collect()}
    rows = q.op6_kneser_ney_quality(spark, SF).collect()
    assert len(rows) == q.table(spark, SF, "documents").count()
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1]
    bad = [r.kept for r in rows if labels.get(r.doc_id) == 0]
    assert sum(good) >= 0.9 * len(good) and sum(bad) < 0.5 * len(bad)


def test_op6_drops_most_bad_texts_of_each_language(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in q.table(spark, sf, "labels").collect()}
    kept = defaultdict(list)
    for r in q.op6_kneser_ney_quality(spark, sf).collect():
        kept[labels.get(r.doc_id), r.lang].append(r.kept)
    bad = {lang: v for (label, lang), v in kept.items() if label == 0}
    assert len(bad) == 4 and all(sum(v) < 0.2 * len(v) for v in bad.values()) and sum(map(sum, bad.values())) < 0.08 * sum(map(len, bad.values()))
    assert all(sum(v) >= 0.97 * len(v) for (label, _), v in kept.items() if label == 1)


def test_pipeline(spark, texts):
    """The same documents are left, and packed whole, as by brute force on what each stage was given."""
    import corpus_pipeline as p
    from marlstone.llm.language_id import train_and_predict

    docs = q.table(spark, SF, "documents")
    rejected = {r.doc_id for r in train_and_predict(docs).filter("ambiguous OR lang_pred = 'und'").collect()}
    left = {k: t for k, t in texts.items() if k not in rejected}
    groups = defaultdict(list)
    for k, t in left.items():
        groups[(t or "").translate(UPPER)].append(k)
    left = {max(v): left[max(v)] for v in groups.values()}
    classes = near_classes(left.items())
    left = {k: t for k, t in left.items() if classes[k, t] == k}
    hits = brute_hits(left, [(r.item_id, r.text) for r in q.table(spark, SF, "benchmark").collect()])
    left = {k for k in left if not hits[k][4]}
    size = Counter()
    total = {}
    for r in p.run(spark, SF).collect():
        size[r.doc_id] += r.length
        total[r.doc_id] = r.doc_tokens
    assert set(size) == left and dict(size) == total
    assert [n for n, _ in p.STAGES] == ["language ID", "exact dedup", "near dedup", "decontamination", "packing"]
