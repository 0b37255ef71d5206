"""N-gram join, LM scores, both classifiers and the pipeline against brute force, on awkward rows."""

import math
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from sedimark.llm import backoff_lm, byte_cnn, centroid_langid, ngram_join
from tests.llm.test_ops_a import documents


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingles(text, k):
    w = words_of(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows}
    names = {i: i for i in sets}

    def find(x):
        while names[x] != x:
            x = names[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                names[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, size, members, most):
    """Copies of one text with up to so many words changed each."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    for _ in range(members):
        own = list(base)
        for _ in range(rng.randrange(most + 1)):
            own[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        yield " ".join(own)


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_components_match_brute_force(spark, k, num, den):
    rng = random.Random(k)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [None, "", " \t\n", "a", "A", "a b", "B a", "x y z w v", "X y z\tw v", "x y z w"]
    for size, members, most in ((6, 8, 1), (8, 8, 1), (11, 12, 1), (14, 12, 1), (20, 15, 1), (60, 60, 4), (150, 90, 9), (400, 10, 15)):
        texts += family(rng, size, members, most)
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(90)) for _ in range(60)]
    texts += [texts[40].upper()] * 30
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts))
    want = brute_components(rows, k, num, den)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(documents(spark, texts, ids), k, num, den).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want) - 60
    assert ngram_join.near_duplicates(documents(spark, []), k, num, den).count() == 0


@pytest.mark.parametrize(("num", "den"), [(85, 100), (80, 100), (1, 2), (95, 100)])
def test_linked_sets_share_a_signature(num, den):
    rng, scheme = np.random.default_rng(3), ngram_join.Scheme(num, den)
    seen = 0
    for _ in range(1500):
        n = int(rng.integers(1, 120))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        away = int(rng.integers(0, n // 5 + 2))
        b = np.concatenate([a[: n - away], rng.integers(0, 1 << 63, int(rng.integers(0, n // 5 + 2)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if len(b) and den * both >= num * (len(a) + len(b) - both):
            seen += 1
            assert len(np.intersect1d(scheme.signatures(a), scheme.signatures(b)))
    assert seen > 50


def test_words_are_hashed_alike_in_any_slices(monkeypatch):
    rng = random.Random(9)
    texts = [None, b"", b" \t", "é Ä x".encode(), b"w" * 300 + b" end", b"".join(rng.choice([b"a", b"B", b" ", b"\n", b"\x0b", b"\x1c"]) for _ in range(2000))]
    hashes, edges = ngram_join.word_hashes(texts)
    words = [w for t in texts for w in words_of((t or b"").decode())]
    assert len(hashes) == len(words) == edges[-1] and len(set(zip(words, hashes))) == len(set(words)) == len(set(hashes))
    for size in (1, 7, 64, 500):
        monkeypatch.setattr(ngram_join, "SLICE", size)
        again, same = ngram_join.word_hashes(texts)
        assert np.array_equal(again, hashes) and np.array_equal(same, edges)


def test_repeated_rows_share_a_component(spark):
    rows = ngram_join.near_duplicates(documents(spark, ["one two three four five six"] * 3, [7, 7, 9])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(7, 7), (7, 7), (9, 7)]


def test_lm_scores_match_brute_force(spark):
    texts = [None, "", "the cat sat", "The cat sat", "a dog", "the\tdog sat on the cat", "zz " * 3000, "the " * 50, "é È"]
    tokens = [words_of(t) for t in texts]
    one, two = Counter(w for t in tokens for w in t), Counter(p for t in tokens for p in zip(t, t[1:]))
    total = sum(one.values())
    got = {r.doc_id: r for r in backoff_lm.score(documents(spark, texts), parts=3).collect()}
    for i, t in enumerate(tokens):
        mine, mine2, x, seen = Counter(t), Counter(zip(t, t[1:])), 0.0, 0
        n = max(total - len(t), 1)
        for j, w in enumerate(t):
            alone = math.log(max(one[w] - mine[w], 1) / n)
            pair = (t[j - 1], w) if j else None
            if pair and two[pair] > mine2[pair]:
                seen += 1
                x += math.log((two[pair] - mine2[pair]) / (one[pair[0]] - mine[pair[0]]))
            else:
                x += alone + (math.log(0.4) if j else 0)
        assert (got[i].n_words, got[i].n_seen) == (len(t), seen) and got[i].score == pytest.approx(x, abs=1e-6)
    assert backoff_lm.score(documents(spark, [])).count() == 0


def test_lm_scores_do_not_depend_on_the_deal(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60))) for _ in range(40)]
    texts += [texts[3]] * 2 + [None]
    ids = [*range(40), 3, None, None]
    rows = list(zip(ids, texts))
    runs = []
    for dealt, parts in ((1, 1), (5, 2), (3, 4)):
        rng.shuffle(rows)
        df = documents(spark, [t for _, t in rows], [i for i, _ in rows]).withColumn("id", backoff_lm.F.lit("clash")).repartition(dealt)
        runs.append(sorted((str(r.doc_id), r.n_words, r.n_seen, round(r.score, 6)) for r in backoff_lm.score(df, parts).collect()))
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 43
    assert len({r for r in runs[0] if r[0] == "3"}) == 1 and sum(r[0] == "3" for r in runs[0]) == 2


def test_lm_blocks_of_equal_contents(spark, monkeypatch):
    monkeypatch.setattr("sedimark.llm.ngram_join.BLOCK_BYTES", 1)
    rows = [(5, "a b a"), (5, "a b a"), (5, "a b a"), (6, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id, r.n_words, r.n_seen) for r in backoff_lm.score(df, 2).collect())
    assert got == [(5, 3, 2)] * 3 + [(6, 2, 1)]
    names = [n for n, _, _ in backoff_lm._named([spark.createDataFrame([(1, "x"), (1, None), (1, "")], "doc_id long, text string").toArrow().to_batches()[0].cast(backoff_lm.pa.schema([("doc_id", backoff_lm.pa.int64()), ("text", backoff_lm.pa.binary())]))])]
    assert len(names) == len(set(names))


def labelled(spark, n):
    rng = random.Random(5)
    good = [" ".join(rng.choice(["stone", "river", "light", "meadow", "walks"]) for _ in range(rng.randrange(3, 200))) for _ in range(n)]
    bad = ["".join(rng.choice(["%%% ", "buy!! ", "$$$ ", "### ", "now "]) for _ in range(rng.randrange(3, 200))) for _ in range(n)]
    docs = documents(spark, [t for pair in zip(good, bad) for t in pair])
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(2 * n)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark, 150)
    model = byte_cnn.fit(docs, labels, sample=60)
    rows = byte_cnn.score(docs, model).where(~byte_cnn.learns("doc_id", 4, 2)).collect()
    assert len(rows) > 40 and sum((r.score >= 0.7) == (r.doc_id % 2 == 0) for r in rows) / len(rows) > 0.95
    assert set(byte_cnn.keep_good(docs, model).columns) == set(docs.columns)
    odd = byte_cnn.score(documents(spark, [None, "", "é", "x" * 300_000]).withColumn("SCORE", byte_cnn.F.lit(3)), model)
    assert all(0 <= r.score <= 1 for r in odd.collect()) and odd.count() == 4
    assert byte_cnn.fit(docs, labels.limit(0)).constant == 1.0
    assert byte_cnn.fit(docs, labels.where("quality = 1")).constant > 0.9
    assert byte_cnn.score(documents(spark, []), model).count() == 0


def test_chunks_cover_every_byte():
    rng, size = random.Random(1), byte_cnn.CHUNK
    step = size - byte_cnn.OVERLAP
    for n in (1, size - 1, size, size + 1, size + step, size + step + 1, 5000):
        data = bytes(rng.randrange(256) for _ in range(n))
        rows = byte_cnn.ByteCnn.chunks(data)
        assert rows[0].tobytes()[: min(n, size)] == data[:size] and (n <= size or rows[-1].tobytes() == data[-size:])
        assert len(rows) == (1 if n <= size else len(range(0, n - size, step)) + 1)


def test_slices_change_nothing(monkeypatch):
    rng, model = random.Random(6), byte_cnn.ByteCnn(2)
    model.last += np.linspace(-1, 1, len(model.last), dtype=np.float32)
    texts = [None, "", "é", *("".join(rng.choices("abc déß。\n", k=n)) for n in (100, 2000, 9000, 40_000))]
    idf = np.linspace(1, 2, centroid_langid.DIMENSIONS).astype(np.float32)
    scores, vectors = model.scores(texts), centroid_langid.vectors([t or "" for t in texts], idf)
    assert len(set(scores[3:])) == 4
    monkeypatch.setattr(byte_cnn, "SLICE", 7)
    monkeypatch.setattr(centroid_langid, "SLICE", 11)
    assert np.array_equal(model.scores(texts), scores) and np.array_equal(centroid_langid.vectors([t or "" for t in texts], idf), vectors)
    for n in (0, 1, 257, 258, 257 + 193 * 7, 5000):
        data = bytes(rng.randrange(256) for _ in range(n))
        rows = list(byte_cnn.ByteCnn.slices(data))
        assert max(map(len, rows)) <= 7 and len(np.concatenate(rows)) == (0 if not n else 1 if n <= 257 else len(range(0, n - 257, 193)) + 1)


def test_a_very_long_text_takes_little_memory_beside_itself():
    text, idf = "some words of a very long text " * 1_000_000, np.ones(centroid_langid.DIMENSIONS, np.float32)
    for run in (lambda: byte_cnn.ByteCnn(2).scores([text]), lambda: centroid_langid.vectors([text], idf)):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 5 * len(text) + (64 << 20)


def test_the_count_table_has_as_many_parts_as_its_text_needs(spark, monkeypatch):
    texts = ["a b c", "b c d e", None, "x" * 5000]
    docs = documents(spark, texts)
    rows = docs.select(backoff_lm.F.col("text").cast("binary"))
    least = backoff_lm.shuffle_partitions(spark)
    assert backoff_lm.table_parts(rows) == least == backoff_lm.table_parts(rows.limit(0))
    monkeypatch.setattr(backoff_lm, "PART_BYTES", 1000)
    assert backoff_lm.table_parts(rows) == -(-backoff_lm.BYTES_ASKED * 5012 // 1000) > least
    assert sorted(map(repr, backoff_lm.score(docs).collect())) == sorted(map(repr, backoff_lm.score(docs, 3).collect()))


def naive_pooled(model, data):
    """Maximum of each filter over each chunk, window by window."""
    size, step = byte_cnn.CHUNK, byte_cnn.CHUNK - byte_cnn.OVERLAP
    starts = [0] if len(data) <= size else [*range(0, len(data) - size, step), len(data) - size]
    out = []
    for start in starts:
        chunk = data[start : start + size].ljust(size, b" ")
        windows = [chunk[i : i + byte_cnn.WINDOW] for i in range(0, size - byte_cnn.WINDOW + 1, byte_cnn.STRIDE)]
        out.append(np.maximum(0, np.max([model.bias + sum(model.filters[o, x] for o, x in enumerate(w)) for w in windows], axis=0)))
    return np.array(out)


def test_convolution_reads_every_byte():
    rng, model = random.Random(8), byte_cnn.ByteCnn(3)
    for n in (1, 5, 256, 257, 258, 300, 512, 1000):
        data = bytes(rng.randrange(32, 127) for _ in range(n))
        assert np.allclose(model.pooled(model.chunks(data)), naive_pooled(model, data), atol=1e-4)
        for at in {0, 1, n // 2, n - 2, n - 1} & set(range(n)):
            other = data[:at] + b"\xff" + data[at + 1 :]
            assert not np.array_equal(model.convolve(model.chunks(data)), model.convolve(model.chunks(other)))


def test_quality_query(spark, tmp_path):
    docs, labels = labelled(spark, 150)
    more = documents(spark, [None, "", "walks", "walks"], [900, 901, 902, 902])
    docs.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = byte_cnn.op8_byte_cnn(spark, str(tmp_path)).collect()
    assert len(rows) == 304 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 300]
    assert sum(r.predicted == 1 - r.doc_id % 2 for r in held) > 0.95 * len(held)
    assert len({r.score for r in rows if r.doc_id == 902}) == 1
    clash = byte_cnn.keep_good(docs.withColumn("score", byte_cnn.F.lit("own")).withColumn("quality score", byte_cnn.F.lit(1)), byte_cnn.fit(docs, labels, sample=60))
    assert {r.score for r in clash.collect()} == {"own"} and "quality score" in clash.columns


def test_language_on_held_out_rows(spark):
    rng = random.Random(6)
    stock = {"en": "the and stone with that river for night", "de": "der und nicht schön über straße mit nacht", "fr": "le été avec où nuit pour déjà rivière"}
    rows = [(i, " ".join(rng.choice(stock[lang].split()) for _ in range(rng.randrange(5, 80))), lang) for i, lang in enumerate(list(stock) * 60)]
    rows += [(900, None, "en"), (901, "", "en"), (902, "123 %%% 456", "en"), (903, "der stone", None), (904, "漢字" * 20, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = centroid_langid.fit(docs, sample=40)
    got = {r.doc_id: r for r in centroid_langid.predict(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:180])
    assert [(got[i].lang_pred, got[i].lang_score, got[i].lang_rejected) for i in (900, 901, 902)] == [("und", 0.0, True)] * 3
    assert got[904].lang_rejected and got[904].lang_pred in stock and not got[903].lang_rejected
    assert len(centroid_langid.clusters(np.eye(6, dtype=np.float32), 4)) == 4
    none = centroid_langid.fit(docs.limit(0))
    assert {r.lang_pred for r in centroid_langid.predict(docs, none).collect()} == {"und"}
    own = docs.withColumn("LANG_PRED", centroid_langid.F.lit("own"))
    assert centroid_langid.keep_known(own, model).columns == own.columns and {r.LANG_PRED for r in centroid_langid.keep_known(own, model).collect()} == {"own"}


def brute_language(model, text):
    """(language, cosine) of the nearest centroid, one trigram after the other."""
    letters = "".join(c if c.islower() and c.isascii() or ord(c) > 127 else " " for c in text.lower())
    data, counts = b" " + letters.encode() + b" ", Counter()
    for i in range(len(data) - 2):
        x = ((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 0x85EBCA6B) % 2**32
        x = ((x ^ x >> 13) * 0xC2B2AE35) % 2**32
        counts[(x ^ x >> 16) >> 32 - centroid_langid.BITS] += 1
    row = {p: math.log1p(n) * float(model.idf[p]) for p, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in row.values()))
    cosine = [(sum(v * float(c[p]) for p, v in row.items()) / norm, n) for c, n in zip(model.centres, model.languages)]
    best = max(c for c, _ in cosine)
    return min(n for c, n in cosine if c == best), best


def test_language_query_against_brute_force(spark, tmp_path):
    rng = random.Random(19)
    stock = {"en": "the and stone with that river for night", "de": "der und nicht schön über straße mit nacht", "fr": "le été avec où nuit pour déjà rivière"}
    rows = [(i, " ".join(rng.choice(stock[lang].split()) for _ in range(rng.randrange(1, 60))), lang) for i, lang in enumerate(list(stock) * 60)]
    rows += [(7, "The night", "en"), (7, "The night", "en"), (800, "le " * 200_000, "fr"), (801, None, "fr"), (802, "1 2 3", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = centroid_langid.fit(docs)
    got = centroid_langid.op9_centroid_langid(spark, str(tmp_path)).collect()
    want = sorted((i, zlib.crc32(str(i).encode()) % 5 == 0, brute_language(model, t)[0] if t and any(map(str.isalpha, t)) else "und") for i, t, _ in rows)
    assert sorted((r.doc_id, r.held_out, r.lang_pred) for r in got) == want and all(0 <= r.score <= 1 for r in got)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_code_and_base64_are_rejected(spark):
    import base64

    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    model = centroid_langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    rng = random.Random(21)
    with open(centroid_langid.__file__) as f:
        code = f.read()
    coded = base64.b64encode(bytes(rng.randrange(256) for _ in range(3000))).decode()
    cyrillic = " ".join("".join(rng.choices("абвгдежзийклмнопрстуфхцчшщъыьэюя", k=6)) for _ in range(60))
    verdicts = {name: model.predict([t])[0][2] for name, t in (("code", code), ("base64", coded), ("cyrillic", cyrillic))}
    assert verdicts == {"code": True, "base64": True, "cyrillic": True}
    kept = [r for _, _, r in model.predict([t for _, t, _ in rows])]
    assert sum(kept) <= 0.02 * len(kept)


def test_foreign_and_junk_texts_are_rejected(spark):
    rng = random.Random(16)
    syllables = {lang: ["".join(rng.choice(x) for x in (onset, vowels, coda)) for _ in range(60)] for lang, onset, vowels, coda in (("one", "bdgklmnprst", "aeiou", "nrst"), ("two", "fhjvwzçñ", "äöüéè", "lmxq"))}

    def text(lang, n):
        return " ".join("".join(rng.choices(syllables[lang], k=rng.randrange(1, 4))) for _ in range(n))

    def strange(letters, n):
        return " ".join("".join(rng.choices(letters, k=rng.randrange(3, 10))) for _ in range(n))

    rows = [(i, text(lang, rng.choice([3, 10, 40, 150, 600])), lang) for i, lang in enumerate(list(syllables) * 150)]
    alphabets = ["αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя", [chr(x) for x in range(0x4E00, 0x9FA5)], [chr(x) for x in range(0xE01, 0xE2F)], "abcdefghijklmnopqrstuvwxyz"]
    model = centroid_langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), sample=40)
    for n in (30, 200, 1000):
        assert all(rejected for _, _, rejected in model.predict([strange(a, n) for a in alphabets for _ in range(5)]))
    for n in (2, 5, 30, 200, 1000):
        clean = model.predict([text(lang, n) for lang in syllables for _ in range(50)])
        assert sum(rejected for _, _, rejected in clean) <= 2
    before = centroid_langid.Centroids(model.idf, model.centres, model.languages)  # without limits of its own
    assert not all(rejected for _, _, rejected in before.predict([strange(a, 1000) for a in alphabets]))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark, 60)
    good = [r.text for r in docs.where("doc_id % 2 = 0").collect()]
    copy = good[0] + " " + " ".join(f"unlike{i}" for i in range(40))
    texts = [r.text for r in docs.orderBy("doc_id").collect()] + [copy, copy + " end", "123", None]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out, kept = rows, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, out, str(tmp_path)).write.parquet(path)
        out = spark.read.parquet(path)
        kept[name] = {r.doc_id for r in out.select("doc_id").distinct().collect()}
        assert name == "packing" or out.columns == corpus_pipeline.COLUMNS
    assert {122, 123} & kept["language"] == set() and len(kept["language"]) == 122
    assert all(i % 2 == 0 or i > 120 for i in kept["quality"]) and len(kept["quality"]) > 55
    assert 120 in kept["near_copies"] and 121 not in kept["near_copies"]
    assert kept["packing"] == kept["near_copies"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept["packing"]


def test_near_copies_keep_one_row_of_each_group(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(17)
    a, b, c, d = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    rows = [(None, a), (None, a + " end"), (None, b), (7, b), (3, b + " end"), (3, b + " end"), (3, c), (3, d), (5, d), (None, None), (8, ""), (9, "")]
    made = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    made.repartition(3).write.parquet(str(tmp_path / "in"))
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, spark.read.parquet(str(tmp_path / "in")), str(tmp_path)).collect()]
    (lone,) = [t for i, t in got if i is None and t]
    assert lone in (a, a + " end")
    assert sorted(got, key=repr) == sorted([(None, lone), (3, b + " end"), (3, c), (3, d), (None, None), (8, ""), (9, "")], key=repr)


def test_stages_take_awkward_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated ids and rows, an empty table, in each stage but with its own columns."""
    import corpus_pipeline

    docs, labels = labelled(spark, 60)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    good = [(r.doc_id, r.text, "en", "s", len(r.text)) for r in docs.collect()]
    long, twice = "meadow river stone light walks " * 60_000, "stone river light meadow walks " * 12
    odd = [(None, None, None, None, None), (500, None, "en", "s", 0), (501, "", "en", None, 0), (502, long, "en", "s", len(long)), (503, "walks light", None, "s", 11), (503, "stone river meadow", "en", "s", 18), (504, twice, "en", "s", len(twice)), (504, twice, "en", "s", len(twice)), (None, "river river light", "en", "s", 17)]
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, spark.createDataFrame([], schema), str(tmp_path))
        assert empty.count() == 0, name
        given = spark.createDataFrame(good + odd, schema).repartition(3)
        path = str(tmp_path / name)
        stage(spark, given, str(tmp_path)).write.parquet(path)
        out = spark.read.parquet(path)
        if name == "packing":
            tokens = out.groupBy("doc_id", "doc_tokens").agg(byte_cnn.F.sum("length").alias("n")).collect()
            assert sum(r.n for r in tokens if r.doc_id == 504) == 2 * next(r.doc_tokens for r in tokens if r.doc_id == 504) and out.where("doc_id = 502").count() > 100
            assert {r.doc_id for r in tokens} == {i for i, *_ in good + odd}
            continue
        assert out.columns == corpus_pipeline.COLUMNS
        rows = [(r.doc_id, r.text) for r in out.collect()]
        assert all(r in [(i, t) for i, t, *_ in good + odd] for r in rows) or name == "lines"
        assert (502, long) in rows, name
        assert rows.count((504, twice)) == (1 if name == "near_copies" else 2), name
        if name == "lines":
            assert len(rows) == len(good + odd)
