"""Packing, exact dedup, BPE, media columns, WARC and line dedup against brute force, on awkward rows."""

import difflib
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sedimark.llm import cuckoo_dedup, line_dedup, media_columns, packing, trie_bpe, warc_merge

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", "a", "A", "Hello world, it's 2024!", "hello WORLD, it's 2024!", "  \n\t x  y \x1c\x1d z", "<|endoftext|> a <|endoftext|>b", "漢字 ЖЖ 🙂é", "ab " * 4000, "x" * 5000, "ÀÉ", "àé"]


def documents(spark, texts, ids=None):
    rows = [(i, t, "other", 7) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, places int").repartition(3)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_bpe_matches_the_library(spark, tokenizer):
    rows = {r.doc_id: r for r in trie_bpe.digests(documents(spark, TEXTS), VOCABULARY).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        ids = ids_of(tokenizer, text)
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    full = {r.doc_id: r for r in trie_bpe.encode(documents(spark, TEXTS), VOCABULARY).collect()}
    assert all(full[i].ids == ids_of(tokenizer, t) and full[i].decoded == (t or "") for i, t in enumerate(TEXTS))
    assert trie_bpe.digests(documents(spark, []), VOCABULARY).count() == 0


def test_the_collector_is_on_again():
    import gc

    def steps():
        with trie_bpe.uncollected():
            yield gc.isenabled()
            yield gc.isenabled()

    assert list(steps()) == [False, False] and gc.isenabled()
    some = steps()
    next(some)
    some.close()
    assert gc.isenabled()


CODER = trie_bpe.TrieBpe(VOCABULARY, cache_words=50)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aeintrsh 's.\n\t"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=4))
def test_bpe_on_any_text(texts):
    tokenizer = Tokenizer.from_file(VOCABULARY) if not hasattr(CODER, "own") else CODER.own
    CODER.own = tokenizer
    assert list(CODER.encode_batch(texts)) == [ids_of(tokenizer, t) for t in texts]


def test_trie_shares_prefixes():
    trie = trie_bpe.PrefixTrie()
    trie.insert([b"there", b"the", b"then", b"a", b"the"])
    assert list(trie.walk()) == [(b"a", 0), (b"the", 0), (b"then", 3), (b"there", 3)]


def test_packing_is_a_partition_of_all_ids(spark, tokenizer):
    texts = TEXTS + [f"word{i} " * (i % 50) for i in range(300)]
    rows = packing.pack(documents(spark, texts), VOCABULARY).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in enumerate(texts):
        ids, at = [*ids_of(tokenizer, text), 0], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    used = []
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        used.append(at)
    assert len(used) <= 1.04 * sum(used) / 1024 + 2  # two open bins are left, whatever the size
    assert packing.pack(documents(spark, []), VOCABULARY).count() == 0


def test_repeated_rows_are_packed_as_often(spark):
    rows = packing.pack(documents(spark, ["same text"] * 3, [5, 5, 5]), VOCABULARY).collect()
    assert len(rows) == 3 * len(packing.cuts(rows[0].doc_tokens)) and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_packing_takes_endless_white_space(spark, tokenizer):
    texts = [" " * 1_500_000 + "a", "\n \t" * 500_000 + "b", "x" + "\u3000" * 2000 + "<|endoftext|>" + " " * 1000 + "y"]
    got = defaultdict(list)
    for r in packing.pack(documents(spark, texts, [None, 4, 5]), VOCABULARY).collect():
        got[r.doc_id].append(r)
    for i, text in zip([None, 4, 5], texts):
        ids, at = [*ids_of(tokenizer, text), 0], 0
        for r in sorted(got[i], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)


@given(st.integers(1, 5000))
def test_cuts_fill_classes(n):
    lengths = packing.cuts(n)
    assert sum(lengths) == n and all(x == 1024 or x < 32 or 1024 % x == 0 for x in lengths)


def test_exact_dedup_matches_brute_force(spark):
    texts = TEXTS * 3 + ["Same"] * 200 + ["same"]
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    rows = {r.doc_id: r for r in cuckoo_dedup.assign(documents(spark, texts, ids), most_bytes=300).collect()}
    lower = {i: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for i, t in zip(ids, texts)}
    kept, size = {}, Counter(lower.values())
    for i, t in lower.items():
        kept[t] = max(i, kept.get(t, i))
    assert len(rows) == len(texts)
    for i, t in lower.items():
        assert (rows[i].keep_id, rows[i].group_size, rows[i].kept, rows[i].text_sha256) == (kept[t], size[t], kept[t] == i, hashlib.sha256(t.encode()).hexdigest())
    assert cuckoo_dedup.assign(documents(spark, [])).count() == 0


def test_exact_dedup_with_null_ids(spark):
    rows = cuckoo_dedup.assign(documents(spark, ["a", "A", "b", "b", "c"], [None, 3, None, None, 5])).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in rows) == [("3", "3", 2, True), ("5", "5", 1, True), ("None", "3", 2, False), ("None", "None", 2, True), ("None", "None", 2, True)]


def test_cuckoo_index_evicts_what_was_hit_longest_ago():
    index, keys = cuckoo_dedup.Index(4), [hashlib.sha256(str(i).encode()).digest() for i in range(50)]
    for i, k in enumerate(keys):
        index.add(k, bytes(range(200)) + k, i)
        index.add(keys[0], bytes(range(200)) + keys[0], i)
    gone = [d for d, *_ in index.evict(index.bytes // 2)]
    assert 20 < len(gone) < 30 and gone == keys[1 : len(gone) + 1] and keys[0] in index.content
    assert sum(d in index.filter for d in gone) < 3 and all(k in index.filter for k in index.content)
    assert [n for _, _, _, n in index.evict(-1)][-1] == 51 and not index.content and index.bytes == 0


def test_cuckoo_bucket_inserts_deletes_and_grows():
    rng, bucket = random.Random(2), cuckoo_dedup.Index(4)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    assert all(bucket.add(k, k, i) for i, k in enumerate(keys))
    assert bucket.resized > 3 and all(k in bucket.filter for k in keys)
    gone = set(rng.sample(keys, 1500))
    assert all(bucket.remove(k, k) for k in gone) and not any(bucket.remove(k, k) for k in gone)
    assert all((k in bucket.content) == (k not in gone) for k in keys)
    assert all(k in bucket.filter for k in keys if k not in gone)
    assert sum(k in bucket.filter for k in gone) < 100  # false hits only
    assert not bucket.add(keys[0], keys[0], 9) if keys[0] not in gone else bucket.add(keys[0], keys[0], 9)
    # the same digest with other content is another text
    assert bucket.add(b"d" * 32, b"one", 1) and bucket.add(b"d" * 32, b"two", 2) and not bucket.add(b"d" * 32, b"one", 3)


def test_media_columns_round_trip(spark, tmp_path):
    docs = documents(spark, TEXTS + TEXTS + ["é" * 288, "y" * 576, "y" * 577])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in media_columns.op4_media_columns(spark, str(tmp_path)).collect()}
    assert len(rows) == docs.count()
    for i, text in {r.doc_id: r.text for r in docs.collect()}.items():
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or 576 * (not data))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        media = media_columns.to_png(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and media_columns.from_png(media) == payload
        lines = (text or "").split("\n")
        before = [x for x in lines[: -(-len(lines) // 2)] if x.strip()]
        assert r.caption == f"{len(data)} bytes" and r.position == len(before) and r.n_items == 1 + sum(bool(x.strip()) for x in lines)
    assert media_columns.resolve(documents(spark, []).select("digest"), media_columns.features(media_columns.store(documents(spark, []), str(tmp_path / "none")))).count() == 0


def test_html_items_keep_order_and_captions():
    page = "<h1>T</h1><p>one<img src=a alt=x>two</p><figure><img src='b'><figcaption>cap &amp; b</figcaption></figure><script>no</script><p>end"
    items = [(i["position"], i["kind"], i["text"], i["ref"], i["caption"]) for i in media_columns.parse_html(page)]
    assert items == [(0, "text", "T", None, None), (1, "text", "one", None, None), (2, "media", None, "a", "x"), (3, "text", "two", None, None), (4, "media", None, "b", "cap & b"), (5, "text", "end", None, None)]
    assert media_columns.parse_html(None) == []
    page = "<head><title>no</title><meta x=y><p>body</p><figure><figcaption><p>first</p><p>second</p></figcaption><img src=a alt=x><figure><img src=b><figcaption>inner</figcaption></figure></figure><img src=c alt=own>"
    items = [(i["kind"], i["text"], i["ref"], i["caption"]) for i in media_columns.parse_html(page)]
    assert items == [("text", "body", None, None), ("media", None, "a", "first second"), ("media", None, "b", "inner"), ("media", None, "c", "own")]
    assert [i["text"] for i in media_columns.parse_html("<html><head><style>x</style>words of a body</head>more")] == ["words of a bodymore"]
    assert media_columns.parse_html("<figure><figcaption>open<img src=z>")[0]["caption"] == "open"


def test_sequences_are_resolved_in_order(spark, tmp_path):
    docs = documents(spark, ["one", "two"])
    media = media_columns.features(media_columns.store(docs, str(tmp_path / "m")))
    digests = {t: hashlib.sha256(media_columns.payload_of(t)).hexdigest() for t in ("one", "two")}
    pages = [(1, f"<p>a</p><img src='sha256:{digests['two']}' alt=t><p>b</p><img src='sha256:{digests['one']}'><img src='x.png'>"), (1, f"<img src='sha256:{digests['two']}'>"), (2, None), (3, "<p>only text</p>")]
    found = media_columns.sequences(spark.createDataFrame(pages, "page_id long, html string"), "page_id", "html")
    got = {(r.page_id, len(r["items"])): r["items"] for r in media_columns.interleave(found, media, "page_id").collect()}
    assert set(got) == {(1, 5), (1, 1), (2, 0), (3, 1)}
    assert [(i["position"], i["text"], i["caption"], i["media"] and i["media"]["payload_sha256"]) for i in got[1, 5]] == [(0, "a", None, None), (1, None, "t", digests["two"]), (2, "b", None, None), (3, None, None, digests["one"]), (4, None, None, None)]


def test_warc_round_trip(spark, tmp_path):
    big = "é<p>WARC/1.1\r\n\r\n</p>" * 100
    pages = [(i, f"http://B.example.com:80/p?q={i % 3}", h) for i, h in enumerate([big, "small", None, big, "small", big + "x", "\r\n\r\n" * 300])] + [(7, None, ""), (8, "http://a.org/x\r\ny", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    path = str(tmp_path / "warc")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        warc_merge.write(warc_merge.classify(df), path, 2000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    rows = warc_merge.merge(warc_merge.read(spark, path), rows_a_range=3).collect()
    assert len(rows) == len(pages) and len({r.archive for r in rows}) > 3
    for r in rows:  # a range read at a record's place gives that record
        data = (tmp_path / "warc" / r.archive).read_bytes()[r.record_offset : r.record_offset + r.record_length]
        ((offset, length, headers, block),) = warc_merge.records(data)
        assert (offset, length, headers["warc-record-id"], headers["warc-date"]) == (0, r.record_length, f"<urn:page:{r.page_id}>", f"1970-01-01T00:00:0{r.page_id}Z")
    by_id = {r.page_id: r for r in rows}
    for i, _, html in pages:
        data = (html or "").encode()
        kept = max(j for j, _, h in pages if (h or "") == (html or ""))
        refers = kept if len(data) >= 1000 and kept != i else None
        r = by_id[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers else "response", refers)
    in_order = sorted(rows, key=lambda r: r.place)
    keys = [(r.url_key, r.captured, r.page_id) for r in in_order]
    assert keys == sorted(keys) and keys[0][0] == ")/" and [r.place for r in in_order] == list(range(len(rows)))
    odd = spark.createDataFrame([(None, "u", big), (None, "u", big), (4, "u", big), (4, "u", big), (5, None, None)], "page_id long, url string, html string")
    warc_merge.write(warc_merge.classify(odd), str(tmp_path / "odd"))
    got = warc_merge.merge(warc_merge.read(spark, str(tmp_path / "odd"))).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == [("4", "response", None), ("4", "response", None), ("5", "response", None), ("None", "revisit", 4), ("None", "revisit", 4)]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc_merge.write(warc_merge.classify(empty), str(tmp_path / "none"))
    assert warc_merge.merge(warc_merge.read(spark, str(tmp_path / "none"))).count() == 0


@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree_merges(runs):
    runs = [sorted(r) for r in runs]
    assert list(warc_merge.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


@given(st.lists(st.integers(0, 6), max_size=12), st.lists(st.integers(0, 6), max_size=12))
def test_patience_aligns_equal_elements_in_order(a, b):
    pairs = line_dedup.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    if len(set(a)) == len(a) and len(set(b)) == len(b) and a[:0] == b[:0]:
        assert len(pairs) <= len(set(a) & set(b))
    if a == b:
        assert len(pairs) == len(a)
    whole = difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
    assert not pairs or whole.size


def line(n):
    return f"line number {n} of some length that makes it rare enough"


def test_line_dedup(spark):
    shared = "\n".join(map(line, range(5)))
    texts = [shared + "\nown a", "intro\n" + shared, "ok\nok\nok", "ok\nok\nok", None, "", "\n".join(map(line, [2, 9, 3])), line(3), "x " * 30_000]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(documents(spark, texts).withColumn("n_chars", line_dedup.F.lit(0).cast("long"))).collect()}
    assert got[0].text == texts[0] and got[1].text == "intro" and got[1].n_chars == 5
    assert [got[i].text for i in (2, 3, 4, 5, 8)] == [texts[i] for i in (2, 3, 4, 5, 8)]
    assert got[6].text == line(9) and got[7].text == ""
    assert got[0].digest == "other"
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


def test_a_frequent_line_makes_a_pair_a_document(spark):
    texts = [f"{line('common')}\nown words of {i} that nobody else has at all here" for i in range(500)]
    rows = line_dedup.deletions(documents(spark, texts)).collect()
    assert sorted((r.doc_id, tuple(r.places)) for r in rows) == [(i, (0,)) for i in range(1, 500)]
    assert {r.n_aligned for r in rows} == {0}  # no pair is formed through it


def test_rows_that_share_a_doc_id_keep_their_own_lines(spark):
    texts = [line(1), f"{line(1)}\nown of the second", f"unique first line of another row\n{line(1)}", f"{line(1)}\nown of the second", line(2), line(2)]
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(documents(spark, texts, [1, 2, 2, 2, 7, 7])).collect())
    assert got == [(1, line(1)), (2, "own of the second"), (2, "own of the second"), (2, "unique first line of another row"), (7, line(2)), (7, line(2))]
    nulls = line_dedup.dedup_lines(documents(spark, [line(1)] * 3, [None, None, 1]))
    assert [r.text for r in nulls.collect()] == [line(1)] * 3


def test_another_document_doesnt_change_what_two_share(spark):
    a, b, c, d = (f"line {x} of twenty-five ch" for x in "abcd")
    texts = [f"own zero\n{b}\n{c}\nown tail", f"q1 own\n{a}\n{b}\n{c}\n{d}", f"q2 own\n{a}\n{b}\n{c}\n{d}"]
    for part in (texts, texts[1:]):
        got = {r.doc_id: r.places for r in line_dedup.deletions(documents(spark, part)).collect()}
        assert got[len(part) - 1] == [1, 2, 3, 4]


def test_alignment_deletes_most_lines(spark):
    rng = random.Random(20)
    stock = [f"sentence {i} of a stock that is used again and again" for i in range(400)]
    texts = ["\n\n".join(stock[i : i + rng.randrange(3, 9)]) for i in (rng.randrange(390) for _ in range(120))]
    rows = line_dedup.deletions(documents(spark, texts)).collect()
    brute = brute_deletions(texts)
    filled = {i: [p for p in x if p % 2 == 0] for i, x in enumerate(brute) if x}
    assert {r.doc_id: [p for p in r.places if p % 2 == 0] for r in rows} == filled
    assert sum(r.n_aligned for r in rows) > 0.5 * sum(map(len, filled.values()))
    left = {r.doc_id: r for r in line_dedup.dedup_lines(documents(spark, texts)).collect()}
    assert all("\n\n\n" not in r.text for r in left.values())


def brute_deletions(texts):
    """Places of lines in a run of at least 40 characters that stands in an earlier text, by trying all runs."""
    split = [[(i, x.strip(" ")) for i, x in enumerate((t or "").split("\n")) if x.strip(" ")] for t in texts]
    out = []
    for n, own in enumerate(split):
        earlier = {tuple(x for _, x in e[a:b]) for e in split[:n] for a in range(len(e)) for b in range(a + 1, len(e) + 1)}
        gone = set()
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                part = [x for _, x in own[a:b]]
                if sum(map(len, part)) >= 40 and tuple(part) in earlier:
                    gone |= set(range(own[a][0], own[b - 1][0] + 1))
        out.append(sorted(gone))
    return out


def test_lines_go_to_whichever_earlier_document_holds_them(spark):
    rng = random.Random(10)
    short = [f"short {i}" for i in range(6)]
    texts = [f"x\n{short[0]}", f"{line(0)}\n{short[1]}\n{line(1)}", f"{line(1)}\n{line(2)}", f"{line(0)}\n{short[1]}\n{line(1)}\n{line(2)}", f"{line(2)}\n{short[2]}\n{line(1)}\n{short[3]}\n{line(0)}"]
    # an exact copy whose lines belong to three documents, with short pieces between them
    texts += [f"{short[4]}\n{line(1)}\n{short[5]}\n{line(0)}\n{short[4]}"] * 2
    texts += ["\n".join(rng.choice([*short, line(7), line(8), "a passage", "of a few", "words each"]) for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    got = {r.doc_id: r.places for r in line_dedup.deletions(documents(spark, texts)).collect()}
    assert [got.get(i, []) for i in range(len(texts))] == brute_deletions(texts)
    left = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(spark, texts)).collect()}
    assert left[3] == "" and left[6] == ""
    for later in range(len(texts)):  # what alignment of any pair deletes is among it
        for earlier in range(later):
            sides = [list(enumerate(map(hash, texts[i].split("\n")))) for i in (earlier, later)]
            sizes = {hash(x): len(x) for x in texts[later].split("\n")}
            assert set(line_dedup.common_blocks(*sides, sizes, 40)) <= set(got.get(later, []))


def test_what_alignment_finds_is_what_goes(spark, monkeypatch):
    texts = ["\n".join(map(line, part)) for part in ([1, 2, 3], [9, 2, 3, 8], [7, 1, 6], [5, 3, 2, 1])]
    count = lambda: sum(len(r.places) for r in line_dedup.deletions(documents(spark, texts)).collect())
    assert count() == 2 + 1 + 3  # a moved passage too
    assert line_dedup._common([1, 2, 3], [9, 2, 3, 8], [50] * 4, 40) == [1, 2]
    monkeypatch.setattr(line_dedup, "patience", lambda a, b: [])
    # without it nothing goes but what is compared for repeated lines
    assert line_dedup._common([1, 2, 3], [9, 2, 3, 8], [50] * 4, 40) == []


def test_line_dedup_finds_what_alignment_of_all_pairs_does(spark):
    """Documents whose id is divisible by 50 against all earlier ones: every line that aligning with each of these deletes."""
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect() if r.text)
    held = [(i, line_dedup.Lines(t)) for i, t in rows]
    got = {r.doc_id: set(r.places) for r in line_dedup.deletions(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    found = total = 0
    for n, (doc_id, lines) in enumerate(held):
        if doc_id % 50 == 0:
            own = lines.hashes()
            brute = {lines.places[j] for _, other in held[:n] if not set(own).isdisjoint(h := other.hashes()) for j in line_dedup._common(h, own, lines.sizes, 40)}
            found, total = found + len(brute & got.get(doc_id, set())), total + len(brute)
    assert total and found >= 0.9 * total


def test_blank_lines_and_short_first_lines_dont_break_a_passage(spark):
    verse = ["the first line", "then a second one", "and a third", "a fourth to end it"]
    texts = ["\n\n".join(["own start", *verse]), "\n".join(["other words", *verse, "tail"]), "\n \n".join(["", *verse, ""]), f"head\nshort\n{line(1)}", f"another head\nshort\n{line(1)}", "the first line\n\nand a third\n\nown " + "x" * 40]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(documents(spark, texts)).collect()}
    assert [got[i].text for i in range(6)] == [texts[0], "other words\ntail", "", texts[3], "another head", texts[5]]
    assert got[2].places == list(range(len(texts[2].split("\n")))) and got[4].places == [1, 2]
