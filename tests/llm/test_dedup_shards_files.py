import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casehours.llm import bpe, byte_words, exact_dedup, sharding, token_planes, warc
from casehours.llm.exact_dedup import CountingQuotientFilter, merge_filters
from casehours.llm.queries import tokenizer_file
from tests.llm.helpers import DOCS, edited, frame, odd_texts, prose

EXTRA = DOCS + ", keep_id int, shard int, n int, fp int"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**58 - 1) | st.integers(0, 20), min_size=1, max_size=60), min_size=1, max_size=4))
def test_quotient_filters_merge_without_loss(parts):
    filters = []
    for p in parts:
        values, counts = np.unique(np.array(p, np.uint64), return_counts=True)
        f = CountingQuotientFilter.build(values, counts, 58)
        back = CountingQuotientFilter.of_row(f.row(0), 58)
        assert [x.tolist() for x in back.items()] == [values.tolist(), counts.tolist()]
        filters.append(back)
    values, counts = merge_filters(filters).items()
    assert dict(zip(values.tolist(), counts.tolist(), strict=True)) == Counter(x for p in parts for x in p)
    assert values.tolist() == sorted(values.tolist())


def test_exact_dedup_against_brute_force(spark):
    rng = random.Random(3)
    texts = odd_texts(rng) + [prose(rng, 5)] * 40 + [prose(rng, 9) for _ in range(30)]
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    got = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids, r = groups[t or ""], got[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(ids), len(ids), i == max(ids), hashlib.sha256((t or "").encode()).hexdigest())


def test_exact_dedup_nulls_repeats_empty(spark):
    rows = [(None, "a", None, None, None), (None, "a", None, None, None), (4, "b", None, None, None), (4, "b", None, None, None), (1, "b", None, None, None), (7, None, None, None, None)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], EXTRA)
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, None, 2, True), (None, None, 2, True), (4, 4, 3, True), (4, 4, 3, True), (1, 4, 3, False), (7, 7, 1, True)], key=repr)
    kept = exact_dedup.drop_exact_duplicates(df)
    assert kept.columns == df.columns and sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(["None", "4", "7"])
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], EXTRA)).count() == 0


def test_exact_dedup_drops_rows_not_ids(spark):
    rows = [(5, "A"), (5, "B"), (9, "A"), (None, "A"), (None, "C"), (7, None), (8, ""), (7, "C"), (9, "A")]
    df = spark.createDataFrame([(i, t, None, None, None, 1, 2, 3, 4) for i, t in rows], EXTRA)
    kept = sorted(((r["doc_id"], r["text"]) for r in exact_dedup.drop_exact_duplicates(df).collect()), key=repr)
    assert kept == sorted([(5, "B"), (9, "A"), (8, ""), (7, "C")], key=repr)


def test_exact_dedup_leaves_one_of_repeated_rows(spark):
    rows = [(7, "t")] * 5 + [(None, "u")] * 4 + [(1, "v")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(i, t, None, None, None, 1, 2, 3, 4) for i, t in order], EXTRA)
        assert sorted(((r["doc_id"], r["text"]) for r in exact_dedup.drop_exact_duplicates(df).collect()), key=repr) == sorted([(7, "t"), (None, "u"), (1, "v")], key=repr)


def test_quotient_filters_level_by_level(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FLUSH", 40)
    rng = random.Random(21)
    values = [rng.randrange(-(2**63), 2**63) for _ in range(300)]
    values += [rng.choice(values) for _ in range(200)] + [values[0]] * 300
    df = spark.createDataFrame([(v,) for v in values], "fp long").repartition(6)
    for bits in (3, 12, 25):
        got = {r["fp"]: r["copies"] for r in exact_dedup.repeated_fingerprints(df, bits).collect()}
        assert got == {v: n for v, n in Counter(values).items() if n > 1}


def test_remainders_are_packed():
    values = np.sort(np.random.default_rng(3).integers(0, 2**54, 5000, dtype=np.uint64))
    row = CountingQuotientFilter.build(values, np.ones(5000, np.int64), 54).row(0)
    assert len(row["remainders"]) == -(-5000 * (54 - row["quotient_bits"]) // 8) and row["quotient_bits"] == 13
    assert CountingQuotientFilter.of_row(row, 54).items()[0].tolist() == values.tolist()


def test_shards_match_the_mixture(spark):
    rows = [(i, "x" * (i % 50), "en", "hot" if i % 3 else f"s{i % 5}" if i % 7 else None, i) for i in range(5000)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], EXTRA)
    got = sharding.interleaved(df, 24, 1).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
        text = rows[r["doc_id"]][1].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 8, zlib.crc32(text), "rows", None)
    sizes = [len(x) for x in by.values()]
    assert sorted(by) == list(range(24)) and max(sizes) - min(sizes) <= 1 and sum(sizes) == 5000
    mixture = Counter(r[3] for r in rows)
    for shard in by.values():
        assert sorted(r["slot"] for r in shard) == list(range(len(shard)))
        own = Counter(r["source"] for r in shard)
        assert all(abs(own[s] - n / 24) <= 1 + len(mixture) * n / 5000 for s, n in mixture.items())
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.interleaved(df.repartition(7), 24, 1).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in got}


def test_shards_of_awkward_rows(spark):
    many = spark.createDataFrame([(None, f"t{k}", None, "s", None, 1, 2, 3, 4) for k in range(400)], EXTRA)
    assert Counter(r["shard"] for r in sharding.interleaved(many, 4, range_rows=1).collect()) == {k: 100 for k in range(4)}
    rows = [(None, None, None, None, None, 1, 2, 3, 4)] * 3 + [(5, "a", None, "s", None, 1, 2, 3, 4)] * 4
    got = sharding.interleaved(spark.createDataFrame(rows, EXTRA), 3).collect()
    assert sorted(Counter(r["shard"] for r in got).values()) == [2, 2, 3]
    assert sharding.interleaved(spark.createDataFrame([], EXTRA)).count() == 0


def test_write_shards(spark, tmp_path):
    df = frame(spark, [f"t{i}" for i in range(100)])
    sharding.write_shards(df, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [25] * 4


PAGES = "page_id long, url string, html string, digest string, archive string"


def test_warc_round_trip(spark):
    rows = [(3, "http://a/x y", "<p>é</p>", "", ""), (1, None, "<p>é</p>", "", ""), (2, "u", None, "", ""), (9, "u", "", "", ""), (None, "v", "solo", "", ""), (4, "w", "a\r\n\r\nb" * 500_000, "", ""), (5, "line\nbreak", "x", "", ""), (5, "line\nbreak", "x", "", "")]
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(spark.createDataFrame(rows, PAGES)).collect()), key=repr)
    first = {}
    for p, _, h, *_ in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    expected = []
    for p, _, h, *_ in rows:
        data, f = (h or "").encode(), first.get(h or "")
        own = f is None or f == p
        expected.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else f))
    assert got == sorted(expected, key=repr)
    assert warc.archive_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_damage_is_found():
    record = warc.record_bytes(1, "u", b"payload", 7, warc.sha1_base32(b"payload"), None)
    import io

    assert [r["payload"] for r in warc.read_archive(io.BytesIO(record * 3))] == [b"payload"] * 3
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(record[:-9])))
    wrong = warc.record_bytes(1, "u", b"payload", 7, warc.sha1_base32(b"other"), None)
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(wrong)))


@pytest.mark.parametrize("bit", [False, True])
def test_planes_round_trip(bit):
    rng = np.random.default_rng(1)
    w = token_planes.PlaneWriter(bit, block=100)
    docs = [rng.integers(0, 2**32, n, dtype=np.uint32) for n in (0, 1, 99, 100, 101, 1000, 3)]
    for k, d in enumerate(docs):
        w.add(k, d)
    import io

    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    f = File(b"".join(w.close()))
    index = token_planes.read_index(f)
    flat = np.concatenate([token_planes.read_block(f, index, k) for k in range(len(index["blocks"]))])
    assert np.array_equal(flat, np.concatenate(docs)) and index["lengths"] == [len(d) for d in docs]


def test_token_files_against_the_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = odd_texts(rng) + [edited(rng, prose(rng, 50), 0.1) for _ in range(20)]
    path = tokenizer_file(spark, "byte_bpe_50k.json")
    tool, start = Tokenizer.from_file(path), 0
    manifest = token_planes.write_tokens(frame(spark, texts).repartition(5), path, token_planes.fresh_path(spark, "t"), file_ids=5000)
    got = {r["doc_id"]: r for r in token_planes.read_tokens(manifest).collect()}
    for i, t in enumerate(texts):
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)
    assert token_planes.token_round_trip(spark.createDataFrame([], DOCS), path).count() == 0


def test_bpe_against_the_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    texts = odd_texts(rng) + ["ΣΑΣ İ ǅ ﬁ ½ ² 's don't 'RE", "<|startoftext|>a<|endoftext|> <|x|>", "aaaaaaaaaaaa bbbbbb ababab", "é  x y\x85z"] + [prose(rng, 40) for _ in range(10)]
    path = tokenizer_file(spark, "word_bpe_49k.json")
    tool = Tokenizer.from_file(path)
    tool.no_padding()
    tool.no_truncation()
    df = spark.createDataFrame([(i, t, None, None, None, 1, 2, 3, 4) for i, t in enumerate(texts)], EXTRA)
    tokens = bpe.encoded(df, path)
    ids = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in tokens.collect()}
    text = {r["doc_id"]: r["text"] for r in bpe.decoded(tokens, path).collect()}
    digests = {r["doc_id"]: r for r in bpe.round_trip_digests(df, path, with_ids=True).collect()}
    for i, t in enumerate(texts):
        expected = tool.encode(t or "", add_special_tokens=False).ids
        assert ids[i] == expected, i
        assert text[i] == tool.decode(expected, skip_special_tokens=False)
        assert digests[i]["n_tokens"] == len(expected) and digests[i]["decoded_sha256"] == hashlib.sha256(text[i].encode()).hexdigest()
        assert digests[i]["ids_sha256"] == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest()
    assert bpe.encoded(spark.createDataFrame([], EXTRA), path).count() == 0


def test_bpe_of_every_code_point(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file(spark, "word_bpe_49k.json")
    tool, own = Tokenizer.from_file(path), bpe.Encoder(path)
    tool.no_padding()
    tool.no_truncation()
    codes = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    disputed = set(filter(own.disputes.disputed, codes))
    assert disputed.isdisjoint("éßçñäΩЖ日한ا") and len(disputed) < len(codes)
    for group in ([c for c in codes if c not in disputed], sorted(disputed)):
        around = (lambda c: f"a{c} ") if group[0] in disputed else (lambda c: f"a{c}b {c}\u0301{c}")
        texts = ["".join(map(around, group[k : k + 1500])) for k in range(0, len(group), 1500)] + ["Ᲊ Ɤ \U00010d50", "\U0001611e\U0001611e"]
        for ids, e, text in zip(own.encode(texts), tool.encode_batch(texts, add_special_tokens=False), texts, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == e.ids, ascii(text[:40])
            assert own.decode(ids).decode() == tool.decode(e.ids, skip_special_tokens=False)


def test_bpe_nulls_and_repeats(spark):
    path = tokenizer_file(spark, "word_bpe_49k.json")
    df = spark.createDataFrame([(i, t, None, None, None, 1, 2, 3, 4, 5) for i, t in [(None, "a b"), (None, "a b"), (3, None), (3, "a b"), (3, "a b")]], EXTRA + ", n_tokens int")
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in bpe.round_trip_digests(df, path).collect()), key=repr)
    assert got == sorted([(None, 2), (None, 2), (3, 0), (3, 2), (3, 2)], key=repr)


def test_bpe_cache_is_bounded(spark):
    path = tokenizer_file(spark, "word_bpe_49k.json")
    small, large = bpe.Encoder(path, cache_words=10), bpe.Encoder(path)
    rng = random.Random(7)
    for _ in range(5):
        texts = [prose(rng, 30) for _ in range(3)]
        assert small.encode(texts) == large.encode(texts)
    assert len(small.cache) <= 100


def test_word_split_equals_the_tokenizers_pattern():
    import regex

    #: Fixed value: the pattern of the byte-level tokenizer.
    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    rng = random.Random(1)
    pieces = [*"stdm'.!]^-\\ \n\tÉaſ1½ª\xad×“’", "  ", "re", "ll", "ve"]
    for _ in range(4000):
        texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(5)]
        data, offsets = token_planes.ended_stream(pa.array(texts))
        kinds = byte_words.kinds_of(data)
        assert not (kinds == byte_words.ODD).any()
        starts = byte_words.word_starts(data, kinds)
        words = [data[a:b].tobytes().decode() for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]
        assert words == [w for t in texts for w in [*pattern.findall(t), "\0"]]
    for c in "\x0b\x1c\x85\xa0日\u2003\u2028":
        assert (byte_words.kinds_of(token_planes.ended_stream(pa.array([c]))[0]) == byte_words.ODD).any()


def test_word_windows_do_not_change_the_words():
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(0, 60)) + rng.choice(["", "'s it's", "\n", " \n x"]) for _ in range(60)]
    data, _ = token_planes.ended_stream(pa.array(texts))
    whole = byte_words.word_starts(data, byte_words.kinds_of(data)).tolist()
    for window in (1, 7, 64, 1000):
        cuts = list(byte_words.windows(data, window))
        assert [a for a, _ in cuts] == [0, *(b for _, b in cuts[:-1])] and cuts[-1][1] == len(data)
        assert [a + x for a, b in cuts for x in byte_words.word_starts(data[a:b], byte_words.kinds_of(data[a:b])).tolist()] == whole


def test_word_table_is_bounded_and_exact(spark):
    path, rng = tokenizer_file(spark, "byte_bpe_50k.json"), random.Random(7)
    small, large = token_planes.WordCachedTokenizer(path, cache_words=300), token_planes.WordCachedTokenizer(path)
    common = [prose(rng, 30) + " " + "y" * 40 for _ in range(3)]
    for k in range(60):
        texts = pa.array([prose(rng, 30) + "z" * k, rng.choice(common), None, "<|endoftext|> é 日本", "nul \0 nul"])
        for got, expected in zip(small.encode(texts), large.encode(texts), strict=True):
            assert np.array_equal(got, expected)
        ids, lengths = large.encode(texts)
        assert lengths.sum() == len(ids) and ids.tolist() == [i for t in texts.to_pylist() for i in [*large.tool.encode(t or "", add_special_tokens=False).ids, 2]]
    assert small.table.n < 700 < large.table.n


def test_token_files_of_awkward_rows(spark):
    rows = [(None, "b", None, None, None), (None, None, None, None, None), (3, "x y", None, None, None), (3, "a", None, None, None), (3, "a", None, None, None), (-5, "", None, None, None)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], EXTRA + ", start int")
    path = tokenizer_file(spark, "byte_bpe_50k.json")
    got = sorted(token_planes.token_round_trip(df, path).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in got] == [(None, 0, 1), (None, 1, 2), (-5, 3, 1), (3, 4, 2), (3, 6, 2), (3, 8, 3)]
