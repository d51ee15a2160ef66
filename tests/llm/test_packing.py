import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from stmtflow.llm import packing as pk

PATH = public_tokenizers.path("byte_bpe_50k.json")


def tokenizer():
    return Tokenizer.from_file(PATH)


def check(rows, docs, window=1024):
    """Every id of every row in exactly one piece; sequences gapless and full or a power of two."""
    t = tokenizer()
    want, have = defaultdict(list), defaultdict(list)
    for doc_id, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want[doc_id, len(ids)].append(np.array(ids, dtype="<u4"))
    for r in rows:
        have[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    assert set(want) == set(have)
    for key, copies in want.items():
        covered = sorted(x for s, n, _ in have[key] for x in range(s, s + n))
        assert covered == sorted(list(range(key[1])) * len(copies))
        for s, n, crc in have[key]:
            assert crc in {zlib.crc32(ids[s:s + n].tobytes()) for ids in copies}
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == window or at & (at - 1) == 0 and at < window


def test_query(spark, sf_small):
    from stmtflow.llm.catalog import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    check(QUERIES["op6_packing"](spark, sf_small).collect(), docs)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = pk.pack(odd_docs, PATH, shard_tokens=3000).collect()
    check(rows, [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert pk.pack(no_docs, PATH).count() == 0


def test_chunks_encode_as_the_whole_text():
    encoder, t = pk.ChunkEncoder(PATH), tokenizer()
    texts = ["a  b", "a\n\n b", " a", "a ", "don't I'll 's", "x y  z", "a\tb \nc", "<|endoftext|> a<|endoftext|>", "", " ", "\n",
             "é ü-ß 12 345,6.7 end.\nNew line", "end\n next", "tab\t next"]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_neighbours_share_a_window():
    r = np.random.default_rng(1)
    topics = [r.integers(1000 * k, 1000 * k + 400, size=(12, 200)) for k in range(1, 5)]
    ids = [x.astype(np.int64) for topic in zip(*topics) for x in topic]
    used = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=6000)
    idf = np.log(1 + (len(ids) - used + 0.5) / (used + 0.5))
    mixed = [len({int(ids[f][0]) // 1000 for f, _, _ in s}) for s in pk.shard_windows(ids, idf, 200.0)]
    assert sum(m == 1 for m in mixed) >= 6


def test_shards_hold_neighbours(spark):
    """Fragments of a topic share a shard, however many shards there are; copies are spread over several."""
    r = np.random.default_rng(2)
    rows = [(i, 0, 200, None, 200, r.integers(1000 * (i % 8) + 1, 1000 * (i % 8) + 400, 200).astype("<u2").tobytes()) for i in range(400)]
    copy = np.arange(9000, 9200).astype("<u2").tobytes()
    rows += [(1000 + i, 0, 200, None, 200, copy) for i in range(150)]
    columns = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary"
    fragments = spark.createDataFrame(rows, columns)
    shared = spark.sparkContext.broadcast((np.ones(10_000), 200.0))
    for shards in (4, 11):  # by a hash one neighbour in as many would be there
        got = pk.by_content(fragments, shared, 110_000, 110_000 // shards).collect()
        assert len(got) == 550 and len({x.doc_id for x in got}) == 550
        of = {x.doc_id: x.shard for x in got}
        near = [of[a] == of[b] for t in range(8) for a in range(t, 400, 8) for b in range(t, a, 8)]
        assert np.mean(near) > 0.8
        assert np.bincount([x.shard for x in got]).max() <= 1.5 * 550 / shards
        assert len({of[1000 + i] for i in range(150)}) >= 150 * shards // 550


def test_every_term_of_a_seed_asks():
    r = np.random.default_rng(3)
    topic = np.arange(2000, 2300)
    seed = np.concatenate([np.arange(100, 120), topic, topic])  # its twenty rarest terms are nobody else's
    related = [r.permutation(topic) for _ in range(2)]
    others = [r.integers(5000, 9000, 250) for _ in range(60)]
    ids = [x.astype(np.int64) for x in [*others[:30], seed, *others[30:], *related]]
    idf = np.ones(10_000)
    idf[100:120] = 20
    window = next(s for s in pk.shard_windows(ids, idf, 300.0) if s[0][0] == 30)
    assert {f for f, _, _ in window} == {30, 61, 62}


def test_neighbours_beyond_the_first_lots():
    """Related short fragments come before longer ones of another topic, however many it takes."""
    r = np.random.default_rng(6)
    ids = [r.integers(1000, 1040, 20) for _ in range(300)] + [r.integers(2000, 2040, 19) for _ in range(300)]
    ids[300] = r.integers(2000, 2040, 21)  # the first seed
    first = pk.shard_windows(ids, np.ones(4000), 20.0)[0]
    assert first[0][0] == 300 and all(f >= 300 for f, _, _ in first)


def test_small_samples_do_not_stop_the_splitting(spark, monkeypatch):
    """With a sample for few leaves a round, leaves are split in later rounds: neighbours stay together as with a large one."""
    r = np.random.default_rng(8)
    rows = [(i, 0, 200, None, 200, r.integers(500 * (i % 30) + 1, 500 * (i % 30) + 200, 200).astype("<u2").tobytes()) for i in range(1500)]
    fragments = spark.createDataFrame(rows, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary")
    shared = spark.sparkContext.broadcast((np.ones(16_000), 200.0))

    def together():
        got = pk.by_content(fragments, shared, 300_000, 10_000).collect()
        assert sorted(x.doc_id for x in got) == list(range(1500))
        of = {x.doc_id: x.shard for x in got}
        return np.mean([of[a] == of[b] for t in range(30) for a in range(t, 1500, 30) for b in range(t, a, 30)])

    plenty = together()
    monkeypatch.setattr(pk, "SAMPLE", 400)
    monkeypatch.setattr(pk, "LEAF_SAMPLE", 100)
    assert plenty > 0.5 and together() > 0.7 * plenty


def test_a_chunk_is_encoded_once_and_many_in_a_call(monkeypatch):
    """Letters, marks and line breaks in every order: the ids are the tokenizer's, and unseen chunks do not cost a call each."""
    r, t, encoder = random.Random(4), tokenizer(), pk.ChunkEncoder(PATH)
    assert encoder.direct
    texts = ["".join(r.choice("ab cé.,'\n\t1ß#… ’-日z_²|<>😀s\u00a0\u2003") for _ in range(r.randrange(30))) for _ in range(3000)]
    texts += ["a\n", "\na", "x" * 300 + " " + "y" * 90 + " x", "it's it'. l'été, été… (é) æ. œ,", "\x1ca b", "end.\n"]
    monkeypatch.setattr(pk, "GROUP_BYTES", 2000)
    monkeypatch.setattr(pk, "CACHE_CHUNKS", 50)
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
    monkeypatch.undo()

    calls = []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return bare.encode_batch_fast(texts, **options)

    bare, encoder.bare = encoder.bare, Counted()
    words = ["".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(6400)]
    first, again = encoder.encode([" ".join(words), " ".join(words)])
    assert first == again and sum(calls) <= 101


def test_white_space_of_uneven_texts():
    """The pattern knows all white space that Python knows, so no text with two of them is cut into chunks."""
    import pyarrow as pa
    import pyarrow.compute as pc

    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    found = pc.match_substring_regex(pa.array([f"a{c}{c}a" for c in chars]), pk.UNEVEN).to_pylist()
    assert {c for c, f in zip(chars, found) if f} == {c for c in chars if c.isspace()}


def test_vocabularies_that_join_chunks_are_not_split_from_many():
    assert pk.separable({"Ġa": 0, "b": 1, ".": 2, "...": 3, "ĊĊ": 4, "'s": 5})
    for token in ("aĠb", "a.", "aĊ", "Ċa", "é."[0].encode().decode("latin-1") + ","):
        assert not pk.separable({token: 0}), token


def test_windows_do_not_depend_on_when_the_index_is_built_again(monkeypatch):
    """Used up fragments leave the index of a shard; what is left scores as before."""
    r = np.random.default_rng(9)
    ids = [r.integers(0, 400, r.integers(1, 120)) for _ in range(700)]
    idf, built = r.random(400) + 0.01, []
    for every in (1 << 30, 8, 1):
        monkeypatch.setattr(pk, "REBUILT", every)
        built.append(pk.shard_windows(ids, idf, 60.0, 256))
    assert built[0] == built[1] == built[2]
    assert sum(b - a for s in built[0] for _, a, b in s) == sum(map(len, ids))
