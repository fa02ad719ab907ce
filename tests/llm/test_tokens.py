import hashlib
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from riskloom.llm import pieces, token_files  # noqa: E402

ALPHA = list("\x1c\x1f\x85\u2028AbZ,; \n\t\r▁aéßb<>/|スー🤖́　\xa0\x00.s'st​") + ["<s>", "</s>", "<unk>", "<|endoftext|>", "the "]


def fuzz(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(ALPHA) for _ in range(draw.randint(0, 20))) for _ in range(n)]


def test_chunks_equal_whole_text():
    path = P.path("piece_bpe_32k.model")
    pieces.check_model(path)
    sp, texts = pieces.load(path), ["", *fuzz(3000)]
    table = pieces.ChunkTable(sp)
    table.most = 50  # the table turns over all the time
    for text, packed in zip(texts, table.encode_texts(texts)):
        assert memoryview(packed).cast("I").tolist() == sp.encode(text, add_bos=True, add_eos=True), repr(text)


def test_words_equal_whole_text():
    words = token_files.WordTable(P.path("word_bpe_49k.json"))
    words.most = 50
    texts = ["", *fuzz(3000, 2)]
    assert words.most == 50
    for text, packed in zip(texts, words.encode(texts)):
        assert memoryview(packed).cast("I").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_of_the_fast_model():
    words = token_files.WordTable(P.path("word_bpe_49k.json"))
    assert words.model is not None
    draw = random.Random(7)
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    letters += list("'.,-;|<>019\u00d7\u00bd\u00ad")
    for word in ["".join(draw.choice(letters[:60] if k % 2 else letters) for _ in range(draw.randint(1, 25))) for k in range(4000)] + [
            "a", "A,", "x" * 900, "it's", "We'Ll've", "<|endoftext|>", "a<|startoftext|>b", "\u0130x", "1st"]:
        assert np.frombuffer(next(words.encode([word])), "<u4").tolist() == words.tokenizer.encode(word, add_special_tokens=False).ids, word


def test_base_and_words_are_checked():
    path = P.path("word_bpe_49k.json")
    token_files.check_words(path, 49_408)
    for base in (49_407, 1 << 21):
        with pytest.raises(ValueError):
            token_files.check_words(path, base)
    with pytest.raises(ValueError):
        token_files.check_words(P.path("byte_bpe_50k.json"), 1 << 17)


def test_repeats_shrink_until_rules_cost_more():
    draw = np.random.default_rng(5)
    passage = draw.integers(0, 49_000, 1000).astype("<u4")
    ids = np.tile(passage, 1000)
    packed = token_files.compress(ids, np.array([0, len(ids)]), 49_408)
    assert len(packed) < 60_000
    block = token_files.Block(packed)
    assert (block.expand(block.sequence) == ids).all()
    plain = draw.integers(0, 49_000, 20_000).astype("<u4")  # nothing repeats, so no rule is made
    assert len(token_files.Block(token_files.compress(plain, np.array([0, len(plain)]), 49_408)).rules) == 0
    full = np.tile(draw.integers(0, 5, 50_000), 4).astype("<u4")  # the grammar ends where symbols would need more bytes
    block = token_files.Block(token_files.compress(full, np.array([0, len(full)]), (1 << 16) - 10))
    assert len(block.rules) <= 10 and (block.expand(block.sequence) == full).all()


def test_encode_decode_awkward(spark, awkward, empty):
    path = P.path("piece_bpe_32k.model")
    sp = pieces.load(path)
    want = []
    for r in awkward.collect():
        ids = sp.encode(r.text or "", add_bos=True, add_eos=True)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    got = [tuple(r) for r in pieces.encode_decode(awkward, path).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert pieces.encode_decode(empty, path).collect() == []


@pytest.mark.parametrize("size", [1, 2, 50, 4000])
def test_block_round_trip(size):
    draw = np.random.default_rng(size)
    docs = [draw.choice([5, 6, 7, 9], draw.integers(1, 40)).astype("<u4") for _ in range(size)] + [np.full(3000, 4, "<u4")]
    starts = np.append(0, np.cumsum([len(d) for d in docs]))
    block = token_files.Block(token_files.compress(np.concatenate(docs), starts, 100))
    assert (block.expand(block.sequence) == np.concatenate(docs)).all()
    assert (block.counts() == np.diff(starts)).all()
    assert all((block.document(k) == docs[k]).all() for k in (0, size // 2, size))
    if size > 100:
        assert len(block.sequence) < 0.6 * starts[-1] and len(block.rules)


def test_files_round_trip(spark, awkward, empty, tmp_path, monkeypatch):
    path = P.path("word_bpe_49k.json")
    monkeypatch.setattr(token_files, "BLOCK", 20_000)
    words = token_files.WordTable(path)
    token_files.write(awkward, str(tmp_path / "t"), path, 2, partitions=3)
    rows = token_files.read(spark, str(tmp_path / "t"), contents=True).orderBy("start").collect()
    assert len(rows) == awkward.count()
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    want = [(r.doc_id, words.tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in awkward.collect()]
    assert sorted(((r.doc_id, r.ids) for r in rows), key=repr) == sorted(want, key=repr)
    token_files.write(empty, str(tmp_path / "e"), path, 2, partitions=2)
    assert token_files.read(spark, str(tmp_path / "e")).collect() == []


def test_new_words_of_a_group_are_split_together():
    """One pass of the piece pattern serves all plain words of a group, whatever stands beside them; ids are the tokenizer's."""
    path = P.path("word_bpe_49k.json")
    table, calls = token_files.WordTable(path), []

    class Counted:
        def __init__(self, pattern):
            self.pattern = pattern

        def findall(self, text):
            calls.append(text)
            return self.pattern.findall(text)

    table.pieces = Counted(table.pieces)
    texts = ["It's a TEST, isn't it? a.b 12,5 x'll", "", "a.b 12,5 -- (new) İÉté 日本 <|x y", "It's   x'll"]
    want = [table.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in table.encode(texts)] == want
    assert len(calls) == 1


@pytest.mark.parametrize("base", [300, 1 << 16])
def test_blocks_of_both_widths(base):
    """Symbols of two and of four bytes, runs, documents of one id, and pairs that stand only across documents."""
    rng = np.random.default_rng(3)
    docs = [np.array([7])] * 50 + [np.full(n, 5) for n in (2, 3, 64, 1000)] + [np.tile(rng.integers(0, 300, 40), 30) for _ in range(9)]
    starts = np.append(0, np.cumsum([len(d) for d in docs]))
    block = token_files.Block(token_files.compress(np.concatenate(docs).astype("<u4"), starts, base))
    assert block.counts().tolist() == [len(d) for d in docs] and len(block.sequence) < starts[-1] / 4
    assert all(block.document(k).tolist() == d.tolist() for k, d in enumerate(docs))
