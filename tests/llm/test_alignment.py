import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from riskloom.llm import alignment  # noqa: E402
from test_tokens import fuzz  # noqa: E402

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(rows, a, b):
    """Straight from the definition, with the libraries and one text at a time."""
    vocab = {i: bytes(alignment.BYTE_OF[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if t != "<|endoftext|>"}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    found = []
    for key, text in rows:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        raw = b" " + (text or "").encode()
        if not text or b"".join(vocab[i] for i in x) != raw or b"".join(map(piece, y)) != raw:
            found.append((key, [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(vocab[i]) for i in x]).tolist(), np.cumsum([len(piece(i)) for i in y]).tolist()
        groups, s, t = [], 0, 0
        links = [(x[i], y[j]) for i, e in enumerate(ends_a) for j in [ends_b.index(e) if e in set(ends_b) else -1] if j >= 0] if len(x) < 400 else None
        places = {e: j for j, e in enumerate(ends_b)}
        links = [(x[i], y[places[e]]) for i, e in enumerate(ends_a) if e in places] if links is None else links
        for i, e in enumerate(ends_a):
            if e in places:
                j = places[e]
                groups.append(",".join(map(str, x[s:i + 1])) + "|" + ",".join(map(str, y[t:j + 1])))
                s, t = i + 1, j + 1
        found.append((key, x, y, links, groups))
    count = Counter(p for r in found for p in r[3])
    top = defaultdict(int)
    for (i, j), n in count.items():
        top[j] = max(top[j], n)
    out = []
    for r in found:
        links = r[3]
        text = ";".join(r[4]) if links else ""
        out.append((r[0], len(r[1]), len(r[2]), len(links), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if links else ""))
    return out


def test_vocabulary_equals_the_library(libraries):
    tool, texts = alignment.ByteLevel(A), [t for t in fuzz(3000, 5) if t] + ["a" * 5000, " " * 3000, "<|endoftext|>x", "\n\n  \t z" * 9]
    want = [e.ids for e in libraries[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert tool.encode(texts) == want


def test_gallop():
    draw = random.Random(3)
    for _ in range(300):
        a, b = (np.array(sorted(draw.sample(range(300), draw.randint(0, 60))), np.int64) for _ in "ab")
        at_a, at_b = alignment.common_ends(a, b)
        assert a[at_a].tolist() == b[at_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    uneven = np.array([1, *range(10**9, 10**9 + 1000)], np.int64)
    assert alignment.gallop(np.array([1, 5, 10**9 + 7]), uneven).tolist() == [0, -1, 8]


def test_pairs_are_suffixes():
    index = alignment.PairIndex({0: b"ab", 1: b"b", 2: b"xyz"}, {0: b"b", 1: b"ab", 2: b"cab", 3: b"b", 4: b"zz"})
    pairs = [(int(k >> 32), int(k & 0xFFFFFFFF)) for k in index.keys]
    assert pairs == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2), (1, 3)]
    assert index.find(np.array([0, 1]), np.array([2, 3])).tolist() == [2, 7]


def test_equals_brute_force(spark, awkward, libraries):
    rows = [(r.doc_id, r.text) for r in awkward.collect()] + [(100 + i, t) for i, t in enumerate(fuzz(400, 8))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, n_links string").repartition(4)
    got = [tuple(r) for r in alignment.align(docs, A, B).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, *libraries), key=repr)
    shown = alignment.align(docs, A, B, contents=True)
    assert shown.where("n_groups > 0 AND sha2(groups, 256) <> groups_sha256").count() == 0
    assert alignment.align(docs.where("false"), A, B).collect() == []


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        alignment.ByteLevel(P.path("word_bpe_49k.json"))
