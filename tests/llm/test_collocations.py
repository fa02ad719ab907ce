import random
import re
from collections import Counter

import pytest

from compare import sorted_rows
from riskloom.llm import collocations


def brute(rows, least, top):
    """Counts of all phrases, cut by cut, straight from the definition."""
    counts: dict[str, Counter] = {}
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0A-\x0D]", low):
            words = re.findall("[^\x20\x09]+", piece)
            for m in range(1, 5):
                counts.setdefault(lang or "und", Counter()).update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        many = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        kept, around = [], {}
        for h, b in many.items():
            for m in range(2, len(h)):
                for i in range(len(h) - m + 1):
                    around.setdefault(h[i:i + m], []).append(b)
        for g, a in many.items():
            if any(100 * b >= 80 * a for b in around.get(g, [])):
                continue
            score, k = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return out


def made(n, seed):
    draw = random.Random(seed)
    words = ["a", "B", "c d e f g", "ß", "日本", "x\x1cy", "e", "a b", "a \x01", "a\x01"]
    return [(draw.choice(["en", "de", None]), "".join(draw.choice(words) + draw.choice([" ", "\t ", " ", ". ", "\n", ",", " "]) for _ in range(40)))
            for _ in range(n)]


@pytest.mark.parametrize("held", [7, 600_000])
def test_equals_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(collocations, "HELD", held)  # with the small number tasks send many runs of one beginning
    rows = made(80, 4) + [(None, None), ("fr", ""), ("es", " \n.;"), ("en", "a b c d " * 50)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n int, phrase string").repartition(4)
    for least, top in ((2, 2000), (30, 5)):
        got = collocations.top_phrases(docs, least, top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted_rows(got.collect()) == sorted_rows(brute(rows, least, top))
    assert collocations.top_phrases(docs.where("false")).collect() == []


def test_flows_are_counts():
    texts = [t for _, t in made(60, 9)] + ["p q r s t u v. " * 4]
    edges = Counter(g for t in texts for g in collocations.longest_grams(t))
    want = Counter()
    for gram, n in edges.items():
        words = gram.split(b" ")
        want.update({b" ".join(words[:k]): n for k in range(1, len(words) + 1)})
    paths, singles = collocations.flows(order := collocations.ordered(edges), [edges[g] for g in order], 3)
    got = {}
    for gram, n, low in paths:
        words = gram.split(b" ")
        for k in range(low, len(words) + 1):
            assert got.setdefault(b" ".join(words[:k]), n) == n
    assert got == {g: n for g, n in want.items() if n >= 3 and b" " in g}
    assert all(want[w] == n for w, n in singles.items()) and sum(singles.values()) == sum(edges.values())
    assert (b"p q r s", 4, 2) in paths  # one path for p q, p q r and p q r s


def test_awkward(spark, awkward):
    rows = [(r.lang, r.text) for r in awkward.collect()]
    assert sorted_rows(collocations.top_phrases(awkward, 2, 50).collect()) == sorted_rows(brute(rows, 2, 50))


def test_products_beyond_64_bits(spark, monkeypatch):
    big = 1 << 60
    counts = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, big + 2), ("en", None, 0, 3 * big // 2)],
                                   "lang string, phrase string, words int, f bigint")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a: counts)
    row = collocations.top_phrases(counts.select("lang", F_text()), 30).first()
    assert row.score == 2000000 * big // (2 * big + 3)


def F_text():
    from pyspark.sql import functions as F

    return F.lit("").alias("text")
