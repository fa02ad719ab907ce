import random
import re

from riskloom.llm.quality import judge, measure

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
            "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines), "n_repeat_words": len(inside)}


def test_counts_against_brute_force(spark, awkward, empty):
    draw = random.Random(3)
    texts = ["".join(draw.choice(["a ", "b ", "c ", "\n", "# ", "é ", "a b c d e ", "🤖 "]) for _ in range(draw.randint(0, 60))) for _ in range(200)]
    docs = awkward.select("doc_id", "text", "n_words").unionByName(
        spark.createDataFrame([(100 + i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, n_words int"))
    rows = measure(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if len(r.text or "") < 5000:
            assert {k: r[k] for k in brute("")} == brute(r.text), r.text
    assert measure(empty).collect() == []


def test_rules(spark):
    good = "The house on the hill is old and the river runs by it in the sun. " * 1
    rows = [(1, good), (2, good.upper().replace(" ", "!! ")), (3, " ".join(w + "***" for w in good.split())), (4, "xyz " * 40), (5, None), (6, ""),
            (7, "short text"), (8, "\n".join([good] + ["same line"] * 9))]
    out = {r.doc_id: r for r in judge(measure(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    assert [i for i in out if out[i].kept] == [1]
    assert "symbols_per_word" in out[3].failed and "upper_letters_per_char" in out[2].failed and out[7].failed[0] == "n_words"
