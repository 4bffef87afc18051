from collections import Counter

import numpy as np

from hearthframe.llm import language


def brute(text):
    """Counts of padded 1- to 3-grams, as codes."""
    counts = Counter()
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    for word in low.split():
        w = f" {word} "
        for n in (1, 2, 3):
            for k in range(len(w) - n + 1):
                g = w[k : k + n]
                if g != " ":
                    counts[g] += 1
    return counts


def name(gram):
    code = 0
    for c in gram:
        code = code << 21 | ord(c)
    return (code * 0x9E3779B97F4A7C15) % 2**64 >> 32


def test_counts(monkeypatch):
    texts = ["", "Über uns, 12 ẞtraße", "a", "a b  c\n\nab", "İstanbul ist", "-- 12 --", "漢字 kana", "wort " * 4000]
    for at_once in (language.AT_ONCE, 300):
        monkeypatch.setattr(language, "AT_ONCE", at_once)
        keys, counts = language.counted(texts, np.arange(len(texts)))
        got = {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(c) for k, c in zip(keys, counts, strict=True)}
        assert got == {(i, name(g)): c for i, t in enumerate(texts) for g, c in brute(t).items()}


def test_ranks_and_distance():
    own, rank, gram = language.ranked(["aab aab", "", "b"])
    counts = brute("aab aab")
    want = sorted(counts, key=lambda g: (-counts[g], name(g)))
    assert [int(g) for g in gram[own == 0]] == [name(g) for g in want] and not (own == 1).any()
    model = language.Profiles([("xx", name("b"), 0), ("yy", name("b"), 9)])
    langs, scores = model.guess(["b", "12", None, "zz"])
    assert langs == ["xx", "und", "und", "xx"] and scores[1] == scores[2] == scores[3] == 0 and 0 < scores[0] <= 1
    assert language.Profiles([]).guess(["abc"]) == (["und"], [0.0])


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = language.op3(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert 0.15 < len(held) / len(got) < 0.35
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) / len(held) > 0.95


def test_edge_cases(spark):
    rows = [(1, "der die das und", "de", "q"), (None, "the of and to", "en", None), (3, None, "en", "q"), (4, "  12 ", None, "q"), (5, "the and " * 100_000, "en", "q"), (1, "der die das und", "de", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language.learn(df)
    out = language.identify(df, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert sorted((r.doc_id or 0, r.lang_pred) for r in out.collect()) == [(0, "en"), (1, "de"), (1, "de"), (3, "und"), (4, "und"), (5, "en")]
    assert language.identify(df.limit(0), language.learn(df.limit(0))).count() == 0


def test_counts_have_no_cap():
    """Beyond a million occurrences n-grams still stand in the order of their counts."""
    text = "z " * 1_300_000 + "a " * 1_200_000
    _, rank, gram = language.ranked([text])
    z, a = (language.ranked([c])[2][0] for c in "za")
    order = list(gram)
    assert order.index(z) < order.index(a)


def test_guess_against_a_plain_computation():
    """Predictions by dictionaries: n-grams, ranks by falling count and hash, out-of-place distance."""
    texts = {"en": "the cat and the dog are in the house", "de": "die katze und der hund sind in dem haus", "fr": "le chat et le chien sont dans la maison"}

    def profile(text):
        grams = {}
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            padded = f" {word} "
            for n in (1, 2, 3):
                for k in range(len(padded) - n + 1):
                    g = padded[k : k + n]
                    if g.strip():
                        grams[g] = grams.get(g, 0) + 1
        code = lambda g: (sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g)) * 0x9E3779B97F4A7C15 % 2**64) >> 32
        return {code(g): k for k, (g, _) in enumerate(sorted(grams.items(), key=lambda x: (-x[1], code(x[0])))[: language.RANKS])}

    learned = {n: profile(t) for n, t in texts.items()}
    model = language.Profiles([(n, g, r) for n, p in learned.items() for g, r in p.items()])
    for text in ["the dog is in the garden", "der hund und die katze", "le chien dans le jardin, et la maison"]:
        own = profile(text)
        far = {n: sum(abs(p[g] - r) if g in p else language.RANKS for g, r in own.items()) for n, p in learned.items()}
        best = min(sorted(far), key=far.get)
        langs, scores = model.guess([text])
        assert langs == [best] and abs(scores[0] - (1 - far[best] / (language.RANKS * len(own)))) < 1e-9
