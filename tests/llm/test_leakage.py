import random

import pytest

from faultline.llm.leakage import build_indexes, leaked_items, words

NAMES = [f"n{i}" for i in range(40)]


def naive(docs, items, k):
    out = set()
    for d, t in docs:
        ws = words(t) if t else []
        for i, x in items:
            want = words(x) if x else []
            size = min(k, len(want))
            spans = {tuple(want[a : a + size]) for a in range(len(want) - size + 1)} if want else set()
            if any(tuple(ws[a : a + size]) in spans for a in range(len(ws) - size + 1)):
                out.add((d, i))
    return out


def run(spark, docs, items, k=12):
    d = spark.createDataFrame([(*x, "") for x in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(*x, "") for x in items], "item_id bigint, item_text string, doc_id string")
    return {tuple(r) for r in leaked_items(d, i, min_words=k).collect()}


def test_words():
    assert words("The ﬁrst re‑tried­ ca​fé, １２ Straße\nx_y") == ["the", "first", "re", "tried", "café", "12", "strasse", "x", "y"]
    assert words("é") == ["é"] and words("") == words("…") == []


def test_nulls_and_empties(spark):
    docs, items = [(1, None), (2, ""), (3, "…"), (4, "one two three"), (None, "one two three")], [(1, None), (2, ""), (3, "one two three"), (4, "two"), (5, "ONE-TWO"), (6, "three two")]
    assert run(spark, docs, items) == {(4, 3), (4, 4), (4, 5), (None, 3), (None, 4), (None, 5)}
    assert run(spark, [], items) == set() and run(spark, docs, []) == set()


@pytest.mark.parametrize("seed", range(4))
def test_against_naive(seed):
    draw = random.Random(seed)
    k = draw.choice([4, 12])
    items = [(i, " ".join(draw.choice(NAMES) for _ in range(draw.choice([1, 2, k - 1, k, 30, 60])))) for i in range(60)]
    docs = []
    for d in range(150):
        ws = [draw.choice(NAMES) for _ in range(draw.randrange(0, 120))]
        if draw.random() < 0.7:
            src = items[draw.randrange(60)][1].split()
            a = draw.randrange(len(src))
            at = draw.randrange(len(ws) + 1)
            ws[at:at] = src[a : a + draw.choice([k - 1, k, k + 5, 60])]
        docs.append((d, ", ".join(ws).upper()))
    indexes = build_indexes(items, k)
    got = {(d, i) for d, t in docs for x in indexes for i in x.leaks(words(t))}
    assert got == naive(docs, items, k)


def test_search_is_exact_scoring():
    draw = random.Random(9)
    items = [(i, [draw.choice(NAMES) for _ in range(40)]) for i in range(200)]
    from faultline.llm.leakage import ItemIndex

    index = ItemIndex(items, 6)
    for _ in range(50):
        terms = set(draw.sample(index.codes.tolist(), 25))
        scores = {}
        for t in terms:
            p = index.postings[t]
            for i, w in zip(p.items, p.impacts, strict=True):
                scores[i] = scores.get(i, 0) + w
        assert sorted(index.above(terms)) == sorted(i for i, s in scores.items() if s >= 1 - 1e-6)


def test_plain_split_equals_the_full_one():
    import random
    import unicodedata

    from faultline.llm import leakage

    r = random.Random(1)
    spans = [(32, 127), (0xA0, 0x600), (0x600, 0x1200), (0x2000, 0x2200), (0x3040, 0x3100), (0xE000, 0x2FFFF)]
    for _ in range(3000):
        text = "".join(chr(r.randrange(*r.choice(spans))) for _ in range(12))
        plain = text if text.isascii() else leakage._INVISIBLE.sub("", unicodedata.normalize("NFKC", leakage._INVISIBLE.sub("", text)))
        assert leakage.words(text) == leakage._WORD.findall(plain.casefold())
