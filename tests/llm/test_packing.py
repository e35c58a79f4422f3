import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm.packing import Tournament, encoding, first_fit_decreasing, pack_documents

PATH = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
pytestmark = pytest.mark.skipif(not __import__("os").path.exists(PATH), reason="no tokenizer file")


def naive_first_fit(sizes, capacity):
    rooms, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        for b, room in enumerate(rooms):
            if room >= sizes[i]:
                break
        else:
            b = len(rooms)
            rooms.append(capacity)
        rooms[b] -= sizes[i]
        out[i] = b
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_tree_is_first_fit(sizes):
    assert first_fit_decreasing(sizes, 50) == naive_first_fit(sizes, 50)


def test_too_large():
    with pytest.raises(ValueError):
        Tournament(3, 10).place(11)


def test_documents(spark):
    draw = random.Random(1)
    texts = ["alpha beta " * draw.choice([1, 5, 30, 200, 900]) for _ in range(200)] + [None, "", "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = pack_documents(df, capacity=256, group_tokens=20_000).toPandas()
    count = {i: len(encoding(PATH).encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert out.groupby("doc_id")["n_tokens"].sum().to_dict() == count
    assert out.groupby("container_id")["n_tokens"].sum().max() <= 256
    assert all((g["n_pieces"] == max(1, -(-count[i] // 256))).all() and sorted(g["piece"]) == list(range(len(g))) for i, g in out.groupby("doc_id"))
    assert all((g.sort_values("piece")["token_start"] == g.sort_values("piece")["piece"] * 256).all() for _, g in out.groupby("doc_id"))
    least = -(-sum(count.values()) // 256)
    assert out["container_id"].nunique() <= 1.1 * least


def test_empty_and_repeated(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    out = pack_documents(spark.createDataFrame([(1, "one two")] * 3 + [(None, None)], "doc_id bigint, text string")).collect()
    assert len(out) == 4 and len({r["container_id"] for r in out}) == 1
