"""Problem 6: documents into containers of fixed token capacity.

Method: first-fit decreasing over a tournament tree of the containers' free
room, independently in randomised groups of documents.  A group of thousands
of documents leaves only its last few containers part empty, so grouping costs
almost nothing in room while no task ever sees more than one group.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import cut_lineage

CAPACITY = 2048
#: A public byte-level BPE vocabulary in tiktoken's rank format; another path may be given.
TOKENIZER = os.environ.get("FAULTLINE_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: the vocabulary's pattern of pre-tokens.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Aimed size of a group, in tokens and in rows.
GROUP_TOKENS, GROUP_ROWS = 4_000_000, 20_000


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a rank file, at its path or as shipped with the job; loaded once a Python worker."""
    import tiktoken

    with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Rows (doc_id, n_tokens) for every document; NULL and empty texts have 0 tokens.  The rank file is shipped to executors that lack it."""
    if os.path.exists(tokenizer):
        documents.sparkSession.sparkContext.addFile(tokenizer)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(tokenizer).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(encode(t)) if t else 0 for t in batch["text"]]})

    chosen = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInPandas(count, f"doc_id {dict(chosen.dtypes)['doc_id']}, n_tokens bigint")


class Tournament:
    """Free room of containers as a tournament tree: each node holds the most room below it."""

    def __init__(self, containers: int, capacity: int) -> None:
        self.leaves = 1 << max(0, containers - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Take ``size`` from the first container with room for it; its number."""
        room, node = self.room, 1
        if room[1] < size:
            raise ValueError(f"no container has room for {size}")
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        room[node] -= size
        leaf = node - self.leaves
        while node > 1:
            node //= 2
            left, right = room[2 * node], room[2 * node + 1]
            room[node] = left if left > right else right
        return leaf


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item; the largest are placed first, equal ones in the order given."""
    tree, out = Tournament(len(sizes), capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        out[i] = tree.place(sizes[i])
    return out


def pack_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, seed: int = 17, group_tokens: int = GROUP_TOKENS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows (doc_id, piece, n_pieces, token_start, n_tokens, container_id): every document, or each piece of one that exceeds the capacity.

    Only such documents are split: into full pieces and a rest, which is
    packed like a document.  NULL, empty and tokenless documents take no room
    and share the first container of their group.  Repeated rows are packed as
    often as they occur.  An empty input gives an empty result.

    Action: counts the tokens in one pass and keeps (doc_id, n_tokens) in the
    checkpoint folder, since the number of groups depends on the total.
    Groups are drawn at random, piece by piece, so neither a huge document nor
    many empty or repeated ones make a large group (a hash of the id would put
    all copies of one into the same).  The draw is seeded and made over the
    kept sizes, so a repeated task draws the same.
    """
    sizes = cut_lineage(token_counts(documents, doc_id, text, tokenizer))
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.lit(capacity))).cast("bigint")
    pieces = sizes.withColumn("n_pieces", n_pieces).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_pieces") - 1)))
    pieces = pieces.withColumn("token_start", F.col("piece") * capacity).withColumn("n_tokens", F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - F.col("token_start")))
    totals = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum(n_pieces), F.lit(0))).first()
    groups = max(1, -(-totals[0] // group_tokens), -(-totals[1] // group_rows))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins = first_fit_decreasing(frame["n_tokens"].tolist(), capacity)
        return frame.assign(container_id=[int(g) << 32 | b for g, b in zip(frame["grp"], bins, strict=True)]).drop(columns="grp")

    drawn = pieces.withColumn("grp", F.floor(F.rand(seed) * groups).cast("bigint")).select("grp", "doc_id", "piece", "n_pieces", "token_start", "n_tokens")
    schema = f"doc_id {dict(sizes.dtypes)['doc_id']}, piece bigint, n_pieces bigint, token_start bigint, n_tokens bigint, container_id bigint"
    return drawn.groupBy("grp").applyInPandas(pack, schema)
