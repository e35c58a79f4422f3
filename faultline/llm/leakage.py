"""Problem 7: held-out evaluation items that leaked into documents.

Method: a BM25 inverted index of the items, queried with every passage of
every document by block-max WAND; what scores above the threshold is verified
word by word.

The threshold loses nothing.  A leak is a window of ``MIN_WORDS`` consecutive
words of an item (all of a shorter one).  For each item the smallest BM25 sum
over its windows is the least that a passage with a leaked window can score;
weights are divided by it, so one threshold, 1, holds for all items.  Passages
overlap such that every window lies in one of them.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive words of an item that make a leak.
MIN_WORDS = 12
#: BM25 parameters.
K1, B = 1.5, 0.75
#: Words of one index term: single words are shared by nearly all texts, pairs prune a hundred times better.
TERM_WORDS = 2
#: Items of one block of a posting list.
BLOCK = 16
#: Items of one index, and indexes searched in one pass over the documents.
ITEMS_PER_INDEX, INDEXES_PER_PASS = 20_000, 5
_EPSILON = 1e-6

_WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")
_INVISIBLE = regex.compile(r"\p{Cf}+")


#: Splits as ``_WORD`` does, and faster, where no character is one that the two take differently, such as marks.
_PLAIN_WORD = re.compile(r"[^\W_]+")


_LATER = "\u3000"


@lru_cache(maxsize=1)
def _unusual() -> frozenset[str]:
    """The characters before ``_LATER`` that only one of the two patterns takes for a part of a word."""
    every = " ".join(map(chr, range(0x80, ord(_LATER))))
    return frozenset(_PLAIN_WORD.findall(every)) ^ frozenset(_WORD.findall(every))


def words(text: str) -> list[str]:
    """Maximal runs of letters, marks and digits after NFKC, without invisible format characters, case folded."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)))
    text = text.casefold()
    plain = text.isascii() or (max(characters := set(text)) < _LATER and _unusual().isdisjoint(characters))
    return (_PLAIN_WORD if plain else _WORD).findall(text)


class Postings:
    """One term's items, normalised impacts, their maximum and the maximum of each block."""

    __slots__ = ("blocks", "impacts", "items", "largest")

    def __init__(self, items: list[int], impacts: list[float]) -> None:
        self.items, self.impacts, self.largest = items, impacts, max(impacts)
        self.blocks = [max(impacts[i : i + BLOCK]) for i in range(0, len(impacts), BLOCK)]


class ItemIndex:
    """Inverted index of items with impacts over each item's own threshold.

    A term is ``gram`` consecutive words, coded as one integer; items with
    fewer words are left out.
    """

    def __init__(self, items: list[tuple[int, list[str]]], min_words: int = MIN_WORDS, gram: int = TERM_WORDS) -> None:
        kept = [(key, ws) for key, ws in items if len(ws) >= gram]
        self.keys, self.min_words, self.gram = [k for k, _ in kept], min_words, gram
        self.vocabulary: dict[str, int] = {}
        for _, ws in kept:
            for w in ws:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.base = len(self.vocabulary) + 1
        coded = [self._codes(np.array([self.vocabulary[w] for w in ws], np.int64)).tolist() for _, ws in kept]
        average = sum(map(len, coded)) / max(1, len(kept))
        counts = [Counter(c) for c in coded]
        in_items = Counter(t for c in counts for t in c)
        idf = {t: np.log1p((len(kept) - n + 0.5) / (n + 0.5)) for t, n in in_items.items()}
        lists: dict[int, tuple[list[int], list[float]]] = {}
        self.windows: list[set[tuple[str, ...]]] = []
        for i, ((_, ws), terms, tf) in enumerate(zip(kept, coded, counts, strict=True)):
            weight = {t: idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(terms) / average)) for t, n in tf.items()}
            size = min(min_words, len(ws))
            least = min(sum(weight[t] for t in set(terms[a : a + size - gram + 1])) for a in range(len(ws) - size + 1))
            self.windows.append({tuple(ws[a : a + size]) for a in range(len(ws) - size + 1)})
            for t, w in weight.items():
                at = lists.setdefault(t, ([], []))
                at[0].append(i)
                at[1].append(float(w / least))
        self.postings = {t: Postings(*x) for t, x in lists.items()}
        self.codes = np.array(sorted(self.postings), np.int64)
        self.largest = np.array([self.postings[t].largest for t in self.codes.tolist()] + [0.0])

    def _codes(self, ids: np.ndarray) -> np.ndarray:
        """Term code at each place where ``gram`` words begin; 0 where a word is in no item."""
        out = ids[: len(ids) - self.gram + 1]
        for k in range(1, self.gram):
            following = ids[k : len(ids) - self.gram + 1 + k]
            out = np.where((out > 0) & (following > 0), out * self.base + following, 0)
        return out

    def above(self, terms: set[int]) -> Iterator[int]:
        """Positions of items that score at least 1 with these distinct terms: block-max WAND."""
        lists = [[p.items[0], 0, p] for t in terms if (p := self.postings.get(t)) is not None]
        limit = 1 - _EPSILON
        while lists:
            lists.sort(key=lambda x: x[0])
            bound, pivot = 0.0, None
            for n, (_, _, p) in enumerate(lists):
                bound += p.largest
                if bound >= limit:
                    pivot = n
                    break
            if pivot is None:
                return
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            # Block maxima of the blocks that would hold the pivot item.
            bound, skip_to = 0.0, lists[pivot + 1][0] if pivot + 1 < len(lists) else None
            for x in lists[: pivot + 1]:
                at = bisect_left(x[2].items, item, x[1])
                block = at // BLOCK
                if at < len(x[2].items):
                    bound += x[2].blocks[block]
                    end = (block + 1) * BLOCK
                    after = x[2].items[end] if end < len(x[2].items) else None
                else:
                    after = None
                if after is not None and (skip_to is None or after < skip_to):
                    skip_to = after
            if bound < limit:
                # No item before the nearest block end can reach the limit.
                target = max(item + 1, skip_to) if skip_to is not None else None
                lists = self._advance(lists, pivot, target)
            elif lists[0][0] == item:
                score = sum(x[2].impacts[x[1]] for x in lists[: pivot + 1])
                if score >= limit:
                    yield item
                lists = self._advance(lists, pivot, item + 1)
            else:
                lists = self._advance(lists, pivot, item)

    @staticmethod
    def _advance(lists: list[list], pivot: int, target: int | None) -> list[list]:
        """The lists with those up to the pivot moved to their first item not before ``target``; exhausted ones dropped."""
        out = []
        for n, x in enumerate(lists):
            if n <= pivot:
                if target is None:
                    continue
                at = bisect_left(x[2].items, target, x[1])
                if at >= len(x[2].items):
                    continue
                x[0], x[1] = x[2].items[at], at
            out.append(x)
        return out

    def leaks(self, ws: list[str]) -> set[int]:
        """Keys of the items leaked into a text with the words ``ws``."""
        if not self.keys or len(ws) < self.gram:
            return set()
        terms = self._codes(np.fromiter(map(self.vocabulary.get, ws, repeat(0)), np.int64, len(ws)))
        hits = np.flatnonzero(terms)
        if not len(hits):
            return set()
        bounds = np.zeros(len(terms) + 1)
        at = np.minimum(np.searchsorted(self.codes, terms[hits]), len(self.codes) - 1)
        bounds[hits + 1] = np.where(self.codes[at] == terms[hits], self.largest[at], 0.0)
        sums = np.cumsum(bounds)
        starts = np.arange(0, max(1, len(ws) - self.min_words + 1), self.min_words)
        ends = np.minimum(starts + 2 * self.min_words - 1, len(ws))
        # The first pivot test of every passage at once: with all maxima below the limit there is no pivot.
        last = np.maximum(ends - self.gram + 1, starts)
        found: set[int] = set()
        for n in np.flatnonzero(sums[last] - sums[starts] >= 1 - _EPSILON):
            passage = ws[starts[n] : ends[n]]
            for item in self.above(set(terms[starts[n] : last[n]].tolist())):
                if item not in found and self._verified(passage, item):
                    found.add(item)
        return {self.keys[i] for i in found}

    def _verified(self, passage: list[str], item: int) -> bool:
        spans = self.windows[item]
        size = len(next(iter(spans)))
        return any(tuple(passage[a : a + size]) in spans for a in range(len(passage) - size + 1))


def build_indexes(items: list[tuple[int, str]], min_words: int = MIN_WORDS) -> list[ItemIndex]:
    """An index of items by terms of ``TERM_WORDS`` words, and one by single words for items of fewer."""
    texts = [(key, words(text)) for key, text in items if text]
    short, long = [x for x in texts if 0 < len(x[1]) < TERM_WORDS], [x for x in texts if len(x[1]) >= TERM_WORDS]
    return [ItemIndex(group, min_words, gram) for group, gram in ((long, TERM_WORDS), (short, 1)) if group]


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, item_id) for each document that holds ``min_words`` consecutive words of an item, or all of a shorter one.

    Exact: the scores only choose what is verified, and the threshold is the
    least score of a true leak.  NULL, blank and wordless documents and items
    give no row; equal item texts are all reported; a repeated document is
    reported as often.  Documents of any length are read whole.

    Action: reads the items (a held-out set, small by nature) and builds each
    index once, on the driver; indexes go to the executors as broadcasts of
    bounded size, at most ``INDEXES_PER_PASS`` of ``ITEMS_PER_INDEX`` items in
    one pass.  Documents are read and cut into words once a pass, so once for
    up to 100,000 items, without any shuffle.
    """
    chosen = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    shards = max(1, -(-chosen.count() // ITEMS_PER_INDEX))
    texts = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    schema = f"doc_id {dict(texts.dtypes)['doc_id']}, item_id bigint"
    context = documents.sparkSession.sparkContext
    out = None
    for start in range(0, shards, INDEXES_PER_PASS):
        shipped = []
        for shard in range(start, min(start + INDEXES_PER_PASS, shards)):
            rows = sorted((r[0], r[1]) for r in chosen.where(F.pmod(F.xxhash64("i"), F.lit(shards)) == shard).collect())
            shipped.append(context.broadcast(build_indexes(rows, min_words)))

        def search(batches: Iterator[pd.DataFrame], shipped: list = shipped) -> Iterator[pd.DataFrame]:
            indexes = [index for held in shipped for index in held.value]
            for batch in batches:
                hits = []
                for key, t in zip(batch["doc_id"], batch["text"], strict=True):
                    ws = words(t)
                    hits += [(key, i) for index in indexes for i in sorted(index.leaks(ws))]
                yield pd.DataFrame(hits, columns=["doc_id", "item_id"])

        part = texts.mapInPandas(search, schema)
        out = part if out is None else out.unionByName(part)
    return out
