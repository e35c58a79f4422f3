"""Problem 8: texts read with the wrong character encoding, found and restored.

Method: round-trip repair.  Text is encoded again with each candidate legacy
encoding and strictly decoded as the intended one, layer after layer, as long
as a garbling cost drops.  The cost is measured on the corpus itself: how few
of all documents hold a pair of neighbouring characters.  Two families of
candidates:

* UTF-8 read as a legacy encoding: each run of non-ASCII characters must
  encode and then decode as UTF-8 as a whole, and its cost in context must
  drop.  So a text garbled only in part is repaired only there.
* One legacy encoding read as another: everything decodes, so evidence is
  gathered over stretches: a two-state path over the words weighs their cost
  as they are and as restored against a price for each change of state,
  cheap between sentences and dear within one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.languages import SENTENCES
from faultline.session import cut_lineage

#: Legacy encodings that UTF-8 may have been read as, the likelier first.
UTF8_READ_AS = ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "koi8-r", "cp866"]
#: (read as, meant): one legacy encoding read as another, the likelier first.
READ_AS_MEANT = [
    ("cp1252", "cp1251"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp850", "cp1252"),
    ("cp1252", "koi8-r"), ("cp1252", "cp866"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp866", "koi8-r"), ("koi8-r", "cp866"), ("cp1251", "cp1252"), ("cp1250", "cp1252"),
    ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1250"), ("koi8-r", "cp1252"), ("cp866", "cp1252"), ("mac_roman", "cp1251"), ("cp437", "cp1251"),
]

#: A pair in so large a share of the documents (as a power of 1/2) costs nothing, and one in so small a share the most.
FREE_BITS, MOST_BITS = 5.0, 10.0
#: Documents that a corpus is short of before its own counts are trusted.
UNSEEN_DOCUMENTS = 1000
#: A pair that costs more than this marks a word that may be garbled.
RARE = 2.0
#: Further cost of a pair that no clean text is known to hold, in a restored word.
UNKNOWN_RESTORED = 2.0
#: Cost by which the first repair of a text must lower it, and by which a further run may raise it.
LEAST_DROP, MOST_RISE = 2.5, 2.5

_RUN = re.compile(r"[^\x00-\x7f]+")
_WORD = re.compile(r"[^ \t\n\r\f\v]*[^\x00-\x7f][^ \t\n\r\f\v]*")
_CYRILLIC, _LATIN = re.compile("[Ѐ-ӿ]"), re.compile("[A-Za-z]")
_ASCII = np.array([32 if chr(c).isspace() or c < 32 else 48 if chr(c).isdigit() else c for c in range(128)], np.uint32)
_NO_BREAK, _ALONE = 0xA0, 1
_PLAIN = {c: int(_ASCII[c]) for c in range(128)} | {_NO_BREAK: 32}
#: A no-break blank inside a word that only a wrong encoding would make.
_BLANKS = re.compile("(?<=[^\\W\\d_])[\u00a0\u00ad](?=[^\\W\\d_])")
_SHIFT = 21


def _legacy_characters() -> frozenset[str]:
    """What the Windows code pages of Europe and KOI8 can write: characters that clean text may hold though its corpus lacks them."""
    pages = ["cp1250", "cp1251", "cp1252", "cp1253", "cp1254", "cp1257", "cp1258", "koi8-u"]
    return frozenset(c for p in pages for c in bytes(range(160, 256)).decode(p, "ignore") if c.isalpha())


_LEGACY = _legacy_characters()


def pair_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Document number and code of each pair of neighbouring characters that holds a non-ASCII one; blanks (no-break ones too) are one character, digits too.

    A text begins and ends with a blank.  All texts are coded at once.
    """
    data = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    special = (data > 127) & (data != _NO_BREAK)
    starts = np.flatnonzero(special[:-1] | special[1:])
    left, right = (np.where(x < 128, _ASCII[np.minimum(x, 127)], np.where(x == _NO_BREAK, 32, x)).astype(np.int64) for x in (data[starts], data[starts + 1]))
    # A character between two blanks is a word of its own: its blanks count as another character.
    opens, closes = (left == 32) & special[starts + 1], (right == 32) & special[starts]
    follows = np.append(starts[1:] == starts[:-1] + 1, False)
    alone = opens & follows & np.append(closes[1:], False)
    left, right = np.where(alone, _ALONE, left), np.where(np.append(False, alone[:-1]), _ALONE, right)
    # A pair that begins at the blank after a text belongs to the next one, unless its left side is the text's last character.
    return np.searchsorted(ends, starts, side="right"), (left << _SHIFT) | right


@lru_cache(maxsize=1)
def utf8_pairs() -> np.ndarray:
    """Sorted codes of the pairs that UTF-8 read as a one-byte encoding is made of: two bytes of a letter or sign, or the opening of a punctuation mark."""
    out = set()
    for encoding in UTF8_READ_AS[:7]:
        char = {b: ord(c) for c, b in _encoder(encoding).items()}
        for lead in range(0xC2, 0xE0):
            for following in range(0x80, 0xC0):
                meant = bytes([lead, following]).decode()
                if meant in _LEGACY or 0xA0 <= ord(meant) < 0x100:
                    out.add(_PLAIN.get(char[lead], char[lead]) << _SHIFT | _PLAIN.get(char[following], char[following]))
        out.add(char[0xE2] << _SHIFT | char[0x80])
    return np.array(sorted(out), np.int64)


def _among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    place = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return known[place] == codes


class PairModel:
    """What pairs of characters cost: nothing if common in the corpus or in the sample sentences, the more the rarer."""

    def __init__(self, counts: dict[int, int] | None = None, documents: int = 0) -> None:
        self.counts, self.documents = counts or {}, documents
        sentences = [v for line in SENTENCES.strip().split("\n") for v in (line, line.upper(), line.title())]
        self.costs = {int(c): 0.0 for c in np.unique(pair_codes(sentences)[1])}
        for code, n in self.counts.items():
            bits = math.log2((documents + UNSEEN_DOCUMENTS) / n)
            cost = min(max(bits, FREE_BITS), MOST_BITS) - FREE_BITS
            self.costs[code] = min(cost, self.costs.get(code, cost))
        self.known = {chr(c) for code in self.costs for c in (code >> _SHIFT, code & ((1 << _SHIFT) - 1)) if c > 127}
        self.free = np.array(sorted({c for c, cost in self.costs.items() if cost <= RARE} - set(utf8_pairs().tolist())), np.int64)
        self.cost = lru_cache(maxsize=100_000)(self._cost)
        self.in_sight = lru_cache(maxsize=50_000)(self._in_sight)
        self.swaps = lru_cache(maxsize=200_000)(self._swaps)

    def _odd(self, text: str) -> float:
        """Cost of characters that neither clean texts nor European code pages hold; a lone letter of a foreign script costs twice as much."""
        strange = [c if c > "\x7f" and c not in self.known and c not in _LEGACY else "" for c in text]
        total = 0.0
        for n, c in enumerate(strange):
            if c:
                code = ord(c)
                if 0x2010 <= code < 0x27C0 or code >= 0x1F000 or 0xA0 <= code < 0xC0:
                    total += 0.5
                elif code < 0xA0 or 0xE000 <= code < 0xF900:
                    total += 3.0
                else:
                    total += 4.0 if (n and strange[n - 1]) or (n + 1 < len(strange) and strange[n + 1]) else 8.0
        return total

    def _cost(self, text: str, restored: bool = False) -> float:
        if text.isascii():
            return 0.0
        most = MOST_BITS - FREE_BITS
        codes = [_PLAIN.get(c, c) for c in map(ord, text)]
        if len(codes) == 3 and codes[0] == codes[2] == 32:
            codes[0] = codes[2] = _ALONE
        total, unknown = 0.0, 0
        for a, b in zip(codes, codes[1:], strict=False):
            if a > 127 or b > 127:
                cost = self.costs.get((a << _SHIFT) | b, most)
                total += cost
                unknown += cost >= most
        if restored:
            total += unknown * UNKNOWN_RESTORED + most * len(_BLANKS.findall(text))
        return total + self._odd(text)

    def _in_sight(self, left: str, run: str, right: str) -> float:
        """Cost of a repaired run in context, or that of one layer further if lower: an inner layer can look worse than the outer one."""
        cost = self.cost(left + run + right)
        if cost > 0 and not run.isascii():
            further = (round_trip(run, e, "utf-8") for e in UTF8_READ_AS)
            cost = min([cost, *(self.cost(left + f + right) + 0.5 for f in further if f is not None)])
        return cost

    def _swaps(self, word: str) -> tuple[int, ...]:
        """The places in READ_AS_MEANT whose round trip lowers the cost of a word with a rare pair; none for other words."""
        as_is = self.cost(f" {word} ")
        if as_is <= RARE:
            return ()
        fixes = (round_trip(word, *swap) for swap in READ_AS_MEANT)
        return tuple(n for n, fixed in enumerate(fixes) if fixed is not None and self.cost(f" {fixed} ", True) < as_is)

    def suspicious(self, texts: list[str]) -> np.ndarray:
        """Which texts hold a pair that is not common: the others cost too little for any repair."""
        out = np.zeros(len(texts), bool)
        documents, codes = pair_codes(texts)
        out[documents[~_among(codes, self.free)]] = True
        return out


@lru_cache(maxsize=64)
def _encoder(encoding: str) -> dict[str, int]:
    """Character -> byte; bytes the encoding leaves undefined stand for the control of the same number, as lenient readers have it."""
    out = {}
    for byte in range(256):
        try:
            char = bytes([byte]).decode(encoding)
        except UnicodeDecodeError:
            char = chr(byte)
        out.setdefault(char, byte)
    return out


@lru_cache(maxsize=100_000)
def round_trip(text: str, read_as: str, meant: str) -> str | None:
    """``text`` encoded as it was read and strictly decoded as it was meant; None if either fails."""
    table = _encoder(read_as)
    try:
        return bytes([table[c] for c in text]).decode(meant)
    except (KeyError, UnicodeDecodeError):
        return None


@lru_cache(maxsize=1)
def sample_model() -> PairModel:
    """The model of the sample sentences alone."""
    return PairModel()


def garbling_cost(text: str, model: PairModel | None = None) -> float:
    """How unlike clean text the characters of ``text`` are; 0 for ASCII."""
    return (model or sample_model()).cost(f" {text} ")


@lru_cache(maxsize=200_000)
def utf8_readings(run: str) -> dict[str, str]:
    """Encoding -> what the run meant, for each encoding in which it is UTF-8 as a whole."""
    return {e: fixed for e in UTF8_READ_AS if (fixed := round_trip(run, e, "utf-8")) is not None}


def repair_utf8(text: str, read_as: str, model: PairModel, runs: list[tuple[int, int, dict[str, str]]]) -> tuple[str, float]:
    """``text`` with its runs repaired that were UTF-8 read as ``read_as``, and by how much the cost dropped.

    Runs whose cost drops are the evidence.  With it, the other runs that
    decode are repaired too unless their cost rises clearly: some garbled
    characters look no worse than the right ones.
    """
    found, evidence = [], 0.0
    for start, end, readings in runs:
        if (fixed := readings.get(read_as)) is not None:
            left, right = text[start - 1] if start else " ", text[end] if end < len(text) else " "
            gain = model.cost(left + text[start:end] + right) - model.in_sight(left, fixed, right)
            evidence = max(evidence, gain)
            found.append((start, end, fixed, gain))
    if evidence < LEAST_DROP:
        return text, 0.0
    out, at, drop = [], 0, 0.0
    for start, end, fixed, gain in found:
        if gain > -MOST_RISE:
            out += [text[at:start], fixed]
            at, drop = end, drop + gain
    return "".join(out) + text[at:], drop


def _price(between: str) -> float:
    """Price of changing state between two words, from the text that parts them."""
    return 3.5 if "\n\n" in between else 5.0 if re.search(r"[.!?:;…][»”\"')]*\s|\n", between) else 15.0


def repair_swapped(text: str, read_as: str, meant: str, model: PairModel) -> tuple[str, float]:
    """``text`` with those stretches restored that were ``meant`` but read as ``read_as``, and by how much the cost dropped."""
    words = list(_WORD.finditer(text))
    kept, swapped, paths, fixes = 0.0, 2.5, [], []
    infinite = float("inf")
    for n, m in enumerate(words):
        word = m.group()
        fixed = round_trip(word, read_as, meant)
        price = _price(text[words[n - 1].end() - 2 : m.start() + 1]) if n else infinite
        to_kept, to_swapped = swapped + price < kept, kept + price < swapped
        paths.append((to_kept, to_swapped))
        kept, swapped = (
            (swapped + price if to_kept else kept) + model.cost(f" {word} "),
            (kept + price if to_swapped else swapped) + (infinite if fixed is None else model.cost(f" {fixed} ", True)),
        )
        fixes.append(fixed)
    state = swapped + 2.5 < kept
    chosen = [False] * len(words)
    for n in range(len(words) - 1, -1, -1):
        chosen[n] = state
        state = (not paths[n][1]) if state else paths[n][0]
    if not any(chosen):
        return text, 0.0
    out, at, drop = [], 0, 0.0
    for m, fixed, take in zip(words, fixes, chosen, strict=True):
        out += [text[at : m.start()], fixed if take else m.group()]
        at = m.end()
        drop += model.cost(f" {m.group()} ") - model.cost(f" {out[-1]} ")
    result = "".join(out) + text[at:]
    # Of two round trips that do as well, the one that scatters no Cyrillic among Latin letters is the likelier.
    cyrillic, latin = len(_CYRILLIC.findall(result)), len(_LATIN.findall(result))
    return result, drop - (1.0 if 0 < cyrillic * 10 < latin else 0.0)


def repair(text: str, model: PairModel | None = None) -> str:
    """``text`` as it was before garbling, or unchanged if no round trip lowers the cost.

    Layer after layer without a bound: a layer of UTF-8 makes the text shorter,
    and one of a legacy encoding lowers its cost at the same length, so it ends.
    """
    model = model or sample_model()
    while not text.isascii():
        best, most = text, 0.0
        runs = [(m.start(), m.end(), r) for m in _RUN.finditer(text) if (r := utf8_readings(m.group()))]
        possible = {e for _, _, readings in runs for e in readings}
        for read_as in (e for e in UTF8_READ_AS if e in possible):
            fixed, drop = repair_utf8(text, read_as, model, runs)
            if drop > most and len(fixed) < len(text):
                best, most = fixed, drop
        if best is text:
            # A round trip that lowers the cost of no word with a rare pair is not tried.
            promising = {swap for w in set(_WORD.findall(text)) for swap in model.swaps(w)}
            for swap in sorted(promising):
                fixed, drop = repair_swapped(text, *READ_AS_MEANT[swap], model)
                if drop > most and fixed != text:
                    best, most = fixed, drop
        if best is text:
            break
        text = best
    return text


def corpus_model(texts: DataFrame, text: str = "text") -> PairModel:
    """Costs from how many of all documents hold each pair; documents of ASCII alone do not count.

    One pass over all texts, counted per partition before the shuffle.  Action:
    collects the pairs that at least 1 in 2 ** MOST_BITS documents hold, so
    their number is at most 2 ** MOST_BITS times the pairs of a mean document,
    however large the corpus.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        garbled = utf8_pairs()
        for batch in batches:
            documents, codes = pair_codes(batch["text"].tolist())
            kept = ~np.isin(documents, documents[_among(codes, garbled)])
            documents, codes = documents[kept], codes[kept]
            found, n = np.unique(np.unique(documents << (2 * _SHIFT) | codes) & ((1 << (2 * _SHIFT)) - 1), return_counts=True)
            yield pd.DataFrame({"code": np.append(found, -1), "n": np.append(n, len(np.unique(documents)))})

    counted = texts.select(F.col(text).alias("text")).where(F.col("text").rlike(r"[^\x00-\x7f]")).mapInPandas(count, "code bigint, n bigint")
    counted = cut_lineage(counted.groupBy("code").agg(F.sum("n").alias("n")))
    total = counted.where("code = -1").select(F.sum("n")).first()[0] or 0
    rows = counted.where((F.col("code") >= 0) & (F.col("n") * 2 ** int(MOST_BITS) >= total + UNSEEN_DOCUMENTS)).collect()
    return PairModel({r["code"]: r["n"] for r in rows}, total)


def restored_texts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, restored_text) for documents with garbled text; restored_text is NULL if characters were destroyed.

    A text with U+FFFD, before or after repair, has lost characters.  NULL,
    empty and clean texts give no row; repeated documents give repeated rows;
    texts of any length are processed whole.  Two passes without a shuffle of
    texts: one counts pairs of characters, the other repairs the texts that
    hold a rare one or one that misread UTF-8 is made of.  A text of common
    pairs alone is clean by definition: a repair could save next to nothing.

    Action: the first pass (see ``corpus_model``).
    """
    kept = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").rlike(r"[^\x00-\x7f]"))
    fitted = corpus_model(kept)
    counts, total = fitted.counts, fitted.documents

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = PairModel(counts, total)
        for batch in batches:
            rows, texts = [], batch["text"].tolist()
            for n in np.flatnonzero(model.suspicious(texts) | batch["text"].str.contains("�", regex=False).to_numpy(bool)):
                original = texts[n]
                fixed = None if "�" in original else repair(original, model)
                if fixed is None or "�" in fixed:
                    rows.append((batch["doc_id"].iloc[n], None))
                elif fixed != original:
                    rows.append((batch["doc_id"].iloc[n], fixed))
            yield pd.DataFrame(rows, columns=["doc_id", "restored_text"])

    return kept.mapInPandas(run, f"doc_id {dict(kept.dtypes)['doc_id']}, restored_text string")
