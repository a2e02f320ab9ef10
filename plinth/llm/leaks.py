"""Evaluation texts inside training texts, found by winnowing.

Method. Every text is squeezed to its letters and digits (case, punctuation, markup, spacing, division at line
breaks and look-alike characters do not count). All k-grams of the squeezed text are hashed and the minimum of
every window of w hashes is kept: any shared span of at least k + w - 1 characters is guaranteed a shared
fingerprint. k and w follow from the shortest passage of `words` consecutive words in the evaluation side, so
no qualifying span can be missed. Fingerprints of both sides are joined; each hit is then extended by an exact
comparison that needs `words` whole consecutive words.

Scale. Documents are mapped to fingerprints without a shuffle; the evaluation side is broadcast only if its
fingerprints are few (checked), else both sides meet in a shuffled join on the fingerprint, where AQE splits
hot fingerprints. Candidates are (document, item) pairs, not texts. For the extension the candidates of a document are
one row; they, and the items' passages, are broadcast behind checks of rows and bytes, so that the texts are read again
where they lie; beyond the bounds the texts of documents move.

Defined results: null and empty texts match nothing; items with fewer than `words` words match nothing;
repeated document rows are reported once per doc_id; texts are read whole.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.lookalikes import LOOKALIKES
from plinth.session import cut, small

WORDS = 12
#: Evaluation fingerprints up to which the evaluation side is broadcast (16 bytes each).
BROADCAST_FINGERPRINTS = 1_000_000
#: Candidate documents, and items, up to which they are broadcast, and the bytes that one of them may have.
HIT_DOCUMENTS, HIT_BYTES = 200_000, 200
ITEMS, ITEM_BYTES = 2_000, 16_384
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_MAP = str.maketrans({k: v for k, v in LOOKALIKES.items() if len(k) == 1})
_NOT = re.compile(r"[\W_]+")
_MASK = np.uint64(0x9E3779B97F4A7C15)


def _letters(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(_MAP)).translate(_MAP)
        text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return text.casefold()


def _unmarked(text: str) -> str:
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return _letters(text)


def squeeze(text: str | None) -> str:
    """Letters and digits only, look-alikes and case folded."""
    return _NOT.sub("", _unmarked(text)) if text else ""


def passages(text: str | None, words: int = WORDS) -> list[str]:
    """Squeezed form of every run of `words` consecutive words."""
    w = [x for x in (_NOT.sub("", t) for t in _unmarked(text or "").split()) if x]
    return ["".join(w[i : i + words]) for i in range(len(w) - words + 1)]


def fingerprints(squeezed: str, k: int, window: int) -> np.ndarray:
    """Distinct minima over every window of k-gram hashes; a text shorter than a window keeps its least hash."""
    raw = np.frombuffer(squeezed.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = len(raw) - k + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * np.uint64(1_000_003) + raw[i : i + n]
        h ^= h >> np.uint64(29)
        h *= _MASK
        h ^= h >> np.uint64(32)
    if n > window:
        low, step = h, 1  # minima over 1, 2, 4, ... positions, then the two that cover a window
        while step * 2 <= window:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        rest = window - step
        h = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    else:
        h = h.min(keepdims=True)
    return np.unique(h).astype(np.int64)


def _fingerprint_column(k: int, window: int):
    @F.pandas_udf("array<bigint>")  # type: ignore[call-overload]
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([fingerprints(squeeze(x), k, window) for x in s])

    return run


def _holds(text: str, wanted: list[str]) -> bool:
    """Whether the text holds one of the passages as whole words."""
    low = _unmarked(text)
    parts = [m for m in re.finditer(r"[^\W_]+", low)]
    squeezed = "".join(m.group() for m in parts)
    starts, ends, at = set(), set(), 0
    for m in parts:
        starts.add(at)
        at += len(m.group())
        ends.add(at)
    for p in wanted:
        i = squeezed.find(p)
        while i >= 0:
            if i in starts and i + len(p) in ends:
                return True
            i = squeezed.find(p, i + 1)
    return False


def leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", fields: tuple[str, ...] = ("question", "answer"), words: int = WORDS) -> DataFrame:
    """(doc, item) of every document that holds `words` consecutive words of one of the item's fields."""

    @F.pandas_udf("array<string>")  # type: ignore[call-overload]
    def cut_up(s: pd.Series) -> pd.Series:
        return pd.Series([passages(x, words) for x in s])

    wanted = items.select(F.col(item).alias("_item"), F.explode(F.array(*[F.col(f) for f in fields])).alias("_t")).where(F.col("_t").isNotNull())
    wanted = wanted.select("_item", cut_up("_t").alias("_p")).where(F.size("_p") > 0)
    shortest = wanted.select(F.min(F.array_min(F.transform("_p", lambda p: F.length(p)))).alias("n")).first().n
    if shortest is None:
        return docs.sparkSession.createDataFrame([], f"{doc} long, {item} long")
    k = max(4, min(24, shortest // 2))
    window = max(1, shortest - k + 1)
    prints = _fingerprint_column(k, window)
    # an item's passages each have at least one window: fingerprint each by itself
    side = wanted.select("_item", F.explode("_p").alias("_q")).select("_item", F.explode(prints("_q")).alias("_f")).distinct()
    train = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("_doc"), F.explode(prints(F.col(text))).alias("_f"))
    pairs = train.join(small(side, BROADCAST_FINGERPRINTS), "_f").select("_doc", "_item").distinct()
    pairs = cut(pairs.groupBy("_doc").agg(F.collect_set("_item").alias("_items")))
    need = cut(wanted.groupBy("_item").agg(F.array_distinct(F.flatten(F.collect_list("_p"))).alias("_p")))

    @F.pandas_udf("boolean")  # type: ignore[call-overload]
    def extend(t: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([isinstance(a, str) and _holds(a, list(b)) for a, b in zip(t, p)])

    hits = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")).join(small(pairs, HIT_DOCUMENTS, HIT_BYTES), "_doc")
    hits = hits.withColumn("_item", F.explode("_items")).join(small(need, ITEMS, ITEM_BYTES), "_item").where(extend("_text", "_p"))
    return hits.select(F.col("_doc").alias(doc), F.col("_item").alias(item)).distinct()
