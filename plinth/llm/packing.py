"""Texts packed into containers of a fixed number of tokens by a distributed grouping genetic algorithm.

Method. Items are spread over blocks by hash. Several islands hold a population of packings of each block.
A generation crosses two parents by injecting whole well-filled containers of one into the other, removes the
documents that then occur twice, and puts the displaced ones by best fit; now and then the emptiest containers
are dissolved. Generations follow each other until a packing is an optimum (no container over the lower bound, at most
one badly filled) or PATIENCE of them bring nothing better. After every epoch each island sends its elite to the next island of its block. The best packing
of each block survives; the documents of its badly filled containers are pooled over blocks and packed again,
so that blocks cost no more than a few containers altogether.

An item is divided only if it alone exceeds the capacity: into full containers and a rest, which is an item.

Scale. A block has a bounded number of items whatever the data; no group grows with it. The pool of one round
is a small part of the items, is spread over blocks in its turn, and rounds stop when one block is left.

Defined results: null and empty texts have no tokens and go into containers as items of size 0; repeated rows
are packed one by one; an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import base64
import bisect
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.session import cut

CAPACITY = 2048
BLOCK_ITEMS = 4000
ISLANDS, EPOCHS, POPULATION = 2, 2, 8
#: Generations in a row that bring no better packing, after which a population counts as settled.
PATIENCE = 20
#: Containers filled less than this are pooled and packed again with those of other blocks.
WELL_FILLED = 0.98


@lru_cache(maxsize=4)
def encoder(path: str):
    """The public byte-level vocabulary at `path` (ranks, or a library's own JSON file); strings of special tokens are ordinary text."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(path: str):
    @F.pandas_udf("bigint")  # type: ignore[call-overload]
    def run(s: pd.Series) -> pd.Series:
        count = encoder(path)
        return pd.Series(count([x if isinstance(x, str) else "" for x in s]), dtype="int64")

    return run


class _Bins:
    """Containers by free room; best fit is a bisection."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.room, self.order = capacity, [], [], []

    def open(self, items: list[int], room: int) -> None:
        self.items.append(items)
        self.room.append(room)
        bisect.insort(self.order, (room, len(self.items) - 1))

    def put(self, i: int, size: int) -> None:
        k = bisect.bisect_left(self.order, (size, -1))
        if k == len(self.order):
            self.open([i], self.capacity - size)
            return
        room, b = self.order.pop(k)
        self.items[b].append(i)
        self.room[b] = room - size
        bisect.insort(self.order, (room - size, b))


def _fit(sizes: np.ndarray, order, capacity: int, given: list[list[int]] = ()) -> list[list[int]]:
    bins = _Bins(capacity)
    for g in given:
        bins.open(list(g), capacity - int(sizes[g].sum()))
    for i in order:
        bins.put(int(i), int(sizes[i]))
    return bins.items


def _threes(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers begun with the largest item and filled by the one or two others that leave least room: for items so large
    that few fit a container, where best fit leaves gaps."""
    order = np.argsort(sizes, kind="stable")
    left = sizes[order].astype(np.int64)
    out = []
    while len(left):
        take, room = [len(left) - 1], capacity - int(left[-1])
        rest = left[:-1]
        k = int(np.searchsorted(rest, room, side="right")) - 1
        if k >= 0:
            best, add = int(rest[k]), [k]
            i = np.arange(k + 1)
            j = np.minimum(np.searchsorted(rest, room - rest[: k + 1], side="right") - 1, i - 1)  # the smaller of two
            two = np.where(j >= 0, rest[: k + 1] + rest[np.maximum(j, 0)], 0)
            if len(two) and two.max() > best:
                m = int(two.argmax())
                add = [m, int(j[m])]
            take += add
        out.append([int(order[t]) for t in take])
        left, order = np.delete(left, take), np.delete(order, take)
    return out


def _score(packing: list[list[int]], sizes: np.ndarray, capacity: int) -> float:
    """Fewer containers first, then fuller ones: the mean square fill, as usual for grouping algorithms."""
    fill = np.array([sizes[b].sum() for b in packing]) / capacity
    return float((fill**2).mean()) - len(packing)


def _cross(a: list[list[int]], b: list[list[int]], sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Inject the well-filled containers of a random part of `b` into `a`."""
    fill = np.array([sizes[x].sum() for x in b]) / capacity
    pick = [b[k] for k in np.flatnonzero((fill >= WELL_FILLED) & (rng.random(len(b)) < 0.3))]
    taken = {i for x in pick for i in x}
    kept, loose = [], []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(x)
        else:
            loose += [i for i in x if i not in taken]
    kept.sort(key=lambda x: sizes[x].sum())
    for x in kept[: max(1, len(kept) // 20)]:  # mutation: the emptiest are dissolved
        loose += x
    rest = kept[max(1, len(kept) // 20) :]
    rest = [_improved(x, loose, sizes, capacity) for x in rest]
    loose.sort(key=lambda i: -sizes[i])
    return _fit(sizes, loose, capacity, pick + rest)


def _improved(x: list[int], loose: list[int], sizes: np.ndarray, capacity: int) -> list[int]:
    """A container that is not full takes displaced items for one or two of its own, where it then holds more; smaller items,
    which fit anywhere, are displaced instead."""
    gap = capacity - int(sizes[x].sum())
    if gap <= 0 or not loose:
        return x
    loose.sort(key=lambda i: sizes[i])
    order = [int(sizes[i]) for i in loose]
    best = (0, None, None)
    subs = [(i,) for i in range(len(x))] + [(i, j) for i in range(len(x)) for j in range(i + 1, len(x))][:200]
    for out in subs:
        have = sum(int(sizes[x[i]]) for i in out)
        k = bisect.bisect_right(order, have + gap) - 1
        if k >= 0 and order[k] - have > best[0]:
            best = (order[k] - have, out, k)
    if best[1] is None:
        return x
    new = loose.pop(best[2])
    gone = [x[i] for i in best[1]]
    loose += gone
    return [i for n, i in enumerate(x) if n not in best[1]] + [new]


def _open_ends(packing: list[list[int]], sizes: np.ndarray, capacity: int) -> tuple[int, int]:
    """(containers over the lower bound, badly filled ones but for one): what evolution can still win; (0, 0) is an optimum."""
    fill = np.array([sizes[b].sum() for b in packing])
    least = max(1, -(-int(sizes.sum()) // capacity))
    return len(packing) - least, max(0, int((fill < int(WELL_FILLED * capacity)).sum()) - 1)


def _evolve(sizes: np.ndarray, elites: list[list[list[int]]], capacity: int, seed: int) -> list[list[int]]:
    rng = np.random.default_rng(seed)
    n = len(sizes)
    people = list(elites)
    if not people and sizes.sum() and n * capacity <= 5 * sizes.sum():
        people.append(_threes(sizes, capacity))
    ends = [_open_ends(p, sizes, capacity) for p in people]
    while len(people) < POPULATION and not (ends and min(ends) == (0, 0)):
        noise = 1 + 0.15 * rng.random(n) * (len(people) > 0)
        people.append(_fit(sizes, np.argsort(-(sizes * noise), kind="stable"), capacity))
        ends.append(_open_ends(people[-1], sizes, capacity))
    best, idle = min(ends), 0
    if best == (0, 0):
        return people[ends.index(best)]
    marks = [_score(p, sizes, capacity) for p in people]
    while best > (0, 0) and idle < PATIENCE:
        x, y = rng.choice(len(people), 2, replace=False)
        child = _cross(people[x], people[y], sizes, capacity, rng)
        s, end = _score(child, sizes, capacity), _open_ends(child, sizes, capacity)
        idle += 1
        if end < best:
            best, idle = end, 0
        worst = int(np.argmin(marks))
        if s > marks[worst]:
            people[worst], marks[worst] = child, s
        if end == (0, 0):
            return child
    return people[int(np.argmax(marks))]


_ITEM = "doc_id long, piece int, size long, row long, block long, island int"
_SENT = f"{_ITEM}, bin int, home int"


def _pack_blocks(items: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, size, row, block, bin) of the best packing of each block. One shuffle per epoch; every group
    has the items of one block and at most one migrant packing."""
    state = items.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    state = state.withColumn("bin", F.lit(None).cast("int")).withColumn("home", F.lit(None).cast("int"))

    def epoch(number: int):
        def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
            block, island = int(key[0]), int(key[1])
            first = pdf["home"].isna().all()
            homes = [None] if first else sorted(pdf["home"].unique())
            frames = [pdf if h is None else pdf[pdf["home"] == h] for h in homes]
            frames = [f.sort_values("row").reset_index(drop=True) for f in frames]
            sizes = frames[0]["size"].to_numpy()
            elites = []
            if not first:
                for f in frames:
                    groups: dict[int, list[int]] = {}
                    for i, b in enumerate(f["bin"].to_numpy()):
                        groups.setdefault(int(b), []).append(i)
                    elites.append(list(groups.values()))
            best = _evolve(sizes, elites, capacity, seed=block * 7919 + island * 104729 + number)
            where = np.empty(len(sizes), dtype=np.int32)
            for b, members in enumerate(best):
                where[members] = b
            out = frames[0][["doc_id", "piece", "size", "row"]].copy()
            out["block"], out["island"], out["bin"], out["home"] = block, island, where, island
            return out[["doc_id", "piece", "size", "row", "block", "island", "bin", "home"]]

        return run

    for e in range(EPOCHS):
        state = state.groupBy("block", "island").applyInPandas(epoch(e), _SENT)
        if e + 1 < EPOCHS:  # the elite stays and also moves to the next island
            moves = F.array(F.col("island"), ((F.col("island") + 1) % ISLANDS).cast("int"))
            state = state.withColumn("island", F.explode(moves))

    def best(key, pdf: pd.DataFrame) -> pd.DataFrame:
        marks = {}
        for h, f in pdf.groupby("home"):
            fill = f.groupby("bin")["size"].sum().to_numpy() / capacity
            marks[h] = float((fill**2).mean()) - len(fill)
        h = max(sorted(marks), key=marks.get)
        return pdf[pdf["home"] == h][["doc_id", "piece", "size", "row", "block", "bin"]]

    return state.groupBy("block").applyInPandas(best, "doc_id long, piece int, size long, row long, block long, bin int")


def pack(docs: DataFrame, path: str | None = None, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY, rounds: int = 3) -> DataFrame:
    """(doc_id, piece, tokens, container): the container of every document, or of every piece of one that alone
    exceeds the capacity. `path` is the file of the public vocabulary."""
    path = path or vocabulary()
    sized = docs.select(F.col(doc).cast("long").alias("doc_id"), token_counts(path)(F.col(text)).alias("n"))
    full = F.when(F.col("n") > capacity, F.ceil(F.col("n") / capacity) - 1).otherwise(0).cast("int")
    pieces = sized.select(
        "doc_id",
        F.explode(F.transform(F.sequence(F.lit(0), full), lambda p: F.struct(p.alias("piece"), F.when(p < full, F.lit(capacity)).otherwise(F.col("n") - full * capacity).cast("long").alias("size")))).alias("p"),
    ).select("doc_id", "p.piece", "p.size")
    pieces = cut(pieces)  # tokenizing once; rows keep their place in it, so that their number is the same at every reading
    pieces = pieces.withColumn("row", F.monotonically_increasing_id())
    done, todo = [], pieces
    for r in range(rounds):
        n = todo.count()
        if n == 0:
            break
        blocks = max(1, -(-n // BLOCK_ITEMS))
        packed = cut(_pack_blocks(todo.withColumn("block", F.pmod(F.xxhash64("row", F.lit(r)), F.lit(blocks))), capacity))
        name = F.concat_ws("-", F.lit(r), "block", "bin").alias("container")
        if blocks == 1 or r + 1 == rounds:
            done.append(packed.select("doc_id", "piece", F.col("size").alias("tokens"), name))
            break
        fill = packed.groupBy("block", "bin").agg(F.sum("size").alias("_fill"))
        marked = packed.join(fill, ["block", "bin"])
        good = F.col("_fill") >= int(WELL_FILLED * capacity)
        done.append(marked.where(good).select("doc_id", "piece", F.col("size").alias("tokens"), name))
        todo = marked.where(~good).select("doc_id", "piece", "size", "row")
    out = None
    for d in done:
        out = d if out is None else out.unionByName(d)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, piece int, tokens long, container string")
    return out


def divided(packing: DataFrame) -> DataFrame:
    """doc_id of every document that had to be divided, that is, alone exceeds the capacity."""
    return packing.where(F.col("piece") > 0).select("doc_id").distinct()
