"""Fill containers of fixed capacity with documents, measured in tokens of a public tokenizer.

Method: swap-based local search. Items start from a best-fit-decreasing packing; then every container with space, the
emptiest first, gives documents away to fuller ones: by moving one, or exchanging one for one, two for one or one for
two. Changes raise the sum of squared fills, so that the emptiest containers empty out. Where none is left, containers
take an item of just their space from a full container of more items, which opens new exchanges at the same sum. The
search ends when neither is left, or when a bound proves that the number of containers is the least possible; nothing
else ends it.

A document longer than the capacity is cut into pieces of the capacity and a rest; no other document is cut.

Scale: what fills a container by itself has one of its own and moves nowhere. All else, at most one item per document,
is dealt by a hash to shards of about SHARD items, each of which is packed on its own; a shard wastes at most part of
one container against packing all items together, one in thousands. Tokens are counted once, in place.

Defined results: null and empty texts have no tokens and are in no container; repeated texts are items of their own.
"""

from __future__ import annotations

import base64
import math
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sutraloom.runtime import collect_bounded, cut_lineage, map_columns

#: Where the public vocabulary is; a parameter of every function that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's own tokenizer cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items that are packed together.
SHARD = 20_000


@lru_cache(maxsize=4)
def encoding(pieces: bytes):
    """The tokenizer of a vocabulary file's content: ranked byte pieces, one to a line."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, pieces.splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, key: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """(key, n) of each text that has tokens. The driver reads the vocabulary, a file of some MB, and broadcasts it."""
    key_type = df.schema[key].dataType.simpleString()
    held = df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())

    def kernel(cols: dict[str, list]) -> dict[str, list]:
        encode = encoding(held.value).encode_ordinary
        rows = [(k, len(encode(t))) for k, t in zip(cols[key], cols[text]) if t]
        return {key: [r[0] for r in rows], "n": [r[1] for r in rows]}

    return map_columns(df.select(key, text), kernel, f"`{key}` {key_type}, n int")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of item numbers; items by falling size, each to the fullest container that takes it.
    Free spaces are bits of one number, so that the tightest one is found by a shift."""
    bins: list[list[int]] = []
    spaces: dict[int, list[int]] = {}
    mask = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        rest = mask >> s
        if rest:
            free = s + (rest & -rest).bit_length() - 1
            stack = spaces[free]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << free)
            bins[b].append(i)
            free -= s
        else:
            b, free = len(bins), capacity - s
            bins.append([i])
        if free:
            spaces.setdefault(free, []).append(b)
            mask |= 1 << free
    return bins


def least_containers(sizes: list[int], capacity: int) -> int:
    """A number of containers that no packing can go below. For each k: items over capacity - k stand alone, those over
    half the capacity stand in different ones, and what is between k and the half must fit beside the latter."""
    s = np.sort(np.asarray(sizes, dtype=np.int64))
    if not len(s):
        return 0
    sums = np.concatenate(([0], np.cumsum(s)))
    k = np.arange(capacity // 2 + 1)
    half = np.searchsorted(s, capacity // 2, "right")
    large, small = np.searchsorted(s, capacity - k, "right"), np.minimum(np.searchsorted(s, k, "left"), half)
    beside = (large - half) * capacity - (sums[large] - sums[half])
    return int((len(s) - half + np.maximum(0, -(-(sums[half] - sums[small] - beside) // capacity))).max())


class Search:
    """Local search on one packing. A change takes tokens from a container (the donor) to another that has space and
    at least the donor's fill, so that the sum of squared fills grows: a move, or one or two of the donor's items for
    one item, or one for two. Each kind is looked up by size over all items and pairs of all containers with space."""

    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int) -> None:
        self.size, self.capacity = sizes, capacity
        self.content = [list(b) for b in bins]
        self.fill = np.array([sum(sizes[i] for i in b) for b in bins], dtype=np.int64)
        self.sums: dict[tuple[int, int], np.ndarray] = {}  # of one or of two items, by (container, how many)
        self.rooms: dict[int, tuple[int, np.ndarray]] = {}
        self.changes = 0

    def run(self, least: int) -> int:
        """Changes until none is left or `least` containers are; gives the number of containers. Donors go by rising
        fill, and one that found no change is asked again only after another has. Where no change raises the squared
        fill any more, space is passed on to full containers of more items, which keeps it and gives more choice; each
        step raises the squared fill or, at the same fill, the items beside which there is space, so there is an end."""
        asked: dict[int, int] = {}
        again = True
        while again and np.count_nonzero(self.fill) > least:
            again = False
            for donor in sorted(self._open().tolist(), key=lambda b: (self.fill[b], b)):
                while asked.get(donor) != self.changes and 0 < self.fill[donor] < self.capacity:
                    asked[donor] = self.changes
                    again |= self._give(donor)
            again = again or self._pass_on()
        return int(np.count_nonzero(self.fill))

    def _pass_on(self) -> bool:
        """Every container with space takes an item of just that size from a full one that is left with more items than
        it had; whether any did."""
        full: dict[int, list[int]] = {}
        for b in np.flatnonzero(self.fill == self.capacity).tolist():
            for s in set(self._of(b, 1).tolist()):
                full.setdefault(s, []).append(b)
        done = False
        for b in self._open().tolist():
            space = int(self.capacity - self.fill[b])
            givers = [f for f in full.get(space, ()) if self.fill[f] == self.capacity and len(self.content[f]) > len(self.content[b]) + 1]
            if givers:
                self._shift(max(givers, key=lambda f: (len(self.content[f]), -f)), b, [space], [])
                done = True
        return done

    def _open(self) -> np.ndarray:
        return np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))

    def _of(self, b: int, count: int) -> np.ndarray:
        """Distinct sums of `count` items of a container."""
        got = self.sums.get((b, count))
        if got is None:
            s = np.array([self.size[i] for i in self.content[b]])
            got = np.unique(s if count == 1 else (s[:, None] + s[None, :])[np.triu_indices(len(s), 1)])
            self.sums[b, count] = got
        return got

    def _room(self, targets: np.ndarray, count: int) -> np.ndarray:
        """For each sum of `count` items: the most space of a target that holds it; -1 without one."""
        room = np.full(self.capacity + 1, -1, dtype=np.int64)
        held = [self._of(b, count) for b in targets.tolist()]
        if held:
            np.maximum.at(room, np.concatenate(held), np.repeat(self.capacity - self.fill[targets], [len(h) for h in held]))
        return room

    def _any_room(self, count: int) -> np.ndarray:
        """_room of all containers with space, made once after each change."""
        made = self.rooms.get(count)
        if made is None or made[0] != self.changes:
            made = self.rooms[count] = (self.changes, self._room(self._open(), count))
        return made[1]

    @staticmethod
    def _gains(given: np.ndarray, room: np.ndarray, most: int) -> tuple[int, int]:
        """The largest gain of giving one of the sums `given` for a smaller one that has room for it, and the sum."""
        gain = np.arange(1, most + 1)
        back = given[:, None] - gain[None, :]
        ok = (back > 0) & (back < len(room))
        ok &= room[np.where(ok, back, 0)] >= gain[None, :]
        hits = np.flatnonzero(ok.any(axis=0))
        return (0, 0) if not len(hits) else (int(gain[hits[-1]]), int(given[ok[:, hits[-1]].argmax()]))

    def _give(self, donor: int) -> bool:
        """One change that takes tokens from the donor; whether there was one."""
        free = self.capacity - self.fill
        targets = self._open()
        targets = targets[(self.fill[targets] >= self.fill[donor]) & (targets != donor)]
        if not len(targets):
            return False
        most = int(free[targets].max())
        for s in self._of(donor, 1)[::-1]:
            if s <= most:  # a move to the tightest place
                fits = targets[free[targets] >= s]
                self._shift(donor, int(fits[free[fits].argmin()]), [int(s)], [])
                return True
        for mine, theirs in ((1, 1), (2, 1), (1, 2)):
            given = self._of(donor, mine)
            if not len(given) or not self._gains(given, self._any_room(theirs), most)[0]:
                continue
            gain, total = self._gains(given, self._room(targets, theirs), most)
            if gain:
                takers = [b for b in targets if free[b] >= gain and total - gain in self._of(b, theirs)]
                self._shift(donor, min(takers, key=lambda b: (free[b], b)), self._parts(donor, total, mine), (total - gain, theirs))
                return True
        return False

    def _parts(self, b: int, total: int, count: int) -> list[int]:
        """Sizes of `count` items of a container that add up to total."""
        if count == 1:
            return [total]
        held = [self.size[i] for i in self.content[b]]
        return next([x, total - x] for n, x in enumerate(held) if total - x in held[n + 1 :])

    def _shift(self, donor: int, taker: int, given: list[int], back: tuple[int, int] | list) -> None:
        for a, b, sizes in ((taker, donor, self._parts(taker, *back) if back else []), (donor, taker, given)):
            for s in sizes:
                i = next(i for i in self.content[a] if self.size[i] == s)
                self.content[a].remove(i)
                self.content[b].append(i)
                self.fill[a] -= s
                self.fill[b] += s
        for b in (donor, taker):
            self.sums.pop((b, 1), None)
            self.sums.pop((b, 2), None)
        self.changes += 1


def local_search(sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """The containers after the changes of Search; empty ones are left out."""
    search = Search(sizes, bins, capacity)
    search.run(least_containers(sizes, capacity))
    return [c for c in search.content if c]


def pack(df: DataFrame, key: str, text: str, limits: DataFrame, limit_key: str, capacity: str, path: str = TOKENIZER, shard: int = SHARD) -> DataFrame:
    """(limit, container, key, piece, first_token, n_tokens): every document or piece in its container, for each
    capacity of `limits`. Capacities below one token and null ones are left out. `key` should be unique."""
    sizes = cut_lineage(count_tokens(df, key, text, path).where(F.col("n") > 0))
    shards = max(1, math.ceil(sizes.count() / shard))
    wanted = limits.select(F.col(limit_key).alias("limit"), F.col(capacity).cast("int").alias("capacity")).where(F.col("capacity") > 0)
    rooms = [F.struct(F.lit(r["limit"]).cast(wanted.schema["limit"].dataType).alias("limit"), F.lit(r["capacity"]).alias("capacity")) for r in collect_bounded(wanted, 1_000, "capacities")]
    each = F.explode(F.array(*rooms) if rooms else F.array().cast(f"array<struct<limit:{wanted.schema['limit'].dataType.simpleString()},capacity:int>>"))
    pieces = F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("capacity")).cast("int") - 1)
    # the few capacities stand at each document; a container holds documents of one capacity and shard
    items = (
        sizes.withColumn("_room", each).select(*sizes.columns, "_room.limit", "_room.capacity").withColumn("piece", F.explode(pieces))
        .withColumn("first_token", F.col("piece") * F.col("capacity"))
        .withColumn("n_tokens", F.least(F.col("capacity"), F.col("n") - F.col("first_token")))
        .withColumn("shard", F.pmod(F.xxhash64(key, "piece"), F.lit(shards)))
        .select("limit", "capacity", "shard", F.col(key).alias("key"), "piece", "first_token", "n_tokens")
    )

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("key", "ascending"), ("piece", "ascending")])
        size = table.column("n_tokens").to_pylist()
        room, part = table.column("capacity")[0].as_py(), table.column("shard")[0].as_py()
        bins = local_search(size, best_fit(size, room), room)
        where = [""] * len(size)
        for b, items in enumerate(bins):
            for i in items:
                where[i] = f"{part}-{b}"
        keep = table.select(["limit", "key", "piece", "first_token", "n_tokens"])
        return keep.add_column(1, "container", pa.array(where, pa.string()))

    limit_type, key_type = items.schema["limit"].dataType.simpleString(), df.schema[key].dataType.simpleString()
    schema = f"limit {limit_type}, container string, key {key_type}, piece int, first_token int, n_tokens int"
    whole = F.col("n_tokens") == F.col("capacity")
    packed = items.where(~whole).groupBy("limit", "shard").applyInArrow(run, schema)
    alone = items.where(whole).withColumn("container", F.concat_ws("-", F.lit("own"), "key", "piece"))
    both = packed.unionByName(alone.select(packed.columns))
    return both.withColumnsRenamed({"limit": limit_key, "key": key})


def usage(packed: DataFrame, limits: DataFrame, limit_key: str, capacity: str) -> DataFrame:
    """(limit, capacity, containers, tokens, least_containers, unused_share) of a packing."""
    per = packed.groupBy(limit_key).agg(F.countDistinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"))
    room = F.col(capacity)
    return per.join(F.broadcast(limits.select(limit_key, capacity)), limit_key).select(
        limit_key, capacity, "containers", "tokens", F.ceil(F.col("tokens") / room).alias("least_containers"),
        F.round(1 - F.col("tokens") / (F.col("containers") * room), 6).alias("unused_share"),
    )
