"""Near-duplicates by SimHash: BK-trees over shards of fingerprints that agree in a block of bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from touchmark.llm.common import digest, read, register, stored, text_or_empty
from touchmark.llm.components import components

WORDS = 4
SEED = 42
RADIUS = 4
#: Most fingerprints that one tree holds; larger shards are split by further bits.
TREE_LIMIT = 20_000
_CHUNK = 1 << 16


def fingerprint(text: str | None, n: int = WORDS) -> int:
    """64 bits, each 1 where over half of the shingles' XXH64 have it; 0 without words."""
    # bytes.lower and bytes.split know only ASCII letters and blanks: just what is wanted.
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    n = min(n, len(parts))
    joined = b" ".join(parts)
    ends = list(accumulate(len(p) + 1 for p in parts))
    starts = [0, *ends[:-1]]
    total, counts = len(parts) - n + 1, np.zeros(64, np.int64)
    for at in range(0, total, _CHUNK):
        stop = min(total, at + _CHUNK)
        hashes = np.array(
            [
                xxhash.xxh64_intdigest(joined[a : b - 1], SEED)
                for a, b in zip(starts[at:stop], ends[at + n - 1 : stop + n - 1])
            ],
            dtype="<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="uint64").astype("int64")


class BKTree:
    """Burkhard-Keller tree; children hang at their distance from the parent.

    It keeps the codes' components as well. ``whole`` names the component that a node's whole subtree
    belongs to (-1: several), so a search passes over subtrees already joined to the new code: a dense
    ball of near copies costs little more than its size.
    """

    def __init__(self, radius: int) -> None:
        self.radius, self.codes, self.children, self.parent, self.whole = radius, [], [], [], []

    def _find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def add(self, code: int) -> list[int]:
        """Insert a code; return one code within the radius from each component it joins."""
        new, radius, linked = len(self.codes), self.radius, []
        self.parent.append(new)
        stack = [0] if new else []
        while stack:
            at = stack.pop()
            if self.whole[at] >= 0 and self._find(self.whole[at]) == self._find(new):
                continue
            distance = (self.codes[at] ^ code).bit_count()
            if distance <= radius and self._find(at) != self._find(new):
                self.parent[self._find(new)] = self._find(at)
                linked.append(self.codes[at])
            stack.extend(
                child for edge, child in self.children[at].items() if abs(edge - distance) <= radius
            )
        root, at = self._find(new), 0
        while new:
            if self.whole[at] >= 0 and self._find(self.whole[at]) != root:
                self.whole[at] = -1
            distance = (self.codes[at] ^ code).bit_count()
            if distance not in self.children[at]:
                self.children[at][distance] = new
                break
            at = self.children[at][distance]
        self.codes.append(code)
        self.children.append({})
        self.whole.append(new)
        return linked


def split_bits(mask: int, blocks: int) -> list[int]:
    """The bits outside the mask in so many runs of near equal length."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [sum(1 << int(i) for i in part) for part in np.array_split(free, blocks)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _shard(codes: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """Each code under every block of free bits of its shard's mask."""
    spark = codes.sparkSession
    pairs = [(_signed(m), _signed(s), _signed(m | s)) for m, subs in masks.items() for s in subs]
    table = spark.createDataFrame(pairs, "mask long, block long, next long")
    # A row per block and mask: the radius and the depth bound the broadcast.
    return codes.join(F.broadcast(table), "mask").select(
        F.col("next").alias("mask"), F.col("code").bitwiseAND(F.col("next")).alias("value"), "code"
    )


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of each shard; the rows of a shard come one after another."""
    key, tree = None, None
    for batch in batches:
        out: list[tuple[int, int]] = []
        columns = (batch.column(c).to_pylist() for c in ("mask", "value", "code"))
        for mask, value, code in zip(*columns):
            if (mask, value) != key:
                key, tree = (mask, value), BKTree(radius)
            for other in tree.add(code & 0xFFFFFFFFFFFFFFFF):
                out.append((code, _signed(other)))
        if out:
            a, b = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links(codes: DataFrame, radius: int = RADIUS, tree_limit: int = TREE_LIMIT) -> DataFrame:
    """Links (a, b) that join just the distinct codes whose chains of steps within the radius meet.

    Codes within the radius agree in one of ``radius + 1`` blocks of bits, so each code goes to the
    shards of its blocks and every shard has a tree of its own. A shard above the limit is cut again
    by the bits that its codes need not share; that ends, as b free bits leave at most 2^b codes.
    """
    rows = codes.select(F.lit(0).cast("long").alias("mask"), F.col("code"))
    masks, ready = [0], []
    while True:
        sharded = _shard(rows, {m: split_bits(m, radius + 1) for m in masks})
        sizes = sharded.groupBy("mask", "value").agg(F.count("*").alias("n"))
        large = sizes.filter(F.col("n") > tree_limit).select("mask", "value")
        masks = [m | s for m in masks for s in split_bits(m, radius + 1)]
        if bin(masks[0]).count("1") + radius + 1 > 64 or large.isEmpty():
            ready.append(sharded)
            break
        ready.append(sharded.join(large, ["mask", "value"], "left_anti"))
        rows = stored(sharded.join(large, ["mask", "value"], "left_semi").select("mask", "code"), "shards")
    shards = ready[0]
    for more in ready[1:]:
        shards = shards.union(more)
    dealt = shards.repartition("mask", "value").sortWithinPartitions("mask", "value", "code")
    return dealt.mapInArrow(lambda it: _search(it, radius), "a long, b long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, tree_limit: int = TREE_LIMIT,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """Per document: key, fingerprint (long), component_id, the least key its links reach.

    Null texts are empty; texts without words share fingerprint 0 and so one component. Equal
    fingerprints meet before any search. A component in which every key is null has a null id.
    Repeated rows all come back; an empty table gives no rows. ``carry`` names further columns.
    """
    rows = docs.select(
        F.col(key), fingerprints(text_or_empty(text)).alias("code"),
        *[c.alias(n) for n, c in (carry or {}).items()],
    )
    rows = stored(rows, "fingerprints")
    codes = rows.groupBy("code").agg(F.min(key).alias("first"))
    roots = components(links(codes.select("code"), radius, tree_limit))
    members = codes.join(roots, F.col("code") == F.col("node"), "left").select(
        F.col("code").alias("__code"), "first", F.coalesce("root", "code").alias("root")
    )
    least = members.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = members.join(least, "root").select("__code", "component_id")
    return rows.join(ids, F.col("code") == F.col("__code")).select(*rows.columns, "component_id")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component stays: that with the least key (null keys last), then text digest."""
    found = near_duplicates(docs, key, text, carry={"__digest": digest(text_or_empty(text))})
    rank = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col("__digest").alias("d"))
    # A component of null keys alone has no id; its fingerprint stands for it.
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("code"))]
    kept = found.groupBy(*group).agg(F.min(rank).alias("r")).select(
        F.col("r.k").alias("__key"), F.col("r.d").alias("__d")
    )
    chosen = docs.withColumn("__digest", digest(text_or_empty(text))).join(
        kept, (F.col("__digest") == F.col("__d")) & F.col(key).eqNullSafe(F.col("__key")), "left_semi"
    )
    # Equal keys and texts are copies as well: one of them stays.
    return chosen.dropDuplicates(["__digest", key]).drop("__digest")


@register("op10_simhash_bktree")
def op10_simhash_bktree(spark: SparkSession, d: str) -> DataFrame:
    found = near_duplicates(read(spark, d, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")
