"""Alignment of two tokenizers over the same bytes, and how many documents link each pair of their ids."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchmark.llm.common import read, register, stored

#: Bytes of text that a task aligns at once; a longer text is a chunk of its own.
CHUNK_BYTES = 4_000_000
#: Texts that a task takes out of a batch at once.
_TEXTS = 256
#: Links of groups with several tokens that are spelled out at once.
_LINKS = 2_000_000
_SHIFT = 32

# Fixed value: how a byte-level tokenizer file of this kind cuts a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: No token of either tokenizer reaches over a single space between characters that are not blank.
_UNIT = re.compile(r"(?<=\S) (?=\S)")


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Two tokenizers: a byte-level BPE file (A) and a sentencepiece model (B), both applied to space+text."""

    def __init__(self, definition: str, model: bytes) -> None:
        parts = json.loads(definition)
        before, vocabulary = parts["pre_tokenizer"], parts["model"]["vocab"]
        if parts["normalizer"] or before["type"] != "ByteLevel" or not before["use_regex"] or before["add_prefix_space"]:
            raise ValueError("not a plain byte-level tokenizer")
        merges = [m if isinstance(m, list) else m.split(" ") for m in parts["model"]["merges"]]
        made = [vocabulary["".join(m)] for m in merges]
        if made != sorted(made) or parts["model"]["ignore_merges"]:
            raise ValueError("merges that are not in the order of their ids")
        # The ids are the ranks of the merges then; special tokens are not among them, so their strings are plain text.
        table = _byte_level()
        ranks = {bytes(table[c] for c in piece): i for piece, i in vocabulary.items() if all(c in table for c in piece)}
        special = {t["content"] for t in parts["added_tokens"]}
        ranks = {piece: i for piece, i in ranks.items() if piece.decode("utf-8", "replace") not in special}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in piece.lstrip("▁") for piece in pieces):
            raise ValueError("a model whose pieces reach over spaces")
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.a_lengths = np.zeros(max(ranks.values()) + 1, "int64")
        self.a_lengths[list(ranks.values())] = list(map(len, ranks))
        self.b_lengths = np.array([len(x) for x in self.b_bytes], "int64")
        names = [str(i) for i in range(max(len(self.a_lengths), len(self.b_bytes)))]
        self.n_names = len(names)
        self.names = pa.array([sign + name for sign in ",;|" for name in names])

    def encode(self, units: list[str]) -> tuple[pa.ListArray, pa.ListArray, np.ndarray]:
        """Ids of both for space+unit each, and whether B gives its bytes back; no ids where it doesn't.

        A always does: its merges start from the bytes.
        """
        spaced = [" " + u for u in units]
        a = list(map(self.a.encode_ordinary, spaced))
        b = self.b.encode(units, num_threads=1) if units else []
        piece = self.b_bytes.__getitem__
        same = [b"".join(map(piece, ids)) == text.encode() for text, ids in zip(spaced, b)]
        for i in [i for i, good in enumerate(same) if not good]:
            a[i] = b[i] = []
        return _lists(a), _lists(b), np.array(same, bool)


def _lists(rows: list[list[int]]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, rows)]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(rows), "int32")))


def _ends(tokens: pa.ListArray, lengths: np.ndarray) -> pa.Table:
    """(doc, end, id) of every token, ``end`` being its byte offset inside the document."""
    ids, doc = pc.list_flatten(tokens), pc.list_parent_indices(tokens)
    total = pc.cumulative_sum(pa.array(lengths).take(ids)).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], total])[tokens.offsets.to_numpy()[:-1]]
    return pa.table({"doc": doc, "end": total - before[doc.to_numpy()], "id": ids})


def _runs(group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and first place of each of n groups, whose numbers come in order."""
    size = np.bincount(group, minlength=n)
    return size, np.cumsum(size) - size


def _summed(doc, pair, n) -> pa.Table:
    table = pa.table({"doc": doc, "pair": pair, "n": n})
    summed = table.group_by(["doc", "pair"], use_threads=False).aggregate([("n", "sum")])
    return summed.select(["doc", "pair", "n_sum"]).rename_columns(["doc", "pair", "n"])


def links_of(a: pa.ListArray, b: pa.ListArray, pair: Pair) -> tuple[pa.Table, pa.Table]:
    """Per text: n_a, n_b, n_groups, n_links and the groups as text; and (doc, pair, n): links by id pair.

    A and B tokens of a text end at the same bytes where an Acero join on (document, end) says so;
    those ends cut both into groups. Inside a group only distinct ids meet, with their counts.
    """
    ta, tb = _ends(a, pair.a_lengths), _ends(b, pair.b_lengths)
    common = ta.select(["doc", "end"]).join(tb.select(["doc", "end"]), ["doc", "end"], join_type="inner", use_threads=False)
    size = np.bincount(ta["doc"].to_numpy(), pair.a_lengths[ta["id"].to_numpy()], len(a)).astype("int64")
    base = np.cumsum(size) - size
    # Ends laid end to end, in order; a token's group is the number of common ends before its own.
    place = lambda t: base[t["doc"].to_numpy()] + t["end"].to_numpy()
    cuts = np.sort(place(common))
    n, owner = len(cuts), np.searchsorted(base + size, cuts)
    ga, gb = np.searchsorted(cuts, place(ta)), np.searchsorted(cuts, place(tb))
    (na, sa), (nb, sb) = _runs(ga, n), _runs(gb, n)
    ida, idb = ta["id"].to_numpy().astype("int64"), tb["id"].to_numpy().astype("int64")

    plain = (na == 1) & (nb == 1)
    parts = [_summed(owner[plain], (ida[sa[plain]] << _SHIFT) | idb[sb[plain]], np.ones(plain.sum(), "int64"))]
    rest = np.flatnonzero(~plain)
    step = np.cumsum(na[rest] * nb[rest]) // _LINKS
    for some in np.split(rest, np.flatnonzero(np.diff(step)) + 1) if len(rest) else []:
        sides = []
        for name, size_, start, ids in (("a", na, sa, ida), ("b", nb, sb, idb)):
            group = np.repeat(some, size_[some])
            at = np.arange(len(group)) - np.repeat(np.cumsum(size_[some]) - size_[some], size_[some]) + start[group]
            table = pa.table({"group": group, name: ids[at]})
            sides.append(table.group_by(["group", name], use_threads=False).aggregate([([], "count_all")]))
        both = sides[0].join(sides[1], "group", join_type="inner", right_suffix="_b", use_threads=False)
        codes = (both["a"].to_numpy() << _SHIFT) | both["b"].to_numpy()
        parts.append(_summed(owner[both["group"].to_numpy()], codes, both["count_all"].to_numpy() * both["count_all_b"].to_numpy()))
    whole = pa.concat_tables(parts)
    links = _summed(whole["doc"], whole["pair"], whole["n"])

    # The ids in order with the sign before each: a new group, the B side of it, or one more of a side.
    order = np.empty(len(ida) + len(idb), "int32")
    first = lambda g: np.diff(g, prepend=-1) != 0
    order[np.arange(len(ida)) + sb[ga]] = ida + pair.n_names * first(ga)
    order[np.arange(len(idb)) + (sa + na)[gb]] = idb + 2 * pair.n_names * first(gb)
    ends = a.offsets.to_numpy() + b.offsets.to_numpy()
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), pair.names.take(pa.array(order))), "")
    texts = pa.table(
        {
            "n_a": a.value_lengths().cast("int64"),
            "n_b": b.value_lengths().cast("int64"),
            "n_groups": np.bincount(owner, minlength=len(a)).astype("int64"),
            # Whole numbers, and far below 2^53.
            "n_links": np.bincount(owner, (na * nb).astype("float64"), len(a)).astype("int64"),
            "groups": pc.utf8_slice_codeunits(text, 1),
        }
    )
    return texts, links


def aligned(texts: list[str | None], pair: Pair) -> tuple[pa.Table, pa.Table]:
    """``links_of`` whole texts; those that are null, empty or not given back by B have no tokens.

    Neither tokenizer's tokens reach over the ends of the texts' units, so groups don't either: each distinct
    unit is encoded and aligned once, as a document of its own, and laid out at all its places.
    """
    units = [_UNIT.split(t) if t else [] for t in texts]
    sizes = np.fromiter(map(len, units), "int64", len(units))
    coded = pa.array(list(chain.from_iterable(units)), pa.string()).dictionary_encode()
    del units
    a, b, same = pair.encode(coded.dictionary.to_pylist())
    rows, links = links_of(a, b, pair)
    unit, doc = coded.indices.to_numpy().astype("int64"), np.repeat(np.arange(len(texts)), sizes)
    bad = np.zeros(len(texts), bool)
    bad[doc[~same[unit]]] = True
    unit, doc = unit[~bad[doc]], doc[~bad[doc]]
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]).astype("int32")
    numbers = {
        # Whole numbers, and far below 2^53.
        c: np.bincount(doc, rows[c].to_numpy()[unit].astype("float64"), len(texts)).astype("int64")
        for c in ("n_a", "n_b", "n_groups", "n_links")
    }
    groups = rows["groups"].combine_chunks().take(pa.array(unit))
    whole = pa.table({**numbers, "groups": pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), groups), ";")})

    # The links of a unit, once for each document that has it, times its places there.
    links = links.sort_by("doc")
    n, first = _runs(links["doc"].to_numpy(), len(rows))
    code, times = np.unique(doc * max(len(rows), 1) + unit, return_counts=True)
    doc, unit = code // max(len(rows), 1), code % max(len(rows), 1)
    each = n[unit]
    at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first[unit], each)
    return whole, _summed(
        np.repeat(doc, each), links["pair"].to_numpy()[at], links["n"].to_numpy()[at] * np.repeat(times, each)
    )


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _chunk(number: int, keys: pa.Array, texts: list[str | None], pair: Pair, groups: bool) -> pa.RecordBatch:
    rows, links = aligned(texts, pair)
    told = rows["groups"].to_pylist()
    rows = rows.append_column(
        "groups_sha256", pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in told], pa.string())
    ).append_column("key", keys)
    # Partial counts: the pairs of the chunk, each with the number of its documents.
    pairs = links.group_by("pair", use_threads=False).aggregate([([], "count_all")])
    links = links.set_column(1, "pair", pc.index_in(links["pair"], pairs["pair"].combine_chunks()))
    one = {
        "chunk": pa.array([number], pa.int64()),
        "rows": pa.array([_packed(rows if groups else rows.drop_columns("groups"))], pa.binary()),
        "links": pa.array([_packed(links)], pa.binary()),
        "pairs": pa.array([pairs["pair"].to_pylist()], pa.list_(pa.int64())),
        "docs": pa.array([pairs["count_all"].to_pylist()], pa.list_(pa.int64())),
    }
    return pa.RecordBatch.from_pydict(one)


def _aligned(batches: Iterator[pa.RecordBatch], files: Broadcast, size: int, groups: bool) -> Iterator[pa.RecordBatch]:
    pair, number = Pair(*files.value), TaskContext.get().partitionId() << 32
    keys, texts, held = [], [], 0
    for batch in batches:
        for part in (batch.slice(at, _TEXTS) for at in range(0, batch.num_rows, _TEXTS)):
            for key, text in zip(part.column(0), part.column(1).to_pylist()):
                keys.append(key)
                texts.append(text)
                held += len(text.encode()) + 8 if text else 8
                if held >= size:
                    yield _chunk(number, pa.array(keys, batch.schema[0].type), texts, pair, groups)
                    keys, texts, held, number = [], [], 0, number + 1
    if keys:
        yield _chunk(number, pa.array(keys, batch.schema[0].type), texts, pair, groups)


def chunks(
    docs: DataFrame, byte_level: str, pieces: str, key: str = "doc_id", text: str = "text",
    chunk_bytes: int = CHUNK_BYTES, groups: bool = False,
) -> DataFrame:
    """A written table of one row per chunk of documents: their rows and links packed, and its pairs with counts."""
    with open(byte_level, encoding="utf-8") as a, open(pieces, "rb") as b:
        files = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))
    table = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        lambda it: _aligned(it, files, chunk_bytes, groups),
        "chunk long, rows binary, links binary, pairs array<long>, docs array<long>",
    )
    return stored(table, "alignment")


def _pairs(table: DataFrame) -> DataFrame:
    each = table.select("chunk", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "x"))
    return each.select("chunk", "at", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))


def pair_counts(table: DataFrame) -> DataFrame:
    """(a, b, pair, count, best): the documents that link two ids, and whether a has no higher count."""
    counts = _pairs(table).groupBy("pair").agg(F.sum("docs").alias("count"))
    counts = stored(counts.withColumn("a", F.shiftright("pair", _SHIFT).cast("int")), "pair-counts")
    # One row per id of A: no more than its vocabulary holds.
    most = F.broadcast(counts.groupBy("a").agg(F.max("count").alias("most")))
    b = F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1)).cast("int")
    return counts.join(most, "a").select("a", b.alias("b"), "pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(
    docs: DataFrame, byte_level: str, pieces: str, key: str = "doc_id", text: str = "text",
    chunk_bytes: int = CHUNK_BYTES, groups: bool = False,
) -> DataFrame:
    """Per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and ``groups`` if asked for.

    Tasks align chunks of documents in Arrow and count the id pairs of a chunk there; only a chunk's distinct
    pairs are shuffled, to be summed and to come back as the chunk's table of counts. So a pair that
    every document holds is one row per chunk. Null, empty and altered texts have no tokens: zeros and
    ''. Every row comes back and counts, repeated or not; other columns are ignored; an empty table gives
    none. A text is aligned whole, so memory follows the longest text, or a chunk.
    """
    table = chunks(docs, byte_level, pieces, key, text, chunk_bytes, groups)
    counted = _pairs(table).join(pair_counts(table).select("pair", "count", "best"), "pair")
    counted = counted.select(F.col("chunk").alias("of"), "at", "count", "best")
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    names = ["key", *numbers, "groups_sha256", *(["groups"] if groups else [])]
    kind = docs.select(key).schema[0].dataType.simpleString()

    def finish(chunk: pa.Table, found: pa.Table) -> pa.Table:
        rows, links = (_unpacked(chunk[c][0].as_py()) for c in ("rows", "links"))
        count, best = (np.zeros(found.num_rows, "int64") for _ in range(2))
        at = found["at"].to_numpy()
        count[at], best[at] = found["count"].to_numpy(), found["best"].to_numpy(zero_copy_only=False)
        pair, n = links["pair"].to_numpy(), links["n"].to_numpy()
        sums = pa.table({"doc": links["doc"], "n_best": n * best[pair], "count_sum": n * count[pair]})
        sums = sums.group_by("doc", use_threads=False).aggregate([("n_best", "sum"), ("count_sum", "sum")])
        for name in ("n_best", "count_sum"):
            values = np.zeros(rows.num_rows, "int64")
            values[sums["doc"].to_numpy()] = sums[f"{name}_sum"].to_numpy()
            rows = rows.append_column(name, pa.array(values))
        return rows.select(names)

    schema = f"key {kind}, {', '.join(f'{c} long' for c in numbers)}, groups_sha256 string" + ", groups string" * groups
    left, right = table.select("chunk", "rows", "links").groupBy("chunk"), counted.groupBy("of")
    return left.cogroup(right).applyInArrow(finish, schema).withColumnRenamed("key", key)


@register("op11_tokenizer_alignment")
def op11_tokenizer_alignment(spark: SparkSession, d: str) -> DataFrame:
    path = public_tokenizers.path
    return align(read(spark, d, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
