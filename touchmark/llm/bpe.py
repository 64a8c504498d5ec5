"""BPE encoding by a table of distinct words, and decoding by a table of pieces."""

from __future__ import annotations

import json
import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from touchmark.llm.common import read, register, text_or_empty
from touchmark.session import new_path

#: Characters of text that a task numbers the words of at once; a longer text is a chunk of its own.
CHUNK_BYTES = 12_000_000
#: Texts that a task passes on, or takes out of a batch, at once.
_TEXTS = 512
#: Words whose ids a task gathers by chunk before it passes them on.
_WORDS = 1_000_000

# The tokenizer's rules for words, as its file has them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
_OTHER = re.compile("[^\x00-\u024f]")
#: White space below U+0250 by its Unicode property, which the library goes by.
_WORD = regex.compile(PATTERN.replace(r"\s", r"\t-\r \x85\xa0"))


class Splitter:
    """Cuts a text into the words that the tokenizer's model encodes one by one.

    Texts of characters below U+0250, which no normal form changes, are lowered and cut by the same
    pattern here; the library itself normalises and cuts all others, at several times the cost.
    """

    def __init__(self, definition: str) -> None:
        self.tokenizer = Tokenizer.from_str(definition)
        parts = json.loads(definition)
        if parts["normalizer"] != NORMALIZER or parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != PATTERN:
            raise ValueError("a tokenizer with other rules for words")
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        names = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")")

    def words(self, text: str) -> list[str]:
        """The words; a special token is one of them, as the pattern never yields its text."""
        if "<|" in text:
            out: list[str] = []
            for i, part in enumerate(self.cut.split(text)):
                out += [part] if i % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if _OTHER.search(text) is None:
            return _WORD.findall(text.lower())
        normal = self.tokenizer.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def encode(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        mapped = "".join(piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(word))
        return [t.id for t in self.tokenizer.model.tokenize(mapped)]


def _lists(rows: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(rows), "int32")))


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


class _Chunk:
    """Texts as numbers of the chunk's distinct words."""

    def __init__(self) -> None:
        self.keys: list[pa.Scalar] = []
        self.texts: list[np.ndarray] = []
        self.words: defaultdict[str, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.bytes = 0

    def add(self, key: pa.Scalar, text: str, words: list[str]) -> None:
        self.keys.append(key)
        self.texts.append(np.fromiter(map(self.words.__getitem__, words), "int32", len(words)))
        self.bytes += len(text) + 8

    def row(self, number: int, kind: pa.DataType) -> pa.RecordBatch:
        codes = np.concatenate(self.texts)
        order = np.argsort(-np.bincount(codes, minlength=len(self.words)), kind="stable")
        rank = np.empty(len(order), "int32")
        rank[order] = np.arange(len(order))
        codes = rank[codes]  # common words have small numbers, whose upper halves pack to nothing
        docs = pa.table({"key": pa.array(self.keys, kind), "n": pa.array(list(map(len, self.texts)), pa.int64())})
        halves = pa.table({"low": (codes & 0xFFFF).astype("uint16"), "high": (codes >> 16).astype("uint16")})
        words = pa.array(list(self.words), pa.string()).take(pa.array(order))
        one = {
            "chunk": pa.array([number], pa.int64()),
            "docs": pa.array([_packed(docs)], pa.binary()),
            "codes": pa.array([_packed(halves)], pa.binary()),
            "words": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
        }
        return pa.RecordBatch.from_pydict(one)


def _split(batches: Iterator[pa.RecordBatch], definition: Broadcast, size: int) -> Iterator[pa.RecordBatch]:
    splitter, number, chunk = Splitter(definition.value), TaskContext.get().partitionId() << 32, _Chunk()
    for batch in batches:
        for part in (batch.slice(at, _TEXTS) for at in range(0, batch.num_rows, _TEXTS)):
            for key, text in zip(part.column(0), part.column(1).to_pylist()):
                chunk.add(key, text, splitter.words(text))
                if chunk.bytes >= size:
                    yield chunk.row(number, batch.schema[0].type)
                    number, chunk = number + 1, _Chunk()
    if chunk.keys:
        yield chunk.row(number, batch.schema[0].type)


def _encode(batches: Iterator[pa.RecordBatch], definition: Broadcast) -> Iterator[pa.RecordBatch]:
    """(of, found) from rows in order of their word: each distinct word is encoded once.

    ``found`` packs the numbers and ids of a chunk's words, for rows of their own would take several times the room.
    """
    splitter, last, ids = Splitter(definition.value), None, []
    held: list[tuple[np.ndarray, np.ndarray, pa.ListArray]] = []

    def flush() -> pa.RecordBatch:
        of, at = (np.concatenate(c) for c in list(zip(*held))[:2])
        lists = pa.concat_arrays([x for *_, x in held])
        order = np.lexsort((at, of))
        of, at, lists = of[order], at[order], lists.take(pa.array(order))
        firsts = np.flatnonzero(np.diff(of, prepend=of[0] - 1))
        packed = []
        for low, high in zip(firsts, [*firsts[1:], len(of)]):
            part = lists.slice(low, high - low)
            sizes = pa.table({"step": np.diff(at[low:high], prepend=0).astype("int32"), "n": part.value_lengths()})
            packed.append(_packed(sizes) + _packed(pa.table({"ids": part.flatten()})))
        return pa.RecordBatch.from_arrays([pa.array(of[firsts]), pa.array(packed, pa.binary())], ["of", "found"])

    n = 0
    for batch in batches:
        rows = []
        for word in batch.column("word").to_pylist():
            if word != last:
                last, ids = word, splitter.encode(word)
            rows.append(ids)
        if rows:
            held.append((batch.column("of").to_numpy(), batch.column("at").to_numpy(), _lists(rows)))
        n += len(rows)
        if n >= _WORDS:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def _found(packs: Iterable[bytes]) -> pa.ListArray:
    """The ids of a chunk's words, in the order of their numbers, from all that was found of them."""
    places, lists = [np.zeros(0, "int64")], [_lists([])]
    for data in packs:
        stream = pa.BufferReader(data)
        sizes, ids = pa.ipc.open_stream(stream).read_all(), pa.ipc.open_stream(stream).read_all()
        places.append(np.cumsum(sizes["step"].to_numpy().astype("int64")))
        ends = np.concatenate([[0], np.cumsum(sizes["n"].to_numpy())]).astype("int32")
        lists.append(pa.ListArray.from_arrays(pa.array(ends), ids["ids"].combine_chunks()))
    return pa.concat_arrays(lists).take(pa.array(np.argsort(np.concatenate(places))))


def encode(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES,
    decode: bool = False,
) -> DataFrame:
    """Per document: key, ids, as the tokenizer file encodes the whole text without special tokens added;
    and ``decoded``, the pieces of the ids, if asked for.

    Tasks split texts and number the distinct words of a chunk of documents. The corpus' words meet in a
    shuffle, a row per chunk and word, where each distinct word is encoded once; its ids join back by
    (chunk, number), and the texts, as numbers, look their ids up by position. Only a chunk's distinct
    words travel, so the commonest word is one row per chunk. Chunks stand in a table bucketed by their
    number, so they aren't shuffled either. Null texts are empty and have no ids. Every row comes back,
    repeated or not; an empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())
    source = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    chunks = source.mapInArrow(
        lambda it: _split(it, definition, chunk_bytes), "chunk long, docs binary, codes binary, words array<string>"
    )
    name = f"bpe_chunks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    target = {"path": new_path(spark, name), "compression": "zstd"}
    chunks.write.bucketBy(buckets, "chunk").options(**target).saveAsTable(name)
    chunks = spark.table(name)

    words = chunks.select(F.col("chunk").alias("of"), F.posexplode("words").alias("at", "word"))
    words = words.repartition("word").sortWithinPartitions("word")
    ids = words.mapInArrow(lambda it: _encode(it, definition), "of long, found binary")
    pieces = spark.sparkContext.broadcast(_pieces(path)) if decode else None

    def lay_out(chunk: pa.Table, found: pa.Table) -> pa.Table:
        rows, codes = (_unpacked(chunk[c][0].as_py()) for c in ("docs", "codes"))
        lists = _found(found["found"].to_pylist())
        word = codes["low"].to_numpy().astype("int32") | (codes["high"].to_numpy().astype("int32") << 16)
        lists = lists.take(pa.array(word))
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        ends = pa.array(ends[np.concatenate([[0], np.cumsum(rows["n"].to_numpy())])].astype("int32"))
        flat = lists.flatten()
        out = {"key": rows["key"], "ids": pa.ListArray.from_arrays(ends, flat)}
        if pieces is not None:
            # The join by id, against the table of all pieces in the order of their ids.
            out["decoded"] = pc.binary_join(pa.ListArray.from_arrays(ends, pa.array(pieces.value).take(flat)), " ")
        return pa.Table.from_batches(pa.table(out).to_batches(max_chunksize=_TEXTS))

    schema = f"key {source.schema['key'].dataType.simpleString()}, ids array<int>" + ", decoded string" * decode
    left = chunks.select("chunk", "docs", "codes").groupBy("chunk")
    return left.cogroup(ids.groupBy("of")).applyInArrow(lay_out, schema).withColumnRenamed("key", key)


def _pieces(path: str) -> list[str]:
    """The piece of every id, special tokens included: a table bounded by the file."""
    tokenizer = Tokenizer.from_file(path)
    if tokenizer.decoder is not None:
        raise ValueError("only tokenizers without a decoder of their own, whose pieces are set apart by spaces")
    pieces: list[str] = [""] * (max(tokenizer.get_vocab().values(), default=-1) + 1)
    for piece, i in tokenizer.get_vocab().items():
        pieces[i] = piece
    return pieces


def encoded_and_decoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_tokens, ids, decoded."""
    rows = encode(docs, path, key, text, decode=True)
    return rows.select(key, F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


@register("op7_bpe_words")
def op7_bpe_words(spark: SparkSession, d: str) -> DataFrame:
    rows = encoded_and_decoded(read(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return rows.select(
        "doc_id", "n_tokens", F.sha2(F.encode(ids, "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
