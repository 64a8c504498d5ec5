"""Two tokenizers over the same bytes, against plain Python and the libraries on whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from touchmark.llm import alignment
from touchmark.llm.common import QUERIES, read

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_FILE)


def byte_values():
    """The characters of a byte-level vocabulary: most Latin-1 letters and signs are themselves, the others follow."""
    kept = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(kept)))}


def plain_groups(text, libraries):
    """[(A ids, B ids)] per group."""
    a, b = libraries
    if not text:
        return []
    table, spaced = byte_values(), " " + text
    xs = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(spaced, add_special_tokens=False).ids]
    ys = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        ys.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    if not all(b"".join(p for _, p in side) == spaced.encode() for side in (xs, ys)):
        return []
    sides = []
    for side in (xs, ys):
        at, ends = 0, []
        for i, piece in side:
            at += len(piece)
            ends.append((at, i))
        sides.append(ends)
    cuts = sorted({e for e, _ in sides[0]} & {e for e, _ in sides[1]})
    groups = {c: ([], []) for c in cuts}
    for k, side in enumerate(sides):
        for end, i in side:
            groups[next(c for c in cuts if c >= end)][k].append(i)
    return [groups[c] for c in cuts]


def plain_alignment(docs, libraries):
    """Rows in the order of docs, a list of texts."""
    links = []
    for text in docs:
        groups = plain_groups(text, libraries)
        links.append((groups, Counter((x, y) for xs, ys in groups for x in xs for y in ys)))
    count = Counter(p for _, own in links for p in own)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    for groups, own in links:
        said = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        yield (
            sum(len(xs) for xs, _ in groups), sum(len(ys) for _, ys in groups), len(groups), sum(own.values()),
            sum(n for p, n in own.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in own.items()),
            hashlib.sha256(said.encode()).hexdigest() if groups else "",
        )


def odd_texts():
    rng = random.Random(6)
    parts = ["a", " ", "  ", "\n", "\t", "\x00", "▁", " ", "　", "\x85", "\x1c", "don't", "<|endoftext|>", "</s>",
             "<0x41>", "1234567", "漢字仮名", "naïve", "\U0001f600", "...", "hello", " world", "ﬁ", "é", "ÿ", "中"]
    return ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(400)]


def test_alignment(spark, data, libraries):
    docs = read(spark, data, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    expected = dict(zip(ids, plain_alignment([texts[i] for i in ids], libraries)))
    found = QUERIES["op11_tokenizer_alignment"](spark, data)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {r["doc_id"]: tuple(r[c] for c in names) for r in found.collect()} == expected
    # Smaller chunks change nothing but the number of partial counts.
    small = alignment.align(docs, A_FILE, B_FILE, chunk_bytes=2000)
    assert {r["doc_id"]: tuple(r[c] for c in names) for r in small.collect()} == expected


def test_odd_characters(spark, libraries):
    """Units between single spaces join to what the libraries make of the whole text."""
    texts = odd_texts()
    expected = list(plain_alignment(texts, libraries))
    assert any(e[0] for e in expected) and any(t and not e[0] for t, e in zip(texts, expected))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r["doc_id"]: r for r in alignment.align(df, A_FILE, B_FILE, chunk_bytes=500, groups=True).collect()}
    for i, e in enumerate(expected):
        assert tuple(rows[i][1:8]) == e, repr(texts[i])
        assert rows[i]["groups"] == ";".join(
            ",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in plain_groups(texts[i], libraries)
        )


def test_ranks_give_what_the_file_gives(libraries):
    """The merges by rank against the library that reads the file: every piece, and random runs of letters."""
    pair = alignment.Pair(open(A_FILE, encoding="utf-8").read(), open(B_FILE, "rb").read())
    rng = random.Random(1)
    texts = [libraries[0].decode([i]) for i in range(libraries[0].get_vocab_size())]
    texts += ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 30))) for _ in range(20000)]
    texts += [" ".join(rng.choices(texts, k=6)) for _ in range(5000)] + odd_texts()
    found = libraries[0].encode_batch([" " + t for t in texts], add_special_tokens=False)
    assert [e.ids for e in found] == [pair.a.encode_ordinary(" " + t) for t in texts]


def test_groups_of_many_tokens(libraries, monkeypatch):
    """Links of large groups, spelled out in slices, add up."""
    texts = odd_texts()[:150]
    pair = alignment.Pair(open(A_FILE, encoding="utf-8").read(), open(B_FILE, "rb").read())
    whole = alignment.aligned(texts, pair)[1]
    monkeypatch.setattr(alignment, "_LINKS", 3)
    sliced = alignment.aligned(texts, pair)[1]
    order = [("doc", "ascending"), ("pair", "ascending")]
    assert whole.sort_by(order).equals(sliced.sort_by(order))


def test_pair_counts(spark, libraries):
    texts = ["hello world", "hello world", "hello", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = alignment.pair_counts(alignment.chunks(df, A_FILE, B_FILE, chunk_bytes=1))
    wanted = Counter(p for t in texts for p in {(x, y) for xs, ys in plain_groups(t, libraries) for x in xs for y in ys})
    assert {(r["a"], r["b"]): r["count"] for r in counts.collect()} == wanted
    assert all(r["best"] for r in counts.collect())


def test_alignment_odd(odd_docs, no_docs, libraries):
    rows = alignment.align(odd_docs, A_FILE, B_FILE).collect()
    texts = [r["text"] for r in odd_docs.collect()]
    assert Counter(tuple(r[1:]) for r in rows) == Counter(plain_alignment(texts, libraries))
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd_docs.collect())
    assert alignment.align(no_docs, A_FILE, B_FILE).count() == 0
