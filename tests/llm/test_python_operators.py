"""BPE and personal data, against the library and plain Python."""

import hashlib
import re

import public_tokenizers
from tokenizers import Tokenizer

from touchmark.llm import bpe, privacy
from touchmark.llm.common import QUERIES, read

PATH = public_tokenizers.path("word_bpe_49k.json")


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def test_bpe(spark, data):
    library = Tokenizer.from_file(PATH)
    docs = {r["doc_id"]: r["text"] or "" for r in read(spark, data, "documents").collect()}
    rows = QUERIES["op7_bpe_words"](spark, data).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected = (len(ids), sha(" ".join(map(str, ids))), sha(decoded))
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected


def test_bpe_odd_texts(spark, odd_docs, no_docs):
    """One chunk for all, and one for every text, so that the same words come from many."""
    library = Tokenizer.from_file(PATH)
    more = ["a<|endoftext|>B <|startoftext|>", "It's we'll I'M ½ ² ①", "é ΑΣ İ ǅ ﬁ", "中文字 ไทย‍ 👩‍👩‍👧", "a\x85b c　d"]
    docs = odd_docs.unionByName(
        spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"), True
    )
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] not in (None, 3)}
    for size in (1, bpe.CHUNK_BYTES):
        rows = bpe.encode(docs, PATH, chunk_bytes=size, decode=True).collect()
        assert len(rows) == docs.count()
        for r in rows:
            if r["doc_id"] in texts:
                ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
                assert r["ids"] == ids, texts[r["doc_id"]][:50]
                assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(no_docs, PATH).count() == 0
    assert bpe.encoded_and_decoded(docs, PATH).columns == ["doc_id", "n_tokens", "ids", "decoded"]


def test_each_distinct_word_is_encoded_once(monkeypatch):
    """Rows come in order of their word, over batches."""
    import pyarrow as pa

    asked = []
    plain = bpe.Splitter.encode
    monkeypatch.setattr(bpe.Splitter, "encode", lambda self, word: asked.append(word) or plain(self, word))

    class Held:
        value = open(PATH, encoding="utf-8").read()

    words = ["a", "a", "b", "b", "b", "c"]
    batches = [
        pa.RecordBatch.from_pydict({"of": [1] * 3, "at": pa.array(at, pa.int32()), "word": part})
        for at, part in (([1, 0, 2], words[:3]), ([3, 4, 5], words[3:]))
    ]
    for words_at_once in (1, 10):
        monkeypatch.setattr(bpe, "_WORDS", words_at_once)
        found = list(bpe._encode(iter(batches), Held))
        assert len(found) == (2 if words_at_once == 1 else 1)
        ids = bpe._found(x for b in found for x in b.column("found").to_pylist()).to_pylist()
        assert asked == ["a", "b", "c"] and ids[0] == ids[1] and ids[2] == ids[3] == ids[4] and len(ids) == 6
        asked.clear()


# --- personal data: the definitions, read without care for speed

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_private(spark, data, odd_docs, no_docs):
    docs = {r["doc_id"]: r["text"] or "" for r in read(spark, data, "documents").collect()}
    rows = QUERIES["op4_private_terms"](spark, data).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        base = plain_spans(docs[r["doc_id"]])
        counts = tuple(sum(b.startswith(k + ":") for b in base) for k in PATTERNS)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == counts
        assert r["base_sha256"] == sha(",".join(base)) and r["spans"].startswith(",".join(base))
    assert privacy.find_private(odd_docs).count() == odd_docs.count()
    assert privacy.find_private(no_docs).count() == privacy.sanitise(no_docs).count() == 0


def test_spans_of_hard_texts():
    import random

    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choices("ab_@@..-+ 1234567890()%é", k=rng.randint(0, 40)))
        assert [f"{k}:{s}:{e}" for k, s, e in privacy.base_spans(text)] == plain_spans(text), text
    cards = "4111 1111 1111 1111 x 4111-1111-1111-1112 +1 (555) 123-4567 300.1.1.1 0001.2.3.4"
    assert [f"{k}:{s}:{e}" for k, s, e in privacy.base_spans(cards)] == plain_spans(cards)
    privacy.base_spans("a" * 300_000 + "@" * 1000 + "1" * 300_000)


def test_disclosing_terms(spark):
    """The nickname goes wherever the address goes; the common words say nothing."""
    docs = [(k, f"please write to the kestrel at bob@mail.example.com about item {'xyz'[k % 3] * 4}") for k in range(6)]
    docs += [(10 + k, f"please write to the office at u{k}@mail.example.com about item qqqq{'abcdefgh'[k % 8]}") for k in range(40)]
    docs += [(100 + k, "please write to the office about item") for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in privacy.find_private(df).collect()}
    for k in range(6):
        text = docs[k][1]
        assert [text[t["start"] : t["end"]] for t in rows[k]["terms"]] == ["kestrel"]
    assert not any(rows[k]["terms"] for k in rows if k >= 10)
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(df).collect()}
    assert clean[0] == "please write to the  at <email> about item xxxx"
    assert clean[100] == docs[-40][1]


def test_terms_of_rare_values(spark):
    """A value known from one text: the rare name beside it goes, the common words and the rare word far off stay."""
    filler = "please write about the item " * 12
    docs = [(0, f"rareword {filler}please write to kestrel at bob@mail.example.com about the item")]
    docs += [(k, f"{filler}number {k}") for k in range(1, 600)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r["doc_id"]: r["terms"] for r in privacy.find_private(df).collect()}
    assert [docs[0][1][t["start"] : t["end"]] for t in rows.pop(0)] == ["kestrel"] and not any(rows.values())


def test_terms_far_from_their_value(spark):
    """A nickname beyond the reach of the address, and alone in other texts, goes everywhere, by each join."""
    filler = "please write about the item " * 8
    docs = [(k, f"bob@mail.example.com {filler}says the Kestrel {k}; kestrel@x.example") for k in range(8)]
    docs += [(8, "kestrel alone"), (9, "the kestrel alone")]
    docs += [(k, f"{filler}number {k}") for k in range(10, 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for rules in (privacy.Disclosure(generalise_at=0.8), privacy.Disclosure(generalise_at=0.8, broadcast_terms=0)):
        rows = {r["doc_id"]: r["terms"] for r in privacy.find_private(df, rules=rules).collect()}
        for k in range(10):
            assert "kestrel" in [docs[k][1][t["start"] : t["end"]].lower() for t in rows[k]], k
            assert all(docs[k][1][t["end"] : t["end"] + 1] != "@" for t in rows[k])
        assert not any(rows[k] for k in range(10, 300))
