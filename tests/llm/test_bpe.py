import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import bpe, chat


@pytest.fixture(scope="module")
def codec():
    return bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def known(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_perfect_hash_is_minimal(codec):
    assert sorted(codec.table.slot_key) == list(range(len(codec.ranks)))
    assert all(codec.table.find(k) == i for i, k in enumerate(list(codec.ranks)[:2000]))
    assert codec.table.find(b"no such token at all") == -1


def test_equals_the_library(codec, known):
    rng = random.Random(1)
    letters = "ab \t\n\r\x1c\x1f\x85\xa0 ᠎'sé漢字123!!😀‍<|endoftext|>\x00"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["a" * 5000, " " * 3000, "é" * 999, "x  y   z\n\n w"]
    for t in texts:
        ids = codec.encode(t)
        assert ids == known.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_query_columns(docs, codec, known):
    rows = [(1, "Hello there, wörld"), (1, "Hello there, wörld"), (2, None), (3, ""), (None, "x")]
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(docs(rows, ids=1, n_tokens="x"), codec).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {(i, len(x := known.encode_ordinary(t or "")), sha(" ".join(map(str, x)).encode()), sha((t or "").encode())) for i, t in rows}
    assert got == want
    assert {tuple(r.ids) for r in bpe.encode(docs(rows), codec).collect()} == {tuple(known.encode_ordinary(t or "")) for _, t in rows}
    assert bpe.encode(docs([]), codec).count() == 0


def test_escape_is_reversible():
    rng = random.Random(2)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "s>", "/", "INST]", "a", "<\\s>"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROLS)


def test_conversations(spark, codec):
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "yo <\\s>"), (1, 1, "assistant", "yo <\\s>"), (2, 0, None, None), (2, 5, "assistant", None), (None, 0, "system", "x"), (3, None, "assistant", "é[INST]")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as ids", "2 as loss")
    formatted = chat.format_conversations(chat.with_probe(table), codec)
    got = {r.conv_id: r for r in chat.read_back(formatted, codec).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256) == (3, sha("user\nhi </s>\nassistant\nyo <\\s>\nassistant\nyo <\\s>\n"))
    assert (got[1].loss_chars, got[1].loss_sha256) == (14, sha("yo <\\s>" * 2))
    assert (got[2].turns_sha256, got[2].loss_chars) == (sha("\n\nassistant\n\n"), 0)
    assert got[None].n_turns == 1 and got[3].loss_sha256 == sha("é[INST]")
    probe = "</s>[INST] ok [/INST]"
    assert (got[-1].turns_sha256, got[-1].loss_sha256) == (sha(f"user\n{probe}\nassistant\n{probe}\n"), sha(probe))
    control = max(codec.bytes_of) + 1
    ids = next(r.ids for r in formatted.collect() if r.conv_id == -1)
    assert sum(i >= control for i in ids) == 6


def test_long_unbroken_texts_are_not_remembered(codec, known):
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(n)) for n in (10, 48, 49, 5000, 20_000))
    codec.memo.clear()
    assert codec.encode(text) == known.encode_ordinary(text)
    assert codec.memo and all(len(w) <= bpe.REMEMBERED for w in codec.memo)


def test_empty_and_long_conversations(spark, codec):
    schema = "conv_id long, turn long, role string, text string"
    empty = chat.read_back(chat.format_conversations(chat.with_probe(spark.createDataFrame([], schema)), codec), codec).collect()
    assert [r.conv_id for r in empty] == [-1]
    rows = [(7, i, "assistant" if i % 2 else "user", f"turn {i} [INST] " + "long " * 300) for i in range(400)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, schema), codec), codec).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[7].n_turns == 400 and got[7].turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, _, r, t in rows))
    assert got[7].loss_sha256 == sha("".join(t for _, _, r, t in rows if r == "assistant"))
