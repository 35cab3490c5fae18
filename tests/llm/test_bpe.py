import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from slotwise.llm.bpe import Codec, PrefixTable, encode_documents, op1_bpe, rank_file

FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


@pytest.fixture(scope="module", params=FILES)
def both(request):
    data = rank_file(public_tokenizers.path(request.param))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return Codec(data, public_tokenizers.PATTERN), tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(codec, text):
    return list(memoryview(codec.encode(text)).cast("I"))


def test_against_tiktoken(both):
    codec, other = both
    rng = random.Random(1)
    tokens = list(codec.vocabulary.ranks)
    texts = ["", " ", "\x1c\x1f x", "a" * 5000, "日本語 😀‍", "  \n\n x", "don't I'LL", "<|endoftext|>"]
    texts += ["".join(rng.choice("abcdefgh ") for _ in range(3000)), "".join(rng.choice("abcdefgh") for _ in range(3000))]
    texts += [b"".join(rng.choices(tokens, k=rng.randint(1, 8))).decode("utf8", "replace") for _ in range(3000)]
    texts += ["a" + chr(c) + "1" + chr(c) for c in range(0, 0x110000, 211) if not 0xD800 <= c < 0xE000]
    for t in texts:
        assert ids(codec, t) == other.encode_ordinary(t), t[:80]
        assert codec.decode(codec.encode(t)) == t.encode()


def test_appending_and_edits(both):
    v, rng = both[0].vocabulary, random.Random(2)
    table, data = PrefixTable(v), b""
    for _ in range(60):
        part = bytes(rng.choices(b"abcdething", k=rng.randint(0, 9)))
        before = table.last[:]
        table.append(part)
        data += part
        assert table.last[: len(before)] == before and table.tokens() == PrefixTable(v, data).tokens()
    for _ in range(200):
        i = rng.randrange(len(data))
        j, new = min(len(data), i + rng.randint(0, 12)), bytes(rng.choices(b"thexing", k=rng.randint(0, 9)))
        table.replace(i, j, new)
        data = data[:i] + new + data[j:]
        assert (table.data, table.last) == (data, PrefixTable(v, data).last)


def test_query(spark, sf, empty):
    _, other = Codec(rank_file(public_tokenizers.path(FILES[0])), public_tokenizers.PATTERN), None
    data = rank_file(public_tokenizers.path(FILES[0]))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    other = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((str(r.doc_id), len(e := other.encode_ordinary(r.text or "")), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in e)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in texts)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op1_bpe(spark, sf).collect()) == want
    assert op1_bpe(spark, empty).count() == 0
    with_ids = encode_documents(spark.read.parquet(f"{sf}/documents.parquet"), data, public_tokenizers.PATTERN, with_ids=True).first()
    assert len(with_ids.ids) == 4 * with_ids.n_tokens
