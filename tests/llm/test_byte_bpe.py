import base64
import hashlib
import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

from srcatlas.llm import byte_bpe  # noqa: E402

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.codec(open(PATH, "rb").read(), PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_same_ids_as_the_library(codec, library):
    rng = random.Random(5)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "aab", "etaoin ", " \n\t'sdlmrvt", "éèüßñ中文字😀 ", "0123456789.,-", "<|endoftext|> "]
    texts = ["", " ", "a" * 3000, "ab" * 999, "<|endoftext|>", "it's they'll WE'RE", "\x00\x1c\x85᠎　x", "https://a.b/c?d=e&f#g"]
    for _ in range(1500):
        letters = rng.choice(alphabets)
        texts.append("".join(rng.choice(letters) for _ in range(rng.randint(1, 60))))
    for text in texts:
        assert codec.encode(text) == packed(library.encode_ordinary(text)), text[:80]
        assert codec.decode(codec.encode(text)) == text.encode()


def test_frame(spark, library):
    rows = [(1, "Hello world, hello!", "x"), (2, None, "y"), (3, "", None), (4, "naïve café 😀" * 500, "z"), (4, "naïve café 😀" * 500, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = byte_bpe.digests(df, PATH, PATTERN).collect()
    want = sorted((i, len(ids := library.encode_ordinary(t or "")), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    assert sorted(map(tuple, out)) == want
    assert byte_bpe.encode(df, PATH, PATTERN).columns == ["doc_id", "text", "token_ids", "n_tokens"]
    assert byte_bpe.digests(df.limit(0), PATH, PATTERN).count() == 0
    apart = byte_bpe.decode(byte_bpe.encode(df, PATH, PATTERN), PATH)
    assert sorted((r["doc_id"], bytes(r["decoded"])) for r in apart.collect()) == sorted((i, (t or "").encode()) for i, t, _ in rows)


def test_memory_is_bounded(codec, library, monkeypatch):
    codec.fits.clear()
    codec.known.clear()
    codec.held = 0
    monkeypatch.setattr(byte_bpe, "REMEMBERED_BYTES", 5000)
    monkeypatch.setattr(byte_bpe, "REMEMBERED_PAIRS", 20)
    rng = random.Random(6)
    for _ in range(50):
        text = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 30))) for _ in range(40))
        assert codec.encode(text) == packed(library.encode_ordinary(text))
        assert codec.held <= 5000 + 600 and len(codec.fits) <= 20 and len(codec.known) < 40


def merged(codec, piece):
    """By definition: the adjacent pair of the lowest rank is merged, until none has one."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        lowest, at = min((codec.ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if lowest == 1 << 30:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


def test_neighbours_by_definition(codec):
    rng = random.Random(7)
    letters = [r for r, t in enumerate(codec.tokens) if t.isalpha()]
    for _ in range(20_000):
        a, b = rng.choice(letters), rng.choice(letters)
        if rng.random() < 0.5:  # the parts of one token
            t = codec.tokens[a]
            k = rng.randint(1, max(1, len(t) - 1))
            a, b = codec.ranks.get(t[:k], a), codec.ranks.get(t[k:], b)
        assert codec._side_by_side(a, b) == (merged(codec, codec.tokens[a] + codec.tokens[b]) == [codec.tokens[a], codec.tokens[b]])
