import hashlib
import json
import random
import time

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_encoder_equals_the_library():
    model, library = bpe.WordBPE(json.load(open(PATH, encoding="utf-8"))), Tokenizer.from_file(PATH)
    r = random.Random(2)
    signs = "abcdeé'´ÀΣσςİß0123 \t\n\x1c\x1f\x85  éaaathinre.,!?<|endoftext|>😀日本ͅﬁ½²\x00\x7f"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 50))) for _ in range(3000)]
    texts += ["<|endoftext|>hi<|startoftext|>", "it's we'LL", "a" * 300, "", "banana" * 30, "İΣΑΣ", "é é"]
    for text, got, want in zip(texts, model.encode_many(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(got, np.int32).tolist() == want.ids, repr(text)
        assert model.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)


def test_very_long_words():
    """Random letters, one letter, a repeated syllable; the queue also against merging side by side on short words."""
    model, library = bpe.WordBPE(json.load(open(PATH, encoding="utf-8"))), Tokenizer.from_file(PATH)
    r = random.Random(7)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=300_000)), "a" * 100_000, "anthe" * 20_000 + "q", "é日" * 5_000]
    start = time.time()
    for word, got in zip(words, model.encode_many(words)):
        assert np.frombuffer(got, np.int32).tolist() == library.encode(word, add_special_tokens=False).ids
    assert time.time() - start < 60
    short = ["".join(r.choices("aehinorst", k=r.randint(1, 40))) for _ in range(2000)]
    assert [model.queued(w) for w in short] == model.merged(short)


def test_compatibility_is_exact():
    """Pairs of tokens found compatible are what exact merging gives, the others are not."""
    model = bpe.WordBPE(json.load(open(PATH, encoding="utf-8")))
    r = np.random.default_rng(3)
    inner = np.array([i for t, i in model.inner.items()])
    final = np.array([i for t, i in model.final.items()])
    x, y = r.choice(inner, 4000), r.choice(final, 4000)
    words = [model.symbols[a] + model.symbols[b][: -len(bpe.END)] for a, b in zip(x, y)]
    exact = [np.frombuffer(b, np.int32).tolist() for b in model.merged(words)]
    assert [e == [a, b] for e, a, b in zip(exact, x.tolist(), y.tolist())] == (model.compatible(x, y) & model.whole[x] & model.whole[y]).tolist()


def test_digest(docs, prose):
    library = Tokenizer.from_file(PATH)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [*prose, (70, "<|endoftext|> x"), (71, "a\x1cb")]
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted((tuple(r) for r in bpe.bpe_digest(docs(rows), PATH).collect()), key=str) == sorted(want, key=str)
    assert bpe.bpe_digest(docs([]), PATH).count() == 0


def test_decode(spark, docs, prose):
    both = bpe.bpe_documents(docs(prose), PATH)
    got = sorted((tuple(r) for r in bpe.decode_documents(both, PATH).collect()), key=str)
    assert got == sorted(((r["doc_id"], r["decoded"]) for r in both.collect()), key=str)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [320, 256])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in bpe.decode_documents(odd, PATH).collect()} == {1: "", 2: "", 3: "a</w> !</w>"}
