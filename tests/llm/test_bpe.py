import random

import numpy as np
from tokenizers import Tokenizer

from tidemark.llm.bpe import VOCABULARY, encode_decode, encode_texts, vocabulary
from tidemark.llm.pretokens import pretokens

ALPHABET = [*" \n\t'stdmrevl'aAéñ12½!?.-_<|> 　日本𝒳\x1c ", "'s", "'re", "'ll", "  ", "<|endoftext|>", "'ve", "the", " of"]


def test_fuzz_against_library():
    library, vocab, rng = Tokenizer.from_file(VOCABULARY), vocabulary(VOCABULARY), random.Random(7)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["", None, "a" * 3000, " " * 500 + "x", "''s", "don't they're ''ll", "ab" * 700 + "!" * 999]
    for text, ids in zip(texts, encode_texts(vocab, texts, vocab.encode_words, {}), strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        got = np.frombuffer(ids, "<u4")
        assert got.tolist() == want
        assert vocab.decode(got) == library.decode(want, skip_special_tokens=False)


def test_every_code_point_is_cut_like_the_library():
    cut = Tokenizer.from_file(VOCABULARY).pre_tokenizer.pre_tokenize_str
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 40_000):
        text = "".join(f"a{c}1{c}!{c} {c}" for c in points[at : at + 4_000])
        assert pretokens([text])[0].to_pylist() == [text[a:b].encode() for _, (a, b) in cut(text)]


def test_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 0), (2, None, 0), (2, "", 0), (None, "x<|endoftext|>y", 0)], "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id or 0, r.decoded, len(r.ids) // 4) for r in encode_decode(docs).collect()))
    assert got == [(0, "x<|endoftext|>y", 3), (1, "a b", 2), (2, "", 0), (2, "", 0)]
    assert encode_decode(docs.limit(0)).count() == 0
