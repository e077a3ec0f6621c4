import random

import public_tokenizers
import sentencepiece

from quillmark.llm import tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_counts(docs, none):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = sorted(map(tuple, tokens.token_counts(docs, PATH, chunk=100, overlap=8, limit=50).collect()), key=repr)
    want = sorted(((r.doc_id, len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 50) for r in docs.collect()), key=repr)
    assert got == want
    assert tokens.token_counts(none, PATH).count() == 0


def test_chunks_meet_where_they_must():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert tokens.splices_at_spaces(model)
    rng = random.Random(1)
    for _ in range(150):
        text = "".join(rng.choice(["a", "b", " ", "  ", "ing", "é", "🙂", "\n", "the ", "x" * 60, " " * 70, "1", "▁"]) for _ in range(rng.randint(0, 300)))
        assert tokens.count_chunked(model, text, rng.choice([30, 90]), rng.choice([1, 8, 40])) == len(model.encode(text)), text
