"""Token counts of whole texts; huge ones are encoded in overlapping chunks that are spliced where both agree."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import in_batches

#: Characters of a chunk and of what two chunks share at first. Texts of up to one chunk are encoded at once.
CHUNK, OVERLAP = 1 << 15, 256


def splices_at_spaces(model) -> bool:
    """Proof from the vocabulary that a space after another character always begins a piece.

    Merges only make pieces of the vocabulary. If none has a space behind another character, none reaches across such a
    place, and what stands before it never changes the pieces behind it. Normalisation must leave the spaces as they are.
    """
    if model.encode("a  b ", out_type=str) != [*model.encode("a  b", out_type=str), "▁"]:
        return False
    return not any(re.search("[^▁]▁", model.id_to_piece(i)) for i in range(model.get_piece_size()))


def ends(model, text: str, begin: int, end: int) -> list[int]:
    """Where the pieces of text[begin:end] end, as positions in the text; inside a character for a byte of it."""
    part = text[begin:end]
    places = [p.end for p in model.encode(part, return_type="proto").pieces]
    if part.isascii():
        return [begin + p for p in places]
    raw = np.frombuffer(part.encode(), np.uint8)
    before = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    return (begin + before[places]).tolist()


def meeting(text: str, left: list[int], right: list[int], low: int) -> int | None:
    """The last place after `low` where both chunks begin a piece and a space follows another character."""
    common = set(right)
    return next((p for p in reversed(left) if p > low and p in common and p < len(text) and text[p] == " " and text[p - 1] != " "), None)


def count_chunked(model, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Pieces of the text. Chunks share `overlap` characters; where the shared part has no proven common boundary, it is
    doubled, until the new chunk reaches back to the last splice and so holds all that is open. Then the open part is taken as
    one, and grows by twice as much the next time, so that a text without boundaries is encoded a few times, not often."""
    total, at, begin, stop = 0, -1, 0, min(chunk, len(text))  # a first piece may end at 0: the space set before the text
    open_ends, step = ends(model, text, 0, stop), chunk
    while stop < len(text):
        share, place = overlap, None
        while place is None:
            start = max(at, 0, stop - share)
            until = min(len(text), stop + step)
            if start == max(at, 0):
                break
            further = ends(model, text, start, until)
            place = meeting(text, open_ends, further, start)
            share *= 2
        if place is None:
            stop, step = until, 2 * step
            open_ends = ends(model, text, begin, stop)
            continue
        total += sum(at < p <= place for p in open_ends)
        at, begin, stop, open_ends, step = place, start, until, further, chunk
    return total + sum(p > at for p in open_ends)


def token_counts(docs: DataFrame, tokenizer: str, *, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs(doc_id, text).

    tokenizer: path of a SentencePiece model that every executor can open. No begin, end or special tokens are added.
    A null text counts as empty: no bytes, no tokens. Repeated rows are counted each; other columns are ignored.
    A model whose vocabulary doesn't prove the splices encodes huge texts in one go.
    """

    def make():
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
        proven = splices_at_spaces(model)

        def f(cols):
            texts = [t or b"" for t in cols["text"]]
            whole = [(i, t.decode()) for i, t in enumerate(texts)]
            short = [(i, t) for i, t in whole if len(t) <= chunk or not proven]
            n = dict(zip((i for i, _ in short), map(len, model.encode([t for _, t in short], num_threads=1)), strict=True))
            n |= {i: count_chunked(model, t, chunk, overlap) for i, t in whole if i not in n}
            return {"doc_id": cols["doc_id"], "n_bytes": list(map(len, texts)), "n_tokens": [n[i] for i in range(len(texts))]}

        return f

    counted = in_batches(docs.select("doc_id", "text"), make, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
