"""Conversations rendered by a template, with the part that a model is trained on, and read back from that."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import arrow_schema, shuffle_partitions
from quillmark.llm.template import as_text, compiled

START, END = "<|im_start|>", "<|im_end|>"
TURNS = (
    "{% for turn in messages %}<|im_start|>{{ turn.role | escape_role }}\n"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}"
    "{% else %}{{ turn.text | escape }}{% endif %}<|im_end|>\n{% endfor %}"
)
#: Characters after which an output batch ends.
BATCH_CHARS = 4 << 20


def escape(value) -> str:
    r"""No control string remains: every `<`, backslashes, `|` gets one more backslash. unescape() takes it away."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", as_text(value))


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(value) -> str:
    """Of one line as well."""
    return escape(as_text(value).replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


FILTERS: dict[str, Callable] = {"escape": escape, "escape_role": escape_role}
SEGMENTS = "conv_id long, seg_no long, text string, loss boolean"


def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def packed(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches that stay small however long the texts are."""
    held, chars = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        chars += sum(len(x) for x in row if isinstance(x, str))
        if chars > BATCH_CHARS or len(held) >= 10_000:
            yield batch()
            held, chars = [], 0
    if held:
        yield batch()


def format_conversations(turns: DataFrame, template: str = TURNS) -> DataFrame:
    """(conv_id, seg_no, text, loss): what the template makes of each conversation, in segments; loss marks what is trained on.

    turns has conv_id, turn, role and text; other columns are ignored. A conversation's rows go by turn, then role, then text,
    so ties and repeated rows come out alike each time. Null role or text counts as empty; rows without a conv_id are one
    conversation without an id. Conversations are rendered as a stream in sorted partitions: even one that holds a third of
    all rows is never in memory as a whole. The segments of a conversation stand together and in order.
    """
    arrow = arrow_schema(turns.sparkSession, SEGMENTS)

    def run(batches):
        render = compiled(template, FILTERS)

        def rows():
            for conv, own in groupby(stream(batches), key=lambda r: r[0]):
                messages = ({"role": role, "text": text} for _, _, role, text in own)
                for n, (text, loss) in enumerate(render({"messages": messages})):
                    yield conv, n, text, loss

        return packed(rows(), arrow)

    own = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return own.mapInArrow(run, SEGMENTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(segments: DataFrame) -> DataFrame:
    """What can be read back from segments that TURNS made: the turns and what is trained on, of each conversation."""
    arrow = arrow_schema(segments.sparkSession, DIGESTS)

    def run(batches):
        rows = ((conv, *read_back((text, loss) for _, _, text, loss in own)) for conv, own in groupby(stream(batches), key=lambda r: r[0]))
        return packed(rows, arrow)

    return segments.mapInArrow(run, DIGESTS)


def read_back(segments: Iterable[tuple[str, bool]]) -> tuple[int, str, int, str, int]:
    turns, trained = hashlib.sha256(), hashlib.sha256()
    n = loss_chars = chars = 0
    rest, marked = "", ""
    for text, loss in segments:
        chars += len(text)
        rest += text
        if loss:
            marked += text
        elif marked:
            loss_chars, marked = loss_chars + _learn(trained, marked), ""
        if END not in text:
            continue
        while (end := rest.find(END + "\n")) >= 0:
            role, _, said = rest[len(START) : end].partition("\n")
            if not rest.startswith(START):
                raise ValueError(f"no turn begins at {rest[:40]!r}")
            turns.update(f"{unescape_role(role)}\n{unescape(said)}\n".encode())
            n, rest = n + 1, rest[end + len(END) + 1 :]
    loss_chars += _learn(trained, marked)
    if rest:
        raise ValueError(f"an open turn: {rest[:40]!r}")
    return n, turns.hexdigest(), loss_chars, trained.hexdigest(), chars


def _learn(digest, marked: str) -> int:
    text = unescape(marked)
    digest.update(text.encode())
    return len(text)
