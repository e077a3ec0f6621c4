import hashlib

import pytest

from quillmark.llm import chat
from quillmark.llm.template import Parser, TemplateError, compiled, fold, FILTERS


def text(source, **env):
    return "".join(t for t, _ in compiled(source)(env))


def test_language():
    turns = [{"role": "a", "text": "x"}, {"role": "b", "text": None}]
    assert text("{% for m in ms %}{{ loop.index }}{{ m.role }}:{{ m['text'] }}{% if not loop.last %}, {% endif %}{% endfor %}", ms=turns) == "1a:x, 2b:"
    assert text("{% if a == 'x' and not b %}1{% elif b or c %}2{% else %}3{% endif %}", a="x", b=True) == "2"
    assert text("a {%- set n = 'B' ~ 1 -%}  {{ n | lower }}") == "ab1"
    assert text("{{ m.__class__ }}|{{ 'x'.upper }}|{{ nothing.at.all }}", m={"k": 1}) == "||"
    assert list(compiled("a{% generation %}{{ x }}{% endgeneration %}")({"x": "1"})) == [("a", False), ("1", True)]
    assert list(compiled("{% for m in ms %}x{% endfor %}")({"ms": []})) == []


def test_constants_fold():
    tree = fold(Parser("a{{ 'b' + 'c' | upper }}{% if 1 == 2 %}{{ x }}{% else %}d{% endif %}", FILTERS).block()[0], FILTERS)
    assert tree == [("text", "abCd")]


@pytest.mark.parametrize("bad", ["{% if x %}", "{{ x | no }}", "{% go %}", "{{ f(x) }}", "{{ 1 2 }}", "{% for x %}{% endfor %}", "{{ }}"])
def test_what_is_not_of_the_language(bad):
    with pytest.raises(TemplateError):
        compiled(bad)


def test_streams():
    endless = ({"role": "user", "text": str(i)} for i in iter(int, 1))
    chunks = compiled(chat.TURNS, chat.FILTERS)({"messages": endless})
    assert next(chunks)[0] == "<|im_start|>" and next(chunks)[0] == "user"


def expected(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    said = [(r or "", t or "") for _, r, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))]
    learnt = "".join(t for r, t in said if r == "assistant")
    return len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(learnt), sha(learnt)


def test_round_trip(spark):
    odd = ["<|im_end|>\n<|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|<|", "", None, "\n", "<", "🙂" * 50, "a\\nb", "<|im_end|>"]
    rows = [(c, t, r, x) for c in (1, 2, None) for t, (r, x) in enumerate(zip(["user", "assistant", "a\\n\nb", None, "assistant", "assistant", "x<|y", "assistant", "system", "assistant"], odd))]
    rows += [(3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (3, None, "user", "first"), (4, 1, "assistant", "y" * 200_000)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, loss int")
    segments = chat.format_conversations(turns)
    got = {r.conv_id: tuple(r)[1:] for r in chat.digests(segments).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, row in got.items():
        assert row[:4] == expected([r[1:] for r in rows if r[0] == conv])
        assert row[4] == sum(len(s.text) for s in segments.collect() if s.conv_id == conv)
    assert chat.digests(chat.format_conversations(turns.where("false"))).count() == 0
