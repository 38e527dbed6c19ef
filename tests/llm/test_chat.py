import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import chat_format, chat_template
from tickloom.llm.chat_format import FILTERS, TEMPLATE, escape, format_conversations, read_back, turns_of, unescape
from tickloom.llm.chat_template import Page, TemplateError, compile_template, fold, parse


def render(source, **scope):
    page = Page()
    names = {}
    done = compile_template(source, FILTERS)
    done.head(names, page)
    done.turn(names | {k.replace("_", ".", 1): v for k, v in scope.items()}, page)
    done.tail(names, page)
    return "".join(page.pieces), page.spans


def test_language():
    loop = "{%% for message in messages %%}%s{%% endfor %%}"
    assert render("a{# no #}" + loop % "{{ message.role | upper }}:{{ message.text | trim }}" + "z", message_role="user", message_text=" hi ") == ("aUSER:hiz", [])
    source = loop % "{% if loop.first and not loop.last %}F{% elif message.role == 'x' or loop.index == 2 %}X{% else %}E{% endif %}"
    assert [render(source, loop_first=f, loop_last=False, message_role=r, loop_index=i)[0] for f, r, i in [(True, "", 1), (False, "x", 1), (False, "", 2), (False, "", 3)]] == list("FXXE")
    text, spans = render(loop % "{% set who = message.role ~ '!' %}{{ who }}{% generation %}{{ message.text }}{% endgeneration %}.", message_role="é", message_text="🙂b")
    assert text == "é!🙂b." and spans == [(2, 4)]
    assert render("{% set n = 'A\\n' %}" + loop % "{{ n }}")[0] == "A\n"
    assert render(loop % "{{ (message.text == previous.role) ~ true ~ 3 }}", message_text=None)[0] == "truetrue3"


def test_constants_are_folded():
    nodes = fold(parse("a{{ 'b' ~ 1 | upper }}{% if 1 == 2 %}x{% elif not false %}c{{ 'd' | upper }}{% else %}y{% endif %}", {"upper": str.upper}), {"upper": str.upper})
    assert nodes == [("const", "ab1cD")]
    nodes = fold(parse("{% for message in messages %}{{ true and message.text }}{{ false and message.text }}{% endfor %}", {}), {})
    assert nodes == [("loop", [("out", ("field", "message.text")), ("const", "false")])]


@pytest.mark.parametrize(
    "source",
    [
        "{{ x }}", "{{ message.__class__ }}", "{{ message.text.upper }}", "{{ message['text'] }}", "{{ open('x') }}", "{{ 'a' | eval }}", "{{ 1 + }}",
        "{% for m in x %}{% endfor %}", "{% for message in messages %}", "{% if true %}", "{% endif %}", "{% import os %}", "{{ message.text }}", "{{ 'a'",
        "{% set message = 1 %}", "{% set if = 1 %}", "{% for message in messages %}{% for message in messages %}{% endfor %}{% endfor %}",
        "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{% if true %}{% else %}{% else %}{% endif %}", "{{ loop.first }}",
    ],
)
def test_refused(source):
    with pytest.raises(TemplateError):
        compile_template(source, FILTERS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="\\<turn>/\n aé\r\x00"), st.text(alphabet="\\<turn>/\n aé"))))
def test_round_trip(said):
    done, page = compile_template(TEMPLATE, FILTERS), Page()
    for role, text in said:
        done.turn({"message.role": role, "message.text": text}, page)
    assert list(turns_of("".join(page.pieces))) == said
    assert all(unescape(escape(t)) == t for _, t in said)


def brute(rows):
    out = {}
    for i, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(i, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    learned = {i: "".join(t for r, t in said if r == "assistant") for i, said in out.items()}
    return {i: (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(learned[i]), sha(learned[i])) for i, said in out.items()}


ROWS = [
    (1, 0, "user", "<turn>a\\</turn>\n"), (1, 1, "assistant", "\\### </turn> ok"), (1, None, None, None), (1, 1, "assistant", "\\### </turn> ok"),
    (2, 5, "assistant", "é🙂 中" * 20_000), (2, 4, "a\nb<turn>", ""), (3, 0, "", ""), (None, 0, "user", "x"), (None, None, "assistant", "y"), (None, None, None, None),
]


@pytest.mark.parametrize("piece", [1, 50, 1_000_000])
def test_same_as_brute_force(spark, piece):
    frame = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as id", "'y' as piece", "'z' as Offset", "1 as spans")
    pieces = format_conversations(frame, piece_chars=piece)
    for in_order in (True, False):
        got = {r["conv_id"]: tuple(r)[1:5] for r in read_back(pieces, in_order=in_order).collect()}
        assert got == brute(ROWS)
    whole = sorted((r for r in pieces.collect() if r["conv_id"] == 1), key=lambda r: r["piece"])
    assert [r["offset"] for r in whole] == [sum(len(x["formatted"]) for x in whole[:k]) for k in range(len(whole))]
    assert len(whole) == {1: 4, 50: 2}.get(piece, 1)
    assert format_conversations(frame.where("false")).count() == 0 and read_back(pieces.where("false")).count() == 0


def test_head_tail_and_neighbours(spark):
    frame = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "b", "y"), (2, 0, "a", "z")], "conv_id long, turn long, role string, text string")
    source = "<<{% for message in messages %}{{ previous.role }}{{ loop.index }}{{ message.text }}{% if loop.last %}!{% endif %}{% endfor %}>>"
    got = {r["conv_id"]: r["formatted"] for r in format_conversations(frame, source).collect()}
    assert got == {1: "<<1xa2y!>>", 2: "<<1z!>>"}
    with pytest.raises(TemplateError):
        format_conversations(frame, "{{ secrets }}")
    assert chat_template.compile_template("", {}) is not None and chat_format.BEGIN in TEMPLATE
