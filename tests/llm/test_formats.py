"""Chat records, templates and page extraction."""

from __future__ import annotations

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexistat.llm import chat, extraction

SAME = [{"role": "user", "text": "hi"}, {"role": "assistant", "text": "yo"}]


@pytest.mark.parametrize("record", [
    {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]},
    {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}], "id": 3, "source": {"a": 1}},
    {"instruction": "hi", "output": "yo"}, {"prompt": "hi", "completion": "yo", "score": 2.5},
    {"prompt": "hi", "response": "yo"}, {"question": "hi", "answer": "yo"}, {"data": {"prompt": "hi", "response": "yo"}},
    {"turns": [{"text": "hi", "role": "user", "n": 1}, {"text": "yo", "role": "assistant"}]},
])
def test_layouts_give_the_same_turns(record):
    assert chat.canonical(json.dumps(record))["turns"] == SAME


def test_fingerprints_are_distinct_and_unknown_layouts_are_null():
    met = [print_ for prints in chat.MET.values() for print_ in prints]
    assert len(set(met)) == len(met)
    for raw in (None, "", "[1]", "3", "{", '{"a": 1}', '{"messages": 1}', '{"messages": [3]}', '{"turns": "x"}', '{"messages": [{}]}'):
        assert chat.canonical(raw) is None
    assert chat.canonical('{"prompt": null, "response": 3}')["turns"] == [
        {"role": "user", "text": ""}, {"role": "assistant", "text": "3"}]


@pytest.mark.parametrize("record, turns", [
    ({"messages": []}, []),
    ({"turns": []}, []),
    ({"system": "s", "messages": []}, [("system", "s")]),
    ({"system": "s", "messages": [{"role": "user", "content": "a"}]}, [("system", "s"), ("user", "a")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image", "url": "x"}, "b"]},
                   {"role": "assistant", "content": "c"}, {"role": "human", "content": None},
                   {"role": "user", "content": []}]},
     [("user", "a\nb"), ("assistant", "c"), ("human", ""), ("user", "")]),
    ({"system": "s", "instruction": "i", "output": "o"}, [("system", "s"), ("user", "i"), ("assistant", "o")]),
    ({"system": "s", "instruction": "i", "input": "j", "output": "o"},
     [("system", "s"), ("user", "i\n\nj"), ("assistant", "o")]),
    ({"prompt": "a", "messages": [{"role": "user", "content": "b"}]}, [("user", "b")]),
])
def test_optional_paths_and_lists_of_parts(record, turns):
    assert [(t["role"], t["text"]) for t in chat.canonical(json.dumps(record))["turns"]] == turns


def test_records_without_a_layout_are_counted(spark):
    rows = spark.createDataFrame([(r,) for r in ('{"messages": []}', '{"turns": []}', "no", None, '{"x": 1}')], "record string")
    made, name = chat.format_records(rows)
    assert dict(map(tuple, chat.layout_counts(made, name).collect())) == {"messages": 1, "turns": 1, None: 3}
    assert sorted(r[0] for r in made.where(f"{name} is not null").select(f"{name}.formatted").collect()) == ["", ""]


def test_conversations_come_in_several_layouts(spark):
    rows = spark.createDataFrame([(c, t, r, "x\ny") for c in range(30) for t, r in ((0, "user"), (1, "human"))],
                                 "conv_id bigint, turn int, role string, text string")
    records = [json.loads(r.record) for r in chat.conversation_records(rows).collect()]
    assert len({tuple(sorted(chat.field_paths(r))) for r in records}) == 3
    assert {json.dumps(chat.canonical(json.dumps(r))["turns"]) for r in records} == {
        json.dumps([{"role": "user", "text": "x\ny"}, {"role": "human", "text": "x\ny"}])}


pieces = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "\n", "<", "s>", "/", "é", "x", " ", "</s>\n<s>"]) | st.text(max_size=3),
                  max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "o\nd<s>"]) | pieces, pieces), max_size=5))
def test_template_is_read_back(turns):
    made = chat.template([{"role": r, "text": t} for r, t in turns])
    assert chat.parse(made["formatted"]) == turns
    said = [chat.unescape(made["formatted"][s["start"] : s["end"]]) for s in made["loss"]]
    assert said == [t for r, t in turns if r == "assistant"]
    assert made["formatted"].count("</s>") == len(turns)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", None, 0), (1, 1, "assistant", "b", 0), (2, None, None, "x", 0),
            (None, 0, "user", "n", 0), (-7, 0, "user", "</s>[INST] ok [/INST]", 0), (-7, 1, "assistant", "</s>[INST] ok [/INST]", 0)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, chat int")
    found = {r.conv_id: r for r in chat.conversation_digests(frame).collect()}
    text = "user\n\nassistant\nb\nassistant\nb\n"
    assert (found[1].n_turns, found[1].turns_sha256, found[1].loss_chars) == (3, hashlib.sha256(text.encode()).hexdigest(), 2)
    assert found[-7].loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()
    assert set(found) == {1, 2, None, -7}
    assert chat.conversation_digests(frame.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="home">
<header class="site-header"><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies, and you agree to that by reading on here.</div>
<div id="main-content"><h1>The long title of this page</h1>
<p>First paragraph of the story &amp; more, with <b>bold</b>ness and a <a href="x">link</a> inside of it.
<p>Second paragraph<br>goes on for a while, so that it has words. It has two sentences.
<div class="ad">Buy now! The best offer of the whole year is here for you.</div>
<ul><li>One point</li><li>Another point</li></ul>
<p>Last   words&nbsp;of the story come here, and they are long enough.</p>
<form><label>Name</label><input><button>Send</button></form></div>
<aside class="sidebar"><h3>Related</h3><a href="1">Other story one</a><a href="2">Other story two</a></aside>
<section class="comments"><article class="comment"><p>A reader says that this was a very good text. Thanks for it!</p></article></section>
<footer>&copy; 2020 Site. All rights reserved.</footer></body></html>"""


def test_page():
    assert extraction.main_text(PAGE) == (
        "The long title of this page First paragraph of the story & more, with boldness and a link inside of it. "
        "Second paragraph goes on for a while, so that it has words. It has two sentences. One point Another point "
        "Last words of the story come here, and they are long enough.")


def test_page_without_marks():
    body = "".join(f"<div>Sentence number {i} of the text goes on, and it ends. A second one follows it here.</div>" for i in range(5))
    menu = "".join(f"<a href='{i}'>Item {i}</a> " for i in range(9))
    text = extraction.main_text(f"<body><div>{menu}</div>{body}<div>Copyright 2020</div></body>")
    assert text.startswith("Sentence number 0") and text.endswith("follows it here.") and text.count("Sentence") == 5


STORY = "The story goes on here, and it is long enough to be read by all. A second sentence follows it."
OTHER = "Buy this now, because the offer ends very soon for all of you. It is the best one of the year!"


@pytest.mark.parametrize("open_tag", [
    "<aside>", "<div class=ad>", "<div class=notice>", "<form>", "<div class=comments>", "<div class=comment-body>",
    "<div class=ad-content>", "<div class=sidebar-content>", "<div class=footer-content>", "<div class=cookie-text>",
    "<div class=main-nav>", "<div class=comment><div class=text>", "<aside><article><div class=entry>",
    "<article class=comment-body>"])
@pytest.mark.parametrize("outer", ["<main><article>", "<article><div class=content>", "<div class=post>"])
def test_marked_regions_inside_content_go(outer, open_tag):
    ends = "".join(f"</{t[1:].split('>')[0].split()[0]}>" for t in reversed([x for x in open_tag.replace("><", ">|<").split("|")]))
    page = f"<body>{outer}<p>{STORY}</p>{open_tag}<p>{OTHER}</p>{ends}<p>{STORY}</p>"
    assert extraction.main_text(page) == f"{STORY} {STORY}"


@pytest.mark.parametrize("start", [
    "<head><title>T</title><div>", "<head><title>T</title><meta charset=utf-8><p>", "<head><title>T</title>", "<head><script>x</script><b>",
    "<form><div id=content><p>", "<div class=comments><main><p>", "<div class='post has-sidebar'><p>", "<form><article><p>",
    "<article><div class=entry-header><p>"])
def test_content_is_not_lost(start):
    assert extraction.main_text(f"<html>{start}{STORY}") == STORY
    assert extraction.main_text("<head><noscript><i>no</i></noscript><template><div>no</div></template></head>" + STORY) == STORY


def test_odd_pages(spark):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "<p"), (4, "u", "<article><p>a &lt;b&gt; &am"), (4, "u", "<article><p>a &lt;b&gt; &am"),
             (5, "u", "<article>" + "<p>word here.</p>" * 3000), (6, "u", "</p></div>" + "<div>" * 600 + "<article>x y</article>")]
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id bigint, url string, html string, text int")
    found = {r.page_id: r for r in extraction.extract_pages(frame).collect()}
    assert [found[i].text for i in (1, 2, 4)] == ["", "", "a <b> &am"]
    assert found[5].text == " ".join(["word here."] * 3000) and found[5].n_chars == len(found[5].text)
    assert found[6].text == "x y"
    assert extraction.extract_pages(frame.limit(0)).count() == 0


def test_cut_is_minimal():
    flow = extraction.Flow(4)
    flow.join(2, 0, 5, 0)
    flow.join(1, 3, 4, 0)
    flow.join(0, 1, 1, 1)
    assert flow.run(2, 3) == [True, False, True, False]


def test_kept_pieces_are_bounded_by_bytes():
    """Small generations give the ids of whole texts too, and long pieces don't pile up."""
    import pyarrow as pa
    from lexistat.llm.tokens import Encoder, vocabulary_path

    small, whole = (Encoder(vocabulary_path("byte_bpe_50k.json"), most) for most in (20_000, 64_000_000))
    for k in range(6):
        texts = pa.array([f"common words of all texts {i} " + "x" * (i * 700) + f" own{k}{i}" for i in range(20)])
        a, b = small.encode(texts), whole.encode(texts)
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
        assert small.size <= 10_000
    assert " of" in small.known or " of" in small.old
