from __future__ import annotations

import re
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelmetrics.llm import html_text

CASES = {
    "<p>a<p>b": "a\n\nb",
    "<p>a\n  b&amp;c &lt;d&gt; &eacute;&#233;&nbsp;e</p>": "a b&c <d> éé e",
    "<div>a</div><div>b</div>c": "a\nb\nc",
    "a<br>b<br/><br>c</br>d": "a\nb\n\nc\nd",
    "<h1>T</h1>x<hr>y": "T\n\nx\n\ny",
    "<ul><li>x<li>y<ul><li>z</ul><li>w</ul>": "- x\n- y\n  - z\n- w",
    "<ol start=3><li>a<li value=7>b<li>c</ol>": "3. a\n7. b\n8. c",
    "<ol reversed><li>a<li>b</ol>": "2. a\n1. b",
    "<ul><li><p>one</p><p>two</p></li><li>three</ul>": "- one\n\n  two\n\n- three",
    "<dl><dt>k<dd>v<dt>l<dd>w</dl>": "k\n  v\nl\n  w",
    "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "<pre>\n a\n   b\t c\n</pre>d": " a\n   b\t c\n\nd",
    "<table><tr><th>n<th>long head<tr><td>1<td>2<tr><td>100<td></table>": "n   | long head\n1   | 2\n100",
    "<table><caption>C</caption><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide cell here</table>": "C\na | b\n  | c\nwide cell here",
    "<table><tr><td>x<table><tr><td>i<td>j</table><td>y</table>z": "x     | y\n\ni | j\n\nz",
    "<td>loose</td><td>cells</td>": "loose cells",
    "<table>stray<tr><td>in</table>": "stray\nin",
    "<head><title>T</title><style>p{}</style></head><body>b": "b",
    "<title>T</title><p>b": "b",
    "<script>if (a < b) '</p>'</script>x<noscript>n</noscript><template>t</template>": "x",
    "a<!-- c --> b<!-- open": "a b",
    "<p hidden>h</p><p style='display: none'>h</p>s<input value=h><span style='visibility:hidden'>h<b style='visibility:visible'>v</b></span>": "s h v",
    "<style>/* x */ .gone, #no, aside{display:none} p.red{color:red}</style><p class='a gone'>1<p id=no>2<aside>3</aside><p class=red>4": "4",
    "<details><summary>S</summary>closed</details><details open><summary>S</summary>open</details>": "S\nS\nopen",
    "<dialog>no</dialog><dialog open>yes</dialog>": "yes",
    "<select><option>a<option selected>b<option>c</select>": "b",
    "<select multiple><option>a<option>b</select>": "a\nb",
    "<textarea> x <b> </textarea>": " x <b>",
    "<b>bo<i>ld</b> it</i> <a href='x>y'>link</a>": "bold it link",
    "1 < 2 <3 <> </> &unknown; <": "1 < 2 <3 <> </> &unknown; <",
    "<p title=\"unclosed>never shown": "",
    "<q>said</q>": "“said”",
    "x퟿ 　y  z": "x퟿ 　y z",
    "": "",
}


@pytest.mark.parametrize("source", CASES)
def test_layout(source):
    assert html_text.visible_text(source) == CASES[source]


STYLED = {
    "<style>@media print{.a{color:red}.b{display:none}} @media (max-width:600px){.a{x:y} .c{display:none}}</style><p class=b>1<p class=c>2": "1\n\n2",
    "<style>@media screen and (min-width:600px){.x{color:red}.b{display:none}}</style><p class=b>1<p>2": "2",
    "<style>.tab{display:none} .tab.on{display:block}</style><p class=tab>1<p class='tab on'>2": "2",
    "<style>.t{display:none} .open > .t, .no:hover{display:block}</style><p class=t>1<div class=open><p class=t>2</div>": "2",
    "<style>.t{display:none}</style><p class=t style='display:block'>1<p class=t>2": "1",
    "<style>.t{display:none!important}</style><p class=t style='display:block'>1<p>2": "2",
    "<style>.t{display:none} .t{display:block}#i{display:none}</style><p class=t>1<p class=t id=i>2": "1",
    "<style>.h{visibility:hidden} .h b{visibility:visible}</style><p class=h>1<b>2</b>": "2",
    "<style>tr.h{visibility:hidden}</style><table><tr class=h><td>1<tr><td>2</table>": "2",
    "<style>.m\\:h{display:none} a[href^='x']{display:none} p:not(.k) i{display:none}</style><b class='m:h'>1</b><a href=xy>2</a><p><i>3</i><p class=k><i>4</i>": "4",
    "<style>p{content:'}'} .b{background:url(a);display:none}</style><p class=b>1<p>2": "2",
    "<style>.b{display:none</style><p class=b>1<p>2": "2",
    "<style>.a,.b{display:none}@media (width >= 50em){.a{display:block}}@media not print{.b{display:BLOCK}}</style><p class=a>1<p class=b>2": "1\n\n2",
    "<style>.b:is(p,i),q{display:none} .c{display:none;display:bogus}</style><p class=b>1<p class=c>2<p>3": "3",
    "<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math>": "x=2",
    "<svg viewBox=x><title>no</title><defs><text>no</text></defs><path d='M0'/><g><text x=1>a<tspan>b</tspan></text></g><text>c</text>no</svg><p>d": "ab c\n\nd",
    "<svg><path><p>out": "out",
    "<input type=submit value=Go> <input type=BUTTON value=b><input type=text value=yes><input type=hidden value=no>": "Go b yes",
}


@pytest.mark.parametrize("source", STYLED)
def test_style_sheets_and_embedded_text(source):
    assert html_text.visible_text(source) == STYLED[source]


def test_wide_characters_keep_columns_aligned():
    assert html_text.visible_text("<table><tr><td>日本<td>a<tr><td>abcd<td>b</table>") == "日本 | a\nabcd | b"


@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<ul>", "<li>", "</ul>", "<b>", "</b>", "<pre>", "<div hidden>", "</div>", "x", " y ", "<!--", "-->", "<select>", "<", "&amp", "<style>", "</style>", "<a b='", "'>", "<h1>", "<dd>"]), max_size=25))
@settings(max_examples=300, deadline=None)
def test_any_soup_of_tags_is_read(parts):
    assert isinstance(html_text.visible_text("".join(parts)), str)


@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<ul>", "<li>", "</ul>", "<b>", "<table>", "<tr>", "<td>", "</td>", "</table>", "<h2>", "<blockquote>", "<br>"]), max_size=20))
@settings(max_examples=300, deadline=None)
def test_no_visible_word_is_lost(parts):
    source = "".join(f"{p} w{i} " for i, p in enumerate(parts))
    assert sorted(w for w in html_text.visible_text(source).split() if w[0] == "w") == sorted(f"w{i}" for i in range(len(parts)))


def test_deep_and_long_pages():
    assert html_text.visible_text("<div>" * 50_000 + "x") == "x"
    assert html_text.visible_text("<b " * 20_000) == ""
    assert len(html_text.visible_text("word " * 200_000)) == 999_999
    assert html_text.visible_text("<style>" + "a" * 300_000 + "</style>y") == "y"


def test_pages(llm):
    rows = [(i, "u", s, "old") for i, s in enumerate(CASES)] + [(None, None, "<p>n", "old"), (5, "u", None, "old"), (5, "u", None, "old")]
    pages = llm.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = html_text.extract_pages(pages).collect()
    assert sorted(((r.page_id, r.text) for r in got), key=str) == sorted(((r[0], html_text.visible_text(r[2])) for r in rows), key=str)
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(pages).columns == ["page_id", "url", "text"]
    assert html_text.extract_pages(pages.limit(0)).collect() == []


FIELDS = {
    "Name:<input value=Ada>!": "Name: Ada !",
    "a<input type=TEXT placeholder='Your name'>b": "a Your name b",
    "a<input type=email value=x@y placeholder=p>": "a x@y",
    "a<input type=password value=secret placeholder=hint>b": "ab",
    "a<input type=password placeholder=hint>": "a hint",
    "a<input type=hidden value=h><input type=checkbox value=c><input type=radio value=r><input type=range value=3>b": "ab",
    "a<input type=strange value=v>": "a v",
    "a<input type=date value=2001-01-01 placeholder=p><input type=date placeholder=p>": "a 2001-01-01",
    "<input type=submit value=Go><input value=x hidden>": "Go",
    "<p>a<textarea placeholder=hint></textarea><p>b<textarea placeholder=hint>own</textarea>": "ahint\n\nbown",
    "a <object>fallback <b>text</b></object> b": "a fallback text b",
    "a <object data=movie.swf>fallback</object> b": "a b",
    "a <progress value=3>30 %</progress> <meter>1 of 2</meter> b": "a b",
    "a<plaintext><b>not a tag</b>\n & no &amp; end</plaintext>": "a\n\n<b>not a tag</b>\n & no &amp; end</plaintext>",
}


@pytest.mark.parametrize("source", FIELDS)
def test_fields_fallbacks_and_plain_text(source):
    assert html_text.visible_text(source) == FIELDS[source]


class Naive(HTMLParser):
    """Words outside hidden elements of well-formed pages without style sheets, in order, ignoring all layout."""

    VOID = {"br", "hr", "img", "meta", "link", "wbr", "col", "area", "source", "embed", "base", "param", "track", "input"}

    def __init__(self):
        super().__init__()
        self.open, self.words = [], []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        plain = (given.get("style") or "").replace(" ", "").lower()
        gone = tag in html_text.UNSEEN or "hidden" in given or "display:none" in plain or "visibility:hidden" in plain
        if tag not in self.VOID:
            self.open.append((tag, gone))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(gone for _, gone in self.open):
            self.words += data.split()


def letters(words):
    """Letters and digits only: marks of lists and columns, and borders of words, are layout."""
    return "".join(c for w in words for c in w if c.isalnum())


def test_given_pages_have_the_words_of_a_naive_reader(llm):
    pages = llm.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_pages(pages).collect()}
    compared = 0
    for r in pages.collect():
        source = r.html or ""
        if re.search(r"<(svg|math|select|details|dialog|input|textarea|ol)\b|display:|visibility:", source, re.I):
            continue  # beyond the naive reader
        naive = Naive()
        naive.feed(source)
        naive.close()
        compared += 1
        assert sorted(letters(got[r.page_id].split())) == sorted(letters(naive.words)), r.page_id
    assert compared > 100
