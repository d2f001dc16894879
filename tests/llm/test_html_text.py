import random

import pytest

from tablescribe.llm import html_text
from tablescribe.llm.html_text import main_text

LONG = "The council met on Monday and agreed that the bridge would stay closed until the repairs are done, whatever they cost."
MORE = "Engineers had found cracks in two of the pillars last spring; since then only cyclists and people on foot may cross it."


def page(body, head="<title>A title</title><style>p{}</style><script>var t='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


CASES = {
    "plain article": (page(f"<nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Bridge</h1><p>{LONG}</p><p>Yes.</p></article><footer>&copy; us</footer>"), f"Bridge\n{LONG}\nYes."),
    "sloppy tags": (page(f"<article><h1>Bridge</h1><p><b>{LONG}<br><p>So\n it   is &amp; was.<p>{MORE}</article><footer>x"), f"Bridge\n{LONG}\nSo it is & was.\n{MORE}"),
    "no article": (page(f"<div class=top><a href=/a>A</a> <a href=/b>B</a></div><div><h1>Bridge</h1><p>{LONG}</p><p>Short.</p><p>{MORE}</p></div><div><a href=/c>C</a></div>"), f"Bridge\n{LONG}\nShort.\n{MORE}"),
    "no containers": (page(f"<ul><li><a href=/>Home page</a><li><a href=/n>News page</a></ul><h1>Bridge</h1><p>{LONG}<p>{MORE}<p>End."), f"Bridge\n{LONG}\n{MORE}\nEnd."),
    "comments": (page(f"<main><h1>Bridge</h1><p>{LONG}</p><section id='comments'><h3>2 comments</h3><p>{MORE} {MORE}</p></section></main>"), f"Bridge\n{LONG}"),
    "comment articles": (page(f"<article><p>{LONG}</p></article><article class='comment odd'><p>{MORE} {MORE} {MORE}</p></article>"), LONG),
    "sidebars": (page(f"<div class='left-sidebar'><p>{MORE} {MORE}</p></div><div id=content><p>{LONG}</p><aside><p>{MORE}</p></aside></div><div class='cookie-notice'><p>{MORE}</p></div>"), LONG),
    "with sidebar": (page(f"<div class='content has-sidebar'><p>{LONG}</p></div><div class=sideBar>{MORE}</div>"), LONG),
    "forms": (page(f"<article><p>{LONG}</p><form><label>Name</label><input><select><option>One<option>Two</select><button>Send</button></form><p>End.</p></article>"), f"{LONG}\nEnd."),
    "headers": (page(f"<header><h1>The Paper</h1><p>{MORE}</p></header><article><header><h1>Bridge</h1></header><p>{LONG}</p></article>"), f"Bridge\n{LONG}"),
    "advert in the text": (page(f"<article><p>{LONG}</p><div class='ad'>Buy <b>now</b> {MORE}</div><p>{MORE}</p></article>"), f"{LONG}\n{MORE}"),
    "lists and links": (page(f"<article><p>{LONG}</p><ul><li>one<li><a href=/t>two</a></ul><blockquote>three</blockquote></article>"), f"{LONG}\none\ntwo\nthree"),
    "references": (page("<article><p>a&nbsp;b &lt;c&gt; &#233; &eacute; &quot;d&quot; &am &#x1F600;</p></article>"), 'a b <c> é é "d" &am 😀'),
    "hidden": (page(f"<article><p>{LONG}</p><p hidden>no</p><p style='display: none'>no</p><noscript>no</noscript><svg><text>no</text></svg></article>"), LONG),
    "short article": (page(f"<div class=ad>{MORE}</div><article><h1>Hi</h1><p>Ok</p></article><footer>{MORE}</footer>"), "Hi\nOk"),
    "declarations": (f"<![if IE]><![odd[x]]><?php x ?><!-- <p>{MORE}</p> --><p>{LONG}</p><![CDATA[z]]>", LONG),
    "only menus": (page("<nav>Home</nav><footer>us</footer>"), ""),
    "no markup": (LONG, LONG),
    "empty": ("", ""),
    "null": (None, ""),
    "unclosed tag": (page(f"<article><p>{LONG}</p></article>") + "<p", LONG),
    "two columns": (page(f"<table><tr><td class=menu><a href=/>x</a></td><td><p>{LONG}</p><p>{MORE}</p></td></tr></table>"), f"{LONG}\n{MORE}"),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    html, want = CASES[name]
    assert main_text(html) == want


def test_ratios_decide_without_names():
    """Pages whose tags and classes say nothing: long lines stay, link lists around them go."""
    r = random.Random(4)
    for _ in range(50):
        body = [" ".join(r.choice(["river", "stone", "light", "green", "open"]) for _ in range(r.randint(20, 80))) for _ in range(r.randint(3, 9))]
        menu = "".join(f"<div><a href=/{k}>go {k}</a></div>" for k in range(r.randint(4, 12)))
        html = page(f"<div class=x1>{menu}</div><div class=x2>{''.join(f'<div>{t}</div>' for t in body)}</div><div class=x3>{menu}</div>")
        assert main_text(html) == "\n".join(body)


def test_table(spark):
    rows = [(1, "u", CASES["plain article"][0], "x", 3), (1, "u", CASES["plain article"][0], "x", 3), (None, None, None, None, None), (2, "v", "", "x", 1), (9007199254740993, "w", page(f"<article>{'<p>' + LONG + '</p>' * 1}</article>" + "<div>" * 20000), "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    want = [main_text(r[2]) for r in rows]
    got = html_text.extract(df).collect()
    assert [(g["page_id"], g["url"], g["text"], g["n_chars"]) for g in got] == [(r[0], r[1], t, len(t)) for r, t in zip(rows, want)]
    assert html_text.extract(df.where("false")).count() == 0
