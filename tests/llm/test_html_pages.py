"""Hand-made pages with their main text, broken markup, and time on hostile pages."""

import random
import time

import pytest

from lattica.llm.html_text import extract

A = "The river had risen in the night and by the morning it was over the road that leads to the mill, so that none of us could get to work. " * 2
B = "We waited on the hill with the others and watched the water as it carried away the fences and the hay that was left in the fields. " * 2
A, B = A.strip(), B.strip()
MENU = "<ul><li><a href=/>Home</a><li><a href=/n>News</a><li><a href=/c>Contact us</a></ul>"

PAGES = {
    "article with menu and footer": (f"<html><head><title>t</title></head><body><nav>{MENU}</nav><article><h1>Flood</h1><p>{A}</p></article><footer>© x</footer></body></html>", ["Flood", A]),
    "main, no article": (f"<body><header><h1>Site</h1></header><main><p>{A}</p><p>{B}</p></main></body>", [A, B]),
    "plain body": (f"<body>{MENU}<div>{A}</div><div>{B}</div><div><a href=/x>Read more about it here</a></div></body>", [A, B]),
    "heading between paragraphs": (f"<body><p>{A}</p><h2>Later</h2><p>{B}</p></body>", [A, "Later", B]),
    "caption nearer to the menu": (f"<body><div>{MENU}</div><div>Log in here</div><div><a href=/a>All the latest stories of the day</a></div><p>{A}</p></body>", [A]),
    "short line nearer to the text": (f"<body><p>{A}</p><p>So it was.</p><div>x</div><div><a href=/a>All the latest stories of the day</a></div></body>", [A, "So it was."]),
    "short line equally near": (f"<body><p>{A}</p><p>So it was.</p><div><a href=/a>All the latest stories of the day</a></div></body>", [A]),
    "comments": (f"<article><p>{A}</p><div class='comment-list'><p>{B}</p></div></article>", [A]),
    "reply form": (f"<article><p>{A}</p></article><form><p>{B}</p></form>", [A]),
    "page in a form": (f"<body><form id=aspnet><div>{A}</div><div>{B}</div></form></body>", [A, B]),
    "article in a form": (f"<form><nav>{MENU}</nav><article><p>{A}</p></article></form>", [A]),
    "advert inside": (f"<article><p>{A}</p><div class=advert><p>{B}</p></div><p>End.</p></article>", [A, "End."]),
    "hidden": (f"<main><p hidden>{B}</p><p style='display: none'>{B}</p><p aria-hidden=true>x</p><p>{A}</p></main>", [A]),
    "cookie notice": (f"<div id=cookieBanner>{B}</div><article>{A}</article>", [A]),
    "sidebar": (f"<article><p>{A}</p></article><aside><p>{B}</p></aside>", [A]),
    "table of text": (f"<main><table><tr><td>one</td><td>two</td></tr></table><p>{A}</p></main>", ["one", "two", A]),
    "list": ("<article><ul><li>first<li>second <b>bold</b><li>third</ul></article>", ["first", "second bold", "third"]),
    "references and space": ("<article><p>a&nbsp;b &lt;tag&gt; &#8364; &amp;amp;\n\t c</p></article>", ["a b <tag> € &amp; c"]),
    "script and style": ("<article><script>if (a < b) document.write('<p>no</p>')</script><style>p > a {}</style><p>yes</p></article>", ["yes"]),
    "nested boilerplate": (f"<article><section class=related><div><div><p>{B}</p></div></div></section><p>{A}</p></article>", [A]),
    "breaks": ("<article>one<br>two<br><br>three</article>", ["one two", "three"]),
    "two articles": (f"<article><p>{A}</p></article><div class=promo>x</div><article><p>{B}</p></article>", [A, B]),
    "bare apostrophe": ("<article><p title=it's>it's here</p><p>don't stop</p></article>", ["it's here", "don't stop"]),
    "quote never closed": ("<article><p>one</p><p title=\"x>two</p><p>three</p></article>", ["one", "two", "three"]),
    "attribute without value": ("<article><p ' data-x=1>one</p><p \">two</p></article>", ["one", "two"]),
    "greater-than in a value": ("<article><p title='a > b'>one</p></article>", ["one"]),
    "select never closed": ("<article><select><option>a<p>text after it</p></article>", ["a", "text after it"]),
    "button around an article": ("<button>Go <article><p>text</p></article> <button>No</button>", ["text"]),
    "unclosed inline": ("<article><p><b>one<div>two</b> three</div><p>four</article>", ["one", "two three", "four"]),
    "stray ends": ("</div></article><article></span><p>one</p></div></article>", ["one"]),
    "unclosed comment": ("<article><p>one</p><!-- <p>two</p></article>", ["one"]),
    "tag without end": ("<article><p>one</p><p class='x", ["one"]),
    "less-than signs": ("<article><p>1 < 2 and 3 <4</p></article>", ["1 < 2 and 3 <4"]),
}


RUSSIAN = ["Ночью река поднялась, и к утру вода стояла над дорогой, которая ведёт к мельнице, так что никто из нас не мог попасть на работу. " * 2, "Мы ждали на холме вместе с другими и смотрели, как вода уносит заборы и сено, оставленное в полях до самой осени этого года. " * 2]
CHINESE = ["夜里河水上涨，到了早晨已经漫过通往磨坊的道路，我们谁也没有办法去上班，只好在山坡上等待消息。" * 2, "我们和其他人一起站在山上，看着大水冲走了篱笆和留在田里的干草，直到傍晚雨才慢慢停了下来。" * 2]
RUSSIAN = [t.strip() for t in RUSSIAN]
PAGES |= {
    "another language, no article": (f"<body>{MENU}<div>{RUSSIAN[0]}</div><div>{RUSSIAN[1]}</div><div><a href=/x>Читать дальше обо всём этом</a></div></body>", RUSSIAN),
    "ideographs, no article": (f"<body>{MENU}<div>{CHINESE[0]}</div><div>{CHINESE[1]}</div></body>", CHINESE),
    "another language in an article": (f"<nav>{MENU}</nav><article><h1>水</h1><p>{CHINESE[0]}</p></article><div>{CHINESE[1]}</div>", ["水", CHINESE[0]]),
    "teaser article beside the main text": (f"<body>{MENU}<div>{A}</div><div>{B}</div><article>Read next</article></body>", [A, B]),
    "article longer than the text beside it": (f"<body><div>{B}</div><article><p>{A}</p><p>{B} {A}</p></article></body>", [A, f"{B} {A}"]),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, want = PAGES[name]
    assert extract(page) == want


@pytest.mark.parametrize("page", ['<a ' * 400_000, "<!-- " * 300_000, '<p title="x ' * 100_000, "<select><b>" * 100_000, "<div hidden><span class=ad>" * 50_000, "</div>" * 200_000, "<article>" + "<p>one two three four " * 250_000, "<" * 1_000_000, "<a='" * 300_000])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    extract(page)
    assert time.process_time() - began < 5


def test_random_markup_never_fails():
    rng = random.Random(7)
    bits = ["<p>", "</p>", "<article>", "</article>", "<form>", "</form>", "<li", ">", "'", '"', "=", " a", "text ", "<!--", "-->", "<script>", "</script>", "<select>", "</select>", "<br>", "&amp;", "<", "/", "<b>", "</b>", "<nav>", "</nav>", "<body>", "<head>", "é"]
    for _ in range(3000):
        out = extract("".join(rng.choices(bits, k=rng.randint(0, 40))))
        assert all(b and b == " ".join(b.split()) for b in out)
