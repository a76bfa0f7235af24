"""Main text of generated pages against the text they were made from, and the distribution against all windows."""

from __future__ import annotations

import random
import time

import pytest

from fathomline.llm import html_text

PROSE = "This paragraph of prose is long enough to be taken for text, {} times over."
#: Parts of a page that are no article.
BESIDE = (
    "<nav><ul><li><a href='/{0}'>menu {0}</a></li></ul></nav>",
    "<header><h1>Site {0}</h1><p>A header with quite a lot of text in it that goes on and on.</p></header>",
    "<div class='cookie-notice'>We use cookies {0} and tell of it in a rather long notice.</div>",
    "<aside><p>Aside {0}, which is a sidebar with more than a few words of its own text.</p></aside>",
    "<div id=sidebar-{0}><p>Sidebar text that would surge as well as any other text of the page.</p></div>",
    "<form><label>Name {0}</label><input><button>Send</button></form>",
    "<script>var a = '<p>no {0}</p>';</script><style>p {{ margin: 0 }}</style><!-- <p>no {0}</p> -->",
    "<section class='comments'><article class=comment><p>Reader {0} says that this comment is no part of it.</p></article></section>",
    "<footer>&copy; {0} all of it</footer>",
    "<div class=ad>Buy {0} now</div>",
)
INSIDE = ("<div class='ad'>Buy {0}</div>", "<!-- {0} -->", "<aside>more {0}</aside>", "<form><input>{0}</form>", "<script>{0}</script>", "<p class='share'>Share {0}</p>")


def made(rng: random.Random, framed: bool) -> tuple[str, str]:
    """(html, main text)."""
    body, words = [], []
    for k in range(rng.randint(2, 8)):
        kind = rng.choice(["p", "p", "p", "li", "h2", "div", "quote"])
        n = rng.choice([1, 2, 5]) if framed else 3
        text = " ".join(PROSE.format(rng.randint(0, 99)) for _ in range(n)) if rng.random() < 0.7 or (not framed and k == 0) else "Short " + str(k)
        words.append(text)
        marked = text.replace("prose", "<b>prose</b>").replace(",", "&#44;").replace(" times", "\n   times")
        shape = {"p": "<p>{}</p>", "li": "<ul><li>{}</ul>", "h2": "<h2>{}</h2>", "div": "<div>{}</div>", "quote": "<blockquote>{}</blockquote>"}[kind]
        body.append(shape.format(marked))
        if rng.random() < 0.3:
            body.append(rng.choice(INSIDE).format(k))
    beside = [rng.choice(BESIDE).format(rng.randint(0, 9)) for _ in range(rng.randint(0, 6))]
    cut = rng.randint(0, len(beside))
    main = f"<article>{''.join(body)}</article>" if framed else f"<div class=content>{''.join(body)}</div>"
    return f"<html><head><title>no</title></head><body>{''.join(beside[:cut])}{main}{''.join(beside[cut:])}</body></html>", " ".join(words)


@pytest.mark.parametrize("framed", [True, False])
def test_generated_pages_give_their_text(framed):
    rng = random.Random(8)
    for _ in range(300):
        html, want = made(rng, framed)
        assert html_text.main_text(html) == want, html


def test_runs_have_the_highest_of_all_windows():
    rng = random.Random(2)
    for _ in range(300):
        lines = [html_text.Line("x" * rng.randint(1, 9), rng.choice([0, 0, 99]), 0, False, rng.choice([0, 0, 1, 2, 4])) for _ in range(rng.randint(0, 25))]
        flat: list[tuple[int, int | None]] = []  # weight, line
        for i, line in enumerate(lines):
            flat += [(0, None)] * line.gap + [(0 if line.links else len(line.text), i)]
        flat += [(0, None)] * html_text.WINDOW
        want, run = [], []
        for k, (weight, i) in enumerate(flat):
            if weight:
                run.append(k)
            if run and not sum(w for w, _ in flat[k : k + html_text.WINDOW]):
                # a window whose first line is the last of weight isn't empty
                highest = max(sum(w for w, _ in flat[j : j + html_text.WINDOW]) for j in range(run[0], run[-1] + 1))
                want.append(([i for _, i in flat[run[0] : run[-1] + 1] if i is not None], highest))
                run = []
        got = list(html_text._runs(lines))
        assert [[line.text for line in run] for run, _ in got] == [[lines[i].text for i in run] for run, _ in want]
        assert [high for _, high in got] == [high for _, high in want]


def test_wrappers_forms_and_teasers():
    text = " ".join(PROSE.format(k) for k in range(6))
    assert html_text.main_text(f"<body><form><h1>Top</h1><p>{text}</p></form>") == f"Top {text}"
    assert html_text.main_text(f"<div class='related-content'><p>{text}</p></div>") == text
    assert html_text.main_text(f"<div class='sidebar-left page'><article><p>{text}</p></article></div>") == text
    assert html_text.main_text(f"<p>{text}</p><p>Bye</p>") == f"{text} Bye"
    cards = "<article>One card</article><article>Another card</article>"
    assert text in html_text.main_text(f"<div><p>{text}</p><ul><li>Two eggs</ul></div>{cards}") and "Two eggs" in html_text.main_text(f"<div><p>{text}</p><ul><li>Two eggs</ul></div>{cards}")
    assert html_text.main_text("<nav><a>x</a></nav><div class=cookie-consent>" + text + "</div>") == ""
    assert html_text.main_text(f"<article><p>{text}</p><div><div><div>ok</div></div></div><p>End</p></article>") == f"{text} ok End"


@pytest.mark.parametrize("shape", ["<div>|</b>", "<i class=a>|<div></div>", "<div class=ad>|</p>", "<form>|<article>x</article>", "<p>|<b id=x>", "x |<"])
def test_time_is_linear_in_the_page(shape):
    first, second = shape.split("|")
    taken = []
    for n in (4_000, 16_000):
        begun = time.process_time()
        html_text.main_text(first * n + second * n)
        taken.append(time.process_time() - begun)
    assert taken[1] < 10 * taken[0] + 0.5
