"""Main text of pages put together from known parts: the output has to equal the article, no more and no less."""

import random

import pytest

from tidemark.llm.op4_html import main_text

PARA = "Some words that make a paragraph of text, quite long."
BLOCK = f"<p>{PARA}</p>" * 3
HEAD = f"<h1>Head line here</h1>{BLOCK}"
WANT = ["Head line here", PARA, PARA, PARA]
LONG = " ".join(f"word{i}" for i in range(40))


@pytest.mark.parametrize("name", ["class='sharing-economy'", "id='social-history'", "class='banner-year report'", "class='commenting-laws'", "id=newsletter-origins"])
@pytest.mark.parametrize("tag", ["section", "div"])
@pytest.mark.parametrize("holder", ["article", "main", "div"])
def test_a_word_of_a_class_drops_no_dense_block(name, tag, holder):
    assert main_text(f"<body><{holder}>{HEAD}<{tag} {name}><p>{LONG}</p></{tag}></{holder}><footer>x</footer>") == "\n\n".join([*WANT, LONG])


@pytest.mark.parametrize("name", ["reader-reactions", "discussion", "comments", "post-comments list", "comment-list", "reader-responses", "ad-slot", "main-sidebar", "cookie-notice-box", "related-stories"])
@pytest.mark.parametrize("inside", [True, False])
def test_whole_words_of_a_class_drop_dense_blocks_too(name, inside):
    other = f"<div class='{name}'><p>{LONG}</p><p>{LONG}</p></div>"
    page = f"<body><article>{HEAD}{other}</article>" if inside else f"<body><div class=story>{HEAD}</div>{other}"
    assert main_text(page) == "\n\n".join(WANT)


def test_article_bounds_what_says_nothing_of_itself():
    for other in (f"<div><h3>About us</h3><p>{LONG}</p></div>", f"<div class=right-col><p>{LONG}</p><p>{LONG}</p></div>", f"<section><p>{LONG}</p></section>", f"<p>{LONG}</p>", LONG):
        for tag in ("article", "main"):
            assert main_text(f"<body><{tag}>{HEAD}</{tag}>{other}") == "\n\n".join(WANT), other
            assert main_text(f"<body>{other}<{tag}>{HEAD}</{tag}>") == "\n\n".join(WANT), other
    assert main_text(f"<body><h1>Head line here</h1><div>Share</div><article>{BLOCK}</article><div><p>{LONG}</p></div>") == "\n\n".join(WANT)
    assert main_text(f"<body><article>{HEAD}<section id=comments><article><p>{LONG}</p></article></section></article>") == "\n\n".join(WANT)
    assert main_text(f"<body><article>{HEAD}<section id=discussion><p>{LONG}</p></section></article>") == "\n\n".join([*WANT, LONG])


def test_siblings_of_another_class_are_no_content():
    assert main_text(f"<body><div class=story>{HEAD}</div><div class=right-col><p>Short words</p></div>") == "\n\n".join(WANT)
    assert main_text(f"<body><div class=a><p>{LONG}</p></div><div class=a><p>{LONG}</p><p>Of.</p></div><div class=a><p>Of.</p></div>") == "\n\n".join([LONG, LONG, "Of.", "Of."])
    assert main_text(f"<body><main>{HEAD}<div class='td-social-sharing-bar'><a href=a>Tweet</a><a href=b>Mail</a></div></main>") == "\n\n".join(WANT)


def test_pages_put_together_at_random():
    """Articles of sections, lists, tables and odd class names, between and around what is not the article."""
    for seed in range(300):
        rng = random.Random(seed)
        say = lambda least, most, k=rng: " ".join(f"w{k.randrange(400)}" for _ in range(k.randrange(least, most)))
        want, body = [], ""

        def block(tag, least=5, most=60):
            nonlocal body
            text = say(least, most)
            want.append(text)
            first, *rest = text.split(" ")
            body += f"<{tag}>{rng.choice((text, f'<b>{first}</b> ' + ' '.join(rest) if rest else text, text.replace(' ', chr(10), 1)))}</{tag}>"

        block("h1", 3, 9)
        for _ in range(rng.randrange(1, 6)):
            name = rng.choice(["", " class=sharing-economy", " id=social-history", " class='part two'"])
            body += f"<section{name}>"
            block("h2", 2, 6)
            for _ in range(rng.randrange(1, 4)):
                block("p", 40 if "-" in name else 5)
            body += "</section>" + rng.choice(["", f"<div class=ad>{say(5, 30)}</div>", f"<aside><p>{say(20, 60)}</p></aside>", "<script>x('</p>')</script>"])
        body += rng.choice(["", f"<div class=reader-reactions>{''.join(f'<p>{say(10, 80)}</p>' for _ in range(4))}</div>", f"<form><label>Say</label><p>{say(3, 9)}</p></form>"])
        tag = rng.choice(["article", "main"])
        before = rng.choice(["", f"<header><h1>Site</h1></header><nav><a href=a>{say(1, 3)}</a></nav>", f"<div class=cookie-notice>{say(10, 50)}</div>"])
        after = rng.choice(["", f"<div><p>{say(10, 70)}</p></div>", f"<div class=discussion><p>{say(10, 70)}</p></div>", f"<footer>{say(3, 20)}</footer>"])
        assert main_text(f"<html><body>{before}<{tag}>{body}</{tag}>{after}</body></html>") == "\n\n".join(want), seed
