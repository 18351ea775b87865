"""Labelled pages: page layouts written down with the part of every block."""

from __future__ import annotations

import random

import numpy as np

from navspark.llm.html import Pages, Potentials, fit

_WORDS = "the of a river stone market letter morning old paper found under many small houses people went across long story about water light early road every voice".split()


def _sentence(rng: random.Random, low: int, high: int) -> str:
    words = [rng.choice(_WORDS) for _ in range(rng.randint(low, high))]
    return " ".join(words).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])


def _text(rng: random.Random, mark: str, long: bool = True) -> str:
    body = " ".join(_sentence(rng, 1, 14) for _ in range(rng.choice([1, 1, 2, 3, 6] if long else [1])))
    return f"{mark} {body}"


#: A block of text that starts with this mark is content, with the other is not; the marks are cut off when read.
YES, NO = "\u0001", "\u0002"


def _links(rng: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{i}">{_text(rng, NO, False)}</a></li>' for i in range(n))


def _outer(rng: random.Random) -> list[str]:
    """Blocks around the article, all of them no content."""
    t = lambda long=True: _text(rng, NO, long)
    blocks = [
        lambda: f"<nav><ul>{_links(rng, rng.randint(2, 8))}</ul></nav>",
        lambda: f'<div class="{rng.choice(["menu", "navbar", "main-nav", "breadcrumbs"])}"><ul>{_links(rng, rng.randint(2, 8))}</ul></div>',
        lambda: f"<header><h1>{t(False)}</h1><p>{t()}</p></header>",
        lambda: f'<div id="{rng.choice(["header", "masthead", "topbar"])}"><a href="/">{t(False)}</a><p>{t()}</p></div>',
        lambda: f'<div class="{rng.choice(["ad", "ads", "advert", "banner", "sponsored", "promo-box"])}">{t()}</div>',
        lambda: f'<div class="{rng.choice(["ad", "advertisement", "sponsor"])}"><p>{t()}</p><p>{t()}</p></div>',
        lambda: f'<aside><h3>{t(False)}</h3><p>{t()}</p><ul>{_links(rng, 4)}</ul></aside>',
        lambda: f'<div class="{rng.choice(["sidebar", "widget", "related", "right-rail"])}"><h2>{t(False)}</h2><p>{t()}</p></div>',
        lambda: f'<div class="{rng.choice(["cookie-notice", "consent", "notice", "newsletter", "popup", "alert"])}"><p>{t()}</p><button>{t(False)}</button></div>',
        lambda: f'<form action="/s"><label>{t(False)}</label><input name="q"><p>{t()}</p></form>',
        lambda: f'<div class="{rng.choice(["share", "social", "tags"])}"><a href="#">{t(False)}</a> <a href="#">{t(False)}</a></div>',
    ]
    return [b() for b in rng.sample(blocks, rng.randint(1, 5))]


def _after(rng: random.Random) -> list[str]:
    t = lambda long=True: _text(rng, NO, long)
    comment = lambda: f'<div class="comment"><p>{t()}</p><p>{t()}</p></div>'
    blocks = [
        lambda: f"<footer>{t()}</footer>",
        lambda: f"<footer><p>{t()}</p><ul>{_links(rng, 3)}</ul></footer>",
        lambda: f'<div id="{rng.choice(["footer", "copyright"])}"><p>{t()}</p></div>',
        lambda: f'<section class="comments"><h2>{t(False)}</h2>{comment()}{comment()}</section>',
        lambda: f'<div id="comments"><ol class="comment-list"><li class="comment"><p>{t()}</p></li><li class="comment">{t()}</li></ol></div>',
        lambda: f'<div class="discussion">{comment()}<form><p>{t()}</p></form></div>',
    ]
    return [b() for b in rng.sample(blocks, rng.randint(1, 3))]


def _article(rng: random.Random) -> str:
    t = lambda long=True: _text(rng, YES, long)
    parts = [f"<{h}>{t(False)}</{h}>" for h in ["h1"] * (rng.random() < 0.8)]
    for _ in range(rng.randint(1, 8)):
        kind = rng.random()
        if kind < 0.62:
            parts.append(f"<p>{t()}</p>")
        elif kind < 0.68:
            parts.append(f"<p><b>{t()}<br>")
        elif kind < 0.74:
            parts.append(f'<p>{t()} <a href="/x">{_sentence(rng, 1, 4)}</a> {_sentence(rng, 3, 9)}</p>')
        elif kind < 0.80:
            parts.append(f"<h2>{t(False)}</h2><p>{t()}</p>")
        elif kind < 0.84:
            parts.append(f"<ul><li>{t()}</li><li>{t()}</li></ul>")
        elif kind < 0.88:
            parts.append(f"<blockquote><p>{t()}</p></blockquote>")
        elif kind < 0.91:
            parts.append(f"<table><tr><td>{t(False)}</td><td>{t(False)}</td></tr></table>")
        elif kind < 0.93:
            parts.append(f"<div>{t()}</div>")
        elif kind < 0.95:
            parts.append(f'<p><a href="/x">{t(False)}</a></p>')
        else:
            parts.append(rng.choice([f'<div class="ad">{_text(rng, NO)}</div>', f"<aside><p>{_text(rng, NO)}</p></aside>", f'<div class="share"><a href="#">{_text(rng, NO, False)}</a></div>', f"<form><p>{_text(rng, NO)}</p></form>"]))
    return "".join(parts)


def _bare(rng: random.Random) -> str:
    """A page of nothing but its text."""
    t = lambda long=True: _text(rng, YES, long)
    return rng.choice([
        lambda: t(),
        lambda: t(),
        lambda: t() + "<br>" + _sentence(rng, 4, 12) + "<br><br>" + _sentence(rng, 4, 12),
        lambda: f"{YES} {_sentence(rng, 2, 8)}",
        lambda: f"{t(False)}<p>{t(False)}",
        lambda: f"<p>{YES} {' '.join(rng.choice(_WORDS) for _ in range(rng.randint(2, 9)))}</p>",
        lambda: "".join(f"<p>{t()}</p>" for _ in range(rng.randint(1, 5))),
        lambda: f"<h1>{t(False)}</h1>" + "".join(f"<p>{t()}</p>" for _ in range(rng.randint(1, 5))),
        lambda: f"<center><h2>{t(False)}</h2></center>{t()}<hr>{t()}<p>{t()}",
        lambda: "<pre>" + t() + "</pre>",
        lambda: "".join(f"<div>{t()}</div>" for _ in range(rng.randint(1, 5))),
        lambda: f"<div><div><div><p>{t()}</p><p>{t()}</p></div></div></div>",
        lambda: f"<ul><li>{t()}</li><li>{t()}</li></ul><p>{t()}</p>",
    ])()


def _plain_links(rng: random.Random, n: int, between: str = " | ") -> str:
    return NO + " " + between.join(f'<a href="/{i}">{_sentence(rng, 1, 3)}</a>' for i in range(n))


def _unnamed(rng: random.Random) -> str:
    """A page whose elements say nothing of their part: links, text, a closing line."""
    t = lambda long=True: _text(rng, YES, long)
    body = lambda: f"<h1>{t(False)}</h1>" * (rng.random() < 0.7) + "".join(f"<p>{t()}</p>" for _ in range(rng.randint(2, 6)))
    links, close = _plain_links(rng, rng.randint(3, 8)), f"{NO} Copyright {rng.randint(1996, 2024)} {_sentence(rng, 2, 5)} All rights reserved."
    listed = "<ul>" + _links(rng, rng.randint(3, 8)) + "</ul>"
    return rng.choice([
        lambda: f"<div>{links}</div><div>{body()}</div><div>{close}</div>",
        lambda: f"<div><div>{listed}</div><div><div>{body()}</div></div></div><div><p>{close}</p></div>",
        lambda: f"<table><tr><td>{links}</td></tr><tr><td>{body()}</td></tr><tr><td>{close}</td></tr></table>",
        lambda: f"<table width=100%><tr><td valign=top>{_plain_links(rng, 5, '<br>')}</td><td>{body()}</td></tr></table><center>{close}</center>",
        lambda: f"<table><tr><td>{listed}<td><div>{t()}</div><div>{t()}</div><div>{t()}</div></table>",
        lambda: f"<center>{links}</center><hr>{body()}<hr><center>{close}</center>",
        lambda: f"<div>{links}</div><div>{t()}<br><br>{_sentence(rng, 5, 14)}</div><div>{t()}</div><p>{_plain_links(rng, 3)}</p>",
        lambda: f"{links}{body()}<p>{_plain_links(rng, 4)}</p>",
    ])()


def _short(rng: random.Random) -> str:
    """A page of one to three paragraphs between blocks that are none of it."""
    t = lambda: f"{YES} {_sentence(rng, 4, 14)}"
    same = t()
    body = "".join(f"<p>{same if rng.random() < 0.4 else t()}</p>" for _ in range(rng.choice([1, 1, 1, 2, 2, 3])))
    if rng.random() < 0.2:
        body = f"<h1>{_text(rng, YES, False)}</h1>{body}"
    body = rng.choice(["{}", "{}", "<div>{}</div>", '<div class="content">{}</div>', '<div id="main">{}</div>', "<main>{}</main>", "<article>{}</article>"]).format(body)
    link = f'<nav><a href="/">{_text(rng, NO, False)}</a></nav>'
    before = rng.choice([link, link, link, f"<button>{_text(rng, NO, False)}</button>", "".join(_outer(rng)[:2]), ""])
    after = rng.choice([f"<footer>{_text(rng, NO, False)}</footer>", f"<footer>{_text(rng, NO, False)}</footer>", f"<footer><p>{_text(rng, NO)}</p></footer>", "".join(_after(rng)[:1]), ""])
    return before + body + after


def labelled(n: int = 400, seed: int = 1) -> list[str]:
    """Pages whose blocks of text start with their label's mark."""
    rng, out = random.Random(seed), []
    wrappers = ["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="main"><article class="post">{}</article></div>', '<main><div class="entry-content">{}</div></main>', '<section class="story">{}</section>', '<div class="post-body">{}</div>', "<div>{}</div>", "{}", '<div id="x1"><div class="col">{}</div></div>', "<section>{}</section>", "<table><tr><td>{}</td></tr></table>"]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2:
            body = _bare(rng)
        elif kind < 0.35:
            body = _unnamed(rng)
        elif kind < 0.55:
            body = _short(rng)
        else:
            inner = rng.choice(wrappers).format(_article(rng))
            body = "".join(_outer(rng)) + inner + "".join(_after(rng))
            if rng.random() < 0.3:
                body = f'<div class="{rng.choice(["wrapper", "page", "container"])}">{body}</div>'
        out.append(f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}</body></html>")
    return out


def train(pages: list[str] | None = None) -> Potentials:
    """Potentials from pages labelled by marks; an element is content if most of the text below it is."""
    trees = Pages()
    for page in labelled() if pages is None else pages:
        trees.add(page)
    n = len(trees.parent)
    yes, no = np.zeros(n), np.zeros(n)
    for k, (leaf, text) in enumerate(zip(trees.leaves, trees.texts)):
        (yes if text.startswith(YES) else no)[leaf] += len(text)
        trees.texts[k] = text.lstrip(YES + NO).strip() or "x"
    for i in range(n - 1, 0, -1):
        if trees.parent[i] >= 0:
            yes[trees.parent[i]] += yes[i]
            no[trees.parent[i]] += no[i]
    return fit(trees.arrays(), (yes > no).astype(np.int64))
