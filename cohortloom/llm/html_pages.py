"""Labelled pages that the page model is trained on.

Fixed values: layouts with places for words. An attribute ``main`` marks elements whose blocks are article text, ``rest``
marks others inside them. {W} stands for one to four words, {S} for a sentence, {P} for a paragraph, {L} for a list of links, {T} for a
short text of one sentence or less.
"""

from __future__ import annotations

import random
import re

LAYOUTS = [
    '<html><head><title>{W}</title><script>var a="</p>";</script></head><body><nav><ul>{L}</ul></nav><div class="ad">{T}</div><article main><h1>{W}</h1><p>{S}<p>{P}</p><p>{T}</p><p>{P}</p></article><footer>&copy; {W} &middot; {S} {T}</footer></body></html>',
    '<html><body><nav><ul>{L}</ul></nav><div class="ad">{S}</div><article main><h1>{T}</h1><p><b>{T}<br></article><footer>&copy; {W} &middot; {S}</footer></body></html>',
    '<body><header><div class="logo">{W}</div><nav><a href="/">{W}</a> <a href="/a">{W}</a></nav></header><div class="cookie-notice"><p>{S}</p><button>{W}</button></div><main><article main><header><h1>{W}</h1></header><p>{P}</p><p>{S}</p><aside rest class="related"><h3>{W}</h3><ul>{L}</ul></aside><p>{P}</p></article><section id="comments" class="comments"><h2>{W}</h2><div class="comment"><p>{S}</p></div><div class="comment"><p>{P}</p></div><form><label>{W}</label><textarea></textarea></form></section></main><aside class="sidebar"><h3>{W}</h3><ul>{L}</ul><p>{S}</p></aside><footer><p>{S}</p></footer></body>',
    '<body><div id="header"><a href="/">{W}</a></div><div id="menu"><ul>{L}</ul></div><div id="content"><div class="post" main><h2>{W}</h2><p>{P}</p><p>{P}</p><blockquote>{S}</blockquote><p>{T}</p></div><div class="share"><a href="/s">{W}</a><a href="/t">{W}</a></div></div><div id="sidebar"><div class="widget"><h4>{W}</h4><p>{S}</p></div><div class="advert">{P}</div></div><div id="footer"><p>{T}</p><ul>{L}</ul></div></body>',
    '<body><div class="navbar">{L}</div><div class="container"><div class="row"><div class="col-8 entry-content" main><h1>{W}</h1><p>{P}</p><ul><li>{S}</li><li>{S}</li><li>{T}</li></ul><p>{S}</p><div rest class="ad-banner"><p>{S}</p></div><p>{P}</p></div><div class="col-4 side"><div class="promo">{P}</div><form class="newsletter"><p>{S}</p><input></form></div></div></div><div class="footer-bottom">{S}</div></body>',
    '<body><table><tr><td class="nav"><ul>{L}</ul></td><td class="text" main><h1>{W}</h1><p>{P}</p>{P}<br>{S}<p>{T}</p></td></tr></table><div class="copyright">&copy; {T}</div></body>',
    '<body><div class="banner notice">{S}</div><header><h1>{W}</h1><p class="tagline">{T}</p></header><section class="article-body" main><p>{P}</p><figure><img><figcaption>{T}</figcaption></figure><p>{P}</p><h2>{W}</h2><p>{S}</p><pre>{S}</pre></section><section class="related-posts"><h3>{W}</h3><div><a href="/r">{S}</a></div><div><a href="/q">{S}</a></div></section><div id="disqus_thread"><div class="reply"><p>{S}</p></div></div><footer class="site-footer"><div>{T}</div></footer></body>',
    '<body><div role="navigation">{L}</div><div role="main" main><h1>{W}</h1><div>{P}</div><div>{P}</div><div>{T}</div></div><div role="complementary"><p>{S}</p></div><div role="contentinfo"><p>{S}</p></div></body>',
    '<body><nav>{L}</nav><main main><h1>{W}</h1><p>{P}</p><table><tr><th>{W}</th><th>{W}</th></tr><tr><td>{T}</td><td>{W}</td></tr></table><p>{P}</p><div rest class="advertisement"><p>{S}</p></div><dl><dt>{W}</dt><dd>{S}</dd></dl></main><div class="modal popup"><p>{S}</p></div><footer>{T}</footer></body>',
    '<body><div class="breadcrumbs"><a href="/">{W}</a> &gt; <a href="/b">{W}</a></div><article main><h1>{W}</h1><p>{T}</p><p>{T}</p><p>{T}</p></article><div class="sponsored"><p>{P}</p></div><ul class="menu">{L}</ul><div class="subscribe"><form><p>{S}</p></form></div><div class="comment-list"><ol><li class="comment"><p>{S}</p></li><li class="comment"><p>{T}</p></li></ol></div></body>',
    '<body main><p>{P}</p><p>{P}</p><h2>{W}</h2><p>{S}</p></body>',
    '<body><div main>{P}</div><div class="ads"><p>{S}</p></div></body>',
    '<body><header><nav><ul>{L}</ul></nav></header><div class="alert warning">{S}</div><article main><h1>{W}</h1><section><h2>{W}</h2><p>{P}</p></section><section><h2>{W}</h2><p>{P}</p><div rest class="ad">{S}</div><ol><li>{S}</li><li>{S}</li></ol></section></article><aside><p>{P}</p></aside><footer><p>{S}</p><nav><ul>{L}</ul></nav></footer></body>',
    '<body><div class="topbar">{T}</div><div class="page"><div class="story" main><p>{S}</p><p>{S}</p><p>{S}</p><p>{S}</p></div><div class="tags"><a href="/t">{W}</a><a href="/u">{W}</a></div><div class="author-bio"><p>{S}</p></div></div></body>',
]


def _words(rng: random.Random, least: int, most: int) -> str:
    parts = ["la", "mo", "ti", "ren", "sa", "ko", "er", "un", "de", "pi", "no", "gra", "el", "vi", "ber"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(least, most)))


def _sentence(rng: random.Random, least: int = 6, most: int = 22) -> str:
    return _words(rng, least, most).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])


def _filled(layout: str, rng: random.Random) -> str:
    def put(match: re.Match) -> str:
        kind = match[1]
        if kind == "W":
            return _words(rng, 1, 4)
        if kind == "S":
            return _sentence(rng)
        if kind == "T":
            return _sentence(rng, 1, 10)
        if kind == "L":
            return "".join(f'<li><a href="/{k}">{_words(rng, 1, 2)}</a></li>' for k in range(rng.randint(2, 8)))
        return " ".join(_sentence(rng) for _ in range(rng.randint(2, 7)))

    return re.sub(r"\{([WSTLP])\}", put, layout)


def labelled_pages(copies: int = 12, seed: int = 7) -> list[str]:
    """``copies`` fillings of every layout."""
    rng = random.Random(seed)
    return [_filled(layout, rng) for layout in LAYOUTS for _ in range(copies)]
