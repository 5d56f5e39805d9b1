"""Labelled pages from which the content model is trained.

Whole pages in common layouts, written for this purpose: `data-main="1"` marks the article,
`data-main="0"` what is not part of it inside. Texts are filler of the lengths such parts have.
"""

SENTENCE = ("The council met on Tuesday and agreed to widen the bridge before the winter, "
            "which had been asked for by people on both banks of the river. ")
SHORT = "A short remark. "

# Article bodies, as they stand inside whatever holds them.
BODIES = [
    f"<h1>The bridge is widened</h1><p>{SENTENCE * 2}</p><p>{SENTENCE}</p><p>{SHORT}</p>"
    f"<p>{SENTENCE * 4}</p>",
    f"<h1>Notes from the coast</h1><p><b>Notes from the coast<br><p>{SENTENCE}</p><p>Yes.</p>"
    f"<p>{SENTENCE * 3}</p><p>On.</p>",
    f"<h1>Bread</h1><p>{SHORT}</p>",
    "<h1>One line</h1><p><b>One line of text that has no end<br>",
    f"<h2>Method</h2><p>{SENTENCE}<a href='/x'>a source</a> says so.</p><ul><li>flour and salt</li>"
    f"<li>water</li><li>{SENTENCE}</li></ul><h3>Result</h3><p>{SENTENCE * 2}</p>"
    f"<blockquote><p>{SENTENCE}</p></blockquote>",
    f"<p>{SENTENCE * 5}</p><figure><img src=a.png><figcaption>The old mill</figcaption></figure>"
    f"<p>{SENTENCE * 2}</p><pre>x = 1\ny = 2</pre><p>{SENTENCE}</p>",
    f"<p>{SENTENCE}</p><table><tr><th>Year</th><th>Boats</th></tr><tr><td>1901</td><td>12</td></tr>"
    f"</table><p>{SENTENCE}</p><h4>Later</h4><p>{SHORT}</p><dl><dt>mill</dt><dd>{SENTENCE}</dd></dl>",
    f"<div><div>{SENTENCE * 2}</div><div>{SENTENCE}</div></div>",
    f"<section><h2>Part one</h2><p>{SENTENCE}</p></section><section><h2>Part two</h2>"
    f"<p>{SENTENCE}</p><p>{SHORT}</p></section>",
    f"<header><h1>A long walk</h1><p>{SHORT}</p></header><p>{SENTENCE * 2}</p>"
    f"<p><em>{SENTENCE}</em></p>",
    f"<h2>Soup</h2><ul><li>one leek</li><li>two potatoes</li><li>salt</li></ul><ol><li>{SENTENCE}</li>"
    f"<li>{SHORT}</li><li>{SENTENCE}</li></ol><p>{SENTENCE}</p><p>{SENTENCE}</p><p>{SHORT}</p>",
    f"<h1>Places</h1><p>{SENTENCE}</p><ul><li>The mill</li><li>The <b>old</b> bridge</li></ul>"
    f"<p>{SENTENCE}</p><ul><li>{SENTENCE}</li></ul><p>{SENTENCE}</p><p>{SENTENCE}</p>",
    f"<h1>Sources</h1><p>{SENTENCE}</p><p><a href='/m'>The book of the mill</a></p><p><a href='/l'>"
    f"The lock</a> and <a href='/n'>the canal</a></p><p>{SENTENCE}</p>",
]

# Parts inside or beside an article that do not belong to it.
ASIDES = [
    '<div class="ad">Buy two lamps and get one free today only.</div>',
    '<div class="ads advertisement"><p>Cheap flights to the islands, book before Friday night.</p></div>',
    '<div class="advert sponsored"><a href="/s">Our partner has an offer for you, see it here</a></div>',
    f'<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">One</a></li>'
    f'<li><a href="/2">Two</a></li></ul><p>{SENTENCE}</p></aside>',
    '<div class="related-posts recommended"><h3>Read more</h3><ul><li><a href="/a">The mill</a></li>'
    '<li><a href="/b">The lock keeper of the north canal</a></li></ul></div>',
    '<div class="share social"><a href="/f">Share</a> <a href="/t">Post</a></div>',
    '<form action="/n" class="newsletter subscribe"><p>Get our letter every week.</p>'
    '<label>Mail</label><input name=m><button>Send</button></form>',
    '<div class="promo banner"><p>Join now and save half of the price in your first year.</p></div>',
    f'<div class="notice"><p>{SENTENCE}</p></div>',
    '<p class="ad">Lamps for every room, now with free delivery.</p>',
    f'<aside><p>{SENTENCE}</p></aside>',
    '<form><p>Search the site</p><label>Words</label><input></form>',
    '<div class="widget popular"><h4>Popular now</h4><p>The mill, the bridge and the lock.</p></div>',
    '<div class="tags meta"><a href="/t/river">river</a> <a href="/t/bridge">bridge</a></div>',
]

COMMENTS = [
    f'<section class="comments" id="comments"><h2>2 comments</h2><div class="comment"><p>{SENTENCE}'
    f'</p></div><div class="comment"><b>Ann</b><p>I was there too.</p></div></section>',
    f'<div id="comments"><ul><li class="comment"><p>{SENTENCE * 2}</p></li><li class="comment reply">'
    f'<p>{SENTENCE}</p></li></ul></div>',
    f'<div class="reader-comments discussion"><article class="comment"><p>{SENTENCE}</p></article>'
    f'<article class="comment"><p>{SHORT}</p></article></div>',
    f'<section class="comments"><h3>Comments</h3><p>{SENTENCE}</p><p>{SHORT}</p></section>',
    f'<div class="comments"><p>{SENTENCE}</p><p>{SENTENCE * 2}</p></div>',
    f'<ol class="commentlist responses"><li><p>{SENTENCE}</p></li><li><p>{SHORT}</p></li></ol>',
]

TOPS = [
    '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About us'
    '</a></li></ul></nav>',
    '<header class="site-header"><div class="logo">The Paper</div><nav class="menu"><a href="/">Home'
    '</a> <a href="/w">World</a></nav></header>',
    '<header><h1>The Evening Paper</h1><p>News from the river since 1901, every day.</p></header>',
    '<div id="header" class="masthead"><h2>River news</h2><ul class="nav navbar menu"><li>'
    '<a href="/1">First</a></li><li><a href="/2">Second</a></li></ul></div>',
    '<div class="cookie-notice consent"><p>We use cookies to make this site better for you.</p>'
    '<button>Fine</button></div>',
    '<div class="breadcrumb"><a href="/">Home</a> <a href="/n">News</a> Bridge</div>',
    '<div class="alert notice" role="alert"><p>The site is closed for repair on Sunday night.</p></div>',
    '<div role="banner"><p>The Paper</p></div><div role="navigation"><a href="/x">Sport</a></div>',
    '<div class="topbar login"><form><input><p>Sign in</p></form></div>',
    '<div class="cookie-banner">This site keeps cookies. <a href="/p">Read how</a>.</div>',
]

BOTTOMS = [
    "<footer>&copy; the paper &middot; The keeper of the mill has the last word here.</footer>",
    '<footer class="site-footer"><p>All rights reserved.</p><ul><li><a href="/p">Privacy</a></li>'
    '<li><a href="/t">Terms</a></li></ul></footer>',
    '<div id="footer" class="footer bottom"><p>Copyright, the paper and its people, since 1901.</p></div>',
    '<div class="pagination pager"><a href="/1">1</a> <a href="/2">2</a> <a href="/3">Next</a></div>',
    '<div role="contentinfo"><p>Written by the river.</p></div>',
    '<div hidden><p>Text that is not shown to any reader of the page.</p></div>',
    '<div class="popup modal overlay"><p>Wait, do not go yet, there is more to read.</p></div>',
]

# What holds the article: opening and closing tags.
HOLDERS = [
    ("<article>", "</article>"),
    ("<main>", "</main>"),
    ('<main id="main"><article class="post">', "</article></main>"),
    ('<div class="post-content entry">', "</div>"),
    ('<div id="content" class="content">', "</div>"),
    ('<div class="article-body story">', "</div>"),
    ('<section class="article text">', "</section>"),
    ('<div role="main" itemprop="articleBody">', "</div>"),
]


def _marked(html: str, state: str) -> str:
    """The part with its first tag marked."""
    end = next(i for i, c in enumerate(html) if c in " >")
    return f'{html[:end]} data-main="{state}"{html[end:]}'


def labelled_pages() -> list[str]:
    """Every body, holder and part in turn, so that each occurs in several pages."""
    pages = []
    for i in range(390):
        body = BODIES[i % len(BODIES)]
        opening, closing = HOLDERS[(i // 3) % len(HOLDERS)]
        aside = _marked(ASIDES[i % len(ASIDES)], "0")
        other = _marked(ASIDES[(i * 5 + 3) % len(ASIDES)], "0")
        comments = _marked(COMMENTS[(i // 2) % len(COMMENTS)], "0")
        top = "".join(_marked(TOPS[(i + k) % len(TOPS)], "0") for k in range(1 + i % 2))
        bottom = _marked(BOTTOMS[i % len(BOTTOMS)], "0")
        # inside the article: nothing, a part in its middle, comments at its end
        if i % 3 == 1 and "</p><p>" in body:
            body = body.replace("</p><p>", f"</p>{aside}<p>", 1)
        if i % 6 == 2:
            body += comments
        article = _marked(opening, "1") + body + closing
        if i % 4 == 0:
            article = f"<div class='wrapper container'>{other}{article}</div>"
        page = top + (aside if i % 2 else "") + article + (comments if i % 5 == 1 else "") + bottom
        pages.append(f"<html><head><title>t</title></head><body>{page}</body></html>")
    return pages
