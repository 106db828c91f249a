"""Labelled pages that the costs of html_text are fitted on.

Hand-made: each page is a string of HTML in which the text of a content block begins with a plus sign, and all other text is
boilerplate. The fit reads nothing else, so its size is bounded by this list.
"""

from __future__ import annotations

_P = (
    "The river rose for three days, and on the fourth the lower bridge was closed to all traffic.",
    "Nobody in the village could remember a spring like it, although the older records mention two floods in one decade.",
    "Engineers from the county measured the banks, drew up a plan and asked the council for time to carry it out.",
    "When the water fell at last, it left behind a layer of fine sand that the farmers later called a gift.",
    "Mix the flour with the butter, add the eggs one at a time, and let the dough rest in a cool place for an hour.",
    "The second edition corrects the tables of the first and adds a chapter on the measurement of small distances.",
    "She had walked along this road every morning, but the house at its end she had never seen before.",
    "In 1998 the society moved to its present rooms, where the library is open to members and their guests.",
)
_NAV = '<nav><ul><li><a href="/">Home</a><li><a href="/news">News</a><li><a href="/about">About us</a></ul></nav>'
_LIST = '<ul><li><a href="/1">Bridge closed until May</a></li><li><a href="/2">Council votes on budget</a></li><li><a href="/3">Ten walks for the autumn</a></li></ul>'
_TALK = '<div class="{0}"><p class="who">Anna, 2 days ago</p><p>I lived there as a child and I remember the old bridge very well, thank you for this.</p><p>Reply</p></div>'


def _p(*numbers: int) -> str:
    return "".join(f"<p>+{_P[k]}</p>" for k in numbers)


PAGES = (
    f"<body>{_NAV}<article><h1>+The flood</h1>{_p(0, 1)}<p>+So it was.</p>{_p(2)}</article><footer>All rights reserved.</footer></body>",
    f'<body class="home has-sidebar"><header><h2>The Daily Post</h2></header><main><h1>+Dough for beginners</h1>{_p(4)}<ul><li>+two eggs</li><li>+a pound of flour</li></ul>{_p(3)}</main><aside>{_LIST}</aside></body>',
    f'<div id="menu"><a href="/">Start</a> <a href="/x">Shop</a></div><div id="content"><h1>+A house</h1>{_p(6, 1)}<p>+No.</p>{_p(3)}</div><div class="footer">Imprint and contact</div>',
    f'<div id="page"><div class="topnav"><a href="/">Home</a></div><div class="post"><h2>+Second edition</h2>{_p(5, 7)}</div><div id="comments"><h3>2 comments</h3>{_TALK.format("comment")}{_TALK.format("comment")}</div></div>',
    f'<article class="post comments-open"><h1>+Rooms</h1>{_p(7, 5)}<div class="comments">{_TALK.format("comment")}</div></article><div class="related"><h3>Read also</h3>{_LIST}</div>',
    f'<main><div class="entry"><h1>+Sand</h1>{_p(3)}<div class="ad">The best boots for wet weather are sold here, said all who bought them.</div>{_p(2, 0)}</div></main><div class="cookie-banner"><p>We use cookies to make this site better for you. By going on you agree.</p><button>OK</button></div>',
    f'<table><tr><td class="leftcol"><a href="/a">Archive</a><br><a href="/b">Links</a></td><td>{_p(1)}{_p(2)}<p>+That was all.</p></td></tr></table><p>Copyright 2004</p>',
    f'<div><div><a href="/">Blog</a></div><div><h1>+Walking</h1>{_p(6)}<blockquote>+{_P[3]}</blockquote><p>+And then?</p>{_p(0)}</div><div><a href="/older">Older</a> <a href="/newer">Newer</a></div></div>',
    f'<body><div class="newsletter"><p>Subscribe to our letter and read the news before all others do.</p></div><div class="story"><h1>+The plan</h1>{_p(2, 0, 1)}</div><div class="user-posts"><p>Tom wrote:</p><p>I do not believe a word of this, but it is well told.</p></div></body>',
    f'<form id="aspnetForm"><div class="head">{_NAV}</div><article>{_p(5, 7, 2)}</article><div class="foot"><p>Printed on recycled screens.</p></div></form>',
    f'<article><header><h1>+Measures</h1></header>{_p(5)}<figure><img src="x"><figcaption>+The old gauge at the bridge.</figcaption></figure>{_p(0)}<div class="share">Share this</div><div class="tags"><a href="/t">water</a> <a href="/u">bridges</a></div></article>',
    f'<article><div class="reviews">{_p(6, 3, 1)}</div></article><footer><p>Made by hand in the north, since 1999.</p></footer>',
    f'<div class="content no-sidebar"><h1>+Why</h1>{_p(1, 0)}</div><div class="sidebar"><h3>Most read</h3>{_LIST}<p>All of these were chosen by our readers this week.</p></div>',
    f'<main>{_p(4)}<p>+See also:</p><ul><li>+<a href="/d">On doughs</a></li></ul>{_p(3)}</main><section class="discussion"><h2>Discussion</h2>{_TALK.format("item")}{_TALK.format("item")}</section>',
    f'<div role="banner"><p>The oldest paper of the valley, printed every day.</p></div><div class="story">{_p(0, 2)}<p>+More soon.</p></div><div role="contentinfo">Write to us</div><div class="modal"><p>Sign in to go on reading this and all other stories.</p></div>',
    "<nav><a href='/'>Home</a></nav><div class='login'><p>Please log in to see this page.</p></div><footer>Imprint</footer>",
    f'<div class="wrap with-menu"><div class="body-text">{_p(7)}<h2>+Later</h2>{_p(6, 5)}</div><div class="promo"><p>Get three books for the price of two, until the end of the month.</p></div></div>',
    f'<article><h1>+A box of nails</h1>{_p(5, 2)}<div class="reviews"><p>It held my shelf for a year, and I would buy it again.</p><p>Good value.</p></div></article><div class="legal"><p>Prices include tax where the law asks for it.</p></div>',
    f'<main><h1>+Old bridges</h1>{_p(1)}<div class="teaser"><p>Ten walks for the autumn, with maps and all trains back to town.</p></div>{_p(0, 3)}<div class="feedback"><p>Was this page of help to you? Tell us what we missed.</p></div></main>',
    f'<article>{_p(7, 6)}<div class="widget"><h3>Weather</h3><p>Rain in the morning and sun in the afternoon, with some wind.</p></div>{_p(5)}<div class="visitors"><p>My grandfather built one of these rooms, as he used to tell us.</p></div></article>',
)
