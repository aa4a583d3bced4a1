"""Small labelled pages the block classifier is trained on.

Every block starts with ``+`` (main text) or ``-`` (anything else). They cover common
layouts with and without structural tags. The pages are made up for this purpose.
"""

LONG = (
    "The ferry left the harbour before dawn and reached the island when the market was just opening, "
    "so we had the whole morning to look for the old lighthouse that the map showed on the northern cliff."
)
MIDDLE = "Nobody on the pier could say when the next boat would leave or whether it would leave at all."
SHORT = "It rained."


def _links(words: str, sign: str = "-") -> str:
    return "".join(f'<li>{sign}<a href="/{w}">{w}</a></li>' for w in words.split())


PAGES = (
    f"""<html><head><title>x</title></head><body><header><div>-Island Courier</div><p>-News from the coast every day of the week</p></header>
    <nav><ul>{_links("Home News Sport Weather Contact")}</ul></nav>
    <main><article><h1>+A day on the island</h1><p>+{LONG}</p><p>+{SHORT}</p><p>+{MIDDLE}</p><h2>+The way back</h2><p>+{LONG}</p>
    <p>+See the <a href="/t">timetable of the ferries</a> before you go.</p></article></main>
    <aside><h3>-Most read</h3><p>-{MIDDLE}</p><ul>{_links("One Two Three")}</ul></aside>
    <footer><p>-Copyright Island Courier, all rights reserved in all countries.</p><p>-{SHORT}</p></footer></body></html>""",
    f"""<body><div class="menu"><p>-<a href="/a">Start</a></p><p>-<a href="/b">Archive of all years</a></p></div>
    <div class="ad">-{MIDDLE}</div><article><h1>+Lighthouse</h1><p>+{SHORT}</p><p>+{LONG}</p><blockquote>+{MIDDLE}</blockquote>
    <ul><li>+A torch</li><li>+Good shoes and something warm to wear</li></ul><p>+{SHORT}</p></article>
    <div class="comments"><h3>-Comments</h3><p>-{MIDDLE}</p><p>-{LONG}</p></div><div id="cookie-notice">-We use cookies on this site, as all do.</div>
    <form><p>-Leave your address and we will write to you when a new report appears.</p><p>-Name</p></form></body>""",
    f"""<body><div>-<a href="/">Home</a> <a href="/n">News</a> <a href="/s">Sport</a></div><div>-<a href="/login">Log in</a></div>
    <h1>+Notes from the northern cliff and the people who live there</h1><p>+{LONG}</p><p>+{LONG}</p><p>+{MIDDLE}</p><p>+{LONG}</p>
    <div>-<a href="/p">Earlier</a> <a href="/q">Later</a></div><div>-<a href="/1">{MIDDLE}</a></div><div>-<a href="/2">{LONG}</a></div>
    <div>-Share</div><div class="related">-{LONG}</div></body>""",
    f"""<body><div class="sidebar"><p>-{LONG}</p><p>-{SHORT}</p></div><div class="content"><p>+{MIDDLE}</p><p>+{LONG}</p>
    <table><tr><td>+Departure</td><td>+Six in the morning</td></tr></table><p>+{MIDDLE}</p></div>
    <div class="banner">-{SHORT}</div><div class="newsletter">-{MIDDLE}</div><div role="navigation">-<a href="/x">Top</a></div></body>""",
    f"""<body><nav>-<a href="/m">Menu</a> {SHORT}</nav><div class="promo">-{SHORT}</div><article><p>+{SHORT}</p><p>+<a href="/l">{MIDDLE}</a></p>
    <p>+Yes.</p><h2>+On</h2><p>+{LONG}</p><aside>-{LONG}</aside><footer>-{MIDDLE}</footer><p>+No.</p></article>
    <footer>-{SHORT} <a href="/i">Imprint</a></footer><div class="popup">-{LONG}</div></body>""",
    f"""<body><nav><ul>{_links("A B C")}</ul></nav><article><h1>+Sources</h1><p>+{LONG} <a href="/r">{MIDDLE}</a> {SHORT}</p><p>+{LONG}</p>
    <p>+{MIDDLE} <a href="/r">{MIDDLE}</a></p><p>+{SHORT}</p><p>+<a href="/s">{LONG}</a></p><p>+{MIDDLE}</p><p>+<a href="/u">Map</a></p></article>
    <div class="share">-<a href="/f">Share</a></div><div>-<a href="/g">{LONG}</a></div><div>-<a href="/h">{SHORT}</a></div></body>""",
    f"""<body><div>-<a href="/1">One</a> <a href="/2">Two</a></div><h1>+Letters</h1><p>+{LONG} <a href="/r">{MIDDLE}</a></p><p>+{LONG}</p>
    <p>+{MIDDLE} <a href="/v">More of it</a></p><p>+{SHORT}</p><div>-<a href="/3">{MIDDLE}</a></div></body>""",
    f"""<body><article><p>+<a href="/1">{LONG}</a></p><p>+Yes.</p><p>+<a href="/2">{LONG}</a></p><p>+No.</p><p>+{LONG} <a href="/3">{LONG}</a></p>
    <p>+Perhaps.</p><p>+<a href="/4">{MIDDLE}</a></p><h3>+Why</h3><p>+Because.</p></article><footer>-<a href="/5">{LONG}</a></footer>
    <div class="pager">-<a href="/6">Next</a></div></body>""",
)
