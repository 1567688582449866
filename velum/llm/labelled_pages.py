"""Small labelled pages that show what the pages of a table may not: layouts without an
``article``, and what else stands beside or inside one. ``data-main`` marks the main text,
``data-not`` what is not part of it; both are read as labels only."""

SENTENCES = (
    "The river rose through the night, and by morning the lower fields were under water. Nobody had expected it.",
    "Three bridges were closed before noon; the fourth held, although its rails had gone.",
    "In the town hall, volunteers sorted blankets, counted beds and kept a list of those who had no place to sleep.",
    "Later that week the engineers published their first report, which blamed the old culverts.",
    "Prices rose by four percent, then fell again when the harvest turned out better than feared.",
    "She had written the letter twice, but the second version said less than the first.",
)
P = "".join(f"<p>{s}</p>" for s in SENTENCES)
SHORT = f"<p>{SENTENCES[1]}</p>"
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul></nav>'
MENU = '<div class="menu" id="topnav"><ul><li><a href="/">Start</a><li><a href="/a">About us</a><li><a href="/s">Shop</a></ul></div>'
FOOT = "<footer><p>&copy; 2024 Example Ltd. All rights reserved.</p></footer>"
FOOTER = '<div id="footer" class="site-footer"><p>Copyright 2023, imprint and <a href="/p">privacy</a>.</p></div>'
ADVERT = '<div class="ad">Buy two boxes now and save half of the price of the third one.</div>'
BANNER = '<div class="advert sponsored"><p>Sponsored: the best offers of the week, only today.</p></div>'
COOKIES = '<div id="cookie-banner" class="notice"><p>We use cookies to improve this site. Read the policy.</p><button>Accept</button></div>'
NOTICE = '<div role="alert" class="consent"><p>This site asks for your consent to store data.</p></div>'
SIDE = '<aside><h3>Most read</h3><ul><li><a href="/1">Ten things to know</a></li><li><a href="/2">Five more</a></li></ul></aside>'
SIDEBAR = '<div class="sidebar widget"><h4>Archive</h4><p>Older pieces by month and by author can be found here.</p></div>'
FORM = '<form action="/s"><label>Your address</label><input name="m"><p>Subscribe to the weekly letter, free of charge.</p></form>'
COMMENTS = (
    '<div class="comments" id="comments"><h3>2 comments</h3><div class="comment"><p>I was there, and it was worse than that. Really.</p></div>'
    '<div class="comment"><p>Thanks for the article, well written and sad.</p></div></div>'
)
REPLIES = '<section id="respond" class="comment-list"><p>First! Nothing to add, but a good read, as always.</p></section>'
SHARE = '<div class="share social"><a href="/f">Share</a> <a href="/t">Send</a></div>'
RELATED = '<div class="related"><h3>See also</h3><ul><li><a href="/x">A dam and its makers</a></li></ul></div>'
HEADER = f'<header><a href="/">The Daily Example</a>{NAV}</header>'
HEAD = '<div class="header" id="masthead"><p>The Example Post, founded in 1901</p></div>'


def _not(html: str) -> str:
    """The first element marked as not part of the main text."""
    at = html.index(">")
    return f"{html[:at]} data-not{html[at:]}"


PAGES = (
    f"<body>{HEADER}{COOKIES}<article data-main><h1>High water</h1>{P}</article>{SIDE}{FOOT}</body>",
    f"<body>{NAV}{ADVERT}<article data-main><h1>A letter</h1>{SHORT}</article>{FOOT}</body>",
    f"<body>{HEAD}{MENU}<div class='content' data-main><h1>High water</h1>{P}</div>{SIDEBAR}{FOOTER}</body>",
    f"<body>{MENU}<div id='main' class='post entry' data-main><h2>Prices</h2>{P}{_not(SHARE)}{_not(COMMENTS)}</div>{FOOTER}</body>",
    f"<body>{NOTICE}{HEADER}<main data-main><h1>Report</h1>{P}{_not(RELATED)}</main>{FORM}{FOOT}</body>",
    f"<body>{HEADER}<article data-main><header><h1>Report</h1></header>{P}{_not(BANNER)}{SHORT}{_not(REPLIES)}</article>{FOOT}</body>",
    f"<body>{HEADER}<main><article data-main><h1>Old culverts</h1>{SHORT}{_not(FORM)}{P}</article>{COMMENTS}</main>{SIDE}{FOOT}</body>",
    f"<body><div class='wrap'>{MENU}<div class='body' data-main>{P}{P}</div>{SIDEBAR}{RELATED}</div>{FOOTER}{COOKIES}</body>",
    f"<body>{HEADER}<article data-main><h1>Beds</h1>{P}{_not(SIDE)}<ul><li>{SENTENCES[2]}</li><li>{SENTENCES[3]}</li></ul>{_not(FOOT)}</article>{FOOT}</body>",
    f"<body>{NAV}<div data-main><h1>Plain</h1>{P}<blockquote>{SENTENCES[5]}</blockquote></div>{COMMENTS}{FOOT}</body>",
    f"<body>{HEAD}{FORM}<table><tr><td>{MENU}</td><td data-main>{P}</td><td>{SIDEBAR}</td></tr></table>{FOOTER}</body>",
    f"<body>{HEADER}<section class='story' data-main><h1>Bridges</h1>{SHORT}{_not(ADVERT)}{P}</section>{REPLIES}{FOOT}</body>",
    f"<body>{P.replace('<p>', '<p data-main>')}</body>",
    f"<body>{NAV}{FORM}{FOOT}</body>",
    f"<body data-main>{SENTENCES[0]}<br>{SENTENCES[2]}</body>",
    " ".join(SENTENCES),
    SENTENCES[4],
    "Nothing but a line, or two. No elements at all.",
)
