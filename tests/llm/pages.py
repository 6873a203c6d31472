"""Hand-written pages of many designs: (html, main text)."""

ONE = "The river rose overnight and by morning the lower meadows were under water, as they are nearly every spring."
TWO = "Nobody in the village was surprised, because the old people had watched the geese leave early and said so in the shop."
THREE = "By noon the ferry had stopped and children were rowing between the apple trees in whatever would float."
TITLE = "Spring flood"
P = f"<p>{ONE}</p><p>{TWO}</p>"
MENU = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/c>Contact us</a></li></ul></nav>"
FOOT = "<footer><p>&copy; 2024 The Valley Paper. All rights reserved.</p></footer>"
ASIDE = "<aside><h3>Most read</h3><ul><li><a href=/1>Bridge to close</a></li><li><a href=/2>Fair dates</a></li></ul></aside>"
REPLIES = "<section class='comments'><h3>2 comments</h3><div class=comment><p>Lovely piece, thank you for writing it down so well.</p></div><div class=comment><p>We saw the geese as well, over the ridge.</p></div></section>"
COOKIE = "<div class='cookie-banner'><p>We use cookies to improve your visit.</p><button>Accept</button></div>"
AD = "<div class=advert><p>Buy two pairs of boots and get one free.</p></div>"
FORM = "<form class=newsletter><label>Your mail</label><input><button>Subscribe</button></form>"
BODY = f"{ONE}\n{TWO}"
FULL = f"{TITLE}\n{BODY}"
H1 = f"<h1>{TITLE}</h1>"


def page(inner: str, body: str = "<body>") -> str:
    return f"<!doctype html><html><head><title>t</title></head>{body}{MENU}{inner}{FOOT}</body></html>"


WRAPPERS = [
    "<article class='post has-sidebar'>|</article>", "<main class='site-main no-sidebar'>|</main>", "<article class='post comments-open'>|</article>", "<div class='article-body share-enabled'>|</div>", "<article class='recent-story'>|</article>",
    "<div class='article ad-free'>|</div>", "<article><div class='search-result-body'>|</div></article>", "<div class='entry tag-news category-more'>|</div>", "<article>|</article>", "<main>|</main>", "<main><article>|</article></main>",
    "<div id=content>|</div>", "<div class=post-content>|</div>", "<section class=story>|</section>", "<div class='entry-content'>|</div>", "<div class='wrapper'><div class='col-8'><article>|</article></div></div>",
    "<main role=main id=main class='layout-with-sidebar'><article class='hentry format-standard'>|</article></main>", "<div class=articleBody>|</div>", "<article class='post type-post status-publish tag-comments category-social'>|</article>",
    "<div class='story-text is-subscribed'>|</div>", "<article id=post-17 class='single sidebar-off'>|</article>", "<div class='page-content with-comments'>|</div>",
]

PAGES = [(page(w.replace("|", P)), BODY) for w in WRAPPERS]
PAGES += [(page(w.replace("|", H1 + P)), FULL) for w in WRAPPERS[:12]]
PAGES += [
    (page(f"<div class='entry tag-news category-more'>{P}</div>", "<body class='archive tag page'>"), BODY),
    (page(f"<article>{P}</article>", "<body class='single has-comments sidebar-right ad-free'>"), BODY),
    (page(f"<article><header><h1>{TITLE}</h1></header>{P}</article>"), FULL),
    (page(f"<article><p>{ONE}</p><p class='message'>{TWO}</p></article>"), BODY),
    (page(f"<article>{H1}{P}</article>{ASIDE}"), FULL),
    (page(f"{ASIDE}<article>{H1}{P}</article>"), FULL),
    (page(f"<article>{H1}{P}</article>{REPLIES}"), FULL),
    (page(f"<article>{H1}{P}{REPLIES}</article>"), FULL),
    (page(f"{COOKIE}<main>{H1}{P}</main>"), FULL),
    (page(f"<main>{H1}<p>{ONE}</p>{AD}<p>{TWO}</p></main>"), FULL),
    (page(f"<main>{H1}{P}{FORM}</main>"), FULL),
    (page(f"<article>{H1}<p>{ONE}</p><ul><li>{TWO}</li><li>{THREE}</li></ul></article>"), f"{FULL}\n{THREE}"),
    (page(f"<article>{H1}<blockquote>{ONE}</blockquote><p>{TWO}</p></article>{ASIDE}{REPLIES}"), FULL),
    (page(f"<div class=container><div class=row><div class='main-column'>{H1}{P}</div>{ASIDE}</div></div>"), FULL),
    (page(f"<article class='post'>{H1}<div class='post-body'>{P}<h2>Afterwards</h2><p>{THREE}</p></div></article>{REPLIES}{ASIDE}"), f"{FULL}\nAfterwards\n{THREE}"),
    (page(ASIDE + FORM), ""),
    ("", ""),
    (page(""), ""),
]
