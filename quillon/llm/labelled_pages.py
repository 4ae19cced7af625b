"""Hand-labelled pages that the extraction model is fitted on.

An element's label is its data-label, else its parent's. The layouts cover semantic elements and plain
divisions, unclosed paragraphs, cut-off pages, and the usual boilerplate around and inside an article.
"""

from __future__ import annotations

_SENTENCE = "The river rose in the night and the lower fields were under water by the morning. "
_LONG, _MID, _SHORT = _SENTENCE * 6, _SENTENCE * 2, "The water fell again."
_MENU = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>World news</a></li><li><a href='/c'>About us</a></li></ul>"
_P = f"<p>{_LONG}</p><p>{_SHORT}</p><p>{_MID}</p>"
_LINKED = f"<p>{_MID} See <a href='/more'>the map</a> for more.</p>"


def _page(body: str, head: str = "") -> str:
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>River</title>{head}</head><body>{body}</body></html>"


#: class or id words of boilerplate that may stand around or inside an article
_OTHER = (
    "ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "sponsor", "cookie notice", "cookie consent", "notice", "alert", "gdpr", "newsletter", "subscribe", "signup", "popup modal",
    "sidebar", "widget", "related", "recommended", "more stories", "share", "social", "breadcrumbs", "breadcrumb", "pagination", "pager", "menu", "navbar", "nav", "navigation", "topbar", "masthead", "site header", "header", "footer", "site footer", "copyright", "legal",
    "comments", "comment list", "comment", "discussion", "replies", "respond", "disqus thread", "login", "search", "toolbar", "tags", "author bio", "skip link", "paywall", "disclosure", "disclaimer", "affiliate notice", "correction policy", "terms", "privacy", "print only", "rating", "byline social", "outbrain", "taboola", "survey", "donate", "app download", "trending", "most read", "feedback", "report",
)
#: class or id words of containers of main text
_MAIN = ("content", "main content", "article body", "post content", "entry content", "story", "article", "post body", "text", "post", "entry", "body copy", "main")


def _around(kind: str, text: str) -> str:
    return f"<div class='{kind}' data-label='other'>{text}</div>"


def _layouts() -> list[str]:
    out = []
    nav, footer = f"<nav data-label='other'>{_MENU}</nav>", "<footer data-label='other'>&copy; 2020 The Paper. All rights reserved.</footer>"
    ad = "<div class='ad' data-label='other'>Buy two chairs now. Only today.</div>"
    out.append(_page(f"{nav}<!-- ad -->{ad}<article data-label='main'><h1>{_SHORT}</h1>{_P}</article>{footer}", "<style>p{}</style><script>x=1</script>"))
    out.append(_page(f"{nav}{ad}<article data-label='main'><h1>River</h1><p><b>{_MID}<br><p>{_LONG}<p>{_SHORT}{_P}</article>{footer}"))
    out.append(f"<html><body>{nav}<article data-label='main'><h1>{_SHORT}</h1><p>{_LONG}<p>One.<p>{_MID}")
    out.append(_page(f"<header data-label='other'><h1>The Paper</h1><p>{_SHORT}</p>{_MENU}</header><main data-label='main'><h2>River</h2>{_P}<ul><li>{_SHORT}</li><li>Fields and farms</li></ul><table><tr><td>Level</td><td>4 m</td></tr></table></main><aside data-label='other'><h3>Most read</h3><p>{_MID}</p></aside>{footer}"))
    out.append(_page(f"{nav}<article data-label='main'><header><h1>River</h1><p>{_SHORT}</p></header><section><h2>Night</h2>{_P}</section><section>{_LINKED}<blockquote>{_MID}</blockquote><pre>a = 1</pre></section></article>{footer}"))
    for i, name in enumerate(_MAIN):
        inside = _around(_OTHER[(3 * i) % len(_OTHER)], f"<p>{_MID}</p>") + _around(_OTHER[(3 * i + 1) % len(_OTHER)], f"<p>{_SHORT}</p>{_MENU}")
        after = _around(_OTHER[(3 * i + 2) % len(_OTHER)], f"<h3>More</h3><p>{_LONG}</p><p>{_SHORT}</p>")
        attribute = "id" if i % 2 else "class"
        out.append(_page(f"<div class='page' data-label='other'>{_around('header', f'<h1>The Paper</h1>{_MENU}')}<div {attribute}='{name}' data-label='main'><h1>{_SHORT}</h1>{_P}{inside}{_LINKED}<p>{_SHORT}</p></div>{after}{_around('footer', '<p>All rights reserved.</p>')}</div>"))
    for i in range(0, len(_OTHER), 2):
        a, b = _OTHER[i], _OTHER[(i + 1) % len(_OTHER)]
        out.append(_page(f"{nav}<section id='{b}' data-label='other'><p>{_MID}</p></section><article data-label='main'><h1>River</h1>{_P}<div class='{a}' data-label='other'><h2>Readers</h2><p>{_MID}</p><p>{_LONG}</p></div><p>{_LONG}</p><div><p>{_MID}</p></div></article><div class='{b}' data-label='other'><p>{_MID}</p></div>{footer}"))
    out.append(_page(f"{nav}<main data-label='main'><article><h1>River</h1>{_P}<form data-label='other'><label>Name</label><p>{_SHORT}</p><button>Send</button></form><aside data-label='other'><p>{_LONG}</p></aside><nav data-label='other'>{_MENU}</nav><figure><figcaption>{_SHORT}</figcaption></figure><p>{_SHORT}</p><footer data-label='other'><p>Filed under news.</p></footer></article></main><form data-label='other'><p>{_MID}</p></form>{footer}"))
    out.append(_page(f"<div role='banner' data-label='other'><p>The Paper</p></div><div role='navigation' data-label='other'>{_MENU}</div><div role='main' data-label='main'><h1>River</h1>{_P}</div><div role='complementary' data-label='other'><p>{_LONG}</p></div><div role='contentinfo' data-label='other'><p>{_SHORT}</p></div><div role='dialog' data-label='other'><p>{_MID}</p></div>"))
    out.append(_page(f"{nav}<section class='comments' data-label='other'><h2>Comments</h2><article data-label='other'><p>{_MID}</p></article><div class='comment'><p>{_LONG}</p></div></section>{footer}"))
    out.append(_page(f"{nav}<article data-label='main'><h1>River</h1>{_P}</article><section id='comments' data-label='other'><h2>3 comments</h2><ol><li><p>{_MID}</p></li><li><p>{_LONG}</p></li></ol></section><aside class='sidebar' data-label='other'><p>{_LONG}</p></aside>{footer}"))
    out.append(_page(f"<div data-label='other'>{_MENU}</div><div data-label='main'><h1>River</h1>{_P}<div><p>{_LONG}</p></div></div>{footer}"))
    # short articles between long boilerplate
    for i, name in enumerate(_MAIN):
        attribute = "class" if i % 2 else "id"
        out.append(f"<html><body>{_around(_OTHER[(5 * i) % len(_OTHER)], f'<p>{_MID}</p>')}<div {attribute}='{name}' data-label='main'><h1>River</h1><p>{_SHORT if i % 3 else 'Wet.'}</p></div>{_around(_OTHER[(5 * i + 2) % len(_OTHER)], f'<p>{_LONG}</p>')}</body></html>")
    out.append(f"<article data-label='main'><p>{_SHORT}</p><div class='comments' data-label='other'><p>{_LONG}</p></div></article>")
    for i, name in enumerate(("comments", "comment list", "replies", "discussion", "respond", "related", "recommended", "more stories")):  # articles within boilerplate
        attribute = "id" if i % 2 else "class"
        out.append(f"<body>{nav}<article data-label='main'><h1>River</h1><p>{_SHORT}</p></article><section {attribute}='{name}' data-label='other'><h2>More</h2><article><p>{_SHORT}</p></article><article><p>{_MID}</p></article></section></body>")
        out.append(f"<main data-label='main'><h1>River</h1>{_P}</main><div {attribute}='{name}' data-label='other'><article><p>{_MID}</p></article><div class='comment'><p>{_SHORT}</p></div></div>")
    for top in ("<header><h1>The Paper</h1></header>", "<header class='site header'><h1>The Paper</h1><h2>Since 1900</h2></header>", "<header><h2>The Paper</h2><p>News</p></header>", f"<header><h1>The Paper</h1>{_MENU}</header>"):
        out.append(f"<body>{top.replace('<header', "<header data-label='other'")}<main data-label='main'><h1>River</h1><p>{_SHORT}</p></main><footer data-label='other'>c</footer></body>")
        out.append(f"<html><body>{top.replace('<header', "<header data-label='other'")}<article data-label='main'><header><h1>River</h1></header><p>{_MID}</p></article><footer data-label='other'><p>c</p></footer></body></html>")
    for tag in ("article", "main"):
        out.append(f"<{tag} data-label='main'><p>Wet fields</p></{tag}>")
        out.append(f"<{tag} data-label='main'><h1>Wet fields</h1><p>River and farm</p><div class='comments' data-label='other'><p>{_SHORT}</p></div></{tag}>")
        out.append(_page(f"{nav}<{tag} data-label='main'><h2>Wet fields</h2><ul><li>River</li><li>Farm</li></ul></{tag}>{footer}"))
    for i, name in enumerate(_OTHER):  # short boilerplate within an article
        text = ("<p>Wet.</p>", f"<h3>More</h3><p>{_SHORT}</p>", f"<form><p>{_SHORT}</p></form>", f"<p>{_MID}</p>")[i % 4]
        tag = ("div", "aside", "section", "div")[i % 4]
        out.append(f"<article data-label='main'><h1>River</h1><p>{_SHORT if i % 2 else _MID}</p><{tag} class='{name}' data-label='other'>{text}</{tag}><ul><li>Wet.</li></ul><p>{_SHORT}</p></article>")
    out.append("<article data-label='main'><p>Wet.</p></article>")
    out.append(_page(f"<article data-label='main'><h1>River</h1></article>{footer}"))
    out.append(_page(f"{nav}<main data-label='main'><p>{_SHORT}</p></main>{footer}"))
    out.append(_page(f"{nav}<article data-label='main'>Wet. {_SHORT}<br>{_SHORT}</article>{footer}"))
    out.append(_page(f"{nav}<div data-label='other'><p>{_SHORT}</p></div><article data-label='main'><p>{_SHORT}</p></article>{footer}"))
    # pages of nothing but paragraphs, with and without headings
    for body in (f"<p>{_MID}</p><p>{_LONG}</p>", f"<h1>River</h1>{_P}", f"<p>{_SHORT}</p><p>{_SHORT}</p>", f"{_LINKED}{_P}", f"<h2>River</h2><p>{_LONG}</p><ul><li>{_SHORT}</li></ul>", "<p>Wet.</p><p>Dry.</p>", f"<h1>River</h1><p>{_SHORT}</p>"):
        out.append(f"<html><body data-label='main'>{body}</body></html>")
        out.append(f"<html><head><title>T</title><body data-label='main'>{body}{footer}</body></html>")
        out.append(f"<html><body data-label='main'>{nav}{body}<div class='ad' data-label='other'>{_SHORT}</div></body></html>")
        out.append(f"<body data-label='main'>{_around('sidebar', f'<p>{_MID}</p>')}{body}{_around('comments', f'<p>{_LONG}</p>')}</body>")
    # tables that lay out a page
    for side in (_MENU, "<a href='/'>Home</a> <a href='/n'>News</a>", "<a href='/a'>Home</a><br><a href='/b'>World news</a><br><a href='/c'>About</a>", "<p><a href='/x'>Archive</a></p>"):
        cell, text = f"<td data-label='other'>{side}</td>", f"<td data-label='main'><h1>River</h1>{_P}</td>"
        out.append(f"<html><body><table><tr>{cell}{text}</tr></table></body></html>")
        out.append(f"<html><body><table><tr><td data-label='other'>The Paper</td></tr><tr>{cell}{text}<td class='ads' data-label='other'>{_SHORT}</td></tr><tr><td class='footer' data-label='other'>&copy; 2020 All rights reserved.</td></tr></table></body></html>")
        out.append(f"<body><table><tr>{cell}<td data-label='main'><p>{_MID}</p><p>{_LONG}</p><table><tr><td>Level</td><td>4 m</td></tr></table></td></tr></table></body>")
    # inline elements with names: words and links of the text, and what was put in between
    for i, name in enumerate(("highlight", "term", "person", "quote", "caps", "x1", "date", "link external", "footnote", "mw redirect", "place", "number", "glossary", "strong", "name", "ref")):
        tag = ("span", "a", "em", "abbr")[i % 4]
        out.append(f"<article data-label='main'><h1>River</h1><p>{_MID} <{tag} class='{name}' href='/m'>The lower fields</{tag}> and the farms. {_SHORT}</p><p>{_LONG}</p></article>")
        out.append(f"<html><body>{nav}<div class='content' data-label='main'><p><{tag} id='{name}'>Wet</{tag}> fields. {_SHORT}</p><p>{_MID}</p></div>{footer}</body></html>")
    for i, name in enumerate(("ad", "advert", "sponsored", "promo", "share", "social", "ads", "newsletter", "related", "advertisement", "comment", "disclosure", "notice", "widget")):
        tag = ("span", "a", "small", "span")[i % 4]
        out.append(f"<article data-label='main'><h1>River</h1><p>{_MID} <{tag} class='{name}' data-label='other'>Buy two chairs now.</{tag}> {_SHORT}</p><p>{_LONG}</p></article>")
        out.append(f"<main data-label='main'><p>{_SHORT} <{tag} class='{name} box' data-label='other'>{_SHORT}</{tag}></p><p>{_LONG}</p></main>")
    # pages of bare text, text right in the body or in divisions without names
    for text in (_SHORT, _MID, _LONG, f"{_MID}<br>{_SHORT}", f"{_MID}<br><br>{_LONG}", "Wet fields", f"<b>River</b> {_MID}"):
        out.append(text)  # a page without labels is main text as a whole
        out.append(f"<html><body data-label='main'>{text}</body></html>")
        out.append(f"<html><head><title>T</title></head><body data-label='main'>{text}<p>{_SHORT}</p></body></html>")
        out.append(f"<html><body data-label='other'><div data-label='main'><h2>River</h2>{text}</div></body></html>")
        out.append(f"<html><body data-label='other'>{nav}<div data-label='main'>{text}</div>{footer}</body></html>")
        out.append(f"<body data-label='other'><center data-label='main'><h1>River</h1></center><div data-label='main'>{text}</div><hr><a href='/' data-label='other'>Home</a></body>")
        out.append(f"<body data-label='main'><center><h1>River</h1></center>{text}<p>{_MID}</p><hr><a href='/' data-label='other'>Home</a></body>")
    for links in ("<a href='/a'>Home</a> <a href='/b'>News</a>", "<a href='/a'>Home</a> | <a href='/b'>News</a> | <a href='/c'>About</a>", _MENU):
        for last in ("Powered by Farm", "&copy; 2020 The Paper", "All rights reserved.", f"{links}"):
            out.append(f"<body><div data-label='other'>{links}</div><div data-label='main'><p>{_MID}</p></div><div data-label='other'>{last}</div></body>")
            out.append(f"<html><body><div><div class='zz1' data-label='other'>{links}</div><div class='zz2' data-label='main'><h1>River</h1>{_P}</div><div class='zz3' data-label='other'>{last}</div></div></body></html>")
            out.append(f"<body><div data-label='other'>{links}</div><div data-label='main'><h2>River</h2>{_MID}<br>{_SHORT}</div><div data-label='other'>{last}</div></body>")
    # readers and notices by what they look like: names that say nothing, repeated blocks after the text, short notices before it
    for i, (one, two) in enumerate(((_SHORT, _MID), (_MID, _SHORT), ("Wet!", _SHORT), (_LONG, _MID))):
        for who in ("<b>Ann</b>", "<span>Ann, 3 May</span>", "<h4>Ann</h4>", "<a href='/u/1'>Ann</a> "):
            replies = f"<div class='zz2'>{who}<p>{one}</p></div><div class='zz2'>{who}<p>{two}</p></div>" + f"<div class='zz2'>{who}<p>{_SHORT}</p></div>" * (i % 3)
            items = replies.replace("<div", "<li").replace("</div", "</li")
            out.append(f"<body><article data-label='main'><h1>River</h1>{_P}</article><div class='zz1' data-label='other'>{replies}</div></body>")
            out.append(f"<body>{nav}<div class='content' data-label='main'><h1>River</h1>{_P}</div><section class='zz1' data-label='other'><h3>Voices</h3>{replies}</section>{footer}</body>")
            out.append(f"<article data-label='main'><h1>River</h1>{_P}<div class='zz1' data-label='other'>{replies}</div></article>")
            out.append(f"<main data-label='main'><h1>River</h1><p>{_LONG}</p><section id='zz1' data-label='other'><h2>2 voices</h2><ul>{items}</ul></section></main>")
            out.append(f"<body><div class='zz3' data-label='main'><h1>River</h1>{_P}</div><div class='zz1' data-label='other'>{replies}</div></body>")
    for ask in ("<button>Yes</button>", "<a href='/p'>More</a> <button>Yes</button>", "<form><button>Yes</button></form>"):
        for text in (_SHORT, _MID):
            out.append(f"<body><div class='zz1' data-label='other'><p>{text}</p>{ask}</div><main data-label='main'><h1>River</h1>{_P}</main></body>")
            out.append(f"<body><div class='zz1 consent layer' data-label='other'><p>{text}</p>{ask}</div><article data-label='main'><h1>River</h1>{_P}</article>{footer}</body>")
            out.append(f"<body>{nav}<article data-label='main'><h1>River</h1>{_P}</article><div class='zz1' data-label='other'><div class='zz2'>{text} {ask}</div></div></body>")
    # sections of a text, to its end
    part = "<{0}><h2>{1}</h2><p>{2}</p></{0}>"
    for tag in ("section", "div"):
        for texts in ((_LONG, _MID), (_MID, _SHORT, _MID), (_MID, _LONG, _SHORT, _MID), (_SHORT, _LONG)):
            parts = "".join(part.format(tag, f"Day {k}", text) for k, text in enumerate(texts))
            out.append(f"<article data-label='main'><h1>River</h1>{parts}</article>")
            out.append(f"<body>{nav}<article data-label='main'><h1>River</h1>{parts}<aside data-label='other'><p>{_MID}</p></aside></article>{footer}</body>")
            out.append(f"<html><body>{nav}<main data-label='main'>{parts}</main><aside data-label='other'><h3>More</h3><p>{_LONG}</p></aside>{footer}</body></html>")
            out.append(f"<body><div class='zz1' data-label='main'><h1>River</h1>{parts}</div>{footer}</body>")
    for side in (_MENU, "<a href='/'>Home</a> <a href='/n'>News</a>", "<a href='/a'>Home</a><br><a href='/b'>World news</a>"):
        for text in (f"<p>{_MID}</p>", f"<p>{_SHORT}</p>", f"<h2>River</h2><p>{_MID}</p>", _MID, f"{_MID}<br>{_SHORT}"):
            out.append(f"<body><table><tr><td data-label='other'>{side}</td><td data-label='main'>{text}</td></tr></table></body>")
    for name, lines in (("zz1", (_MID, _LONG, _MID)), ("zz1 par", (_MID, _SHORT)), ("zz1", (_SHORT, _MID, _SHORT, _MID)), ("zz1", (_MID, _MID, _MID)), ("zz1", (_SHORT, _SHORT, _SHORT))):  # divisions for paragraphs
        texts = "".join(f"<div class='{name}'>{t}</div>" for t in lines)
        out.append(f"<html><body data-label='main'>{texts}</body></html>")
        out.append(f"<body><div class='zz2' data-label='main'>{texts}</div></body>")
        out.append(f"<body>{nav}<div class='zz2' data-label='main'><h1>River</h1>{texts}</div>{footer}</body>")
        out.append(f"<article data-label='main'><h1>River</h1>{texts}</article>")
    # repeated named blocks that are the text itself, and boxes in it
    for name in ("zz1", "zz1 step"):
        out.append(f"<article data-label='main'><h1>River</h1><ol class='zz2'><li class='{name}'>{_SHORT}</li><li class='{name}'>Wet fields.</li><li class='{name}'>{_SHORT}</li></ol><p>{_MID}</p></article>")
        out.append(f"<body>{nav}<article data-label='main'><h1>River</h1><p class='{name}'>{_MID}</p><p class='{name}'>{_LONG}</p><p class='{name}'>{_SHORT}</p></article>{footer}</body>")
        out.append(f"<body>{nav}<div data-label='main'><div class='{name}'><h2>River</h2>{_P}</div><div class='{name}'><h2>Night</h2><p>{_LONG}</p></div><div class='{name}'><p>{_MID}</p></div></div>{footer}</body>")
        out.append(f"<body><section data-label='main'><h2>River</h2><p>{_LONG}</p></section><section data-label='main'><h2>Night</h2><p>{_MID}</p></section>{footer}</body>")
        out.append(f"<article data-label='main'><h1>River</h1><p>{_LONG}</p><details><summary>In short</summary><p>{_SHORT}</p></details><div class='{name}'><p>{_MID}</p></div></article>")
        out.append(f"<article data-label='main'><h1>River</h1><p>{_LONG}</p><figure class='{name}'><figcaption>{_SHORT}</figcaption></figure><blockquote class='{name}'>{_MID}</blockquote></article>")
    return out


PAGES = tuple(_layouts())
