"""Main text of layouts that are not among the labelled pages, and of names that the model doesn't know."""

import pytest

from quillon.llm import html_extraction

S = "The council met on Monday to discuss the new bridge. It will cost two million."
S2 = "The harbour was closed for a week after the storm. Fishermen stayed at home."
MENU = "<ul><li><a href='/'>Start</a></li><li><a href='/n'>News</a></li></ul>"

LAYOUTS = {
    "div h2": (f"<html><body><div><h2>One</h2>{S}</div></body></html>", f"One\n{S}"),
    "divs": (f"<body><div><a href='/a'>Home</a> <a href='/b'>News</a></div><div><p>{S}</p></div><div>Powered by Foo</div></body>", f"{S}"),
    "bare": (f"{S} {S2}", f"{S} {S2}"),
    "bare body": (f"<html><body>{S}</body></html>", f"{S}"),
    "bare br": (f"<html><head><title>x</title></head><body>{S}<br><br>{S2}</body></html>", f"{S} {S2}"),
    "kommentare": (f"<body><article><h1>Bridge</h1><p>{S}</p><p>{S2}</p></article><div class='kommentare'><div class='kommentar'><b>Anna</b><p>I do not agree at all. Too costly.</p></div><div class='kommentar'><b>Bert</b><p>Well done by the council!</p></div></div></body>", f"Bridge\n{S}\n{S2}"),
    "user-reviews": (f"<body><nav>{MENU}</nav><div class='content'><h1>Bridge</h1><p>{S}</p><p>{S2}</p></div><section class='user-reviews'><h3>Opinions</h3><div class='rv'><span>Anna</span><p>I do not agree at all. Too costly.</p></div><div class='rv'><span>Bert</span><p>Well done by the council!</p></div></section></body>", f"Bridge\n{S}\n{S2}"),
    "comments in article": (f"<article><h1>Bridge</h1><p>{S}</p><p>{S2}</p><div class='lesermeinungen'><div class='lm'><b>Anna</b><p>I do not agree at all. Too costly.</p></div><div class='lm'><p>Well done by the council!</p></div></div></article>", f"Bridge\n{S}\n{S2}"),
    "consent": (f"<body><div class='consent-layer'><p>We use your data to show you things. Do you agree?</p><button>Yes</button></div><main><h1>Bridge</h1><p>{S}</p><p>{S2}</p></main></body>", f"Bridge\n{S}\n{S2}"),
    "summary": (f"<article><h1>Bridge</h1><p>{S}</p><details><summary>In short</summary><p>{S2}</p></details></article>", f"Bridge\n{S}\nIn short\n{S2}"),
    "plain div p": (f"<body><div><div><p>{S}</p><p>{S2}</p></div></div></body>", f"{S}\n{S2}"),
    "zwei": (f"<body><div class='kopf'><a href='/'>Zeitung</a></div><div class='inhalt'><h1>Bridge</h1><p>{S}</p><p>{S2}</p></div><div class='fuss'>Impressum</div></body>", f"Bridge\n{S}\n{S2}"),
    "sections": (f"<body><section><h2>One</h2><p>{S}</p></section><section><h2>Two</h2><p>{S2}</p></section></body>", f"One\n{S}\nTwo\n{S2}"),
    "div cards": (f"<body><nav>{MENU}</nav><div><div class='x1'><h2>One</h2><p>{S}</p></div></div><footer>c</footer></body>", f"One\n{S}"),
    "lists": (f"<article><h1>Steps</h1><ol class='steps'><li class='s'>Mix the flour.</li><li class='s'>Add the eggs.</li></ol><p>{S}</p></article>", f"Steps\nMix the flour.\nAdd the eggs.\n{S}"),
    "tab": ("<body><table><tr><td><a href='/'>Home</a> <a href='/n'>News</a></td><td><p>Frogs came down on the town, and nobody knew why they had come to stay.</p></td></tr></table></body>", "Frogs came down on the town, and nobody knew why they had come to stay."),
    "p2": ("<html><body><p>First things come first here.</p><p>Second thoughts come later on.</p></body></html>", "First things come first here.\nSecond thoughts come later on."),
    "one": ("<html><head><title>T</title><body><article><p>The lower fields were under water.</p></article></body></html>", "The lower fields were under water."),
    "one line bare": ("A short bare line without any markup at all.", "A short bare line without any markup at all."),
    "long bare": (S * 30, S * 30),
    "article h2 sections": (f"<article><h1>T</h1><section><h2>A</h2><p>{S}</p></section><section><h2>B</h2><p>{S2}</p></section><aside><p>{S}</p></aside></article>", f"T\nA\n{S}\nB\n{S2}"),
    "steps named": (f"<article><h1>Steps</h1><div class='step'><h2>One</h2><p>{S}</p></div><div class='step'><h2>Two</h2><p>{S2}</p></div></article>", f"Steps\nOne\n{S}\nTwo\n{S2}"),
    "paragraph divs": (f"<body><div class='z'><div class='para'>{S}</div><div class='para'>{S2}</div><div class='para'>{S}</div></div></body>", f"{S}\n{S2}\n{S}"),
    "avis": (f"<article><h1>Pont</h1><p>{S}</p><p>{S2}</p><p>{S}</p></article><div id='avis-lecteurs'><ul><li class='avis'><b>Jean</b> Bravo!</li><li class='avis'><b>Marie</b> Je ne suis pas d'accord.</li></ul></div>", f"Pont\n{S}\n{S2}\n{S}"),
    "banner consent fr": (f"<div id='bandeau'><p>Nous utilisons des traceurs. Acceptez-vous?</p><button>Oui</button><button>Non</button></div><article><h1>Pont</h1><p>{S}</p><p>{S2}</p></article>", f"Pont\n{S}\n{S2}"),
    "footer div": (f"<body><div class='wrap'><div class='txt'><h1>Pont</h1><p>{S}</p><p>{S2}</p></div><div class='foot'><a href='/i'>Impressum</a> <a href='/d'>Datenschutz</a></div></div></body>", f"Pont\n{S}\n{S2}"),
    "blog post + comments ol": (f"<body><div id='blog'><h2>Pont</h2><p>{S}</p><p>{S2}</p></div><ol class='zz'><li class='c1'><cite>A</cite><p>Nice one.</p></li><li class='c1'><cite>B</cite><p>Thanks for it.</p></li></ol></body>", f"Pont\n{S}\n{S2}"),
    "dl": (f"<main><h1>Words</h1><dl><dt>Pier</dt><dd>{S}</dd><dt>Quay</dt><dd>{S2}</dd></dl></main>", f"Words\nPier\n{S}\nQuay\n{S2}"),
    "table data": (f"<article><h1>T</h1><table class='data'><tr class='r'><td>Level</td><td>4 m</td></tr><tr class='r'><td>Flow</td><td>9</td></tr></table><p>{S}</p></article>", f"T\nLevel\n4 m\nFlow\n9\n{S}"),
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layout(name):
    page, want = LAYOUTS[name]
    assert html_extraction.main_text(page, html_extraction.default_model()) == want


@pytest.mark.parametrize("comments", ["kommentare", "leserbriefe", "opiniones", "zkq", ""])
@pytest.mark.parametrize("item", ["div", "li", "article"])
def test_readers_are_told_by_repetition_not_by_name(comments, item):
    who = "".join(f"<{item} class='q{len(comments)}'><b>{n}</b><p>{t}</p></{item}>" for n, t in (("Anna", "Too costly."), ("Bert", "Well done by the council!"), ("Cleo", "I do not agree at all. It is ugly.")))
    page = f"<body><article><h1>Bridge</h1><p>{S}</p><p>{S2}</p><p>{S}</p></article><section class='{comments}'><h3>Voices</h3>{'<ul>' * (item == 'li')}{who}{'</ul>' * (item == 'li')}</section></body>"
    assert html_extraction.main_text(page, html_extraction.default_model()) == f"Bridge\n{S}\n{S2}\n{S}"


def test_marginals_of_all_pages_at_once_equal_those_of_each(spark):
    import numpy as np

    pages = [html_extraction.parse(p) for p in html_extraction.PAGES[::40]]
    model = html_extraction.fit(html_extraction.PAGES[:60], steps=10)
    own = [np.array(model.potentials(p)) for p in pages]
    edges = np.array([model.edges[k] for k in html_extraction.KINDS])
    p, joint = html_extraction._Forest(pages).marginals(np.concatenate(own), edges)
    assert np.allclose(p, np.concatenate([model.content(page, o) for page, o in zip(pages, own)]))
    assert np.allclose(joint, np.concatenate([model.joints(page, o)[1:] for page, o in zip(pages, own)]))
