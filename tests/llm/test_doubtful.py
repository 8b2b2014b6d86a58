"""Elements inside an article whose name says nothing for sure: their lines decide."""

from assayer.llm import extract

TEXT = "A sentence of some length that is text. " * 3
P = f"<p>{TEXT.strip()}</p>"


def inside(html):
    return extract.main_text(f"<nav><a href=1>Home</a></nav><article>{P}{html}<p>End.</p></article>").removeprefix(TEXT).removesuffix(" End.").removesuffix("End.")


def test_texts_that_are_named_like_lists_stay():
    assert inside(f'<section id="discussion"><h2>Discussion</h2>{P}</section>') == f"Discussion {TEXT.strip()}"
    assert inside('<div class="menu"><h3>Soup</h3><p>Boil water and salt.</p><p>Serve <a href=x>hot</a>.</p></div>') == "Soup Boil water and salt. Serve hot."
    assert inside('<div class="menu"><div class="menu">Only text in it.</div></div>') == "Only text in it."
    assert inside('<section id="notices">Short but plain</section>') == "Short but plain"


def test_lists_of_links_go():
    assert inside('<div class="menu"><a href=1>One</a><a href=2>Two</a> more</div>') == ""
    assert inside('<ul class="breadcrumb"><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>') == ""
    assert inside('<div class="related"><p><a href=1>Another article about things</a></p></div>') == ""


def test_sure_names_go_as_before():
    assert inside('<div class="discussion"><p>Nice post, I like it.</p></div>') == ""
    assert inside('<div class="menu"><p>Plain words here.</p><div class="ad">Buy it now, buy it now.</div></div>') == "Plain words here."
    assert inside('<div class="comments"><p>First!</p></div><aside class="menu">text</aside>') == ""


def test_windows_decide_there():
    page = f'<article>{P}<div class="menu"><a href=1>One</a> <a href=2>Two</a></div><div class="menu">{P}</div></article>'
    lines, marked = extract.lines_of(page)
    kept = {i for start, end in extract.stretches(extract.weights(lines, marked)) for i in range(start, end)}
    left_out = [lines[i][0] for i in range(len(lines)) if lines[i][0] and i not in kept]
    assert left_out == ["One Two"]
