"""Simple tree matching against its plain recursion, long sibling lists, layouts of one host, names inside an article."""

import random
import tracemalloc

from vigil.llm.html_extract import Reference, match_trees, matched_size, parse


def plain_size(a, b) -> int:
    """Simple tree matching as published: rows of siblings by dynamic programming, one recursion for every pair."""
    if a.tag != b.tag:
        return 0
    best = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + plain_size(x, y))
    return 1 + best[-1][-1]


def random_html(rng, depth=0) -> str:
    if depth == 4 or rng.random() < 0.2:
        return rng.choice(["one", "two", "three", ""])
    return "".join(f"<{t}>{random_html(rng, depth + 1)}</{t}>" for t in rng.choices(["div", "section", "ul"], k=rng.randint(0, 4)))


def test_matching_equals_the_plain_recursion():
    rng = random.Random(5)
    for _ in range(300):
        a, b = parse(random_html(rng)), parse(random_html(rng))
        pairs = match_trees(a, b)
        assert matched_size(a, b, {}) == plain_size(a, b) == 1 + len(pairs)
        assert all(x.tag == y.tag for x, y in pairs)
        order = {id(n): k for tree in (a, b) for k, n in enumerate(in_order(tree))}
        placed = sorted((order[id(x)], order[id(y)]) for x, y in pairs)
        assert [y for _, y in placed] == sorted({y for _, y in placed})  # one partner each, order kept
    assert len(match_trees(a, a)) == a.size - 1


def in_order(top):
    out, todo = [], [top]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += reversed(node.children)
    return out


def test_long_lists_of_siblings_are_matched_in_bounded_memory():
    a, b = (parse("<body><h1>t</h1>" + "".join(f"<p>{k} {i}</p>" for i in range(8000)) + f"<div>{k}</div><p>end</p>") for k in "xy")
    tracemalloc.start()
    pairs = match_trees(a, b)
    assert len(pairs) == a.size - 1 and tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()


def induced(reference: str, pages: list[str]) -> Reference:
    ref, sums = Reference(reference), {}
    for p in pages:
        for k, v in ref.vote(p).items():
            sums[k] = [x + y for x, y in zip(sums.get(k, (0, 0, 0)), v)]
    ref.induce([(k, *v) for k, v in sums.items()])
    return ref


def test_a_second_layout_does_not_hide_the_template_of_the_first():
    def first(k):
        return f"<body><div><div>same words on top</div><div><p>story {k} begins</p><p>story {k} ends after many words</p></div><div>all rights kept</div></div>"

    def other(k):
        return f"<body><section><h2>product {k}</h2><ul><li>price {k * 7}</li><li>size {k * 3}</li></ul></section>"
    ref = induced(first(0), [f(k) for k in range(1, 30) for f in (first, other)])
    assert ref.extract(first(99)) == "story 99 begins\n\nstory 99 ends after many words"


def test_names_of_content_inside_an_article_stay():
    page = ('<body><article><section id="related-work"><p>A</p></section><div class="search results-note">B</div><p class="notice-of-meeting">C</p>'
            '<p>x <math><mi>y</mi><mo>=</mo><mn>2</mn></math> z</p><xmp><b>&amp;</xmp><object>fallback</object>'
            '<div class="advert-box">no</div><p class="cookie notice">no</p><div id="commentlist">no</div><ul class="share-links"><li>no</ul></article>')
    assert Reference("").extract(page).split("\n\n") == ["A", "B", "C", "x y=2 z", "<b>&amp;", "fallback"]
