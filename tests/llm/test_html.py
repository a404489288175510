import random

import pytest

from quantaloom.llm import html


def page(i, body, menu="<li><a href='/a'>Home</a></li>"):
    return f"<!DOCTYPE html><html><head><title>T{i}</title><script>var x='<p>no</p>'</script></head><body><nav><ul>{menu * (i % 4 + 1)}</ul></nav><div class='ad'>Buy {i}</div>{body}<footer>&copy; {i}</footer>"


def test_article():
    body = "<article><h1>One &amp; two</h1><p><b>Three\n  four<br><p>f&#105;ve</p><div class=comments><p>spam</p></div></article>"
    assert html.extract_group([page(1, body)]) == ["One & two Three four five"]


def test_induces_template_without_semantics():
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    pages, want = [], []
    for _ in range(12):
        paragraphs = [" ".join(word() for _ in range(rng.randint(20, 40))) for _ in range(rng.randint(2, 6))]
        text = "".join(f"<p>{p}</p>" for p in paragraphs)
        pages.append(f"<html><body><div><a href=/>Start</a> | <a href=/x>Other</a></div><div><div><span>Written by the staff</span>{text}</div></div><div><p>All rights reserved by us.</p></div>")
        want.append(" ".join(paragraphs))
    assert html.extract_group(pages) == want


def matched(a, b):
    matcher = html.Matcher()
    a, b = html.parse(a), html.parse(b)
    matcher.shape(a)
    matcher.shape(b)
    return matcher, a, b, matcher.align(a[0], b[0])


def largest(a, b):
    """Simple tree matching by its definition: the size of the largest match of two trees of equal roots."""
    left, right = a.elements(), b.elements()
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, x in enumerate(left, 1):
        for j, y in enumerate(right, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + (largest(x, y) if x.key == y.key else 0))
    return 1 + best[-1][-1]


def test_alignment_is_simple_tree_matching(monkeypatch):
    assert len(matched("<ul><li><b>x</b></li><li>y</li></ul>", "<ul><li>q</li><li><b>z</b></li><li>y</li></ul>")[3]) == 5
    rng = random.Random(7)

    def some(depth):
        return "".join(f"<{t}>{some(depth - 1) if depth else 'x'}</{t}>" for t in rng.choices(["div", "b", "i", "section"], k=rng.randint(0, 5)))

    for kept, small in ((html.KEPT, html.SMALL), (3, 0), (3, 400)):
        monkeypatch.setattr(html, "KEPT", kept)
        monkeypatch.setattr(html, "SMALL", small)
        for _ in range(60):
            matcher, a, b, pairs = matched(some(3), some(3))
            want = largest(a[0], b[0])
            assert len(pairs) == want == matcher.size(a[0].shape, b[0].shape)
            assert all(x.key == y.key and (x.parent is None or (x.parent, y.parent) in set(pairs)) for x, y in pairs)


@pytest.mark.parametrize("cells", [0, 1, 4, 30])
def test_long_child_lists_are_matched_exactly(monkeypatch, cells):
    """The match does not depend on how many pairs of different shapes two child lists make."""
    rng = random.Random(11)

    def some(depth):
        return "".join(f"<{t}>{some(depth - 1) if depth else 'x'}</{t}>" for t in rng.choices(["div", "b", "i"], k=rng.randint(0, 6)))

    for kept, small in ((html.KEPT, html.SMALL), (3, 0)):
        for _ in range(40):
            a, b = some(3), some(3)
            monkeypatch.undo()
            want = [(x.key, y.key) for x, y in matched(a, b)[3]]
            monkeypatch.setattr(html, "CELLS", cells)
            monkeypatch.setattr(html, "KEPT", kept)
            monkeypatch.setattr(html, "SMALL", small)
            matcher, x, y, pairs = matched(a, b)
            assert len(pairs) == len(want) == matcher.size(x[0].shape, y[0].shape) == largest(x[0], y[0])
            if kept > 3:
                assert [(x.key, y.key) for x, y in pairs] == want


def test_many_different_children():
    """Beyond CELLS pairs of different shapes, children weigh by their match and not by their size."""
    rng = random.Random(5)
    kids = lambda n: ["<p>" + "".join(f"<{t}>x</{t}>" for t in rng.choices(["b", "i", "u", "em", "q", "s"], k=rng.randint(4, 8))) + "</p>" for _ in range(n)]
    common = kids(30)
    left, right = kids(700), kids(800)
    for k, one in enumerate(common):
        left.insert(20 * k, one)
        right.insert(25 * k, one)
    matcher, a, b, pairs = matched(f"<div>{''.join(left)}</div>", f"<div>{''.join(right)}</div>")
    assert len(left) * len(right) > html.CELLS and len(pairs) == matcher.size(a[0].shape, b[0].shape)


def test_long_lists_and_deep_trees():
    a, b = ("<div>" + "".join(f"<{t}>x</{t}>" for t in random.Random(k).choices(["b", "i", "u"], k=4000)) for k in (1, 2))
    assert len(matched(a, b)[3]) > 2500
    deep = "<article>" + "<div>" * 20_000 + "<p>deep</p><nav>menu</nav>" + "</div>" * 20_000 + "<p>deep after</p></article><p>out</p>"
    assert html.extract_group([deep] * 2 + [deep.replace("deep", f"deep {i}") for i in range(5)])[3:5] == ["deep 1 deep 1 after", "deep 2 deep 2 after"]


def word(rng):
    return "".join(rng.choices("abcdefgh", k=6))


def written(rng, decoy):
    """A page made of known parts, and its article as the plain joined texts of these parts."""
    parts = [" ".join(word(rng) for _ in range(rng.randint(15, 30))) for _ in range(rng.randint(2, 7))]
    teaser = f"<div><article><p>{word(rng)} {word(rng)}</p></article></div>" if decoy else ""
    inner = "".join(f"<p>{x}</p>" for x in parts)
    return f"<html><body><div><a href=/>{word(rng)}</a><a href=/b>{word(rng)}</a></div>{teaser}<div><section><h2>Our column</h2>{inner}</section></div><div>All rights reserved</div></body>", " ".join(parts)


@pytest.mark.parametrize("decoy", [False, True])
def test_wrapper_decides(decoy):
    """The region and the template come from the alignment: without it the decoy, or the whole page, is taken."""
    rng = random.Random(3)
    pages, want = zip(*(written(rng, decoy) for _ in range(20)), strict=True)
    assert html.extract_group(list(pages)) == list(want)
    lone = [html.Wrapper([]).text(html.parse(p)) for p in pages]
    assert all(x != y for x, y in zip(lone, want, strict=True))


@pytest.mark.parametrize("text", [None, "", "<", "<p", "a < b", "<!-- open", "<script>open", "<p>" * 5000, "<div>" * 3000 + "x", "<a b='" * 2000, "plain &lt;p&gt;", "x" * 300_000])
def test_odd_pages(spark, text):
    pages = spark.createDataFrame([(1, None, text, "k")], "page_id long, url string, html string, text string")
    row = html.extract(pages).first()
    assert row["page_id"] == 1 and row["url"] is None and row["n_chars"] == len(row["text"])
    if text in ("a < b", "plain &lt;p&gt;"):
        assert row["text"] == text.replace("&lt;", "<").replace("&gt;", ">")


def test_hot_host(spark, monkeypatch):
    monkeypatch.setattr(html, "GROUP", 10)
    rows = [(i, f"http://h{i % 7 % 2}.example/{i}", page(i, f"<article><p>text {i}</p></article>")) for i in range(60)] + [(3, "http://h1.example/3", page(3, "<article><p>text 3</p></article>"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"], r["text"]) for r in html.extract(pages).collect())
    assert got == sorted((i, f"text {i}") for i in [*range(60), 3])
    assert html.extract(pages.limit(0)).collect() == []
