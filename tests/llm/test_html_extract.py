import random

import pytest

from sedge.llm import html_extract as h

SCHEMA = "page_id long, url string, html string, text int, n_chars int"
BODY = "<h1>Great &amp; small</h1><p>First long paragraph with many words in it.<p>Second <b>bold</b>ly\n\n  spaced &lt;one&gt;.<br>Line.</p>"
TEXT = "Great & small First long paragraph with many words in it. Second boldly spaced <one>. Line."
AROUND = [
    '<nav><ul><li><a href="/x">Home</a></li></ul></nav>',
    "<header><p>The name of this site and what it is about, at length</p></header>",
    "<footer>&copy; somebody and all the small print that nobody reads at all</footer>",
    '<div class="ad">Buy this thing now, it is the best thing that you can buy</div>',
    '<aside><p>See also these many other long stories that we have written</p></aside>',
    '<div id="cookie-notice"><p>We use cookies and want you to agree to all of them now</p></div>',
    '<form><label>Write to us about what you think</label><input name="q"><button>Go</button></form>',
    '<section class="comments"><p>I have read this and I do not agree with one word of it</p></section>',
    "<script>var t='</p><article>';</script><style>p{margin:0}</style><!-- <p>not here</p> -->",
    '<div role="complementary"><p>Something beside the point, told in quite some words</p></div>',
]


def test_article_is_told_from_what_stands_around_it():
    rng = random.Random(1)
    for _ in range(50):
        a, b = (" ".join(rng.sample(AROUND, 4)) for _ in range(2))
        assert h.main_text(f"<!DOCTYPE html><html><head><title>T</title></head><body>{a}<article>{BODY}</article>{b}</body></html>") == TEXT
        assert h.main_text(f'<body>{a}<div class="content"><div>{BODY}</div></div>{b}') == TEXT


def test_boilerplate_inside_the_article_goes():
    assert h.main_text(f'<article><header>{BODY}</header><div class="share">Tell all your friends about it now</div></article>') == TEXT


def test_cut_equals_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 7)
        costs = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < 0.6]

        def cost(keep):
            return sum(c for c, k in zip(costs, keep) if c > 0 and not k) + sum(-c for c, k in zip(costs, keep) if c < 0 and k) + sum(w for a, b, w in edges if keep[a] != keep[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(h.min_cut(costs, edges)) == pytest.approx(best, abs=1e-6)


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "a < b", "<!--", "<script>x", "</div></p>", "<p>" * 3000, "<b>" * 3000 + "x", '<a href="x>y">', "&#0;&bogus;&#x110000;"])
def test_broken_pages_give_text(page):
    assert isinstance(h.main_text(page), str)


def test_rows(spark):
    rows = [(1, "u", f"<article>{BODY}</article>", 1, 1), (1, "u", f"<article>{BODY}</article>", 1, 1), (None, None, None, None, None), (2, "v", "", 0, 0)]
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in h.extract(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, "", "", 0), (1, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT)), (2, "v", "", 0)]
    assert h.extract(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        '<body class="has-sidebar"><article>%s</article>',
        '<body><div class="post no-comments">%s</div>',
        '<body><main class="search-open">%s</main>',
        '<article><div class="promo-free">%s</div></article>',
        '<body><div class="sidebar-layout"><article>%s</article><div class="sidebar"><p>Other things to read, many of them.</p></div></div>',
        '<article>%s</article><section class="comments">' + "<p>I have read this all and do not agree with a word of it.</p>" * 40 + "</section>",
        '<article>%s<section id="comments"><article class="comment"><p>I have read this, all of it, and disagree.</p></article></section></article>',
    ],
)
def test_names_of_state_and_of_wrappers_do_not_empty_a_page(page):
    assert h.main_text(page % BODY) == TEXT


def test_math_and_hidden_text_stay():
    assert h.main_text(f"<article>{BODY}<math>x</math></article>") == TEXT + " x"
    assert h.main_text(f"<article>{BODY}<p hidden>Not shown.</p></article>") == TEXT + " Not shown."


def test_the_cut_decides_against_the_costs_of_blocks():
    page = f'<body><article>{BODY}<p>Ok</p></article><div class="ad">Buy this thing now, it is the best thing of all that you can buy today.</div>'
    found = h.blocks(page)
    kept = h.label(found)
    alone = [h.own_cost(b) > 0 for b in found]
    assert [b[0] for b, k, a in zip(found, kept, alone) if k and not a][-1] == "Ok"
    assert [b[0][:3] for b, k, a in zip(found, kept, alone) if a and not k] == ["Buy"]


def whole_graph(found, weights=h.PRIOR):
    """Costs and edges of a page's graph, built anew from what the docstring says."""
    nodes, costs, edges = {}, [h.own_cost(b, weights) for b in found], []
    total = sum(len(b[0]) for b in found)
    under = lambda e: [b for b in found if e in list(up(b[1]))]

    def up(node):
        while node:
            yield node
            node = node.parent

    for b in found:
        for e in up(b[1]):
            if e not in nodes:
                nodes[e] = len(costs)
                below = under(e)
                much = e.by_class and sum(len(x[0]) for x in below) > h.MOST * total
                costs.append(e.lean * len(below) * (h.LESS if much else 1))
    for e, i in nodes.items():
        if e.parent:
            edges.append((i, nodes[e.parent], h.EDGES["part" if e.lean or e.tag in h.PART_TAGS else "text" if e.tag in h.TEXT_TAGS | h.CELL_TAGS else "plain"]))
    for i, b in enumerate(found):
        edges.append((i, nodes[b[1]], h.EDGES["text"]))
        if i:
            edges.append((i - 1, i, h.NEXT / (1 + h.distance(found[i - 1][1], b[1]))))
    return costs, edges


def test_labels_of_whole_pages_are_a_least_cut():
    rng = random.Random(8)
    for _ in range(40):
        parts = [f"<{t}{rng.choice(['', ' class=ad', ' class=post', ' class=site-nav'])}>{rng.choice(['Ok', 'A long line of words that goes on and on for a while.', '<a href=x>Home</a>'])}</{t}>" for t in rng.choices(["p", "div", "nav", "article", "footer"], k=4)]
        found = h.blocks("<body>" + "".join(parts))
        costs, edges = whole_graph(found)
        n = len(costs)
        if n > 14:
            continue

        def cost(keep):
            return sum(c for c, k in zip(costs, keep) if c > 0 and not k) + sum(-c for c, k in zip(costs, keep) if c < 0 and k) + sum(w for a, b, w in edges if keep[a] != keep[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        kept = h.label(found)
        least = min(cost(kept + [bool(m >> i & 1) for i in range(n - len(found))]) for m in range(1 << (n - len(found))))
        assert least == pytest.approx(best, abs=1e-6)


def test_learnt_weights(spark):
    rng = random.Random(3)
    rows = [(i, "u", "<body>" + " ".join(rng.sample(AROUND, 4)) + f"<article>{BODY}</article>", 0, 0) for i in range(30)]
    pages = spark.createDataFrame(rows, SCHEMA)
    weights = h.learn(pages, sample=20)
    assert weights != h.PRIOR and weights == h.learn(pages.repartition(3), sample=20)
    assert weights[2] < 0  # links speak against content
    assert h.learn(pages.limit(0)) == h.PRIOR


def test_weights_do_not_follow_the_order_of_rows(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, "u", "<body>" + " ".join(rng.sample(AROUND, 4)) + f"<article>{BODY}</article>", 0, 0) for i in range(30)]
    pages, seen, fit = spark.createDataFrame(rows, SCHEMA), [], h.fit
    monkeypatch.setattr(h, "fit", lambda labels, x: seen.append((labels.tolist(), x.tolist())) or fit(labels, x))
    weights = [h.learn(p) for p in (pages.coalesce(1), spark.createDataFrame(rows[::-1], SCHEMA).coalesce(1), pages.repartition(4))]
    assert seen[0] == seen[1] == seen[2] and weights[0] == weights[1] == weights[2]
