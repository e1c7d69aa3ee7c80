"""HTML extraction against a recursive walk over generated documents, and by examples."""

import html
import random

import pytest

from lodestone.llm import htmltext

TREE = htmltext.fit()


def used(tree):
    return set() if len(tree) == 1 else {htmltext.FEATURES[tree[0]]} | used(tree[2]) | used(tree[3])


def test_tree_decides_by_words_and_neighbours():
    assert {"words", "links", "words_before", "links_before"} <= used(TREE) and {"words_after", "links_after"} & used(TREE)
    rows = [(htmltext.features([b[:2] for b in page]), [b[2] for b in page]) for page in htmltext.LABELLED]
    assert all((htmltext.classify(TREE, x) == y).all() for x, y in rows)


LONG = "A paragraph with quite a few words in it, as they stand in articles."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<article><p>{LONG}</p><li class="share"><div>Share this now</div></li><td class="sidebar"><div>x</div></td></article>', LONG),
        (f'<article><p>{LONG}</p><div class="share-price">Now 12.5 euro</div></article>', f"{LONG}\n\nNow 12.5 euro"),
        (f'<form id="aspnetForm"><article><p>{LONG}</p></article></form>', LONG),
        (f'<form id="aspnetForm"><p>{LONG}</p><div class="search-box">Find <input></div></form>', LONG),
        ("<p>See <math><mi>x</mi><mo>=</mo><mn>1</mn></math> and <object>an object</object> here.</p>", "See x=1 and an object here."),
        (f"<p>{LONG}</p><p><a href=x>One link here</a></p><p>{LONG}</p>", f"{LONG}\n\nOne link here\n\n{LONG}"),
        (f"<form><label>Mail</label><p>Subscribe</p></form><p>{LONG}</p>", LONG),
        (f'<p>{LONG}</p><section id="comments"><p>{LONG}</p><article>{LONG}</article></section>', LONG),
        (f'<p>{LONG}</p><p>Click <button>Here</button> now</p><select><option>One</select>', f"{LONG}\n\nClick now"),
        ("<div><a>Home</a></div><div><a>About us</a></div><div><a>More</a></div><div>" + LONG + "</div><div><a>x</a></div><div><a>w</a></div><div>Follow</div><div><a>y z</a></div>", LONG),
        (f"<ul><li>one two three<li>four five six</ul><p>{LONG}", f"one two three\n\nfour five six\n\n{LONG}"),
        ('<div hidden><p>no</p></div><div style="display: none">no</div><header class="article-header"><p>no</p></header><article><header><h1>A title</h1></header></article>', "A title"),
        (f"<p>{LONG}</p>" * 3, "\n\n".join([LONG] * 3)),
    ],
)
def test_examples(page, text):
    assert htmltext.extract_many([page], TREE) == [text]


KINDS = [("div", ""), ("p", ""), ("section", ' class="wide"'), ("ul", ""), ("nav", ""), ("aside", ""), ("div", ' class="ad-slot"'), ("div", ' class="share-price"'), ("article", ""), ("header", ""), ("footer", ""), ("blockquote", ""), ("section", ' id="comments"'), ("h2", "")]


def grown(r, depth):
    """A random element: (tag, attributes, children); children are elements, links or texts."""
    tag, extra = r.choice(KINDS)
    inside = []
    for _ in range(r.randrange(1, 5)):
        words = " ".join(r.choice(["word", "é&x", "<b>", "a"]) for _ in range(r.choice([1, 2, 5, 20])))
        if depth and tag not in ("p", "h2") and r.random() < 0.6:
            inside.append(grown(r, depth - 1))
        else:
            inside.append(("a" if r.random() < 0.3 else "", "", [words]))
    return tag, extra, inside


def written(e):
    tag, extra, inside = e
    body = "".join(html.escape(x) if isinstance(x, str) else written(x) for x in inside)
    return f"<{tag}{extra}>{body}</{tag}>" if tag not in ("", "a") else f" <a href='x'>{body}</a> " if tag else f" {body} "


def walked(e, outside, article):
    """The (text, words, linked words) of the flat blocks of an element, and None where a block ends."""
    tag, extra, inside = e
    if tag in ("", "a"):
        words = inside[0].split()
        return [] if outside else [(words, len(words) if tag else 0)]
    comment = outside == "comment" or "comments" in extra
    gone = outside or tag in ("nav", "aside", "footer") or "ad-slot" in extra or tag == "header" and not article
    gone = "comment" if comment else "" if tag == "article" else gone
    out = [None]
    for x in inside:
        out += walked(x, gone, article or tag == "article")
    return out + [None]


def naive_label(tree, row):
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


@pytest.mark.parametrize("seed", range(30))
def test_pages_equal_a_recursive_walk(seed):
    r = random.Random(seed)
    roots = [grown(r, 3) for _ in range(4)]
    runs, open_ = [], []
    for piece in [x for e in roots for x in walked(e, "", False)] + [None]:
        if piece is None:
            runs, open_ = runs + ([open_] if open_ else []), []
        else:
            open_ = open_ + [piece]
    blocks = [(" ".join(w for words, _ in run for w in words), sum(len(words) for words, _ in run), sum(n for _, n in run)) for run in runs]
    facts = [(n, links / n) for _, n, links in blocks]
    at = lambda k: facts[k] if 0 <= k < len(facts) else (0, 0)
    kept = [b[0] for k, b in enumerate(blocks) if naive_label(TREE, [f[c] for c in (1, 0) for f in (facts[k], at(k - 1), at(k + 1))])]
    assert htmltext.extract_many(["<body>" + "".join(map(written, roots)) + "</body>"], TREE) == ["\n\n".join(kept)]
