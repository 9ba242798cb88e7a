import html as H
import random

import numpy as np

from neighborflow.llm import html as M

from .corpora import prose

TREE = M.grow(*M.table())


def test_tree_fits_its_table():
    x, y = M.table()
    assert (M.classify(TREE, x) == (y == 1)).all()


def page(rng, with_main=True):
    paragraphs = [prose(rng, rng.choice([1, 5, 30, 120])) + rng.choice([" &amp; more", " é", "", " &lt;b&gt;"]) for _ in range(rng.randint(1, 6))]
    body = "".join(f"<p>{p}" + rng.choice(["</p>", ""]) for p in paragraphs)
    aside = f'<aside><p>{prose(rng, 30)}</p></aside>'
    links = "<ul>" + "".join(f'<li><a href="/{i}">{prose(rng, 2)}</a></li>' for i in range(4)) + "</ul>"
    parts = [f"<header><h1>{prose(rng, 3)}</h1>{links}</header>", f"<nav>{links}</nav>", f'<div class="cookie-notice">{prose(rng, 25)}</div>', f'<div class="ad">{prose(rng, 8)}</div>', "<script>var a = '<p>no</p>';</script><style>p{}</style>", f"<form><label>{prose(rng, 3)}</label><textarea>x</textarea></form>"]
    rng.shuffle(parts)
    article = f"<article><h2>Title &copy;</h2>{body}{aside}</article>" if with_main else body
    return "<!DOCTYPE html><html><head><title>T</title></head><body>" + "".join(parts[:3]) + article + "".join(parts[3:]) + f'<section id="comments"><p>{prose(rng, 40)}</p></section><footer>{links}<p>{prose(rng, 12)}</p></footer></body></html>', [" ".join(H.unescape(p).split()) for p in paragraphs]


def test_articles_whole_and_alone():
    rng = random.Random(1)
    for _ in range(60):
        source, want = page(rng)
        assert M.extract(source, TREE) == "\n".join(["Title ©", *want])


def test_page_without_main_container():
    long_ = "<div><p>" + "word " * 40 + "</p><p>" + "more " * 30 + "</p></div>"
    assert M.extract(f"<nav><a>x</a> <a>y</a></nav>{long_}<footer>words of the house at the end</footer>", TREE) == ("word " * 40).strip() + "\n" + ("more " * 30).strip()


def test_odd_pages():
    assert M.extract(None, TREE) == "" and M.extract("", TREE) == "" and M.extract("<article>", TREE) == ""
    assert M.extract("<article><p>a &#233;&nbsp;b\n c<br>d &amp e &am</p><!-- x", TREE) == "a é b c d & e &am"
    assert M.extract("<article>one<p>two<div>three</div></article>", TREE) == "one\ntwo\nthree"
    assert M.extract("<article>a < b <script>x</scripty></script> c<p hidden>no</p><p style='display:none'>no</p></article>", TREE) == "a < b c"
    assert M.extract("<main>" + "<div>" * 3000 + "deep" + "</div>" * 10, TREE) == "deep"


def test_frame(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>x y</p></article>", "c"), (2, None, None, "c"), (1, "u", "<article><p>x y</p></article>", "c")], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in M.extract_pages(df).orderBy("page_id").collect()]
    assert got == [(1, "u", "x y", 3), (1, "u", "x y", 3), (2, None, "", 0)]
    assert M.extract_pages(df.limit(0)).count() == 0
    assert np.isfinite(M.features(M.blocks("<p>a</p>"))).all()


def features_used(tree):
    return {M.FEATURES[tree[0]]} | features_used(tree[2]) | features_used(tree[3]) if isinstance(tree, tuple) else set()


def test_tree_uses_neighbours():
    used = features_used(TREE)
    assert {"words", "link density", "words before", "link density before", "link density after"} <= used


def in_article(extra):
    return f"<body><nav><a>x</a></nav><article><h1>T</h1><p>{'word ' * 30}</p>{extra}<p>{'more ' * 40}</p></article><footer>f</footer></body>"


def test_container_and_text_disagree():
    frame = ["T", ("word " * 30).strip(), ("more " * 40).strip()]
    for gone in ("<ul><li><a href=x>Read more</a></li></ul>", '<p><a href="x">Great shoes at shop now</a></p>', '<div class="ad-slot">Buy this now please</div>', '<div id="entry-comments"><p>' + "I agree with it " * 12 + "</p></div>", "<ul>" + ("<li><a href=x>" + "long title " * 12 + "</a></li>") * 4 + "</ul>"):
        assert M.extract(in_article(gone), TREE).split("\n") == frame, gone
    for stays, text in (
        ('<p class="intro social-history">It began in the year of our lord with a great deal of noise.</p>', "It began in the year of our lord with a great deal of noise."),
        ("<h2><a href=x>Linked title</a></h2>", "Linked title"),
        ('<p title="the hidden role of class">ok</p>', "ok"),
        ("<p>see <a href=x>this one</a> now</p>", "see this one now"),
    ):
        assert M.extract(in_article(stays), TREE).split("\n") == [*frame[:2], text, frame[2]], stays
    prose_ = "<p>" + "b " * 30 + "</p><p>" + "c " * 20 + "</p>"
    assert M.extract(f'<body><div class="post-notice">{prose_}</div></body>', TREE) == ("b " * 30).strip() + "\n" + ("c " * 20).strip()
    assert M.extract("<body><nav><a>x</a></nav><h1>Title of it</h1><p>One</p></body>", TREE) == "Title of it\nOne"
    assert M.extract(f'<body><form id="all"><div class="has-sidebar"><main>{prose_}</main></div></form></body>', TREE).count("\n") == 1


def test_parsing_is_linear():
    import time

    start = time.perf_counter()
    for page_ in ('<a "' * 250_000, "<div>" * 100_000 + "</section>" * 100_000, '<a href="' * 120_000, "<!--" * 250_000, "<script>" * 130_000, '<p class="x">' * 80_000, "<section>" + "<div>" * 100_000 + "</section>" * 100_000, "<" * 1_000_000):
        M.extract(page_, TREE)
    assert time.perf_counter() - start < 12
    assert M.extract("<article>&#9" + "9" * 100_000 + "; &#00000000065;</article>", TREE) == "� A"


def test_leaf_ties_keep():
    assert M.classify(0.5, np.zeros((2, 10))).all()


def test_class_names_of_texts_are_faint_hints():
    """A paragraph of an article stays under a name that contains a word of page furniture; a container's comments go."""
    prose = "The teacher wrote on the margin that every one of these words belongs to the story and should stay in it."
    page = f"<article><p>{prose}</p><p class='teacher-comment'>{prose}</p><li class='menu-of-the-day'>{prose}</li></article><div class='user-comments'><p>{prose}</p></div><p class='comment'>{prose}</p>"
    assert M.extract(page, M.grow(*M.table())) == "\n".join([prose] * 3)
