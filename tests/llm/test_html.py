"""HTML extraction: generated pages with known main text, damaged pages, odd rows."""

import random
import time

import numpy as np
import pytest

from atril.llm import html_text

WORDS = "sun river stone green walks under quiet märz naïve light seven garden over late".split()
TREE = html_text.train()


def page(rng: random.Random) -> tuple[str, str]:
    """A page and its main text: a menu, an advert or notice, an article in one of several wrappers, comments, a footer."""
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    lines, body = [], []
    for _ in range(rng.randint(2, 9)):
        text = say(rng.choice([1, 2, 5, 9, 14, 40, 90, 200]))
        tag = rng.choice(["p", "p", "p", "h2", "li", "blockquote"])
        shown = text.replace(" ", rng.choice([" ", "\n ", "&nbsp;", " <b>", "  "]), 1) if " " in text else text
        lines.append(text)
        body.append(f"<{tag}>{shown}" + (f"</{tag}>" if rng.random() < 0.7 or tag == "h2" else ""))
    title = say(rng.randint(2, 12))
    tag, wrap = rng.choice([("article", "<div class='page has-sidebar'>"), ("main", "<div id=content>"), ("div role=main", ""), ("article class=post", "<section>")])
    menu = "".join(f"<li><a href=/{k}>{rng.choice(WORDS)}</a>" for k in range(rng.randint(1, 6)))
    extra = rng.choice([f"<div class='ad'>{say(6)}</div>", f"<aside><h3>{say(2)}</h3><p>{say(50)}</p></aside>", f"<div class=cookie-notice>{say(12)} <button>{say(1)}</button></div>", f"<form><label>{say(2)}</label><select><option>{say(1)}</select></form>"])
    made = f"<html><head><title>{title}</title><style>p {{}}</style><script>if (a < b) x('</p>')</script></head><body><nav><ul>{menu}</ul></nav>{extra}{wrap}<{tag}><h1>{title}</h1>{''.join(body)}<div class=comments><p>{say(30)}</p></div></{tag.split()[0]}><footer>&copy; {say(8)}</footer>"
    return made, "\n".join([title, *lines])


def test_generated_pages(spark):
    rng = random.Random(12)
    rows = [(k, f"u{k}", *page(rng)) for k in range(300)]
    got = {r.page_id: r for r in html_text.main_text(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    for k, url, _, want in rows:
        assert (got[k].url, got[k].text, got[k].n_chars) == (url, want, len(want))


def test_counts_decide_most_blocks():
    x, y = html_text.labelled()
    assert (TREE(x) == y).all() and (TREE.feature[:3] < html_text.COUNTS).all()
    plain = html_text.Tree(x[:, : html_text.COUNTS], y)
    found = [html_text.features(html_text.blocks(page(random.Random(k))[0])) for k in range(100)]
    same = np.concatenate([TREE(f) == plain(f[:, : html_text.COUNTS]) for f in found])
    assert same.mean() > 0.7


def test_pages_without_articles():
    long = " ".join(["word"] * 40)
    text = f"<ul><li><a href=/>x</a><li><a href=/>y</a></ul><h2>a short heading of six words</h2><p>{long}</p><p>{long} <a href=/>z</a></p><ul><li><a href=/>x</a><li><a href=/>y</a></ul>"
    assert html_text.extract(text, TREE) == f"a short heading of six words\n{long}\n{long} z"


@pytest.mark.parametrize(
    "text",
    [
        "<nav><button>Menu<main><p>{}</p></main>",
        "<button>Menu<main><p>{}</p></main>",
        "<article><select><option>a<option>b<p>{}</p></article>",
        "<article><noscript><p>{}</p></article>",
        "<article><p>{}<template>",
        "<article><a name=top><p>{}</p></article>",
        "<ARTICLE><P STYLE=x>{}</ARTICLE>",
        "<article><p title='a>b' class=x>{}</i></b></p>",
        "<article><p>{}<!-- cut",
        "<article><p>{}<p hidden>no<p style='display: none'>no</article>",
        "<article><p>{}<svg><text>no</text></svg><iframe src=x>no</iframe></article>",
    ],
)
def test_damaged_pages(text):
    long = " ".join(["word"] * 30)
    assert html_text.extract(text.format(long), TREE) == long


def test_linear_in_depth():
    for text in ("<div>x" * 150_000, "<p><b>x" * 150_000, "</i><div></span>x" * 60_000, "<a href=/><li>x" * 60_000):
        began = time.time()
        html_text.extract(text, TREE)
        assert time.time() - began < 6


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", None, "clash", 5), (2, None, "", "clash", 5), (None, "u", "<article>one <b>two", None, None), (3, "u", "<p>a<p>b", "", 1), (3, "u", "<p>a<p>b", "", 1)]
    got = html_text.main_text(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and {r.page_id: r.text for r in got}[None] == "one two" and all((r.text, r.n_chars) == ("", 0) for r in got if r.page_id in (1, 2))
    assert html_text.main_text(spark.createDataFrame([], schema)).count() == 0


def test_references_without_semicolon(spark):
    rows = [(1, "u", "<article><h1>this &amp;&amp</h1><p>a&ltb &copy; &#39;&#x41; &notit; &quo</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert html_text.main_text(pages).first().text == "this &&\na<b © 'A ¬it; &quo"
    assert html_text.main_text(pages, html_text.ended_references).first().text == "this &&amp\na&ltb © 'A &notit; &quo"


def test_articles_of_cut_headings_are_those_of_sql(spark, tmp_path):
    import duckdb

    from atril.llm import queries

    long = " ".join(["word"] * 60)
    rows = [(k, f"u{k}", f"<html><body><nav><a href=/>x</a></nav><article><h1>{head} and a few words more {head}</h1><p>{long} &amp; more</p></article></body></html>") for k, head in enumerate(["R&amp;D of&amp", "less &l", "cut&quo", "whole &lt;"])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.llm_html_articles(spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(db.execute(queries.ORACLE_SQL["llm_html_articles"]).fetchall())
