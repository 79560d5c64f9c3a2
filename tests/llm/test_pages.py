"""URL rules and templates, and main text of pages."""

import random

import numpy as np
import pytest

from lexmill.llm import html_extraction, url_filter
from lexmill.llm.boosting import fit_trees
from lexmill.llm.html_extraction import Page, features
from lexmill.llm.queries import URL_RULES

URLS = [
    "https://a.Example.ORG/es/1?x#y", "http://example.org/en/12/", "http://example.org/en/2", "http://notexample.org/es/3", "https://b.com/fr/1", "https://b.com/de/1",
    "https://b.com/de", "https://org", "https://x.org", "http://x.org?/de/", "ftp://h#/f", "no scheme", "://", "", None, "a://b://c/d", "http://ÄB.com/de/é#", "https://b.com/en/1", "http://net/de/1", "http://net/en/9",
]


def brute(url):
    """Host, path, rule and verdict of the rules by plain string work."""
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for rule, verdict in URL_RULES:
        name, slash, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + start) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best and best[0], best and best[1]


def test_rules_equal_brute_force(spark):
    urls = URLS + URLS[:5]
    df = spark.createDataFrame([(i, u, "h", "p", 1, "t") for i, u in enumerate(urls)], "page_id long, url string, host string, segment string, n int, template string")
    made = {r["page_id"]: r for r in url_filter.judge(df, URL_RULES).collect()}
    assert len(made) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute(u)
        assert (made[i]["host"], made[i]["path"], made[i]["rule"]) == (host, path, rule)
        assert made[i]["verdict"] == verdict if verdict else made[i]["verdict"] in ("allow", "block")
        if not host:
            assert made[i]["verdict"] == "allow"


def test_templates_learn_from_their_branch(spark):
    """Unlabelled urls follow labelled ones of their template; numbers and ever new names become wildcards."""
    rules = [("h.com/spam/a", "block"), ("h.com/news/a", "allow")]
    rng = random.Random(1)
    urls = [f"http://h.com/{part}/{c}{rng.randint(0, 9999)}x" for part in ("spam", "news") for c in "ab" for _ in range(40)]
    urls += [f"http://h.com/new/{''.join(rng.choices('defgh', k=6))}" for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    made = url_filter.judge(df, rules).collect()
    spam, news = ([r for r in made if f"/{p}/b" in r["path"]] for p in ("spam", "news"))
    assert {r["verdict"] for r in spam} == {"block"} and {r["verdict"] for r in news} == {"allow"}
    assert {r["template"].split("/")[-1] for r in made if "/new/" in r["path"]} == {"*"}
    assert url_filter.judge(df.limit(0), rules).count() == 0


def article(i, rng, wrap="article"):
    words = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(8, 60))) + "." for _ in range(rng.randint(2, 6))]
    body = f"<h1>T{i} &amp; x</h1>" + "".join(f"<p><b>{w}<br><p>" if k % 3 == 1 else f"<p>{w}</p>" for k, w in enumerate(words))
    page = f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">Menu {i}</a></li><li><a>b</a></li></ul></nav><!-- x --><div class="ad">Buy it {i}.</div><{wrap}>{body}</{wrap.split()[0]}><footer>&copy; host {i}</footer></body></html>'
    return page, " ".join([f"T{i} & x", *words])


def test_extraction(spark):
    rng = random.Random(3)
    pages = [article(i, rng) for i in range(60)]
    rows = [(i, f"u{i}", html, 1) for i, (html, _) in enumerate(pages)]
    rows += [(100, None, None, 2), (101, "u", "", 2), (102, "u", "   ", 2), (103, "u", "<div><nav>x</nav></div>", 3), (104, "u", "<" * 50 + "p" * 10, 4), (0, "u0", pages[0][0], 1), (105, "u", "<div>" * 3000 + "deep", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    model = html_extraction.fit(df)
    made = {r["page_id"]: r for r in html_extraction.extract(df, model).collect()}
    assert len(made) == len({r[0] for r in rows})
    assert all(made[i]["text"] == text for i, (_, text) in enumerate(pages))
    assert all(made[i]["text"] == "" and made[i]["n_chars"] == 0 for i in (100, 101, 102))
    assert all(r["n_chars"] == len(r["text"]) for r in made.values())
    other, text = article(7, rng, 'div class="post-content"')
    page = Page(other)
    scored, own = features(page.measures())
    assert page.text(model.score(scored), own) == text


def test_extraction_without_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extraction.extract(df, html_extraction.fit(df)).count() == 0


def test_no_node_is_kept_below_a_dropped_one():
    rng = np.random.RandomState(0)
    page = Page("<div>a<p>b</p><div>c<p>d</p></div></div><p>e</p>")
    for _ in range(50):
        scores = rng.normal(size=len(page.tags))
        own = rng.uniform(1, 9, len(page.tags))
        gains, best = scores * np.log1p(own), 0.0
        for mask in range(1 << len(page.tags)):
            keep = [mask >> i & 1 for i in range(len(page.tags))]
            if all(not k or page.parent[i] < 0 or keep[page.parent[i]] for i, k in enumerate(keep)):
                best = max(best, sum(g for g, k in zip(gains, keep, strict=True) if k))
        kept = page.text(scores, own).split()
        got = page.text(scores, own)
        node_of = {text: node for node, text, _ in page.runs if text != " "}
        chosen = {node_of[t] for t in kept}
        while True:
            more = chosen | {page.parent[i] for i in chosen if page.parent[i] >= 0}
            if more == chosen:
                break
            chosen = more
        assert sum(gains[i] for i in chosen) <= best + 1e-9 and (got == "" or best > 0)


@pytest.mark.parametrize("n", [0, 1, 40])
def test_trees(n):
    rng = np.random.RandomState(1)
    rows = rng.normal(size=(n, 3))
    labels = (rows[:, 0] > 0.1).astype(float)
    scores = fit_trees(rows, labels).score(rows)
    assert len(scores) == n
    if n == 40:
        assert ((scores > 0) == (labels > 0)).mean() > 0.95
