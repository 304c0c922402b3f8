"""URL rules read by hand, and the language models against a dictionary version."""

import math
import random
from collections import Counter, defaultdict

import pytest

from slicekit.llm import urls as U

from .helpers import with_clashes

PAGES = "page_id long, url string, html string"

CASES = [
    ("http://a.example.com/fr/1", "a.example.com", "/fr/1", "com/", "allow"),
    ("https://example.com/en/1?x=/en/", "example.com", "/en/1", "example.com/en/", "block"),
    ("https://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
    ("https://WWW.Example.com/en/x#t", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("https://a.www.example.com/en/x", "a.www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("https://notexample.com/en/x", "notexample.com", "/en/x", "com/", "allow"),
    ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
    ("http://x.net/fr", "x.net", "/fr", None, None),
    ("http://x.com", "x.com", "", None, None),
    ("http://x.com?a=/", "x.com", "", None, None),
    ("x.com/en/", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("a://b://c.com/x", "b:", "//c.com/x", None, None),
    ("http://xcom/", "xcom", "/", None, None),
    ("http://É.COM/\nq", "É.com", "/\nq", "com/", "allow"),
]


def _pages(spark, urls):
    return spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], PAGES).repartition(2)


def test_rules(spark):
    got = {r.page_id: r for r in U.filter_urls(with_clashes(_pages(spark, [c[0] for c in CASES] * 2))).collect()}
    assert len(got) == 2 * len(CASES)
    for i, (_, host, path, rule, verdict) in enumerate(CASES * 2):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


class _PlainModel:
    def __init__(self, urls):
        self.n, self.follow = Counter(), defaultdict(set)
        for u in urls:
            s = b"\x00" * U.ORDER + u.lower().encode() + b"\x01"
            for i in range(U.ORDER, len(s)):
                for k in range(U.ORDER + 1):
                    self.n[k, s[i - k:i], s[i]] += 1
                    self.n[k, s[i - k:i]] += 1
                    self.follow[k, s[i - k:i]].add(s[i])

    def log(self, u):
        s, out = b"\x00" * U.ORDER + (u or "").lower().encode() + b"\x01", []
        for i in range(U.ORDER, len(s)):
            p = 1 / 256
            for k in range(U.ORDER + 1):
                n, t = self.n[k, s[i - k:i]], len(self.follow[k, s[i - k:i]])
                if n:
                    p = (self.n[k, s[i - k:i], s[i]] + t * p) / (n + t)
            out.append(math.log(p))
        return sum(out) / len(out)


def test_ratio_equals_the_plain_models(spark, monkeypatch):
    monkeypatch.setattr(U, "SLOTS", 1 << 23)  # hardly any slot is shared
    rng = random.Random(1)
    good = [f"http://good{rng.randint(1, 9)}.org/read/{rng.randint(1, 999)}" for _ in range(60)]
    bad = [f"http://spam{rng.randint(1, 9)}.biz/win-{rng.randint(1, 999)}" for _ in range(40)]
    rows = [(u, True) for u in good] + [(u, False) for u in bad]
    model = U.fit_model(spark.createDataFrame(rows, "url string, accepted boolean").repartition(3))
    a, b = _PlainModel(good), _PlainModel(bad)
    asked = good[:3] + bad[:3] + ["http://other.org/win", "", None, "é中"]
    for u, got in zip(asked, model.ratio(asked)):
        assert got == pytest.approx(a.log(u) - b.log(u), abs=0.01)


def test_unmatched_urls_follow_what_rules_taught(spark):
    rng = random.Random(2)
    rules = (("allow", "good.org", "/"), ("block", "spam.biz", "/"))
    urls = [f"http://{h}.good.org/read/{rng.randint(1, 999)}.html" for h in "abcdefghij" for _ in range(20)]
    urls += [f"http://{h}.spam.biz/win-now?{rng.randint(1, 999)}" for h in "abcdefghij" for _ in range(20)]
    asked = ["http://x.other.org/read/12.html", "http://x.other.biz/win-now?77"]
    got = {r.page_id: r for r in U.filter_urls(_pages(spark, urls + asked), rules).collect()}
    assert [got[len(urls)].verdict, got[len(urls) + 1].verdict] == ["allow", "block"]
    assert got[len(urls)].rule is None


def test_one_kind_of_label_or_none(spark):
    only = lambda urls, rules: {r.verdict for r in U.filter_urls(_pages(spark, urls), rules).collect()}
    assert only(["http://a.b/", None], ()) == {"allow"}
    assert only(["http://a.b/", "http://c.d/"], (("block", "b", "/"),)) == {"block"}
    assert only(["http://a.b/", "http://c.d/"], (("allow", "b", "/"),)) == {"allow"}
    assert U.filter_urls(_pages(spark, [])).count() == 0


def _labelled(rng, n):
    name = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=rng.randint(2, 12)))
    return [(f"http://{name()}.{'org' if ok else 'biz'}/{name()}/{name()}", ok) for ok in (True, False) for _ in range(n)]


@pytest.mark.parametrize("bound", [0, 1 << 19])
def test_any_number_of_grams_is_counted_exactly(spark, monkeypatch, bound):
    monkeypatch.setattr(U, "SLOTS", bound)  # 0: by joins
    rows = _labelled(random.Random(3), 400)
    model = U.fit_model(spark.createDataFrame(rows, "url string, accepted boolean").repartition(3))
    a, b = (_PlainModel([u for u, ok in rows if ok is kind]) for kind in (True, False))
    asked = [u for u, _ in rows[::40]] * 2 + ["http://other.org/win", "http://q.biz/", "", None, "é中"]
    scored = model.score(_pages(spark, asked))
    assert scored.columns == ["page_id", "url", "html", "llr"]
    got = {r.page_id: r.llr for r in scored.collect()}
    assert len(got) == len(asked)
    for i, u in enumerate(asked):
        assert got[i] == pytest.approx(a.log(u) - b.log(u), abs=1e-9)


def test_joins_give_the_verdicts_of_the_broadcast_model(spark, monkeypatch):
    urls = [u for u, _ in _labelled(random.Random(4), 150)] + [None, "", "http://x.net/a"]
    rules = (("allow", "org", "/a"), ("allow", "org", "/b"), ("block", "biz", "/a"), ("block", "biz", "/b"))
    pages = _pages(spark, urls + urls[:5])
    rows = []
    for bound in (1 << 19, 0):
        monkeypatch.setattr(U, "SLOTS", bound)
        rows.append(sorted(U.filter_urls(pages, rules).collect()))
    assert len(rows[0]) == len(urls) + 5 and {r.verdict for r in rows[0] if r.rule is None} == {"allow", "block"}
    for x, y in zip(*rows, strict=True):
        assert x[:-1] == y[:-1] and x.llr == pytest.approx(y.llr, abs=1e-9)
    assert U.filter_urls(spark.createDataFrame([], PAGES)).count() == 0
