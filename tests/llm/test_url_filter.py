import random
import re

import numpy as np

from quillstone.llm import url_filter as u


def brute(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_equals_brute_force(spark):
    rng = random.Random(1)
    hosts = ["com", "example.com", "a.example.com", "notexample.com", "Example.NET", "x.y.net", "org", "", "com:80", "ÀB.org"]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/76", "/de/8", "/de/9", "/es/x/y", "/en/7?x#y", "?a=/en/", "#/en/"]
    urls = [None, "", "example.com/en/7", "http:/com/en/", "a://b://c/en/"] + [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    for rules in (u.RULES, (), u.RULES + (("com", "", "block"), ("c", "/en/", "allow"))):
        pages = spark.createDataFrame([(i, x, "h") for i, x in enumerate(urls)] + [(None, urls[9], "h")], "page_id long, url string, verdict string")
        got = u.judge(pages, rules).collect()
        assert len(got) == len(urls) + 1
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == brute(urls[9] if r.page_id is None else urls[r.page_id], rules)
    assert u.judge(pages.limit(0), u.RULES).count() == 0
    many = u.RULES + tuple((f"h{i}.org", f"/{i}", "block") for i in range(40)) + (("com", "", "block"), ("h3.org", "/3/4", "allow"))
    more = spark.createDataFrame([(i, f"http://x.h{i}.org/{i}/4?") for i in range(60)] + [(100 + i, x) for i, x in enumerate(urls)], "page_id long, url string")
    for r, (_, url) in zip(sorted(u.judge(more, many, part=7).collect()), sorted(more.collect()), strict=True):
        assert (r.host, r.path, r.rule, r.verdict) == brute(url, many)


def test_a_first_level_with_too_many_false_positives_is_made_anew(spark, monkeypatch):
    monkeypatch.setattr(u, "PASSING", -3_333)
    rules = tuple((f"h{i}.org", "/", "block") for i in range(3))
    pages = spark.createDataFrame([(i, f"http://h{i}.org/") for i in range(2_000)], "page_id long, url string")
    made = []
    first_level = u.Cascade.first_level
    monkeypatch.setattr(u.Cascade, "first_level", staticmethod(lambda listed, n: made.append(n) or first_level(listed, 1 if len(made) == 1 else n)))
    got = u.judge(pages, rules).collect()
    assert sorted(r.page_id for r in got if r.verdict == "block") == [0, 1, 2] and len(made) > 2 and made[1] > made[0]


def test_cascade_is_exact_over_its_universe():
    digests = u.as_array([u.digest(str(i)) for i in range(60_000)])
    listed, others = digests[:5_000], digests[5_000:]
    first = u.Cascade.first_level(listed, len(others))
    wrong = others[first.passes(u.salted(others, 0))]
    assert 0 < len(wrong) < 3 * len(listed)
    cascade = u.Cascade(first).complete(listed, wrong)
    assert len(cascade.levels) > 2
    assert cascade.contains(listed).all() and not cascade.contains(others).any()
    assert sum(level.bits for level in cascade.levels) < 12 * len(listed)
    assert np.array_equal(u.Cascade(first).contains(digests), first.passes(u.salted(digests, 0)))
