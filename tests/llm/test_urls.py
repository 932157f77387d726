import pytest

from tarnloom.llm import urls


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([k for k in (rest.find(c) for c in "/?#") if k >= 0], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min([k for k in (rest.find(c) for c in "?#") if k >= 0], default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:cut]


def brute(url, rules, default):
    host, path = host_path(url)
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[2], best[3]) if best else (host, path, None, default)


URLS = [
    None, "", "example.com/en/", "http://example.com/en/", "http://example.com/en", "http://WWW.Example.COM/en/x?y#z", "http://a.www.example.com/en//", "http://notexample.com/en/", "http://net/es/", "x://n.net/es", "x://n.net/es/?q",
    "x://n.net?/es/", "x://n.net#/fr/", "http://com", "http://com/", "http://a.com:80/", "a://b://c.com/", "http://.com/", "http://com./", "http:///en/", "http://x.net/fr/" + "a/" * 5000, "http://x\n.com/a\nb", "http://xn.com/es/",
]
MORE = (("com", "/", "allow"), ("com", "/", "block"), ("a.com", "/e", "block"), ("a.com", "/en/x/y", "allow"), ("b.a.com", "", "allow"), ("", "/", "block"))


@pytest.mark.parametrize("rules", [urls.DEFAULT_RULES, urls.DEFAULT_RULES + MORE[2:5], MORE[:2]])
def test_against_all_rules(spark, rules):
    rows = [(k, u) for k, u in enumerate(URLS + ["http://b.a.com/english", "http://a.com/en/x/yz", "http://c.b.a.com"])]
    got = urls.judge(spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, host string, verdict int"), rules).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(rows[r.page_id][1], rules, "allow"), rows[r.page_id]


def test_null_ids_and_no_pages(spark):
    frame = lambda rows: spark.createDataFrame(rows, "page_id long, url string")
    assert len(urls.judge(frame([(None, None), (None, None), (1, "http://a.com")])).collect()) == 3
    assert urls.judge(frame([])).collect() == []


def test_a_trie_that_is_too_large_is_refused(monkeypatch):
    monkeypatch.setattr(urls, "MAX_RULES", 2)
    with pytest.raises(ValueError):
        urls.Trie(MORE)
