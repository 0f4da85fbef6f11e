from hypothesis import given, settings
from hypothesis import strategies as st

from binfields.llm.queries import URL_RULES
from binfields.llm.url_filter import DigestArray, judge_urls, rules_frame, write_digests


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for mark in "/?#":
        host = host.split(mark, 1)[0]
    path = rest[len(host) :]
    for mark in "?#":
        path = path.split(mark, 1)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def judged(url, rules):
    host, path = split(url)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [
    None, "", "no scheme", "http://", "http://example.net", "http://example.net?x=/en/", "http://Example.NET/en/a?b#c", "https://a.b.example.net/en", "http://example.com/de/1",
    "http://notexample.com/de/1", "ftp://x.org/fr/#y", "http://org/fr/", "http://net/", "http://net.org/x", "x://y://example.net/en/", "http://é.net/ö", "http://.net/", "http://a..net/x", "http://example.net:80/en/",
]


def check(spark, urls, rules, **options):
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rows = judge_urls(pages, rules_frame(spark, rules), **options).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == {i: judged(u, rules) for i, u in enumerate(urls)}


def test_rules_of_the_query(spark):
    check(spark, URLS, URL_RULES)


def test_list_beyond_the_local_bound(spark):
    check(spark, URLS, URL_RULES, max_local_rules=2)
    check(spark, URLS, [], max_local_rules=2)
    check(spark, URLS, URL_RULES, max_local_bytes=20)


def test_repeated_rules_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    rules = rules_frame(spark, [("net", "/", "allow"), ("net", "/", "block"), (None, "/", "block"), ("", "/", "block")])
    assert judge_urls(pages, rules).first().verdict == "block"
    assert judge_urls(pages.limit(0), rules).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.text("abc.", min_size=1, max_size=5), st.text("/ab", max_size=4)), unique=True, max_size=20))
def test_digest_array_finds_what_it_holds(tmp_path_factory, pairs):
    file = str(tmp_path_factory.mktemp("d") / "f")
    write_digests([(h, p, "block") for h, p in pairs], file)
    held = DigestArray(file)
    wanted = [f"{h}\n{p}" for h, p in pairs]
    assert [held.string(k) for k in held.find(wanted)] == wanted
    assert (held.find(["zz\n/"]) == -1).all()
