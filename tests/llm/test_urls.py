import itertools

import xxhash
from pyspark.sql import functions as F

from statloom.llm import urls
from statloom.llm.queries import SPAM_HOSTS, URL_RULES

ROWS = [
    (1, "http://a.example.org/es/x?q=1"), (2, "https://EXAMPLE.org/en/12#t"), (3, "http://b.net/x"), (4, "http://www.cheap-pills.example.net/"), (5, None), (6, "no scheme"),
    (7, "http://x.com/fr/1"), (8, "http://x.com/de/1"), (9, "http://org"), (10, "http://notexample.org/es/"), (3, "http://b.net/x"), (None, "http://example.org"), (11, "x://"),
    (12, "http://" + "a." * 50_000 + "cheap-pills.example.net/"), (13, "http://" + "." * 100_000 + "com/de/"), (14, "http://xcheap-pills.example.net"), (15, "http://com./de/"),
]


def expect(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: (len(r.text), len(r.host)))
        return host, path, best.text, best.verdict
    return host, path, None, "block" if any(host == h or host.endswith("." + h) for h in SPAM_HOSTS) else "allow"


def test_verdicts_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "host") for i, u in ROWS], "page_id long, url string, host string")
    want = sorted((str(i), *map(str, expect(u))) for i, u in ROWS)
    listed = spark.createDataFrame([(h, 1) for h in SPAM_HOSTS], "host string, n int")
    for limit, blocked in itertools.product((urls.MOST_BYTES, 0), (SPAM_HOSTS, listed)):  # the array, and the join for long lists
        got = urls.filter_urls(pages, URL_RULES, blocked, most_bytes=limit).select("page_id", "host", "path", "rule", "verdict").collect()
        assert sorted(tuple(map(str, r)) for r in got) == want


def test_empty_table(spark):
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES, SPAM_HOSTS).count() == 0


def test_digests_with_collisions(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda b: 7)
    path = tmp_path / "list.bin"
    path.write_bytes(urls.build([], ["a.com", "b.com", "c.com"]))
    assert urls.DigestArray(str(path)).find([b"a.com", b"c.com", b"d.com"]).tolist() == [3, 3, 0]
    path.write_bytes(urls.build([], []))
    assert urls.DigestArray(str(path)).find([b"a.com"]).tolist() == [0]


def test_keys_are_those_of_spark(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a.com"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a.com", 42)
