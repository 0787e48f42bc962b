"""URL rules against a plain search of every rule."""

import random

import numpy as np
import pytest

from quarrymill.llm import url_filter as U

URLS = [
    "http://Example.NET/en/1", "https://a.example.net/en", "http://net/x", "http://net", "http://evilnet/", "ftp://x.net?u=http://org/fr/", "http://a.org/fr/", "http://org/fr", "http://example.com/de/?q", "HTTP://b.example.com/de/#x", None, "", "no scheme/", "://", ":///en/", "http://net:80/", "http://.net/", "http://net./",
    "a://b://c.net/", "http://u@example.net/en/\nx", "http://éxample.org/fr/é", "http://" + "a." * 50_000 + "net/", "http://x.net/" + "p" * 100_000, "http://x\ny.org/fr/", "http://ORG/fr/A?B#C",
]


def plain(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, default)


@pytest.mark.parametrize("digest", [U._digest, lambda k: U._digest(k) % 3, lambda _: 7])
def test_rule_files(digest):
    rng = random.Random(5)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    paths = ["", "/", "/a", "/a/", "/ab", "/b/c", "/é"]
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h in hosts for p in rng.sample(paths, 3)}.values())
    table = U.RuleFile(np.frombuffer(U.RuleFile.pack(rules, digest), np.uint8), digest)
    assert len(set(table.rules.digests.tolist())) < len(rules) or digest is U._digest
    urls = [f"http://{rng.choice(['', 'z.', 'a.', 'xa'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'x', '/y'])}" for _ in range(800)]
    want = [plain(u, rules) for u in urls]
    best = table.best([w[0].encode() for w in want], [w[1].encode() for w in want])
    assert [(None if k < 0 else table.text(k), "allow" if k < 0 or not table.blocks[k] else "block") for k in best] == [w[2:] for w in want]


def test_odd_urls(spark):
    df = spark.createDataFrame([(k // 2, u, 1, "x", "y") for k, u in enumerate(URLS)] + [(None, URLS[0], 1, "x", "y")], "page_id long, url string, host int, rule string, verdict string").repartition(3)
    got = U.judge_urls(df, U.RULES)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == sorted([(k // 2, *plain(u, U.RULES)) for k, u in enumerate(URLS)] + [(None, *plain(URLS[0], U.RULES))], key=repr)
    assert {r.verdict for r in U.judge_urls(df, [], default="block").collect()} == {"block"}
    assert U.judge_urls(df.limit(0), U.RULES).collect() == []


def test_rules_are_checked(spark, monkeypatch):
    for bad in [("drop", "net", "/"), ("block", "", "/"), ("block", "a\nb", "/")]:
        with pytest.raises(ValueError):
            U.RuleFile.pack([bad])
    assert U.RuleFile.pack([("allow", "NET", "/"), ("block", "net", "/")]) == U.RuleFile.pack([("block", "net", "/")])
    monkeypatch.setattr(U, "MOST_BYTES", 10)
    with pytest.raises(ValueError):
        U._hand_out(spark, U.RuleFile.pack(U.RULES))
