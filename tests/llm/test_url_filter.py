"""Verdicts against a plain loop over all rules; patterns, tokens, both ways to reach rules, odd inputs."""

import random
import re

import pytest

from minim.llm import url_filter
from minim.llm.queries import url_rules
from minim.llm.url_filter import RULE, RuleIndex, compile_rule, keep_allowed, order_of, url_verdicts


def parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", "", ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m.group(1))
    return host, m.group(2), host + url[m.end(1):]


def plain(url, rules, default="allow"):
    host, path, subject = parts(url)
    hits = [r for r in rules if re.search(compile_rule(r["pattern"])[0], subject)]
    best = min(hits, key=order_of, default=None)
    return (host, path, *((best["rule"], best["pattern"], best["tier"], best["verdict"]) if best else (None, None, None, default)))


def as_dicts(rules):
    return [dict(zip(("rule", "pattern", "verdict", "tier"), r)) for r in rules]


RULES = [*url_rules(), ("wide", "*promo*", "block", 0), ("ends", "^pdf|", "block", 0), ("number", "/<[0-9]+>^", "allow", 0), ("any case", "/Shop/", "block", 2),
         ("a", "||same.org", "allow", 0), ("b", "||same.org", "block", 0), ("start", "|http.example.", "block", 0), ("none", "||never-seen.net^", "block", 3)]


def urls(rng, n):
    hosts = ["a.example.org", "EXAMPLE.org", "example.org", "notexample.org", "org", "x.casino-win.example.com", "casinos.com", "same.org", "my.same.org", "pills",
             "http.example.com", "1.2.3.4:80", "user@host.com", "müller.de"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/123", "/en/2", "/fr/x", "/de/y/", "/Shop/1", "/shop/1", "/login", "/login/", "/a.pdf", "/a.pdfx", "/7/8", "/ü/promoted"]
    ends = ["", "?q=1", "#top", "?u=http://b.org/es/"]
    return [f"{rng.choice(['http', 'https', 'ftp', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(ends)}" for _ in range(n)]


ODD = [None, "", "no scheme", "://", "http://", "http://org", "http://org/", "mailto:a@b.org", "http:/one/slash.org/", "http://a.example.org/" + "long/" * 20_000,
       "x://y://z.org/", "http://A.B\n.org/\nes/"]


@pytest.fixture(scope="module")
def pages(spark):
    listed = urls(random.Random(3), 300) + ODD
    rows = [(i if i % 7 else None, u, "h", "host", 3) for i, u in enumerate(listed)] + [(5, listed[5], "h", "host", 3)]
    return spark.createDataFrame(rows, "page_id long, url string, rule string, host string, tier int").repartition(3)


@pytest.mark.parametrize("limit", [20_000, 3])
def test_agrees_with_all_rules(spark, pages, monkeypatch, limit):
    """Rules sent along, and rules joined (a limit of 3, with blocks of 3 open rules)."""
    monkeypatch.setattr(url_filter, "MAX_RULES", limit)
    rules = spark.createDataFrame(RULES, RULE)
    got = sorted((tuple(r) for r in url_verdicts(pages, rules).collect()), key=repr)
    want = sorted(((r["page_id"], *plain(r["url"], as_dicts(RULES))) for r in pages.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("limit", [20_000, 3])
def test_keep_allowed_keeps_columns(spark, pages, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "MAX_RULES", limit)
    kept = keep_allowed(pages, spark.createDataFrame(RULES, RULE))
    assert kept.schema == pages.schema
    want = [tuple(r) for r in pages.collect() if plain(r["url"], as_dicts(RULES))[-1] == "allow"]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(want, key=repr)


def test_no_rules_and_no_pages(spark, pages):
    none = spark.createDataFrame([], RULE)
    assert {r["verdict"] for r in url_verdicts(pages, none).collect()} == {"allow"}
    assert {r["verdict"] for r in url_verdicts(pages, none, default="block").collect()} == {"block"}
    assert url_verdicts(pages.limit(0), spark.createDataFrame(RULES, RULE)).count() == 0


def test_tokens_are_in_every_match():
    rng = random.Random(8)
    for _, pattern, *_ in RULES:
        regex, tokens = compile_rule(pattern)
        for url in urls(rng, 400):
            subject = parts(url)[2]
            if re.search(regex, subject):
                assert set(tokens) <= set(re.findall("[a-z0-9]+", subject.translate(url_filter._TO_LOWER)))
    assert compile_rule("||example.org/en/1")[1] == ["en", "example", "org"]
    assert compile_rule("*promo*")[1] == [] and compile_rule("<x>word^")[1] == []


def test_rules_lie_under_their_rarest_token():
    index = RuleIndex(as_dicts(RULES), {"org": 900, "example": 900, "en": 50, "es": 70})
    assert [e[2] for e in index.by_token["en"]] == ["example.org/en/1"] and [e[2] for e in index.by_token["es"]] == ["example.org/es/"]
    tried = [e[2] for rules in index.candidates("a.b.info/x") for e in rules]
    assert tried == [e[2] for e in index.open]
