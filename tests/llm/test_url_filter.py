"""URL filter against a plain loop over the tree, and against its rules by hand."""

import random
import re
from collections import defaultdict

import duckdb
import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from tallyframe.llm.queries import URL_RULES
from tallyframe.llm.url_filter import judge, oracle_sql

PAGES = "page_id long, url string, html string"
RESULT = ("page_id", "host", "path", "rule", "verdict", "template", "labelled", "blocked")


def table(spark, urls):
    return spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], PAGES)


def parsed(url):
    _, there, rest = (url or "").partition("://")
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest if there else "").groups()
    rule = None
    for _, r in sorted(URL_RULES, key=lambda x: len(x[1])):
        name, _, start = r.partition("/")
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        if (low == name or low.endswith("." + name)) and path.startswith("/" + start):
            rule = r
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path, rule


def form(path):
    out = []
    for s in filter(None, path.split("/")):
        named = re.fullmatch(r"[0-9a-fA-F-]{8,}", s) and re.search("[0-9]", s) and re.search("[a-fA-F]", s)
        out.append("{x}" if named else re.sub("[0-9]+", "{n}", s))
    return tuple(out)


def brute_force(urls, levels=6):
    verdict = {r: v for v, r in URL_RULES}
    places = [parsed(u) for u in urls]
    leaves = defaultdict(lambda: [0, 0, 0])
    for host, path, rule in set(places):
        counts = leaves[host, form(path)]
        for i, one in enumerate((True, rule is not None, verdict.get(rule) == "block")):
            counts[i] += one
    prefix = {key: "" for key in leaves}
    for level in range(levels):
        kids = defaultdict(lambda: defaultdict(lambda: [0, 0, 0, defaultdict(int)]))
        for (host, segs), counts in leaves.items():
            if len(segs) > level:
                kid = kids[host, prefix[host, segs]][segs[level]]
                for i in range(3):
                    kid[i] += counts[i]
                kid[3][segs[level + 1] if len(segs) > level + 1 else ""] += counts[0]
        names = {}
        for node, children in kids.items():
            pools = defaultdict(lambda: [0, 0, 0])
            told = {}
            for seg, (n, labelled, blocked, ways) in children.items():
                if len(children) > 8 and n < 5:
                    names[node, seg] = "*"
                elif labelled >= 5:
                    _, after = max((c, s) for s, c in ways.items())
                    told[seg] = (after, 5 * (blocked + 1) // (labelled + 2))
                    pools[told[seg]][0] += labelled
                    pools[told[seg]][1] += blocked
                    pools[told[seg]][2] += 1
            for seg, group in told.items():
                (_, l, b, _), (all_l, all_b, members) = children[seg], pools[group]
                if members > 1 and (b * all_l - l * all_b) ** 2 <= 4 * l * all_b * (all_l - all_b):
                    names[node, seg] = f"~{group[1]}({group[0]})"
        before = dict(prefix)
        for host, segs in leaves:
            if len(segs) > level:
                node = (host, before[host, segs])
                prefix[host, segs] += "/" + names.get((node, segs[level]), segs[level])
    pooled = defaultdict(lambda: [0, 0])
    name = {key: prefix[key] + ("/**" if len(key[1]) > levels else "") for key in leaves}
    for key, counts in leaves.items():
        pooled[key[0], name[key]][0] += counts[1]
        pooled[key[0], name[key]][1] += counts[2]
    out = []
    for i, (host, path, rule) in enumerate(places):
        template = name[host, form(path)]
        labelled, blocked = pooled[host, template]
        learned = "block" if 5 * (blocked + 1) >= 4 * (labelled + 4) else "allow"
        out.append((i, host, path, rule, verdict.get(rule, learned), template, labelled, blocked))
    return sorted(out, key=repr)


def random_urls(n, seed):
    rng = random.Random(seed)
    hosts = ["a.example.net", "B.example.com", "example.org", "x.y.org", "net", "other.test", "example.com:80"]
    first = ["en", "de", "fr", "es", "news", "DE", "tags"]
    out = []
    for _ in range(n):
        segs = [rng.choice(first)] if rng.random() < 0.95 else []
        for _ in range(rng.randrange(0, 4)):
            segs.append(rng.choice([str(rng.randrange(1000)), f"p{rng.randrange(30)}.html", rng.choice("abcdefghijklmn") * 3, "deadbeef42", "x" * rng.randrange(1, 40)]))
        out.append("http://" + rng.choice(hosts) + "".join("/" + s for s in segs) + rng.choice(["", "/", "?q=/de/", "#/fr/", "//"]))
    return out


AWKWARD = [None, "", "no scheme/de/1", "://", "http://", "http://net", "http://net/", "http://EXAMPLE.net/en/1", "http://notnet/", "ftp://é.org/fr/ü?x", "a://b://net/", "http://example.com/de", "http://example.com/de/", "http://x.org\n/fr/a\nb", "http://d.net/" + "s/" * 5000 + "1"]


def test_equals_brute_force_and_sql(spark):
    urls = [*random_urls(1500, 1), *AWKWARD, *["http://hot.example.com/de/1"] * 700]
    urls += [f"http://c.example.com/de/{i}" for i in range(40)] + ["http://c.example.com//de/7"]
    want = brute_force(urls)
    got = judge(table(spark, urls), URL_RULES)
    assert rows_of(got, *RESULT) == want
    assert {r[4] for r in want if r[3] is None} == {"allow", "block"}
    con = duckdb.connect()
    con.register("pages", table(spark, urls).toPandas())
    columns = ", ".join(RESULT)
    assert sorted(con.execute(f"SELECT {columns} FROM ({oracle_sql(URL_RULES)}) q").fetchall(), key=repr) == want


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_levels(spark, levels):
    urls = random_urls(300, 2)
    assert rows_of(judge(table(spark, urls), URL_RULES, levels=levels), *RESULT) == brute_force(urls, levels)


def test_longest_rule_wins(spark):
    urls = ["http://example.net/en/1", "http://a.example.net/de/1", "http://example.com/de/x", "http://example.com/en/x", "http://q.org/fr/1", "http://xorg/fr/1", "http://example.net"]
    got = [(r["rule"], r["verdict"]) for r in judge(table(spark, urls), URL_RULES).orderBy("page_id").collect()]
    assert got == [("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), (None, "allow"), ("org/fr/", "allow"), (None, "allow"), (None, "allow")]


def test_branches_like_blocked_ones_go(spark):
    """Old and new paths of a section that rules block: a rule that names the section's start does not fit the rest."""
    rules = (("block", "shop.test/sale/item-1"), ("allow", "shop.test/help/"))
    urls = [f"http://shop.test/sale/item-1{i}" for i in range(60)] + [f"http://shop.test/sale/item-{i}" for i in range(20, 30)]
    urls += [f"http://shop.test/help/{i}" for i in range(60)] + ["http://shop.test/about/1"]
    got = {r["url"].split("test/")[1]: r["verdict"] for r in judge(table(spark, urls), rules).collect()}
    assert got["sale/item-25"] == "block" and got["help/7"] == "allow" and got["about/1"] == "allow"


def test_similar_branches_are_merged(spark):
    rules = (("block", "s.test/a/"), ("block", "s.test/b/"), ("allow", "s.test/c/"))
    urls = [f"http://s.test/{s}/{i}" for s in "abcd" for i in range(20)]
    got = {r["url"].split("/")[3]: (r["template"], r["labelled"]) for r in judge(table(spark, urls), rules).collect()}
    assert got["a"] == got["b"] == ("/~4({n})/{n}", 40) != got["c"] and got["d"] == ("/d/{n}", 0)


def test_empty_table_and_clashing_columns(spark):
    assert judge(table(spark, []), URL_RULES).collect() == []
    names = ("host", "path", "rule", "verdict", "form", "prefix", "n", "label", "seg", "in_0")
    frame = table(spark, random_urls(50, 3)).withColumns({c: F.lit("extra") for c in names})
    got = judge(frame, URL_RULES)
    assert set(got.columns) == {"page_id", "url", "html", "form", "prefix", "n", "label", "seg", "in_0", *RESULT}
    assert rows_of(got, *RESULT) == brute_force(random_urls(50, 3))
