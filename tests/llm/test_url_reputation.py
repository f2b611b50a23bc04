from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import url_reputation as U
from ledgerlens.llm.queries import QUERIES
from tests.llm.conftest import rows_of

URLS = [
    "http://a.example.net/en/1", "https://EXAMPLE.net/de/?q", "http://net", "http://net/", "http://x.net?y=/",
    "HTTP://Sub.Example.COM/de/2#f", "http://notexample.com/de/", "http://r.org/fr/1", "http://r.org/fr", None, "",
    "no scheme", "mailto://", "ftp://u:p@H.co.uk:80/p", "http://10.0.0.1/a", "http://É.example.com/de/", "a://b://c/d",
    "http://host/" + "x" * 100_000, "http://b.h.co.uk/", "http://a.example.net/en/1"]


def pages(spark):
    return spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, "http://q.org/")],
                                 "page_id long, url string").withColumns({c: F.lit(0) for c in ("host", "rule", "n", "k")})


def plain_judgement(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(rule), rule, verdict) for verdict, rule in U.RULES for name, _, tail in [rule.partition("/")]
            if (host == name or host.endswith("." + name)) and path.startswith("/" + tail)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def labels(spark, rows):
    """Outcomes (page_id, bad) from rows (page_id, quality, toxic)."""
    return spark.createDataFrame(rows, "page_id long, quality int, toxic int").select(
        "page_id", U.is_bad(F.col("quality"), F.col("toxic")).alias("bad"))


def test_hosts_paths_and_rules(spark):
    judged = U.judge_pages(pages(spark), labels(spark, [(0, 1, 0), (None, 0, 1), (3, None, None)]))
    found = {r["page_id"]: r for r in judged.collect()}
    assert len(found) == judged.count() == len(URLS) + 1
    for i, url in enumerate(URLS):
        host, path, rule, verdict = plain_judgement(url)
        assert (found[i]["host"], found[i]["path"], found[i]["rule"]) == (host, path, rule), url
        assert found[i]["verdict"] == (verdict or "allow")


def test_bad_hosts_are_blocked_and_small_ones_shrink(spark):
    rows = [(i, f"http://bad.site.org/{i}") for i in range(200)] + [(1000 + i, f"http://h{i % 40}.fine.org/") for i in range(400)]
    rows += [(5000, "http://once.fine.org/"), (5001, "http://new.site.org/"), (5002, "http://else.io/")]
    outcome = [(i, 0, 0) for i in range(200)] + [(1000 + i, 1, int(i % 50 == 0)) for i in range(400)] + [(5000, 0, 0)]
    pages_ = spark.createDataFrame(rows, "page_id long, url string")
    found = {r["page_id"]: r for r in U.judge_pages(pages_, labels(spark, outcome)).collect()}
    assert found[3]["verdict"] == "block" and found[3]["bad_rate"] > 0.9
    assert found[1001]["verdict"] == "allow"
    # one bad page of a good domain says little; an unseen host of a bad domain is worse than one of a good domain
    assert found[5000]["bad_rate"] < 0.5 and found[5000]["verdict"] == "allow"
    assert found[5001]["bad_rate"] > found[5000]["bad_rate"] > found[1001]["bad_rate"]


def plain_reputation(hosts, z=U.Z):
    """``hosts``: host -> (domain, suffix, n, k); the formulas one by one, a child's pages left out of its prior."""
    def strength(children):
        noise = [n * m * (1 - m) for n, _, m in children]
        above = sum(round(((k - n * m) ** 2 - e) * 1e6) for (n, k, m), e in zip(children, noise))
        scale = sum(round((n - 1) * e * 1e6) for (n, _, _), e in zip(children, noise))
        rho = min(max(above / scale if scale > 0 else 1.0, 1 / (1 + U.STRENGTH[1])), 1 / (1 + U.STRENGTH[0]))
        return round(1 / rho - 1, 6)

    domains, suffixes = {}, {}
    for domain, suffix, n, k in hosts.values():
        for group, key in ((domains, (domain, suffix)), (suffixes, suffix)):
            group[key] = tuple(map(sum, zip(group.get(key, (0, 0)), (n, k))))
    all_n, all_k = (sum(x[i] for x in suffixes.values()) for i in (0, 1))
    base = {x: (all_k - k + 1) / (all_n - n + 2) for x, (n, k) in suffixes.items()}
    s1 = strength([(*suffixes[x], base[x]) for x in suffixes])
    top = {d: (suffixes[d[1]][1] - k + s1 * base[d[1]]) / (suffixes[d[1]][0] - n + s1) for d, (n, k) in domains.items()}
    s2 = strength([(*domains[d], top[d]) for d in domains])
    own = {h: (domains[d, x][1] - k + s2 * top[d, x]) / (domains[d, x][0] - n + s2) for h, (d, x, n, k) in hosts.items()}
    s3 = strength([(n, k, own[h]) for h, (_, _, n, k) in hosts.items()])
    out = {}
    for h, (_, _, n, k) in hosts.items():
        a, b = k + s3 * own[h], n - k + s3 * (1 - own[h])
        out[h] = a / (a + b), max(0.0, a / (a + b) - z * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5)
    return out


def test_reputation_equals_the_formulas(spark):
    rng, hosts = random.Random(5), {}
    for i in range(60):
        domain, suffix = f"d{i % 9}.{'org' if i % 3 else 'co.uk'}", "org" if i % 3 else "co.uk"
        n = rng.choice([0, 1, 5, 40])
        hosts[f"h{i}.{domain}"] = (domain, suffix, n, min(n, int(n * rng.random() * (1 if i % 9 else 1.6))))
    rows = [(h, n, k) for h, (_, _, n, k) in hosts.items()]
    found = {r["host"]: r for r in U.host_reputation(spark.createDataFrame(rows, "host string, n long, k long")).collect()}
    for host, (rate, low) in plain_reputation(hosts).items():
        assert (found[host]["bad_rate"], found[host]["bad_low"]) == pytest.approx((rate, low), abs=2e-6)


def test_prior_does_not_hold_the_hosts_own_pages(spark):
    """All labelled pages lie on one host: its prior is the flat one, whatever they say."""
    rows = [("a.x.org", 100, 90), ("b.x.org", 0, 0)]
    found = {r["host"]: r for r in U.host_reputation(spark.createDataFrame(rows, "host string, n long, k long")).collect()}
    assert found["a.x.org"]["bad_rate"] == pytest.approx((90 + 2 * 0.5) / 102, abs=1e-5)
    assert found["b.x.org"]["bad_rate"] > 0.8


def text_tables():
    """Pages, documents and labels: bad hosts and good ones, each page carrying a document's text."""
    rng, docs, marks, pages_ = random.Random(8), [], [], []
    for i in range(240):
        bad = i % 4 == 0
        text = " ".join(rng.choice(["green", "bean", "stone", "river", "lamp", "Été"]) + str(rng.randrange(999)) for _ in range(12))
        docs.append((i, f"{text}. Every page says this same line! {text[::-1]}\nand the end of number {i}", None, None, None))
        if i % 5:
            marks.append((i, int(not bad), int(bad and i % 8 == 0)))
        host = f"h{i % 3}.casino.org" if bad else f"www{i % 7}.fine.com"
        body = docs[-1][1].replace("\n", "</p>\r\n<P class=x>").replace("green", "<b>green</b>")
        pages_.append((1000 + i, f"http://{host}/{i}", f"<html><SCRIPT>var x;</script ><p>{body}</p><!-- a\nb --></html>"))
    docs += [(900, None, None, None, None), (901, "", None, None, None), (None, docs[0][1], None, None, None), docs[7]]
    pages_ += [(None, "http://n.org", pages_[0][2]), (2000, None, None), (2001, "http://new.casino.org/", ""), pages_[3]]
    return pages_, docs, marks + [(None, 0, 0), (3, None, None), (7, 1, 0)]


def test_query_blocks_bad_hosts_as_its_sql_does(spark, tmp_path):
    pages_, docs, marks = text_tables()
    tables = {"pages": spark.createDataFrame(pages_, "page_id long, url string, html string"),
              "documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
              "labels": spark.createDataFrame(marks, "doc_id long, quality int, toxic int")}
    con = duckdb.connect()
    for name, df in tables.items():
        df.withColumns({c: F.lit("x") for c in ("line", "content", "bad", "n")}).write.parquet(f"{tmp_path}/{name}.parquet")
        con.register(name, df.toArrow())
    found = QUERIES["op1_url_reputation"][0](spark, str(tmp_path))
    assert rows_of(found) == sorted(con.execute(U.SQL).fetchall(), key=repr)
    verdicts = {r["host"]: r["verdict"] for r in found.collect()}
    assert {h: v for h, v in verdicts.items() if "fine" in h or h.startswith("h")} == {
        **{f"h{i}.casino.org": "block" for i in range(3)}, **{f"www{i}.fine.com": "allow" for i in range(7)}}


@pytest.mark.parametrize("urls", [[], ["http://a.org/x"]])
def test_without_labels_or_pages(spark, urls):
    empty = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    found = U.judge_pages(empty, labels(spark, [])).collect()
    assert [r["verdict"] for r in found] == ["allow"] * len(urls)


def test_registered_domains(spark, tmp_path):
    hosts = {"a.b.example.com": ("example.com", "com"), "x.co.uk": ("x.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
             "u@w.x.co.uk:8080": ("x.co.uk", "co.uk"), "10.0.0.1": ("10.0.0.1", ""), "localhost": ("localhost", ""), "": ("", "")}
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    found = U.with_domains(rows).collect()
    assert {r["host"]: (r["domain"], r["suffix"]) for r in found} == hosts

    path = tmp_path / "rules"
    path.write_text("// a comment\n\ncom\n*.ck\n!www.ck\na.b.jp trailing words\nb.jp\n")
    rules = U.load_suffixes(str(path))
    listed = {"x.com": ("x.com", "com"), "s.shop.ck": ("s.shop.ck", "shop.ck"), "shop.ck": ("shop.ck", "shop.ck"),
              "www.ck": ("www.ck", "ck"), "q.www.ck": ("www.ck", "ck"), "y.z.a.b.jp": ("z.a.b.jp", "a.b.jp"),
              "z.c.b.jp": ("c.b.jp", "b.jp"), "x.unknown": ("x.unknown", "unknown")}
    found = U.with_domains(spark.createDataFrame([(h,) for h in listed], "host string"), rules).collect()
    assert {r["host"]: (r["domain"], r["suffix"]) for r in found} == listed


def test_outcomes_come_from_the_text_of_pages(spark):
    """A page has the label of the document that it carries, not of the document with its number."""
    own = ["One bad text about certain large wins. Another line of %d.", "A fine text on growing green garden beans. And more of %d."]
    docs = [(i, own[i % 2] % i + f" Only number {i} says these words.\nEvery page says this very same line.") for i in range(6)]
    docs += [(6, docs[0][1]), (7, "An unlabelled text with words of its own. Every page says this very same line."), (8, None)]
    marks = [(i, i % 2, 0) for i in range(1, 6)] + [(6, 0, 0), (8, 0, 0), (None, 0, 0)]
    page = lambda i: ("<html><script>var x;</script><p>" + docs[i][1].replace("\n", "</p><p>").replace("Only", "<b>Only</b>")
                      + "</p><!-- x --></html>")
    pages_ = [(10 + i, page(i)) for i in range(8)] + [(1, page(2)), (2, "<p>Nothing that a document says at all</p>"), (3, None)]
    found = U.outcomes_by_text(spark.createDataFrame(pages_, "page_id long, html string"),
                               spark.createDataFrame(docs, "doc_id long, text string"),
                               spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    expected = {10 + i: 1 - i % 2 for i in range(7)} | {1: 1}
    assert {r["page_id"]: r["bad"] for r in found.collect()} == expected and found.count() == len(expected)
