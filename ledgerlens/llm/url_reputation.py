"""URL filter: rules first, then empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted by host, registered domain and
suffix.  Rates shrink top-down through beta-binomial priors: everything ->
suffix -> domain -> host.  A child's own pages are left out of its parent's
rate, so no page enters both a host's counts and its prior.  The prior's strength on
each level comes from how much the children of that level scatter around these
rates (method of moments).  A page is blocked when the lower bound of its
host's posterior bad rate exceeds ``max_bad_rate``.

Outcomes of pages come from labelled documents whose sentences the pages carry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm._util import stored

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Suffixes under which names are registered, in the form of the public suffix list (``*.x`` and ``!a.x``
#: too; see ``load_suffixes``); any other suffix is the last label.  These few are a stand-in for the list.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "or.jp",
                      "ne.jp", "co.kr", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "co.in", "co.nz",
                      "co.za", "com.ar", "com.sg", "com.hk", "co.il", "github.io", "blogspot.com")
MAX_BAD_RATE = 0.3
Z = 1.645
#: The prior counts as many labelled pages as this at least and at most.
STRENGTH = (2.0, 1000.0)
#: A sentence of fewer words does not tell documents apart.
MIN_WORDS = 4
_HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
_INLINE = r"(?i)</?(a|abbr|b|code|em|i|mark|s|small|span|strong|sub|sup|u)\b[^>]*>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    found: Column = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def load_suffixes(path: str) -> tuple[str, ...]:
    """Rules of a file in the form of the public suffix list: a rule per line, ``//`` comments."""
    with open(path, encoding="utf-8") as source:
        rules = (line.split(maxsplit=1)[0] for line in source if line.strip() and not line.startswith("//"))
        return tuple(rule.lower() for rule in rules)


#: A list of so many rules is broadcast; a longer one is joined by a shuffle.
BROADCAST_RULES = 100_000


def with_domains(hosts: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Adds ``domain`` (registered domain) and ``suffix`` to ``hosts(host, ..)``, one row per host.

    An exception (``!a.x``) wins over other rules, else the rule of most labels; user and
    port do not count; an address is its own domain.
    """
    name = F.regexp_replace(F.regexp_replace(F.col("host"), r"^.*@", ""), r":\d*$", "")
    parts = F.split(name, r"\.")
    size = F.size(parts)
    address = name.rlike(r"^(\d+\.){3}\d+$|^\[.*\]$") | (size < 2)
    tail = F.explode(F.transform(F.sequence(F.lit(1), size), lambda j: F.struct(
        j.alias("n"), F.array_join(F.slice(parts, -j, j), ".").alias("key"))))
    # what a rule adds to the labels of its key: *.x one, !a.x takes one away
    rows = [(r[2:], 1) if r.startswith("*.") else (r[1:], -1) if r.startswith("!") else (r, 0) for r in suffixes]
    rules = hosts.sparkSession.createDataFrame(rows or [(None, 0)], "key string, more int").distinct()
    rules = F.broadcast(rules) if len(rows) <= BROADCAST_RULES else rules
    tails = hosts.where(~address).select("host", size.alias("all"), tail.alias("t")).select("host", "all", "t.n", "t.key")
    fits = tails.join(rules, "key").where("n + more <= all").groupBy("host").agg(
        F.max(F.struct((F.col("more") < 0).alias("exception"), (F.col("n") + F.col("more")).alias("labels"))).alias("best"))
    labels = F.coalesce(F.col("best.labels"), F.lit(1))

    def last(n: Column) -> Column:
        n = F.least(n, size)
        return F.array_join(F.slice(parts, -n, n), ".")

    return hosts.join(fits, "host", "left").withColumns({
        "domain": F.when(address, name).otherwise(last(labels + 1)), "suffix": F.when(address, "").otherwise(last(labels))}).drop("best")


# --- reputation -------------------------------------------------------------

def _strength(children: DataFrame) -> float:
    """Prior strength of a level from ``children(n, k, parent)``: one row of two sums reaches the driver.

    For a beta-binomial with mean m, E[(k - nm)^2] = nm(1-m)(1 + (n-1) rho)
    and the strength is 1/rho - 1.  Terms are summed as integers of 1e-6, so
    the sums do not depend on their order.
    """
    n, k, m = F.col("n"), F.col("k"), F.col("parent")
    noise = n * m * (1 - m)
    exact = [F.coalesce(F.sum(F.round(x * 1e6).cast("decimal(38,0)")), F.lit(0)).cast("double")
             for x in ((k - n * m) * (k - n * m) - noise, (n - 1) * noise)]
    above, scale = children.agg(*exact).first()
    rho = above / scale if scale > 0 else 1.0  # nothing seen of the scatter: the weakest prior
    low, high = STRENGTH
    rho = min(max(rho, 1 / (1 + high)), 1 / (1 + low))
    return round(1 / rho - 1, 6)


def _posterior(n: Column, k: Column, strength: float, parent: Column) -> Column:
    return (k + F.lit(strength) * parent) / (n + F.lit(strength))


def _rest(strength: float) -> Column:
    """Parent rate of a child without the child's own pages: ``all_n, all_k`` of the parent, ``above`` its own prior."""
    n, k = F.col("all_n") - F.col("n"), F.col("all_k") - F.col("k")
    return _posterior(n, k, strength, F.col("above"))


def host_reputation(hosts: DataFrame, z: float = Z, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """``host, labelled, bad, bad_rate, bad_low`` from ``hosts(host, n, k)``.

    ``n`` labelled pages of which ``k`` are bad (zero for unseen hosts).
    ``bad_low`` is the posterior mean less ``z`` posterior standard deviations,
    at least zero.
    """
    counts = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    rows = stored(with_domains(hosts, suffixes).select("host", "n", "k", "domain", "suffix"), "url-domains-of-hosts")
    domains = stored(rows.groupBy("domain", "suffix").agg(*counts), "url-domains")
    tops = stored(domains.groupBy("suffix").agg(*counts), "url-suffixes")
    total = tops.agg(F.sum("n"), F.sum("k")).first()
    all_n, all_k = total[0] or 0, total[1] or 0

    tops = tops.withColumn("parent", (F.lit(all_k) - F.col("k") + 1.0) / (F.lit(all_n) - F.col("n") + 2.0))
    s = _strength(tops)
    above = tops.select("suffix", F.col("n").alias("all_n"), F.col("k").alias("all_k"), F.col("parent").alias("above"))
    domains = stored(domains.join(above, "suffix").withColumn("parent", _rest(s)).select(
        "domain", "suffix", "n", "k", "parent"), "url-domain-rates")
    s = _strength(domains)
    above = domains.select("domain", "suffix", F.col("n").alias("all_n"), F.col("k").alias("all_k"), F.col("parent").alias("above"))
    rows = stored(rows.join(above, ["domain", "suffix"]).withColumn("parent", _rest(s)), "url-host-rates")
    s = F.lit(_strength(rows))
    a, b = F.col("k") + s * F.col("parent"), F.col("n") - F.col("k") + s * (1 - F.col("parent"))
    mean = a / (a + b)
    low = F.greatest(mean - F.lit(z) * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), F.lit(0.0))
    return rows.select("host", F.col("n").alias("labelled"), F.col("k").alias("bad"),
                       F.round(mean, 6).alias("bad_rate"), F.round(low, 6).alias("bad_low"))


def judge_pages(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES,
                max_bad_rate: float = MAX_BAD_RATE, z: float = Z, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, bad_rate, bad_low``.

    ``outcomes(page_id, bad)`` holds labelled pages; null ids and null outcomes
    are ignored and a page labelled more than once is bad if any label says so.
    A null url or one without ``://`` has empty host and path and is judged by
    the empty host's reputation.  Repeated pages count as often as they occur.
    Without labels every host has a flat, weak prior and is
    allowed.  An empty table gives no rows.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    placed = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(
        F.max(F.col("bad").cast("int")).alias("bad"))
    counts = stored(placed.join(labels, "page_id", "left").groupBy("host").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k")), "url-hosts")
    known = stored(host_reputation(counts, z, suffixes), "url-reputation")
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    return (placed.join(known, "host", "left").select("*", rule.alias("match")).select(
        "page_id", "host", "path", F.col("match.rule").alias("rule"),
        F.coalesce("match.verdict", F.when(F.col("bad_low") > max_bad_rate, "block").otherwise("allow"))
        .alias("verdict"), "bad_rate", "bad_low"))


def is_bad(quality: Column, toxic: Column) -> Column:
    """1 if of low quality or toxic, 0 if labelled otherwise, null without labels."""
    return F.when((quality == 0) | (toxic == 1), 1).when(quality.isNotNull() | toxic.isNotNull(), 0)


def _sentences(text: Column) -> Column:
    """Hashes of the distinct sentences (words only, lower-cased; ``MIN_WORDS`` words or more) of a text."""
    words = F.transform(F.split(F.lower(text), r"[.!?\n]+"),
                        lambda s: F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " ")))
    long = F.filter(words, lambda s: F.size(F.split(s, " ")) >= MIN_WORDS)
    return F.array_distinct(F.transform(long, lambda s: F.xxhash64(s)))


def page_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments left out, a line per block element, entities as blanks."""
    bare = F.regexp_replace(html, _HIDDEN, "")
    inline = F.regexp_replace(F.regexp_replace(bare, r"[\r\n]+", " "), _INLINE, "")
    return F.regexp_replace(F.regexp_replace(inline, r"<[^>]*>", "\n"), r"&#?\w+;", " ")


def outcomes_by_text(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``page_id, bad`` of every page that carries text of a labelled document.

    Documents with the same set of sentences are one content, bad if any label
    of it says so.  A sentence points to a content if no other content of
    ``docs``, labelled or not, has it; a page is bad if any content that its
    sentences point to is.  The html and the texts are read whole.  Null ids,
    null texts and texts without a long enough sentence point nowhere; pages
    of one id share their outcome; other columns are not read.
    """
    bad = is_bad(F.col("quality"), F.col("toxic"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(bad).alias("bad")).where("bad is not null")
    texts = stored(docs.select("doc_id", _sentences(F.col("text")).alias("s")).where("size(s) > 0").select(
        "doc_id", "s", F.xxhash64(F.array_sort("s")).alias("content")), "url-sentences")
    contents = texts.select("doc_id", "content").join(marks, "doc_id").groupBy("content").agg(F.max("bad").alias("bad"))
    lines = texts.select("content", F.explode("s").alias("line")).groupBy("line").agg(
        F.min("content").alias("content"), F.max("content").alias("other")).where("content = other")
    pointers = lines.join(contents, "content").select("line", "bad")
    seen = pages.where("page_id is not null").select("page_id", F.explode(_sentences(page_text(F.col("html")))).alias("line"))
    return seen.join(pointers, "line").groupBy("page_id").agg(F.max("bad").alias("bad"))


def _sql_sentences(text: str) -> str:
    return (f"list_distinct(list_filter(list_transform(string_split_regex(lower({text}), '[.!?\\n]+'), "
            r"lambda s: trim(regexp_replace(s, '[^\p{L}\p{N}]+', ' ', 'g'))), "
            f"lambda s: len(string_split(s, ' ')) >= {MIN_WORDS}))")


def _sql_page_text(html: str) -> str:
    for pattern, by in ((_HIDDEN, "''"), (r"[\r\n]+", "' '"), (_INLINE, "''"), ("<[^>]*>", "chr(10)"), (r"&#?\w+;", "' '")):
        html = f"regexp_replace({html}, '{pattern}', {by}, 'g')"
    return html


def _sql_rest(strength: str) -> str:
    return f"((u.k - x.k + {strength} * u.parent) / (u.n - x.n + {strength}))::DOUBLE AS parent"


def _sql_strength(name: str, rows: str) -> str:
    terms = ("(k - n * parent) * (k - n * parent) - n * parent * (1 - parent)", "(n - 1) * (n * parent * (1 - parent))")
    above, scale = (f"coalesce(sum(round(({t}) * 1e6)::DECIMAL(38,0)), 0)::DOUBLE" for t in terms)
    low, high = (repr(1 / (1 + s)) + "::DOUBLE" for s in reversed(STRENGTH))
    return (f"{name} AS (SELECT round(1 / least(greatest(CASE WHEN scale > 0 THEN above / scale ELSE 1.0 END, {low}), "
            f"{high}) - 1, 6) AS s FROM (SELECT {above} AS above, {scale} AS scale FROM {rows}))")


#: DuckDB twin of ``judge_pages`` with its defaults over outcomes by text.
SQL = rf"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
             FROM pages),
placed AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
marks AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1
                WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY doc_id),
texts AS (SELECT doc_id, list_sort(s) AS s FROM (SELECT doc_id, {_sql_sentences("text")} AS s FROM documents) WHERE len(s) > 0),
contents AS (SELECT s, max(bad) AS bad FROM texts JOIN marks USING (doc_id) WHERE bad IS NOT NULL GROUP BY s),
lines AS (SELECT line, any_value(s) AS s FROM (SELECT DISTINCT s, unnest(s) AS line FROM texts) GROUP BY line HAVING count(*) = 1),
pointers AS (SELECT line, bad FROM lines JOIN contents USING (s)),
bads AS (SELECT page_id, max(bad) AS bad FROM (SELECT page_id, unnest({_sql_sentences(_sql_page_text("html"))}) AS line FROM pages)
         JOIN pointers USING (line) GROUP BY page_id),
counts AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k FROM placed LEFT JOIN bads USING (page_id) GROUP BY host),
named AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM counts),
parted AS (SELECT *, string_split(name, '.') AS p FROM named),
paired AS (SELECT *, len(p) AS np, array_to_string(p[-2:], '.') AS two,
                  regexp_matches(name, '^([0-9]+\.){{3}}[0-9]+$|^\[.*\]$') OR len(p) < 2 AS address FROM parted),
hosts AS (SELECT host, n, k,
    CASE WHEN address THEN name WHEN two IN {SUFFIXES} AND np > 2 THEN array_to_string(p[-3:], '.') ELSE two END AS domain,
    CASE WHEN address THEN '' WHEN two IN {SUFFIXES} THEN two ELSE p[-1] END AS suffix FROM paired),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT *, ((sum(k) OVER () - k + 1.0::DOUBLE) / (sum(n) OVER () - n + 2.0::DOUBLE))::DOUBLE AS parent
  FROM (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix)),
{_sql_strength("s1", "suffixes")},
d2 AS (SELECT x.*, {_sql_rest("s")} FROM domains x JOIN suffixes u USING (suffix), s1),
{_sql_strength("s2", "d2")},
h2 AS (SELECT x.*, {_sql_rest("s")} FROM hosts x JOIN d2 u USING (domain, suffix), s2),
{_sql_strength("s3", "h2")},
ab AS (SELECT host, (k + s * parent)::DOUBLE AS a, (n - k + s * (1 - parent))::DOUBLE AS b FROM h2, s3),
known AS (SELECT host, round(a / (a + b), 6) AS bad_rate,
    round(greatest(a / (a + b) - {Z}::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 0.0), 6) AS bad_low FROM ab),
ruled AS (SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM placed JOIN known USING (host))
SELECT page_id, host, path, rule, CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
    WHEN 'example.com/de/' THEN 'block' WHEN 'net/' THEN 'block'
    ELSE CASE WHEN bad_low > {MAX_BAD_RATE} THEN 'block' ELSE 'allow' END END AS verdict, bad_rate, bad_low
FROM ruled
"""
