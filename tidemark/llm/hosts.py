"""URL filter: longest matching rule, else the host's reputation.

A page's outcome is known where its address names a labelled document (``/xx/<number>``); it is bad if that document is
of quality 0 or toxic. Outcomes are shrunk by beta-binomial priors: a suffix towards all pages, a registered domain
towards its suffix, a host towards its domain. The strength of each prior comes from how far its children lie apart
beyond chance (moments of the beta-binomial; the spread is held between 1e-4 and 0.5, a prior of 1 to 9,999 outcomes).

A host is blocked if the lower LEVEL quantile of its beta posterior is above a bound, that is if the posterior puts less than
LEVEL below it (the incomplete beta function, as a continued fraction whose length grows with the root of the counts).
The bound has WORSE times the odds of all outcomes (a base rate of a quarter gives a half), so that an average host is never
blocked, however many pages it has; ``most_bad`` sets it outright.

A host's name is taken without its port and a last dot; an address in numbers or brackets is a domain of the suffix ``ip``.
A suffix is the longest of ``suffixes`` that fits (``read_suffixes`` reads a list in the public format), else two labels
where a country's letters follow one of SECOND, else one label.

DataFrame functions only; outcomes are added up by host, and written, before anything meets. Defined cases: null urls, or
urls without ``://``, have an empty host and path and no rule; labels that repeat a document count once (worst outcome);
pages that repeat count each; labels with neither mark are no outcome; without outcomes nothing is blocked; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from math import log, pi
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch

# fixed values
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
SECOND = ["ac", "co", "com", "edu", "gob", "gov", "mil", "net", "or", "org"]
WORSE = 3.0  # times the odds of all outcomes that a blocked host's odds of a bad page surely are
LEVEL = 0.05


def parse(pages: DataFrame) -> DataFrame:
    url = F.col("url").cast("string")
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(cast(url AS string), instr(cast(url AS string), '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


def matching(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits; of rules of equal length a block wins."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        name, slash, path = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(slash + path)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def read_suffixes(path: str) -> list[str]:
    """Suffixes of several labels from a file with one a line; comments (``//``), wildcards and exceptions are left out."""
    with open(path, encoding="utf-8") as file:
        lines = [line.split()[0].lower() for line in file if line.strip() and not line.startswith(("//", "*", "!"))]
    return sorted({line for line in lines if "." in line})


def levels(hosts: DataFrame, suffixes: list[str] = ()) -> DataFrame:
    """hosts with the registered domain and the suffix of each host."""
    bare = F.regexp_replace(F.regexp_replace("host", r":[0-9]*$", ""), r"\.$", "")
    last = lambda n: F.regexp_extract("__bare", r"[^.]+" + r"\.[^.]+" * (n - 1) + "$", 0)
    number = F.col("__bare").rlike(r"^[0-9]+(\.[0-9]+){3}$") | F.col("__bare").startswith("[")
    deep = F.lit(1)
    if SECOND:
        deep = F.when(last(2).rlike(rf"^({'|'.join(SECOND)})\.[a-z][a-z]$"), 2).otherwise(deep)
    for n in sorted({x.count(".") + 1 for x in suffixes}):
        deep = F.when(last(n).isin([x for x in suffixes if x.count(".") + 1 == n]), n).otherwise(deep)
    most = max([2, *(x.count(".") + 1 for x in suffixes)])
    pick = lambda more: F.coalesce(*(F.when(F.col("__deep") == n, last(n + more)) for n in range(1, most + 1)))
    placed = hosts.withColumn("__bare", bare).withColumn("__deep", deep)
    domain = F.when(number | (pick(1) == ""), F.col("__bare")).otherwise(pick(1))
    return placed.withColumns({"domain": domain, "suffix": F.when(number, "ip").otherwise(pick(0))}).drop("__bare", "__deep")


def _strength(children: DataFrame) -> float:
    """Prior sample size of children (n, bad, prior) from their spread about their priors."""
    chance = F.col("prior") * (1 - F.col("prior"))
    far = F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2) / chance
    got = children.filter((F.col("n") > 0) & (chance > 0)).agg(F.sum(far).alias("q"), F.count("*").alias("k"), F.sum("n").alias("n")).first()
    spread = (got.q - got.k) / (got.n - got.k) if got.n and got.n > got.k else 0.0
    return 1 / min(max(spread, 1e-4), 0.5) - 1


def log_gamma(z: Column) -> Column:
    """Stirling's series, eight places further up."""
    up = z + 8
    series = (up - 0.5) * F.ln(up) - up + 0.5 * log(2 * pi) + 1 / (12 * up) - 1 / (360 * F.pow(up, 3)) + 1 / (1260 * F.pow(up, 5))
    return series - sum((F.ln(z + k) for k in range(1, 8)), F.ln(z))


def beta_below(x: float, a: Column, b: Column) -> Column:
    """How much of a beta distribution lies below x."""
    turn = F.lit(x) > (a + 1) / (a + b + 2)  # the fraction converges fast on the other side of the mean
    p, q, at = F.when(turn, b).otherwise(a), F.when(turn, a).otherwise(b), F.when(turn, 1 - x).otherwise(x)
    terms = (60 + 4 * F.ceil(F.sqrt(a + b))).cast("int")

    def step(f: Column, m: Column) -> Column:
        k = F.floor(m / 2)
        even = k * (q - k) * at / ((p + 2 * k - 1) * (p + 2 * k))
        odd = -(p + k) * (p + q + k) * at / ((p + 2 * k) * (p + 2 * k + 1))
        return 1 + F.when(m % 2 == 0, even).otherwise(odd) / f

    fraction = F.aggregate(F.sequence(terms, F.lit(1)), F.lit(1.0).cast("double"), step)
    front = F.exp(p * F.ln(at) + q * F.ln(1 - at) + log_gamma(p + q) - log_gamma(p) - log_gamma(q))
    return F.when(turn, 1 - front / p / fraction).otherwise(front / p / fraction)


def reputations(pages: DataFrame, labels: DataFrame, most_bad: float | None = None, suffixes: list[str] = ()) -> DataFrame:
    """(host, n, bad, mean, below): outcomes, posterior mean of each host's chance of a bad page, posterior mass below the bound."""
    outcome = labels.filter("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").cast("long").alias("named"))
    outcome = outcome.agg(F.max(F.expr("cast(coalesce(quality = 0, false) OR coalesce(toxic = 1, false) AS int)")).alias("is_bad"))
    number = F.expr("try_cast(regexp_extract(path, '^/[a-z][a-z]/([0-9]+)', 1) AS bigint)")
    known = pages.select("host", number.alias("number")).join(outcome, F.col("number") == F.col("named"))
    counts = known.groupBy("host").agg(F.count("*").alias("n"), F.sum("is_bad").alias("bad"))
    hosts = Scratch(pages.sparkSession, "hosts").keep(levels(counts, suffixes))
    whole = hosts.agg(F.sum("n"), F.sum("bad")).first()
    bad, good = (whole[1] or 0) + 0.5, (whole[0] or 0) - (whole[1] or 0) + 0.5
    bound = WORSE * bad / (WORSE * bad + good) if most_bad is None else most_bad
    upper = None
    for level in ("suffix", "domain", "host"):
        keys = {"suffix": ["suffix"], "domain": ["domain", "suffix"], "host": ["host", "domain"]}[level]
        mine = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        if upper is None:
            mine = mine.withColumns({"ua": F.lit(bad), "ub": F.lit(good)})
        else:
            key = keys[1]
            mine = mine.join(upper.select(F.col(key).alias("up"), F.col("a").alias("ua"), F.col("b").alias("ub")), F.col(key) == F.col("up")).drop("up")
        # the parent as it is without this child, so that no outcome counts twice
        mine = mine.withColumns({"ua": F.col("ua") - F.col("bad"), "ub": F.col("ub") - F.col("n") + F.col("bad")})
        mine = mine.withColumns({"prior": F.col("ua") / (F.col("ua") + F.col("ub")), "known": F.col("ua") + F.col("ub")})
        size = 1 / (1 / F.lit(_strength(mine)) + 1 / F.col("known"))  # no prior is surer than its parent
        upper = mine.withColumns({"a": F.col("bad") + size * F.col("prior"), "b": F.col("n") - F.col("bad") + size * (1 - F.col("prior"))})
        upper = upper.withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))
    return upper.select("host", "n", "bad", "mean", beta_below(bound, F.col("a"), F.col("b")).alias("below"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, most_bad: float | None = None, suffixes: list[str] = ()) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each page."""
    parsed = parse(pages)
    worst = reputations(parsed, labels, most_bad, suffixes).filter(F.col("below") < LEVEL).select(F.col("host").alias("blocked"))
    rule, action = matching(rules)
    out = parsed.join(worst, F.col("host") == F.col("blocked"), "left")
    own = F.when(F.col("blocked").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, own).alias("verdict"))


ORACLE = f"""
WITH parsed AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*', 0), ''), '{ascii_uppercase}', '{ascii_lowercase}') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)),
outcome AS (
  SELECT doc_id, max((coalesce(quality = 0, false) OR coalesce(toxic = 1, false))::INT) AS is_bad FROM labels
  WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
bare AS (
  SELECT host, count(*) AS n, sum(is_bad) AS bad, regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '[.]$', '') AS name
  FROM parsed JOIN outcome ON try_cast(regexp_extract(path, '^/[a-z][a-z]/([0-9]+)', 1) AS BIGINT) = doc_id GROUP BY host),
cut AS (
  SELECT *, regexp_matches(name, '^[0-9]+([.][0-9]+){{3}}$') OR starts_with(name, '[') AS is_number,
    regexp_matches(regexp_extract(name, '[^.]+[.][^.]+$', 0), '^({"|".join(SECOND)})[.][a-z][a-z]$') AS deep FROM bare),
placed AS (
  SELECT host, n, bad,
    CASE WHEN is_number THEN 'ip' WHEN deep THEN regexp_extract(name, '[^.]+[.][^.]+$', 0) ELSE regexp_extract(name, '[^.]+$', 0) END AS suffix,
    CASE WHEN is_number THEN name ELSE
      coalesce(nullif(CASE WHEN deep THEN regexp_extract(name, '[^.]+[.][^.]+[.][^.]+$', 0) ELSE regexp_extract(name, '[^.]+[.][^.]+$', 0) END, ''), name) END AS domain
  FROM cut),
whole AS (SELECT sum(bad) + 0.5 AS a, sum(n) - sum(bad) + 0.5 AS b FROM placed),
s0 AS (SELECT *, ua / (ua + ub) AS prior, ua + ub AS known FROM (SELECT suffix, n, bad, a - bad AS ua, b - n + bad AS ub FROM (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM placed GROUP BY suffix), whole)),
sk AS (SELECT 1 / least(greatest(coalesce(CASE WHEN sum(n) > count(*) THEN (sum(n * power(bad / n - prior, 2) / (prior * (1 - prior))) - count(*)) / (sum(n) - count(*)) END, 0), 0.0001), 0.5) - 1 AS k
  FROM s0 WHERE n > 0 AND prior * (1 - prior) > 0),
s1 AS (SELECT *, bad + prior / (1 / k + 1 / known) AS a, n - bad + (1 - prior) / (1 / k + 1 / known) AS b FROM s0, sk),
d0 AS (SELECT *, ua / (ua + ub) AS prior, ua + ub AS known FROM (SELECT c.*, s1.a - c.bad AS ua, s1.b - c.n + c.bad AS ub FROM (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM placed GROUP BY domain, suffix) c JOIN s1 USING (suffix))),
dk AS (SELECT 1 / least(greatest(coalesce(CASE WHEN sum(n) > count(*) THEN (sum(n * power(bad / n - prior, 2) / (prior * (1 - prior))) - count(*)) / (sum(n) - count(*)) END, 0), 0.0001), 0.5) - 1 AS k
  FROM d0 WHERE n > 0 AND prior * (1 - prior) > 0),
d1 AS (SELECT *, bad + prior / (1 / k + 1 / known) AS a, n - bad + (1 - prior) / (1 / k + 1 / known) AS b FROM d0, dk),
h0 AS (SELECT *, ua / (ua + ub) AS prior, ua + ub AS known FROM (SELECT c.host, c.n, c.bad, d1.a - c.bad AS ua, d1.b - c.n + c.bad AS ub FROM placed c JOIN d1 USING (domain))),
hk AS (SELECT 1 / least(greatest(coalesce(CASE WHEN sum(n) > count(*) THEN (sum(n * power(bad / n - prior, 2) / (prior * (1 - prior))) - count(*)) / (sum(n) - count(*)) END, 0), 0.0001), 0.5) - 1 AS k
  FROM h0 WHERE n > 0 AND prior * (1 - prior) > 0),
h1 AS (SELECT *, bad + prior / (1 / k + 1 / known) AS a, n - bad + (1 - prior) / (1 / k + 1 / known) AS b FROM h0, hk),
turned AS (
  SELECT host, h1.a, h1.b, bound > (h1.a + 1) / (h1.a + h1.b + 2) AS turn, CASE WHEN turn THEN h1.b ELSE h1.a END AS p, CASE WHEN turn THEN h1.a ELSE h1.b END AS q,
    CASE WHEN turn THEN 1 - bound ELSE bound END AS x FROM h1, (SELECT {WORSE}::DOUBLE * a / ({WORSE} * a + b) AS bound FROM whole)),
summed AS (
  SELECT host, turn, exp(p * ln(x) + q * ln(1 - x) + lgamma(p + q) - lgamma(p) - lgamma(q)) / p
    / list_reduce(list_reverse(range(1, 61 + 4 * ceil(sqrt(a + b))::BIGINT))::DOUBLE[], lambda f, m: 1 + CASE
      WHEN m % 2 = 0 THEN (m / 2) * (q - m / 2) * x / ((p + m - 1) * (p + m))
      ELSE -(p + (m - 1) / 2) * (p + q + (m - 1) / 2) * x / ((p + m - 1) * (p + m)) END / f, 1.0::DOUBLE) AS tail FROM turned),
blocked AS (SELECT host FROM summed WHERE CASE WHEN turn THEN 1 - tail ELSE tail END < {LEVEL}),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parsed)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
