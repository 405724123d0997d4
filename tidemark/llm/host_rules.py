r"""Host-level quality rules, in DataFrame functions alone.

Each document is measured and held against the rules; failures are summed per
host and rule.  A host's failure rate is shrunk towards the rate of all hosts by
a beta prior, whose mean and strength come from the hosts themselves (moments
of a beta-binomial, as Kleinman weighs them by size): hosts that differ little
are pulled together, hosts that differ much keep their own rates, and a host of
few documents is judged by little more than the prior.  A host whose shrunk
rate under any rule passes ``limit`` is rejected, and the verdict is joined
back: a document is kept if it passes the base rules and its host stands.

Documents are measured once, each within its own row; what is stored and
travels are counts, not texts.  Sums are formed before the shuffle, so a host
of a third of all rows adds one row a task.  Verdicts travel only of rejected
hosts: broadcast up to ``max_broadcast`` hosts, beyond it by a join in which
every host is dealt out ``SALT`` times.

Cases: a null text has no words and fails as too short.  A null or empty host
is no host: such documents are judged by the base rules alone.  Very long texts
are measured whole, in time about linear in their words.  Repeated rows count
each.  A rate that equals ``limit`` passes.  Where hosts are alike, or there is
but one, the prior has its greatest strength and all are judged by the mean.  An
empty table gives no rows, and columns of any other name play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, documents

#: White space between words.
SPACES = " \t\n\x0b\f\r"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words in a window whose repetition counts.
WINDOW = 5
#: Parts that a host's documents are dealt into where verdicts are too many to broadcast.
SALT = 64
#: Rejected hosts that are broadcast; each row is a host name.
MAX_BROADCAST = 100_000
#: Bounds of the prior's strength, in documents.
WEAKEST, STRONGEST = 1.0, 1e6

#: The rules: the conditions under which a document fails, over the columns of ``measured``.
BASE_RULES = {"few_words": "n_words < 10", "repeated_words": "100 * n_repeat_words > 20 * n_words"}
HOST_RULES = {
    **BASE_RULES,
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 3 * n_words or word_chars > 10 * n_words",
}


def host_of(place: Column) -> Column:
    """The host of a URL, without port, user and ``www.``, or else the name itself; lower-cased, null if empty."""
    host = F.regexp_extract(place, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    name = F.lower(F.when(host != "", host).otherwise(place))
    return F.nullif(F.regexp_replace(name, r"^www\.", ""), F.lit(""))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _covered(windows: Column, size: int) -> Column:
    """Words under windows whose digest occurs twice or more: the windows' places in order, each up to the next."""

    def twice(s: Column) -> Column:
        other = lambda i, step: F.get(s, i + F.lit(step))["h"]
        return F.transform(s, lambda x, i: F.when((x["h"] == other(i, -1)) | (x["h"] == other(i, 1)), x["at"]))

    by_digest = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    places = F.sort_array(F.filter(_let(by_digest, twice), lambda x: x.isNotNull()))
    reach = _let(places, lambda p: F.transform(p, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(p, i + F.lit(1)) - x, F.lit(size)))))
    return F.aggregate(reach, F.lit(0).cast("long"), lambda total, x: total + x)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row of ``docs``: doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Lines without a word are no lines.  Windows are told apart by 64-bit digests
    within one text.
    """
    own = documents(docs, id_col, text_col, (host_col,)).toDF("doc_id", "text", "place")
    # each array has two uses or more, so the planner computes it once and does not repeat it where it is used
    split = own.select("doc_id", "text", host_of(F.col("place")).alias("host"), F.filter(F.split("text", rf"[{SPACES}]+"), lambda w: w != "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(rf"[^{SPACES}]")).alias("lines"))
    at = F.sequence(F.lit(1), F.size("words") - F.lit(WINDOW - 1))
    hashed = _let(F.col("words"), lambda w: F.transform(at, lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW)))))
    whole = split.withColumn("windows", F.when(F.size("words") >= WINDOW, hashed).otherwise(F.array().cast("array<bigint>")))
    left = lambda gone: F.char_length(F.translate("text", gone, ""))
    return whole.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        left(SPACES).cast("long").alias("word_chars"),
        (F.char_length("text") - left(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("windows") > F.size(F.array_distinct("windows")), _covered(F.col("windows"), WINDOW)).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def host_rates(documents_measured: DataFrame, rules: dict[str, str] = HOST_RULES, weakest: float = WEAKEST, strongest: float = STRONGEST) -> DataFrame:
    """Per host and rule: host, rule, n (documents), failures, rate, prior_mean, prior_strength and the rate shrunk, ``shrunk``."""
    sums = documents_measured.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(F.expr(rule)).alias(f"f_{name}") for name, rule in rules.items()])
    one = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"f_{name}").alias("failures")) for name in rules]))
    rates = cut(sums.select("host", "n", one.alias("x")).select("host", "x.rule", "n", "x.failures"))
    n, k = F.col("n").cast("double"), F.col("failures").cast("double")
    moments = rates.groupBy("rule").agg(F.count("*").cast("double").alias("hosts"), F.sum(n).alias("docs"), F.sum(n * n).alias("squares"), F.sum(k).alias("failed"), F.sum(k * k / n).alias("spread"))
    mean = F.col("failed") / F.col("docs")
    # expected spread of the rates: binomial alone, and what a unit of correlation within hosts adds
    plain = F.col("hosts") - 1
    seen = F.try_divide(F.col("spread") - F.col("failed") * mean, mean * (1 - mean))
    correlation = F.try_divide(seen - plain, F.col("docs") - F.col("squares") / F.col("docs") - plain)
    strength = F.when(correlation > 0, F.greatest(F.lit(weakest), F.least(F.lit(strongest), 1 / correlation - 1))).otherwise(F.lit(strongest))
    # one row a rule
    prior = moments.select("rule", mean.alias("prior_mean"), strength.alias("prior_strength"))
    shrunk = (k + F.col("prior_strength") * F.col("prior_mean")) / (n + F.col("prior_strength"))
    return rates.join(F.broadcast(prior), "rule").select("host", "rule", "n", "failures", (k / n).alias("rate"), "prior_mean", "prior_strength", shrunk.alias("shrunk"))


def rejected_hosts(rates: DataFrame, limit: float = 0.5) -> DataFrame:
    """Hosts with a shrunk rate over ``limit`` under any rule, and these rules: (host, rules)."""
    return rates.where(F.col("shrunk") > limit).groupBy("host").agg(F.sort_array(F.collect_list("rule")).alias("rules"))


def _with_verdict(rows: DataFrame, rejected: DataFrame, max_broadcast: int) -> DataFrame:
    """``rows`` with ``refused``: the rules their host is rejected by, null if it stands."""
    names = rejected.select(F.col("host").alias("_host"), F.col("rules").alias("refused"))
    if names.limit(max_broadcast + 1).count() <= max_broadcast:
        return rows.join(F.broadcast(names), rows["host"] == F.col("_host"), "left").drop("_host")
    dealt = names.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(SALT)).cast("int"))
    return salted.join(dealt, (F.col("host") == F.col("_host")) & (F.col("_salt") == F.col("_part")), "left").drop("_host", "_salt", "_part")


def judged(docs: DataFrame, limit: float = 0.5, rules: dict[str, str] = HOST_RULES, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The columns of ``measured`` with base_failed, the rules the host is rejected by (``refused``), and kept."""
    rows = cut(measured(docs, id_col, text_col, host_col))
    rejected = cut(rejected_hosts(host_rates(rows, rules), limit))
    base = F.expr(" or ".join(f"({rule})" for rule in BASE_RULES.values()))
    return _with_verdict(rows, rejected, max_broadcast).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & F.col("refused").isNull())


def digests(result: DataFrame) -> DataFrame:
    """The contract columns from the operator's result."""
    return result.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_NAMED = ", ".join(f"('{name}')" for name in HOST_RULES)
_FAILED = " ".join(f"WHEN '{name}' THEN {rule}" for name, rule in HOST_RULES.items())

#: The same in DuckDB, windows compared as lists of words.
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    nullif(regexp_replace(lower(CASE WHEN regexp_matches(source, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)') THEN regexp_extract(source, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1) ELSE source END), '^www\.', ''), '') AS host FROM documents),
win AS (SELECT rid, i, w[i:i + 4] AS g FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) >= 2),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(generate_series(i, i + 4)) AS p FROM twice) GROUP BY rid),
ln AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(ln.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(ln.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN ln USING (rid) LEFT JOIN rep USING (rid)),
rates AS (
  SELECT host, rule, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (CASE rule {_FAILED} END) AS DOUBLE) AS k
  FROM m, (VALUES {_NAMED}) AS named(rule) WHERE host IS NOT NULL GROUP BY host, rule),
mom AS (SELECT rule, count(*) - 1 AS plain, sum(n) AS docs, sum(n * n) AS squares, sum(k) AS failed, sum(k) / sum(n) AS mean, sum(k * k / n) AS spread FROM rates GROUP BY rule),
cor AS (
  SELECT rule, mean, CASE WHEN mean > 0 AND mean < 1 AND docs - squares / docs - plain <> 0 THEN ((spread - failed * mean) / (mean * (1 - mean)) - plain) / (docs - squares / docs - plain) END AS c FROM mom),
pri AS (SELECT rule, mean, CASE WHEN c > 0 THEN greatest({WEAKEST}, least({STRONGEST}, 1 / c - 1)) ELSE {STRONGEST} END AS strength FROM cor),
bad AS (SELECT DISTINCT host FROM rates JOIN pri USING (rule) WHERE (k + strength * mean) / (n + strength) > 0.5),
v AS (SELECT m.*, ({BASE_RULES["few_words"]}) OR ({BASE_RULES["repeated_words"]}) AS base_failed, bad.host IS NOT NULL AS refused FROM m LEFT JOIN bad ON bad.host = m.host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT refused AS kept FROM v
"""
