"""Quality rules with host verdicts. DataFrame functions only.

Each document is measured in its own row (no text or word is shuffled) and held against rules on length, repeated
words, symbols and repeated lines. Failures of each rule are counted by host; a host's failure rate of a rule is shrunk towards
a beta prior that the method of moments finds from all hosts (empirical Bayes), and a host is refused where a shrunk rate lies more than ``deviations``
standard deviations of the prior above its mean, and is ``least_rate`` at least (what hosts have in common, or a few of many documents, refuses none). Its verdict is joined
back to its documents.

Words are runs of characters other than space and U+0009-U+000D. A word of a 3-word window that occurs twice
or more in its text is a repeated word; windows are compared by a 64-bit hash of their three words.

Defined results: a null text has no word and fails; null is a host of its own; a host with few documents
stays near the prior; rows repeated under one id are measured and counted one by one; an empty table gives an empty result; other columns are
ignored. The host may be a column or an expression, such as ``host_of`` an address.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm._work import SPACE, SPACE_CHARS, let, materialize

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
WINDOW = 3
DEVIATIONS, LEAST_RATE = 3.0, 0.25


def _repeat_words(words) -> F.Column:
    """Positions covered by windows that occur twice or more: sort the window hashes, mark equal neighbours, and add up
    what each marked window covers before the next begins. n log n in the words of a text."""
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(h):
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda e, i: F.coalesce(e["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(s, i + 1)["h"], F.lit(False)))
        at = let(ordered, lambda s: F.sort_array(F.transform(twice(s), lambda e: e["i"])))
        steps = let(at, lambda p: F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), lambda a, x: a + x))

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(hashes, covered))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: F.Column | str = "source") -> DataFrame:
    """(id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    host = F.col(host) if isinstance(host, str) else host
    drop = lambda x, chars: F.length(F.translate(x, chars, ""))
    rows = docs.select(F.col(id_col).alias("id"), host.cast("string").alias("host"), text.alias("t"))
    rows = rows.select(
        "id", "host", drop(F.col("t"), SPACE_CHARS).alias("word_chars"), (F.length("t") - drop(F.col("t"), SYMBOLS)).alias("n_symbols"),
        let(F.filter(F.split("t", "\n", -1), lambda x: drop(x, SPACE_CHARS) > 0), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("lines"),
        let(F.array_remove(F.split("t", SPACE, -1), ""), lambda x: F.struct(F.size(x).alias("n"), _repeat_words(x).alias("r"))).alias("words"),
    )
    long = lambda c, name: c.cast("long").alias(name)
    return rows.select("id", "host", long(F.col("words.n"), "n_words"), long(F.col("word_chars"), "word_chars"), long(F.col("n_symbols"), "n_symbols"), long(F.col("lines.n"), "n_lines"), long(F.col("lines.n") - F.col("lines.d"), "n_dup_lines"), long(F.col("words.r"), "n_repeat_words"))


def failures(least_words: int = LEAST_WORDS) -> dict[str, F.Column]:
    """Rule name to whether a measured row fails it."""
    return {
        "short": F.col("n_words") < least_words,
        "repeats": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": F.col("n_symbols") * 5 > F.col("n_words"),
        "lines": F.col("n_dup_lines") * 2 > F.col("n_lines"),
    }


def host_of(url) -> F.Column:
    """The host of an address, in lower case; null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def host_rates(measured: DataFrame, deviations: float = DEVIATIONS, least_rate: float = LEAST_RATE) -> DataFrame:
    """(host, docs, refused) and for each rule (rate_.., limit_..): failure rates shrunk by a beta prior fitted to all hosts, and the rate above which a host is refused."""
    rules = failures()
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), *[F.sum(r.cast("long")).alias(k) for k, r in rules.items()])
    n = F.col("docs").cast("double")
    sums = [F.struct(F.sum(F.col(k).cast("double")).alias("f"), F.sum(F.col(k) * F.col(k) / n).alias("sq")).alias(k) for k in rules]
    whole = hosts.agg(F.sum(n).alias("n"), F.count(F.lit(1)).cast("double").alias("h"), *sums).first()  # a few numbers; null without hosts
    out, refused = hosts.select("host", "docs", *rules), F.lit(False)
    for k in rules:
        total, f, sq = whole["n"] or 1.0, whole[k]["f"] or 0.0, whole[k]["sq"] or 0.0
        mean = f / total
        noise = mean * (1 - mean)
        spread = sq / total - mean * mean - noise * whole["h"] / total
        strength = min(max(noise / max(spread, 1e-9) - 1, 1.0), 1e6)
        limit = max(mean + deviations * (noise / (strength + 1)) ** 0.5, least_rate)
        out = out.withColumn(f"rate_{k}", (F.col(k) + mean * strength) / (n + strength)).withColumn(f"limit_{k}", F.lit(limit))
        refused = refused | (F.col(f"rate_{k}") > limit)
    return out.drop(*rules).withColumn("refused", refused)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: F.Column | str = "source", deviations: float = DEVIATIONS, least_rate: float = LEAST_RATE) -> DataFrame:
    """The measures with base_failed, host_refused and kept, one row for each row of ``docs``."""
    measured = materialize(measure(docs, id_col, text_col, host), "measures")
    rules = failures()
    verdicts = host_rates(measured, deviations, least_rate).select(F.col("host").alias("_host"), F.col("refused").alias("host_refused"))
    rows = measured.withColumn("base_failed", rules["short"] | rules["repeats"]).join(verdicts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.col("host_refused"))


_RULES = {"short": "n_words < 50", "repeats": "100 * n_repeat_words > 50 * n_words", "symbols": "n_symbols * 5 > n_words", "lines": "n_dup_lines * 2 > n_lines"}
ORACLE = """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
m AS (SELECT doc_id, source, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM w),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
a AS (SELECT m.*, coalesce(rep.n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a),
f AS (""" + " UNION ALL ".join(f"SELECT source, '{k}' AS rule, count(*)::DOUBLE AS n, count(*) FILTER ({r})::DOUBLE AS f FROM b GROUP BY source" for k, r in _RULES.items()) + """),
s AS (SELECT rule, sum(f) / sum(n) AS mu, sum(f * f / n) / sum(n) AS sq, count(*) / sum(n) AS hn FROM f GROUP BY rule),
p AS (SELECT rule, mu, least(greatest(mu * (1 - mu) / greatest(sq - mu * mu - mu * (1 - mu) * hn, 1e-9) - 1, 1.0), 1e6) AS k FROM s),
r AS (SELECT source, bool_or((f + mu * k) / (n + k) > greatest(mu + 3.0 * sqrt(mu * (1 - mu) / (k + 1)), 0.25)) AS host_refused FROM f JOIN p USING (rule) GROUP BY source)
SELECT b.doc_id, CAST(b.n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT host_refused AS kept, host_refused
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
"""
