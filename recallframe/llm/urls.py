"""URL filters: rules first, then the ratio of two character language models.

Rules are pairs of a host and the beginning of a path; they fit a host and all
its subdomains, and the longest wins. URLs that rules accept and reject train
one Markov model of variable order each; a URL without a rule is judged by the
difference of its log-likelihoods per character, with a threshold calibrated on
a fifth of the ruled URLs that the models didn't count.

The models are tables of exact counts and grow with the input: how often a
character follows each context of 0 to ``ORDER`` characters. Orders blend by
Witten-Bell weights, from a uniform start over all bytes and the end mark, so
the probabilities after any context sum to one. Each different run of
``ORDER + 1`` characters of the URLs is scored once, by joins with the counts,
and a URL's likelihood is the sum over its runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallframe.session import cut, stored, without

#: Longest context; symbols of the alphabet: the bytes and the end mark.
ORDER, ALPHABET = 5, 257
#: Marks outside of the bytes, which are written as characters of the same number.
BEGIN, END = "\u0100", "\u0101"
#: Bin width of the calibration's histogram in nats per character, and its number of bins to each side.
BIN, BINS = 0.01, 1000
FOLDS = 5
KINDS = ("block", "allow")


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched(df: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """``df`` with host, path, rule and the rule's verdict (null without a rule).

    The rules are a parameter and so small; each row looks at all of them in
    place, without a shuffle. Of equally long rules the first in order of text wins.
    """
    named = without(df, "host", "path", "rule", "verdict").withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    rule = verdict = F.lit(None).cast("string")
    for r in reversed(ordered):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return named.withColumn("rule", rule).withColumn("verdict", verdict)


def subject(host: Column, path: Column) -> Column:
    """Host and path, a character a byte."""
    return F.decode(F.encode(F.concat(host, path), "UTF-8"), "ISO-8859-1")


def runs(text: Column) -> Column:
    """All runs of ORDER + 1 characters of a marked subject, one for each character and the end mark."""
    marked = F.concat(F.lit(BEGIN * ORDER), text, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(marked, i, F.lit(ORDER + 1)))


def counts(subjects: DataFrame) -> DataFrame:
    """(run, block, allow): how often each run occurs in the ``subjects`` (subject, verdict, times) of each verdict."""
    each = subjects.select(F.explode(runs(F.col("subject"))).alias("run"), "verdict", "times")
    return each.groupBy("run").agg(*[F.sum(F.when(F.col("verdict") == k, F.col("times")).otherwise(0)).alias(k) for k in KINDS])


def likelihoods(asked: DataFrame, counted: DataFrame) -> DataFrame:
    """(run, block, allow): the natural logarithm of the probability of the last character after the others, by class.

    ``asked`` (run) holds different runs, ``counted`` those of ``counts``. After a
    context that a class hasn't seen, the next shorter one's probability holds.
    """
    now = asked.select("run", *[F.lit(1.0 / ALPHABET).alias(f"p_{k}") for k in KINDS])
    for order in range(ORDER + 1):
        gram = F.substring("run", ORDER + 1 - order, order + 1)
        grams = counted.groupBy(gram.alias("gram")).agg(*[F.sum(k).alias(f"n_{k}") for k in KINDS])
        context = F.substring("gram", 1, order) if order else F.lit("")
        grams = cut(grams.withColumn("context", context))
        contexts = grams.groupBy("context").agg(
            *[F.sum(f"n_{k}").alias(f"uses_{k}") for k in KINDS], *[F.count(F.when(F.col(f"n_{k}") > 0, 1)).alias(f"kinds_{k}") for k in KINDS]
        )
        keyed = now.withColumn("gram", gram).withColumn("context", context)
        joined = keyed.join(grams.drop("context"), "gram", "left").join(contexts, "context", "left")
        blended = []
        for k in KINDS:
            n, uses, kinds = (F.coalesce(F.col(f"{c}_{k}"), F.lit(0)) for c in ("n", "uses", "kinds"))
            p = F.when(uses > 0, (n + kinds * F.col(f"p_{k}")) / (uses + kinds)).otherwise(F.col(f"p_{k}"))
            blended.append(p.alias(f"p_{k}"))
        now = cut(joined.select("run", *blended))
    return now.select("run", *[F.log(f"p_{k}").alias(k) for k in KINDS])


def ratios(subjects: DataFrame, counted: DataFrame) -> DataFrame:
    """(subject, ratio) of different ``subjects``: log-likelihood as accepted less that as rejected, per character, the end mark being one."""
    each = stored(subjects.select("subject", F.posexplode(runs(F.col("subject"))).alias("at", "run")).select("subject", "run"))
    scores = likelihoods(each.select("run").distinct(), counted)
    gains = stored(scores.select("run", (F.col("allow") - F.col("block")).alias("gain")))
    # read back, the sides have no partitioning of their own, and Spark can split the join at runs that many URLs have
    found = each.join(gains, "run")
    # whole billionths add up alike in any order
    total = F.sum(F.round(F.col("gain") * 1e9).cast("long")) / 1e9
    return stored(found.groupBy("subject").agg((total / F.count("*")).alias("ratio")))


def _held(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)) == 0


def threshold(held: DataFrame) -> float:
    """The ratio that best parts accepted from rejected rows (verdict, times, ratio): largest sum of both classes' shares; 0 if one is missing.

    A threshold is the right end of a histogram's bin, of equally good ones the middle.
    """
    bins = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("ratio") / BIN))).cast("int")
    found = held.groupBy("verdict", bins.alias("bin")).agg(F.sum("times").alias("n")).collect()  # 4 * BINS + 2 rows at most
    hist = {k: [0] * (2 * BINS + 1) for k in KINDS}
    for r in found:
        hist[r["verdict"]][r["bin"] + BINS] += r["n"]
    total = {k: sum(hist[k]) for k in KINDS}
    if not all(total.values()):
        return 0.0
    below, gains = dict.fromkeys(KINDS, 0), []
    for i in range(2 * BINS + 1):
        for k in KINDS:
            below[k] += hist[k][i]
        gains.append(below["block"] * total["allow"] - below["allow"] * total["block"])
    best = [i for i, g in enumerate(gains) if g == max(gains)]
    return (best[len(best) // 2] - BINS + 1) * BIN


def judge(df: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """``df`` with host, path, rule, ratio and verdict (allow or block).

    Null URLs and URLs without ``://`` have an empty host and path and, as rules
    don't fit, the method's verdict. Without ruled URLs of both kinds nothing can
    be told: the ratio is 0 and all others are allowed. Repeated URLs count as
    often as they occur. Input columns of these names are replaced.
    """
    named = matched(without(df, "ratio", "__subject"), rules, url).withColumn("__subject", subject(F.col("host"), F.col("path")))
    # equal subjects have equal rules
    subjects = cut(named.groupBy(F.col("__subject").alias("subject")).agg(F.first("verdict").alias("verdict"), F.count("*").alias("times")))
    ruled = subjects.where("verdict is not null")
    learned = counts(ruled.where(~_held(F.col("subject"))))
    if ruled.where(~_held(F.col("subject"))).select("verdict").distinct().count() == len(KINDS):
        scored = ratios(subjects.select("subject"), cut(learned))
        least = threshold(ruled.where(_held(F.col("subject"))).join(scored, "subject"))
    else:
        scored, least = subjects.select("subject", F.lit(0.0).alias("ratio")), 0.0
    joined = named.join(scored.withColumnRenamed("subject", "__scored"), F.col("__subject") == F.col("__scored"))
    told = F.when(F.col("ratio") >= least, F.lit("allow")).otherwise(F.lit("block"))
    return joined.withColumn("verdict", F.coalesce("verdict", told)).drop("__subject", "__scored")
