"""URL filters: listed rules first, then a ratio of two character language models.

Each model is a variable-order Markov model: the probability of a character given the five
before it is interpolated with that given four, three … none, weighted by how many different
characters followed the context (Witten-Bell). One is fitted on accepted, one on rejected URLs;
a URL is accepted if the difference of its log-likelihoods per character reaches a limit that
was calibrated on labelled URLs the models have not seen.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 5
ALPHABET = 256
MAX_URLS = 10_000  # labelled URLs of each class that the models are fitted on

Rule = tuple[str, str]
# The rules, as (verdict, host and path).
RULES: list[Rule] = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
                     ("allow", "com/fr/"), ("block", "com/de/")]


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ?, # or end, in lower case; '' without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or end; '' without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of verdict and rule; NULL if none does."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


class MarkovModel:
    """Counts of characters after contexts of up to `order` characters, Witten-Bell smoothed."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.follow: dict[str, dict[str, int]] = defaultdict(dict)

    def fit(self, texts: Sequence[str]) -> MarkovModel:
        for text in texts:
            padded = "\x02" * self.order + text + "\x03"
            for i in range(self.order, len(padded)):
                for k in range(self.order + 1):
                    seen = self.follow[padded[i - k:i]]
                    seen[padded[i]] = seen.get(padded[i], 0) + 1
        self.total = {c: (sum(f.values()), len(f)) for c, f in self.follow.items()}
        self.follow = dict(self.follow)
        return self

    def log_likelihood(self, text: str) -> float:
        """Natural logarithm of the probability of the text and its end."""
        padded, out = "\x02" * self.order + text + "\x03", 0.0
        for i in range(self.order, len(padded)):
            char, p = padded[i], 1.0 / ALPHABET
            for k in range(self.order + 1):
                context = padded[i - k:i]
                found = self.total.get(context)
                if found is None:
                    break  # a longer context was not seen either
                count, kinds = found
                p = (self.follow[context].get(char, 0) + kinds * p) / (count + kinds)
            out += math.log(p)
        return out


class UrlJudge:
    """Two models and the limit of their ratio."""

    def __init__(self, accepted: Sequence[str], rejected: Sequence[str], order: int = ORDER):
        hold = [i % 5 == 4 for i in range(max(len(accepted), len(rejected)))]
        part = lambda urls, held: [u for u, h in zip(urls, hold) if h == held]
        self.accept = MarkovModel(order).fit(part(accepted, False))
        self.reject = MarkovModel(order).fit(part(rejected, False))
        self.limit = 0.0
        good = np.sort([self.score(u) for u in part(accepted, True)])
        bad = np.sort([self.score(u) for u in part(rejected, True)])
        if len(good) and len(bad):
            # The middle of the scores between which the sum of both error rates is least.
            cuts = np.unique(np.r_[good, bad, good[-1] + 1e-9])
            errors = np.searchsorted(good, cuts) / len(good) + 1 - np.searchsorted(bad, cuts) / len(bad)
            best = np.flatnonzero(errors == errors.min())
            self.limit = float((cuts[max(best[0] - 1, 0)] + cuts[best[-1]]) / 2)

    def score(self, url: str) -> float:
        """Difference of the log-likelihoods per character; 0 if a model has seen no URL."""
        if not self.accept.total or not self.reject.total:
            return 0.0
        return (self.accept.log_likelihood(url) - self.reject.log_likelihood(url)) / (len(url) + 1)


def fit_judge(urls: DataFrame, rules: Sequence[Rule] = RULES, max_urls: int = MAX_URLS) -> UrlJudge:
    """Models of the URLs that the rules decide; of each class the `max_urls` distinct ones that
    come first by hash, a bounded sample that does not depend on how rows are dealt."""
    known = (urls.select("url", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules).alias("r"))
             .where("r is not null").select("url", F.col("r.verdict").alias("verdict")).distinct())
    sample: dict[str, list[str]] = {}
    for verdict in ("allow", "block"):
        rows = known.where(F.col("verdict") == verdict).orderBy(F.xxhash64("url"), "url").limit(max_urls)
        sample[verdict] = [r["url"] for r in rows.select("url").collect()]
    return UrlJudge(sample["allow"], sample["block"])


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, max_urls: int = MAX_URLS) -> DataFrame:
    """page_id, url, host, path, rule, score and verdict per row.

    The verdict is that of the longest rule that fits, else `allow` if the score reaches the
    calibrated limit. A NULL URL is judged like an empty one: empty host and path, no rule, and
    a score over no characters but the end. Without accepted or without rejected URLs to learn
    from every score is 0 and the limit too, so nothing is blocked but by rules. Repeated rows
    each get a row, an empty table gives none.
    """
    judge = fit_judge(pages, rules, max_urls)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"),
                        path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    shared = pages.sparkSession.sparkContext.broadcast(judge)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for urls in parts:
            yield urls.fillna("").map(own.score).astype(float)

    judged = F.when(F.col("score") >= F.lit(judge.limit), F.lit("allow")).otherwise(F.lit("block"))
    return (rows.select("page_id", "url", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("_v"),
                        score("url").alias("score"))
            .select("page_id", "url", "host", "path", "rule", "score", F.coalesce("_v", judged).alias("verdict")))
