"""URL filter: host and path rules first, then logistic regression on hashed character n-grams.

The classifier is trained from a small labelled URL table: the caller's, or addresses
built from the word lists below in the shapes that both kinds of sites use, so that
only the words tell them apart.  Words are also joined with each other and with neutral
ones, as sites join them, so that unseen compounds of known parts are recognised.

Cases: null urls and urls without ``://`` have empty host and path and take the
classifier's verdict on nothing, which is allow; repeated rows get equal verdicts;
very long urls are judged whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import features, kernel

#: (host, path start, verdict); the longest that fits wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

BLOCK_WORDS = (
    "casino", "poker", "slots", "jackpot", "betting", "bets", "bookmaker", "roulette", "gamble", "lottery",
    "pills", "viagra", "pharma-deals", "weight-loss", "xxx", "porn", "adult-cams", "sex-dating", "escorts", "hot-singles",
    "adserver", "ads", "adclick", "clickbait", "popups", "spam", "malware", "phish", "free-money", "crypto-profit", "get-rich",
    "payday-loans", "replica-watches", "warez", "torrents", "cracked-keys", "fake-followers", "seo-links", "buy-likes", "miracle-cure",
)
ALLOW_WORDS = (
    "news", "library", "museum", "school", "university", "weather", "recipes", "garden", "travel", "history", "science", "maths", "physics",
    "health", "hospital", "council", "archive", "forum", "journal", "review", "music", "theatre", "cinema", "sports", "football", "chess",
    "photos", "maps", "trains", "books", "poetry", "letters", "reading", "teacher", "students", "research", "institute", "software", "kernel",
    "python", "docs", "wiki", "encyclopedia", "dictionary", "language", "nature", "birds", "rivers", "mountain", "kitchen", "bakery", "craft",
    "winter", "better", "alphabet", "adsorption", "slotted", "shadows", "trackway", "beta-test", "island", "therapist", "pillow", "essex",
    "station", "orchard", "harbour", "village", "painter", "weaver", "thunder", "feather", "leather", "motion", "nation", "lantern", "stone", "ready", "whole",
)
DIMS = 1 << 13
ORDERS = (3, 4, 5)


#: Parts that sites of both kinds carry.
NEUTRAL = ("my", "the", "best", "online", "club", "shop", "world", "city", "free", "top", "24", "hub", "zone", "blog")


def labelled_urls(block: tuple[str, ...] = BLOCK_WORDS, allow: tuple[str, ...] = ALLOW_WORDS) -> list[tuple[str, str, int]]:
    """The small labelled table: (host, path, 1 = block), each word in the shapes below."""
    out = []
    for label, words in ((1, block), (0, allow)):
        joined = [f"{words[i * 7 % len(words)]}{'-' * (i % 2)}{words[(i * 7 + 3) % len(words)]}" for i in range(len(words))]
        joined += [f"{NEUTRAL[i % len(NEUTRAL)]}{'-' * (i % 2)}{w}" if i % 3 else f"{w}{'-' * (i % 2)}{NEUTRAL[i % len(NEUTRAL)]}" for i, w in enumerate(words)]
        for i, w in enumerate([*words, *joined]):
            tld = ("com", "org", "net", "info")[i % 4]
            sub = ("", "www.", "m.", "blog.")[i // 4 % 4]
            lang = ("en", "de", "fr", "es")[i % 4]
            out += [
                (f"{sub}{w}.example.{tld}", f"/{lang}/{1000 + 37 * i}.html", label),
                (f"{w}.{tld}", "/", label),
                (f"www.{w}.example.com", f"/{lang}/{(i * 71) % 9000}", label),
                (f"m.site{i}.{tld}", f"/{w}/{lang}/index.html", label),
            ]
    return out


def _features(keys: list[str]) -> np.ndarray:
    col = pa.array(keys, pa.string())
    x = features.by_chunk(col, lambda buf, offs: features.grams(kernel.LOWER[buf], offs, ORDERS, DIMS), DIMS)
    return np.minimum(x, 1)


def _key(host: str, path: str) -> str:
    return f"^{host.replace('.', ' . ')}$ {path}"


class Model:
    """Logistic weights of the hashed n-grams."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        y = np.array([r[2] for r in rows], float)
        x = _features([_key(h, p) for h, p, _ in rows])
        share = np.array([(y == 0).sum(), (y == 1).sum()])
        self.w, self.b = features.logistic(x, y, l2=1e-4, steps=600, weight=1 / np.maximum(share[y.astype(int)], 1))

    def blocked(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        keys = [_key(h, p) for h, p in zip(hosts, paths)]
        z = _features(keys) @ self.w[:, 0] + self.b[0]
        return (z > 0) & np.array([len(h) + len(p) > 0 for h, p in zip(hosts, paths)], bool)


def host_of(url: Column) -> Column:
    """A-Z lower-cased text between the first :// and the next /, ?, # or end; empty where there is none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """Text after the host up to ?, # or end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", labelled: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """(id, host, path, rule, verdict) for every row; ``labelled`` is a small table of (host, path, 1 = block) to learn from instead of the built-in one."""
    model = Model(labelled_urls() if labelled is None else labelled)
    url = F.coalesce(F.col(url_col), F.lit(""))
    slim = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))

    @F.pandas_udf("string")
    def other(host, path):
        import pandas as pd

        # ruled rows come with null hosts and are not judged
        need = host.notna().to_numpy()
        out = np.full(len(host), None, object)
        out[need] = np.where(model.blocked(host[need].tolist(), path[need].tolist()), "block", "allow")
        return pd.Series(out, dtype=object)

    ruled = slim.select("id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    return ruled.select("id", "host", "path", "rule", F.coalesce("by_rule", other(F.when(F.col("by_rule").isNull(), F.col("host")), F.col("path"))).alias("verdict"))
