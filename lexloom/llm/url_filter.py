"""URL filter: logistic regression on hashed character n-grams of host and path, below a table of host/path rules.

Training takes a small labelled table of URLs and runs on the driver over that table alone (its size is the bound). The intercept
is set on hosts held out of the training in turn: of allowed URLs with words that the model has not seen, no more than
``unseen_blocked`` may be blocked. Scoring uses built-in functions only: the code points of a URL are cut out once, each
n-gram is a polynomial hash of n neighbours, and integer weights (micro-units) are added up, so that the sum is exact in any order and
the time is linear in the URL's length.

Defined results: a null URL or one without ``://`` has an empty host and path; it has no n-grams, so the intercept alone
judges it. Of the rules that fit, the longest (host and path together) wins, then the first listed.
Repeated rows each give a row, an empty table gives none, other columns are neither read nor returned.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICRO = 1_000_000


@dataclass(frozen=True)
class UrlFilterConfig:
    sizes: tuple[int, ...] = (3, 4)
    buckets: int = 8192
    steps: int = 150
    rate: float = 0.1
    decay: float = 0.05
    #: parts of the training hosts that are held out in turn to set the intercept, and the part of them that may be blocked wrongly
    folds: int = 5
    unseen_blocked: float = 0.03
    #: multiplier of the polynomial hash of an n-gram's code points
    base: int = 257


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def slots(text: str, config: UrlFilterConfig) -> list[int]:
    out = []
    for n in config.sizes:
        for i in range(len(text) - n + 1):
            h = 0
            for c in text[i:i + n]:
                h = (h * config.base + ord(c)) % config.buckets
            out.append(h)
    return out


def judged(host: str, path: str) -> str:
    """What the n-grams are taken from: both parts with their ends marked."""
    return f"^{host}|{path}$" if host else ""


@dataclass(frozen=True)
class UrlModel:
    """weights: one for each bucket, in millionths; a sum over 0 blocks."""

    weights: tuple[int, ...]
    intercept: int
    config: UrlFilterConfig


def _descend(rows: list[list[int]], labels: np.ndarray, config: UrlFilterConfig) -> tuple[np.ndarray, float]:
    """Weights and intercept: adaptive gradient descent over the whole table, each n-gram weighted by one over the root of their number."""
    sizes = np.array([len(r) for r in rows])
    row, slot = np.repeat(np.arange(len(rows)), sizes), np.concatenate([np.array(r, np.int64) for r in rows])
    x = 1 / np.sqrt(np.maximum(sizes, 1))[row]
    w, b, grown, b_grown = np.zeros(config.buckets), 0.0, np.full(config.buckets, 1e-12), 1e-12
    for _ in range(config.steps):
        z = b + np.bincount(row, w[slot] * x, len(rows))
        slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(rows)
        step, b_step = np.bincount(slot, slope[row] * x, config.buckets) + config.decay * w / len(rows), slope.sum()
        grown, b_grown = grown + step**2, b_grown + b_step**2
        w -= config.rate * step / np.sqrt(grown)
        b -= config.rate * b_step / b_grown**0.5
    return w, b


def _margins(rows: list[list[int]], w: np.ndarray) -> np.ndarray:
    return np.array([w[r].sum() / max(1, len(r)) ** 0.5 for r in rows])


def train(rows: list[tuple[str, int]], config: UrlFilterConfig = UrlFilterConfig(), words: Callable[[str], str] | None = None) -> UrlModel:
    """rows: (url, 1 to block or 0 to allow); deterministic. words(host) names what a host is made of: hosts with the same name are
    held out together (else each host by itself)."""
    hosts = [host_and_path(u)[0] for u, _ in rows]
    data = [slots(judged(*host_and_path(u)), config) for u, _ in rows]
    labels = np.array([y for _, y in rows], float)
    fold = np.array([zlib.crc32((words(h) if words else h).encode()) % config.folds for h in hosts])
    unseen = []
    for k in range(config.folds):
        inside, out = np.flatnonzero(fold != k), np.flatnonzero((fold == k) & (labels == 0))
        if len(inside) and len(out):
            w, _ = _descend([data[i] for i in inside], labels[inside], config)
            unseen += _margins([data[i] for i in out], w).tolist()
    w, b = _descend(data, labels, config)
    if unseen:
        b = min(b, -float(np.quantile(unseen, 1 - config.unseen_blocked)))
    return UrlModel(tuple(round(x * MICRO) for x in w), round(b * MICRO), config)


def host_column(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_column(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Index of the rule that wins, null if none fits."""
    out = F.lit(None).cast("int")
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))
    for i in reversed(order):
        r = rules[i]
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(i)).otherwise(out)
    return out


def score_column(host: Column, path: Column, model: UrlModel) -> Column:
    """The model's log-odds in millionths: n-gram weights over the root of their number, and the intercept."""
    c = model.config
    text = F.when(host != "", F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))).otherwise(F.lit(""))
    table = F.split(F.lit(",".join(map(str, model.weights))), ",").cast("array<bigint>")  # folded to a constant

    def total(codes: Column) -> Column:
        out, count = F.lit(0).cast("bigint"), F.lit(0)
        for n in c.sizes:
            def slot(i: Column, n: int = n) -> Column:
                h = F.lit(0).cast("bigint")
                for j in range(n):
                    h = (h * c.base + F.get(codes, i + j)) % c.buckets
                return h.cast("int")

            many = F.greatest(F.size(codes) - (n - 1), F.lit(0))
            starts = F.when(many > 0, F.sequence(F.lit(0), F.greatest(many - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
            out = out + F.aggregate(starts, F.lit(0).cast("bigint"), lambda acc, i: acc + F.get(table, slot(i)))
            count = count + many
        return out.cast("double") / F.sqrt(F.greatest(count, F.lit(1)).cast("double"))

    codes = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), F.ascii)  # cut once: a substring would scan from the start
    return F.element_at(F.transform(F.array(codes), total), 1) + F.lit(float(model.intercept))


def judge(pages: DataFrame, rules: list[Rule], model: UrlModel, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score; one pass of built-in functions, no shuffle."""
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("u"))
    split = slim.select("page_id", host_column(F.col("u")).alias("host"), path_column(F.col("u")).alias("path"))
    ruled = split.withColumn("r", rule_column(F.col("host"), F.col("path"), rules))
    ruled = ruled.withColumn("score", score_column(F.col("host"), F.col("path"), model))
    pick = lambda of: F.get(F.array(*[F.lit(of(r)) for r in rules]), F.col("r")) if rules else F.lit(None).cast("string")
    by_model = F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return ruled.select("page_id", "host", "path", pick(lambda r: r.name).alias("rule"), F.coalesce(pick(lambda r: r.verdict), by_model).alias("verdict"), "score")


def duckdb_score(model: UrlModel, text: str) -> str:
    """The same log-odds as DuckDB SQL over the SQL expression text."""
    c, total, count = model.config, [], []
    for n in c.sizes:
        h = "0::BIGINT"
        for j in range(n):
            h = f"(({h} * {c.base} + unicode(substr({text}, i + {j}, 1))) % {c.buckets})"
        total.append(f"coalesce(list_sum(list_transform(range(1, greatest(length({text}) - {n - 1}, 0) + 1), lambda i: w[{h} + 1])), 0)")
        count.append(f"greatest(length({text}) - {n - 1}, 0)")
    return f"(({' + '.join(total)})::DOUBLE / sqrt(greatest({' + '.join(count)}, 1)::DOUBLE) + {float(model.intercept)!r}::DOUBLE)"
