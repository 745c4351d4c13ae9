"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

A rule is `host` + `path`, like `example.com/en/`. It fits its host and all subdomains, if the url's path starts with the
rule's; the longest fitting rule decides (then the longer host; block before allow). Where none fits, a logistic
regression trained from a small labelled URL table decides. Rules are looked up by the suffixes of the host, so their
number costs memory only; the table of rules and the weights (2 ** BITS) are sent to the executors once and the rows
are never shuffled.

Defined cases: a null url, or one without `://`, has an empty host and path, and one like `file:///x` an empty host; no rule
fits these, and the method judges the n-grams there are. Urls of any length are judged whole. Ties are decided as above;
repeated rows are judged one by one; an empty table gives an empty result; clashing input columns are replaced by the
result's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.llm import common

BITS = 14
SIZES = (3, 4, 5)
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: The labelled URL table: host and path, 1 to block.
LABELLED = (
    ("en.wikipedia.org/wiki/Logistic_regression", 0),
    ("www.gutenberg.org/ebooks/1342", 0),
    ("arxiv.org/abs/1706.03762", 0),
    ("news.example.org/2021/05/budget-debate.html", 0),
    ("www.library.example.org/en/catalogue/412", 0),
    ("docs.python.org/3/library/re.html", 0),
    ("blog.gardening.example.net/de/rosen-schneiden", 0),
    ("www.university.example.org/fr/cours/17", 0),
    ("museum.example.org/es/coleccion/88.html", 0),
    ("recipes.example.net/en/302/", 0),
    ("m.weather.example.org/en/today", 0),
    ("www.history.example.net/fr/651", 0),
    ("forum.woodwork.example.org/topic/5521", 0),
    ("science.example.org/de/artikel/90.html", 0),
    ("www.townhall.example.net/en/minutes/2020", 0),
    ("poems.example.org/en/77", 0),
    ("travel.example.net/es/guia/lisboa", 0),
    ("www.hospital.example.org/en/contact", 0),
    ("code.example.org/projects/parser/readme", 0),
    ("music.example.net/de/noten/14", 0),
    ("school.example.org/en/lessons/3.html", 0),
    ("www.theatre.example.net/fr/programme", 0),
    ("m.henderson.example.net/en/41", 0),
    ("blog.anderson.example.com/fr/905.html", 0),
    ("m.thornton.example.com/de/77/", 0),
    ("m.therapy.example.org/en/6", 0),
    ("blog.motion.example.net/es/230", 0),
    ("stanton.example.net/en/518.html", 0),
    ("thompson.example.net/fr/36", 0),
    ("nation.example.com/en/91/", 0),
    ("m.ashton.example.net/de/204", 0),
    ("blog.weather.example.com/en/3", 0),
    ("m.theatre.example.org/fr/88/", 0),
    ("northwind.example.net/en/16", 0),
    ("panther.example.net/es/741.html", 0),
    ("m.authentic.example.net/en/520", 0),
    ("handbook.example.com/de/59", 0),
    ("blog.together.example.org/en/8", 0),
    ("southland.example.net/en/660/", 0),
    ("m.station.example.com/fr/12", 0),
    ("tradition.example.org/es/4", 0),
    ("www.therin.example.net/en/33", 0),
    ("lighthouse.example.net/de/902", 0),
    ("m.edition.example.com/en/71.html", 0),
    ("casino-royal.example.org/en/12", 1),
    ("www.online-casino.example.net/play/slots", 1),
    ("win-big.example.org/jackpot", 1),
    ("free-bets.example.net/bonus/77", 1),
    ("sports-bets.example.org/odds/today", 1),
    ("ads-server.example.net/banner/300x250", 1),
    ("track.ads-click.example.org/pixel/1", 1),
    ("spam-link.example.net/farm/9", 1),
    ("www.spam-mail.example.org/fr/5", 1),
    ("adult-dating.example.com/en/31", 1),
    ("link-farm.example.org/en/seo/backlinks", 1),
    ("cheap-pills.example.net/viagra/order", 1),
    ("pharma-discount.example.org/pills", 1),
    ("payday-loans.example.net/apply-now", 1),
    ("quick-loans.example.org/cash/fast", 1),
    ("xxx-videos.example.net/hot/44", 1),
    ("adult-cams.example.org/live/xxx", 1),
    ("poker-win.example.net/free-chips", 1),
    ("replica-watches.example.org/sale", 1),
    ("warez-crack.example.net/keygen/download", 1),
    ("free-download-crack.example.org/serial", 1),
    ("click-tracker.example.net/redirect/ads", 1),
    ("earn-money-fast.example.org/join", 1),
    ("lottery-win.example.net/claim-prize", 1),
)


def host(url: Column) -> Column:
    """After the first :// up to / ? # or end, A-Z lower-cased; empty without ://."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ? # or end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _grams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every n-gram of `^host$` and of the path, all rows at once."""
    rows, slots = [], []
    for salt, parts in ((1, [f"^{h}$" for h in hosts]), (2, paths)):
        data = [p.lower().encode("utf-8", "replace") for p in parts]
        size = np.fromiter(map(len, data), np.int64, len(data))
        flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
        row = np.repeat(np.arange(len(data)), size)
        for n in SIZES:
            if len(flat) < n:
                continue
            h = np.full(len(flat) - n + 1, salt * 16 + n, np.uint64)
            for i in range(n):
                h = (h * np.uint64(0x100000001B3)) ^ flat[i : len(flat) - n + 1 + i]
            h *= np.uint64(0x9E3779B97F4A7C15)
            inside = row[: len(h)] == row[n - 1 :]
            rows.append(row[: len(h)][inside])
            slots.append((h >> np.uint64(64 - BITS)).astype(np.int64)[inside])
    return np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*slots, np.zeros(0, np.int64)])


@dataclass
class Filter:
    rules: dict[str, list[tuple[str, str, str]]]  # host: (path, rule, verdict), the longest first
    weights: np.ndarray
    bias: float

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[int, int, str, str] | None = None
        suffix = host
        while suffix:
            for p, rule, verdict in self.rules.get(suffix, ()):
                if path.startswith(p):
                    if best is None or (len(rule), len(suffix)) > best[:2]:
                        best = (len(rule), len(suffix), rule, verdict)
                    break
            suffix = suffix.partition(".")[2]
        return best[2:] if best else (None, None)

    def blocked(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Probability to block, from the mean weight of the n-grams."""
        row, slot = _grams(hosts, paths)
        n = np.bincount(row, minlength=len(hosts))
        z = np.bincount(row, self.weights[slot], minlength=len(hosts)) / np.sqrt(np.maximum(n, 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(labelled=LABELLED, rules=RULES, steps: int = 400, rate: float = 2.0, decay: float = 1e-3) -> Filter:
    """Full-batch gradient descent on the labelled table; the same table gives the same weights."""
    parts = [u.partition("/") for u, _ in labelled]
    row, slot = _grams([p[0] for p in parts], [p[1] + p[2] for p in parts])
    y = np.array([float(label) for _, label in labelled])
    x = np.zeros((len(y), 1 << BITS))
    np.add.at(x, (row, slot), 1)
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    w, b = np.zeros(x.shape[1]), 0.0
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))  # both classes weigh alike
    for _ in range(steps):
        g = share * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w -= rate * (x.T @ g + decay * w)
        b -= rate * g.sum()
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[1] != "block")):
        h, slash, p = rule.partition("/")
        by_host.setdefault(h, []).append((slash + p, rule, verdict))
    return Filter(by_host, w.astype(np.float32), b)


def judge(df: DataFrame, model: Filter | None = None, url: str = "url") -> DataFrame:
    """df with host, path, rule, verdict and p_block, the method's probability to block."""
    sent = df.sparkSession.sparkContext.broadcast(model or train())

    def decide(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        f = sent.value
        for hosts, paths in batches:
            hosts, paths = hosts.tolist(), paths.tolist()
            p = f.blocked(hosts, paths) if hosts else np.zeros(0)
            found = [f.rule(h, q) for h, q in zip(hosts, paths, strict=True)]
            verdicts = [v or ("block" if x >= 0.5 else "allow") for (_, v), x in zip(found, p, strict=True)]
            yield pd.DataFrame({"rule": pd.Series([r for r, _ in found], dtype=object), "verdict": pd.Series(verdicts, dtype=object), "p_block": p})

    out = df.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    out = out.withColumn("__v", F.pandas_udf(decide, "rule string, verdict string, p_block double")("host", "path"))
    return out.withColumns({c: F.col(f"__v.{c}") for c in ("rule", "verdict", "p_block")}).drop("__v")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "p_block")
