"""Operator 3, URL filter: rules, and logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMS, MIN_N, MAX_N = 1 << 14, 3, 5
#: At most so many labelled URLs are used, those with the smallest CRC-32; the model is fitted at the driver.
MOST_LABELLED = 5000
STEPS, RATE, L2 = 400, 0.5, 1e-4

# General words of unwanted and of ordinary sites, of which the small labelled table is made. They come from
# no table of documents or pages.
BLOCK_WORDS = ["casino", "poker", "roulette", "slots", "jackpot", "betting", "bets", "gambling", "lottery", "porn", "xxx", "sex", "nude", "escort", "camgirls", "adult", "hentai", "viagra", "cialis", "pills", "steroids", "payday", "loans", "forex", "spam", "phishing", "malware", "keygen", "crack", "warez", "serials", "adserver", "ads", "popunder", "tracker", "clickbait", "replica", "giveaway", "cheats", "hookup"]
ALLOW_WORDS = ["library", "news", "university", "weather", "recipes", "gardening", "theatre", "history", "travel", "museum", "football", "physics", "translation", "school", "nation", "station", "thinking", "therapy", "north", "brother", "action", "anthem", "earth", "health", "rhythm", "theory", "thread", "throne", "method", "clinic", "times", "country", "energy", "shop", "windows", "learning", "freedom", "parcel", "alphabet", "farmers", "jardin", "ciudad", "garten", "verein", "bibliothek", "zeitung", "journal", "musique", "escuela", "biblioteca", "noticias", "salud", "kirche", "rathaus", "mairie", "sante", "cuisine", "deportes", "wetter", "reisen", "society", "council", "institute", "research", "archive", "software", "engineering", "medicine", "law", "bakery"]
BLOCK_FRAMES = ["{}.com", "www.{}-online.net", "free-{}.org", "best{}.biz", "{}24.info"]
ALLOW_FRAMES = ["{}.com", "www.{}-online.net", "the-{}.org", "city{}.edu", "{}24.info"]
PATHS = ["/", "/index.html", "/a/b/3", "/view"]


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rules(lines: list[str]) -> list[Rule]:
    """Rules from lines such as `block example.net/de/8`: the host up to the first slash, the path from there."""
    out = []
    for line in lines:
        verdict, _, place = line.partition(" ")
        host, slash, path = place.partition("/")
        out.append(Rule(verdict, host.lower(), slash + path))
    return out


_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty for null or without `://`."""
    m = _PARTS.search(url) if url else None
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


class Rules:
    """The longest rule that fits a host or a parent of it and starts the path. Ties: the first rule given."""

    def __init__(self, rules: list[Rule]):
        self.by_host: dict[str, list[Rule]] = {}
        for r in rules:
            self.by_host.setdefault(r.host, []).append(r)
        for own in self.by_host.values():
            own.sort(key=lambda r: -len(r.path))

    def fit(self, host: str, path: str) -> Rule | None:
        best, at = None, 0
        while True:
            for r in self.by_host.get(host[at:], ()):
                if path.startswith(r.path):
                    if best is None or len(r.name) > len(best.name):
                        best = r
                    break
            at = host.find(".", at) + 1
            if not at:
                return best


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: (url, 1 to block, 0 to allow)."""
    kinds = ((1, BLOCK_WORDS, BLOCK_FRAMES), (0, ALLOW_WORDS, ALLOW_FRAMES))
    return [(f"https://{f.format(word)}{p}", label) for label, words, frames in kinds for word in words for f in frames for p in PATHS]


def features(host: str, path: str) -> list[int]:
    """Cells of the distinct n-grams of host and path; the two are told apart, and their ends are marked."""
    out = set()
    for kind, s in (("h", f"^{host}$"), ("p", f"^{path}$")):
        data = s.encode("utf-8", "surrogatepass")
        seed = zlib.crc32(kind.encode())
        for n in range(MIN_N, MAX_N + 1):
            out.update(zlib.crc32(data[i : i + n], seed) % DIMS for i in range(len(data) - n + 1))
    return sorted(out)


def fit_weights(rows: list[tuple[str, int]]) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression by full gradient descent with momentum, classes balanced."""
    rows = sorted(rows, key=lambda r: (zlib.crc32(r[0].encode("utf-8", "surrogatepass")), r))[:MOST_LABELLED]
    w = np.zeros(DIMS + 1)
    y = np.array([label for _, label in rows], float)
    if not len(rows) or y.min() == y.max():
        w[-1] = -10.0 if not len(rows) or y.max() == 0 else 10.0
        return w
    cells = [features(*split_url(u)) for u, _ in rows]
    row = np.repeat(np.arange(len(rows)), [len(c) for c in cells])
    cell = np.concatenate([np.array(c, int) for c in cells])
    value = np.repeat([1 / np.sqrt(len(c)) for c in cells], [len(c) for c in cells])
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    speed = np.zeros_like(w)
    for _ in range(STEPS):
        z = np.bincount(row, w[cell] * value, len(rows)) + w[-1]
        error = weight * (1 / (1 + np.exp(-z)) - y)
        slope = np.append(np.bincount(cell, error[row] * value, DIMS), error.sum())
        slope[:-1] += L2 * w[:-1]
        speed = 0.9 * speed - RATE * 4 * slope
        w = w + speed
    return w


def block_chance(host: str, path: str, w: np.ndarray) -> float:
    cells = features(host, path)
    z = w[cells].sum() / np.sqrt(max(1, len(cells))) + w[-1]
    return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def judge_urls(pages: DataFrame, rules: list[str], labelled: list[tuple[str, int]] | None = None, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule, verdict and score of every row, in one pass without a shuffle.

    The longest rule that fits decides; else the model's chance of `block` does, which is the score of every row. Null
    urls and urls without `://` have empty host and path; these get `allow` if no rule fits. Ids may be null or repeated;
    an empty table gives no rows; other columns are ignored. Of the pages, only the url is read.
    """
    weights = fit_weights(labelled_urls() if labelled is None else labelled)
    shared = pages.sparkSession.sparkContext.broadcast((weights, parse_rules(rules)))

    def run(batches):
        w, given = shared.value
        known = Rules(given)
        for batch in batches:
            out, scores = [], {}
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                if (host, path) not in scores:
                    scores[host, path] = block_chance(host, path, w) if host or path else 0.0
                score = scores[host, path]
                rule = known.fit(host, path)
                verdict = rule.verdict if rule else "block" if score >= threshold else "allow"
                out.append((host, path, rule.name if rule else None, verdict, score))
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.string()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [id_col, "host", "path", "rule", "verdict", "score"])

    source = pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col))
    return source.mapInArrow(run, f"`{id_col}` long, host string, path string, rule string, verdict string, score double")
