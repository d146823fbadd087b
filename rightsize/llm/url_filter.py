"""URL filter: rules first, then logistic regression on hashed n-grams.

1. Host (between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in
   lower case) and path (on to ``?``, ``#`` or the end) are cut in the JVM.
2. A rule (verdict, host, path) fits its host and all subdomains where the path
   starts with its path; of fitting rules the longest (host and path) wins. A
   url looks up its host and the hosts above it, label by label.
3. Every other url is judged by a logistic regression. Its features are the
   counts of the character n-grams (``SIZES``) of host and path, each between
   marks, hashed into ``BUCKETS`` and scaled to length 1. It is trained on
   a small table of labelled urls (``most`` rows at most, else an error; both
   verdicts, or everything gets the one there is) by gradient descent
   over all its rows with an L2 penalty, without randomness. ``block`` at a probability of
   ``threshold`` or more.

Defined results: a null url or one without ``://`` has an empty host and path,
which no rule fits, and is judged by the model on its bias alone; repeated rows
and null ids stay; equal rules are one, and of rules that differ in the verdict
alone ``block`` wins; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rightsize.llm.common import mix, raw_bytes, slices

BUCKETS, SIZES = 1 << 18, (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A small labelled URL table (verdict, url).
LABELLED = [
    ("block", "http://www.cheap-pills.example.com/en/1201"), ("block", "https://cheap-pills.example.org/de/88?page=2"),
    ("block", "https://spam-farm.example.org/en/311.html"), ("block", "http://m.spam-farm.example.net/fr/9/"),
    ("block", "http://m.adult-x.example.net/en/77"), ("block", "https://blog.adult-x.example.com/es/5004?utm_source=feed"),
    ("block", "https://ads-track.example.org/en/640"), ("block", "http://www.ads-track.example.net/de/13#top"),
    ("block", "http://casino-win.example.com/en/204"), ("block", "https://m.casino-win.example.org/es/71.html"),
    ("block", "http://free-bets.example.net/en/9/"), ("block", "https://www.free-bets.example.com/fr/450?page=2&ref=x"),
    ("block", "http://best-casino-bonus.test/win/now"), ("block", "http://pills-online.test/buy/cheap"),
    ("block", "https://adult-video.test/free"), ("block", "http://click.ads-server.test/track?id=1"),
    ("block", "http://bets-today.test/free-bets/odds"), ("block", "http://link-farm-spam.test/page/1"),
    ("allow", "https://www.library.test/catalogue/12"), ("allow", "http://news.harbour.test/2024/05/weather.html"),
    ("allow", "https://docs.handbook.test/en/guide/"), ("allow", "https://blog.garden.test/posts/roses"),
    ("allow", "http://www.university.test/physics/lecture-3"), ("allow", "https://m.cookery.test/fr/soupe"),
    ("allow", "http://thorin.example.org/en/120"), ("allow", "https://blog.theresa.example.org/de/36.html"),
    ("allow", "http://www.tionandth.example.net/en/901"), ("allow", "https://m.shanering.example.org/fr/44/"),
    ("allow", "https://theronand.example.org/es/7?page=2&ref=x"), ("allow", "http://blog.inghat.example.net/de/15#top"),
    ("allow", "https://www.blewhis.example.org/en/310?utm_source=feed"), ("allow", "http://m.houthis.example.net/en/55"),
    ("allow", "http://www.thinthed.example.com/en/402"), ("allow", "https://thatinon.example.com/es/68"),
    ("allow", "https://blog.hereally.example.com/de/1300.html"), ("allow", "http://onlythe.example.org/fr/2/"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """See the module; both empty for a null url or one without ``://``."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def fitting_rule(host: str, path: str, rules: dict) -> tuple[str, str] | None:
    """(rule, verdict) of the longest of ``rules`` (host -> [(path, verdict)]) that fits."""
    best = None
    while host:
        for start, verdict in rules.get(host, ()):
            if path.startswith(start):
                rank = (len(host) + len(start), verdict == "block")
                if best is None or rank > best[0]:
                    best = rank, host + start, verdict
        _, dot, host = host.partition(".")
    return best and best[1:]


def grams(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(url, bucket, value) of the hashed n-grams of all urls."""
    joined = pc.binary_join_element_wise(pa.scalar("\x01"), hosts, pa.scalar("\x02"), paths, pa.scalar("\x03"), pa.scalar(""), "")
    data, ends = raw_bytes(joined)
    owner = np.repeat(np.arange(len(joined)), np.diff(ends))
    codes = mix(np.arange(256, dtype=np.uint64))[data]
    empty = np.asarray(pc.equal(pc.add(pc.binary_length(hosts), pc.binary_length(paths)), 0))
    urls, buckets = [], []
    for size in SIZES:
        if len(data) < size:
            continue
        h = np.zeros(len(data) - size + 1, np.uint64)
        for k in range(size):
            h = h * np.uint64(0x100000001B3) + codes[k : len(data) - size + 1 + k]
        inside = (owner[: len(h)] == owner[size - 1 :]) & ~empty[owner[: len(h)]]
        urls.append(owner[: len(h)][inside])
        buckets.append((mix(h[inside], size) & np.uint64(BUCKETS - 1)).astype(np.int64))
    url, bucket = (np.concatenate(urls), np.concatenate(buckets)) if urls else (np.empty(0, np.int64),) * 2
    pair, n = np.unique(url * BUCKETS + bucket, return_counts=True)
    url, bucket, n = pair // BUCKETS, pair % BUCKETS, n.astype(float)
    length = np.sqrt(np.bincount(url, weights=n * n, minlength=len(joined)))
    return url, bucket, n / length[url]


def train(urls: list[tuple[str, str, str]], penalty: float = 1e-3, rounds: int = 400, rate: float = 4.0) -> tuple[np.ndarray, float]:
    """Weights and bias from (verdict, host, path), by full-batch gradient descent."""
    y = np.array([v == "block" for v, _, _ in urls], float)
    url, bucket, value = grams(pa.array([h for _, h, _ in urls], pa.string()), pa.array([p for _, _, p in urls], pa.string()))
    weights, bias = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(url, weights=weights[bucket] * value, minlength=len(y)) + bias, -30, 30)))
        off = (p - y) / len(y)
        weights = weights * (1 - rate * penalty) - rate * np.bincount(bucket, weights=off[url] * value, minlength=BUCKETS)
        bias -= rate * off.sum()
    return weights.astype(np.float32), float(bias)


def _judge(model, threshold: float):
    def run(batches):
        rules, weights, bias = model.value
        for whole in batches:
            for batch in slices(whole, "url_path", 1 << 20):
                hosts, paths = batch["host"], batch["path"]
                url, bucket, value = grams(hosts, paths)
                z = np.bincount(url, weights=weights[bucket] * value, minlength=batch.num_rows) + bias
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                fits = [fitting_rule(h, x, rules) for h, x in zip(hosts.to_pylist(), paths.to_pylist())]
                verdict = [f[1] if f else "block" if q >= threshold else "allow" for f, q in zip(fits, p)]
                yield pa.RecordBatch.from_arrays([batch["page_id"], hosts, paths, pa.array([f and f[0] for f in fits], pa.string()), pa.array(verdict, pa.string()), pa.array(p)], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return run


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame | None = None, page_id: str = "page_id", url: str = "url", threshold: float = 0.5, most: int = 20_000) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of ``pages``.
    ``rules`` are (verdict, host, path), 100,000 at most; ``labelled`` has
    columns verdict and url (default: the table above)."""
    spark = pages.sparkSession
    if len(rules) > 100_000:
        raise ValueError("too many rules to send to every task")
    table: dict = {}
    for verdict, host, path in rules:
        table.setdefault(host, []).append((path, verdict))
    if labelled is None:
        labelled = spark.createDataFrame(LABELLED, "verdict string, url string")
    host, path = host_and_path(F.col("url"))
    known = labelled.filter("verdict in ('allow', 'block')").select("verdict", host.alias("host"), path.alias("path")).limit(most + 1).collect()
    if len(known) > most:
        raise ValueError(f"more than {most} labelled urls: draw a sample")
    weights, bias = train(sorted((r["verdict"], r["host"], r["path"]) for r in known)) if known else (np.zeros(BUCKETS, np.float32), -1.0)
    model = spark.sparkContext.broadcast((table, weights, bias))
    host, path = host_and_path(F.col(url))
    read = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("url_path", F.concat("host", "path"))
    kind = dict(read.dtypes)["page_id"]
    return read.mapInArrow(_judge(model, threshold), f"page_id {kind}, host string, path string, rule string, verdict string, score double")
