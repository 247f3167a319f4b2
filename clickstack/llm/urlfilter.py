"""URL rules through a sorted digest array.

A rule (host, path) is stored under the 64-bit xxhash of its text.  The digests lie sorted
in one file beside the rules' full strings, are sent to the executors by Spark, and each
task maps the file into memory: it is read by page, not loaded.  A url's candidates (its
host and all parent domains, each with the leading parts of the path whose lengths some
rule has) are hashed, probed by a vectorised binary search, and a hit counts only if the
stored strings are equal, so digest collisions cannot judge a url.  The longest fitting
rule wins.

The file holds at most ``max_rules`` rules; beyond that ``judge`` joins the candidates with
the rule table on their text instead.

Defined cases: a null url or one without ``://`` has an empty host and path and no rule;
repeated rules are one (block wins over allow); extra columns are ignored; an empty table
or rule set works."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

_MAGIC = 0x5552_4C31


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path)."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3:]
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:end]


def write_index(path: str, rules: list[tuple[str, str, str]]) -> None:
    """Sorted digests, string offsets, verdicts, path lengths that occur, then the strings."""
    by_text: dict[str, int] = {}
    for verdict, host, prefix in rules:
        text = host + prefix
        by_text[text] = max(by_text.get(text, 0), int(verdict == "block"))
    texts = sorted(by_text, key=lambda t: (xxhash.xxh64_intdigest(t.encode()), t))
    digests = np.array([xxhash.xxh64_intdigest(t.encode()) for t in texts], np.uint64)
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    verdicts = np.array([by_text[t] for t in texts], np.int64)
    lengths = np.array(sorted({len(p) for _, _, p in rules}), np.int64)
    with open(path, "wb") as f:
        f.write(np.array([_MAGIC, len(texts), len(lengths)], np.int64).tobytes())
        for part in (digests, offs, verdicts, lengths):
            f.write(part.tobytes())
        f.write(b"".join(raw))


class DigestArray:
    """A written index, mapped into memory."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        magic, n, k = whole[:24].view(np.int64).tolist()
        if magic != _MAGIC:
            raise ValueError(f"{path} is no rule index")
        at = 24

        def part(count, kind):
            nonlocal at
            at += 8 * count
            return whole[at - 8 * count:at].view(kind)

        self.digests, self.offs = part(n, np.uint64), part(n + 1, np.int64)
        self.verdicts, self.lengths = part(n, np.int64), part(k, np.int64)
        self.strings = whole[at:]

    def probe(self, texts: list[str]) -> np.ndarray:
        """Row of each text, -1 where it is not stored."""
        out = np.full(len(texts), -1)
        if not len(self.digests) or not texts:
            return out
        keys = np.fromiter((xxhash.xxh64_intdigest(t.encode()) for t in texts), np.uint64, len(texts))
        at = np.searchsorted(self.digests, keys)
        hit = np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == keys))
        for i in hit:
            row, want = int(at[i]), texts[i].encode()
            while row < len(self.digests) and self.digests[row] == keys[i]:  # rules that share a digest are neighbours
                if self.strings[self.offs[row]:self.offs[row + 1]].tobytes() == want:
                    out[i] = row
                    break
                row += 1
        return out


def host_suffixes(host: str) -> list[str]:
    out = [host] if host else []
    at = host.find(".")
    while at >= 0:
        out.append(host[at + 1:])
        at = host.find(".", at + 1)
    return out


def longest_rules(index: DigestArray, parts: list[tuple[str, str]]) -> list[tuple[str | None, str | None]]:
    """(rule, verdict) of each (host, path)."""
    lengths = index.lengths.tolist()
    memo: dict[tuple[str, str], list[str]] = {}
    keys = []
    for host, path in parts:
        heads = tuple(path[:n] for n in lengths if n <= len(path))
        keys.append((host, heads))
    texts: dict[str, int] = {}
    for host, heads in set(keys):
        memo[host, heads] = [s + h for s in host_suffixes(host) for h in heads]
        for t in memo[host, heads]:
            texts.setdefault(t, len(texts))
    found = index.probe(list(texts))
    best = {}
    for k, cands in memo.items():
        fits = [t for t in cands if found[texts[t]] >= 0]
        rule = max(fits, key=lambda t: (len(t), t)) if fits else None
        best[k] = (rule, None if rule is None else ("allow", "block")[index.verdicts[found[texts[rule]]]])
    return [best[k] for k in keys]


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", max_rules: int = 5_000_000) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of ``pages`` (page_id, url); ``rules`` has
    verdict, host, path.  A url that no rule fits gets ``otherwise``."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    some = rules.select("verdict", F.lower("host").alias("host"), "path").where("host is not null and path is not null").distinct()
    schema = "page_id long, host string, path string, rule string, verdict string"
    listed = some.limit(max_rules + 1).collect()  # bounded by max_rules
    if len(listed) > max_rules:
        return _joined(rows, some, otherwise)
    name = f"rules-{uuid.uuid4().hex[:12]}.idx"
    path = os.path.join(tempfile.mkdtemp(), name)
    write_index(path, [tuple(r) for r in listed])
    spark.sparkContext.addFile(path)

    def run(batches):
        index = DigestArray(SparkFiles.get(name))
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            got = longest_rules(index, parts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()),
                 pa.array([r for r, _ in got], pa.string()), pa.array([v or otherwise for _, v in got], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])

    return arrow_map(rows, run, schema)


def _joined(rows: DataFrame, rules: DataFrame, otherwise: str) -> DataFrame:
    """The same by a join, for rule sets without a bound on their size."""
    def cut(batches):
        for batch in batches:
            parts = [split_url(u) for u in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()),
                 pa.array([host_suffixes(h) for h, _ in parts], pa.list_(pa.string()))],
                names=["url", "host", "path", "suffixes"])

    urls = arrow_map(rows.select("url").distinct(), cut, "url string, host string, path string, suffixes array<string>")
    grouped = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block > allow
    fits = (urls.select("url", "path", F.explode("suffixes").alias("host"))
            .join(grouped.withColumnRenamed("path", "prefix"), "host").where(F.startswith("path", "prefix"))
            .groupBy("url").agg(F.max(F.struct(F.length(F.concat("host", "prefix")), F.concat("host", "prefix").alias("rule"),
                                               "verdict")).alias("best")))
    known = urls.join(fits, "url", "left").select("url", "host", "path", "best.rule", "best.verdict")
    return (rows.join(known, rows.url.eqNullSafe(known.url), "left")
            .select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
                    "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict")))
