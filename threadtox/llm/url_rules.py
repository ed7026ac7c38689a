"""URL filter over a sorted digest array of allow and block rules.

A rule is (action, host, path): it fits its host and all subdomains, where the URL's path starts with the
rule's. The rules become one file: 64-bit xxhash keys in ascending order, then each rule's string. The file is
written once to the shared folder, given to the executors with ``addFile`` and memory-mapped by their Python
workers. A batch of URLs makes all its keys (host suffixes at label borders x path prefixes of the lengths
that rules have), probes the array with one vectorised binary search, and confirms every hit against the
stored string, so two strings with equal digests are never confused. The longest fitting rule decides; of
rules equally long the one with the longer host. A URL without a fitting rule gets ``default``.

The file is bounded by the rule list, not by the data (about 40 bytes a rule); ``max_rules`` guards it.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and gets
``default``. Rows with a null ``page_id`` and repeated rows are judged like others. An empty table gives an
empty result; other columns are ignored. Of repeated rules the last one counts; without rules all is default.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from threadtox.llm.rows import arrow_map, typed
from threadtox.session import scratch_path

Rule = tuple[str, str, str]

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_HOST = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL; both empty without ``://``."""
    if url is None:
        return "", ""
    at = url.find("://")
    if at < 0:
        return "", ""
    host = _HOST.match(url, at + 3)
    return host[0].translate(_LOWER), _PATH.match(url, host.end())[0]


def _entry(host: str, path: str) -> bytes:
    return f"{host}\0{path}".encode()


def digest_file(rules: Sequence[Rule], digest=xxhash.xxh64_intdigest) -> bytes:
    """The rules as one file: number, sorted keys, string borders, actions, strings."""
    entries = list({_entry(host.translate(_LOWER), path): action for action, host, path in rules}.items())
    entries.sort(key=lambda e: (digest(e[0]), e[0]))
    if any(a not in ("allow", "block") for _, a in entries):
        raise ValueError("a rule's action is allow or block")
    ends = np.cumsum([0, *(len(s) for s, _ in entries)], dtype=np.int64)
    return b"".join([np.array([len(entries)], dtype=np.int64).tobytes(),
                     np.array([digest(s) for s, _ in entries], dtype=np.uint64).tobytes(), ends.tobytes(),
                     np.array([a == "block" for _, a in entries], dtype=np.uint8).tobytes(), *(s for s, _ in entries)])


class DigestArray:
    """A digest file, memory-mapped."""

    def __init__(self, path: str, digest=xxhash.xxh64_intdigest):
        self.digest = digest
        self.n = n = int(np.memmap(path, np.int64, "r", shape=(1,))[0])
        self.keys = np.memmap(path, np.uint64, "r", 8, (n,)) if n else np.zeros(0, np.uint64)
        self.ends = np.memmap(path, np.int64, "r", 8 + 8 * n, (n + 1,))
        size = int(self.ends[n])
        self.block = np.memmap(path, np.uint8, "r", 16 + 16 * n, (n,)) if n else np.zeros(0, np.uint8)
        self.text = np.memmap(path, np.uint8, "r", 16 + 17 * n, (size,)) if size else np.zeros(0, np.uint8)
        self.lengths = sorted({len(self.string(i).split(b"\0", 1)[1].decode()) for i in range(n)})

    def string(self, i: int) -> bytes:
        return self.text[self.ends[i]:self.ends[i + 1]].tobytes()

    def find(self, probes: list[bytes]) -> list[int]:
        """Where each string is stored, -1 if nowhere."""
        keys = np.fromiter((self.digest(p) for p in probes), dtype=np.uint64, count=len(probes))
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        out = [-1] * len(probes)
        for k in np.flatnonzero(lo < hi):
            out[k] = next((i for i in range(lo[k], hi[k]) if self.string(i) == probes[k]), -1)
        return out

    def judge(self, parts: list[tuple[str, str]]) -> list[tuple[str | None, str | None]]:
        """(rule, action) for each (host, path); None, None where no rule fits."""
        probes: dict[bytes, int] = {}
        tries = []
        for host, path in parts:
            labels = host.split(".")
            tries.append([probes.setdefault(_entry(".".join(labels[i:]), path[:n]), len(probes))
                          for i in range(len(labels)) for n in self.lengths if n <= len(path)] if host else [])
        found = self.find(list(probes))
        out = []
        for own in tries:
            fits = [found[k] for k in own if found[k] >= 0]
            if not fits:
                out.append((None, None))
                continue
            named = [(*self.string(i).decode().split("\0", 1), i) for i in fits]
            host, path, i = max(named, key=lambda x: (len(x[0]) + len(x[1]), len(x[0])))
            out.append((host + path, "block" if self.block[i] else "allow"))
        return out


@lru_cache(maxsize=4)
def _opened(path: str) -> DigestArray:
    return DigestArray(path)


def publish(spark: SparkSession, content: bytes) -> str:
    """Write a small file to the shared folder and have Spark give it to every executor; its name there."""
    name = f"url-rules-{xxhash.xxh64_hexdigest(content)}-{uuid.uuid4().hex[:8]}.bin"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_path(spark, 'rules')}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", max_rules: int = 1_000_000) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages`` (page_id, url)."""
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; the digest file is meant for at most {max_rules}")
    name = publish(pages.sparkSession, digest_file(rules))

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        array = _opened(SparkFiles.get(name))
        parts = [split_url(u) for u in batch.column(1).to_pylist()]
        judged = array.judge(parts)
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.string()),
            pa.array([r for r, _ in judged], pa.string()), pa.array([a or default for _, a in judged], pa.string()),
        ], names=["page_id", "host", "path", "rule", "verdict"])

    return arrow_map(typed(pages, page_id="long", url="string"), of,
                     "page_id long, host string, path string, rule string, verdict string")
