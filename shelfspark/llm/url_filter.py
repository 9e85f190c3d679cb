"""URL filters over a memory-mapped sorted digest array.

The rule list becomes an immutable file: the sorted 64-bit xxhash keys of the
rule strings, their offsets, their verdicts and the strings themselves; a long
list is cut into several files by ranges of the keys.  The files reach the
executors through ``SparkContext.addFile`` and are mapped, not loaded, so all Python
workers of a machine share their pages.  A batch of URLs is
probed by one vectorised binary search over every (host suffix, path prefix)
candidate; a hit counts only if the stored string equals the candidate, so
digest collisions cannot change a verdict.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Default rules: (verdict, host and path prefix).
DEFAULT_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

#: Bytes of rule strings in one file; a longer list takes more files.
FILE_BYTES = 1 << 30


def url_host(url: str | Column) -> Column:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; ASCII lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: str | Column) -> Column:
    """Path: what follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def write_digest_array(rules: Iterable[tuple[str, str]], path: str, digest=None, file_bytes: int = FILE_BYTES) -> list[str]:
    """Write the sorted digest array of ``rules`` to ``path`` and, beyond ``file_bytes``, to files beside it; returns their paths.

    Of equal rules the last one counts.
    """
    import numpy as np
    import xxhash

    digest = digest or xxhash.xxh64_intdigest
    table = {}
    for verdict, rule in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r} is neither allow nor block")
        host, slash, rest = rule.partition("/")
        table[(host.translate(str.maketrans(UPPER, LOWER)) + slash + rest).encode()] = verdict == "block"
    keys = sorted(table, key=lambda k: (digest(k), k))
    digests = [digest(k) for k in keys]
    cuts, size = [0], 0
    for k, key in enumerate(keys):
        if size >= file_bytes and digests[k] != digests[k - 1]:  # equal digests stay together
            cuts.append(k)
            size = 0
        size += len(key)
    paths = []
    for n, (begin, end) in enumerate(zip(cuts, [*cuts[1:], len(keys)], strict=True)):
        part = keys[begin:end]
        longest = max((len(k.partition(b"/")[0]) for k in part), default=0)
        lengths = sorted({len(k) - (k.find(b"/") if b"/" in k else len(k)) for k in part})
        paths.append(f"{path}.{n}" if n else path)
        with open(paths[-1], "wb") as out:
            out.write(np.array([len(part), len(lengths), longest], "<u8").tobytes())
            out.write(np.array(lengths, "<u8").tobytes())
            out.write(np.array(digests[begin:end], "<u8").tobytes())
            out.write(np.cumsum([0, *map(len, part)]).astype("<u8").tobytes())
            out.write(np.array([table[k] for k in part], "u1").tobytes())
            out.writelines(part)
    return paths


class _Mapped:
    """One mapped file of :func:`write_digest_array`."""

    def __init__(self, path: str):
        import numpy as np

        raw = np.memmap(path, "u1", "r")
        self.size, n_lengths, self.longest_host = (int(x) for x in raw[:24].view("<u8"))
        at = 24 + 8 * n_lengths
        self.lengths = [int(x) for x in raw[24:at].view("<u8")]
        self.keys, at = raw[at : at + 8 * self.size].view("<u8"), at + 8 * self.size
        self.offsets, at = raw[at : at + 8 * (self.size + 1)].view("<u8"), at + 8 * (self.size + 1)
        self.blocked, self.blob = raw[at : at + self.size], raw[at + self.size :]

    def rule(self, k: int) -> bytes:
        return self.blob[int(self.offsets[k]) : int(self.offsets[k + 1])].tobytes()


class DigestArray:
    """The mapped files of :func:`write_digest_array`, in order."""

    def __init__(self, *paths: str, digest=None):
        import numpy as np
        import xxhash

        self.digest = digest or xxhash.xxh64_intdigest
        self.parts = [_Mapped(p) for p in paths]
        self.lengths = sorted({n for part in self.parts for n in part.lengths})
        self.longest_host = max((part.longest_host for part in self.parts), default=0)
        self.firsts = np.array([part.keys[0] for part in self.parts[1:]], np.uint64)

    def find(self, candidates: list[bytes]) -> list[tuple[int, int] | None]:
        """File and position of each candidate."""
        import numpy as np

        found: list[tuple[int, int] | None] = [None] * len(candidates)
        digests = np.fromiter(map(self.digest, candidates), np.uint64, len(candidates))
        which = np.searchsorted(self.firsts, digests, "right")
        for n, part in enumerate(self.parts):
            own = np.nonzero(which == n)[0]
            if not len(own) or not part.size:
                continue
            left, right = (np.searchsorted(part.keys, digests[own], side) for side in ("left", "right"))
            for i in np.nonzero(right > left)[0]:
                for k in range(int(left[i]), int(right[i])):
                    if part.rule(k) == candidates[own[i]]:
                        found[own[i]] = n, k
        return found

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
        """Longest fitting rule and verdict of each URL; ``allow`` where none fits."""
        candidates, owners = [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            raw_path, suffix = path.encode(), host.encode()
            if len(suffix) > self.longest_host:  # a suffix longer than any rule's host fits none
                suffix = suffix[-self.longest_host - 1 :].partition(b".")[2]
            while suffix:
                for n in self.lengths:
                    if n <= len(raw_path):
                        candidates.append(suffix + raw_path[:n])
                        owners.append(i)
                suffix = suffix.partition(b".")[2]
        rules: list[str | None] = [None] * len(hosts)
        verdicts, best = ["allow"] * len(hosts), [(-1, -1)] * len(hosts)
        for i, key, at in zip(owners, candidates, self.find(candidates), strict=True):
            if at and (rank := (len(key), (key + b"/").index(b"/"))) > best[i]:
                best[i], rules[i] = rank, key.decode()
                verdicts[i] = "block" if self.parts[at[0]].blocked[at[1]] else "allow"
        return rules, verdicts


def filter_urls(df: DataFrame, url_col: str = "url", rules: Iterable[tuple[str, str]] = DEFAULT_RULES) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row.

    A rule fits its host and all subdomains if the URL's path starts with the
    rule's path; the longest rule wins, then the one with the longer host.
    A null URL or one without ``://`` has an empty host and path, no rule and the
    verdict ``allow``.  Repeated rows are judged alike; an empty table stays empty.  URLs of any length are judged whole: of a
    host only the suffixes that are as short as some rule's host are looked up, of a path the prefixes as long as a rule's.
    Added columns replace input columns of their names, others stay.
    """
    names = []
    for path in write_digest_array(rules, os.path.join(tempfile.mkdtemp(prefix="url-rules-"), "rules")):
        with open(path, "rb") as f:
            names.append(f"url-rules-{hashlib.file_digest(f, 'sha256').hexdigest()[:24]}.bin")
        # a file of this content keeps its place, as a name can be sent from one path only
        os.replace(path, os.path.join(tempfile.gettempdir(), names[-1]))
        df.sparkSession.sparkContext.addFile(os.path.join(tempfile.gettempdir(), names[-1]))

    def probe(batches):
        import pyarrow as pa
        from pyspark import SparkFiles

        array = DigestArray(*map(SparkFiles.get, names))
        for batch in batches:
            hosts = batch.column(batch.schema.get_field_index("host")).to_pylist()
            paths = batch.column(batch.schema.get_field_index("path")).to_pylist()
            found, verdicts = array.judge(hosts, paths)
            yield batch, [pa.array(found, pa.string()), pa.array(verdicts, pa.string())]

    parsed = df.withColumns({"host": url_host(df[url_col]), "path": url_path(df[url_col])})
    return map_batches(parsed, probe, [T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType(), False)])
