"""Secret scans with a token-efficiency test (operator 7)."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from partgraph.llm.common import documents, text_blocks, with_text

#: A tiktoken vocabulary: one "base64 rank" a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The kinds and patterns of the contract, in its order.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Strings that the token-efficiency test looks at, and what it makes of them.
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
LEAST_RUN = 16
#: A shorter run must hold a digit and a letter: rare words of 16 to 19 letters can have 2 characters a token.
LEAST_PLAIN = 20
#: Fewer characters a token than this is random; prose has about 4, names 3.
MOST_CHARS_A_TOKEN = 2.2
#: Known digests and identifiers, which the test leaves alone: a named digest, no
#: longer than it can be, a UUID, a hex digest of a usual length, a date or number.
DIGEST_BEFORE = re.compile(r"(sha-?(?:1|224|256|384|512)|md5|blake2b?|crc32|commit|digest|etag|integrity)[\"']?[\x20:=-]*$", re.I)
#: Bytes of the digest that a name stands for; other names stand for up to MOST_BYTES. Commits are never in base64.
DIGEST_BYTES = {"md5": 16, "sha1": 20, "sha224": 28, "sha256": 32, "sha384": 48, "sha512": 64, "crc32": 4, "commit": 32}
MOST_BYTES = 64
IDENTIFIER = re.compile(
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64}|[-0-9_=+/]+"
)

_CLASS = np.zeros(256, bool)
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_=-"]] = True
_KEYWORD = re.compile(rb"(?i:password|passwd|secret|token|api_?key)")

#: How the public vocabulary splits text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokens:
    """Counts the tokens of short strings under a vocabulary given as the bytes of its file."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        pairs = (line.split() for line in vocabulary.splitlines() if line)
        ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self._encoding = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.count = lru_cache(maxsize=65536)(lambda text: len(self._encoding.encode_ordinary(text)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return sorted(out)


def named_digest(text: str, a: int, run: str) -> bool:
    """Whether a digest's name stands before ``a`` and ``run``, which begins there, can be such a digest, whole or cut short, in hex or base64."""
    name = DIGEST_BEFORE.search(text, max(0, a - 24), a)
    if not name:
        return False
    kind = name[1].lower().replace("-", "")
    size = DIGEST_BYTES.get(kind, MOST_BYTES)
    if re.fullmatch(r"[0-9A-Fa-f]+", run):
        return len(run) <= 2 * size
    return kind != "commit" and "=" not in run.rstrip("=") and len(run) <= -(-size // 3) * 4


def random_spans(text: str, taken: list[tuple[int, int, int]], tokens: Tokens) -> list[tuple[int, int, int]]:
    """Runs with few characters a token that no base span touches and that are no known digest or identifier."""
    out, k = [], 0
    for m in RUN.finditer(text):
        a, b = m.span()
        if b - a < LEAST_RUN:
            continue
        while k < len(taken) and taken[k][2] <= a and taken[k][0] <= a:
            k += 1
        if any(s < b and e > a for s, _, e in taken[max(0, k - 3) : k + 3]):
            continue
        run = m[0]
        if len(run) < LEAST_PLAIN and not (re.search(r"\d", run) and re.search(r"[A-Za-z]", run)):
            continue
        if IDENTIFIER.fullmatch(run) or named_digest(text, a, run):
            continue
        if len(run) < MOST_CHARS_A_TOKEN * tokens.count(run):
            out.append((a, 3, b))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that can hold any span: a keyword, or a run of LEAST_RUN bytes of the run's class."""
    flag = np.concatenate([[False], _CLASS[data], [False]])
    edges = np.flatnonzero(flag[1:] != flag[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= LEAST_RUN
    rows = [np.searchsorted(offsets, starts[long], "right") - 1, np.searchsorted(offsets, ends[long] - 1, "right") - 1]
    places = np.array([m.start() for m in _KEYWORD.finditer(data.tobytes())], np.int64)
    rows.append(np.searchsorted(offsets, places, "right") - 1)
    # A run may span several short texts: all of them are looked at.
    wide = [np.arange(a, b + 1) for a, b in zip(rows[0], rows[1], strict=True) if b > a + 1]
    return np.unique(np.concatenate(rows + wide))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Secrets of each text: the base patterns', and random strings by token efficiency.

    A run of at least LEAST_RUN characters of ``[A-Za-z0-9+/_=-]``, or under
    LEAST_PLAIN characters one with letters and digits, is reported as
    kind token where it has fewer than MOST_CHARS_A_TOKEN characters a token, is no
    known digest or identifier and touches no base span.
    Only texts with a keyword or such a run are decoded. The vocabulary file (about
    1 MB, fixed; ``vocabulary`` is a path that the driver can open, else this raises
    FileNotFoundError before any job) is read on the driver and sent to the tasks. Null and empty texts:
    no spans, base_sha256 of the empty string. Repeated rows give repeated results;
    other columns are left out; no rows give no rows.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    nothing = hashlib.sha256(b"").hexdigest()

    def work(batches):
        tokens = Tokens(shared.value)
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(1)):
                n = b - a
                counts, sums, spans = np.zeros((3, n), np.int64), [nothing] * n, [""] * n
                for row in _suspects(data, offsets):
                    text = data[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8", "replace")
                    base = base_spans(text)
                    for _, kind, _ in base:
                        counts[kind, row] += 1
                    sums[row] = hashlib.sha256(joined(base).encode()).hexdigest()
                    spans[row] = joined(base + random_spans(text, base, tokens))
                arrays = [batch.column(0).slice(a, n).cast(pa.int64()), *(pa.array(c) for c in counts)]
                arrays += [pa.array(sums, pa.string()), pa.array(spans, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in SCHEMA.split(", ")])

    return with_text(docs, "doc_id").mapInArrow(work, SCHEMA)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 7 over all documents."""
    return scan_secrets(documents(spark, sf_dir))
