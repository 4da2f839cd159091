"""Secret scan by token efficiency.

Words of a language take few tokens of a byte-level BPE vocabulary for their length; random strings take many. Candidate
strings with a low number of characters per token are reported, after known digests and identifiers are excluded.

Candidates are found by array operations over the bytes of a slice, and only they are tokenised, through tiktoken with a
vocabulary file whose path is a parameter. The plan is one scan without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from . import kernels as K
from .bpe import VOCABULARY, read_ranks
from .common import column, through_arrow

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MIN_CHARS = 16
#: Characters per token below which a candidate is a random string.
MAX_RATIO = 2.2
#: The same for candidates of letters only: long words of some languages come near 2.
MAX_LETTERS_RATIO = 1.8
#: Bytes of digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512): twice as many hexadecimal, 4/3 as many base-64 characters.
DIGEST_BYTES = (16, 20, 28, 32, 48, 64)
DIGESTS = frozenset(2 * n for n in DIGEST_BYTES)
BASE64_DIGESTS = frozenset(-(-4 * n // 3) for n in DIGEST_BYTES)

_BYTE = np.zeros(256, bool)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-+/=":
    _BYTE[_c] = True
_LETTER = np.zeros(256, np.int8)
_LETTER[65:91] = _LETTER[97:123] = 1
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)
_HEX = re.compile(r"(?:0x)?([0-9a-f]+)", re.I)
_NUMBERS = re.compile(r"[0-9\-+/=_]+")
_BASE64 = re.compile(r"(?:sha-?\d{1,3}-)?([0-9a-z+/_-]+)", re.I)
_NAMED = re.compile(r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer)\w*[\"']?\s*(?:[:=]|=>)?\s*[\"']?$", re.I)
_DIGEST_NAMED = re.compile(r"(?:md5|sha-?\d{0,3}|digest|checksum|integrity|commit|etag|hash|revision|blob)\w*[\"']?\s*[:=\-(]*\s*[\"']?$", re.I)
#: What of the text in front a name can reach into, read backwards.
_NAME = re.compile(r"[\"']?\s*[>:=\-(]*\s*[\"']?[\w-]*")
_WINDOW = 64


def tokenizer(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


def kind_of(word: str, before: str) -> str | None:
    """'digest' or 'identifier' for a known string that is no secret, None for any other.

    before: the text in front. What is assigned to a name for secrets is neither. Hexadecimal strings of a digest's
    length are digests, and under a digest's name base-64 strings of a digest's length too.
    """
    if _NAMED.search(before):
        return None
    if _UUID.fullmatch(word) or _NUMBERS.fullmatch(word):
        return "identifier"
    m = _HEX.fullmatch(word)
    if m and len(m.group(1)) in DIGESTS:
        return "digest"
    m = _BASE64.fullmatch(word)
    if m and len(m.group(1)) in BASE64_DIGESTS and (_DIGEST_NAMED.search(before) or m.start(1)):
        return "digest"
    return None


def name_before(body: np.ndarray, low: int, at: int) -> str:
    """What stands in body[low:at] right before at and can be a name with its sign of assignment, of any length."""
    width = _WINDOW
    while True:
        front = body[max(low, at - width) : at].tobytes().decode("utf-8", "ignore")
        size = _NAME.match(front[::-1]).end()
        if size < len(front) or at - width <= low:
            return front[len(front) - size :]
        width *= 2


def candidates(body: np.ndarray, at: np.ndarray, min_chars: int = MIN_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of runs of base-64 characters with a letter, at least min_chars long."""
    n = len(body)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _BYTE[body]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    before, here = inside[:-1], inside[1:]
    start, end = np.flatnonzero(here & (~before | cut)), np.flatnonzero(before & (~here | cut))
    long = end - start >= min_chars
    start, end = start[long], end[long]
    count = np.concatenate(([0], np.cumsum(_LETTER[body], dtype=np.int64)))
    some = count[end] > count[start]
    start, end = start[some], end[some]
    return start, end, np.searchsorted(at, start, "right") - 1


_OUT = pa.schema([("start", pa.int64()), ("secret", pa.string()), ("n_tokens", pa.int32()), ("ratio", pa.float64())])


def _scan(shared, min_chars: int, max_ratio: float, max_letters_ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        for batch in batches:
            body, at = K.texts(batch.column(0), lower=False)
            for i, j in K.slices(at):
                own, edge = body[at[i] : at[j]], at[i : j + 1] - at[i]
                rows, out = [], []
                for a, b, r in zip(*(x.tolist() for x in candidates(own, edge, min_chars))):
                    a += own[a:b].tobytes().rstrip(b"=").rfind(b"=") + 1  # of name=value, the value
                    word = own[a:b].tobytes().decode().strip("=-/+_")
                    if len(word) < min_chars:
                        continue
                    tokens = len(enc.encode_ordinary(word))
                    most = max_ratio if any(c.isdigit() for c in word) else min(max_ratio, max_letters_ratio)
                    if len(word) / tokens < most and any(c.isalpha() for c in word) and not kind_of(word, name_before(own, edge[r], a)):
                        head = own[edge[r] : a]
                        offset = int(((head & 0xC0) != 0x80).sum()) + own[a:b].tobytes().decode().index(word)
                        rows.append(i + r)
                        out.append((offset, word, tokens, round(len(word) / tokens, 6)))
                if rows:
                    yield pa.RecordBatch.from_arrays([*batch.select(range(1, batch.num_columns)).take(pa.array(rows)).columns, *(pa.array(c, f.type) for c, f in zip(zip(*out), _OUT))], names=[*batch.schema.names[1:], *_OUT.names])

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, max_ratio: float = MAX_RATIO, max_letters_ratio: float = MAX_LETTERS_RATIO, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, start, secret, n_tokens, ratio): every random string of the texts, with its offset in characters.

    A candidate is a run of letters, digits and ``_-+/=`` (the last five stripped from its ends, and what stands before
    an inner equals sign) of at least ``min_chars`` characters, with a letter. It is a random string with fewer than
    ``max_ratio`` characters per token, ``max_letters_ratio`` if it has no digit. UUIDs, numbers, hexadecimal strings of a
    digest's length and, under a digest's name, base-64 ones are excluded, unless they are assigned to a name such as
    token or password.

    Null and empty texts have none. Texts of any length are read whole. Rows with a null id are reported with it;
    repeated rows each report theirs. Other columns of docs are not read. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    src = docs.select(column(docs, text_col).alias("t"), column(docs, id_col).alias("doc_id"))
    return through_arrow(src, "t", ["doc_id"], _scan(shared, min_chars, max_ratio, max_letters_ratio), "start bigint, secret string, n_tokens int, ratio double")
