"""Vectorised word and shingle hashing over a batch of texts.

A word is a run of ASCII letters and digits and of bytes above 0x7F, in lower case; a null text has no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), U(base))
        step[0] = 1
        _powers[name] = have = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Bytes of words that white space parts.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False


def hashed(parts: list[bytes], is_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the parts, and for each part where its words begin (one entry more at the end)."""
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    ends_of_text = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))) if parts else np.zeros(0, np.int64)
    flag = is_word[raw]
    edge = np.flatnonzero(flag[1:] != flag[:-1]) + 1
    if len(flag) and flag[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[::2], edge[1::2]
    at = np.concatenate([[0], np.searchsorted(begin, ends_of_text)]).astype(np.int64)
    sums = np.zeros(len(raw) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum((raw.astype(U) + U(1)) * _power(_BASE, len(raw), "base"), out=sums[1:])
        return mix((sums[end] - sums[begin]) * _power(_INV, len(raw), "inverse")[begin] + (end - begin).astype(U)), at


def words(texts: list[str | None], is_word: np.ndarray = _IS_WORD, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The same of texts, in lower case if asked for."""
    return hashed([((t or "").lower() if lower else t or "").encode("utf-8", "replace") for t in texts], is_word)


def shingles(word: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's n-word shingles and where each text's begin; a text of 1 to n-1 words has one, of all its words."""
    count = np.diff(at)
    rolled = np.zeros(max(0, len(word) - n + 1), U)
    with np.errstate(over="ignore"):
        for k in range(n):
            rolled = rolled * U(0xD6E8FEB86659FD93) + word[k : k + len(rolled)]
        rolled = mix(rolled)
        size = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
        to = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(to[-1], U)
        long = np.flatnonzero(count >= n)
        for i in long:
            out[to[i] : to[i + 1]] = rolled[at[i] : at[i] + size[i]]
        for i in np.flatnonzero((count > 0) & (count < n)):
            h = U(count[i])
            for w in word[at[i] : at[i + 1]]:
                h = h * U(0xD6E8FEB86659FD93) + w
            out[to[i]] = mix(np.array([h], U))[0]
    return out, to


def minhash(sh: np.ndarray, to: np.ndarray, n_hashes: int) -> np.ndarray:
    """(texts, n_hashes) 16-bit MinHash values; texts without shingles have zeros."""
    out = np.zeros((len(to) - 1, n_hashes), np.uint16)
    full = np.flatnonzero(np.diff(to))
    if not len(full):
        return out
    rng = np.random.default_rng(20_240_511)
    mul = rng.integers(1, 1 << 63, n_hashes, dtype=np.uint64) * U(2) + U(1)
    low = (sh >> U(32)) ^ sh
    with np.errstate(over="ignore"):
        for k in range(n_hashes):
            least = np.minimum.reduceat((low * mul[k]) >> U(24), to[full])
            out[full, k] = (mix(least) & U(0xFFFF)).astype(np.uint16)
    return out


def fingerprints(sh: np.ndarray, to: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """128 bits for each text's set of shingles, and the sets' sizes."""
    names, sizes = [], np.zeros(len(to) - 1, np.int64)
    with np.errstate(over="ignore"):
        for i in range(len(to) - 1):
            own = np.unique(sh[to[i] : to[i + 1]])
            sizes[i] = len(own)
            a = mix(own + U(0x1234567)).sum(dtype=U)
            b = mix(own ^ U(0xABCDEF987654321)).sum(dtype=U)
            names.append(int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big"))
    return names, sizes


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Pieces of a batch of about `most` bytes of text, so that memory stays bounded whatever the batch's size."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(n)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def runs(batches, key: str):
    """From batches sorted by a key: tables that hold whole groups only."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows < 2:
            continue
        keys = held.column(key).combine_chunks()
        differs = pc.not_equal(keys, keys[-1]).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held
