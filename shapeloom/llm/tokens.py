"""Exact byte-level BPE token counts at every prefix of a text.

Pieces of the pre-tokenizer are encoded apart, so a piece needs its table only once: for each prefix of its bytes the
last token and the count. A token ends a prefix if it and the last token of what precedes it are what the merges
make of both together; exactly one token does. A text's table is then the pieces' tables, each raised by the count
before it, and answers truncation and budget questions without encoding again.
"""

from __future__ import annotations

import json
import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat
from .store import bounded

#: Fixed value: the published pre-tokenizer pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""


#: The same pieces of texts of Latin-1 characters only: letters, numbers and white space of \p{L}, \p{N} and \p{White_Space} below U+0100, for the faster matcher.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


@dataclass
class PrefixCounter:
    """most_pieces: whose tables are held in each of two generations; a piece that is met again stays. most_prefixes: of up to 16 bytes, held for pieces that begin alike."""

    path: str
    most_pieces: int = 400_000
    most_prefixes: int = 1_000_000
    memo: dict = field(default_factory=dict)

    def __post_init__(self):
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        code = {c: b for b, c in enumerate(_byte_chars())}
        self.special = [t["content"] for t in spec["added_tokens"]]
        raw = lambda t: bytes(code[c] for c in t)
        #: Tokens by number; the first 256 are the bytes.
        self.text = [bytes([b]) for b in range(256)]
        self.id = {t: k for k, t in enumerate(self.text)}
        #: Two tokens -> rank of their merge, and the token it gives.
        self.join: dict[int, int] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            one, two = map(raw, m.split(" ") if isinstance(m, str) else m)
            both = one + two
            if both not in self.id:
                self.id[both] = len(self.text)
                self.text.append(both)
            self.join[self.id[one] << 20 | self.id[two]] = rank << 20 | self.id[both]
        #: Bytes of the longest token that ends with two given bytes.
        self.reach: dict = {}
        for t in self.text:
            self.reach[t[-2:]] = max(len(t), self.reach.get(t[-2:], 2))
        self.whole: dict = {}
        self.prefix: dict = {}
        self.pairs: dict = {}
        self.older: dict = {}
        self.pieces, self.latin = regex.compile(PATTERN), re.compile(LATIN)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def merged(self, piece: bytes) -> list[int]:
        """What the merges make of a short piece."""
        parts, join = list(piece), self.join.get
        while len(parts) > 1:
            best, at, a = 1 << 60, -1, parts[0]
            for i, b in enumerate(parts[1:]):
                v = join(a << 20 | b)
                if v is not None and v < best:
                    best, at = v, i
                a = b
            if at < 0:
                break
            parts[at : at + 2] = [best & 0xFFFFF]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether the merges make these two tokens of the bytes of both."""
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        got = self.pairs[a << 20 | b] = self.merged(self.text[a] + self.text[b]) == [a, b]
        return got

    def stands(self, token: int) -> bool:
        """Whether the merges make the token of its own bytes."""
        got = self.whole.get(token)
        if got is None:
            got = self.whole[token] = self.merged(self.text[token]) == [token]
        return got

    def piece(self, text: str) -> tuple[bytes, int]:
        """Token counts after each code point of one piece, as 32-bit integers, and the last of them."""
        got = self.memo.get(text)
        if got is not None:
            return got
        if len(self.memo) > self.most_pieces:
            self.older, self.memo = self.memo, {}
        got = self.older.get(text)
        if got is None:
            data = text.encode("utf-8", "replace")
            # the last token and the count of a prefix depend on nothing after it: pieces that begin alike share them
            last, count, known = [0], [0], self.prefix
            if len(known) > self.most_prefixes:
                known.clear()
            share = known.get
            for end in range(1, min(len(data), 16) + 1):
                held = share(data[:end])
                if held is None:
                    break
                last.append(held >> 8)
                count.append(held & 0xFF)
            begun = len(last) - 1
            number, longest, pairs = self.id.get, self.reach.get, self.pairs.get
            for end in range(begun + 1, len(data) + 1):
                for begin in range(max(0, end - longest(data[max(0, end - 2) : end], 2)), end):
                    token = number(data[begin:end])
                    if token is None:
                        continue
                    if begin:
                        fits = pairs(last[begin] << 20 | token)
                        if fits is None:
                            fits = self.follows(last[begin], token)
                    else:
                        fits = self.stands(token)
                    if fits:
                        last.append(token)
                        count.append(count[begin] + 1)
                        break
                if end <= 16:
                    known[data[:end]] = last[-1] << 8 | count[-1]
            if len(data) != len(text):
                ends = [k for k in range(1, len(data)) if data[k] & 0xC0 != 0x80]
                count = [0, *(count[k] for k in ends), count[-1]]
            got = array("I", count[1:]).tobytes(), count[-1]
        self.memo[text] = got
        return got

    def _plain(self, text: str) -> np.ndarray:
        """Counts after each code point of a text without special strings.

        Inside a piece the table of the piece holds, but where a prefix would be cut into other pieces: after white
        space that precedes a word, and inside contractions.
        """
        try:
            text.encode("latin-1")
            found = self.latin.findall(text)
        except UnicodeEncodeError:
            found = self.pieces.findall(text)
        if not found:
            return np.zeros(0, np.int32)
        have, piece = self.memo.get, self.piece
        tables = [have(p) or piece(p) for p in found]
        size = np.array([len(p) for p in found])
        total = np.array([t[1] for t in tables])
        base = np.cumsum(total) - total
        out = np.frombuffer(b"".join([t[0] for t in tables]), np.uint32).astype(np.int64) + np.repeat(base, size)
        at = np.cumsum(size) - size
        for k in [k for k, p in enumerate(found) if p[0] == "'" or p.isspace()]:
            p = found[k]
            if len(p) > 2 and p[0] == "'" and p in ("'re", "'ve", "'ll"):
                # after the first letter: the apostrophe and the letter are two pieces
                out[at[k] + 1] = base[k] + self.piece("'")[1] + self.piece(p[1])[1]
            if k + 1 < len(found) and p.isspace() and found[k + 1][0].isspace():
                # a prefix that ends after the next piece's white space has it in this run
                out[at[k + 1]] = base[k] + self.piece(p + found[k + 1][0])[1]
        return out

    def prefixes(self, text: str | None) -> np.ndarray:
        """Token counts after each code point; empty for null and empty texts."""
        text = text or ""
        out, base, begin = [], 0, 0
        for m in self.cut.finditer(text) if self.cut else ():
            # until it is complete, a special string is plain text
            partial = self._plain(text[begin : m.end() - 1])
            out += [partial + base, np.array([base + self.total(text[begin : m.start()]) + 1])]
            base, begin = int(out[-1][0]), m.end()
        out.append(self._plain(text[begin:]) + base)
        return np.concatenate(out)

    def total(self, plain: str) -> int:
        return int(self._plain(plain)[-1]) if plain else 0

    @staticmethod
    def tokens_at(prefixes: np.ndarray, n_chars: int) -> int:
        """Tokens of the first n_chars code points."""
        return int(prefixes[min(n_chars, len(prefixes)) - 1]) if n_chars > 0 and len(prefixes) else 0

    @staticmethod
    def longest_within(prefixes: np.ndarray, budget: int) -> int:
        """Code points of the longest prefix of at most `budget` tokens; counts of longer prefixes may be smaller again, so the last one that fits is sought."""
        fits = np.flatnonzero(prefixes <= budget)
        return int(fits[-1]) + 1 if len(fits) else 0


_counters: dict[str, PrefixCounter] = {}


def _counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str, budgets: tuple[int, ...] = (), tables: bool = False) -> DataFrame:
    """docs with n_bytes and n_tokens; for each budget the code points of the longest prefix within it as fit_<budget>; with tables, all counts as array prefix_tokens. Null texts are empty: 0 tokens."""
    bounded(docs.sparkSession)
    names = ["n_bytes", "n_tokens", *(f"fit_{b}" for b in budgets), *(["prefix_tokens"] if tables else [])]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *(f"{n} {'array<int>' if n == 'prefix_tokens' else 'bigint'}" for n in names)])

    def run(batches):
        counter = _counter(tokenizer)
        for whole in batches:
            for b in flat.slices(whole, "text"):
                out = [[] for _ in names]
                for text in b.column("text").to_pylist():
                    p = counter.prefixes(text)
                    row = [len((text or "").encode("utf-8", "replace")), int(p[-1]) if len(p) else 0, *(counter.longest_within(p, x) for x in budgets), *([p] if tables else [])]
                    for c, v in zip(out, row):
                        c.append(v)
                types = [pa.list_(pa.int32()) if n == "prefix_tokens" else pa.int64() for n in names]
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(out, types))], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
