"""BPE encoding as a streaming transducer with a bounded look-ahead, and incremental decoding.

A merge list is applied rule by rule. Two inputs that agree up to some place can only differ to the
left of it if a rule joins the last common token with what follows, which moves the place back by that
token; the next such rule must come later in the list and join a token with one that begins with the
token just lost. The longest such chain, found by one pass over the merges (``sufficient_lookahead``),
bounds how far unseen input can reach back. Tokens that end further back than that are final, so they
are emitted at once and the transducer keeps a buffer whose size depends on the merges only.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.process import kept

# White space of the Unicode property, which str.split widens by U+001C to U+001F.
_SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD_SPACES = re.compile("[\x1c-\x1f]")
# Text is read in windows of about this many characters, cut before an ASCII blank, where neither
# normal forms nor tokens reach across.
WINDOW = 1 << 16
_WINDOW_END = re.compile("[\t-\r ]")
_SHORT = 48
_NONE = 1 << 40
# Encoded words kept per process; at twice as many the oldest are dropped.
_REMEMBERED = 1 << 16


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(moved)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], end: str = "") -> int:
    """Symbols that must follow a place before the tokens to its left are final."""
    reach: dict[str, int] = {}
    longest = 0
    for left, right in merges:
        plain = right.removesuffix(end) if end else right
        before = max((reach.get(plain[:n], 0) for n in range(1, len(plain) + 1)), default=0)
        total = before + len(left)
        if total > reach.get(left, 0):
            reach[left] = total
        longest = max(longest, total)
    return longest


class Bpe:
    """Vocabulary, merges, normal form and word pattern of a tokenizer file; encodes and decodes streams."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.lookahead = sufficient_lookahead(merges, self.end)
        self.block = 2 * self.lookahead + 4096
        self.ranks = {(vocab[a], vocab[b]): i for i, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + self.end] for s in symbols]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split)
        self.tokens: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        self.raw: list[bytes] = list(self.tokens)
        byte_of = {s: b for b, s in enumerate(symbols)}
        # Symbols covered by each token, for places in the buffer of the transducer.
        self.length = [0] * len(self.tokens)
        for token, i in vocab.items():
            plain = token.removesuffix(self.end) if self.end else token
            self.tokens[i] = token.encode()
            self.length[i] = len(plain)
            self.raw[i] = bytes(byte_of[c] for c in plain) + (b" " if plain != token else b"")
        for token, i in self.special.items():
            self.tokens[i] = self.raw[i] = token.encode()

    # Encoding

    def merged(self, ids: list[int]) -> list[int]:
        """Tokens of a run of symbols, lowest rank first, leftmost first among equals."""
        ranks = self.ranks
        if len(ids) <= _SHORT:
            rank, made = ranks.get, self.made
            found = [rank(p, _NONE) for p in zip(ids, ids[1:])]
            while found and (best := min(found)) != _NONE:
                i = found.index(best)
                ids[i : i + 2] = [made[best]]
                del found[i]
                if i:
                    found[i - 1] = rank((ids[i - 1], ids[i]), _NONE)
                if i < len(found):
                    found[i] = rank((ids[i], ids[i + 1]), _NONE)
            return ids
        n = len(ids)
        ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = self.made[ranks[pair]], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                new = (ids[i], ids[after[j]])
                if new in ranks:
                    heapq.heappush(heap, (ranks[new], i, new))
            if before[i] >= 0:
                new = (ids[before[i]], ids[i])
                if new in ranks:
                    heapq.heappush(heap, (ranks[new], before[i], new))
        return [i for i in ids if i >= 0]

    def stable(self, symbols: Iterable[int]) -> Iterator[list[int]]:
        """The transducer: lists of final tokens while the symbols of one word arrive."""
        buffer: list[int] = []
        for symbol in symbols:
            buffer.append(symbol)
            if len(buffer) >= self.block:
                out, reached = [], 0
                for token in self.merged(buffer):
                    if reached + self.length[token] > len(buffer) - self.lookahead:
                        break
                    reached += self.length[token]
                    out.append(token)
                buffer = buffer[reached:]
                yield out
        yield self.merged(buffer)

    def piece(self, piece: str) -> bytes:
        """Token ids of one word as little-endian 32-bit numbers."""
        data = piece.encode("utf-8", "surrogatepass")
        if len(data) <= _SHORT:
            ids = [self.inner[b] for b in data]
            ids[-1] = self.last[data[-1]]
            ids = self.merged(ids)
            return struct.pack(f"<{len(ids)}I", *ids)

        def symbols():
            for b in memoryview(data)[:-1]:
                yield self.inner[b]
            yield self.last[data[-1]]

        return b"".join(np.array(ids, dtype="<u4").tobytes() for ids in self.stable(symbols()))

    def windows(self, chunks: Iterable[str]) -> Iterator[str]:
        """The text again, cut where encoding may be cut."""
        held = ""
        for chunk in chunks:
            held += chunk
            while len(held) > WINDOW:
                cut = _WINDOW_END.search(held, WINDOW)
                if not cut:
                    break
                yield held[: cut.start()]
                held = held[cut.start() :]
        yield held

    def encode(self, chunks: Iterable[str], known: dict | None = None) -> Iterator[bytes]:
        """Ids of a text that arrives in chunks, as little-endian 32-bit numbers, once they are final."""
        known = Known(self) if known is None else known
        for window in self.windows(chunks):
            parts = [window]
            if self.special_pattern and "<" in window:
                parts = self.special_pattern.split(window)
            for odd, part in enumerate(parts):
                if odd % 2:
                    yield self.special[part].to_bytes(4, "little")
                    continue
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                part = part.lower()
                blanks = _SPACES.split(part) if _ODD_SPACES.search(part) else part.split()
                if known.room < len(blanks):
                    known.forget()
                yield b"".join(map(known.__getitem__, blanks))

    # Decoding

    def decode(self, ids: Iterable[bytes], plain: bool = False) -> Iterator[str]:
        """Text of ids that arrive in pieces of whole 32-bit numbers.

        Tokens are bytes; a UTF-8 automaton keeps the unfinished bytes between them and emits text as
        soon as it is determined; bytes that cannot be text become U+FFFD. With ``plain`` the bytes a
        token stands for are decoded, and the ends of words are blanks; otherwise the names of tokens
        are joined with blanks, as libraries do for vocabularies without a decoder.
        """
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        table, glue = (self.raw, b"") if plain else (self.tokens, b" ")
        begun = False
        for piece in ids:
            tokens = np.frombuffer(piece, dtype="<u4").tolist()
            if tokens:
                yield machine.decode((glue if begun else b"") + glue.join(map(table.__getitem__, tokens)))
                begun = True
        yield machine.decode(b"", final=True)


class Known(dict):
    """Ids of blank-separated strings, and of the words in them, seen before; bounded."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe
        self.words: dict[str, bytes] = {}

    def __missing__(self, blank: str) -> bytes:
        out = []
        for word in self.bpe.words.findall(blank):
            ids = self.words.get(word)
            if ids is None:
                ids = self.bpe.piece(word)
                if len(word) <= _SHORT:
                    self.words[word] = ids
            out.append(ids)
        ids = b"".join(out)
        if len(blank) <= _SHORT:
            self[blank] = ids
        return ids

    @property
    def room(self) -> int:
        return 2 * _REMEMBERED - len(self)

    def forget(self) -> None:
        """Drop the oldest until the usual number is left."""
        for memory in (self, self.words):
            for key in list(memory)[: max(0, len(memory) - _REMEMBERED)]:
                del memory[key]


_CODED = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_decode(
    docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """Encodes every whole text, decodes the ids again: (id, n_tokens, ids_sha256, decoded_sha256).

    ``ids_sha256`` is the digest of the ids as little-endian unsigned 32-bit numbers, ``decoded_sha256``
    that of the decoded text in UTF-8. With ``with_ids`` a column ``ids`` holds those bytes.

    A narrow job without a shuffle: ids are hashed and decoded window by window. Null texts count as
    empty: no token, digests of nothing. Repeated rows are coded each for themselves, other columns of
    ``docs`` do not matter, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept(("bpe", path), lambda: Known(Bpe(path)))
        bpe = known.bpe
        for batch in batches:
            rows: list[tuple] = []
            for value in batch.column(1):
                counted, coded, decoded = 0, hashlib.sha256(), hashlib.sha256()
                held: list[bytes] = []

                def ids(text=value.as_py() or "", coded=coded, held=held):
                    nonlocal counted
                    for piece in bpe.encode([text], known):
                        counted += len(piece) // 4
                        coded.update(piece)
                        if with_ids:
                            held.append(piece)
                        yield piece

                for text_out in bpe.decode(ids()):
                    decoded.update(text_out.encode())
                rows.append((counted, coded.hexdigest(), decoded.hexdigest(), b"".join(held)))
            columns = list(zip(*rows)) or [(), (), (), ()]
            arrays = [
                batch.column(0),
                pa.array(columns[0], pa.int64()),
                pa.array(columns[1], pa.string()),
                pa.array(columns[2], pa.string()),
                pa.array(columns[3], pa.binary()),
            ]
            names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
            yield pa.RecordBatch.from_arrays(arrays[: 4 + with_ids], names[: 4 + with_ids])

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, {_CODED}" + (", ids binary" if with_ids else "")
    return docs.select(F.col(f"`{id_column}`"), F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)
