"""Benchmark decontamination by latent semantic retrieval and checks on the words themselves.

Passages of all documents are TF-IDF vectors over hashed terms. A randomised SVD of their matrix, made of
sums over all passages, gives a latent space; benchmark items are folded in and compared by cosine with
windows of every document. Candidates are confirmed by the longest common subsequence of words, with an
answer check for paraphrases. Word for word copies are candidates whatever their cosine is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.sums import summed
from repoquarry.llm.words import NO_LETTERS, Words, shingles, slices

# Hashed terms; singular directions left out at the front, where languages and their commonest words
# are told apart, those that are kept, and further random directions that steady them.
TERMS = 1 << 13
COMMON = 16
RANK = 96
EXTRA = 16
_SEED = 7
# Words per block; passages of the matrix are so many blocks, windows as many as an item's length asks for.
BLOCK = 16
PASSAGE_BLOCKS = 3
WIDEST = 4
# A window that is an item and otherwise unlike it has a cosine of about the root of the item's share of
# the window; candidates reach this part of it.
COSINE = 0.42
# Share of an item's words that must appear in order; with the answer in place, the lower share is enough.
SHARE = 0.6
PARAPHRASE = 0.5
# Short items need more, as a few common words stand in order by chance: so many words and so much of the
# item's own, or all it has. Beyond 24 words the shares alone decide.
LEAST_WORDS, LEAST_SHARE = 6, 0.25
# Items are limited by the driver's memory, not by a number; longer ones are cut into parts of so many words.
ITEM_WORDS = BLOCK * WIDEST
# Words that tell where a whole copy may begin.
HEAD = 5
_HEAD_SHIFT = np.uint64(44)
_CHUNK = 4096
_COMMON_TERMS = 256
_PASSAGES_AT_ONCE = 1 << 10
_WORDS_AT_ONCE = 1 << 12
_NO_WORD = 1 << 16
# Words are told apart by so many kinds where only a bound is wanted.
KINDS = 1 << 10


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts as 16-bit numbers, and per text its bounds among them."""
    words = Words(texts, NO_LETTERS)
    return (words.hashes() >> np.uint64(48)).astype(np.int32), words.bounds


def terms_of(words: np.ndarray) -> np.ndarray:
    """The hashed term of each word."""
    return words >> 3


def runs(bounds: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive runs of ``step`` words that do not cross texts: (first words, number of words)."""
    sizes = np.diff(bounds)
    count = -(-sizes // step)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(bounds[:-1], count) + inside * step, np.minimum(np.repeat(sizes, count) - inside * step, step)


def in_rows(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, step: int, empty: int) -> np.ndarray:
    """A row of ``step`` values per run, filled up with ``empty``."""
    places = starts[:, None] + np.arange(step)
    missing = np.arange(step) >= sizes[:, None]
    rows = values[np.minimum(places, len(values) - 1)]
    rows[missing] = empty
    return rows


def _passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The term of each word, and the first word and the size of each passage of some texts."""
    words, bounds = words_of(texts)
    return terms_of(words), *runs(bounds, BLOCK * PASSAGE_BLOCKS)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """In how many passages each term is, and how many passages there are."""
    seen = np.zeros(TERMS + 1)
    for batch in batches:
        for _, part in slices(batch.column(0)):
            terms, starts, sizes = _passages(part)
            if not len(terms):
                continue
            rows = np.sort(in_rows(terms, starts, sizes, BLOCK * PASSAGE_BLOCKS, TERMS).astype(np.uint16), axis=1)
            new = np.ones(rows.shape, dtype=bool)
            new[:, 1:] = rows[:, 1:] != rows[:, :-1]
            seen[:-1] += np.bincount(rows[new], minlength=TERMS + 1)[:-1]
            seen[-1] += len(starts)
    return seen[:, None]


def _image(directions: np.ndarray):
    """Sums over passages of c (c' D) / n, for the term counts c of a passage of n words and directions D."""
    width = directions.shape[1]
    space = LatentSpace(directions)

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((TERMS, width))
        for batch in batches:
            for _, part in slices(batch.column(0)):
                terms, starts, sizes = _passages(part)
                if not len(terms):
                    continue
                seen = space.vectors(in_rows(terms, starts, sizes, BLOCK * PASSAGE_BLOCKS, TERMS))
                _add_by_term(total, terms, np.repeat(np.arange(len(starts)), sizes), seen / sizes[:, None].astype(np.float32))
        return total

    return run


def _add_by_term(total: np.ndarray, terms: np.ndarray, passages: np.ndarray, seen: np.ndarray) -> None:
    """Adds to the row of every word's term what its passage has ``seen``; passages do not fall.

    The commonest terms, about half of all words, are summed by a product with their counts, the others
    word by word in order of the term.
    """
    common = np.argsort(-np.bincount(terms, minlength=TERMS), kind="stable")[:_COMMON_TERMS]
    place = np.full(TERMS, -1)
    place[common] = np.arange(len(common))
    kinds = place[terms]
    often = kinds >= 0
    for a in range(0, len(seen), _PASSAGES_AT_ONCE):
        part = seen[a : a + _PASSAGES_AT_ONCE]
        inside = slice(*np.searchsorted(passages, [a, a + len(part)]))
        cells = (kinds[inside] * len(part) + passages[inside] - a)[often[inside]]
        counts = np.bincount(cells, minlength=len(common) * len(part)).reshape(len(common), -1)
        total[common] += counts.astype(np.float32) @ part
    terms, passages = terms[~often], passages[~often]
    order = np.argsort(terms, kind="stable")
    terms, passages = terms[order], passages[order]
    for a in range(0, len(terms), _WORDS_AT_ONCE):
        found = terms[a : a + _WORDS_AT_ONCE]
        firsts = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        total[found[firsts]] += np.add.reduceat(seen.take(passages[a : a + _WORDS_AT_ONCE], axis=0), firsts, axis=0)


class LatentSpace:
    """Term vectors, already weighted by inverse document frequency and divided by the singular values."""

    def __init__(self, terms: np.ndarray):
        # The last row stands for no word.
        self.terms = np.vstack([terms, np.zeros((1, terms.shape[1]))]).astype(np.float32)

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        """Sums of the vectors of each row's terms."""
        out = np.zeros((len(rows), self.terms.shape[1]), dtype=np.float32)
        for a in range(0, len(rows), _CHUNK):
            part, total = rows[a : a + _CHUNK], out[a : a + _CHUNK]
            for k in range(rows.shape[1]):
                total += self.terms.take(part[:, k], axis=0)
        return out


def fit_space(docs: DataFrame, benchmark: DataFrame | None = None) -> LatentSpace:
    """Document frequencies of all passages and the randomised SVD of their TF-IDF matrix A.

    Passages are those of ``docs`` and of the items of ``benchmark``, whose words so are in the space even
    if few documents are.
    One pass over all texts counts, a second one sums ``A'AD`` for random directions D over all passages;
    with ``D'A'AD`` that gives the leading right singular vectors and singular values (Nystrom form). Sums
    depend on the passages only, and batches and partitions change no more than their rounding. The driver
    holds ``TERMS`` x (``COMMON`` + ``RANK`` + ``EXTRA``) numbers whatever the input.
    """
    text = F.col("text").cast("string").alias("text")
    texts = docs.select(text) if benchmark is None else docs.select(text).unionByName(benchmark.select(text))
    texts = texts.where("text IS NOT NULL")
    seen = summed(texts, _frequencies, 1)
    seen = seen[:, 0] if len(seen) else np.zeros(TERMS + 1)
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])).clip(min=0.0)
    width = COMMON + RANK + EXTRA
    directions = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((TERMS, width)))[0]
    image = summed(texts, _image(idf[:, None] * directions), width)
    if not len(image) or not image.any():
        return LatentSpace(np.zeros((TERMS, RANK)))
    image = idf[:, None] * image
    shift = 1e-7 * np.linalg.norm(image)
    image = image + shift * directions
    core = directions.T @ image
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    half = image @ (vectors / np.sqrt(np.maximum(values, shift)))
    left, singular, _ = np.linalg.svd(half, full_matrices=False)
    used = slice(COMMON, COMMON + RANK)
    return LatentSpace(idf[:, None] * left[:, used] / np.maximum(singular[used], 1e-9 * singular[0]))


@dataclass
class Item:
    """A part of a benchmark item: its words, and the last words of it, which hold the answer."""

    number: int
    words: list[int]
    answer: list[int]


def items_of(rows: list[tuple[int, bytes]]) -> list[Item]:
    """Parts of all items; the answer is the end of the last sentence of the part, a quarter of it at most."""
    out = []
    for number, text in rows:
        starts = Words([text], NO_LETTERS).starts
        found = words_of([text])[0].tolist()
        ends = [int(np.searchsorted(starts, i)) for i, b in enumerate(text.rstrip(b" .!?\n")) if b in b".!?"]
        parts = max(1, -(-len(found) // ITEM_WORDS))
        for k in range(parts):
            a, b = k * len(found) // parts, (k + 1) * len(found) // parts
            last = max([e for e in ends if a < e < b], default=b - max(1, (b - a) // 4))
            if b > a:
                out.append(Item(number, found[a:b], found[max(last, b - max(3, (b - a) // 4)) : b]))
    return out


def common_subsequence(item: dict[int, int], size: int, span: list[int]) -> int:
    """Length of the longest common subsequence; ``item`` maps words to the bits of their places."""
    row = full = (1 << size) - 1
    for word in span:
        match = item.get(word)
        if match:
            part = row & match
            row = ((row + part) | (row - part)) & full
    return size - row.bit_count()


def least_words(size: int) -> float:
    """How many words of an item of ``size`` words must appear in order, whatever the shares allow."""
    return min(size, LEAST_WORDS + LEAST_SHARE * size)


class Matcher:
    """Finds items in texts."""

    def __init__(self, space: LatentSpace, items: list[Item]):
        self.space, self.items = space, items
        self.bits = [_bits(item.words) for item in items]
        self.sizes = np.array([len(i.words) for i in items])
        # How many words of each kind an item has; no word is of the last kind.
        self.times = np.zeros((len(items), KINDS + 1), dtype=np.uint8)
        # Where a whole copy may begin: hashes of the first words, and the items that begin so.
        self.heads: dict[int, dict[int, list[int]]] = {}
        for i, item in enumerate(items):
            np.add.at(self.times[i], np.array(item.words) % KINDS, 1)
            size = min(HEAD, len(item.words))
            head = int(shingles(np.array(item.words[:size], dtype=np.uint64), size)[0])
            self.heads.setdefault(size, {}).setdefault(head, []).append(i)
        # Most places are ruled out by the first bits of their hash.
        self.possible = {size: np.zeros(1 << (64 - int(_HEAD_SHIFT)), dtype=bool) for size in self.heads}
        for size, heads in self.heads.items():
            self.possible[size][np.array(list(heads), dtype=np.uint64) >> _HEAD_SHIFT] = True
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        # Wide enough to hold most of the item wherever it begins.
        widths = np.array([min(WIDEST, -(-(len(i.words) + BLOCK // 2) // BLOCK)) for i in items])
        for width in sorted(set(widths.tolist())):
            chosen = np.flatnonzero(widths == width)
            vectors = [space.vectors(terms_of(np.array([items[i].words], np.int32)))[0] for i in chosen]
            level = COSINE * np.sqrt(np.minimum(self.sizes[chosen] / (width * BLOCK), 1.0))
            self.by_width[width] = (chosen, (_unit(np.array(vectors)) / level[:, None]).astype(np.float32), level)

    def find(self, texts: list[bytes]) -> list[tuple[int, int, float, float, bool]]:
        """(text, item number, cosine, share in order, answer in place) of every confirmed leak."""
        words, bounds = words_of(texts)
        if not len(words) or not self.items:
            return []
        starts, sizes = runs(bounds, BLOCK)
        text_of = np.searchsorted(bounds, starts, side="right") - 1
        # A word counts once in a block, or a repeated one would outweigh the item beside it.
        rows = np.sort(in_rows(terms_of(words), starts, sizes, BLOCK, TERMS).astype(np.uint16), axis=1)
        rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = TERMS
        blocks = self.space.vectors(rows)
        copied = self._copies(words, bounds, starts)
        out: dict[tuple[int, int], tuple[float, float, bool]] = {}
        windows = blocks.copy()
        for width in range(1, WIDEST + 1):
            if width > 1:
                # The next block counts where it is of the same text.
                k = width - 1
                same = np.flatnonzero(text_of[k:] == text_of[: len(text_of) - k])
                windows[same] += blocks[same + k]
            if width in self.by_width:
                self._search(out, words, bounds, starts, text_of, windows, width, copied)
        return [(text, number, *best) for (text, number), best in sorted(out.items())]

    def _copies(self, words: np.ndarray, bounds: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(block, item) of every word for word copy of an item that begins in the block."""
        found = []
        for size, heads in self.heads.items():
            if len(words) < size:
                continue
            hashes = shingles(words.astype(np.uint64), size)
            for at in np.flatnonzero(self.possible[size].take((hashes >> _HEAD_SHIFT).astype(np.int64))).tolist():
                end = bounds[np.searchsorted(bounds, at, side="right")]
                for i in heads.get(int(hashes[at]), ()):
                    item = self.items[i].words
                    if at + len(item) <= end and words[at : at + len(item)].tolist() == item:
                        found.append((int(np.searchsorted(starts, at, side="right")) - 1, i))
        return np.array(found, dtype=np.int64).reshape(-1, 2)

    def _search(self, out, words, bounds, starts, text_of, windows, width: int, copied: np.ndarray) -> None:
        chosen, vectors, level = self.by_width[width]
        lengths = np.sqrt(np.einsum("ij,ij->i", windows, windows)) + np.float32(1e-12)
        place = np.full(len(self.items), -1)
        place[chosen] = np.arange(len(chosen))
        copied = copied[place[copied[:, 1]] >= 0]
        for a in range(0, len(windows), _CHUNK):
            near = windows[a : a + _CHUNK] @ vectors.T
            reached = near >= lengths[a : a + _CHUNK, None]
            whole = copied[(copied[:, 0] >= a) & (copied[:, 0] < a + _CHUNK)]
            reached[whole[:, 0] - a, place[whole[:, 1]]] = True
            w, i = np.divmod(np.flatnonzero(reached), len(chosen))
            if not len(w):
                continue
            cosine = near[w, i] / lengths[a + w] * level[i]
            w, i = a + w, chosen[i]
            first = np.maximum(bounds[text_of[w]], starts[w] - BLOCK)
            last = np.minimum(bounds[text_of[w] + 1], starts[w] + (width + 1) * BLOCK)
            common = self._common(in_rows(words, first, last - first, (width + 2) * BLOCK, _NO_WORD), i)
            for k in np.flatnonzero(common >= PARAPHRASE * self.sizes[i]):
                span = words[first[k] : last[k]].tolist()
                self._confirm(out, int(text_of[w[k]]), int(i[k]), span, float(cosine[k]))

    def _common(self, spans: np.ndarray, items: np.ndarray) -> np.ndarray:
        """At least as many as the words of each item that occur at all in its span, and so as its subsequence."""
        out = np.empty(len(items), dtype=np.int32)
        for a in range(0, len(items), _CHUNK):
            kinds = np.where(spans[a : a + _CHUNK] == _NO_WORD, KINDS, spans[a : a + _CHUNK] % KINDS)
            kinds.sort(axis=1)
            kinds[:, 1:][kinds[:, 1:] == kinds[:, :-1]] = KINDS
            out[a : a + _CHUNK] = self.times[items[a : a + _CHUNK, None], kinds].sum(axis=1, dtype=np.int32)
        return out

    def _confirm(self, out, text: int, number: int, span: list[int], cosine: float) -> None:
        item = self.items[number]
        size = len(item.words)
        before = out.get((text, item.number))
        if before and before[1] >= 1.0:
            return
        common = common_subsequence(self.bits[number], size, span)
        share = common / size
        answered = common_subsequence(_bits(item.answer), len(item.answer), span) == len(item.answer)
        enough = share >= SHARE or (share >= PARAPHRASE and answered)
        if enough and common >= least_words(size) and (before is None or share > before[1]):
            out[(text, item.number)] = (cosine, share, answered)


def _bits(words: list[int]) -> dict[int, int]:
    """The places of each word as bits."""
    out: dict[int, int] = {}
    for i, word in enumerate(words):
        out[word] = out.get(word, 0) | 1 << i
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def benchmark_items(benchmark: DataFrame) -> list[Item]:
    """All items on the driver: the benchmark is the query set, and its texts are what is held."""
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct().collect()
    return items_of(sorted((int(r.item_id), r.text.encode()) for r in rows))


def leaks(docs: DataFrame, space: LatentSpace, items: list[Item]) -> DataFrame:
    """(doc_id, item_id, cosine, share, answer) of every document that holds a benchmark item.

    A narrow job over whole texts; every window of every text is compared with every item, in blocks. Tasks
    hold about 1 KB for an item part. Null and empty texts, items without words, and rows or items without an id find nothing (rows without
    an id are reported with a null id); repeated rows are reported each; other columns do not matter.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(space, items)
        for batch in batches:
            for first, part in slices(batch.column(1), 2 << 20):
                found = matcher.find(part)
                ids = batch.column(0).slice(first, len(part)).take(pa.array([f[0] for f in found], pa.int64()))
                columns = [pa.array([f[i] for f in found], t) for i, t in _FOUND]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "item_id", "cosine", "share", "answer"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, item_id bigint, cosine double, share double, answer boolean")


_FOUND = [(1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.bool_())]


def keep_clean(docs: DataFrame, space: LatentSpace, items: list[Item]) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item; a narrow job."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(space, items)
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            for first, part in slices(batch.column(place), 2 << 20):
                for text, *_ in matcher.find(part):
                    clean[first + text] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
