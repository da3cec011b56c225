"""Order-preserving packing of tokenised documents into sequences by dynamic programming.

Documents of a partition stay in order and form one run of tokens. Cuts are chosen among document ends,
sentence ends and, at a price, places within sentences; the cost of a sequence is its padding and the
penalty of the cut that ends it. A cut's best cost needs the least cost among the cuts of the window before
it, which a monotone queue gives in constant time. Nothing is shuffled.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections import deque
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import give_back, wide_rows

#: Words whose ids a worker remembers before it forgets those not used of late.
REMEMBERED = 400_000
#: Tokens after which the best cuts so far are taken for good.
TOKENS_AT_ONCE = 1 << 18
#: Id that ends every document.
END = 1
#: Characters of text that are encoded together, one text at least.
TEXT_AT_ONCE = 8 << 20
#: Words that the tokenizer gets together, and in one text.
WORDS_AT_ONCE = 8192
WORDS_IN_TEXT = 256
#: What may follow the letters of a word; a run of these is a token sequence of its own.
_TAIL = ".,;:!?%&*#$"
#: The letter whose lower case is a letter and a mark, which joins what follows; below it all have one letter.
_PLAIN = "\u0130"
_WORD_END = "</w>"
#: Letters that the tokenizer's normal form (NFC, lower case) turns into a letter and a mark.
_COMPOSED = "[" + _PLAIN + "".join(c for c in map(chr, range(0x0900, 0xFB50)) if len(unicodedata.normalize("NFC", c)) > 1) + "]"


class Words:
    """Words and their ids: an Arrow array, the number of ids of each, and all ids in a row."""

    def __init__(self, words: pa.Array, size: np.ndarray, ids: np.ndarray):
        self.words, self.size, self.ids = words, size, ids

    def of(self, at: np.ndarray) -> Words:
        """The words at these places."""
        return Words(self.words.take(pa.array(at)), self.size[at], _spans(self.ids, (np.cumsum(self.size) - self.size)[at], self.size[at]))

    def __add__(self, other: Words) -> Words:
        return Words(pa.concat_arrays([self.words, other.words]), np.r_[self.size, other.size], np.r_[self.ids, other.ids])


def _spans(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[begin : begin + size] for each pair, one after the other."""
    where = np.repeat(begin - (np.cumsum(size) - size), size)
    where += np.arange(len(where))
    return values[where]


class Encoder:
    """Ids of texts as unsigned 32-bit numbers.

    Tokens of the vocabulary never reach over white space, so the distinct words of many texts are encoded
    once and remembered. New words of letters are encoded as one text, in which the vocabulary's word ends
    tell them apart.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        whole = (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)
        by_space = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ways = {False: whole, True: (normalizers.Sequence([]), by_space)}
        self.simple = False
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith(_WORD_END)]] = True
        self.known = self._encode(pa.array([], pa.string()))
        self.used = np.zeros(0, bool)

    def _run(self, texts: list[str], simple: bool) -> list:
        """Encodings of texts; simple ones are lower-case words of letters, which nothing but spaces parts."""
        if simple != self.simple:
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.ways[simple]
            self.simple = simple
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _encode(self, words: pa.Array) -> Words:
        """Each word on its own."""
        ids = [np.zeros(0, np.uint32)]
        for part in self._parts(words):
            ids += [np.array(e.ids, np.uint32) for e in self._run(part, False)]
        return Words(words, np.array([len(i) for i in ids[1:]], np.int64), np.concatenate(ids))

    def _letters(self, words: pa.Array) -> Words:
        """Words of letters, many as one text."""
        sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for part in self._parts(words):
            texts = [" ".join(part[k : k + WORDS_IN_TEXT]) for k in range(0, len(part), WORDS_IN_TEXT)]
            simple = all(t.isascii() or max(t) < _PLAIN for t in texts)  # composed letters whose lower case is one letter
            found = self._run([t.lower() for t in texts] if simple else texts, simple)
            ids.append(np.concatenate([np.array(e.ids, np.uint32) for e in found]))
            stops = np.flatnonzero(self.ends[ids[-1]]) + 1
            if len(stops) != len(part):
                return self._encode(words)
            sizes.append(np.diff(stops, prepend=0))
        return Words(words, np.concatenate(sizes), np.concatenate(ids))

    @staticmethod
    def _parts(words: pa.Array):
        for k in range(0, len(words), WORDS_AT_ONCE):
            yield words.slice(k, WORDS_AT_ONCE).to_pylist()

    def _learn(self, words: pa.Array) -> Words:
        """The ids of new words, in an order of its own."""
        core = pc.utf8_rtrim(words, _TAIL)
        plain = pc.and_not(pc.utf8_is_alpha(core), pc.match_substring_regex(core, _COMPOSED)).to_numpy(zero_copy_only=False)
        tailed = plain & (pc.binary_length(core).to_numpy() < pc.binary_length(words).to_numpy())
        pick = lambda array, mask: array.filter(pa.array(mask))
        found = self._letters(pick(words, plain & ~tailed)) + self._encode(pick(words, ~plain))
        if not tailed.any():
            return found
        wholes, heads = pick(words, tailed), pick(core, tailed)
        head = heads.dictionary_encode()
        before = self._letters(head.dictionary).of(head.indices.to_numpy())
        tail = pa.array([w[len(h) :] for w, h in zip(wholes.to_pylist(), heads.to_pylist())]).dictionary_encode()
        after = self._encode(tail.dictionary).of(tail.indices.to_numpy())
        both = np.empty(2 * len(wholes), np.int64)
        both[::2], both[1::2] = before.size, after.size
        first = np.repeat(np.arange(len(both)) % 2 == 0, both)
        ids = np.empty(int(both.sum()), np.uint32)
        ids[first], ids[~first] = before.ids, after.ids
        return found + Words(wholes, before.size + after.size, ids)

    def _known(self, words: pa.Array) -> np.ndarray:
        """Places of the words among the known ones, which the new ones join; those not used of late make room."""
        if len(self.used) > REMEMBERED:
            self.known = self.known.of(np.flatnonzero(self.used))
            if len(self.known.size) > REMEMBERED // 2:
                self.known = self.known.of(np.arange(0))
            self.used = np.zeros(len(self.known.size), bool)
        at = pc.index_in(words, value_set=self.known.words)
        if at.null_count:
            self.known += self._learn(words.filter(at.is_null()))
            self.used = np.r_[self.used, np.zeros(len(self.known.size) - len(self.used), bool)]
            at = pc.index_in(words, value_set=self.known.words)
        at = at.to_numpy()
        self.used[at] = True
        return at

    def documents(self, texts: pa.Array):
        """Of each text: the tokens of every sentence, and the bytes of all ids."""
        lines = pc.split_pattern(texts.fill_null(""), "\n")
        parts = pc.ascii_split_whitespace(lines.values)
        found = parts.values.dictionary_encode()
        words, codes = found.dictionary, found.indices.to_numpy()
        at = self._known(words)
        size, every = self.known.size, self.known.ids
        begin = (np.cumsum(size) - size)[at]
        size = size[at]
        line_ends = parts.offsets.to_numpy()
        ends = pc.match_substring_regex(words, "[.!?]$").to_numpy(zero_copy_only=False)[codes]
        ends[line_ends[1:][np.diff(line_ends) > 0] - 1] = True
        ends = np.flatnonzero(ends)
        upto = np.cumsum(size[codes], dtype=np.int64)
        sentences = np.diff(upto[ends], prepend=0)
        word_at = line_ends[lines.offsets.to_numpy()]
        token_at, sentence_at = np.r_[0, upto][word_at], np.searchsorted(ends, word_at).tolist()
        group = token_at[1:] // TOKENS_AT_ONCE
        cuts = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(texts)]
        for lo, hi in zip(cuts, cuts[1:]):
            part = codes[word_at[lo] : word_at[hi]]
            tokens = _spans(every, begin[part], size[part])
            at = (token_at[lo : hi + 1] - token_at[lo]).tolist()
            for i in range(lo, hi):
                yield sentences[sentence_at[i] : sentence_at[i + 1]], tokens[at[i - lo] : at[i - lo + 1]].tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a Python worker, which keeps the words of earlier tasks."""
    return Encoder(path)


class Packer:
    """Chooses the cuts of one partition's documents. Positions count tokens from the partition's start."""

    def __init__(self, window: int, sentence_penalty: float, word_penalty: float, step: int):
        self.window, self.sentence_penalty, self.word_penalty, self.step = window, sentence_penalty, word_penalty, step
        self.even = [1 << k for k in range(7, window.bit_length()) if 1 << k < window]
        self.docs: deque = deque()  # (id, first position, ids)
        self.start = self.end = self.taken = 0  # where what isn't settled starts, all ends, and cuts are known up to
        self.waiting: list[np.ndarray] = []  # sizes of sentences whose cuts aren't known yet, 0 before a document's end
        self.cuts = (np.zeros(0, np.int64), np.zeros(0))  # positions and penalties

    def add(self, doc_id, sizes, ids: bytes) -> None:
        """Take up a document of sentences of these sizes."""
        self.docs.append((doc_id, self.end, ids + END.to_bytes(4, "little")))
        self.waiting.append(np.asarray(sizes, np.int64))
        self.end += (len(ids) >> 2) + 1

    def _take(self) -> None:
        """Turn what waits into cuts: sentence ends, document ends (a token further), and every step within sentences."""
        lengths = np.array([len(w) + 1 for w in self.waiting], np.int64)
        last = np.cumsum(lengths) - 1
        sizes = np.ones(int(lengths.sum()), np.int64)
        inner = np.ones(len(sizes), bool)
        inner[last] = False
        if inner.any():
            sizes[inner] = np.concatenate(self.waiting)
        penalty, full = np.where(inner, self.sentence_penalty, 0.0), sizes > 0
        sizes, penalty = sizes[full], penalty[full]
        stops = self.taken + np.cumsum(sizes)
        counts = (sizes - 1) // self.step + 1
        ends = np.cumsum(counts) - 1
        place = np.arange(int(counts.sum())) - np.repeat(ends - counts, counts)
        positions = np.repeat(stops - sizes, counts) + place * self.step
        penalties = np.full(len(positions), self.word_penalty)
        positions[ends], penalties[ends] = stops, penalty
        self.cuts = (np.r_[self.cuts[0], positions], np.r_[self.cuts[1], penalties])
        self.waiting, self.taken = [], self.end

    def solve(self) -> None:
        """Least cost, and the cut before, of every cut since the start."""
        if self.waiting:
            self._take()
        places, window = np.r_[self.start, self.cuts[0]], self.window
        later, earlier = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]  # pairs of cuts that leave a size without padding
        for w in self.even:
            at = np.searchsorted(places, places - w)
            found = np.flatnonzero(places[at] == places - w)
            later.append(found)
            earlier.append(at[found])
        order = np.argsort(np.concatenate(later), kind="stable")
        ends, starts = np.concatenate(later)[order].tolist() + [0], np.concatenate(earlier)[order].tolist()
        self.pos = pos = places.tolist()
        best, back, queue = [0.0], [0], deque([(float(pos[0]), 0)])
        pair = 0
        for j, penalty in enumerate(self.cuts[1].tolist(), 1):
            p = pos[j]
            low = p - window
            while pos[queue[0][1]] < low:
                queue.popleft()
            cost, i = queue[0]
            cost -= low
            while ends[pair] == j:
                k = starts[pair]
                if best[k] < cost:
                    cost, i = best[k], k
                pair += 1
            cost += penalty
            best.append(cost)
            back.append(i)
            cost += p
            while queue and queue[-1][0] >= cost:
                queue.pop()
            queue.append((cost, j))
        self.best, self.back = best, back

    def _path(self, i: int) -> list[int]:
        cuts = [i]
        while i:
            i = self.back[i]
            cuts.append(i)
        return [self.pos[i] for i in reversed(cuts)]

    def settled(self) -> list[int]:
        """Cuts that are taken for good: the cheapest way into the last window; what follows starts anew."""
        self.solve()
        pos, best = self.pos, self.best
        i = min((k for k in range(len(pos)) if pos[k] > self.end - self.window), key=lambda k: (best[k], -pos[k]))
        self.start, self.cuts = pos[i], (self.cuts[0][i:], self.cuts[1][i:])
        return self._path(i)

    def last(self) -> list[int]:
        """Cuts to the end: the last sequence is padded, or cut into sizes that need no padding."""
        self.solve()
        pos, end = self.pos, self.end

        def rest(k: int) -> tuple[float, list[int]]:
            size = end - pos[k]
            sizes = [1 << b for b in reversed(range(size.bit_length())) if size >> b & 1]
            free = (len(sizes) - 1) * self.word_penalty
            return (free, sizes) if free < self.window - size else (self.window - size, [size])

        i = min((k for k in range(len(pos) - 1) if pos[k] >= end - self.window), key=lambda k: self.best[k] + rest(k)[0])
        return self._path(i) + list(accumulate(rest(i)[1], initial=pos[i]))[1:]

    def pieces(self, cuts: list[int]):
        """(id, start, length, crc32, document's tokens, sequence within `cuts`, offset) between the cuts."""
        docs = self.docs
        for n, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            p = lo
            while p < hi:
                doc_id, first, ids = docs[0]
                size = len(ids) >> 2
                stop = min(hi, first + size)
                part = memoryview(ids)[4 * (p - first) : 4 * (stop - first)]
                yield doc_id, p - first, stop - p, zlib.crc32(part), size, n, p - lo
                if stop == first + size:
                    docs.popleft()
                p = stop


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = 2048,
    sentence_penalty: float = 1.0,
    word_penalty: float = 8.0,
    step: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of every document in sequences of at most `window` tokens; see PIECES for the columns.

    `tokenizer` is the path of a vocabulary file on every executor. A document is the ids of its whole text
    and then END; a null or empty text is END alone. Each id lies in exactly one piece. A cut costs 0 at a
    document's end, `sentence_penalty` at a sentence's and `word_penalty` inside one, where cuts may fall
    every `step` tokens; padding costs 1 a token, and sizes that are powers of two need none. Documents
    keep the order of their partition, and a sequence holds documents of one partition only. sequence_id
    holds the partition in its upper bits. Ids may be null or repeat; rows stay apart. An empty table gives
    an empty result, and other columns are not read.
    """
    if step < 1 or window < step:
        raise ValueError("step must be from 1 to window")
    wide_rows(docs.sparkSession)
    id_type = docs.select(id_col).schema[0]
    schema = T.StructType([T.StructField(id_col, id_type.dataType)] + [T.StructField(c, T.LongType()) for c in PIECES[1:]])

    def run(batches):
        words, packer = encoder(tokenizer), Packer(window, sentence_penalty, word_penalty, step)
        base, sequences, since = TaskContext.get().partitionId() << 33, 0, 0

        def rows(cuts):
            nonlocal sequences
            found = [(*r[:5], base + sequences + r[5], r[6]) for r in packer.pieces(cuts)]
            sequences += len(cuts) - 1
            arrays = [pa.array([r[i] for r in found], t) for i, t in enumerate([kind] + [pa.int64()] * 6)]
            return pa.RecordBatch.from_arrays(arrays, names=[id_col, *PIECES[1:]])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            group = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), dtype=np.int64) // TEXT_AT_ONCE
            cuts = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(group)]
            for lo, hi in zip(cuts, cuts[1:]):
                ids = batch.column(0).slice(lo, hi - lo).to_pylist()
                for doc_id, (sizes, tokens) in zip(ids, words.documents(batch.column(1).slice(lo, hi - lo))):
                    packer.add(doc_id, sizes, tokens)
                    if packer.end >= since + TOKENS_AT_ONCE:
                        since = packer.end
                        yield rows(packer.settled())
        if packer.docs:
            yield rows(packer.last())
        give_back()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


PIECES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
