"""BPE encoding and decoding with a vocabulary file of the tokenizers library (byte-level alphabet, word-end suffix).

Encoding is a bounded-lookahead streaming transducer.  Texts are read in pieces, and tokens are emitted once they are stable.  A
word's end makes its tokens stable; inside a word, ``sufficient_lookahead`` derives from the merge list how far a
later symbol can change earlier tokens, so a token that ends at least that far before the end of what was read is emitted and
its symbols are forgotten.  Beside the row itself, memory is constant: a piece, a window of symbols and bounded caches.

Why the bound holds: compare merging a prefix alone with merging the whole word.  Merges run by rank.  Left of a boundary both
hold the same tokens; the boundary moves only when merge k joins the last common token to something right of it, and then by
the length of k's left part ``a``.  What starts at the new boundary has ``a`` on its left edge, so the next such merge has a
higher rank and a right part with ``a`` on its left edge.  The longest chain of such merges is the lookahead.

Decoding is an incremental byte-to-text state machine, ``Decoder``: ids come in pieces, and bytes of an incomplete character
wait for the next piece.  A file without a decoder, like the given one, prescribes the tokens' own characters, one space apart;
their bytes pass the same machine.

Letters, numbers and lower case are those of the library's Unicode tables: Python's (15.1 or later) and what ``NEWER_*`` add.
They are built from Python, whose version Spark requires to be the same everywhere, so no module's version matters.

Defined results: null text counts as empty and gives no tokens; the file's special tokens in a text become their ids, as the
library does; a text is never cut; repeated rows are reported alike; an empty table gives an empty table.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Block, column, ranges, scan

#: White space of the normaliser's ``\s``: fixed values.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters and numbers that Unicode 16 added (first, last), and lower case that 16 and 17 added (first, last, lower
#: case of the first).
NEWER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEWER_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
NEWER_LOWER = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]
CACHED_WORDS = 300_000
CACHED_IDS = 4_000_000
PIECE_BYTES = 1 << 16
TOGETHER = 32
NO_RANK = 1 << 60
PLACE = (1 << 40) - 1


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b if b in plain else 256 + extra))
        extra += b not in plain
    return out


def sufficient_lookahead(merges: list[tuple[str, str]], suffix: str = "") -> int:
    """Symbols after a token's end that decide whether it is final."""
    size = lambda t: len(t.removesuffix(suffix)) if suffix and len(t) > len(suffix) else len(t)
    left_of = {a + b: a for a, b in merges}
    reach: dict[str, int] = {}
    most = 0
    for a, b in reversed(merges):
        chain = size(a) + reach.get(a, 0)
        most = max(most, chain)
        while b is not None:
            reach[b] = max(reach.get(b, 0), chain)
            b = left_of.get(b)
    return most


def word_patterns() -> list[re.Pattern]:
    """The file's words, and line ends, in texts of the Unicode plane 0 and in all texts."""
    kinds = "".join(unicodedata.category(chr(c))[0] for c in range(0x110000))

    def character_class(category: str, newer: list[tuple[int, int]], top: int) -> str:
        spans = [(m.start(), m.end() - 1) for m in re.finditer(category + "+", kinds[:top])] + [x for x in newer if x[0] < top]
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)

    def pattern(top: int) -> re.Pattern:
        letters, numbers = character_class("L", NEWER_LETTERS, top), character_class("N", NEWER_NUMBERS, top)
        return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+|\n")

    return [pattern(0x10000), pattern(0x110000)]


NEWER = {a + i: chr(low + i) for a, b, low in NEWER_LOWER for i in range(b - a + 1)}


def normal(text: str) -> str:
    """The file's normal form: composed, and each character in lower case by itself."""
    if text.isascii():
        return text.lower()
    low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    high = codes[codes >= min(NEWER)]
    return low.translate(NEWER) if len(high) and not NEWER.keys().isdisjoint(high.tolist()) else low


class Runs:
    """Ids of many keys (words, or chunks of text), one run behind another, so that the runs of many keys are gathered at once."""

    def __init__(self):
        self.at: dict = {}
        self.ids, self.first, self.size, self.used = np.empty(1 << 12, np.int32), np.empty(1 << 10, np.int64), np.empty(1 << 10, np.int32), 0

    def add(self, keys: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.at)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        while n + len(keys) > len(self.first):
            self.first, self.size = (np.concatenate((x, np.empty_like(x))) for x in (self.first, self.size))
        self.ids[self.used : self.used + len(ids)] = ids
        self.first[n : n + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(keys)] = sizes
        self.used += len(ids)
        self.at.update(zip(keys, range(n, n + len(keys)), strict=True))

    def places(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.at.__getitem__, keys), dtype=np.int64, count=len(keys))

    def gather(self, places: np.ndarray) -> np.ndarray:
        first = self.first[places]
        return self.ids[ranges(first, first + self.size[places])]


class Spelled:
    """A byte string for each id, and the joined strings of many ids."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.size = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
        self.first = np.cumsum(self.size) - self.size

    def join(self, ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        """The strings of ids[cuts[i] : cuts[i + 1]], joined, for each i."""
        first, size = self.first[ids], self.size[ids]
        data = self.data[ranges(first, first + size)].tobytes()
        ends = np.concatenate(([0], np.cumsum(size)))[cuts].tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


class Bpe:
    """Normaliser, word splitter, transducer and decoder of one vocabulary file."""

    def __init__(self, path: str, window: int | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.has_decoder = bool(spec.get("decoder"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in self.alphabet]
        self.last = [vocab[c + self.suffix] for c in self.alphabet]
        self.rank = {vocab[a] << 20 | vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self.size = {i: len(t) - len(self.suffix) if self.suffix and t.endswith(self.suffix) else len(t) for t, i in vocab.items()}
        self.lookahead = sufficient_lookahead(merges, self.suffix)
        self.window = max(window or 8 * self.lookahead, 2 * self.lookahead + 64)
        self.patterns = word_patterns()
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pairs = np.array(sorted(self.rank), dtype=np.int64)
        self.pair_rank = np.array([self.rank[k] for k in sorted(self.rank)], dtype=np.int64)
        self.made_array = np.array([*self.made, 0], dtype=np.int64)
        self.inner_array, self.last_array = np.array(self.inner), np.array(self.last)
        every = range(max(self.token) + 1)
        self.decimals = Spelled([f" {i}".encode() for i in every])
        self.spelled = {True: Spelled([f" {self.token.get(i, '')}".encode() for i in every]), False: Spelled([self.bytes_of(self.token.get(i, "")) for i in every])}
        self.words, self.chunks = Runs(), Runs()

    def bytes_of(self, token: str) -> bytes:
        """The bytes that a token stands for; a word's end is a space."""
        if token in self.special:
            return token.encode()
        end = bool(self.suffix) and token.endswith(self.suffix)
        known = {c: b for b, c in enumerate(self.alphabet)}
        return bytes(known[c] for c in (token[: -len(self.suffix)] if end else token)) + b" " * end

    def merge(self, ids: list[int]) -> list[int]:
        """Applies the merges to a list of symbols, lowest rank first, leftmost first: a heap of pairs over linked symbols."""
        rank, made, n = self.rank.get, self.made, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = [rank(a << 20 | b, NO_RANK) for a, b in zip(ids, ids[1:], strict=False)]
        heap = [r << 40 | i for i, r in enumerate(ranks) if r != NO_RANK]
        heapq.heapify(heap)
        while heap:
            least = heapq.heappop(heap)
            i, r = least & PLACE, least >> 40
            j = after[i]
            # Pairs that other merges have changed since are passed over.
            if ids[i] < 0 or j == n or rank(ids[i] << 20 | ids[j], NO_RANK) != r:
                continue
            new, ids[j] = made[r], -1
            ids[i] = new
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                r = rank(new << 20 | ids[j], NO_RANK)
                if r != NO_RANK:
                    heapq.heappush(heap, r << 40 | i)
            j = before[i]
            if j >= 0:
                r = rank(ids[j] << 20 | new, NO_RANK)
                if r != NO_RANK:
                    heapq.heappush(heap, r << 40 | j)
        return [i for i in ids if i >= 0]

    def transduce(self, symbols):
        """Ids of one word from an iterable of its bytes, each as soon as it is final; holds ``window`` symbols at most."""
        held: list[int] = []
        symbols = iter(symbols)
        ahead = list(islice(symbols, 1))
        while ahead:
            need = max(1, self.window - len(held))
            read = ahead + list(islice(symbols, need))
            # The last byte that was read waits, as it may be the word's last.
            ahead = read[need:]
            held += map(self.inner.__getitem__, read[:need] if ahead else read[:-1])
            if not ahead:
                held.append(self.last[read[-1]])
                break
            end, done = 0, 0
            ids = self.merge(held.copy())
            for i in ids:
                if end + self.size[i] > len(held) - self.lookahead:
                    break
                end += self.size[i]
                done += 1
            yield from ids[:done]
            del held[:end]
        yield from self.merge(held)

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of a run of text without special tokens."""
        out: list[int] = []
        for w in self.split(normal(piece)):
            out += self.transduce(w.encode())
        return out

    def split(self, clean: str) -> list[str]:
        beyond = not clean.isascii() and len(clean.encode("utf-16-le")) > 2 * len(clean)
        return self.patterns[beyond].findall(clean)

    def flush_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """What the transducer holds at the end of each of many words shorter than its window, merged all at once: a row of
        symbols for each word, and in each round the leftmost pair of lowest rank of every row.  Ids, and how many of each word."""
        n, size = len(words), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        if not n:
            return size, size
        width = int(size.max())
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        place = np.arange(width)
        ids = np.full((n, width + 1), -1, dtype=np.int64)
        ids[:, :width][place < size[:, None]] = self.inner_array[flat]
        ids[np.arange(n), size - 1] = self.last_array[flat[np.cumsum(size) - 1]]
        none = len(self.made)

        def ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            key = (left << 20) | right
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            return np.where((self.pairs[at] == key) & (right >= 0), self.pair_rank[at], none)

        rank = ranks(ids[:, :-1], ids[:, 1:])
        rows = np.arange(n)
        columns = np.arange(width + 1)
        while True:
            least = rank[rows].min(axis=1)
            rows, least = rows[least < none], least[least < none]
            if not len(rows):
                break
            at = rank[rows].argmin(axis=1)
            ids[rows, at] = self.made_array[least]
            source = np.minimum(columns + (columns > at[:, None]), width)
            shifted = np.take_along_axis(ids[rows], source, axis=1)
            shifted[:, -1] = -1
            ids[rows] = shifted
            moved = np.take_along_axis(rank[rows], np.minimum(source[:, :width], width - 1), axis=1)
            moved[:, -1] = none
            each = np.arange(len(rows))
            moved[each, at] = ranks(shifted[each, at], shifted[each, np.minimum(at + 1, width)])
            before = np.flatnonzero(at > 0)
            moved[before, at[before] - 1] = ranks(shifted[before, at[before] - 1], shifted[before, at[before]])
            rank[rows] = moved
        return ids[ids >= 0], (ids >= 0).sum(axis=1)

    def ids_of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one text behind another, and where each text's ids start.

        Works on chunks (runs without ASCII white space), whose ids are kept between calls: CACHED_WORDS of them and what the
        texts themselves need, whatever the corpus; no more once they hold CACHED_IDS."""
        if len(self.chunks.at) > CACHED_WORDS or self.chunks.used > CACHED_IDS:
            self.chunks = Runs()
        block = Block(texts)
        chunks = block.bytes.tobytes().split()
        places = np.fromiter(map(self.chunks.at.get, chunks, repeat(-1)), dtype=np.int64, count=len(chunks))
        new = np.flatnonzero(places < 0)
        if len(new):
            seen = [chunks[i] for i in new]
            self.add_chunks(list(set(seen)))
            places[new] = self.chunks.places(seen)
        n = block.count(block.words()[2], self.chunks.size[places])
        return self.chunks.gather(places), np.concatenate(([0], np.cumsum(n))).astype(np.int64)

    def add_chunks(self, new: list[bytes]) -> None:
        special = [c for c in new if b"<|" in c] if self.special else []
        if special:
            ids = [self.encode_chunk(c) for c in special]
            self.chunks.add(special, np.array([i for x in ids for i in x], dtype=np.int32), np.array([len(x) for x in ids]))
            new = [c for c in new if c not in self.chunks.at]
        if len(self.words.at) > CACHED_WORDS or self.words.used > CACHED_IDS or not self.words.at:
            self.words = Runs()
            self.words.add(["\n"], np.empty(0, np.int32), np.zeros(1, np.int64))
        found = self.split(normal(b"\n".join(new).decode("utf-8", "replace")))
        unseen = [w.encode() for w in set(found) - self.words.at.keys()]
        short, long_ = [w for w in unseen if len(w) <= TOGETHER], [w for w in unseen if len(w) > TOGETHER]
        ids, sizes = self.flush_all(short)
        tails = [np.fromiter(self.transduce(w), dtype=np.int64) for w in long_]
        self.words.add([w.decode() for w in short + long_], np.concatenate([ids, *tails]), np.concatenate([sizes, [len(t) for t in tails]]).astype(np.int64))
        places = self.words.places(found)
        chunk = np.cumsum(places == 0)
        self.chunks.add(new, self.words.gather(places), np.bincount(chunk, weights=self.words.size[places], minlength=len(new)).astype(np.int64))

    def encode(self, text: bytes) -> list[int]:
        out: list[int] = []
        for chunk in text.split():
            out += self.encode_chunk(chunk)
        return out

    def encode_chunk(self, chunk: bytes) -> list[int]:
        """Ids of a run of bytes without ASCII white space, at which no token, normal form or special token can cross."""
        text = chunk.decode("utf-8", "replace")
        if self.specials is None or "<" not in text:
            return self.encode_piece(text)
        out: list[int] = []
        for part in self.specials.split(text):
            out += [self.special[part]] if part in self.special else self.encode_piece(part) if part else []
        return out

    def digests(self, texts: list[bytes], keep: bool = True) -> list[Digest]:
        """Each text's tokens, read in pieces of about PIECE_BYTES; ``keep``: with the ids themselves."""
        out = [Digest(self, keep) for _ in texts]
        pieces = [(i, p) for i, t in enumerate(texts) for p in cut(t)]
        at = 0
        while at < len(pieces):
            end, size = at, 0
            while end < len(pieces) and (end == at or size + len(pieces[end][1]) <= 4 * PIECE_BYTES):
                size += len(pieces[end][1])
                end += 1
            ids, cuts = self.ids_of([p for _, p in pieces[at:end]])
            owners = [out[i] for i, _ in pieces[at:end]]
            # One word may be longer than a piece: its ids go on in runs.
            runs = range(0, len(ids), PIECE_BYTES) if len(owners) == 1 else ()
            for x in runs:
                self.hand_on(ids, np.array([x, min(x + PIECE_BYTES, len(ids))]), owners)
            if not runs:
                self.hand_on(ids, cuts, owners)
            at = end
        return out

    def hand_on(self, ids: np.ndarray, cuts: np.ndarray, digests: list[Digest]) -> None:
        ids, cuts = ids[cuts[0] : cuts[-1]], cuts - cuts[0]
        shown, spelled = self.decimals.join(ids, cuts), self.spelled[not self.has_decoder].join(ids, cuts)
        for digest, a, b, x, y in zip(digests, cuts[:-1].tolist(), cuts[1:].tolist(), shown, spelled, strict=True):
            digest.take(ids[a:b], x, y)


def cut(text: bytes):
    """A text's pieces: PIECE_BYTES and what is left of the word there."""
    at = 0
    while len(text) - at > PIECE_BYTES:
        space = SPACE_BYTE(text, at + PIECE_BYTES)
        if space is None:
            break
        yield text[at : space.start()]
        at = space.start()
    yield text[at:]


SPACE_BYTE = re.compile(rb"[\t-\r ]").search


class Digest:
    """What is kept of a text's tokens, taken piece by piece: their number, the SHA-256 of the ids in decimal one space apart and
    of the decoded text, and the ids if wanted."""

    def __init__(self, bpe: Bpe, keep: bool = True):
        self.keep, self.n, self.ids, self.ids_sha, self.text_sha, self.decoder = keep, 0, [], hashlib.sha256(), hashlib.sha256(), Decoder(bpe)

    def take(self, ids: np.ndarray, shown: bytes, spelled: bytes) -> None:
        self.ids_sha.update(shown if self.n else shown[1:])
        self.text_sha.update(self.decoder.take(spelled).encode())
        self.n += len(ids)
        if self.keep:
            self.ids.append(ids)

    def finish(self) -> tuple[int, str, str]:
        self.text_sha.update(self.decoder.finish().encode())
        return self.n, self.ids_sha.hexdigest(), self.text_sha.hexdigest()


class Decoder:
    """Takes the ids of a text in pieces; gives its characters as soon as they are complete.

    ``as_tokens``: the tokens' own characters, one space apart (the default for files without a decoder), else what their bytes
    spell, a word's end being a space; bytes that are no character become U+FFFD.
    """

    def __init__(self, bpe: Bpe, as_tokens: bool | None = None):
        self.as_tokens = not bpe.has_decoder if as_tokens is None else as_tokens
        self.spelled = bpe.spelled[self.as_tokens]
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: np.ndarray) -> str:
        return self.take(self.spelled.join(ids, np.array([0, len(ids)]))[0])

    def take(self, data: bytes) -> str:
        """As ``feed``, from what the ids spell."""
        if self.as_tokens and not self.begun:
            self.begun, data = len(data) > 0, data[1:]
        return self.machine.decode(data)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def held(cell: list, path: str) -> Bpe:
    """The tables of ``path``, read once in each task: ``cell`` travels empty and is filled on the executor."""
    if not cell:
        cell.append(Bpe(path))
    return cell[0]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of each document; ``path`` must exist on every executor."""
    return digested(docs, path).select("doc_id", "ids")


def decode(tokens: DataFrame, path: str, as_tokens: bool | None = None) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids count as none."""
    cell: list = []

    def run(batches):
        for batch in batches:
            bpe = held(cell, path)
            texts = []
            for ids in column(batch, "ids").to_pylist():
                decoder = Decoder(bpe, as_tokens)
                texts.append(decoder.feed(np.array(ids or [], dtype=np.int64)) + decoder.finish())
            yield pa.RecordBatch.from_pydict({"doc_id": column(batch, "doc_id"), "text": pa.array(texts, pa.string())})

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def digested(docs: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """doc_id, ids (if wanted), n_tokens and the SHA-256 of ids and of the text decoded from them."""
    cell: list = []

    def kernel(batch, texts):
        parts = held(cell, path).digests(texts, ids)
        n, ids_sha, text_sha = zip(*[p.finish() for p in parts], strict=True)
        out = {"doc_id": column(batch, "doc_id"), "n_tokens": list(n), "ids_sha256": list(ids_sha), "decoded_sha256": list(text_sha)}
        if not ids:
            return out
        flat = np.concatenate([x for p in parts for x in p.ids])
        return out | {"ids": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(flat, pa.int32()))}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scan(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids, kernel)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of decoded text."""
    return digested(docs, path, ids=False)


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_tokens and the SHA-256 of the text decoded from the ids."""
    return digested(docs, path).select("doc_id", "ids", "n_tokens", "decoded_sha256")


def op2_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_vocabulary())
