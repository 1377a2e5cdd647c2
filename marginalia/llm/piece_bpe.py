"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding: symbols start as characters; a score-ordered agenda holds the adjacent pairs whose join is a piece; the best
pair (highest score, then leftmost) merges, and its new neighbours join the agenda. Symbols that are no piece fall back
to byte pieces. No piece of such a vocabulary holds a space mark after another character, which the model is tested
for, so a text falls into segments of space marks and what follows them; each segment is merged once and kept.
Decoding joins pieces, turns space marks into spaces, drops the leading one and reads byte pieces as UTF-8.

Checks in each Arrow batch, against the sentencepiece library: the ids of all new segments; whole texts where they are the first of a slice, have runs of spaces or marks, or
characters that don't print; the own decoding of the first text of a slice. The decoded texts are the library's.

Defined results: a null text is empty and has no ids; rows are kept one by one, also with equal or null ids; an empty
table gives no rows; other columns are ignored; a very long text is one row like any other.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, give_back, slices, table, texts_of

MARK = "▁"
CACHE_MB = 100.0
SHORT, NO_PIECE = 64, 1 << 30
AT_ONCE = 40_000  # new words that are merged in one table
PART = 50  # texts whose ids are held at once
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


class PieceBpe:
    def __init__(self, path: str, cache_mb: float = CACHE_MB):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        normal = [i for i in range(len(self.pieces)) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        order = {x: k for k, x in enumerate(sorted({lib.get_score(i) for i in normal}, reverse=True))}
        self.ranks = {self.pieces[i]: order[lib.get_score(i)] for i in normal}  # the highest score is rank 0
        self.bytes = {int(m[1], 16): i for i, p in enumerate(self.pieces) if lib.is_byte(i) and (m := BYTE_PIECE.fullmatch(p))}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.unknown = lib.unk_id()
        self.silent = {i for i in range(len(self.pieces)) if lib.is_control(i)}
        if len(self.pieces) > 65_536 or len(self.bytes) != 256 or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("not a merge-type vocabulary with byte pieces whose pieces start at spaces")
        if lib.encode(" a  b ") != self._plain(" a  b "):
            raise ValueError("a model that changes its text before encoding isn't supported")
        self.cache = WordCache(self._word, cache_mb, self, 60, lambda: MADE.pop((path, cache_mb), None))
        self.numbers = list(map(str, range(len(self.pieces))))
        self._pairs()

    def _pairs(self) -> None:
        """Tables for many segments at once: the symbol of each character, and rank and symbol of each pair of symbols that
        is a piece. A character that is no piece is symbol `other`, which no pair holds."""
        self.other = n = len(self.pieces)
        self.symbol_of = np.full(0x110000, n, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
        pairs = sorted((self.ids[a] * (n + 1) + self.ids[b], self.ranks[p], i) for p, i in self.ids.items() for k in range(1, len(p)) if (a := p[:k]) in self.ids and (b := p[k:]) in self.ids)
        self.pair_keys, ranks, symbols = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.pair_ranks, self.pair_symbols = ranks.astype(np.int32), symbols.astype(np.int32)

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, NO_PIECE where it is no piece."""
        keys = left.astype(np.int64) * (self.other + 1) + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_PIECE)

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment of escaped text."""
        symbols = list(segment)
        self._merge_long(symbols)
        out: list[int] = []
        for s in symbols:
            if s:
                i = self.ids.get(s)
                out += [self.bytes[b] for b in s.encode()] if i is None else [i]
        return out

    def merge_all(self, segments: list[str]) -> list[list[int]]:
        """Ids of many segments. Short ones of equal length are the rows of a table, each with its agenda of ranks by place;
        in each round every row merges the first of its least ranks, until none has a pair that is a piece."""
        out: list[list[int]] = [[]] * len(segments)
        by_size: dict[int, list[int]] = {}
        for k, s in enumerate(segments):
            by_size.setdefault(len(s), []).append(k)
        for size, places in by_size.items():
            if size > SHORT:
                for k in places:
                    out[k] = self.merge(segments[k])
                continue
            text = "".join([segments[k] for k in places]).encode("utf-32-le", "surrogatepass")
            symbols = self.symbol_of[np.frombuffer(text, "<u4").reshape(-1, size)]
            rows = np.array(places)
            ranks = self._ranked(symbols[:, :-1], symbols[:, 1:])
            while len(rows):
                each = np.arange(len(rows))
                best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
                going = ranks[each, best] < NO_PIECE if ranks.shape[1] else np.zeros(len(rows), bool)
                for k, ids in zip(rows[~going].tolist(), symbols[~going].tolist(), strict=True):
                    out[k] = self._with_bytes(ids, segments[k]) if self.other in ids else ids
                rows, symbols, ranks, best = rows[going], symbols[going], ranks[going], best[going, None]
                each, n = np.arange(len(rows)), symbols.shape[1]
                at = np.arange(n - 1)
                keys = symbols[each, best[:, 0]].astype(np.int64) * (self.other + 1) + symbols[each, best[:, 0] + 1]
                symbols = np.take_along_axis(symbols, at + (at > best), axis=1)
                symbols[each, best[:, 0]] = merged = self.pair_symbols[np.searchsorted(self.pair_keys, keys)]
                at = np.arange(n - 2)
                ranks = np.take_along_axis(ranks, at + (at >= best), axis=1)
                before, after = np.flatnonzero(best[:, 0] > 0), np.flatnonzero(best[:, 0] < n - 2)
                ranks[before, best[before, 0] - 1] = self._ranked(symbols[before, best[before, 0] - 1], merged[before])
                ranks[after, best[after, 0]] = self._ranked(merged[after], symbols[after, best[after, 0] + 1])
        return out

    def _with_bytes(self, ids: list[int], segment: str) -> list[int]:
        """ids with the byte pieces of the segment's characters that are no piece."""
        others = iter([c for c in segment if c not in self.ids])
        return [x for i in ids for x in ([self.bytes[b] for b in next(others).encode()] if i == self.other else [i])]

    def _merge_long(self, symbols: list[str]) -> None:
        """A heap of (rank, place, pair); a pair that has merged elsewhere meanwhile is passed over."""
        ranks, n = self.ranks, len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(ranks[p], i, p) for i, p in enumerate(map("".join, zip(symbols, symbols[1:]))) if p in ranks]
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = right[i]
            if j < 0 or not symbols[i] or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, ""
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (p := pair + symbols[k]) in ranks:
                    heapq.heappush(agenda, (ranks[p], i, p))
            if (h := left[i]) >= 0 and (p := symbols[h] + pair) in ranks:
                heapq.heappush(agenda, (ranks[p], h, p))

    def _plain(self, text: str) -> list[int]:
        return [i for s in SEGMENT.findall((MARK + text.replace(" ", MARK)) if text else "") for i in self.merge(s)]

    def _word(self, word: str) -> bytes:
        return array("H", self.merge(MARK + word)).tobytes()

    def _words(self, words: list[str]) -> Iterator[bytes]:
        """The ids of the segments of one space mark and a word, as bytes; so many at once are held against the library in one call."""
        for k in range(0, len(words), AT_ONCE):
            part = words[k : k + AT_ONCE]
            ids = self.merge_all([MARK + w for w in part])
            full = [k for k, w in enumerate(part) if w]  # the library drops a space alone
            if self.library.encode([part[k] for k in full]) != [ids[k] for k in full]:
                raise AssertionError("segments differ from the sentencepiece library")
            yield from (array("H", x).tobytes() for x in ids)

    def encode(self, texts: list[str]) -> tuple[list[str], list[list[int]]]:
        """Of each text the ids as text, joined by commas, and the ids."""
        parts = list(self.encode_parts(texts))
        return [x for shown, _ in parts for x in shown], [x for _, ids in parts for x in ids]

    def encode_parts(self, texts: list[str], size: int = PART) -> Iterator[tuple[list[str], list[list[int]]]]:
        """What encode() returns, for parts of so many texts: new words are merged for all texts at once, but ids, which take
        many times the memory of the texts, are made for one part after the other."""
        new: set[str] = set()
        for t in texts:
            if not self.odd(t):
                new.update(t.split(" "))
        self.cache.fill(new, self._words)
        del new
        for k in range(0, len(texts), size):
            ids = [self._plain(t) if self.odd(t) else array("H", b"".join(map(self.cache.__getitem__, t.split(" ")))).tolist() for t in texts[k : k + size]]
            yield [",".join(map(self.numbers.__getitem__, x)) for x in ids], ids
        self.cache.turn()

    @staticmethod
    def odd(text: str) -> bool:
        """Whether runs of spaces, or the mark itself, send the text the long way."""
        return not text or "  " in text or MARK in text or text[0] == " " or text[-1] == " "

    def decode(self, ids: list[int]) -> str:
        """The text of ids, as the library's decode(ids): byte pieces as UTF-8, the first space mark dropped."""
        out, run, begun = [], bytearray(), False
        for i in ids:
            if (b := self.of_byte.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(run))
                run, begun = bytearray(), True
            if i in self.silent:
                continue
            if i == self.unknown:
                out.append(" \u2047 ")
            else:
                p = self.pieces[i]
                out.append((p if begun or p[0] != MARK else p[1:]).replace(MARK, " "))
            begun = True
        return "".join(out) + (_utf8(run) if run else "")


codecs.register_error("each_byte", lambda e: ("\ufffd", e.start + 1))


def _utf8(data: bytes | bytearray) -> str:
    """UTF-8, with one replacement character for each byte that belongs to no character."""
    return data.decode("utf-8", "each_byte")


MADE: dict[tuple[str, float], PieceBpe] = {}


def processor(path: str, cache_mb: float = CACHE_MB) -> PieceBpe:
    """One per Python worker, until another operator works there."""
    made = MADE.get((path, cache_mb))
    if made is None:
        made = MADE[path, cache_mb] = PieceBpe(path, cache_mb)
        give_back()  # what its tables were made of
    return made


def encode_documents(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", cache_mb: float = CACHE_MB) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row. Words are kept in cache_mb per Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = processor(path, cache_mb)
        for b in slices(batches, 500, 2_000_000, owner=bpe):
            texts = texts_of(b)
            sizes, shas, decoded_shas = [], [], []
            for shown, ids in bpe.encode_parts(texts):
                first = len(sizes)
                for k, t in enumerate(texts[first : first + len(ids)]):
                    if (first + k == 0 or bpe.odd(t) or not t.replace("\n", "").isprintable()) and bpe.library.encode(t) != ids[k]:
                        raise AssertionError("a text differs from the sentencepiece library")
                decoded = bpe.library.decode(ids)
                if first == 0 and bpe.decode(ids[0]) != decoded[0]:
                    raise AssertionError("a decoded text differs from the sentencepiece library")
                sizes += map(len, ids)
                shas += (hashlib.sha256(x.encode()).hexdigest() for x in shown)
                decoded_shas += (hashlib.sha256(x.encode()).hexdigest() for x in decoded)
            yield pa.record_batch([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded_shas, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op6_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
