"""SentencePiece merge-type encoding and decoding, exact, by backtracking over longest matches.

A sequence of pieces is the encoding of its text exactly if each two neighbours, merged anew by themselves, come apart
the same way. So the longest piece at a place is tried first (Aho-Corasick finds the pieces in one pass); it is kept if
it agrees with its left neighbour, else the next shorter one is tried; a place from which nothing fits is marked in a
bitfield and never entered again, and the walk goes one piece back. Every place fails at most once.

Spaces become U+2581 and one is put in front. No piece runs over the place where a word ends and the next U+2581
begins, so words are encoded by themselves, and their results kept in a cache of fixed size in each worker. Characters
that are no piece become byte pieces. The model file is read for its pieces and scores only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Cached words of a worker in each of two generations, the longest word kept (characters), and cached pairs of pieces.
CACHED_WORDS, CACHED_LENGTH, CACHED_PAIRS = 150_000, 48, 500_000


class PieceCodec:
    """Encoder and decoder for the vocabulary of one model file (merge type with byte fallback, no other normalisation)."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: model.get_score(i) for i in plain}
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.silent = {i for i in range(size) if model.is_control(i)}
        self.unknown = model.unk_id()
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces with a space inside are not supported")
        # Only pieces that merging itself can produce ever occur in an encoding.
        self.made = {p: i for p, i in self.ids.items() if self._merge(p) == [p]}
        self.shorter: dict[str, str | None] = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.made), None) for p in self.made}
        self.finder = ahocorasick.Automaton()
        for p in self.made:
            self.finder.add_word(p, p)
        self.finder.make_automaton()
        # A line feed that no piece holds ends a word too.
        line = "" if any("\n" in p for p in self.ids) else "\n"
        self.words = re.compile(f"{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+" + (r"|\n+" if line else ""))
        # Nor does a piece go on from a word character to another kind, but for a few: texts without those split finer.
        crossing = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1) if re.match(r"\w\W", p[k : k + 2])}
        self.crossing = re.compile("|".join(map(re.escape, sorted(crossing))) or r"(?!)")
        mark = rf"[^\w{SPACE}{line}]"
        self.fine = re.compile(rf"{SPACE}*{mark}*\w+|{SPACE}+{mark}*|{mark}+" + (r"|\n+" if line else ""))
        self._pairs: dict[tuple[str, str], bool] = {}
        self._cache: dict[str, tuple[str, int, str]] = {}
        self._older: dict[str, tuple[str, int, str]] = {}

    def _merge(self, text: str) -> list[str]:
        """Merges by themselves: the best scored pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def agree(self, left: str, right: str) -> bool:
        """Whether the two pieces come apart the same way when merged anew."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= CACHED_PAIRS:
                self._pairs.clear()
            known = self._pairs[left, right] = self._merge(left + right) == [left, right]
        return known

    def _backtrack(self, text: str) -> list[str]:
        """Pieces of a text all of whose characters are pieces."""
        longest: list[str | None] = [None] * len(text)
        for end, piece in self.finder.iter(text):  # ends rise, so the last one at a start is the longest
            longest[end - len(piece) + 1] = piece
        failed = bytearray(len(text) + 1)
        out: list[str] = []
        at = 0
        piece = longest[0]
        while at < len(text):
            while piece is not None and (failed[at + len(piece)] or out and not self.agree(out[-1], piece)):
                piece = self.shorter[piece]
            if piece is not None:
                out.append(piece)
                at += len(piece)
                piece = longest[at] if at < len(text) else None
            else:
                failed[at] = 1
                last = out.pop()
                at -= len(last)
                piece = self.shorter[last]
        return out

    def _word(self, word: str) -> list[int]:
        ids: list[int] = []
        at = 0
        while at < len(word):
            stop = at
            while stop < len(word) and word[stop] in self.made:
                stop += 1
            if stop > at:
                ids += [self.made[p] for p in self._backtrack(word[at:stop])]
            if stop < len(word):
                ids += self._bytes(word[stop])
                stop += 1
            at = stop
        return ids

    def _bytes(self, char: str) -> list[int]:
        raw = char.encode("utf-8")
        return [self.byte_id[b] for b in raw] if all(b in self.byte_id for b in raw) else [self.unknown]

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        spaced = SPACE + text.replace(" ", SPACE)
        return (self.words if self.crossing.search(spaced) else self.fine).findall(spaced)

    def encode(self, text: str) -> list[int]:
        return [i for word in self.split(text) for i in self._word(word)]

    def _plain(self, ids: list[int]) -> str:
        """Text of ids before the space in front is taken off; broken byte sequences become U+FFFD."""
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_replaced(bytes(raw)))
                raw.clear()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.silent:
                out.append(self.pieces[i].replace(SPACE, " "))
        if raw:
            out.append(_replaced(bytes(raw)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self._plain(ids)
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first is not None and self.pieces[first].startswith(SPACE) else text

    def cached(self, word: str) -> tuple[str, int, str]:
        """(decimal ids joined by commas, how many, decoded text with its leading space) of one word."""
        hit = self._cache.get(word)
        if hit is None:
            hit = self._older.get(word)
            if hit is None:
                ids = self._word(word)
                hit = ",".join(map(str, ids)), len(ids), self._plain(ids)
            if len(word) <= CACHED_LENGTH:
                if len(self._cache) >= CACHED_WORDS:  # what the last generation did not meet goes
                    self._older, self._cache = self._cache, {}
                self._cache[word] = hit
        return hit


def _replaced(raw: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that is no part of a character."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_CODECS: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """The codec of a file, made once in each worker."""
    if model_file not in _CODECS:
        _CODECS[model_file] = PieceCodec(model_file)
    return _CODECS[model_file]


def encode(docs: DataFrame, model_file: str, text: str = "text", to: str = "ids") -> DataFrame:
    """All columns plus the ids of each whole text; a null or empty text has none."""
    @F.pandas_udf("array<int>")
    def ids(texts):
        c = codec(model_file)
        return texts.map(lambda t: c.encode(t or ""))

    return docs.withColumn(to, ids(F.coalesce(F.col(text), F.lit(""))))


def decode(df: DataFrame, model_file: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """All columns plus the decoded text; null ids give an empty text, ids outside the vocabulary raise."""
    @F.pandas_udf("string")
    def texts(series):
        c = codec(model_file)
        return series.map(lambda x: c.decode([] if x is None else list(x)))

    return df.withColumn(to, texts(ids))


def digests(docs: DataFrame, model_file: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row: encoding and decoding of each whole text in one pass.

    A null text is an empty one, with no tokens and the digests of the empty string. Repeated rows and null ids
    pass through as they are; other columns are ignored; an empty table gives an empty result.
    """
    def rows(batches: Iterator[pa.RecordBatch]):
        c = codec(model_file)
        make = c.cached
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for t in batch.column(1):
                ids, back, n = hashlib.sha256(), hashlib.sha256(), 0
                words = c.split(t.as_py() or "")
                for k in range(0, len(words), 50_000):  # a long text goes through in parts
                    get = c._cache.get
                    hits = [get(w) or make(w) for w in words[k : k + 50_000]]
                    n += sum([h[1] for h in hits])
                    ids.update(((b"," if k else b"") + ",".join([h[0] for h in hits]).encode()))
                    plain = "".join([h[2] for h in hits])
                    back.update((plain if k else plain[1:]).encode())
                counts.append(n)
                encoded.append(ids.hexdigest())
                decoded.append(back.hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(encoded, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())})

    rows_in = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows_in.mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
