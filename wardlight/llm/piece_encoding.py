"""SentencePiece encoding and decoding in vectorised merge rounds.

A model of the byte-pair kind joins, again and again, the neighbours whose join is the piece
of the best rank, the leftmost first. No piece goes on over the boundary between two
characters that no piece holds next to each other, so these boundaries cut a text into
words that do not influence each other; in particular, white space starts a word wherever
the vocabulary has it at the front of pieces only. The distinct words of a block of texts are
encoded together, as one flat array of symbols:

1. every neighbouring pair of a word gets its rank, and every word its best rank;
2. all places of a word that have it are joined at once, leftmost first where they overlap;
3. the array is compacted, words without a pair leave, and only the pairs beside new
   symbols are ranked again, until no pair remains.

Joining one at a time gives the same result as long as no join brings up a pair of the same or
a better rank. Where one does, which a look at the pairs beside the new symbol tells, the word's
later places wait for the next round.

Characters outside the vocabulary are written as bytes. Null texts are empty and empty texts
have no ids. Very long texts are encoded whole: a round costs the symbols of the words still
open. Repeated rows are encoded alike; columns that are not named here are not looked at.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructType

from wardlight.llm.common import text_blocks

#: How the library writes a space inside pieces.
SPACE = "▁"
#: How it decodes an unknown piece.
UNKNOWN = " ⁇ "
#: Words whose ids a worker remembers between blocks, about.
_KNOWN_WORDS = 1 << 18
_NONE = np.int64(1 << 40)
_BITS = 21


def model_path() -> str:
    """The byte-pair model that the environment provides."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(message):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
        else:
            size, at = {1: (8, at), 5: (4, at)}.get(tag & 7) or number(at)
            value, at = message[at : at + size], at + size
        yield tag >> 3, value


def _require_supported(proto: bytes) -> None:
    """Refuses models that normalise texts or cut them by another rule than this module's."""
    fields = dict(field for field in _fields(proto) if field[0] in (2, 3))
    trainer, normaliser = dict(_fields(fields[2])), dict(_fields(fields[3]))
    # Numbers and defaults of the fields in the public model format.
    wanted = {
        "byte pairs": trainer.get(3, 1) == 2,
        "byte fallback": trainer.get(35, 0) == 1,
        "no white space as suffix": trainer.get(24, 0) == 0,
        "no character map": not normaliser.get(2),
        "a space before the text": normaliser.get(3, 1) == 1,
        "kept white space": normaliser.get(4, 1) == 0,
        "escaped white space": normaliser.get(5, 1) == 1,
    }
    missing = [name for name, given in wanted.items() if not given]
    if missing:
        raise ValueError(f"the model needs: {', '.join(missing)}")


class KnownWords:
    """Words encoded so far and their ids; begins anew when it holds much."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.ids = np.empty(0, np.int32)
        self.sizes = np.empty(0, np.int64)

    def full(self) -> bool:
        return len(self.numbers) > _KNOWN_WORDS or len(self.ids) > 4 * _KNOWN_WORDS


@dataclass
class Encoder:
    """The vocabulary of a model as arrays.

    A symbol is a piece's id or, for a character that is no piece, `size` plus its code point.
    """

    size: int
    of_character: np.ndarray  # symbol by code point
    keys: np.ndarray  # sorted pairs of symbols whose join is a piece
    ranks: np.ndarray  # of their joins, 0 is best
    joins: np.ndarray  # ids of their joins
    risky: np.ndarray  # by id: the piece is part of a join of the same or a better rank
    joinable: np.ndarray  # sorted pairs of characters that some piece holds next to each other
    words: re.Pattern
    byte_ids: np.ndarray
    written: list[bytes]  # what an id decodes to
    silent: np.ndarray  # by id: decodes to nothing
    spaced: np.ndarray  # by id: starts with a space
    known: KnownWords

    @classmethod
    def load(cls, path: str) -> Encoder:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        _require_supported(model.serialized_model_proto())
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in range(size)]
        if any(model.is_unused(i) for i in range(size)):
            raise ValueError("the model has unused pieces")
        ids = {name: i for i, name in enumerate(names) if not special[i]}
        of_character = np.arange(size, size + 0x110000, dtype=np.int64)
        for name, i in ids.items():
            if len(name) == 1:
                of_character[ord(name)] = i

        def symbol(part: str) -> int | None:
            return int(of_character[ord(part)]) if len(part) == 1 else ids.get(part)

        scores = np.array([model.get_score(i) for i in range(size)])
        # Equal scores share a rank, so that the leftmost of their pairs comes first.
        rank = np.unique(-scores, return_inverse=True)[1]
        pairs = [
            (left << _BITS | right, int(rank[i]), i, left, right)
            for name, i in ids.items()
            for at in range(1, len(name))
            if (left := symbol(name[:at])) is not None and (right := symbol(name[at:])) is not None
        ]
        pairs.sort()
        risky = np.zeros(size, bool)
        for _, own, _, left, right in pairs:
            for part in (left, right):
                # Single characters are no joins; nothing comes up by making one.
                if part < size and len(names[part]) > 1 and own <= rank[part]:
                    risky[part] = True
        joinable = {ord(a) << _BITS | ord(b) for name in ids for a, b in zip(name, name[1:])}
        space_leads = not any(a != SPACE and b == SPACE for name in ids for a, b in zip(name, name[1:]))
        words = f"{SPACE}*+[^{SPACE}]++|{SPACE}++" if space_leads else "(?s:.++)"
        written = [name.replace(SPACE, " ").encode() for name in names]
        for i in range(size):
            if model.is_byte(i):
                written[i] = bytes([int(names[i][1:-1], 16)])
            elif model.is_unknown(i):
                written[i] = UNKNOWN.encode()
            elif model.is_control(i):
                written[i] = b""
        byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        columns = [np.array([pair[k] for pair in pairs], np.int64) for k in range(3)]
        return cls(
            size, of_character, *columns, risky,
            np.array(sorted(joinable), np.int64), re.compile(words), byte_ids, written,
            np.array([model.is_control(i) for i in range(size)]),
            np.array([not special[i] and names[i].startswith(SPACE) for i in range(size)]),
            KnownWords(),
        )

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and join of pairs of symbols; `_NONE` where they do not join."""
        keys = left << _BITS | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return np.where(known, self.ranks[at], _NONE), self.joins[at]

    def _segments(self, points: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """The segment each character belongs to; `fresh` marks the first ones of words."""
        keys = points[:-1].astype(np.int64) << _BITS | points[1:]
        at = np.minimum(np.searchsorted(self.joinable, keys), len(self.joinable) - 1)
        fresh = fresh.copy()
        fresh[1:] |= self.joinable[at] != keys
        return np.cumsum(fresh) - 1

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each has."""
        lengths = np.array([len(word) for word in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        fresh = np.zeros(len(points), bool)
        fresh[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        place = np.arange(len(points))
        symbols, owner = self._merged(self.of_character[points], self._segments(points, fresh), place)
        # `owner` is the place of a symbol's first character, by which words are found again.
        order = np.argsort(owner, kind="stable")
        symbols, owner = symbols[order], owner[order]
        word = np.repeat(np.arange(len(words)), lengths)[owner]
        ids, of = self._with_bytes(symbols, word)
        return ids.astype(np.int32), np.bincount(of, minlength=len(words))

    def _with_bytes(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their words; characters outside the vocabulary become their bytes."""
        strange = symbols >= self.size
        if not strange.any():
            return symbols, word
        kinds, which = np.unique(symbols[strange] - self.size, return_inverse=True)
        spelled = [chr(k).encode("utf-8", "replace") for k in kinds.tolist()]
        sizes = np.ones(len(symbols), np.int64)
        sizes[strange] = np.array([len(s) for s in spelled])[which]
        ids = np.repeat(symbols, sizes)
        firsts = (np.cumsum(sizes) - sizes)[strange]
        table = np.zeros((len(spelled), 4), np.int64)
        for i, s in enumerate(spelled):
            table[i, : len(s)] = self.byte_ids[list(s)]
        for k in range(4):
            has = sizes[strange] > k
            ids[firsts[has] + k] = table[which[has], k]
        return ids, np.repeat(word, sizes)

    def _merged(self, sym: np.ndarray, own: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left when no pair of a segment joins, and their first characters' places."""
        done = []
        rank, join = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
        inside = np.flatnonzero(own[:-1] == own[1:])
        rank[inside], join[inside] = self._ranked(sym[inside], sym[inside + 1])
        while len(sym):
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(sym)])
            still = best < _NONE
            if not still.all():
                stay = np.repeat(still, sizes)
                done.append((sym[~stay], place[~stay]))
                sym, own, place, rank, join = (x[stay] for x in (sym, own, place, rank, join))
                best, sizes = best[still], sizes[still]
                if not len(sym):
                    break
            best_here = np.repeat(best, sizes)
            at = self._first_joins(sym, own, rank, join, best_here)
            sym[at] = join[at]
            left = np.ones(len(sym), bool)
            left[at + 1] = False
            changed = np.zeros(len(sym), bool)
            changed[at] = True
            changed[at[at > 0] - 1] = True
            # A pair's left symbol may itself have been joined into the one before it.
            behind = at[at > 1] - 2
            changed[behind] = True
            sym, own, place, rank, join, changed = (x[left] for x in (sym, own, place, rank, join, changed))
            again = np.flatnonzero(changed)
            rank[again] = _NONE
            again = again[again + 1 < len(sym)]
            again = again[own[again] == own[again + 1]]
            rank[again], join[again] = self._ranked(sym[again], sym[again + 1])
        symbols, places = zip(*done) if done else ((sym,), (place,))
        return np.concatenate(symbols), np.concatenate(places)

    def _first_joins(self, sym, own, rank, join, best_here) -> np.ndarray:
        """Where pairs are joined in this round: the left places, in order."""
        at = np.flatnonzero(rank == best_here)
        # Of places in a row, which share symbols, every other one, from the left.
        starts = np.r_[True, np.diff(at) != 1]
        run = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        check = np.flatnonzero(self.risky[join[at]])
        if not len(check):
            return at
        spot = at[check]
        made = join[spot]
        before = np.maximum(spot - 1, 0)
        # The neighbour on the left has been joined already if the place before it was taken.
        joined = np.zeros(len(check), bool)
        earlier = check > 0
        joined[earlier] = at[check[earlier] - 1] == spot[earlier] - 2
        left = np.where(joined, join[np.maximum(spot - 2, 0)], sym[before])
        after = np.minimum(spot + 2, len(sym) - 1)
        ahead = (spot > 0) & (own[before] == own[spot]) & (self._ranked(left, made)[0] <= best_here[spot])
        follows = (spot + 2 < len(sym)) & (own[after] == own[spot]) & (self._ranked(made, sym[after])[0] <= best_here[spot])
        halting = np.flatnonzero(ahead | follows)
        if not len(halting):
            return at
        stops, which = np.unique(own[spot[halting]], return_index=True)
        last = spot[halting][which]
        found = np.minimum(np.searchsorted(stops, own[at]), len(stops) - 1)
        return at[(stops[found] != own[at]) | (at <= last[found])]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        if self.known.full():
            self.known = KnownWords()
        known = self.known
        numbers, before = known.numbers, len(known.numbers)
        listed, counts = [], []
        for text in texts:
            own = self.words.findall(SPACE + text.replace(" ", SPACE)) if text else []
            listed += [numbers.setdefault(word, len(numbers)) for word in own]
            counts.append(len(own))
        ids, sizes = self.encode_words(list(islice(numbers, before, None)))
        ids = known.ids = np.concatenate([known.ids, ids])
        sizes = known.sizes = np.concatenate([known.sizes, sizes])
        which = np.array(listed, np.int64)
        own = sizes[which]
        firsts = (np.cumsum(sizes) - sizes)[which]
        spots = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(firsts, own)
        text_of = np.repeat(np.arange(len(texts)), counts)
        return ids[spots], np.bincount(text_of, own, len(texts)).astype(np.int64)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, bytes put together, the space before the text left out."""
        try:
            text = b"".join([self.written[i] for i in ids]).decode("utf-8", _each_byte())
        except IndexError:
            raise ValueError("an id is outside the vocabulary") from None
        lead = next((i for i in ids if not self.silent[i]), None)
        return text[1:] if lead is not None and self.spaced[lead] else text


def _each_byte() -> str:
    """The name of an error handler that puts a replacement character for each undecodable byte."""
    codecs.register_error("wardlight-each-byte", lambda e: ("�" * (e.end - e.start), e.end))
    return "wardlight-each-byte"


def _encoder(path: str) -> Encoder:
    """The worker process's encoder; it hangs on an imported module, as task functions come anew."""
    import sentencepiece

    held = vars(sentencepiece).setdefault("_remembered_encoders", {})
    if path not in held:
        held[path] = Encoder.load(path)
    return held[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row (doc_id, text), as the library encodes the text with the model at `path`."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for start, end in text_blocks(texts):
                ids, sizes = encoder.encode(texts[start:end])
                offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, end - start),
                        pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                    ],
                    names=["doc_id", "ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.selectExpr("doc_id", "cast(text AS string) AS text").mapInArrow(
        run, f"doc_id {kind}, ids array<int>"
    )


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows (ids, ...) with a column `decoded`, the text the library decodes the ids to."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for row in range(0, len(batch), 512):
                part = batch.slice(row, 512)
                texts = [encoder.decode(ids or []) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"]
                )

    schema = StructType([*encoded.schema.fields]).add("decoded", StringType())
    return encoded.mapInArrow(run, schema)
