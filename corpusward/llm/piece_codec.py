"""SentencePiece encoding and decoding with a merge-type prefix table.

Greedy pair merging has one encoding per text, and the encoding of a prefix that
ends at a token border is the front part of it.  So every prefix has one last
token, and that token alone is stored: an automaton lists the pieces that end at
a position, and the piece is taken whose predecessor - the stored last token of
what is before it - stays apart from it when the two are merged on their own.
The ids are then read backwards.

No piece of a merge-type model has the space mark behind another character, so a
text falls into words that never merge; words are looked up in a bounded cache.
The vocabulary is a file of the sentencepiece library; its path is a parameter
and must exist on every executor.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MARK = '▁'
CACHED_WORDS = 350_000
CACHED_PAIRS = 500_000


class _Words(dict):
    """Word -> its ids as bytes; emptied when full."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = np.array(self.encode(word), '<i4').tobytes()
        return found


class PieceCodec:
    """Vocabulary, automaton and pair tests of one model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        self.unknown = model.unk_id()
        control = {i for i in range(size) if model.is_control(i)}
        plain = [i for i in range(size) if not (model.is_byte(i) or i in control or i == self.unknown)]
        self.id_of = {pieces[i]: i for i in plain}
        self.piece = pieces
        self.score = {i: model.get_score(i) for i in plain}
        self.byte_id = {int(pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        if len(self.byte_id) != 256:
            raise ValueError(f'{path}: a model with bytes for unknown characters is needed')
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(pieces[i], (len(pieces[i]), i))
        self.automaton.make_automaton()
        # what a word may be: marks first, and nothing that is in no piece
        letters = {c for i in plain for c in pieces[i]}
        breaks = ''.join(c for c in '\n\t\r' if c not in letters)
        if any(MARK in pieces[i].lstrip(MARK) for i in plain):
            self.words = re.compile(r'[\s\S]+')
        else:
            self.words = re.compile(f'{MARK}*[^{MARK}{breaks}]+|{MARK}+' + (f'|[{breaks}]+' if breaks else ''))
        self.pairs: dict[int, bool] = {}
        self.cache = _Words(self.encode_word, CACHED_WORDS)
        # decoding: what an id stands for
        self.bytes_of = [b'' if i in control else pieces[i].replace(MARK, ' ').encode() for i in range(size)]
        for value, i in self.byte_id.items():
            self.bytes_of[i] = bytes([value])
        self.bytes_of[self.unknown] = ' ⁇ '.encode()
        self.is_byte, self.control = set(self.byte_id.values()), control

    def merged(self, text: str) -> list[int]:
        """Pair merging as such, for the few characters of one or two pieces."""
        symbols: list[str | None] = list(text)
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(symbols)
            if i >= 0 and j < len(symbols) and (k := self.id_of.get(whole := symbols[i] + symbols[j])) is not None:
                heapq.heappush(queue, (-self.score[k], i, whole))

        for i in range(len(symbols) - 1):
            offer(i)
        while queue:
            _, i, whole = heapq.heappop(queue)
            if symbols[i] is None or (j := after[i]) >= len(symbols) or symbols[i] + symbols[j] != whole:
                continue
            symbols[i], symbols[j], after[i] = whole, None, after[j]
            if after[j] < len(symbols):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [self.id_of.get(s, self.unknown) for s in symbols if s is not None]

    def apart(self, left: int, right: int) -> bool:
        """Whether the two stay what they are when merged on their own; left is -1 at a border."""
        if left < 0:
            return self.merged(self.piece[right]) == [right]
        return self.merged(self.piece[left] + self.piece[right]) == [left, right]

    def encode_word(self, word: str) -> list[int]:
        last, pairs, done = [-1] * (len(word) + 1), self.pairs, 0
        if len(pairs) > CACHED_PAIRS:
            pairs.clear()
        for end, (length, token) in self.automaton.iter(word):
            end += 1
            if done == end:  # a position has one last token
                continue
            key = (last[end - length] + 1 << 32) | token
            ok = pairs.get(key)
            if ok is None:
                ok = pairs[key] = self.apart(last[end - length], token)
            if ok:
                last[end], done = token, end
        ids: list[int] = []
        end = len(word)
        while end:
            token = last[end]
            if token < 0:  # in no piece: the bytes of the character
                ids.extend(self.byte_id[b] for b in reversed(word[end - 1].encode()))
                end -= 1
            else:
                ids.append(token)
                end -= len(self.piece[token])
        return ids[::-1]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, '<i4')
        marked = MARK + text.replace(' ', MARK)
        return np.frombuffer(b''.join(map(self.cache.__getitem__, self.words.findall(marked))), '<i4')

    def decode(self, ids: list[int]) -> str:
        raw = b''.join(map(self.bytes_of.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._with_bad_bytes(ids)
        first = next((i for i in ids if i not in self.control), None)
        marked = first is not None and first not in self.is_byte and first != self.unknown and self.piece[first][0] == MARK
        return text[1:] if marked else text

    def _with_bad_bytes(self, ids: list[int]) -> str:
        """Runs of byte ids are text where they are UTF-8, else one replacement character per byte."""
        out, run = [], bytearray()

        def flush() -> None:
            rest = bytes(run)
            while rest:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(rest[:n].decode())
                        rest = rest[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append('�')
                    rest = rest[1:]
            run.clear()

        for i in ids:
            if i in self.is_byte:
                run += self.bytes_of[i]
            else:
                flush()
                out.append(self.bytes_of[i].decode())
        flush()
        return ''.join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encoded(text: Column, path: str) -> Column:
    """Ids of a text, array<int>; null is the empty text."""
    def ids(texts: pa.Array) -> pa.Array:
        encode = codec(path).encode
        found = [encode(t.as_py() or '') for t in texts]
        offsets = np.zeros(len(found) + 1, np.int32)
        np.cumsum([len(f) for f in found], out=offsets[1:])
        values = np.concatenate(found) if found else np.empty(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32, copy=False)))
    # marked so, the function is evaluated once whatever reads its result
    return F.arrow_udf(ids, 'array<int>').asNondeterministic()(text)


def decoded(ids: Column, path: str) -> Column:
    """Text of ids; null ids are no ids."""
    @F.arrow_udf('string')
    def text(lists: pa.Array) -> pa.Array:
        decode = codec(path).decode
        flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
        return pa.array([decode(flat[a:b].tolist()) for a, b in zip(np.r_[0, ends], ends)], pa.string())
    return text(ids)


def encode_texts(docs: DataFrame, path: str, text: str = 'text', ids: str = 'ids') -> DataFrame:
    """Adds the column ``ids``, replacing one of that name.  Null and empty texts have no ids."""
    return docs.withColumn(ids, encoded(F.col(text), path))


def decode_ids(docs: DataFrame, path: str, ids: str = 'ids', text: str = 'decoded') -> DataFrame:
    """Adds the column ``decoded``, replacing one of that name."""
    return docs.withColumn(text, decoded(F.col(ids), path))
