"""Language-model scores by a hidden Markov model over word classes.

Every frequent word is a class of its own; the others share classes by their
ending.  A word's chance is that of its class in the latent state (Baum-Welch)
times its chance inside the class (counts of the whole training part).  Expected
counts of a pass are summed per task and then by Spark; passes read all training
texts.  Scoring is the scaled forward recursion over whole texts.

Counts of words meet texts without a row per word and document: tasks cut their
input into chunks of some megabytes, a chunk's different words are joined with
the counts, and the chunk's texts follow its dictionary in one sorted stream.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fold, written

TOP = 2000  # words that are classes of their own; class 0 is the end of a text
ENDINGS = 2000
CLASSES = 1 + TOP + ENDINGS
STATES = 8
CHUNK_BYTES = 8_000_000
SEGMENT = 256  # training cuts texts here; scoring never cuts
SCALED = 8  # tokens from one scaling to the next in scoring
SMOOTH = 0.1


def tokens(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at the six ASCII white-space characters."""
    return (text or '').encode().lower().split()


class Classes(dict):
    """Word -> class; the rare ones are worked out, and kept while there is room."""

    def __init__(self, top: list[bytes]):
        super().__init__((w, 1 + i) for i, w in enumerate(top))
        self.most = len(self) + 300_000

    def __missing__(self, word: bytes) -> int:
        found = 1 + TOP + zlib.crc32(word[-3:]) % ENDINGS
        if len(self) < self.most:
            self[word] = found
        return found


@dataclass
class Model:
    start: np.ndarray  # chance of a state at the first token
    move: np.ndarray  # state x state
    emit: np.ndarray  # class x state


def first_guess(shares: np.ndarray, seed: int = 9) -> Model:
    rng = np.random.default_rng(seed)
    emit = (shares[:, None] + 1e-9) * np.exp(rng.normal(0, 1, (len(shares), STATES)))
    move = np.full((STATES, STATES), 0.2 / STATES) + 0.8 * np.eye(STATES)
    return Model(np.full(STATES, 1 / STATES), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def lanes(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences side by side, longest first: (symbols by step then lane, lanes per step, order)."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind='stable')
    active = np.searchsorted(-lengths[order], -np.arange(lengths.max()), 'left') if len(sequences) else np.empty(0, int)
    first = np.r_[0, np.cumsum(active)]
    symbols = np.empty(lengths.sum(), np.int32)
    for lane, i in enumerate(order):
        symbols[first[:lengths[i]] + lane] = sequences[i]
    return symbols, active, order


def log_chances(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each (non-empty) sequence: forward recursion, scaled every few tokens.

    A token's factor is over 1e-30 whatever the number of texts, so a few of them are far from the smallest double.
    """
    symbols, active, order = lanes(sequences)
    total = np.zeros(len(sequences))
    alpha, at = None, 0
    for first in range(0, len(active), SCALED):
        steps = active[first:first + SCALED].tolist()
        seen = model.emit[symbols[at:at + sum(steps)]]
        at, place = at + len(seen), 0
        for n in steps:
            if alpha is None:
                alpha = model.start * seen[:n]
            else:
                if n < len(alpha):  # the texts that have ended
                    total[n:len(alpha)] += np.log(alpha[n:].sum(1))
                alpha = alpha[:n] @ model.move
                alpha *= seen[place:place + n]
            place += n
        scale = alpha.sum(1)
        total[:len(alpha)] += np.log(scale)
        alpha /= scale[:, None]
    found = np.empty(len(sequences))
    found[order] = total
    return found


def expected(model: Model, sequences: list[np.ndarray], starts: np.ndarray, counts: dict[str, np.ndarray]) -> None:
    """Adds the expected counts of the sequences; only those in ``starts`` say where texts begin."""
    symbols, active, order = lanes(sequences)
    begin = np.r_[0, np.cumsum(active)].tolist()
    seen = model.emit[symbols]  # from the forward pass on by the token's scale, which the backward pass needs as well
    alpha, one = np.empty_like(seen), np.ones(STATES)
    stationary = np.linalg.matrix_power(model.move, 64).mean(0)
    first = np.where(starts[order][:, None], model.start, stationary)
    for step, (a, b) in enumerate(zip(begin, begin[1:])):
        here, now = seen[a:b], alpha[a:b]
        before = first if step == 0 else np.matmul(alpha[begin[step - 1]:begin[step - 1] + b - a], model.move, out=now)
        np.multiply(before, here, out=now)
        scale = (1 / (now @ one))[:, None]
        now *= scale
        here *= scale
    beta, back, moved = np.ones_like(seen), np.ascontiguousarray(model.move.T), np.zeros((STATES, STATES))
    for step in range(len(active) - 2, -1, -1):
        a, b, end = begin[step:step + 3]
        after = seen[b:end]
        after *= beta[b:end]
        np.matmul(after, back, out=beta[a:a + end - b])
        moved += alpha[a:a + end - b].T @ after
    counts['move'] += model.move * moved
    gamma = alpha * beta
    for k in range(STATES):
        counts['emit'][:, k] += np.bincount(symbols, gamma[:, k], minlength=CLASSES)
    counts['start'] += gamma[:active[0]][starts[order]].sum(0) if len(active) else 0


def _batches(batches, limit: int):
    """Rows of the record batches in groups of at most about ``limit`` characters."""
    rows, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            rows.append(row)
            size += len(row[-1] or '')
            if size >= limit:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def chunks(batches):
    """(chunk id, rows); the id comes from the rows, so that it is the same wherever they are read again.

    Chunks of equal rows share an id, which does no harm: they have the same words.
    """
    for rows in _batches(batches, CHUNK_BYTES):
        mark = hashlib.blake2b(digest_size=8)
        for row in rows:
            mark.update(repr(row[:-1]).encode())
            mark.update((row[-1] or '').encode())
        yield int.from_bytes(mark.digest(), 'little', signed=True), rows


def word_counts(docs: DataFrame) -> DataFrame:
    """(chunk, word, n): different words of each chunk, n of them in training texts; word '' is the end of a text."""
    def run(batches):
        for chunk, rows in chunks(batches):
            train, rest, ends = Counter(), set(), 0
            for learn, _, text in rows:
                if learn:
                    train.update(tokens(text))
                    ends += 1
                else:
                    rest.update(tokens(text))
            words = [*train, *(rest - train.keys()), b'']
            n = [*train.values(), *([0] * (len(words) - len(train) - 1)), ends]
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(words), pa.int64()), pa.array(words, pa.binary()),
                                              pa.array(n, pa.int64())], ['chunk', 'word', 'n'])
    return docs.select('_learn', '_key', '_text').mapInArrow(run, 'chunk long, word binary, n long')


def classes_of(docs: DataFrame, top: list[bytes]) -> DataFrame:
    """(symbols): classes of each training text as little-endian 16-bit numbers, the end included."""
    def run(batches):
        classes = Classes(top)
        for batch in batches:
            found = []
            for text in batch.columns[0]:
                words = tokens(text.as_py())
                found.append(np.append(np.fromiter(map(classes.__getitem__, words), '<u2', len(words)), np.uint16(0)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ['symbols'])
    return docs.where('_learn').select('_text').mapInArrow(run, 'symbols binary')


def train(docs: DataFrame, top: list[bytes], shares: np.ndarray, passes: int) -> Model:
    """Baum-Welch; a pass sums (place, value) rows per task, so what is gathered is a row per place.

    Words become classes once; the passes read those.
    """
    model = first_guess(shares)
    coded = written(classes_of(docs, top), 'symbols')
    sizes = {'start': STATES, 'move': STATES * STATES, 'emit': CLASSES * STATES}
    for _ in range(passes):
        def run(batches, model=model):
            counts = {'start': np.zeros(STATES), 'move': np.zeros((STATES, STATES)), 'emit': np.zeros((CLASSES, STATES))}
            for rows in _batches(batches, 1_500_000):
                parts, starts = [], []
                for (raw,) in rows:
                    symbols = np.frombuffer(raw, '<u2').astype(np.int32)
                    parts += [symbols[i:i + SEGMENT] for i in range(0, len(symbols), SEGMENT)]
                    starts += [i == 0 for i in range(0, len(symbols), SEGMENT)]
                expected(model, parts, np.array(starts), counts)
            flat = np.concatenate([counts[k].ravel() for k in sizes])
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at], pa.float64())], ['at', 'v'])
        sums = coded.mapInArrow(run, 'at int, v double').groupBy('at').agg(F.sum('v').alias('v')).toPandas()
        flat = np.zeros(sum(sizes.values()))
        flat[sums['at'].to_numpy(int)] = sums['v'].to_numpy(float)
        start, move, emit = np.split(flat, np.cumsum(list(sizes.values()))[:-1])
        # additive smoothing keeps every class possible in every state
        start, move = start + 0.1, move.reshape(STATES, STATES) + 0.1
        emit = emit.reshape(CLASSES, STATES) + 0.01 + shares[:, None]
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    return model


def score_texts(docs: DataFrame, text: str = 'text', key: str = 'doc_id', folds: int = 10, held_fold: int = 0,
                passes: int = 4) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    Texts are learned from whose crc32(key) modulo ``folds`` is not ``held_fold``
    (a null key is not learned from).  A null text is an empty one: its only token
    is the end.  Scores are log10 probabilities: ``base_score`` of independent
    words with counts raised by 0.1, ``score`` of the model.  Without training
    texts all counts are 0.  Other columns are not returned.  The input is read
    twice and must give the same rows both times: one behind a shuffle whose order
    may differ is to be written to a table first.  Training cuts texts into
    segments of 256 tokens and does not count the transitions over these cuts;
    scoring does not cut.
    """
    spark = docs.sparkSession
    part = fold(key, folds)
    table = docs.select((part != held_fold) & (part >= 0), F.col(key), F.col(text)).toDF('_learn', '_key', '_text')
    parts = written(word_counts(table), 'words')
    known = parts.groupBy('word').agg(F.sum('n').alias('c'))
    known = written(known, 'counts')
    n_all, v_all = known.where('c > 0').agg(F.coalesce(F.sum('c'), F.lit(0)), F.count('*')).first()
    rows = known.where("word <> X'' and c > 0").orderBy(F.desc('c'), 'word').limit(TOP).collect()
    top = [bytes(r['word']) for r in rows]
    ends = known.where("word = X''").agg(F.coalesce(F.sum('c'), F.lit(0))).first()[0]
    # per class: tokens and different words; at most ENDINGS rows
    ending = F.crc32(F.when(F.length('word') > 3, F.substring('word', -3, 3)).otherwise(F.col('word'))) % ENDINGS
    by_class = known.where("word <> X'' and c > 0").groupBy((ending + 1 + TOP).cast('int').alias('k')).agg(
        F.sum('c').alias('c'), F.count('*').alias('v')).collect()
    size, words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class:
        size[r['k']], words[r['k']] = r['c'], r['v']
    for i, r in enumerate(rows):
        k = 1 + TOP + zlib.crc32(bytes(r['word'])[-3:]) % ENDINGS
        size[k] -= r['c']
        words[k] -= 1
        size[1 + i] = r['c']
    size[0] = ends
    shares = (size + SMOOTH) / (size + SMOOTH).sum()
    shares[1 + len(top):1 + TOP] = 0  # classes that no word is in
    shares /= shares.sum()
    model = train(table, top, shares, passes)
    inside = np.log10(size + SMOOTH * (words + 1))
    whole = np.log10(n_all + SMOOTH * (v_all + 1))

    def texts(batches):
        for chunk, rows in chunks(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.bool_()),
                 pa.array([r[1] for r in rows], key_type), pa.array([r[2] for r in rows], pa.string())],
                ['chunk', '_learn', '_key', '_text'])

    from pyspark.sql.pandas.types import to_arrow_type
    key_field = table.schema['_key'].dataType
    key_type = to_arrow_type(key_field)
    kind = key_field.simpleString()
    told = table.select('_learn', '_key', '_text').mapInArrow(texts, f'chunk long, _learn boolean, _key {kind}, _text string')
    told = told.select('chunk', F.lit(1).alias('what'), F.lit(None).cast('binary').alias('word'), F.lit(None).cast('long').alias('c'),
                       '_key', '_text')
    book = parts.where("word <> X''").select('chunk', 'word').join(known, 'word').select(
        'chunk', F.lit(0).alias('what'), 'word', 'c', F.lit(None).cast(kind).alias('_key'), F.lit(None).cast('string').alias('_text'))
    stream = book.unionByName(told).repartition('chunk').sortWithinPartitions('chunk', 'what')

    def run(batches):
        classes, now, end_base = Classes(top), None, np.log10(ends + SMOOTH) - whole
        place, words, counts, book_of, waiting, held = {}, [], [], None, [], 0

        def scored():
            nonlocal book_of
            if book_of is None:  # the chunk's different words, each looked at once
                c = np.concatenate([np.empty(0), *counts])
                symbol = np.fromiter(map(classes.__getitem__, words), np.int32, len(words))
                book_of = c > 0, symbol, np.log10(c + SMOOTH), np.where(symbol > TOP, np.log10(c + SMOOTH) - inside[symbol], 0.0)
            seen, symbol, log_c, within = book_of
            sequences, out = [], []
            for id_, text in waiting:
                found = tokens(text)
                try:
                    at = np.fromiter(map(place.__getitem__, found), np.int32, len(found))
                except KeyError:
                    raise RuntimeError('the input gave other rows at its second reading; write it to a table first') from None
                sequences.append(np.append(symbol[at], np.int32(0)))
                out.append((id_, len(at) + 1, int(seen[at].sum()) + int(ends > 0), float((log_c[at] - whole).sum() + end_base), float(within[at].sum())))
            logs = log_chances(model, sequences) / np.log(10)
            columns = [pa.array([o[0] for o in out], key_type), *(pa.array([o[i] for o in out], pa.int64()) for i in (1, 2)),
                       pa.array([o[3] for o in out], pa.float64()), pa.array([o[4] for o in out] + logs, pa.float64())]
            return pa.RecordBatch.from_arrays(columns, ['key', 'n_tokens', 'n_known', 'base_score', 'score'])

        for batch in batches:
            chunk, what = batch['chunk'].to_numpy(), batch['what'].to_numpy()
            edges = np.flatnonzero((np.diff(chunk) != 0) | (np.diff(what) != 0)) + 1
            for a, b in zip(np.r_[0, edges].tolist(), np.r_[edges, len(chunk)].tolist()):
                if a == b:
                    continue
                if chunk[a] != now:
                    if waiting:
                        yield scored()
                    now, place, words, counts, book_of, waiting, held = chunk[a], {}, [], [], None, [], 0
                part = batch.slice(a, b - a)
                if what[a] == 0:
                    more = part['word'].to_pylist()
                    place.update(zip(more, range(len(words), len(words) + len(more))))
                    words += more
                    counts.append(part['c'].to_numpy().astype(float))
                    continue
                for id_, text in zip(part['_key'].to_pylist(), part['_text']):
                    waiting.append((id_, text.as_py()))
                    held += len(waiting[-1][1] or '')
                    if held > 2 * CHUNK_BYTES:
                        yield scored()
                        waiting, held = [], 0
        if waiting:
            yield scored()

    result = stream.mapInArrow(run, f'key {kind}, n_tokens long, n_known long, base_score double, score double')
    return result.select(F.col('key').alias(key), (fold('key', folds) == held_fold).alias('held_out'), 'n_tokens', 'n_known',
                         F.lit(n_all).cast('long').alias('train_tokens'), 'base_score', 'score')
