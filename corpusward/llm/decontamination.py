"""Benchmark passages in training documents, found in a positional inverted index.

``build_index`` stores the postings of all training tokens.  The corpus is dealt
into segments of a bounded number of tokens; a posting list holds the places of
one word in one segment, so the index is built where the documents are read and
no list grows with the corpus.

``search`` takes the words of the test items and moves only their lists, segment
by segment.  For every window of an item it starts from the rarest word's list,
shifted back by the word's offset, and intersects it with the next rarest one's,
so lists of frequent words are only looked into at the few places that are left.
What is left after the last word is an exact occurrence.  ``near`` finds, from the
same lists, stretches that hold all words of a window in any order.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import written

#: Words: runs of letters and digits of ASCII and of all other characters, A-Z lower-cased.  Works on UTF-8 as it stands.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WINDOW = 10
#: Limits of one segment; a longer document is a segment of its own.
SEGMENT_TOKENS, SEGMENT_DOCS = 1 << 22, 1 << 16
#: Words of test items searched for at a time.
BLOCK_WORDS = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    return (text or '').encode('utf-8', 'surrogatepass').translate(TABLE).split()


# --- index ------------------------------------------------------------------------

def _segments(key_type: pa.DataType, tokens: int, docs: int, rows: int = 50_000):
    names = ['segment', 'term', 'n', 'positions', 'docs']
    kind = pa.list_(pa.struct([('doc_id', key_type), ('base', pa.int32()), ('n_words', pa.int32())]))

    def flush(segment: int, ids: dict, parts: list[np.ndarray], starts: list[int], keys: list, sizes: list[int]) -> Iterator[pa.RecordBatch]:
        listed = pa.StructArray.from_arrays([pa.array(keys, key_type), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32())], fields=list(kind.value_type))
        yield pa.RecordBatch.from_arrays([
            pa.array([segment], pa.int64()), pa.array([None], pa.string()), pa.array([0], pa.int32()), pa.array([None], pa.list_(pa.int32())),
            pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), listed)], names=names)
        if not ids:
            return
        terms = np.concatenate(parts)
        places = np.repeat(np.array(starts) - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(len(terms))
        ordered = np.sort(terms.astype(np.int64) << 32 | places)
        ends = np.cumsum(np.bincount(terms, minlength=len(ids)))
        positions, begins = (ordered & 0xFFFFFFFF).astype(np.int32), np.r_[0, ends[:-1]]
        spelled = list(ids)
        for a in range(0, len(spelled), rows):
            b = min(a + rows, len(spelled))
            offsets = np.r_[begins[a], ends[a:b]]
            lists = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(positions[offsets[0]:offsets[-1]]))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(b - a, segment)), pa.array(spelled[a:b], pa.binary()).cast(pa.string()),
                pa.array(np.diff(offsets).astype(np.int32)), lists, pa.nulls(b - a, kind)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        segment = TaskContext.get().partitionId() << 32

        def empty() -> tuple:
            ids: defaultdict = defaultdict()
            ids.default_factory = ids.__len__
            return ids, [], [], [], []
        state, base = empty(), 0
        for batch in batches:
            for key, text in zip(batch['doc_id'].to_pylist(), batch['text']):
                words = words_of(text.as_py())
                if state[3] and (base + len(words) > tokens or len(state[3]) >= docs):
                    yield from flush(segment, *state)
                    state, base, segment = empty(), 0, segment + 1
                ids, parts, starts, keys, sizes = state
                parts.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
                starts.append(base)
                keys.append(key)
                sizes.append(len(words))
                base += len(words) + 1  # a place between documents: no phrase runs from one into the next
        if state[3]:
            yield from flush(segment, *state)
    return run


def build_index(docs: DataFrame, key: str = 'doc_id', text: str = 'text', segment_tokens: int = SEGMENT_TOKENS,
                segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """The positional inverted index, as a written table.

    Rows with a term: (segment, term, n, positions); positions are places in the
    segment, in order.  Rows without one: the segment's documents, as (doc_id,
    base, n_words): word w of a document is at place base + w.  A null or empty
    text has no words but is listed.  Repeated keys are documents of their own.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    narrow = docs.select(F.col(key).alias('doc_id'), F.col(text).alias('text'))
    kind = narrow.schema['doc_id'].dataType
    schema = f'segment long, term string, n int, positions array<int>, docs array<struct<doc_id: {kind.simpleString()}, base: int, n_words: int>>'
    return written(narrow.mapInArrow(_segments(to_arrow_type(kind), segment_tokens, segment_docs), schema), 'postings')


# --- windows of the test items -----------------------------------------------------

def blocks(items: DataFrame, key: str, text: str, window: int, block_words: int) -> Iterator[dict]:
    """Test items in blocks of about ``block_words`` words: windows as rows of term numbers, and where they come from.

    An item of fewer words than a window, but not none, is one window.
    """
    narrow = items.select(F.col(key).alias('item_id'), F.col(text).alias('text')).where('text is not null')
    size = narrow.agg(F.sum(F.length('text'))).first()[0] or 0
    n = 1 + size // (4 * block_words)  # a word and a blank are four characters at least on average: not more words than that
    dealt = narrow.withColumn('_block', F.pmod(F.xxhash64(F.col('item_id').cast('string'), 'text'), F.lit(n)))
    for at in range(n):
        terms: defaultdict = defaultdict()
        terms.default_factory = terms.__len__
        windows, origins = {}, defaultdict(list)  # window as term numbers -> its number -> (item, place)
        for row in dealt.where(F.col('_block') == at).select('item_id', 'text').toLocalIterator():
            ids = tuple(map(terms.__getitem__, words_of(row['text'])))
            for place in range(max(1, len(ids) - window + 1) if ids else 0):
                number = windows.setdefault(ids[place:place + window], len(windows))
                origins[number].append((row['item_id'], place))
        yield {'terms': [t.decode('utf-8', 'surrogatepass') for t in terms], 'windows': list(windows), 'origins': [origins[i] for i in range(len(windows))]}


# --- intersections -----------------------------------------------------------------

def occurrences(lists: dict[int, np.ndarray], window: tuple[int, ...]) -> np.ndarray:
    """Places where the window's words stand one after another: offset-adjusted lists, rarest first."""
    order = sorted(range(len(window)), key=lambda offset: len(lists.get(window[offset], ())))
    starts = None
    for offset in order:
        positions = lists.get(window[offset])
        if positions is None:
            return np.zeros(0, np.int64)
        if starts is None:
            starts = positions.astype(np.int64) - offset
        else:
            at = np.searchsorted(positions, starts + offset)
            starts = starts[(at < len(positions)) & (positions[np.minimum(at, len(positions) - 1)] == starts + offset)]
        if not len(starts):
            break
    return starts


def stretches(lists: dict[int, np.ndarray], window: tuple[int, ...], span: int) -> np.ndarray:
    """(start, end) rows: shortest stretches of at most ``span`` places that hold all different words of the window, in any order.

    Looked for around the rarest word only: every other word must have a place
    within ``span`` of it.
    """
    terms = sorted(set(window), key=lambda t: len(lists.get(t, ())))
    if any(t not in lists for t in terms):
        return np.zeros((0, 2), np.int64)
    rare = lists[terms[0]].astype(np.int64)
    for t in terms[1:]:
        at = np.searchsorted(lists[t], rare - span + 1)
        rare = rare[(at < len(lists[t])) & (lists[t][np.minimum(at, len(lists[t]) - 1)] < rare + span)]
    found = set()
    for center in rare.tolist():
        around = sorted((int(p), t) for t in terms for p in lists[t][np.searchsorted(lists[t], center - span + 1):np.searchsorted(lists[t], center + span)])
        last: dict[int, int] = {}
        for place, t in around:  # the shortest stretch that ends here starts at the earliest of the last places
            last[t] = place
            start = min(last.values())
            if len(last) == len(terms) and place - start < span and around and start <= center <= place:
                found.add((start, place + 1))
    # of stretches within each other only the shortest
    kept = []
    for start, end in sorted(found, key=lambda s: (s[0], -s[1])):
        while kept and kept[-1][1] >= end:
            kept.pop()
        kept.append((start, end))
    return np.array(kept, np.int64).reshape(-1, 2)


def _exact(lists: dict, windows: list, _) -> Iterator[tuple[int, np.ndarray]]:
    for number, window in enumerate(windows):
        if all(t in lists for t in window):
            starts = occurrences(lists, window)
            if len(starts):
                yield number, np.column_stack([starts, starts + len(window)])


def _close(lists: dict, windows: list, span: int) -> Iterator[tuple[int, np.ndarray]]:
    for number, window in enumerate(windows):
        found = stretches(lists, window, max(span, len(window)))
        if len(found):
            yield number, found


def _in_segment(block: dict, match: Callable, span: int, out: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    windows, origins = block['windows'], block['origins']

    def run(table: pa.Table) -> pa.Table:
        lists, docs = {}, None
        for batch in table.to_batches():
            for term, positions, listed in zip(batch['term'].to_pylist(), batch['positions'], batch['docs']):
                if term is None:
                    docs = listed.values
                else:
                    lists[term] = positions.values.to_numpy(zero_copy_only=False)
        keys, base, sizes = docs.field('doc_id'), docs.field('base').to_numpy(), docs.field('n_words').to_numpy()
        spans: dict[int, list] = defaultdict(list)
        for number, found in match(lists, windows, span):
            owner = np.searchsorted(base, found[:, 0], 'right') - 1
            within = found[:, 1] <= base[owner] + sizes[owner]  # never false for phrases
            for doc, start, end in zip(owner[within].tolist(), found[within, 0].tolist(), found[within, 1].tolist()):
                at = start - int(base[doc])
                spans[doc] += [(item, place, at, end - start) for item, place in origins[number]]
        kind = out.field('spans').type
        return pa.Table.from_arrays([
            pa.repeat(pa.scalar(table['segment'][0].as_py(), pa.int64()), len(sizes)), pa.array(np.arange(len(sizes), dtype=np.int32)), keys,
            pa.array(sizes.astype(np.int64)),
            pa.array([[dict(zip(('item_id', 'item_start', 'start', 'length'), s)) for s in sorted(spans[i], key=lambda s: s[2:] + s[1:2])] if i in spans else []
                      for i in range(len(sizes))], kind)], schema=out)
    return run


def _found(index: DataFrame, items: DataFrame, key: str, text: str, window: int, block_words: int, match: Callable, span: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    spark = index.sparkSession
    doc_kind = index.schema['docs'].dataType.elementType['doc_id'].dataType.simpleString()
    item_kind = items.schema[key].dataType.simpleString()
    schema = (f'segment long, number int, doc_id {doc_kind}, n_words long, '
              f'spans array<struct<item_id: {item_kind}, item_start: int, start: int, length: int>>')
    out = to_arrow_schema(spark.createDataFrame([], schema).schema)
    answers = []
    for block in blocks(items, key, text, window, block_words):
        terms = spark.createDataFrame(pa.table({'_term': pa.array(block['terms'], pa.string()), '_id': pa.array(range(len(block['terms'])), pa.int32())}))
        # at most BLOCK_WORDS terms; the rows that list a segment's documents have none and stay
        wanted = index.join(F.broadcast(terms), F.col('term') == F.col('_term'), 'left').where('_id is not null or term is null')
        own = {'windows': block['windows'], 'origins': block['origins']}
        answers.append(wanted.select('segment', F.col('_id').alias('term'), 'positions', 'docs').groupBy('segment').applyInArrow(
            _in_segment(own, match, span, out), schema))
    found = answers[0]
    for more in answers[1:]:
        found = found.unionByName(more)
    if len(answers) > 1:
        found = found.groupBy('segment', 'number').agg(F.first('doc_id').alias('doc_id'), F.first('n_words').alias('n_words'),
                                                       F.flatten(F.collect_list('spans')).alias('spans'))
    return found.select('doc_id', 'n_words', 'spans')


def search(index: DataFrame, items: DataFrame, key: str = 'item_id', text: str = 'text', window: int = WINDOW,
           block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, spans) of every indexed document: the windows of test items that occur in it, exactly.

    A span is (item_id, item_start, start, length): ``length`` words from word
    ``item_start`` of the item stand at word ``start`` of the document.  Items
    without words have no windows; items of equal text, and a window an item
    has twice, give a span each.  No items: no spans.
    """
    return _found(index, items, key, text, window, block_words, _exact, 0)


def near(index: DataFrame, items: DataFrame, span: int, key: str = 'item_id', text: str = 'text', window: int = WINDOW,
         block_words: int = BLOCK_WORDS) -> DataFrame:
    """Like ``search``, for stretches of at most ``span`` words with all different words of a window, in any order.

    Only shortest stretches are given: none holds another one of the same window.
    """
    return _found(index, items, key, text, window, block_words, _close, span)


def n_hit(spans: Column) -> Column:
    """Words covered by the spans, each once."""
    places = F.array_sort(F.transform(spans, lambda s: F.struct(s['start'].cast('long').alias('start'), (s['start'] + s['length']).cast('long').alias('end'))))
    none = F.lit(0).cast('long')
    return F.aggregate(places, F.struct(none.alias('n'), none.alias('upto')), lambda a, s: F.struct(
        (a['n'] + F.greatest(none, s['end'] - F.greatest(s['start'], a['upto']))).alias('n'),
        F.greatest(a['upto'], s['end']).alias('upto')), lambda a: a['n'])
