"""Repeated strings removed by a distributed merge sort of suffixes that knows common prefixes.

Every byte is removed that lies in a string of LENGTH bytes which also starts earlier: in a document of
smaller id, or earlier in the same one. Strings are compared on the input, and never cross documents.

1. Which suffixes need sorting: each window of LENGTH bytes has an anchor chosen by content (see
   anchors.py). Windows can be equal only if their anchors' k-grams are, so an anchor whose k-gram occurs
   once ends here. Anchors whose windows cover the same bytes are equal in all windows: all but the
   earliest are repeats. Both are found by dealing 16-byte hashes, packed in blocks, by k-gram.
2. For k-grams that stand in different surroundings, the suffixes from the anchor on are sorted: each
   block of documents sorts its own, front-codes the run (length of the prefix shared with the one before,
   and the rest) and deals it out; a loser tree merges the runs, comparing suffixes only beyond the
   prefix that they are known to share with the last one put out, and yields the sorted suffixes with
   their common prefixes. Suffixes that share LENGTH - r bytes, and whose preceding r bytes are equal (by
   the same reasoning on reversed text), hold equal windows r bytes before the anchor; the earliest stays.
   K-grams in very many surroundings (a line that every page has) are sorted window by window instead,
   dealt out by the windows' content, so that no k-gram is gathered in one task.
3. Each document gets the starts of its repeated windows and loses what they cover.

Blocks are dealt by hash, their number follows the input's size, and equal content is combined before
each exchange. Nothing is gathered on the driver but the input's size.

K-grams and the bytes around them are compared by two 64-bit hashes of at most 170 bytes; in step 2 by the
bytes themselves.

Cases: a null or empty text loses nothing and has no bytes; texts shorter than LENGTH lose nothing; very long
texts are read in stretches; rows that repeat an id and its text count as one place, so each gets the same
result; different texts of one id are ordered by where a string starts, and both keep a string that
starts at the same place in both; a null id is the smallest; columns named like the outputs are replaced,
others are kept; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import anchors
from lodestone.llm.bytekit import byte_codes, mix, pieces, prefix_hash, raw, release, span_hash
from lodestone.llm.store import small_batches, written

LENGTH = 100
#: Bytes of text that a task takes together: for its anchors, and for the blocks it packs.
UNIT = 12 << 20
#: Surroundings from which on a k-gram's windows are dealt out one by one.
CROWD = 1000
#: Blocks of the exchanges: so many at least, and one more for so many bytes of text; of the exchanges by k-gram one for
#: GRAM_SHARE times as many, as each of their blocks hands each block of documents a row, which must not become tiny.
LEAST_BLOCKS, BLOCK_BYTES, GRAM_SHARE = 128, 2 << 20, 16
WINDOW_CODES = byte_codes(103)
ROWS = "block int, kind int, body binary"
ANCHORS, REPEATS, SORT, SORT_ALONE, TEXTS, RUN = range(6)


def pack(*columns: np.ndarray) -> bytes:
    """Equally long integer columns as bytes; each column's bytes stand by significance, which compresses well."""
    out = [np.array([len(columns[0])], "<i8").tobytes()]
    for c in columns:
        width = c.dtype.itemsize
        out.append(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), width).T.tobytes())
    return b"".join(out)


def unpack(body: bytes, *kinds: str) -> list[np.ndarray]:
    """The columns of pack()."""
    n, at, out = int(np.frombuffer(body, "<i8", 1)[0]), 8, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(body, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * width
    return out


def gathered(bodies: list[bytes], *kinds: str) -> list[np.ndarray]:
    """unpack() of several, one after the other."""
    parts = [unpack(b, *kinds) for b in bodies]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, kind in enumerate(kinds)]


ANCHOR_KINDS = ("<u8", "<u8", "<i8", "<i4", "<i4", "<u2")  # gram, whole, id, text key, first, windows less one
MARK_KINDS = ("<i8", "<i4", "<i4", "<i4")  # id, text key, first, last


def document_key(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """One hash for an id and a text key."""
    return mix(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + keys.astype(np.int64).view(np.uint64))


def by_block(block: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each block with its rows' places."""
    order = np.argsort(block, kind="stable")
    heads = np.flatnonzero(np.diff(block[order], prepend=-1))
    for a, b in zip(heads, [*heads[1:], len(order)]):
        yield int(block[order[a]]), order[a:b]


def marks_by_block(kind: int, columns: list[np.ndarray], blocks: int) -> Iterator[tuple[int, int, bytes]]:
    """Marks as rows (block of documents, kind, body)."""
    if len(columns[0]):
        for b, at in by_block((document_key(columns[0], columns[1]) % np.uint64(blocks)).astype(np.int64)):
            at = at[np.lexsort((columns[2][at], columns[0][at]))]
            yield b, kind, pack(*(c[at].astype(k) for c, k in zip(columns, MARK_KINDS)))


def table(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["block", "kind", "body"])


def earliest(gram: np.ndarray, whole: np.ndarray, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by gram and whole, then place; in that order, whether an anchor is at the earliest place of its class, and whether a class begins."""
    order = np.lexsort((first, ids, whole, gram))
    g, w, d, f = gram[order], whole[order], ids[order], first[order]
    begins = np.ones(len(order), bool)
    begins[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])
    head = np.flatnonzero(begins)[np.cumsum(begins) - 1] if len(order) else np.zeros(0, np.int64)
    return order, (d == d[head]) & (f == f[head]), begins


def anchor_rows(length: int, blocks: int) -> Callable:
    """Step 1 on the side of the texts: anchors packed by k-gram, one of each class; the other ones are repeats already."""

    def flush(found: list[list[np.ndarray]]) -> pa.RecordBatch | None:
        gram, whole, ids, keys, first, more = (np.concatenate(c) for c in zip(*found))
        order, leads, _ = earliest(gram, whole, ids, first)
        late = order[~leads]
        rows = list(marks_by_block(REPEATS, [ids[late], keys[late], first[late], first[late] + more[late]], blocks))
        at = order[leads]
        for b, part in by_block(((gram[at] >> np.uint64(20)) % np.uint64(blocks)).astype(np.int64)):
            part = at[part]
            rows.append((b, ANCHORS, pack(*(c[part].astype(k) for c, k in zip((gram, whole, ids, keys, first, more), ANCHOR_KINDS)))))
        return table(rows) if rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            ids, keys = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("__id", "__text_key"))
            for i, j in pieces(offsets, 1 << 19):
                a = anchors.find(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)
                if len(a):
                    found.append([a.gram, a.whole, ids[i + a.row], keys[i + a.row], a.first, a.last - a.first])
                held += int(offsets[j] - offsets[i])
                if held >= UNIT:
                    if found and (out := flush(found)):
                        yield out
                    found, held = [], 0
        if found and (out := flush(found)):
            yield out
        del found
        release()

    return run


def anchor_groups(doc_blocks: int, crowd: int) -> Callable:
    """Step 1 where all anchors of a k-gram meet: repeats, and anchors whose suffixes must be sorted."""

    def run(group: pa.Table) -> pa.Table:
        kinds, bodies = group.column("kind").to_pylist(), group.column("body").to_pylist()
        rows = []
        done = gathered([b for k, b in zip(kinds, bodies) if k == REPEATS], *MARK_KINDS)
        gram, whole, ids, keys, first, more = gathered([b for k, b in zip(kinds, bodies) if k == ANCHORS], *ANCHOR_KINDS)
        last = first + more.astype(np.int32)
        order, leads, begins = earliest(gram, whole, ids, first)
        late = order[~leads]
        rows += marks_by_block(REPEATS, [np.concatenate([d, c[late]]) for d, c in zip(done, (ids, keys, first, last))], doc_blocks)
        g = gram[order]
        number = np.cumsum(np.diff(g, prepend=g[:1] + np.uint64(1)) != 0) - 1 if len(g) else np.zeros(0, np.int64)
        classes = np.bincount(number, begins) if len(g) else np.zeros(0)
        for kind, low, high in ((SORT, 2, crowd), (SORT_ALONE, crowd, np.inf)):
            at = order[leads & (classes[number] >= low) & (classes[number] < high)]
            rows += marks_by_block(kind, [ids[at], keys[at], first[at], last[at]], doc_blocks)
        return pa.Table.from_batches([table(rows)])

    return run


def pack_documents(doc_blocks: int) -> Callable:
    """Documents as compressed Arrow blocks, dealt out by document."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        ids, keys = (whole.column(c).to_numpy() for c in ("__id", "__text_key"))
        rows = []
        for b, at in by_block((document_key(ids, keys) % np.uint64(doc_blocks)).astype(np.int64)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(whole.take(pa.array(at)))
            rows.append((b, TEXTS, sink.getvalue().to_pybytes()))
        return table(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= UNIT:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)
        del held
        release()

    return run


class Block:
    """The documents of a block and the marks that came for them."""

    def __init__(self, group: pa.Table):
        kinds, bodies = group.column("kind").to_pylist(), group.column("body").to_pylist()
        texts = [pa.ipc.open_stream(b).read_all() for k, b in zip(kinds, bodies) if k == TEXTS]
        self.rows = pa.concat_tables(texts).combine_chunks() if texts else None
        if self.rows is None:
            return
        self.ids, keys = (self.rows.column(c).to_numpy() for c in ("__id", "__text_key"))
        self.data, self.offsets = raw(self.rows.column("text"))
        self.keys = keys
        known, self.one, self.doc = np.unique(document_key(self.ids, keys), return_index=True, return_inverse=True)
        self.marks = {}
        for kind in (REPEATS, SORT, SORT_ALONE):
            ids, keys, first, last = gathered([b for k, b in zip(kinds, bodies) if k == kind], *MARK_KINDS)
            self.marks[kind] = self.one[np.searchsorted(known, document_key(ids, keys))] if len(ids) else np.zeros(0, np.int64), first.astype(np.int64), last.astype(np.int64)


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    d = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (d.bit_length() + 7) // 8


RUN_KINDS = ("<i8", "<i4", "<i4", "<u2", "<u2", "<u2", "<u2")  # id, text key, anchor's place, least and most r, shared prefix, length of the rest


def write_run(items: list[tuple]) -> bytes:
    """A sorted run of (suffix, before, id, text key, place, least r, most r), front-coded."""
    items.sort(key=lambda x: x[0])
    shared, last = [], b""
    for x in items:
        shared.append(common_prefix(last, x[0]))
        last = x[0]
    rests = [x[0][s:] for x, s in zip(items, shared)]
    columns = [*zip(*(x[2:] for x in items)), shared, [len(r) for r in rests]]
    head = pack(*(np.array(c, k) for c, k in zip(columns, RUN_KINDS)))
    return np.array([len(head)], "<i8").tobytes() + head + b"".join(rests) + b"".join(x[1] for x in items)


def read_run(body: bytes) -> tuple[list[np.ndarray], list[bytes], list[bytes]]:
    """Columns, suffixes and the (reversed) bytes before them."""
    size = int(np.frombuffer(body, "<i8", 1)[0])
    columns = unpack(body[8 : 8 + size], *RUN_KINDS)
    at, last, suffixes, before = 8 + size, b"", [], []
    for s, n in zip(columns[5].tolist(), columns[6].tolist()):
        last = last[:s] + body[at : at + n]
        suffixes.append(last)
        at += n
    for n in columns[4].tolist():
        before.append(body[at : at + n])
        at += n
    return columns, suffixes, before


def suffix_runs(length: int, blocks: int) -> Callable:
    """Step 2 on the side of the texts: sorted, front-coded runs of the suffixes that were asked for."""

    def run(group: pa.Table) -> pa.Table:
        block, rows = Block(group), []
        runs: dict[int, list[tuple]] = {}
        if block.rows is not None:
            data, offsets = block.data, block.offsets
            body = data.tobytes()
            row, first, last = block.marks[SORT]
            if len(row):
                gram, place = _anchors_of(data, offsets, row, first, last, length)
                at = offsets[row]
                for g, p, a, lo, hi, i, k in zip(gram.tolist(), place.tolist(), at.tolist(), (place - last).tolist(), (place - first).tolist(), block.ids[row].tolist(), block.keys[row].tolist()):
                    suffix = g.to_bytes(8, "big") + body[a + p : a + p + length - lo]
                    runs.setdefault((g >> 20) % blocks, []).append((suffix, body[a + p - hi : a + p][::-1], i, k, p, lo, hi))
            row, first, last = block.marks[SORT_ALONE]
            if len(row):
                n = last - first + 1
                start = np.repeat(first - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
                row = np.repeat(row, n)
                at = offsets[row] + start
                code = mix(span_hash(prefix_hash(data, WINDOW_CODES), at, at + length))
                order, leads, _ = earliest(code, code, block.ids[row], start)
                late = order[~leads]
                rows += marks_by_block(REPEATS, [block.ids[row[late]], block.keys[row[late]], start[late], start[late]], blocks)
                for o in order[leads].tolist():
                    c, a = int(code[o]), int(at[o])
                    runs.setdefault((c >> 20) % blocks, []).append((c.to_bytes(8, "big") + body[a : a + length], b"", int(block.ids[row[o]]), int(block.keys[row[o]]), int(start[o]), 0, 0))
        rows += [(b, RUN, write_run(items)) for b, items in runs.items()]
        return pa.Table.from_batches([table(rows)])

    return run


def _anchors_of(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """K-gram hash and place (in the row) of the anchor of given runs of windows."""
    prefix = prefix_hash(data, anchors.CODES)
    at = offsets[row]
    # the anchor lies in every window of its run: within [last, first + length - GRAM]
    span = first + length - anchors.GRAM - last + 1
    start = np.concatenate([[0], np.cumsum(span)])
    place = np.repeat(at + last - start[:-1], span) + np.arange(start[-1])
    code = mix(span_hash(prefix, place, place + anchors.GRAM))
    high = code >> np.uint64(anchors.PLACE_BITS)
    least = np.minimum.reduceat(high, start[:-1])
    hit = np.flatnonzero(high == np.repeat(least, span))
    head = hit[np.searchsorted(hit, start[:-1])]
    return code[head], place[head] - at


def merge(runs: list[tuple[list[int], list[bytes]]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs (shared prefixes, strings) by a loser tree: run and place of each string, and the prefix it shares with the one before.

    A string that waits in the tree keeps the length of the prefix it shares with the last one put out.
    Of two strings the one that shares more is the smaller; only equal lengths call for a comparison, and
    that starts beyond the shared prefix.
    """
    width = 1
    while width < len(runs):
        width *= 2
    strings = [r[1] for r in runs] + [[]] * (width - len(runs))
    shares = [r[0] for r in runs] + [[]] * (width - len(runs))
    place, known = [0] * width, [0] * width
    alive = [bool(s) for s in strings]

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes the one it shares with the winner."""
        if not alive[b]:
            return a, b
        if not alive[a]:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y, k = strings[a][place[a]], strings[b][place[b]], known[a]
        x, y = x[k:], y[k:]
        if y < x:
            a, b = b, a
        known[b] = k + common_prefix(x, y)
        return a, b

    losers = [0] * width
    level = list(range(width))
    at = width
    while len(level) > 1:
        at //= 2
        up = []
        for k in range(0, len(level), 2):
            w, lost = play(level[k], level[k + 1])
            losers[at + k // 2] = lost
            up.append(w)
        level = up
    winner = level[0]
    out_run, out_place, out_shared = [], [], []
    while alive[winner]:
        out_run.append(winner)
        out_place.append(place[winner])
        out_shared.append(known[winner])
        place[winner] += 1
        if place[winner] < len(strings[winner]):
            known[winner] = shares[winner][place[winner]]
        else:
            alive[winner] = False
        node = (winner + width) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2
    return out_run, out_place, out_shared


def equal_windows(shared: np.ndarray, before: list[bytes], ids: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(item, r) of the windows, r bytes before an anchor, that occur at an earlier place.

    Items are sorted by their suffixes (a k-gram hash of 8 bytes, then text); shared: bytes in common with
    the item before; before: the reversed text before the anchor, `high` bytes of it.
    """
    n, most = len(before), int(high.max(initial=0))
    text = np.zeros((n, most + 8), np.uint8)
    if most:
        lengths = np.array([len(b) for b in before])
        flat = np.frombuffer(b"".join(before), np.uint8)
        text[np.repeat(np.arange(n), lengths), np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(lengths)])[:-1], lengths)] = flat
    words = np.ascontiguousarray(text[:, : (most + 7) // 8 * 8]).view(">u8") if most else np.zeros((n, 0), ">u8")
    back = np.lexsort(words.T[::-1]) if most else np.arange(n)
    sorted_text = text[back, :most]
    differ = sorted_text[1:] != sorted_text[:-1]
    alike = np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), most)]) if n and most else np.zeros(n, np.int64)
    rank = np.lexsort((place, ids))
    items, found = [], []
    for r in range(most + 1):
        front = np.cumsum(shared < 8 + length - r)
        rear = np.empty(n, np.int64)
        rear[back] = np.cumsum(alike < r)
        at = rank[(low[rank] <= r) & (r <= high[rank])]
        if len(at) < 2:
            continue
        code = front[at] * np.int64(n + 1) + rear[at]
        order = np.argsort(code, kind="stable")
        at, code = at[order], code[order]
        head = np.flatnonzero(np.diff(code, prepend=-1))[np.cumsum(np.diff(code, prepend=-1) != 0) - 1]
        late = at[(ids[at] != ids[at[head]]) | (place[at] != place[at[head]])]
        items.append(late)
        found.append(np.full(len(late), r))
    return (np.concatenate(items), np.concatenate(found)) if items else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def merged_runs(length: int, doc_blocks: int) -> Callable:
    """Step 2 where runs meet: merge them and mark repeated windows."""

    def run(group: pa.Table) -> pa.Table:
        kinds, bodies = group.column("kind").to_pylist(), group.column("body").to_pylist()
        marks = [gathered([b for k, b in zip(kinds, bodies) if k == REPEATS], *MARK_KINDS)]
        runs = [read_run(b) for k, b in zip(kinds, bodies) if k == RUN]
        if runs:
            which, at, shared = merge([(c[5].tolist(), s) for c, s, _ in runs])
            base = np.concatenate([[0], np.cumsum([len(s) for _, s, _ in runs])])
            order = base[np.array(which)] + np.array(at)
            ids, keys, place, low, high = (np.concatenate([c[k] for c, _, _ in runs])[order].astype(np.int64) for k in range(5))
            before = [runs[w][2][p] for w, p in zip(which, at)]
            item, r = equal_windows(np.array(shared), before, ids, place, low, high, length)
            o = np.lexsort((-r, item))
            item, start = item[o], place[item[o]] - r[o]
            heads = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (start[1:] != start[:-1] + 1)])) if len(item) else np.zeros(0, np.int64)
            ends = np.concatenate([heads[1:] - 1, [len(item) - 1]]).astype(np.int64) if len(item) else heads
            marks.append([ids[item[heads]], keys[item[heads]], start[heads], start[ends]])
        rows = list(marks_by_block(REPEATS, [np.concatenate(c) for c in zip(*marks)], doc_blocks))
        return pa.Table.from_batches([table(rows)])

    return run


def removed_bytes(block: Block, length: int) -> np.ndarray:
    """Whether each byte of the block's distinct documents is removed."""
    row, first, last = block.marks[REPEATS]
    cover = np.zeros(len(block.data) + 1, np.int32)
    np.add.at(cover, block.offsets[row] + first, 1)
    np.add.at(cover, block.offsets[row] + last + length, -1)
    return np.cumsum(cover)[:-1] > 0


def results(schema: T.StructType, keep: list[str], length: int, digest: bool) -> Callable:
    """Step 3: what is left of each document."""

    def run(group: pa.Table) -> pa.Table:
        block = Block(group)
        if block.rows is None:
            return pa.Table.from_batches([], _arrow(schema))
        gone, offsets = removed_bytes(block, length), block.offsets
        total = np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = offsets[:-1][np.diff(offsets) > 0]
        begins[inner] = gone[inner]
        spans = np.concatenate([[0], np.cumsum(begins)])
        left = block.data[~gone].tobytes()
        at = offsets - total[offsets]
        here = block.one[block.doc]  # a repeated row takes the result of its first copy
        a, b = offsets[here], offsets[here + 1]
        kept = [left[at[k] : at[k + 1]] for k in here]
        columns = [block.rows.column(c).combine_chunks() for c in keep]
        columns += [pa.array(b - a), pa.array(total[b] - total[a]), pa.array(spans[b] - spans[a])]
        columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in kept]) if digest else pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()))
        return pa.Table.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else c.combine_chunks().cast(f.type) for c, f in zip(columns, _arrow(schema))], schema=_arrow(schema))

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, digest: bool = False, crowd: int = CROWD) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and what is left of the text.

    digest=True gives kept_sha256 in place of the text. A character that a removed span cuts goes with it
    in the text; the digest is of the bytes.
    """
    if length < anchors.GRAM + 1:
        raise ValueError(f"length must be over {anchors.GRAM}")
    keep = [f for f in docs.schema.fields if f.name not in (text, "n_bytes", "n_removed", "n_spans", "kept_sha256", "__id", "__text_key")]
    least = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(*(F.col(f.name) for f in keep), F.coalesce(F.col(doc_id).cast("long"), least).alias("__id"), F.pmod(F.xxhash64(text), F.lit((1 << 31) - 1)).cast("int").alias("__text_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if text != "text" and "text" in [f.name for f in keep]:
        raise ValueError("a column named text must be the text")
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = LEAST_BLOCKS + int(total) // (GRAM_SHARE * BLOCK_BYTES)
    doc_blocks = LEAST_BLOCKS + int(total) // BLOCK_BYTES
    narrow = small_batches(rows).select("__id", "__text_key", "text")
    found = written(narrow.mapInArrow(anchor_rows(length, blocks), ROWS).groupBy("block").applyInArrow(anchor_groups(doc_blocks, crowd), ROWS), "anchors")
    asked = found.where(F.col("kind").isin(SORT, SORT_ALONE))
    packed = narrow.mapInArrow(pack_documents(doc_blocks), ROWS)
    runs = packed.unionByName(asked).groupBy("block").applyInArrow(suffix_runs(length, blocks), ROWS)
    merged = written(runs.groupBy("block").applyInArrow(merged_runs(length, doc_blocks), ROWS), "repeats")
    schema = T.StructType([*keep, T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256" if digest else "text", T.StringType())])
    whole = rows.mapInArrow(pack_documents(doc_blocks), ROWS)
    return whole.unionByName(found.where(F.col("kind") == REPEATS)).unionByName(merged).groupBy("block").applyInArrow(results(schema, [f.name for f in keep], length, digest), schema)


def dedup_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    return dedup(docs.select("doc_id", "text"), digest=True)
