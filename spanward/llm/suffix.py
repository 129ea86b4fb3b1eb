"""Bytes of documents that lie in a string of ``length`` bytes which also starts anywhere else.

Suffixes are sorted by their first ``length`` bytes a bucket at a time, and a difference cover resolves long ties: a
sample of positions such that any two equal strings of that length hold samples at the same distance from their
starts, with ranks worked out beforehand. The sample here is chosen by content, the smallest hash of ``anchor``
consecutive bytes in every window of ``length``, and not by residues: it has that property for equal strings, where
only it is needed, and takes about 2 / (length - anchor + 2) of the positions instead of the tenth that a cover of
residues of this period takes.

1. Every start of a string belongs to one anchor. An anchor that occurs once rules out all its starts.
2. The bytes around an anchor, as far as its starts reach, are its segment. Equal segments, the inside of long
   repeats, settle all their starts at once; what is ranked is one number per anchor, not one per position.
3. Only where an anchor has several segments, at the edges of repeats, are single starts ranked, by the hash of the
   whole string.

Anchors and strings meet in hash buckets as packed arrays, one bucket sorted at a time. A task settles what repeats
within it and sends one entry per anchor or string, so what a third of all documents share is an entry per task.
Strings are compared by 64-bit hashes.

Defined cases: null text is empty; texts shorter than ``length`` have nothing to lose unless they hold such strings,
which they cannot; matches never cross documents; repeated rows are documents of their own, so their strings of that
length start elsewhere; null ids are kept; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship, slices
from .arrow import Prefix, U, binary, flat, mix, packed_texts, row_slices, unpacked

LENGTH = 200
ANCHOR = 48
#: Bits of a position in a slice; the others hold the hash.
_PLACE_BITS = 27
#: Anchors or strings that a task holds before it sends them on.
FLUSH = 500_000
# What is known of a run of starts: all repeat; to be ranked one by one; to be counted for those.
SETTLED, OPEN, COUNTED = 1, 2, 4
# What a task sends of an anchor: one occurrence, several with one segment, several segments.
SINGLE, MULTI, MANY = 0, 1, 2
PACKED = "bucket int, local boolean, keys binary, more binary, docs binary, doc binary, value binary"
_SALT = U(0xA0761D6478BD642F)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[Prefix, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places of a slice, and the first and last start that belongs to each (several runs have rows of their own)."""
    prefix, n = Prefix(data), len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return prefix, none, none, none
    if n >= 1 << _PLACE_BITS:
        raise ValueError(f"a text of more than {1 << _PLACE_BITS} bytes")
    grams = mix(prefix.of_length(anchor) ^ _SALT)
    low = U((1 << _PLACE_BITS) - 1)
    rows = (grams & ~low) | np.arange(len(grams), dtype=U)
    del grams
    width = length - anchor + 1  # anchors in one string
    m = n - length + 1  # starts
    pad = -len(rows) % width
    blocks = np.concatenate([rows, np.full(pad, ~U(0), U)]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[:m], left[width - 1 : width - 1 + m])
    place = (least & low).astype(np.int64)
    whole = np.zeros(m + 1, np.int32)  # starts whose string stays in its text
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= length)
    whole[offsets[long]] += 1
    np.add.at(whole, offsets[long + 1] - length + 1, -1)
    inside = np.cumsum(whole[:m]) > 0
    cut = np.ones(m, bool)
    cut[1:] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])
    # a text that follows another without a gap of starts cannot share an anchor with it
    first = np.flatnonzero(cut)
    last = np.append(first[1:], m) - 1
    keep = inside[first]
    return prefix, place[first[keep]], first[keep], last[keep]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, number of starts and flags of packed runs."""
    return values >> 16, (values >> 3) & 8191, values & 7


def _packed(bucket: int, local: bool, *parts: np.ndarray) -> tuple:
    return (bucket, local, *[binary(p) for p in parts], *[None] * (5 - len(parts)))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.bool_()] + [pa.binary()] * 5
    columns = list(zip(*rows)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [c.split()[0] for c in PACKED.split(", ")])


def _by_bucket(buckets: int, keys: np.ndarray, more: np.ndarray, doc_keys: np.ndarray, doc: np.ndarray, value: np.ndarray) -> list[tuple]:
    """Entries sorted by key as one packed row per bucket."""
    ends = np.searchsorted(keys, np.array([(i << 64) // buckets for i in range(1, buckets)], U))
    ends = np.concatenate([[0], ends, [len(keys)]])
    rows = []
    for i in range(buckets):
        part = slice(ends[i], ends[i + 1])
        if ends[i + 1] > ends[i]:
            own, index = np.unique(doc[part], return_inverse=True)
            rows.append(_packed(i, False, keys[part], more[part], doc_keys[own], index.astype(np.uint32), value[part]))
    return rows


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted keys."""
    fresh = np.zeros(len(keys[0]), bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[1:] != k[:-1]
    return fresh


def _sent_back(doc_keys: np.ndarray, values: np.ndarray, targets: int) -> pa.Table:
    """Results of one bucket on the way to their documents, packed by the group of the document."""
    group = (doc_keys.view(U) % U(targets)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    group, doc_keys, values = group[order], doc_keys[order], values[order]
    ends = np.searchsorted(group, np.arange(targets + 1))
    full = np.flatnonzero(np.diff(ends))
    rows = [(int(i), binary(doc_keys[ends[i] : ends[i + 1]]), binary(values[ends[i] : ends[i + 1]])) for i in full]
    columns = list(zip(*rows)) or [[]] * 3
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, [pa.int32(), pa.binary(), pa.binary()])], ["target", "keys", "more"])


def _arrived(table: pa.Table) -> pa.Table:
    """One row per document of a group with its values."""
    doc_keys = np.concatenate([np.frombuffer(b, np.int64) for b in table["keys"].to_pylist()])
    values = np.concatenate([np.frombuffer(b, np.int64) for b in table["more"].to_pylist()])
    order = np.argsort(doc_keys, kind="stable")
    doc_keys, values = doc_keys[order], values[order]
    at = np.flatnonzero(_heads(doc_keys))
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(values)), pa.int32()), pa.array(values, pa.int64()))
    return pa.table({"doc_key": pa.array(doc_keys[at], pa.int64()), "found": lists})


def _combine_anchors(keys, segments, value) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one task: flags of every occurrence, and what is sent (indices and states)."""
    order = np.lexsort((segments, keys))
    k, s = keys[order], segments[order]
    new_key, new_segment = _heads(k), _heads(k, s)
    at_key, at_segment = np.flatnonzero(new_key), np.flatnonzero(new_segment)
    per_segment = np.diff(np.append(at_segment, len(k)))
    of_key = np.cumsum(new_key) - 1
    kinds = np.bincount(of_key[at_segment], minlength=len(at_key))
    several = np.repeat(per_segment > 1, per_segment)
    mixed = kinds[of_key] > 1
    flags = np.where(several, SETTLED, 0) | np.where(mixed & ~several, OPEN, 0) | np.where(mixed & several & new_segment, COUNTED, 0)
    state = np.where(kinds > 1, MANY, np.where(np.diff(np.append(at_key, len(k))) > 1, MULTI, SINGLE))
    return order, flags, order[at_key], state


def _find_anchors(length: int, anchor: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, parts, docs, n_docs = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            if not parts:
                return _batch([])
            keys, segments, doc, value = (np.concatenate([p[i] for p in parts]) for i in range(4))
            doc_keys = np.concatenate(docs)
            order, flags, sent, state = _combine_anchors(keys, segments, value)
            known = flags > 0
            rows = [_packed(part % buckets, True, doc_keys[doc[order[known]]], value[order[known]] | flags[known])] if known.any() else []
            return _batch(rows + _by_bucket(buckets, keys[sent], segments[sent], doc_keys, doc[sent], value[sent] | state))

        for batch in row_slices(batches, "text"):
            data, offsets = flat(batch.column(1))
            prefix, place, first, last = anchors(data, offsets, length, anchor)
            keys = prefix.hashes(place, place + anchor)
            segments = mix(prefix.hashes(first, last + length) ^ mix((place - first).astype(U) + _SALT))
            doc = np.searchsorted(offsets, first, "right") - 1
            value = ((first - offsets[doc]) << 16) | ((last - first + 1) << 3)
            parts.append((keys, segments, doc + n_docs, value))
            docs.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            n_docs += batch.num_rows
            held += len(keys)
            if held > FLUSH:
                yield flush()
                held, parts, docs, n_docs = 0, [], [], 0
        yield flush()

    return run


def _unpack(table: pa.Table):
    """Local results, and the entries of all tasks."""
    local, sent = [], []
    for r in table.to_pylist():
        if r["local"]:
            local.append((np.frombuffer(r["keys"], np.int64), np.frombuffer(r["more"], np.int64)))
        else:
            doc = np.frombuffer(r["docs"], np.int64)[np.frombuffer(r["doc"], np.uint32)]
            sent.append((np.frombuffer(r["keys"], U), np.frombuffer(r["more"], U), doc, np.frombuffer(r["value"], np.int64)))
    join = lambda rows, kinds: [np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, k) for i, k in enumerate(kinds)]
    return join(local, [np.int64] * 2), join(sent, [U, U, np.int64, np.int64])


def _meet_anchors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Documents and flagged runs of one bucket."""
    (doc_keys, values), (keys, segments, doc, value) = _unpack(table)
    order = np.lexsort((value & 7, segments, keys))
    keys, segments, doc, value = keys[order], segments[order], doc[order], value[order]
    state = value & 7
    new_key = _heads(keys)
    of_key = np.cumsum(new_key) - 1
    n = np.bincount(of_key)
    # several segments, or a task that has several of its own
    new_segment = _heads(keys, segments)
    mixed = ((np.bincount(of_key[new_segment], minlength=len(n)) > 1) | (np.bincount(of_key, weights=state == MANY) > 0))[of_key]
    own = _heads(keys, segments, (state == MANY).astype(np.int8))  # entries of MANY stand for nothing but the anchor
    group = np.cumsum(own) - 1
    several = np.bincount(group)[group] > 1
    met = (n[of_key] > 1) & (state != MANY)
    flags = np.where(met & (several | (state == MULTI)), SETTLED, 0)
    flags |= np.where(met & mixed & ~several & (state == SINGLE), OPEN, 0)
    flags |= np.where(met & mixed & (several | (state == MULTI)) & own, COUNTED, 0)
    known = flags > 0
    return np.concatenate([doc_keys, doc[known]]), np.concatenate([values, value[known] & ~7 | flags[known]])


def _find_strings(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, parts, docs = TaskContext.get().partitionId(), 0, [], []

        def flush() -> pa.RecordBatch:
            if not parts:
                return _batch([])
            keys, doc, value = (np.concatenate([p[i] for p in parts]) for i in range(3))
            doc_keys = np.array(docs, np.int64)
            order = np.lexsort((1 - (value & 1), keys))  # open ones first
            keys, doc, value = keys[order], doc[order], value[order]
            at = np.flatnonzero(_heads(keys))
            n = np.diff(np.append(at, len(keys)))
            hit = np.repeat(n > 1, n) & (value & 1 > 0)
            rows = [_packed(part % buckets, True, doc_keys[doc[hit]], value[hit] >> 1)] if hit.any() else []
            sent = np.where(n > 1, value[at] & ~1, value[at])
            return _batch(rows + _by_bucket(buckets, keys[at], np.zeros(0, U), doc_keys, doc[at], sent))

        for batch in batches:
            for key, body, runs in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                first, n, flags = _runs(np.array(runs, np.int64))
                use = flags & (OPEN | COUNTED) > 0
                first, n, flags = first[use], n[use], flags[use]
                if not len(first):
                    continue
                starts = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                prefix = Prefix(np.frombuffer(unpacked(body), np.uint8))
                parts.append((prefix.hashes(starts, starts + length), np.full(len(starts), len(docs)), (starts << 1) | np.repeat(flags & OPEN > 0, n)))
                docs.append(key)
                held += len(starts)
                if held > FLUSH:
                    yield flush()
                    held, parts, docs = 0, [], []
        yield flush()

    return run


def _meet_strings(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Documents and starts of one bucket that were to be ranked and repeat."""
    (doc_keys, values), (keys, _, doc, value) = _unpack(table)
    order = np.argsort(keys)
    keys, doc, value = keys[order], doc[order], value[order]
    at = np.flatnonzero(_heads(keys))
    n = np.diff(np.append(at, len(keys)))
    hit = np.repeat(n > 1, n) & (value & 1 > 0)
    return np.concatenate([doc_keys, doc[hit]]), np.concatenate([values, value[hit] >> 1])


def removal_mask(size: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    depth = np.zeros(size + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, np.minimum(starts + lengths, size), -1)
    return np.cumsum(depth)[:size] > 0


def whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Do not remove a character of which a byte stays."""
    if not len(data):
        return gone
    lead = np.flatnonzero(data & 0xC0 != 0x80)
    lead = lead if len(lead) and lead[0] == 0 else np.concatenate([[0], lead])
    return np.repeat(np.minimum.reduceat(gone, lead), np.diff(np.append(lead, len(data))))


def _finish(length: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, body, runs, hits in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                data = np.frombuffer(unpacked(body), np.uint8)
                first, n, flags = _runs(np.array(runs, np.int64))
                done = flags & SETTLED > 0
                single = np.array(hits or [], np.int64)
                starts = np.concatenate([first[done], single])
                gone = removal_mask(len(data), starts, np.concatenate([n[done], np.ones(len(single), np.int64)]) + length - 1)
                if keep_text:
                    rows.append((key, data[~whole_characters(data, gone)].tobytes().decode("utf-8", "replace")))
                else:
                    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].any())
                    rows.append((key, int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            kinds = [pa.int64(), pa.string()] if keep_text else [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            names = ["doc_key", "kept"] if keep_text else ["doc_key", "n_removed", "n_spans", "kept_sha256"]
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return run


def repeats(keyed: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, keep_text: bool = False) -> DataFrame:
    """Results of the documents with anything to remove; ``keyed`` is (doc_key, text).

    (doc_key, n_removed, n_spans, kept_sha256), or (doc_key, kept) with whole characters only.
    """
    spark = keyed.sparkSession
    ship(spark)
    n = slices(spark)

    def met(packed: DataFrame, meet: Callable, name: str) -> DataFrame:
        def ranked(table: pa.Table) -> pa.Table:
            return _sent_back(*meet(table), n)

        rows = packed.groupBy("bucket").applyInArrow(ranked, "target int, keys binary, more binary")
        return materialise(rows.groupBy("target").applyInArrow(_arrived, "doc_key bigint, found array<bigint>").withColumnRenamed("found", name), name)

    runs = met(keyed.mapInArrow(_find_anchors(length, anchor, n), PACKED), _meet_anchors, "runs")
    bodies = keyed.mapInArrow(packed_texts, "doc_key bigint, body binary")
    affected = materialise(bodies.join(runs, "doc_key"), "affected")
    hits = met(affected.mapInArrow(_find_strings(length, n), PACKED), _meet_strings, "hits")
    whole = affected.join(hits, "doc_key", "left").select("doc_key", "body", "runs", "hits")
    schema = "doc_key bigint, kept string" if keep_text else "doc_key bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return whole.mapInArrow(_finish(length, keep_text), schema).dropDuplicates(["doc_key"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    return docs.select(F.xxhash64(id_col, text_col).alias("doc_key"), text)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated strings taken out of their texts, up to whole characters; null stays null."""
    key, new = "_repeats_key", "_repeats_kept"
    kept = repeats(_keyed(docs, id_col, text_col), length, keep_text=True).withColumnsRenamed({"doc_key": key, "kept": new})
    joined = docs.withColumn(key, F.xxhash64(id_col, text_col)).join(kept, key, "left")
    return joined.withColumn(text_col, F.coalesce(new, text_col)).select(*docs.columns)


def repeat_digests(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    keyed = _keyed(docs, id_col, text_col)
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("doc_key"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("b"))
    base = sizes.select("doc_id", "doc_key", F.octet_length("b").cast("long").alias("n_bytes"), F.sha2("b", 256).alias("whole"))
    out = base.join(repeats(keyed, length), "doc_key", "left")
    return out.select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
    )
