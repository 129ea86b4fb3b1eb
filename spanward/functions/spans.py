"""Span kernels on arrays: one row in, one row out, no shuffle.

Detection and replacement are Python on Arrow batches, a whole detection profile in one call; the other kernels are SQL
expressions.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ENTITIES, ENTITIES_DDL, ENTITY
from .regex import jvm_pattern, may_match_sql, required_literals, sql_literal

NO_ENTITIES = f"cast(array() as {ENTITIES_DDL})"
#: Stands round matches while a text is cut; texts that hold it themselves are searched twice instead.
MARK = "\\u0001"
#: Characters of text whose spans are held as Python objects at once.
BLOCK_CHARS = 4_000_000
_RAW = "array<struct<start:int,end:int,value:string>>"


def entity(label, start, end, score, value) -> Column:
    cells = zip((label, start, end, score, value), ENTITY.fields)
    return F.struct(*[c.cast(f.dataType).alias(f.name) for c, f in cells])


def no_entities() -> Column:
    return F.expr(NO_ENTITIES)


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold(text: str, pattern: str, item: str, empty: str) -> str:
    """Matches with their offsets; ``item`` builds one from begin, finish and p.value.

    The gaps between matches and the matches themselves give every offset by addition. The
    additions run in chunks of about the square root of the number of matches, so that a long
    text with a match on every word does not copy an ever longer array at each step.
    A pattern that matches the empty string has no gaps and is refused.
    """
    if re.compile(pattern).match(""):
        raise ValueError(f"pattern matches the empty string: {pattern!r}")
    jvm = sql_literal(jvm_pattern(pattern))
    begin, width = "(acc.pos + p.gap)", "char_length(p.value)"
    made = item.format(begin=begin, finish=f"({begin} + {width})")
    size = "cast(ceil(sqrt(size(ps))) AS int)"
    chunks = f"transform(sequence(0, cast((size(ps) - 1) div {size} AS int)), c -> slice(ps, c * {size} + 1, {size}))"
    placed = f"""aggregate({chunks},
        named_struct('pos', 0, 'out', cast(array() as array<struct<pos:int,ps:array<struct<gap:int,value:string>>>>)),
        (a, ch) -> named_struct(
            'pos', a.pos + aggregate(ch, 0, (n, q) -> n + q.gap + coalesce(char_length(q.value), 0)),
            'out', concat(a.out, array(named_struct('pos', a.pos, 'ps', ch)))),
        a -> a.out)"""
    one_chunk = f"""aggregate(k.ps, named_struct('pos', k.pos, 'out', {empty}),
        (acc, p) -> named_struct(
            'pos', {begin} + coalesce({width}, 0),
            'out', CASE WHEN p.value IS NULL THEN acc.out ELSE concat(acc.out, array({made})) END),
        acc -> acc.out)"""
    twice = f"""zip_with(split({text}, {jvm}, -1), regexp_extract_all({text}, {jvm}, 0),
        (g, v) -> named_struct('gap', char_length(g), 'value', v))"""
    # gap, match, gap, ... of a text in which every match stands between two marks: the pattern runs once
    pair = "named_struct('gap', char_length(get(cut, i)), 'value', get(cut, i + 1))"
    marked = f"split(regexp_replace({text}, {jvm}, '{MARK}$0{MARK}'), '{MARK}', -1)"
    once = f"get(transform(array({marked}), cut -> transform(sequence(0, size(cut) - 1, 2), i -> {pair})), 0)"
    pieces = f"CASE WHEN contains({text}, '{MARK}') THEN {twice} ELSE {once} END"
    return f"""CASE WHEN {may_match_sql(text, pattern)}
        THEN get(transform(array({pieces}), ps -> flatten(transform({placed}, k -> {one_chunk}))), 0) ELSE {empty} END"""


def raw_spans(column: str, pattern: str) -> Column:
    """All matches as array<struct<start,end,value>>."""
    item = "named_struct('start', {begin}, 'end', {finish}, 'value', p.value)"
    return F.expr(_fold(name(column), pattern, item, f"cast(array() as {_RAW})"))


def found_entities(text: Column, found: list[tuple[str, str, float]], target: Column | None = None, overlaps: bool = False) -> Column:
    """All matches of (label, pattern, score) sorted by start; ties keep the order in which patterns were given.

    Without ``overlaps``, spans are resolved as by ``resolve``. Nothing is found in a null text. Python's own regexes on
    Arrow batches: they take a small part of the time of the JVM's. A batch's spans become Arrow arrays after every
    ``BLOCK_CHARS`` characters, so that few are held as objects.
    """
    for _, pattern, _ in found:
        if re.compile(pattern).match(""):
            raise ValueError(f"pattern matches the empty string: {pattern!r}")
    # all names below are local: workers get the function itself and need no module of this package
    labels, scores = [x[0] for x in found], [float(x[2]) for x in found]
    sources, aimed, block = [(pattern, required_literals(pattern)) for _, pattern, _ in found], target is not None, BLOCK_CHARS
    kind = pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("value", pa.string())])

    def kept(es, aim):
        out = []
        for e in es:
            last = out[-1] if out else None
            if last is None or e[0] >= last[2]:
                out.append(e)
                continue
            mine, its = aim is not None and labels[e[1]] == aim, aim is not None and labels[last[1]] == aim
            if mine != its:
                if mine:
                    out[-1] = e
            elif e[2] - e[0] > last[2] - last[0]:
                out[-1] = e
        return out

    def arrays(spans, values, sizes):
        at = np.array(spans, dtype=np.int32).reshape(-1, 3)
        named = pa.array(labels, pa.string()).take(pa.array(at[:, 1]))
        scored = pa.array(np.array(scores)[at[:, 1]])
        fields = [named, pa.array(at[:, 0]), pa.array(at[:, 2]), scored, pa.array(values, pa.string())]
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32))
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, fields=list(kind)))

    def run(texts: pa.Array, targets: pa.Array) -> pa.Array:
        patterns = [(i, re.compile(pattern), literals) for i, (pattern, literals) in enumerate(sources)]
        parts, spans, values, sizes, chars = [], [], [], [], 0
        for one, aim in zip(texts, targets):
            value, es = one.as_py(), []
            if value:
                chars += len(value)
                for i, pattern, literals in patterns:
                    if literals is None or any(x in value for x in literals):
                        es += [(m.start(), i, m.end()) for m in pattern.finditer(value)]
                es.sort()
                if not overlaps:
                    es = kept(es, aim.as_py() if aimed else None)
                spans += es
                values += [value[e[0] : e[2]] for e in es]
            sizes.append(len(es))
            if chars > block:
                parts.append(arrays(spans, values, sizes))
                spans, values, sizes, chars = [], [], [], 0
        return pa.concat_arrays([*parts, arrays(spans, values, sizes)])

    return F.arrow_udf(run, ENTITIES)(text, F.lit(None).cast("string") if target is None else F.lower(target))


def sort_sql(entities: str) -> str:
    """Stable sort by start: ties keep the order in which they were given."""
    keyed = f"transform({entities}, (e, i) -> named_struct('s', e.start, 'i', i, 'e', e))"
    return f"transform(sort_array({keyed}), k -> k.e)"


def sort_by_start(column: str) -> Column:
    return F.expr(sort_sql(name(column)))


def resolve_sql(entities: str, target: str | None = None) -> str:
    """Left fold over spans in start order, keeping at most one of two that overlap, in chunks of about the square root of
    their number.

    The target label wins over others; between equals the strictly longer one replaces
    the last kept; else the newcomer is dropped.
    """
    last = "try_element_at(kept, -1)"
    swapped = "concat(slice(kept, 1, size(kept) - 1), array(e))"
    aimed = ""
    if target is not None:
        mine, its = f"coalesce(e.label = lower({target}), false)", f"coalesce({last}.label = lower({target}), false)"
        aimed = f"WHEN {mine} AND NOT {its} THEN {swapped} WHEN {its} AND NOT {mine} THEN kept"
    step = f"""CASE WHEN size(kept) = 0 OR e.start >= {last}.end THEN concat(kept, array(e))
        {aimed}
        WHEN e.end - e.start > {last}.end - {last}.start THEN {swapped}
        ELSE kept END"""
    # only the last kept span can still change: a chunk starts with it and gives the others away
    one_chunk = f"get(transform(array(aggregate(ch, acc.last, (kept, e) -> {step})), kept -> named_struct('done', concat(acc.done, array(slice(kept, 1, size(kept) - 1))), 'last', slice(kept, -1, 1))), 0)"
    nothing = f"named_struct('done', cast(array() AS array<{ENTITIES_DDL}>), 'last', {NO_ENTITIES})"
    width = "cast(ceil(sqrt(size(es))) AS int)"
    chunks = f"transform(sequence(0, (size(es) - 1) div {width}), c -> slice(es, cast(c AS int) * {width} + 1, {width}))"
    folded = f"CASE WHEN size(es) = 0 THEN es ELSE aggregate({chunks}, {nothing}, (acc, ch) -> {one_chunk}, acc -> concat(flatten(acc.done), acc.last)) END"
    return f"get(transform(array({sort_sql(entities)}), es -> {folded}), 0)"


def resolve(column: str, target: str | None = None) -> Column:
    return F.expr(resolve_sql(name(column), None if target is None else name(target)))


def flatten(df: DataFrame, array, item: str, *keep, pos: str | None = None) -> DataFrame:
    """One row per element, as ``item`` next to the kept columns; null elements are left out.

    An outer generator on purpose: for the inner one the optimizer adds a filter on the array's
    size and pushes it through the projections below, which computes the array several times.
    """
    made = F.explode_outer(array).alias(item) if pos is None else F.posexplode_outer(array).alias(pos, item)
    return df.select(*keep, made).filter(F.col(item).isNotNull())


def mask_token(label: Column) -> Column:
    return F.concat(F.lit("["), F.replace(F.upper(label), F.lit(" "), F.lit("_")), F.lit("]"))


def replace_spans(text: Column, spans: Column, token) -> Column:
    """Struct of the new text and the given spans at their new offsets.

    ``spans`` must be sorted and free of overlaps; ``token(span)`` gives the substitute, and null leaves that span as it
    is. The substitutes are an expression; texts are put together on Arrow batches, where cutting a text at a span does
    not read it from its beginning, and offsets are prefix sums over a batch.
    """
    made = T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", ENTITIES)])

    def run(texts: pa.Array, given: pa.Array, news: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(given), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        label, start, end, score, _ = given.flatten().flatten()
        value = news.flatten().cast(pa.string())
        begin, finish = (pc.fill_null(x, 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (start, end))
        width = pc.fill_null(pc.utf8_length(value), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        grown = np.concatenate([[0], np.cumsum(width - (finish - begin))])
        moved = begin + grown[:-1] - np.repeat(grown[ends[:-1]], sizes)
        out = []
        for i, one in enumerate(texts):
            old = one.as_py()
            if old is not None and sizes[i]:
                own, parts, last = slice(ends[i], ends[i + 1]), [], 0
                for s, e, new in zip(begin[own].tolist(), finish[own].tolist(), value[own.start : own.stop].to_pylist()):
                    parts += [old[last:s], new or ""]
                    last = e
                old = "".join(parts) + old[last:]
            out.append(old)
        fields = [label.cast(pa.string()), pa.array(moved, pa.int32()), pa.array(moved + width, pa.int32()), score, value]
        placed = pa.StructArray.from_arrays(fields, names=["label", "start", "end", "score", "value"])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), placed)
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), lists], names=["text", "spans"])

    news = F.transform(spans, lambda e: F.coalesce(token(e), e["value"]))
    return F.arrow_udf(run, made)(text, spans, news)


def lookup(keys: Column, table: dict, default: Column) -> Column:
    """A ``when`` chain over a small fixed table."""
    out = functools.reduce(
        lambda acc, kv: acc.when(keys == F.lit(kv[0]), F.lit(kv[1])), table.items(), F
    )
    return out.otherwise(default) if table else default
