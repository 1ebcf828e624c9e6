"""First-fit selection in time order, distributed over chunks of one key.

The rule: walk the rows of a key in order; accept a row when its ``start`` is at or after the ``limit``
of the last accepted row. A cooldown has limit = ts + gap, non-overlapping trades have limit = exit.

A stretch of rows acts as a step function "limit coming in -> limit going out" (neighbouring starts that lead to the same
outcome are one step), and step functions compose. So chunks are reduced to their functions, a tree composes ``FAN``
neighbours at a time, its top turns each key's first limit into the limits that enter the top nodes, and these go down the
tree to every chunk, which marks its rows. No task walks a key: the top has one node per ``FAN ** (levels - 1)`` chunks.

Rows pass through Python in Arrow batches, sorted by group. A chunk of more than ``ROWS`` rows is reduced in pieces and
marking carries nothing but the last limit, so memory is bounded by the batch whatever the chunk's width.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import by_group, ints, spans
from .scan import CHUNK, chunk_of

_FLOOR = -(2 ** 62)
FAN, LEVELS = 64, 3
_HORIZON = 2 ** 41  # milliseconds up to the year 2039: how many chunks there may be


def _links(start: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Index of the row accepted after each row, len(start) when it lies beyond the chunk."""
    return np.maximum(np.searchsorted(start, limit, side="left"), np.arange(1, len(start) + 1))


def steps(start: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(upper, out): an incoming limit <= upper[i] (and above upper[i-1]) leaves as out[i]; one above all stays."""
    following = _links(start, limit)
    out = limit.copy()
    for i in range(len(start) - 1, -1, -1):
        if following[i] < len(start):
            out[i] = out[following[i]]
    return _merged(start, out)


def _merged(upper: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(out):
        first = np.r_[True, upper[1:] != upper[:-1]]  # of equal starts the first decides
        upper, out = upper[first], out[first]
        last = np.r_[out[1:] != out[:-1], True]
        upper, out = upper[last], out[last]
    return upper, out


def apply(upper: np.ndarray, out: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The step function's values at ``limit``."""
    at = np.searchsorted(upper, limit, side="left")
    inside = at < len(upper)
    return np.where(inside, out[np.minimum(at, len(out) - 1)], limit) if len(out) else limit


def compose(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The step function of ``first`` and then ``then``."""
    beyond = then[0] > (first[0][-1] if len(first[0]) else _FLOOR)
    return _merged(np.r_[first[0], then[0][beyond]], np.r_[apply(*then, first[1]), then[1][beyond]])


def accepted(start: np.ndarray, limit: np.ndarray, entering: int) -> np.ndarray:
    keep = np.zeros(len(start), bool)
    following = _links(start, limit)
    i = int(np.searchsorted(start, entering, side="left"))
    while i < len(start):
        keep[i] = True
        i = int(following[i])
    return keep


def _reduce(part: list[str]) -> Callable[[pa.Table, np.ndarray], Iterator[pa.Table]]:
    """Rows (part, _seed, _s, _l) to steps (part, _seed, _piece, _upper, _out). Pieces of a long group are numbered by their
    place in the stream, which is in order."""
    piece = 0

    def fn(table: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        nonlocal piece
        start, limit = ints(table.column("_s")), ints(table.column("_l"))
        at, pieces, uppers, outs = [], [], [], []
        for lo, hi in spans(starts, table.num_rows):
            upper, out = steps(start[lo:hi], limit[lo:hi])
            piece += 1
            at.append(np.full(len(upper), lo))
            pieces.append(np.full(len(upper), piece))
            uppers.append(upper)
            outs.append(out)
        yield _table(table.select([*part, "_seed"]).take(np.concatenate(at)), _piece=pieces, _upper=uppers, _out=outs)

    return fn


def _table(head: pa.Table, **columns: list[np.ndarray]) -> pa.Table:
    for name, parts in columns.items():
        head = head.append_column(name, pa.array(np.concatenate(parts)))
    return head


def _functions(table: pa.Table, lo: int, hi: int, child: str) -> list[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """(row, function) of each child in rows lo..hi, its pieces composed."""
    names, pieces = ints(table.column(child))[lo:hi], ints(table.column("_piece"))[lo:hi]
    upper, out = ints(table.column("_upper"))[lo:hi], ints(table.column("_out"))[lo:hi]
    found: list[tuple[int, tuple[np.ndarray, np.ndarray]]] = []
    cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]) | (pieces[1:] != pieces[:-1])) + 1).tolist(), hi - lo]
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = (upper[a:b], out[a:b])
        if found and names[found[-1][0] - lo] == names[a]:
            found[-1] = (found[-1][0], compose(found[-1][1], own))
        else:
            found.append((lo + a, own))
    return found


def _compose_children(keys: list[str], node: str, child: str) -> Callable[[pa.Table, np.ndarray], Iterator[pa.Table]]:
    """Functions of children (keys, child, node, _seed, _piece, _upper, _out) to those of their nodes."""
    piece = 0

    def fn(table: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        nonlocal piece
        at, pieces, uppers, outs = [], [], [], []
        for lo, hi in spans(starts, table.num_rows):
            whole = None
            for _, own in _functions(table, lo, hi, child):
                whole = own if whole is None else compose(whole, own)
            piece += 1
            at.append(np.full(len(whole[0]), lo))
            pieces.append(np.full(len(whole[0]), piece))
            uppers.append(whole[0])
            outs.append(whole[1])
        yield _table(table.select([*keys, node, "_seed"]).take(np.concatenate(at)), _piece=pieces, _upper=uppers, _out=outs)

    return fn


def _enter_children(keys: list[str], child: str, entering: str) -> Callable[[pa.Table, np.ndarray], Iterator[pa.Table]]:
    """Functions of a node's children and the limit that enters the node to (keys, child, _enter)."""
    limit, last = np.zeros(1, np.int64), None

    def fn(table: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        nonlocal limit, last
        at, limits, begins = [], [], set(starts.tolist())
        names = ints(table.column(child))
        for lo, hi in spans(starts, table.num_rows):
            if lo in begins:
                limit, last = ints(table.column(entering).slice(lo, 1)), None
            for row, own in _functions(table, lo, hi, child):
                if names[row] != last:  # else the rest of a child whose first part came before
                    at.append(row)
                    limits.append(limit)
                last, limit = names[row], apply(*own, limit)
        yield _table(table.select([*keys, child]).take(np.array(at, np.int64)), _enter=limits or [np.zeros(0, np.int64)])

    return fn


def greedy_select(df: DataFrame, keys: Sequence[str], start: str, limit: str, ties: Sequence[str] = (),
                  *, width: int, seed: str | None = None, levels: int | None = None) -> DataFrame:
    """Add ``accepted``. ``limit`` must exceed ``start``; rows without either are not accepted. ``ties`` order equal
    starts; ``seed`` names a column holding the key's limit before its first row. ``width`` and ``levels`` (of the tree;
    from the width by default) spread the work and decide nothing."""
    keys, order = list(keys), [start, *ties]
    if levels is None:
        levels = max(1, min(LEVELS, math.ceil(math.log(max(_HORIZON / width, 2)) / math.log(FAN))))
    known = F.col(start).isNotNull() & F.col(limit).isNotNull()
    rows = df.withColumn(CHUNK, chunk_of(start, width))
    first = F.coalesce(F.col(seed).cast("bigint"), F.lit(_FLOOR)) if seed else F.lit(_FLOOR)
    lean = rows.where(known).select(*keys, CHUNK, F.col(start).cast("bigint").alias("_s"), F.col(limit).cast("bigint").alias("_l"), first.alias("_seed"),
                                    *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    long_ = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    fields = [df.schema[k] for k in keys]
    tail = long_("_seed", "_piece", "_upper", "_out")
    own = by_group(lean, [*keys, CHUNK], [f"_o{i}" for i in range(len(order))], _reduce([*keys, CHUNK]), T.StructType([*fields, *long_(CHUNK), *tail]), True)

    # Up the tree: nodes of level i hold FAN ** i chunks.
    names, tables = [CHUNK], [own]
    for i in range(1, levels):
        node, child = f"_n{i}", names[-1]
        up = tables[-1].withColumn(node, F.floor(F.col(child) / FAN).cast("bigint"))
        tables[-1] = up
        tables.append(by_group(up, [*keys, node], [child, "_piece", "_upper"], _compose_children(keys, node, child), T.StructType([*fields, *long_(node), *tail]), True))
        names.append(node)
    # The top: one group per key; then down, one group per node.
    enter = lambda table, part, child, entering: by_group(table, part, [child, "_piece", "_upper"], _enter_children(keys, child, entering), T.StructType([*fields, *long_(child, "_enter")]), True)
    entering = enter(tables[-1], keys, names[-1], "_seed")
    for i in range(levels - 2, -1, -1):
        node = names[i + 1]
        above = entering.select(*[F.col(c).alias(f"_k_{c}") for c in (*keys, node)], "_enter")
        same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*keys, node)]
        entering = enter(tables[i].join(above, same).drop(*[f"_k_{c}" for c in (*keys, node)]), [*keys, node], names[i], "_enter")

    named = entering.select(*[F.col(c).alias(f"_k_{c}") for c in (*keys, CHUNK)], "_enter")
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*keys, CHUNK)]
    joined = rows.join(named, same, "left").select(*df.columns, CHUNK, "_enter", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    state, columns = _FLOOR, df.columns

    def mark(table: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        nonlocal state
        keep = np.zeros(table.num_rows, bool)
        full = table.column(start).is_valid().to_numpy() & table.column(limit).is_valid().to_numpy()
        begins = set(starts.tolist())
        for lo, hi in spans(starts, table.num_rows):
            at = lo + np.flatnonzero(full[lo:hi])
            if not len(at):
                continue
            if lo in begins:
                state = table.column("_enter")[int(at[0])].as_py()
            part = table.take(at)
            limits = ints(part.column(limit))
            keep[at] = accepted(ints(part.column(start)), limits, state)
            taken = np.flatnonzero(keep[at])
            state = int(limits[taken[-1]]) if len(taken) else state
        yield table.select(columns).append_column("accepted", pa.array(keep))

    out = T.StructType([*df.schema.fields, T.StructField("accepted", T.BooleanType())])
    return by_group(joined, [*keys, CHUNK], [f"_o{i}" for i in range(len(order))], mark, out, False)
