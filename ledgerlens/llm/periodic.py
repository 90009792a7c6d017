"""Periodic runs of words, found with a suffix automaton and link-cut access.

A run is a stretch of consecutive words with smallest period q that no
neighbouring word extends keeping that period. Reported are the runs of
``LEAST_POWER`` periods and ``LEAST_WORDS`` words or more.

Method: the suffix automaton of the words gives a tree of suffix links. Words
are appended one by one; each time the path from the new prefix's state to the
root is *accessed* as in a link-cut tree, whose preferred paths (splay trees)
hold the states that occurred last at the same end. Access meets every segment
of the path once and recolours it with the new end. A segment holds the
suffixes of lengths (low, high] that ended before at one place, d words
earlier. Where low < d <= high the last 2d words are a square with primitive
root, and as high is the longest common suffix of the two ends, the repetition
of period d begins ``high`` words before the earlier end: all that follows is
to keep the last end at which (begin, d) is met, which is the run's right end.

A run of four periods holds each of its 3-word windows three times at least, so
words outside stretches whose windows are that frequent within the stretch can
be in no run; automata are built for those stretches alone (``stretches``). A
document without repeated windows costs one sort of its windows.

Bounds: a task holds one Arrow batch and the automaton of one stretch (about
0.7 KB a word); there is no shuffle, and a lost task reads its rows again.

Defined cases: a null text has no words, no runs and the collapsed text ''. An
empty text and one of separators only are the same. Repeated rows give repeated
results. An empty table gives no rows. Texts of any length are handled whole,
each in one task. Other columns are passed through by ``collapse``, whatever
their names, and not read by ``runs``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import unused

LEAST_POWER = 4
LEAST_WORDS = 6

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

#: Bytes of results that a task gathers before it hands them on.
_OUT_BYTES = 32 << 20


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links, longest lengths and the state of each prefix; states count from 1 (the root), 0 is none."""
    step: list[dict[int, int]] = [{}, {}]
    link, length, prefix = [0, 0], [0, 0], []
    last = 1
    for w in words:
        new = len(length)
        length.append(length[last] + 1)
        link.append(1)
        step.append({})
        p = last
        while p and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p:
            q = step[p][w]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(step[q].copy())
                while p and step[p].get(w) == q:
                    step[p][w] = copy
                    p = link[p]
                link[q] = link[new] = copy
        prefix.append(new)
        last = new
    return link, length, prefix


def repetitions(words: list[int]) -> dict[tuple[int, int], int]:
    """(begin, period) -> end (past the last word) of every run of two periods or more."""
    link, length, prefix = automaton(words)
    up = link  # a splay root's path parent, or the parent inside the splay tree
    left, right, colour = [0] * len(up), [0] * len(up), [0] * len(up)
    found: dict[tuple[int, int], int] = {}
    for end, state in enumerate(prefix, 1):
        below, x = 0, state
        while x:
            # Bring x to the root of its path's splay tree; the root carries the path's colour.
            p = up[x]
            while p and (left[p] == x or right[p] == x):
                g = up[p]
                inner = left[p] == x
                if g and (left[g] == p or right[g] == p):
                    far = up[g]
                    outer = left[g] == p
                    colour[x] = colour[g]
                    if inner == outer:  # same side twice: p over g, then x over p
                        if inner:
                            a = left[g] = right[p]
                            right[p] = g
                            b = left[p] = right[x]
                            right[x] = p
                        else:
                            a = right[g] = left[p]
                            left[p] = g
                            b = right[p] = left[x]
                            left[x] = p
                        if a:
                            up[a] = g
                        if b:
                            up[b] = p
                        up[g] = p
                        up[p] = x
                    else:
                        if inner:  # p is g's right child, x is p's left
                            a = right[g] = left[x]
                            left[x] = g
                            b = left[p] = right[x]
                            right[x] = p
                        else:
                            a = left[g] = right[x]
                            right[x] = g
                            b = right[p] = left[x]
                            left[x] = p
                        if a:
                            up[a] = g
                        if b:
                            up[b] = p
                        up[g] = up[p] = x
                    up[x] = far
                    if far:
                        if left[far] == g:
                            left[far] = x
                        elif right[far] == g:
                            right[far] = x
                    p = far
                else:
                    colour[x] = colour[p]
                    if inner:
                        b = left[p] = right[x]
                        right[x] = p
                    else:
                        b = right[p] = left[x]
                        left[x] = p
                    if b:
                        up[b] = p
                    up[p] = x
                    up[x] = g
                    p = g
                    break
            before = colour[x]
            if before:
                d = end - before
                if length[p] < d <= length[x]:
                    found[before - length[x], d] = end
            cut = right[x]
            if cut:
                colour[cut] = before
            right[x] = below
            below, x = x, p
        colour[below] = end
    return found


def stretches(words: np.ndarray, kinds: int) -> list[tuple[int, int]]:
    """[begin, end) of the stretches in which every 3-word window is found three times or more.

    Runs of LEAST_POWER periods and LEAST_WORDS words lie in one of them. Each
    pass cuts the stretches where a window is too rare in its stretch.
    """
    n = len(words)
    if n < LEAST_WORDS or n - kinds < 3:
        return []
    pair = words[:-1] * kinds + words[1:]
    if kinds > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    code = pair[:-1] * kinds + words[2:]
    at = np.arange(n - 2)
    for _ in range(16):
        _, code, count = np.unique(code, return_inverse=True, return_counts=True)
        often = count[code] >= 3
        whole = bool(often.all())
        at, code = at[often], code[often]
        group = np.cumsum(np.diff(at, prepend=-2) != 1) - 1
        enough = np.bincount(group, minlength=1)[group] >= LEAST_WORDS - 2 if len(at) else np.zeros(0, dtype=bool)
        at, code, group = at[enough], code[enough], group[enough]
        if not len(at) or (whole and enough.all()):
            break
        code = group * (int(code.max()) + 1) + code
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) != 1)
    return list(zip(at[np.append(0, cut + 1)].tolist(), (at[np.append(cut, len(at) - 1)] + 3).tolist(), strict=True))


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of words, by start, then period."""
    number: dict = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    out = []
    for a, b in stretches(np.array(ids, dtype=np.int64), len(number)):
        for (begin, d), end in repetitions(ids[a:b]).items():
            if end - begin >= max(LEAST_WORDS, LEAST_POWER * d):
                out.append((a + begin, end - begin, d))
    out.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def _scan(text: str, runs_name: str, text_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, held, all_runs, texts = 0, 0, [], []
            values = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())

            def out(b: int, a: int, all_runs: list, texts: list, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                part = batch.slice(a, b - a)
                columns = [*part.columns, pa.array(all_runs, _RUNS), pa.array(texts, pa.binary()).cast(pa.string())]
                return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, runs_name, text_name])

            for i, value in enumerate(values, 1):
                words = (value.as_py() or b"").split()
                runs = runs_of(words)
                texts.append(b" ".join(collapsed(words, runs)))
                all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                held += len(texts[-1]) + 64 * len(runs)
                if held > _OUT_BYTES:
                    yield out(i, a, all_runs, texts)
                    a, held, all_runs, texts = i, 0, [], []
            if a < len(batch):
                yield out(len(batch), a, all_runs, texts)

    return run


def _scanned(docs: DataFrame, text: str, runs_name: str, text_name: str) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField(runs_name, T._parse_datatype_string(RUNS)), T.StructField(text_name, T.StringType())])
    return docs.mapInArrow(_scan(text, runs_name, text_name), schema)


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and collapsed (the kept words, one space between)."""
    return _scanned(docs.select("doc_id", "text"), "text", "runs", "collapsed")


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with the text of documents that hold a run replaced by its kept words; other texts stay as they are."""
    found, kept = unused(docs, "runs", "kept")
    out = _scanned(docs, "text", found, kept)
    return out.withColumn("text", F.when(F.size(F.col(found)) > 0, F.col(kept)).otherwise(F.col("text"))).select(*[f"`{c}`" for c in docs.columns])


def greatest(found: Column) -> Column:
    """The run with the greatest exact length / period, then least start, then least period; null without runs."""
    more = lambda a, r: (r["length"] * a["period"] > a["length"] * r["period"])
    return F.aggregate(found, F.get(found, F.lit(0)), lambda a, r: F.when(more(a, r), r).otherwise(a))
