"""Mean, population deviation and slope over the last n rows, with the same work a row whatever n is.

A trajectory is cut into runs of n rows.  Any window of n rows is the end of one run and the beginning of the next, so it is
put together from two stacks: moments of each run's beginnings, taken row by row from the left, and of its ends, taken from the
right.  Nothing is ever subtracted: moments grow by the update for one more value and are joined by the rule for two samples,
so a large value leaves no trace in the windows that don't hold it, and long trajectories lose no digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: n, means of x and y, sums of squares and of products about the means, and the sum of y.
Moments = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def grown(m: Moments, x: np.ndarray, y: np.ndarray, there: np.ndarray) -> Moments:
    """Moments with one more value each, where there is one."""
    n, mx, my, xx, yy, xy, total = m
    n = n + there
    dx, dy, share = (x - mx) * there, np.where(there, y - my, 0.0), there / np.maximum(n, 1)
    mx, my = mx + dx * share, my + dy * share
    rest = np.where(there, y - my, 0.0)
    return n, mx, my, xx + dx * (x - mx), yy + dy * rest, xy + dx * rest, total + np.where(there, y, 0.0)


def merged(a: Moments, b: Moments) -> Moments:
    """Moments of two samples together."""
    n = a[0] + b[0]
    dx, dy, share = b[1] - a[1], b[2] - a[2], b[0] / np.maximum(n, 1)
    w = a[0] * share
    return n, a[1] + dx * share, np.where(a[0] > 0, a[2] + dy * share, b[2]), a[3] + b[3] + w * dx * dx, np.where(w > 0, a[4] + b[4] + w * dy * dy, a[4] + b[4]), np.where(w > 0, a[5] + b[5] + w * dx * dy, a[5] + b[5]), a[6] + b[6]


def scanned(x: np.ndarray, y: np.ndarray, there: np.ndarray) -> list[np.ndarray]:
    """Moments of the first 1, 2, ... values of each run; arrays are (runs, n, columns)."""
    runs, n, columns = y.shape
    out = [np.zeros((runs, n, columns)) for _ in range(7)]
    m: Moments = tuple(np.zeros((runs, columns)) for _ in range(7))
    for k in range(n):
        m = grown(m, x[:, k], y[:, k], there[:, k])
        for full, part in zip(out, m, strict=True):
            full[:, k] = part
    return out


def windows_of(y: np.ndarray, begins: np.ndarray, n: int) -> Moments:
    """Moments over the last n rows of the same trajectory, for each row and column; x is the row's number.

    begins has the first row of each trajectory; null values, NaN here, are left out."""
    rows, columns = y.shape
    sizes = np.diff(np.r_[begins, rows])
    padded = -(-sizes // n) * n  # each trajectory fills whole runs
    start = np.cumsum(padded) - padded
    place = np.repeat(start - begins, sizes) + np.arange(rows)
    offset = np.arange(rows) - np.repeat(begins, sizes)
    total = int(padded.sum())
    full, x = np.zeros((total, columns)), np.zeros((total, 1))
    there = np.zeros((total, columns), bool)
    full[place], x[place, 0], there[place] = np.nan_to_num(y, nan=0.0, posinf=np.inf, neginf=-np.inf), offset, ~np.isnan(y)
    shape = lambda a: a.reshape(-1, n, a.shape[1])
    heads = [a.reshape(total, columns)[place] for a in scanned(shape(x), shape(full), shape(there))]
    tails = [a[:, ::-1].reshape(total, columns) for a in scanned(shape(x)[:, ::-1], shape(full)[:, ::-1], shape(there)[:, ::-1])]
    # the end of the run before, from n - 1 rows back on; nothing in the first run, or where a run is whole
    back = (offset >= n) & (offset % n != n - 1)
    ends = [np.where(back[:, None], a[np.maximum(place - n + 1, 0)], 0.0) for a in tails]
    return merged(tuple(ends), tuple(heads))


def statistics(y: np.ndarray, begins: np.ndarray, n: int, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean (NaN of nothing), population deviation and slope per unit of time (0 where they can't be told)."""
    count, _, _, xx, yy, xy, total = windows_of(y, begins, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(count > 0, total / count, np.nan)
        deviation = np.where(count > 0, np.sqrt(np.maximum(yy, 0) / np.maximum(count, 1)), 0.0)
        slope = np.where(xx > 0, xy / np.where(xx > 0, xx, 1) / step, 0.0)
    return mean, deviation, slope


def appended(batches: Iterator[pa.RecordBatch], columns: list[str], windows: tuple[int, ...], entity: str, order: str, step: float, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """The kept columns of rows that aren't halo, with statistics per column and window; rows come by entity, block and position.

    A batch is looked at together with the last rows of the one before.  A place that repeats in a trajectory is an error."""
    reach = max(windows) - 1
    tail: pa.RecordBatch | None = None
    for batch in batches:
        if not len(batch):
            continue
        old = len(tail) if tail is not None else 0
        both = pa.concat_batches([tail, batch]) if old else batch
        of = lambda name: both.column(both.schema.get_field_index(name))  # noqa: B023, E731
        code = of(entity).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        block, position = of("_block").to_numpy(), of("position").to_numpy()
        new = (code[1:] != code[:-1]) | (block[1:] != block[:-1])
        places = of(order).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        if np.any(~new & (places[1:] == places[:-1])):
            raise ValueError(f"repeated {order} in a trajectory")
        begins = np.flatnonzero(np.r_[True, new])
        y = np.stack([of(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1)
        made = {}
        for n in windows:
            for kind, values in zip(("mean", "std", "slope"), statistics(y, begins, n, step), strict=True):
                made |= {f"{c}_roll_{kind}_{n}": values[:, j] for j, c in enumerate(columns)}
        own = np.flatnonzero(~of("_halo").to_numpy(zero_copy_only=False)[old:]) + old
        take = pa.array(own)
        names = [f"{c}_roll_{kind}_{n}" for c in columns for n in windows for kind in ("mean", "std", "slope")]
        yield pa.RecordBatch.from_arrays([of(c).take(take) for c in keep] + [pa.array(made[c][own], from_pandas=True) for c in names], names=[*keep, *names])
        tail = both.slice(max(int(begins[-1]), len(both) - reach)) if reach else None


def rounded(batch: pa.RecordBatch, digits: int) -> pa.RecordBatch:
    """batch with its doubles rounded as SQL does it: times a power of ten, half away from zero, and back; no negative zero."""
    scale, out = 10.0**digits, []
    for column in batch.columns:
        if pa.types.is_float64(column.type):
            x = column.to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                y = x * scale
                r = np.rint(y)
                r = np.where(np.abs(y - r) == 0.5, y + np.copysign(0.5, y), r) / scale + 0.0
            column = pa.array(np.where(np.isfinite(y), r, x), mask=column.is_null().to_numpy(zero_copy_only=False))
        out.append(column)
    return pa.RecordBatch.from_arrays(out, names=batch.schema.names)
