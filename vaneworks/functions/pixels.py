"""Image arrays, a batch at a time: Arrow UDFs over the contiguous values of many images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DOUBLES = T.ArrayType(T.DoubleType())


def lists(values: np.ndarray, known: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """One list per row from consecutive ``values``; rows that are not ``known`` are NULL and take no values."""
    ends = np.concatenate([[0], np.cumsum(np.where(known, sizes, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array(~known))


def _values(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def _standardised(pixels: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(pixels), 0).to_numpy(zero_copy_only=False)
    full = sizes > 0
    lengths = sizes[full]
    values = _values(pixels)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    means = np.add.reduceat(values, starts) / lengths if len(lengths) else lengths
    centred = values - np.repeat(means, lengths)
    squares = np.add.reduceat(centred * centred, starts) if len(lengths) else lengths.astype(np.float64)
    usable = (lengths > 1) & (squares > 0)
    deviation = np.sqrt(squares[usable] / (lengths[usable] - 1))
    kept = centred[np.repeat(usable, lengths)] / np.repeat(deviation, lengths[usable])
    known = np.zeros(len(sizes), dtype=bool)
    known[full] = usable
    return lists(kept, known, sizes)


@F.arrow_udf(_DOUBLES)
def standardise_image(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``(x - mean) / deviation`` over all pixels of an image, with the sample deviation; NULL for a constant image.

    Images of a batch may differ in size: each is a segment of the batch's values.
    """
    for pixels in batches:
        yield _standardised(pixels)


def _cell_matrix(size: int, grid: int) -> np.ndarray:
    """(size, grid) averaging weights: pixel ``r`` belongs to cell ``r * grid // size``."""
    cell = np.arange(size) * grid // size
    member = (cell[:, None] == np.arange(grid)[None, :]).astype(np.float64)
    return member / member.sum(axis=0)


def _pooling(channels: int, height: int, width: int, grid: int) -> Callable[[pa.Array], pa.Array]:
    """Cell means of a batch of images: one block of memory, averaged with two small matrix products."""
    if grid < 1 or grid > min(height, width):
        raise ValueError("grid must be between 1 and the image size")
    size, cells = channels * height * width, channels * grid * grid
    rows, cols = _cell_matrix(height, grid), _cell_matrix(width, grid)

    def pooled(pixels: pa.Array) -> pa.Array:
        fits = pc.fill_null(pc.equal(pc.list_value_length(pixels), size), False)
        block = _values(pixels.filter(fits)).reshape(-1, channels, height, width)
        values = np.matmul(np.matmul(block, cols).swapaxes(2, 3), rows).swapaxes(2, 3)
        known = fits.to_numpy(zero_copy_only=False)
        return lists(values.ravel(), known, np.full(len(known), cells))

    return pooled


def cell_means(channels: int, height: int, width: int, grid: int):
    """Arrow UDF: mean of every cell of a ``grid`` x ``grid`` raster per channel, in (channel, row, column) order.

    An image of another size gives NULL.
    """
    pooled = _pooling(channels, height, width, grid)

    @F.arrow_udf(_DOUBLES)
    def means(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pixels in batches:
            yield pooled(pixels)

    return means


def stacked_cells(channels: int, height: int, width: int, grid: int):
    """Arrow UDF over arrays of images: each image standardised, then its cell means; NULL in place of one of another size or a constant one."""
    pooled = _pooling(channels, height, width, grid)

    @F.arrow_udf(T.ArrayType(_DOUBLES))
    def stacked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for stacks in batches:
            sizes = pc.fill_null(pc.list_value_length(stacks), 0).to_numpy(zero_copy_only=False)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.ListArray.from_arrays(ends, pooled(_standardised(stacks.flatten())), mask=pc.is_null(stacks))

    return stacked
