"""Work on large tables beside smaller ones, in place: the large one is never shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweir.operators.durable import stored

# Rows of the large table that a task holds at once, and of a smaller one.
_ROWS, _SCAN = 1 << 18, 1 << 17
# Of may_match: a bitmap has some 2^26 bits, 8 MB, whatever the tables.
_BITS, _PART = 1 << 26, 1 << 15


def beside(big: DataFrame, smalls: list[tuple[DataFrame, str]], work: Callable, schema: str) -> DataFrame:
    """What `work` makes of the rows of `big`, each beside its row of every smaller table.

    `smalls` has tables with the key that they are unique on and share with `big`. They are written once to the
    shared folder; a task reads all of them for every 262,144 of its rows, by pyarrow, and holds what these
    need, so its memory doesn't follow any table's size. work(chunks) gets an iterator of (rows, found...), a
    found being (place, table), a place for each row in a table of the rows found, -1 without one; it yields
    record batches of `schema`. For tables so large that their shuffle costs more than those reads.
    """
    laid = [(key, sorted(stored(small.filter(F.col(key).isNotNull()), tidy=True).inputFiles()), small.columns) for small, key in smalls]

    def look(rows: pa.Table, key: str, paths: list[str], columns: list[str]) -> tuple[np.ndarray, pa.Table | None]:
        from pyarrow import fs, parquet

        codes = rows[key].combine_chunks().dictionary_encode()
        place, found, n = np.full(len(codes.dictionary) + 1, -1), [], 0
        for path in paths:
            at, name = fs.FileSystem.from_uri(path)
            with at.open_input_file(name) as f:
                for b in parquet.ParquetFile(f).iter_batches(_SCAN, columns=columns, use_threads=False):
                    hit = pc.index_in(b[key], codes.dictionary)
                    some = np.flatnonzero(hit.is_valid().to_numpy(zero_copy_only=False))
                    if len(some) or not found:
                        place[hit.fill_null(-1).to_numpy()[some]] = n + np.arange(len(some))
                        found.append(b.take(pa.array(some)))
                        n += len(some)
        return place[codes.indices.fill_null(len(codes.dictionary)).to_numpy()], pa.Table.from_batches(found).combine_chunks() if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks():
            held, n = [], 0
            for b in batches:
                held.append(b)
                n += b.num_rows
                if n >= _ROWS:
                    rows = pa.Table.from_batches(held).combine_chunks()
                    held, n = [], 0
                    yield rows, *(look(rows, *x) for x in laid)
            if n:
                rows = pa.Table.from_batches(held).combine_chunks()
                yield rows, *(look(rows, *x) for x in laid)

        yield from work(chunks())

    return big.mapInArrow(run, schema)


def numbers(found: pa.Table | None, column: str, missing: float) -> np.ndarray:
    """A column of numbers of the rows found, and at its end, for place -1, what stands for a missing row."""
    return np.r_[found[column].to_numpy(), missing] if found is not None else np.array([missing])


def coded(rows: pa.Table, column: str) -> tuple[np.ndarray, pa.Array]:
    """(a code for each row, the values by code), null being a value."""
    codes = rows[column].combine_chunks().dictionary_encode(null_encoding="encode")
    return codes.indices.to_numpy(), codes.dictionary


def may_match(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `big` whose keys are in `small`, and a few others: for a join that then shuffles few rows.

    A broadcast bitmap of hashes, of 8 MB at most, decides; with some 1,000,000 keys in `small` one in 60 of
    the others passes.
    """
    number = F.pmod(F.xxhash64(*keys), F.lit(_BITS))
    maps = small.select(number.alias("_h")).groupBy(F.shiftright("_h", 15).alias("_part")).agg(F.bitmap_construct_agg(F.col("_h") % _PART).alias("_map"))
    byte = F.expr(f"cast(conv(hex(substring(_map, cast((_h % {_PART}) div 8 as int) + 1, 1)), 16, 10) as int)")
    bit = F.expr("cast(_h % 8 as int)")
    marked = big.withColumn("_h", number).withColumn("_part", F.shiftright("_h", 15)).join(F.broadcast(maps), "_part")
    return marked.filter(F.call_function("getbit", byte, bit) == 1).select(*big.columns)
