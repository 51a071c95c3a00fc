"""Questions that each text has about all the others, answered by range of a 64-bit key.

1. `pack` writes the rows once, in units of about UNIT_BYTES of text.
2. `ask`: a pass over the units gives each unit's keys in order, with a number for each.
   They are dealt out by ranges of the keys, as differences by byte place, compressed:
   a key that many texts have is one row a unit, so it gathers nowhere.
3. `answers`: a task has all questions of its range and gives each a bit. Bits go back
   in the order of the questions, without keys.
4. `attach` brings them to the units: as a broadcast while they are few bytes, else both
   are shuffled. `recall` lays them beside the keys, which the unit makes again.

All of it grows with the input alone; units that many tasks share and tables of keys on
the driver are not needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, materialize

#: Bytes of text in a unit, a row counted with ROW_BYTES more.
UNIT_BYTES, ROW_BYTES = 16_000_000, 16
#: Bytes of text for each range of keys, at most.
PART_BYTES = 32_000_000
#: Bytes of a row where MAX_BROADCAST_ROWS bounds a broadcast.
BROADCAST_ROW = 16
#: Units of one task are so many numbers apart.
_STEP = 2**31 - 1


def squeeze(x: np.ndarray) -> bytes:
    """The numbers' bytes by place, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def expand(data: bytes, kind: type) -> np.ndarray:
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def squeeze_keys(keys: np.ndarray) -> bytes:
    """Keys in ascending order."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def expand_keys(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data, np.uint64), dtype=np.uint64)


class Groups:
    """Equal keys: the distinct ones in order, and the group of each. At most 2^31 at once, as units and ranges hold far fewer."""

    def __init__(self, x: np.ndarray):
        order = np.argsort(x)
        s = x[order]
        new = np.ones(len(x), bool)
        new[1:] = s[1:] != s[:-1]
        self.start, self.keys = np.flatnonzero(new), s[new]
        del s
        self.of = np.empty(len(x), np.int32)
        self.of[order] = np.cumsum(new, dtype=np.int32) - 1
        self.order = order.astype(np.int32)

    def fold(self, how: np.ufunc, x: np.ndarray) -> np.ndarray:
        """how (np.minimum, np.add, ...) over the numbers of each group."""
        return how.reduceat(x[self.order], self.start) if len(x) else x


def pack(docs: DataFrame, size: int | None = None) -> DataFrame:
    """docs in units, written once: unit, size (bytes of text, and ROW_BYTES a row), data."""
    size = size or UNIT_BYTES
    schema = pa.schema([("unit", pa.int64()), ("size", pa.int64()), ("data", pa.binary())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, n = TaskContext.get().partitionId(), [], 0

        def row():
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((unit, n, sink.getvalue().to_pybytes()), schema.types, strict=True)], schema=schema)

        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW_BYTES)
            start, before = 0, 0
            while start < b.num_rows:
                stop = min(b.num_rows, int(np.searchsorted(ends, before + size - n)) + 1)
                held.append(b.slice(start, stop - start))
                n, before, start = n + int(ends[stop - 1]) - before, int(ends[stop - 1]), stop
                if n >= size:
                    yield row()
                    unit, held, n = unit + _STEP, [], 0
        if held:
            yield row()

    return materialize(docs.mapInArrow(work, "unit long, size long, data binary"), "units")


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def part_count(units: DataFrame) -> int:
    """Ranges of keys: as many as shuffle partitions, more where a range would serve over PART_BYTES of text."""
    size = units.agg(F.sum("size")).first()[0] or 0
    return max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def edges(keys: np.ndarray, parts: int, shift: int = 0) -> np.ndarray:
    """Where each range begins among the ascending keys, and their number; ranges begin at multiples of 2^shift."""
    bounds = np.array([(p << 64) // parts >> shift << shift for p in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


Question = tuple[np.ndarray, np.ndarray]


def ask(units: DataFrame, questions: Callable[[dict], Sequence[Question]], parts: int, shift: int = 0) -> DataFrame:
    """For each of a unit's questions (its kind is its place): ascending keys and a number for each, dealt by range."""
    schema = pa.schema([("unit", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("numbers", pa.binary())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            out = []
            for kind, (keys, numbers) in enumerate(questions(row)):
                at = edges(keys, parts, shift)
                out += [(row["unit"], kind, p, squeeze_keys(keys[at[p] : at[p + 1]]), squeeze(numbers[at[p] : at[p + 1]])) for p in np.flatnonzero(np.diff(at)).tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return units.mapInArrow(work, "unit long, kind int, part int, keys binary, numbers binary").repartitionById(parts, "part")


def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time as Python objects."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


Judge = Callable[[np.ndarray, np.ndarray], np.ndarray]


def elsewhere(keys: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Whether other units have the key too, or one that has it says that there are more in itself."""
    g = Groups(keys)
    return (g.fold(np.add, 1 + more) > 1)[g.of]


def differing(keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether the key has more than one number."""
    g = Groups(keys)
    return (g.fold(np.minimum, numbers) < g.fold(np.maximum, numbers))[g.of]


def earlier(keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether the key has a smaller number elsewhere."""
    g = Groups(keys)
    return g.fold(np.minimum, numbers)[g.of] < numbers


def answers(asked: DataFrame, judges: Sequence[Judge]) -> DataFrame:
    """A bit for each question, by the judge of its kind; written once."""
    schema = pa.schema([("unit", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("bits", pa.binary())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(rows(batches))
        for kind, judge in enumerate(judges):
            own = [r for r in held if r["kind"] == kind]
            if not own:
                continue
            keys = [expand_keys(r["keys"]) for r in own]
            bits = judge(np.concatenate(keys), np.concatenate([expand(r["numbers"], np.int64) for r in own]))
            each = np.split(bits, np.cumsum([len(k) for k in keys])[:-1])
            columns = [r["unit"] for r in own], [kind] * len(own), [r["part"] for r in own], [squeeze(np.packbits(x)) for x in each]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types, strict=True)], schema=schema)

    return materialize(asked.mapInArrow(work, "unit long, kind int, part int, bits binary"), "answers")


def attach(units: DataFrame, given: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """units with a column for each of the given answers: broadcast while they have at most limit (else MAX_BROADCAST_ROWS) times BROADCAST_ROW bytes."""
    for name, found in given.items():
        values = [c for c, kind in found.dtypes if kind == "binary"]
        size = found.agg(F.sum(sum(F.octet_length(c) for c in values))).first()[0] or 0
        each = found.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("kind", "part", *values))).alias(name))
        few = size <= BROADCAST_ROW * (MAX_BROADCAST_ROWS if limit is None else limit)
        units = units.join(F.broadcast(each) if few else each.hint("shuffle_hash"), "unit", "left")
    return units


def recall(given: list[dict] | None, kind: int, keys: np.ndarray, parts: int) -> np.ndarray:
    """The answers to a unit's questions of a kind, beside its keys."""
    out, at, n = np.zeros(len(keys), bool), edges(keys, parts), 0
    for x in given or ():
        if x["kind"] == kind:
            a, b = at[x["part"]], at[x["part"] + 1]
            out[a:b] = np.unpackbits(expand(x["bits"], np.uint8), count=b - a)
            n += b - a
    if n != len(keys):
        raise RuntimeError(f"{n} of {len(keys)} questions have an answer")
    return out
