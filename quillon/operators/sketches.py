"""Distinct counts as sketches that tasks unite: a list of coupons while they are few, so exact, then HyperLogLog registers, compressed.

A coupon is 32 bits of a value's hash: 26 that place it (the last lg_k of them choose a register), and the rank of the rest.
Registers do not touch each other, so a sketch can be kept in slices of registers, one after the other: what an estimate
needs of a slice are sums.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACE = 26
#: Ranks a register can have, from 0 (nothing yet).
RANKS = 64 - PLACE + 2
#: What a register of each rank adds to an estimate's sum; the first and the last are counted.
WEIGHTS = np.array([0.0, *(2.0**-k for k in range(1, RANKS - 1)), 0.0])
#: What is told of registers: coupons of those that are kept as such, whether others are not, empty registers, those of the last rank, and the sum.
SUMS = "few int, dense int, c0 int, last int, z double"
LOG = np.dtype([("depth", "<i4"), ("few", "<i4"), ("dense", "<i4"), ("c0", "<i4"), ("last", "<i4"), ("z", "<f8")])
NAMES = LOG.names[1:]


def _hash(c: Column) -> Column:
    return F.xxhash64(c.cast("string"))


def _rank(c: Column) -> Column:
    return RANKS - 1 - F.length(F.bin(F.shiftrightunsigned(_hash(c), PLACE)))


def slice_of(c: Column, lg_k: int, lg_slices: int) -> Column:
    """The slice, of 2**lg_slices, that a value's register is in."""
    return F.shiftright(_hash(c).bitwiseAND(F.lit((1 << lg_k) - 1)), lg_k - lg_slices).cast("int")


def single(c: Column, here: Column, lg_m: int) -> dict[str, Column]:
    """A slice's state of one value, which is in the slice or not: the sketch, what is told of it, and that nothing has grown."""
    rank, one = _rank(c), F.when(here, 1).otherwise(0)
    last = F.when(here & (rank == RANKS - 1), 1).otherwise(0)
    z = F.when(here & (rank < RANKS - 1), F.pow(F.lit(2.0), -rank.cast("double"))).otherwise(0.0)
    return {"near": F.when(here, coupon(c)).otherwise(F.lit(b"s")), "few": one, "dense": F.lit(0), "c0": (1 << lg_m) - one, "last": last, "z": z, "log": F.lit(b"")}


def coupon(c: Column) -> Column:
    """The sketch of one value."""
    h, rank = _hash(c), _rank(c).cast("long")
    return F.concat(F.lit(b"s"), F.unhex(F.lpad(F.hex(F.shiftleft(rank, PLACE) + h.bitwiseAND(F.lit((1 << PLACE) - 1))), 8, "0")))


def _coupons(sketch: bytes) -> np.ndarray:
    return np.frombuffer(sketch, ">u4", offset=1).astype(np.int64)


def _registers(sketch: bytes, m: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(sketch[1:], decompressed_size=m, codec="zstd", asbytes=True), np.uint8)


def _fill(full: np.ndarray, at, coupons: np.ndarray) -> None:
    """Raises registers of rows `at` to the coupons."""
    np.maximum.at(full, (at, coupons & (full.shape[1] - 1)), (coupons >> PLACE).astype(np.uint8))


def estimate(c0: np.ndarray, last: np.ndarray, z: np.ndarray, lg_k: int) -> np.ndarray:
    """How many values registers have seen, by how many are empty and of the last rank, and the sum of the others (Ertl's improved raw estimator)."""
    m = float(1 << lg_k)
    x, y, tau = 1 - last / m, np.ones(len(c0)), last / m
    for _ in range(64):  # of the full registers
        x, y = np.sqrt(x), y / 2
        tau = tau - (1 - x) ** 2 * y
    tau = np.where((last == 0) | (last == m), 0.0, tau / 3) * m
    x, y = c0 / m, np.ones(len(c0))
    sigma = x.copy()
    for _ in range(64):  # of the empty ones
        x, y, sigma = x * x, y * 2, sigma + x * x * y
    return m * m / (2 * np.log(2)) / (tau / 2.0 ** (RANKS - 2) + z + m * sigma)


class _Block:
    """The unions of what has come for the places of a block: coupons, and registers of the places that have more."""

    def __init__(self, m: int, few: int):
        self.m, self.few, self.coupons = m, few, {}
        self.full, self.told = np.zeros((0, m), np.uint8), np.zeros(0, bool)

    def reach(self, n: int) -> None:
        if n > len(self.full):
            full, told = np.zeros((max(n, 2 * len(self.full)), self.m), np.uint8), np.zeros(max(n, 2 * len(self.full)), bool)
            full[: len(self.full)], told[: len(self.told)] = self.full, self.told
            self.full, self.told = full, told

    def add_coupons(self, sketch: bytes, places: list[int]) -> None:
        for at in places:
            own = self.coupons.get(at)
            if own is None:
                own = self.coupons[at] = bytearray(b"s")
            own += sketch[1:]
            if len(own) > 16 * self.few:
                found = np.unique(np.frombuffer(bytes(own), ">u4", offset=1))
                if len(found) > self.few:
                    _fill(self.full, at, found.astype(np.int64))
                    self.told[at], self.coupons[at] = True, bytearray(b"s")
                else:
                    self.coupons[at] = bytearray(b"s" + found.astype(">u4").tobytes())

    def add_registers(self, sketches: list[bytes], senders: np.ndarray, places: np.ndarray) -> None:
        """Each place's first sender, then each one's second, and so on, so that no place is twice in one step."""
        rows = np.stack([_registers(x, self.m) for x in sketches])
        order = np.argsort(places, kind="stable")
        senders, places = senders[order], places[order]
        new = np.r_[True, places[1:] != places[:-1]]
        nth = np.arange(len(places)) - np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))
        order = np.argsort(nth, kind="stable")
        senders, places = senders[order], places[order]
        step = max(1, (1 << 20) // self.m)
        ends = np.cumsum(np.bincount(nth))
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            for i in range(a, b, step):
                at = places[i : min(i + step, b)]
                self.full[at] = np.maximum(self.full[at], rows[senders[i : min(i + step, b)]])
        self.told[places] = True


def united(batches: Iterable[pa.RecordBatch], lg_m: int, few: int, depth: int) -> Iterator[pa.RecordBatch]:
    """One block's states (id, block, at, near, SUMS, log) after the sketches that have come, which are rows (near, to) with the places that they go to. log has what has changed at each depth."""
    m, own = 1 << lg_m, []
    block = _Block(m, few)
    for batch in batches:
        there = batch.column("to").is_valid()
        states, come = batch.filter(batch.column("to").is_null()), batch.filter(there)
        if states.num_rows:
            own.append(states)
        if not come.num_rows:
            continue
        near, counts, places = come.column("near").to_pylist(), come.column("to").value_lengths().to_numpy(), come.column("to").flatten().to_numpy()
        block.reach(int(places.max()) + 1)
        begins = np.cumsum(counts) - counts
        dense = np.array([x[:1] == b"d" for x in near])
        for i in np.flatnonzero(~dense).tolist():
            block.add_coupons(near[i], places[begins[i] : begins[i] + counts[i]].tolist())
        step = max(1, (1 << 23) // m)
        for i in range(0, len(some := np.flatnonzero(dense)), step):
            part = some[i : i + step]
            spots = np.concatenate([places[begins[j] : begins[j] + counts[j]] for j in part])
            block.add_registers([near[j] for j in part], np.repeat(np.arange(len(part)), counts[part]), spots)
    if not own:
        return
    states = pa.Table.from_batches(own).combine_chunks().to_batches()[0]
    at, near, log = states.column("at").to_numpy(), states.column("near").to_pylist(), states.column("log").to_pylist()
    old = {c: states.column(c).to_numpy() for c in NAMES}
    block.reach(int(at.max()) + 1)
    full, grew, now = block.full, np.zeros(len(at), bool), {c: x.copy() for c, x in old.items()}
    lists = []
    for i, place in enumerate(at.tolist()):
        come, told = block.coupons.get(place), block.told[place]
        if come is None and not told:
            continue
        if near[i][:1] == b"d":
            before = _registers(near[i], m)
            np.maximum(full[place], before, out=full[place])
            if come is not None:
                _fill(full, place, _coupons(come))
            grew[i] = not np.array_equal(full[place], before)
        else:
            found = np.unique(np.concatenate([_coupons(near[i]), _coupons(come or b"s")]))
            grew[i] = told or len(found) != old["few"][i]
            if grew[i]:
                lists.append((place, found))
                if told or len(found) > few:
                    now["few"][i], now["dense"][i] = 0, 1
                else:
                    now["few"][i], near[i] = len(found), b"s" + found.astype(">u4").tobytes()
    if lists:
        _fill(full, np.repeat([p for p, _ in lists], [len(x) for _, x in lists]), np.concatenate([x for _, x in lists]))
    some, step = np.flatnonzero(grew), max(1, (1 << 20) // m)
    for k in range(0, len(some), step):
        part = some[k : k + step]
        rows = full[at[part]]
        now["c0"][part], now["last"][part], now["z"][part] = (rows == 0).sum(axis=1), (rows == RANKS - 1).sum(axis=1), WEIGHTS[rows].sum(axis=1)
        for i, row in zip(part.tolist(), rows):
            if now["dense"][i]:
                near[i] = b"d" + pa.compress(row, codec="zstd", asbytes=True)
    change = np.zeros(len(some), LOG)
    change["depth"] = depth
    for c in NAMES:
        change[c] = now[c][some] - old[c][some]
    for i, x in zip(some.tolist(), change):
        log[i] += x.tobytes()
    arrays = [pa.array(near, pa.binary()), *[pa.array(now[c]) for c in NAMES], pa.array(log, pa.binary()), pa.array(grew)]
    yield pa.RecordBatch.from_arrays([states.column(c) for c in ("id", "block", "at")] + arrays, names=["id", "block", "at", "near", *NAMES, "log", "grew"])


def sizes(states: DataFrame, lg_k: int) -> DataFrame:
    """(id, r, s) of the states of all slices: how many values have come to a node's own one, and the sum of the depths at which they have."""
    kind = states.schema["id"].dataType.simpleString()
    rows = states.groupBy("id").agg(*[F.sum(c).cast("double").alias(c) for c in NAMES], F.collect_list("log").alias("log"))

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = [b"".join(x) for x in batch.column("log").to_pylist()]
            change = np.frombuffer(b"".join(logs), LOG)
            row = np.repeat(np.arange(len(logs)), [len(x) // LOG.itemsize for x in logs])
            order = np.lexsort((change["depth"], row))
            change, row = change[order], row[order]
            new = np.r_[True, (row[1:] != row[:-1]) | (change["depth"][1:] != change["depth"][:-1])] if len(row) else np.zeros(0, bool)
            begins = np.flatnonzero(new)
            row, depth = row[begins], change["depth"][begins]  # one step of a node
            step = {c: np.add.reduceat(change[c].astype(float), begins) if len(begins) else np.zeros(0) for c in NAMES}
            now = {c: batch.column(c).to_numpy().copy() for c in NAMES}
            for c in NAMES:
                now[c] -= np.bincount(row, step[c], len(logs))  # as it was before all steps
            n, s, nth = np.ones(len(logs)), np.zeros(len(logs)), np.arange(len(row)) - np.searchsorted(row, row)
            for k in range(int(nth.max()) + 1 if len(nth) else 0):
                own = np.flatnonzero(nth == k)
                at = row[own]
                for c in NAMES:
                    now[c][at] += step[c][own]
                grown = np.where(now["dense"][at] > 0, estimate(now["c0"][at], now["last"][at], now["z"][at], lg_k), now["few"][at])
                grown = np.maximum(grown, n[at])
                s[at] += depth[own] * (grown - n[at])
                n[at] = grown
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n - 1), pa.array(s)], names=["id", "r", "s"])

    return rows.mapInArrow(of, f"id {kind}, r double, s double")
