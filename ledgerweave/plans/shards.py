"""Local training as a map over shards.

Encoded training rows are placed once, one shard per partition, and cached. A round is
then a map-only job over the cached shards plus a tiny aggregation: no row moves again.
Every bank has the same, configured number of shards, whatever its size, and md5 of the
account picks the shard, so that any engine can replay a run; averaging their
results by row count and then averaging banks by row count is one flat average.

A pass reads its shard in the order of md5("seed:round:epoch:account"), sorted by Spark, and
trains on it batch by batch, so a task never holds a shard.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import ledgerweave
from ledgerweave.operators.averaging import fedavg, flatten_updates
from ledgerweave.plans.models import Params, Shard, ShardModel
from ledgerweave.settings import TrainSpec

# Training functions travel to the executors as code, so the package need not be
# installed there; NumPy and PyArrow must be.
cloudpickle.register_pickle_by_value(ledgerweave)

UPDATE_COLUMNS = (
    "alpha double, bank_id string, shard int, n_train bigint, key string, values array<double>"
)
@dataclass(frozen=True)
class ShardSet:
    rows: DataFrame
    n_train: dict[str, int]
    count: int

    @property
    def banks(self) -> list[str]:
        return sorted(self.n_train)

    def release(self) -> None:
        self.rows.unpersist()


def place_shards(encoded: DataFrame, spec: TrainSpec) -> ShardSet:
    """Assigns every training row to a shard and caches the shards. Only the row count
    of each bank reaches the driver."""
    training = encoded.where(F.col("split").isin(*spec.splits))
    sizes = {
        bank: n
        for bank, n in training.groupBy("bank_id").agg(F.count("*").alias("n")).collect()
    }
    if not sizes:
        raise ValueError("no training rows")
    numbers = F.create_map(*[F.lit(x) for i, b in enumerate(sorted(sizes)) for x in (b, i)])
    # Accounts without an id are told apart by the rest of their row.
    name = F.coalesce(
        F.col("acct_id").cast("string"), F.hex(F.xxhash64("bank_id", "y", "num", "cat"))
    )
    digest = F.md5(F.concat(F.lit("shard:"), name))
    part = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(spec.shards))
    shard = numbers[F.col("bank_id")] * spec.shards + part
    count = len(sizes) * spec.shards
    rows = (
        training.select(name.alias("name"), "bank_id", "y", "num", "cat", shard.cast("int").alias("shard"))
        .repartitionById(count, F.col("shard"))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    return ShardSet(rows, sizes, count)


def _matrix(column: pa.Array, n: int, missing: float | int) -> np.ndarray:
    values = column.flatten().fill_null(missing).to_numpy(zero_copy_only=False)
    return values.reshape(n, -1)


def as_shard(rows: pa.RecordBatch) -> Shard:
    n = rows.num_rows
    return Shard(
        num=np.ascontiguousarray(_matrix(rows.column("num"), n, np.nan)),
        cat=_matrix(rows.column("cat"), n, -1).astype(np.int64),
        y=rows.column("y").to_numpy(),
    )


def in_order(rows: DataFrame, round_id: int, spec: TrainSpec) -> DataFrame:
    """Every row once per epoch, each partition in the order of the round's passes."""
    text = F.concat_ws(":", F.lit(spec.seed), F.lit(round_id), F.col("epoch"), F.col("name"))
    epochs = F.sequence(F.lit(1), F.lit(spec.local_epochs))
    return (
        rows.withColumn("epoch", F.explode(epochs))
        .withColumn("order", F.md5(text))
        .sortWithinPartitions("shard", "epoch", "order")
        .drop("order", "name")
    )


def train_shards(
    shards: ShardSet,
    model: ShardModel,
    states: Mapping[tuple[float, str | None], Params],
    round_id: int,
    spec: TrainSpec,
) -> DataFrame:
    """One local round of every state on every shard: rows of UPDATE_COLUMNS.

    ``states`` maps (alpha, bank) to start parameters; bank None means every bank. All
    alphas train in the same pass, each from its own parameters.
    """
    start = dict(states)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A partition is one shard; its first row says whose it is.
        runs: list[tuple[float, Params]] = []
        state, bank, number, seen = None, "", 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if state is None:
                bank, number = batch.column("bank_id")[0].as_py(), batch.column("shard")[0].as_py()
                runs = [(a, p) for (a, owner), p in start.items() if owner in (None, bank)]
                if not runs:
                    return
                state = model.begin([p for _, p in runs], [a for a, _ in runs])
            model.step(state, as_shard(batch))
            seen += int(np.count_nonzero(batch.column("epoch").to_numpy() == 1))
        if state is None:
            return
        out: dict[str, list] = {name: [] for name in names}
        for (alpha, _), trained in zip(runs, model.finish(state)):
            for key, value in trained.items():
                row = (alpha, bank, number, seen, key, np.ravel(value).tolist())
                for name, cell in zip(names, row):
                    out[name].append(cell)
        yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema(
        [
            ("alpha", pa.float64()),
            ("bank_id", pa.string()),
            ("shard", pa.int32()),
            ("n_train", pa.int64()),
            ("key", pa.string()),
            ("values", pa.list_(pa.float64())),
        ]
    )
    names = schema.names
    return in_order(shards.rows, round_id, spec).mapInArrow(train, UPDATE_COLUMNS)


def bank_updates(updates: DataFrame) -> DataFrame:
    """Shard results merged into one update per (alpha, bank)."""
    flat = flatten_updates(updates, ["alpha", "bank_id", "shard"])
    return fedavg(flat, members=("shard",), run=("alpha", "bank_id"))


def restore(
    merged: DataFrame, model: ShardModel, width: int, run: tuple[str, ...]
) -> dict[tuple, Params]:
    """Averaged parameters back on the driver: width + 1 numbers per run."""
    template = model.initial(width)
    out: dict[tuple, Params] = {}
    for row in merged.collect():
        params = out.setdefault(
            tuple(row[c] for c in run), {k: np.full(v.size, np.nan) for k, v in template.items()}
        )
        params[row["key"]][row["pos"]] = row["value"]
    if not out:
        raise RuntimeError("no client sent an update")
    shaped = {
        r: {k: v.reshape(template[k].shape) for k, v in params.items()}
        for r, params in out.items()
    }
    if any(not np.isfinite(v).all() for params in shaped.values() for v in params.values()):
        raise RuntimeError("training produced missing or undefined parameters")
    return shaped
