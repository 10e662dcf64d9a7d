"""A write-ahead store of training rounds.

Every round is written under a name of its own (round and attempt): the parameters of all
running and all best models, and the metric log so far. It counts from the moment at which a
row that names it is added to the table of commits, which Spark's committer publishes as one
file. A run that dies in between leaves files that no commit names; the next run goes on from
the last commit. The first row names the settings, and a run with others is refused.

    <path>/commits              round, attempt, settings
    <path>/rounds/<r>-<a>/models   parameters, as tables.save_models lays them out
    <path>/rounds/<r>-<a>/log      one row per (alpha, round) up to this round
    <path>/rounds/<r>-<a>/evaluation   the metrics of all rounds up to this one
    <path>/log                     JSON lines for reading along, rebuilt when a run goes on
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.settings import FeatureSpec, TrainSpec
from ledgerweave.sources import tables

COMMITS = "round int, attempt string, settings string"
LOG = "alpha double, round int, avg_val_wlogloss double, best_loss double, no_improve int"
EVALUATION = "alpha double, round int, metric string, value double"
RUNNING, BEST = "running", "best"

Params = dict[str, np.ndarray]


@dataclass
class Progress:
    """Where a run stands after a committed round."""

    round_id: int
    running: dict[float, Params]
    best: dict[float, tuple[int, Params]]
    log: list[dict]
    evaluation: list[dict]


def settings_text(width: int, features: FeatureSpec, spec: TrainSpec, model: object) -> str:
    """What decides a run's numbers. The number of rounds and the patience do not: a run may
    go on with more of them."""
    decisive = {k: v for k, v in asdict(spec).items() if k not in ("rounds", "patience")}
    return json.dumps(
        {"width": width, "features": asdict(features), "spec": decisive, "model": repr(model)}, sort_keys=True
    )


class RoundStore:
    """The committed rounds of one run under ``path``, in whatever store Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _commits(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _commit(self, round_id: int, attempt: str, settings: str) -> None:
        row = self.spark.createDataFrame([(round_id, attempt, settings)], COMMITS).coalesce(1)
        row.write.mode("append").parquet(f"{self.path}/commits")

    def begin(self, settings: str) -> Progress | None:
        """Opens the store for a run: what was committed, or nothing for a new run."""
        commits = self._commits()
        rows = [] if commits is None else commits.orderBy("round").collect()
        if not rows:
            self._commit(0, "", settings)
            return None
        if any(r["settings"] != settings for r in rows):
            raise ValueError(f"{self.path} holds a run with other settings")
        return self.after(rows[-1]["round"], rows[-1]["attempt"]) if rows[-1]["round"] else None

    def committed(self) -> list[int]:
        """The rounds that count, in their order."""
        commits = self._commits()
        if commits is None:
            return []
        return [r["round"] for r in commits.where("round > 0").orderBy("round").collect()]

    def _round(self, round_id: int, attempt: str) -> str:
        return f"{self.path}/rounds/{round_id}-{attempt}"

    def after(self, round_id: int, attempt: str) -> Progress:
        where = self._round(round_id, attempt)
        models = tables.load_models(self.spark, f"{where}/models")
        return Progress(
            round_id,
            {alpha: p for (kind, alpha, _), (p, _) in models.items() if kind == RUNNING},
            {alpha: (r, p) for (kind, alpha, r), (p, _) in models.items() if kind == BEST},
            self._lines(f"{where}/log", LOG),
            self._lines(f"{where}/evaluation", EVALUATION),
        )

    def _note(self, lines: Sequence[Mapping], path: str, schema: str) -> None:
        """Rows of a bounded log, numbered to keep their order."""
        names = [f.split()[0] for f in schema.split(", ")]
        rows = [(n, *(line[c] for c in names)) for n, line in enumerate(lines)]
        self.spark.createDataFrame(rows, f"nth int, {schema}").coalesce(1).write.mode("errorifexists").parquet(path)

    def _lines(self, path: str, schema: str) -> list[dict]:
        rows = self.spark.read.schema(f"nth int, {schema}").parquet(path).orderBy("nth").drop("nth")
        return [r.asDict() for r in rows.collect()]

    def save(
        self,
        round_id: int,
        settings: str,
        running: Mapping[float, Params],
        best: Mapping[float, tuple[int, Params]],
        log: Sequence[Mapping],
        evaluation: Sequence[Mapping] = (),
    ) -> None:
        """Writes a round and then commits it."""
        attempt = uuid.uuid4().hex
        where = self._round(round_id, attempt)
        models = [(RUNNING, alpha, round_id, p, {}) for alpha, p in running.items()]
        models += [(BEST, alpha, r, p, {}) for alpha, (r, p) in best.items() if p]
        tables.save_models(self.spark, f"{where}/models", models, "errorifexists")
        self._note(log, f"{where}/log", LOG)
        self._note(evaluation, f"{where}/evaluation", EVALUATION)
        self._commit(round_id, attempt, settings)
        latest = [r for r in log if r["round"] == round_id]
        first = len(latest) == len(log)
        tables.write_round_log(self.spark, latest, f"{self.path}/log", "overwrite" if first else "append")

    def rewind_log(self, log: Sequence[Mapping]) -> None:
        """The readable log as it was at the last commit."""
        if log:
            tables.write_round_log(self.spark, log, f"{self.path}/log", "overwrite")

    def best_model(self) -> tuple[float, int, Params]:
        """alpha, round and parameters of the lowest loss committed so far; ties go to the
        alpha that comes first in the log, then to the earlier round."""
        commits = self._commits()
        last = None if commits is None else commits.where("round > 0").orderBy(F.desc("round")).first()
        if last is None:
            raise FileNotFoundError(f"no committed round under {self.path}")
        progress = self.after(last["round"], last["attempt"])
        losses = {r["alpha"]: r["best_loss"] for r in progress.log}
        alpha = min((a for a in losses if a in progress.best), key=losses.get)
        return alpha, *progress.best[alpha]
