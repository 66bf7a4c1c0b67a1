"""Training state, checkpoints as versioned folders with an atomically moved pointer."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .config import EnsembleConfig, Phase


@dataclass
class State:
    seeds: list[int]
    num_epochs: int
    phase: Phase = Phase.NOT_STARTED
    working_epoch: int = 0
    completed_epochs: int = 0
    next_slot: int = 0
    goal: int = 10
    max_meta_concepts: int = 20
    num_greedy_holdout: int = 1
    tables: dict[str, str] = field(default_factory=dict)
    answers: list[str] = field(default_factory=list)  # parts of the answers, appended and never rewritten
    seen: list[str] = field(default_factory=list)  # parts of (obs_id, text_key): the texts that were answered
    scaler: str | None = None

    def validate(self) -> "State":
        if self.phase != Phase.COMPLETE:
            if self.completed_epochs > self.working_epoch:
                raise ValueError("more epochs completed than worked on")
            if self.num_epochs and self.working_epoch >= self.num_epochs:
                raise ValueError("the working epoch lies beyond the last one")
        elif self.completed_epochs > self.num_epochs:
            raise ValueError("more epochs completed than there are")
        return self

    def compatible(self, config: EnsembleConfig) -> list[str]:
        """Raises for other seeds or concept limits; other epochs only warn."""
        if list(config.init_seeds) != list(self.seeds):
            raise ValueError("the checkpoint has other seeds")
        if config.concept.max_meta_concepts != self.max_meta_concepts:
            raise ValueError("the checkpoint has another max_meta_concepts")
        return [f"the checkpoint has {self.num_epochs} epochs, the settings {config.training.epochs}"] if config.training.epochs != self.num_epochs else []

    def dump(self) -> str:
        return json.dumps(asdict(self) | {"phase": self.phase.value})

    @classmethod
    def load(cls, text: str) -> "State":
        d = json.loads(text)
        return cls(**(d | {"phase": Phase(d["phase"])}))


class Checkpoints:
    """Folder: v<N>/ with tables and state.json. That file is renamed into place when
    all else of its version is written, so the highest version that has it is whole:
    no pointer is ever replaced, and a crash at any time leaves the last one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self) -> int | None:
        whole = [v for v in self._versions() if self._fs.exists(self._path(f"{self.folder}/v{v}/state.json"))]
        return max(whole, default=None)

    def _versions(self) -> list[int]:
        at = self._path(self.folder)
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return [int(n[1:]) for n in names if re.fullmatch(r"v\d+", n)]

    def _write(self, path: str, text: str) -> None:
        stream = self._fs.create(self._path(path), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def save(self, state: State, config: EnsembleConfig, tables: dict[str, DataFrame]) -> int:
        version = max(self._versions(), default=0) + 1
        base = f"{self.folder}/v{version}"
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{base}/{name}")
        state.tables = {name: f"{base}/{name}" for name in tables}
        self._fs.mkdirs(self._path(base))
        self._write(f"{base}/state.tmp", json.dumps({"state": json.loads(state.dump()), "config": config.to_dict()}))
        self._fs.rename(self._path(f"{base}/state.tmp"), self._path(f"{base}/state.json"))
        return version

    def load(self) -> tuple[State, EnsembleConfig, dict[str, DataFrame]] | None:
        version = self.current()
        if version is None:
            return None
        raw = json.loads(self.spark.read.text(f"{self.folder}/v{version}/state.json", wholetext=True).first()["value"])
        state = State.load(json.dumps(raw["state"]))
        if not state.tables and state.phase != Phase.NOT_STARTED:
            raise ValueError("the checkpoint names no tables")
        return state, EnsembleConfig.from_dict(raw["config"]), {k: self.spark.read.parquet(p) for k, p in state.tables.items()}
