"""Model clients: a registry, bounded retries in the workers, answers kept by prompt.

A client is what a registered factory makes from `ClientSettings`: an object with
`complete(prompts, settings) -> list`, whose items are texts, None or exceptions. The
factory travels to the workers, which make one client each. `Asker` adds the retries: prompts
that failed are asked again after a growing pause, the others not. `answered` asks a table of prompts: each
distinct prompt once, those that earlier runs answered not at all; failures are rows of
their own and are asked again by the next run.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship


@dataclass(frozen=True)
class ClientSettings:
    name: str
    temperature: float = 0.0
    max_new_tokens: int = 5000
    max_retries: int = 3  # after the first try
    pause: float = 1.0  # seconds before the first retry, twice as many before each later one
    longest_pause: float = 60.0
    timeout: float = 120.0
    batch_size: int = 20
    seed: int = 10
    response_model: str | None = None  # a Spark schema that answers must parse as

    def __post_init__(self):
        if not self.name or self.max_retries < 0 or self.batch_size < 1:
            raise ValueError("a client needs a name, a batch size, and no negative number of retries")

    def fingerprint(self) -> str:
        """What an answer depends on besides its prompt."""
        kept = {k: v for k, v in asdict(self).items() if k in ("name", "temperature", "max_new_tokens", "seed", "response_model")}
        return hashlib.sha256(json.dumps(kept, sort_keys=True).encode()).hexdigest()


class Client(Protocol):
    def complete(self, prompts: list[str], settings: ClientSettings) -> list[str | None | Exception]: ...


REGISTRY: dict[str, Callable[[ClientSettings], Client]] = {}


def register(name: str, factory: Callable[[ClientSettings], Client]) -> None:
    """A factory for names that are equal to or begin with `name`."""
    REGISTRY[name] = factory


def factory_of(name: str) -> Callable[[ClientSettings], Client]:
    known = [n for n in REGISTRY if name == n or name.startswith(n)]
    if not known:
        raise ValueError(f"no client is registered for {name!r}")
    return REGISTRY[max(known, key=len)]


def clients(llm_model: str | None = None, llm_iter: str | None = None, llm_extraction: str | None = None, **settings) -> dict[str, "Asker"]:
    """The two roles: proposing (`iter`) and answering (`extraction`), one client for both
    unless a role names its own."""
    if not (llm_model or (llm_iter and llm_extraction)):
        raise ValueError("a role has no model")
    shared = Asker(ClientSettings(llm_model, **settings)) if llm_model else None
    own = lambda name: shared if not name or name == llm_model else Asker(ClientSettings(name, **settings))
    return {"iter": own(llm_iter), "extraction": own(llm_extraction)}


class Asker:
    """Asks with retries; may be pickled. `check` raises ValueError for answers that
    don't do, which count as failures."""

    def __init__(self, settings: ClientSettings, factory: Callable[[ClientSettings], Client] | None = None, check: Callable[[str], None] | None = None, sleep: Callable[[float], None] = time.sleep):
        self.settings, self.check, self.sleep = settings, check, sleep
        self.factory = factory or factory_of(settings.name)
        self._client = None

    def __getstate__(self):
        return self.__dict__ | {"_client": None}

    def _once(self, prompts: list[str]) -> list[tuple[str | None, str | None]]:
        """(answer, error) of each."""
        if self._client is None:
            self._client = self.factory(self.settings)
        try:
            got = self._client.complete(prompts, self.settings)
            if len(got) != len(prompts):
                raise ValueError(f"{len(got)} answers to {len(prompts)} prompts")
        except Exception as e:
            return [(None, f"{type(e).__name__}: {e}")] * len(prompts)
        out = []
        for answer in got:
            error = "no answer" if answer is None else f"{type(answer).__name__}: {answer}" if isinstance(answer, Exception) else None
            if error is None and self.check is not None:
                try:
                    self.check(answer)
                except ValueError as e:
                    error = f"rejected: {e}"
            out.append((None, error) if error else (answer, None))
        return out

    def detailed(self, prompts: list[str]) -> list[tuple[str | None, str | None, int]]:
        """(answer, error of the last try, tries) of each prompt."""
        out: list[tuple[str | None, str | None, int]] = [(None, None, 0)] * len(prompts)
        size = self.settings.batch_size
        for begin in range(0, len(prompts), size):
            open_ = list(range(begin, min(len(prompts), begin + size)))
            for attempt in range(self.settings.max_retries + 1):
                if attempt:
                    self.sleep(min(self.settings.longest_pause, self.settings.pause * 2 ** (attempt - 1)))
                for i, (answer, error) in zip(open_, self._once([prompts[i] for i in open_]), strict=True):
                    out[i] = (answer, error, attempt + 1)
                open_ = [i for i in open_ if out[i][0] is None]
                if not open_:
                    break
        return out

    def __call__(self, prompts: list[str]) -> list[str | None]:
        """What annotators and extractors ask with."""
        return [answer for answer, _, _ in self.detailed(prompts)]


ANSWERS = "prompt_key string, response string, error string, tries int"


class Answers:
    """A folder of answered prompts, by prompt and settings; runs append parts to it."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path

    def _parts(self) -> list[str]:
        at = self._path(self.folder)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(str(p) for p in found if p.getName().startswith("part=") and fs.exists(self._path(f"{p}/_SUCCESS")))  # whole ones

    def known(self) -> DataFrame:
        """The prompts that were answered, once each."""
        parts = self._parts()
        rows = self.spark.read.schema(ANSWERS).parquet(*parts) if parts else self.spark.createDataFrame([], ANSWERS)
        return rows.filter("response is not null").dropDuplicates(["prompt_key"])

    def ask(self, prompts: DataFrame, asker: Asker, prompt: str = "prompt", tasks: int | None = None) -> DataFrame:
        """prompts with response, error and tries. A null prompt has no answer and is not
        asked. Null tries: the answer was known."""
        ship(self.spark)
        mark = asker.settings.fingerprint()
        keyed = prompts.withColumn("prompt_key", F.sha2(F.concat_ws("\n", F.lit(mark), F.col(prompt)), 256))
        known = self.known().select("prompt_key")
        new = keyed.filter(F.col(prompt).isNotNull()).select("prompt_key", F.col(prompt).alias("_prompt")).dropDuplicates(["prompt_key"]).join(known, "prompt_key", "left_anti")
        if tasks:
            new = new.repartition(tasks)
        model = asker.settings.response_model

        def run(frames):
            for frame in frames:
                got = asker.detailed(frame["_prompt"].tolist())
                answer, error, tries = zip(*got, strict=True) if got else ((), (), ())
                yield pd.DataFrame({"prompt_key": frame["prompt_key"], "response": answer, "error": error, "tries": tries})

        said = new.mapInPandas(run, ANSWERS)
        if model:  # answers of another form are failures
            fits = F.from_json("response", model, {"mode": "PERMISSIVE"})
            bad = F.col("response").isNotNull() & fits.isNull()
            bad = bad | (F.col("response").isNotNull() & F.forall(F.array(*(fits[f].isNull() for f in _fields(self.spark, model))), lambda x: x))
            said = said.withColumns({"error": F.when(bad, F.lit("rejected: not of the response model")).otherwise(F.col("error")), "response": F.when(~bad, F.col("response"))})
        path = f"{self.folder}/part={time.time_ns()}"
        said.write.parquet(path)  # answers are whole before anything reads them: no prompt is asked twice
        fresh = self.spark.read.schema(ANSWERS).parquet(path)
        every = self.known().join(fresh.select("prompt_key"), "prompt_key", "left_anti").withColumns({"error": F.lit(None).cast("string"), "tries": F.lit(None).cast("int")}).unionByName(fresh)
        return keyed.join(every, "prompt_key", "left").drop("prompt_key")


def _fields(spark, schema: str) -> list[str]:
    return spark.createDataFrame([], schema).columns
