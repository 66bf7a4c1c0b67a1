"""Settings of training and their defaults."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from enum import Enum

PENALTIES = (None, "l2", "l1", "l1_sklearn")


class Phase(str, Enum):
    NOT_STARTED = "not_started"
    BASELINE_RUNNING = "baseline_running"
    BASELINE_COMPLETE = "baseline_complete"
    GREEDY_RUNNING = "greedy_running"
    COMPLETE = "complete"


@dataclass
class ModelConfig:
    residual_model_type: str = "l2"
    final_model_type: str = "l1"
    final_learner_type: str = "l2"
    count_vectorizer: str = "count"
    use_acc: bool = False
    cv: int = 5

    def __post_init__(self):
        for kind in (self.residual_model_type, self.final_model_type, self.final_learner_type):
            if kind not in PENALTIES:
                raise ValueError(f"unknown penalty {kind!r}")
        if self.count_vectorizer not in ("count", "tfidf"):
            raise ValueError(f"unknown vectorizer {self.count_vectorizer!r}")


@dataclass
class DataConfig:
    text_summary_column: str = "text"
    concept_column: str = "text"
    min_prevalence: float = 0.0
    num_top_attributes: int = 40
    keep_x_cols: list[str] | None = None
    max_section_length: int | None = None
    join_column: str | None = None


@dataclass
class TrainingConfig:
    num_epochs: int | None = None  # None: num_greedy_epochs
    num_greedy_epochs: int = 2
    batch_concept_size: int = 20
    train_frac: float = 0.5
    num_greedy_holdout: int = 1
    is_greedy_metric_acc: bool = False
    cv: int = 5
    do_coef_check: bool = False

    @property
    def epochs(self) -> int:
        return self.num_greedy_epochs if self.num_epochs is None else self.num_epochs


@dataclass
class ConceptConfig:
    goal_num_meta_concepts: int = 10
    max_meta_concepts: int = 20
    num_top_residual_words: int = 40


@dataclass
class ClientConfig:
    """Model clients by registered names: one for both roles, or one for each."""

    llm_model: str | None = None
    llm_iter_type: str | None = None
    llm_extraction_type: str | None = None
    max_new_tokens: int = 5000
    temperature: float = 0.0
    max_retries: int = 3
    batch_size: int = 20

    def roles(self) -> dict | None:
        """Askers by role; None without a model."""
        from ..operators.client import clients

        if not (self.llm_model or self.llm_iter_type or self.llm_extraction_type):
            return None
        more = {k: getattr(self, k) for k in ("max_new_tokens", "temperature", "max_retries", "batch_size")}
        return clients(self.llm_model, self.llm_iter_type, self.llm_extraction_type, **more)


@dataclass
class EnsembleConfig:
    init_seeds: list[int] = field(default_factory=lambda: [1, 2, 3])
    model: ModelConfig = field(default_factory=ModelConfig)
    data: DataConfig = field(default_factory=DataConfig)
    training: TrainingConfig = field(default_factory=TrainingConfig)
    concept: ConceptConfig = field(default_factory=ConceptConfig)
    force_keep_columns: list[str] | None = None
    client: ClientConfig = field(default_factory=ClientConfig)

    def __post_init__(self):
        if not self.init_seeds:
            raise ValueError("at least one seed is needed")

    @classmethod
    def from_args(cls, **args) -> "EnsembleConfig":
        """Flat settings sorted into their parts; unknown names raise."""
        parts = {"model": ModelConfig, "data": DataConfig, "training": TrainingConfig, "concept": ConceptConfig, "client": ClientConfig}
        given: dict[str, dict] = {k: {} for k in parts}
        own = {}
        for name, value in args.items():
            homes = [k for k, kind in parts.items() if name in {f.name for f in fields(kind)}]
            if homes:
                for k in homes:
                    given[k][name] = value
            elif name in ("init_seeds", "force_keep_columns"):
                own[name] = value
            else:
                raise ValueError(f"unknown setting {name!r}")
        return cls(**own, **{k: kind(**given[k]) for k, kind in parts.items()})

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> "EnsembleConfig":
        return cls(d["init_seeds"], ModelConfig(**d["model"]), DataConfig(**d["data"]), TrainingConfig(**d["training"]), ConceptConfig(**d["concept"]), d.get("force_keep_columns"), ClientConfig(**d.get("client", {})))


@dataclass
class KeyphraseConfig:
    """Settings of keyphrase extraction; a file must name all and no others. (Fixed values: the names.)"""

    llm_model_type: str
    prompt_file: str
    cache_file: str  # a folder of answers
    seed: int
    batch_size: int
    num_new_tokens: int
    prompt_placeholder: str
    text_column: str
    is_image: bool
    index_col: int | None  # position of the key column; None: obs_id
    llm_outputs_file: str | None
    log_file: str

    def __post_init__(self):
        if not self.llm_model_type or not self.prompt_file:
            raise ValueError("llm_model_type and prompt_file must not be empty")
        if self.batch_size <= 0 or self.num_new_tokens <= 0 or self.seed < 0:
            raise ValueError("batch_size and num_new_tokens must be positive, seed at least 0")

    @classmethod
    def from_dict(cls, given: dict) -> "KeyphraseConfig":
        names = {f.name for f in fields(cls)}
        if set(given) != names:
            raise ValueError(f"missing settings: {sorted(names - set(given))}, unknown ones: {sorted(set(given) - names)}")
        return cls(**given)
