"""Thresholds of the pipelines, as frozen records; operators take them as arguments and read no environment."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class ExtractionConfig:
    max_files: int = 1
    parquet_batch: int = 10_000
    sentence_batch: int = 4_096
    min_sentence: int = 40
    max_sentence: int = 800
    semantic_min: float = 0.34
    semantic_margin: float = 0.03
    rescue_min: float = 0.27
    rescue_margin: float = 0.08
    rescue_keep: float = 0.60
    human_keep: float = 0.65
    human_review: float = 0.30
    keep: float = 0.56
    borderline: float = 0.45
    block_noise: bool = True
    low_margin: float = 0.06
    high_pos: float = 0.65
    high_margin: float = 0.10
    classifier_c: float = 1.5
    classifier_iterations: int = 3_000
    report_samples: int = 15

    def __post_init__(self) -> None:
        for name in ("max_files", "parquet_batch", "sentence_batch"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")


@dataclass(frozen=True)
class AnalysisConfig:
    min_pair: int = 5
    min_distance: int = 2
    min_group: int = 50
    candidate_top: int = 60
    candidate_min_llr: float = 3.0
    frame_floor: float = 0.55
    frame_margin: float = 0.04
    contexts_max: int = 500
    contexts_min: int = 10
    dimension_floor: float = 0.60
    dimension_margin: float = 0.04
    attitude_floor: float = 0.24
    attitude_margin: float = 0.02
    resolver_floor: float = 0.26
    resolver_margin: float = 0.04
    focus_window: int = 24
    group_window: int = 4
    binding_distance: int = 8


@dataclass(frozen=True)
class SiteConfig:
    excerpt_words: int = 30
    results: int = 8
    tags_shown: int = 5
    description: int = 150
    description_max: int = 300
    feed: int = 10
    toc_depth: int = 3
    toc_min: int = 1
    recent: int = 3
    words_per_minute: int = 200


@dataclass(frozen=True)
class EncoderModel:
    """A published encoder: its name, dimension, and texts of a batch by device (DEFAULT_BATCH where none is given)."""

    name: str
    dim: int
    batches: Mapping[str, int] = field(default_factory=dict)


DEFAULT_BATCH = 32
# Presets, models and tuned batches.
ENCODERS = {
    "gte_modernbert_base": EncoderModel("Alibaba-NLP/gte-modernbert-base", 768),
    "minilm": EncoderModel("all-MiniLM-L6-v2", 384, {"mps": 64, "cuda": 256}),
    "bge_small": EncoderModel("BAAI/bge-small-en-v1.5", 384),
    "gte_small": EncoderModel("thenlper/gte-small", 384),
}
EXTRACTION_ENCODER, ANALYSIS_ENCODER = "minilm", "gte_modernbert_base"  # a light one to filter, a strong one for what is reported


def encoder_model(preset: str, more: Mapping[str, EncoderModel] | None = None) -> EncoderModel:
    """The model of a preset; `more` adds presets and overrides those known."""
    known = {**ENCODERS, **(more or {})}
    if preset not in known:
        raise ValueError(f"unknown encoder {preset!r}; known: {', '.join(sorted(known))}")
    return known[preset]


@dataclass(frozen=True)
class Placement:
    """Where an encoder runs: device, texts of a batch, and what a task and its executor must have for it."""

    device: str = "cpu"
    batch: int = DEFAULT_BATCH
    task_cpus: int = 1
    task_gpus: float = 0.0
    executor_cores: int | None = None
    executor_memory: str | None = None

    def profile(self):
        """The stage's resource profile; None where the session's own resources will do. Stage profiles need a cluster manager that offers them."""
        if self.task_cpus == 1 and not self.task_gpus and not self.executor_cores and not self.executor_memory:
            return None
        from pyspark.resource import ExecutorResourceRequests, ResourceProfileBuilder, TaskResourceRequests

        task, executor = TaskResourceRequests().cpus(self.task_cpus), ExecutorResourceRequests()
        if self.task_gpus:
            task.resource("gpu", self.task_gpus)
            executor.resource("gpu", max(1, round(self.task_gpus)))
        if self.executor_cores:
            executor.cores(self.executor_cores)
        if self.executor_memory:
            executor.memory(self.executor_memory)
        return ResourceProfileBuilder().require(task).require(executor).build


def placement(model: EncoderModel, device: str = "cpu", batch: int | None = None, **resources) -> Placement:
    """A model's placement on a device (cpu, cuda, mps), with the model's batch for it unless one is given. A cuda task takes one GPU."""
    if device not in ("cpu", "cuda", "mps"):
        raise ValueError(f"unknown device {device!r}")
    if device == "cuda":
        resources.setdefault("task_gpus", 1.0)
    size = model.batches.get(device, DEFAULT_BATCH) if batch is None else batch
    if size <= 0:
        raise ValueError("batch must be positive")
    return Placement(device, size, **resources)
