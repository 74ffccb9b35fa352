"""Configurations of runs: dataclasses, files of `key|value` lines, result names, the command line."""

from __future__ import annotations

import argparse
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

POLICIES = ("idf", "dataset_level", "hybrid", "neural")
DISTRIBUTIONS = ("uniform", "zipfian", "fixed", "uniform_fixed")


@dataclass(frozen=True)
class PolicyConfig:
    """How queries are chosen and learned."""

    alpha: float = 0.2
    p_thresh: float | None = None
    supervised_term_borrowing: bool = False
    unsupervised_term_borrowing: bool = False
    external_feat_specific: bool = False
    external_feat_specific_unsupervised: bool = False
    dedupe_keywords: bool = False
    window_size: int = 50
    rr_threshold: float = 1 / 15
    epsilon: float = 0.05
    learning_rate: float = 0.001
    buffer_size: int = 30
    buffer_sample_size: int = 8
    split_sample: bool = False
    attribute_encoding: bool = True


@dataclass(frozen=True)
class RunConfig:
    """What is run: interactions, query length, results per query, intents."""

    dataset_name: str = "benchmark"
    interactions: int = 2000
    query_length: int = 4
    top_k_size: int = 20
    average_runs: int = 1
    distribution: str = "uniform"
    model: str = "dataset_level"
    batch: int = 1
    seeds: tuple[int, ...] = ()
    policy: PolicyConfig = field(default_factory=PolicyConfig)
    #: Numbers of the repetitions; by default 1 to average_runs.
    runs: tuple[int, ...] = ()
    #: Part of the result's name alone, as every interaction is measured anyway.
    evaluation_interval: int = 0
    evaluation_sample: int = 0

    def __post_init__(self):
        if self.model not in POLICIES:
            raise ValueError(f"model is one of {', '.join(POLICIES)}")
        if self.distribution not in DISTRIBUTIONS:
            raise ValueError(f"distribution is one of {', '.join(DISTRIBUTIONS)}")

    @property
    def run_ids(self) -> tuple[int, ...]:
        return self.runs or tuple(range(1, self.average_runs + 1))

    def seed(self, run: int) -> int:
        """The seed of a run: as given, in the order of the runs, else the run's number."""
        place = self.run_ids.index(run) if run in self.run_ids else run - 1
        return self.seeds[place] if place < len(self.seeds) else run


def load_paths(path: str) -> dict[str, str | bool]:
    """`key|value` lines; true and false become booleans."""
    out: dict[str, str | bool] = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        if "|" in line:
            key, value = line.split("|")[:2]
            out[key] = {"true": True, "false": False}.get(value, value)
    return out


def shortened(key: str) -> str:
    return "_".join(part[:2] for part in key.split("_"))


def result_name(config: dict, keys: list[str]) -> str:
    """A directory name: the first two letters of each part of a key, with its value; keys that aren't there are left out."""
    return "-".join(f"{shortened(k)}={config[k]}" for k in keys if k in config)


def save_path(root: str, run: RunConfig) -> str:
    """Where a run's results go, named after all that distinguishes it."""
    own = asdict(run.policy)
    keys = ["epsilon", "learning_rate", "buffer_size", "buffer_sample_size", "split_sample", "attribute_encoding"] if run.model == "neural" else ["unsupervised_term_borrowing", "external_feat_specific_unsupervised", "p_thresh", "alpha", "external_feat_specific", "supervised_term_borrowing"]
    keys += ["window_size", "rr_threshold"] if run.model == "hybrid" else []
    return f"{root.rstrip('/')}/{result_name(asdict(run), ['dataset_name', 'query_length', 'interactions', 'distribution', *(k for k in ('evaluation_interval', 'evaluation_sample') if getattr(run, k))])}/{run.model}-{result_name(own, keys)}"


def _flag(value: str) -> bool:
    return value.lower() == "true"


def _numbers(value: str) -> tuple[int, ...]:
    return tuple(int(x) for x in value.split(",") if x.strip())


def parse(args: list[str] | None = None) -> RunConfig:
    """A run from command-line options; dataset, iterations and keys are required, everything else has a default."""
    p = argparse.ArgumentParser(prog="querysmith", description="Runs interactions of a query policy over a dataset.")
    p.add_argument("--dataset", required=True)
    p.add_argument("--iterations", type=int, required=True)
    p.add_argument("--keys", type=int, required=True)
    p.add_argument("--model", default="dataset_level", choices=POLICIES)
    p.add_argument("--distribution", default="uniform", choices=DISTRIBUTIONS)
    p.add_argument("--average_runs", type=_numbers, default=(1,), help="how many repetitions, or a list of their numbers")
    p.add_argument("--evaluation_interval", type=int, default=0, help="part of the result's name; every interaction is measured")
    p.add_argument("--evaluation_sample", type=int, default=0, help="part of the result's name; every interaction is measured")
    p.add_argument("--lm_prefixes", type=int, default=0, help="a learned prefix needs a language model, which isn't run here: 0 only")
    p.add_argument("--batch", type=int, default=1)
    p.add_argument("--top_k", type=int, default=20)
    p.add_argument("--alpha", type=float, default=0.2)
    p.add_argument("--p_thresh", type=lambda s: float(s) if s.strip() else None)
    p.add_argument("--epsilon", type=float, default=0.05)
    p.add_argument("--learning_rate", type=float, default=0.001)
    p.add_argument("--buffer_size", type=int, default=50)
    p.add_argument("--buffer_sample_size", type=int, default=8)
    for name in ("attribute_encoding", "split_sample", "term_borrowing", "unsupervised_term_borrowing", "ts_features", "external_feat_specific_unsupervised"):
        p.add_argument(f"--{name}", type=_flag, default=False)
    p.add_argument("--seeds", type=_numbers, default=())
    o = vars(p.parse_args(args))
    if o["lm_prefixes"]:
        p.error("--lm_prefixes: a learned prefix needs a language model in front of which it is learned, and none is run here; give 0")
    if not o["average_runs"] or min(o["average_runs"]) < 1 or len(set(o["average_runs"])) < len(o["average_runs"]):
        p.error("--average_runs: a number of repetitions, or different numbers of theirs, all above 0")
    runs = o["average_runs"] if len(o["average_runs"]) > 1 else ()
    own = {f.name for f in fields(PolicyConfig)}
    policy = PolicyConfig(supervised_term_borrowing=o["term_borrowing"], external_feat_specific=o["ts_features"], **{k: v for k, v in o.items() if k in own and k not in ("supervised_term_borrowing", "external_feat_specific")})
    return RunConfig(o["dataset"], o["iterations"], o["keys"], o["top_k"], len(runs) or o["average_runs"][0], o["distribution"], o["model"], o["batch"], o["seeds"], policy, runs, o["evaluation_interval"], o["evaluation_sample"])


def sweep(base: RunConfig, **values: list) -> list[RunConfig]:
    """Every combination of the given values of a run or its policy."""
    from dataclasses import replace
    from itertools import product

    out = []
    for combination in product(*values.values()):
        given = dict(zip(values, combination, strict=True))
        policy = replace(base.policy, **{k: v for k, v in given.items() if hasattr(base.policy, k)})
        out.append(replace(base, policy=policy, **{k: v for k, v in given.items() if not hasattr(base.policy, k)}))
    return out
