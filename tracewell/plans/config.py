"""Pipeline configuration: includes, precedence, validation, and stage folders named by content."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable

STAGES = ("construction", "transformation", "featurization", "feat_inference", "batching", "training", "evaluation", "triage")
# What each choice may be.
CHOICES = {
    "featurization": ("word2vec", "doc2vec", "fasttext", "alacarte", "temporal_rw", "flash", "hierarchical_hashing", "magic", "only_type", "only_ones"),
    "transformation": ("none", "undirected", "dag", "rcaid_pseudo_graph", "synthetic_attack_naive"),
    "evaluation": ("node_evaluation", "tw_evaluation", "node_tw_evaluation", "queue_evaluation", "edge_evaluation"),
    "threshold": ("max_val_loss", "mean_val_loss", "90_percent_val_loss", "threatrace", "flash", "magic"),
}


def merge(base: dict, child: dict) -> dict:
    """base with child's values on top, dictionaries level by level."""
    out = dict(base)
    for k, v in child.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def resolve(name: str, load: Callable[[str], dict], seen: tuple[str, ...] = ()) -> dict:
    """A configuration with those it includes below it."""
    if name in seen:
        raise ValueError(f"{name} includes itself: {' > '.join((*seen, name))}")
    own = dict(load(name))
    parent = own.pop("_include", None)
    return merge(resolve(parent, load, (*seen, name)), own) if parent else own


def layered(*layers: dict) -> dict:
    """Defaults, file, tuned values, experiment, command line: later layers win."""
    out: dict = {}
    for layer in layers:
        out = merge(out, layer)
    return out


def public(config: dict) -> dict:
    return {k: public(v) if isinstance(v, dict) else v for k, v in config.items() if not k.startswith("_")}


def validate(config: dict) -> dict:
    """config, or a ValueError about unknown stages, choices and combinations that make no sense."""
    for k, v in public(config).items():
        if k not in STAGES:
            raise ValueError(f"unknown stage {k}")
        method = v.get("used_method") if isinstance(v, dict) else None
        for one in str(method).split(",") if method else []:
            if k in CHOICES and one.strip() not in CHOICES[k]:
                raise ValueError(f"{k}: {one} is none of {', '.join(CHOICES[k])}")
    steps = [x.strip() for x in str(config.get("transformation", {}).get("used_method", "none")).split(",")]
    if "undirected" in steps and "dag" in steps:
        raise ValueError("a graph can't be both undirected and acyclic")
    if "none" in steps and len(steps) > 1:
        raise ValueError("none goes with no other transformation")
    batching = config.get("batching", {})
    if batching.get("tgn_last_neighbor") and batching.get("global_batching") == "unique_edge_types":
        raise ValueError("last neighbours need edges in batches of their own order")
    if config.get("training", {}).get("decoder") == "none" and config.get("training", {}).get("objective") not in (None, "none"):
        raise ValueError("an objective needs a decoder")
    return config


def stage_keys(config: dict) -> dict[str, str]:
    """A hash for each stage over its own settings and all stages before it."""
    out, chain = {}, ""
    for stage in STAGES:
        text = json.dumps(public(config.get(stage, {})), sort_keys=True, default=str)
        chain = hashlib.sha256(f"{chain}/{stage}/{text}".encode()).hexdigest()
        out[stage] = chain[:16]
    return out


def to_run(config: dict, done: Callable[[str, str], bool], force: Iterable[str] = ()) -> list[str]:
    """The stages to run: from the first that isn't done, or is forced, all that follow."""
    keys, force = stage_keys(config), set(force)
    for i, stage in enumerate(STAGES):
        if stage in force or not done(stage, keys[stage]):
            return list(STAGES[i:])
    return []


def offsets(max_ids: list[int]) -> list[int]:
    """What to add to each dataset's node ids so that they don't meet."""
    out, total = [], 0
    for m in max_ids:
        out.append(total)
        total += m + 1
    return out
