"""Rules of run documents: one table of parameters, applied to a nested document on the driver or to many flat ones as a DataFrame."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Outputs that a run may be asked to save.
OUTPUTS = ("coarsened_graph", "matrix_k_permuted", "matrix_m_permuted", "permutation", "run_metrics", "run_simulation_parameters")
CONFIG_KEYS = ("parameters_file_path", "input_matrices", "save_output")
STRATEGIES = ("levels", "recursive", "starts")
TRUE, FALSE = ("true", "1", "yes", "y"), ("false", "0", "no", "n")


@dataclass(frozen=True)
class Rule:
    """A parameter: where it stands, its kind, its bounds or choices, and its default (``...`` where it must be given)."""

    block: str
    name: str
    kind: str
    low: float | None = None
    high: float | None = None
    above: float | None = None
    choices: tuple[str, ...] = ()
    default: Any = ...
    folded: bool = False  # lower-cased before it is compared


RULES = (
    Rule("general_parameters", "dof_per_node", "int", low=1),
    Rule("general_parameters", "seed", "int"),
    Rule("coarsening_parameters", "coarsen_inferior_limit", "int", low=1),
    Rule("coarsening_parameters", "coarsen_superior_limit", "int", default=None),
    Rule("coarsening_parameters", "max_levels", "int", low=1),
    Rule("coarsening_parameters", "weight", "text", default="weight"),
    Rule("coarsening_parameters", "strategy", "text", choices=("random", "sorted", "modified", "light"), folded=True),
    Rule("coarsening_parameters", "coarsen_ratio", "float", above=0, high=1),
    Rule("coarsening_parameters", "max_node_weight", "float", above=0, default=None),
    Rule("partitioning_parameters", "partitioning_strategy", "text", choices=STRATEGIES),
    Rule("partitioning_parameters.common", "k_target", "int", low=1, default=2),
    Rule("partitioning_parameters.common", "balance_tolerance", "float", low=0, default=0.1),
    Rule("uncoarsening_parameters", "refine_objective", "text", choices=("cut", "cut_balance"), folded=True),
    Rule("uncoarsening_parameters", "refine_balance_lambda", "float", low=0),
    Rule("uncoarsening_parameters", "refine_max_passes_per_level", "int", low=0),
    Rule("uncoarsening_parameters", "refine_max_moves_per_pass", "int", low=1, default=None),
    Rule("uncoarsening_parameters", "validate_node_weights", "bool", default=None),
)


def coerce(kind: str, value: Any, name: str) -> Any:
    """A JSON value as that kind; whole numbers may be text or floats without a fraction, but no booleans."""
    if kind == "int":
        if not isinstance(value, bool):
            if isinstance(value, int):
                return value
            if isinstance(value, float) and value.is_integer():
                return int(value)
            if isinstance(value, str) and re.fullmatch(r"\s*[+-]?\d+\s*", value):
                return int(value)
        raise ValueError(f"{name} must be a whole number")
    if kind == "float":
        try:
            x = float("nan") if isinstance(value, bool) or value is None else float(value)
        except (TypeError, ValueError):
            x = float("nan")
        if not math.isfinite(x):
            raise ValueError(f"{name} must be a finite number")
        return x
    if kind == "bool":
        x = value.strip().lower() if isinstance(value, str) else value
        if x is True or x in TRUE:
            return True
        if x is False or x in FALSE:
            return False
        raise ValueError(f"{name} must be a boolean")
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} must be text that is not blank")
    return value.strip()


def checked(rule: Rule, value: Any) -> Any:
    """The value in its kind and within its rule."""
    name = f"{rule.block}.{rule.name}"
    x = coerce(rule.kind, value, name)
    x = x.lower() if rule.folded else x
    if rule.choices and x not in rule.choices:
        raise ValueError(f"{name} must be one of: {', '.join(rule.choices)}")
    if (rule.low is not None and x < rule.low) or (rule.high is not None and x > rule.high) or (rule.above is not None and x <= rule.above):
        raise ValueError(f"{name} is out of bounds: {x}")
    return x


def parameters(document: dict) -> dict:
    """A nested parameter document with kinds coerced and defaults filled in; keys without a rule stay as they are."""
    out: dict = {k: dict(v) if isinstance(v, dict) else v for k, v in document.items()}
    for rule in RULES:
        block = out
        for step in rule.block.split("."):
            inner = block.get(step)
            if inner is None and step == "common":
                inner = {}
            if not isinstance(inner, dict):
                raise ValueError(f"{rule.block} must be an object")
            block[step] = block = dict(inner)
        value = block.get(rule.name)
        if value is None:
            if rule.default is ...:
                raise ValueError(f"{rule.block}.{rule.name} must be given")
            block[rule.name] = rule.default
        else:
            block[rule.name] = checked(rule, value)
    c = out["coarsening_parameters"]
    if c["coarsen_superior_limit"] is not None and c["coarsen_superior_limit"] < c["coarsen_inferior_limit"]:
        raise ValueError("coarsening_parameters.coarsen_superior_limit must not be below coarsen_inferior_limit")
    return out


def validity(document: dict) -> tuple[bool, str | None]:
    """Whether a document holds, and what is wrong."""
    try:
        parameters(document)
    except ValueError as e:
        return False, str(e)
    return True, None


def run_config(document: dict) -> dict:
    """A run's own document: known keys only, a JSON file of parameters, two matrices, known outputs."""
    if extra := sorted(set(document) - set(CONFIG_KEYS)):
        raise ValueError(f"unknown keys: {', '.join(extra)}")
    path = coerce("text", document.get("parameters_file_path"), "parameters_file_path")
    if PurePosixPath(path).suffix.lower() != ".json":
        raise ValueError("parameters_file_path must name a JSON file")
    matrices = document.get("input_matrices")
    if not isinstance(matrices, dict):
        raise ValueError("input_matrices must be an object")
    named = {k: coerce("text", matrices.get(k), f"input_matrices.{k}") for k in ("matrix_k_file_path", "matrix_m_file_path")}
    outputs = document.get("save_output") or []
    if not isinstance(outputs, list) or not all(isinstance(x, str) for x in outputs):
        raise ValueError("save_output must be a list of text")
    if extra := sorted(set(outputs) - set(OUTPUTS)):
        raise ValueError(f"unknown outputs: {', '.join(extra)}")
    return {**document, "parameters_file_path": path, "input_matrices": {**matrices, **named}, "save_output": list(outputs)}


def contained(root: str, path: str) -> str:
    """A path inside ``root``; one that leaves it is refused."""
    parts: list[str] = []
    for p in PurePosixPath(path).parts:
        if p == "..":
            if not parts:
                raise ValueError(f"{path} leaves {root}")
            parts.pop()
        elif p == "/":
            raise ValueError(f"{path} leaves {root}")
        elif p != ".":
            parts.append(p)
    return "/".join([root.rstrip("/"), *parts])


def merged(existing: dict, incoming: dict) -> dict:
    """Blocks of both documents, the incoming ones last, so that parameters of inactive strategies stay."""
    out = dict(existing)
    for k, v in incoming.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


#: What is wrong with a flat document, in SQL that needs no engine of its own, by parameter.
FLAWS = {
    "dof_per_node": "try_cast(dof_per_node AS BIGINT) IS NULL OR try_cast(dof_per_node AS BIGINT) < 1",
    "seed": "try_cast(seed AS BIGINT) IS NULL",
    "coarsen_inferior_limit": "try_cast(coarsen_inferior_limit AS BIGINT) IS NULL OR try_cast(coarsen_inferior_limit AS BIGINT) < 1",
    "coarsen_superior_limit": "coarsen_superior_limit IS NOT NULL AND (try_cast(coarsen_superior_limit AS BIGINT) IS NULL OR try_cast(coarsen_superior_limit AS BIGINT) < try_cast(coarsen_inferior_limit AS BIGINT))",
    "max_levels": "try_cast(max_levels AS BIGINT) IS NULL OR try_cast(max_levels AS BIGINT) < 1",
    "strategy": "strategy IS NULL OR lower(trim(strategy)) NOT IN ('random', 'sorted', 'modified', 'light')",
    "coarsen_ratio": "try_cast(coarsen_ratio AS DOUBLE) IS NULL OR try_cast(coarsen_ratio AS DOUBLE) <= 0 OR try_cast(coarsen_ratio AS DOUBLE) > 1",
    "max_node_weight": "max_node_weight IS NOT NULL AND (try_cast(max_node_weight AS DOUBLE) IS NULL OR try_cast(max_node_weight AS DOUBLE) <= 0)",
    "k_target": "k_target IS NOT NULL AND (try_cast(k_target AS BIGINT) IS NULL OR try_cast(k_target AS BIGINT) < 1)",
    "balance_tolerance": "balance_tolerance IS NOT NULL AND (try_cast(balance_tolerance AS DOUBLE) IS NULL OR try_cast(balance_tolerance AS DOUBLE) < 0)",
    "simulated": "simulated IS NOT NULL AND lower(trim(simulated)) NOT IN ('true', '1', 'yes', 'y', 'false', '0', 'no', 'n')",
    "refine_objective": "refine_objective IS NULL OR lower(trim(refine_objective)) NOT IN ('cut', 'cut_balance')",
    "refine_balance_lambda": "try_cast(refine_balance_lambda AS DOUBLE) IS NULL OR try_cast(refine_balance_lambda AS DOUBLE) < 0",
}


def flaws(documents: DataFrame) -> DataFrame:
    """(doc, valid, n_flaws, flaws) of flat documents with text columns: the parameters that break their rules, in the rules' order."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(F.expr(sql), F.lit(False)), F.lit(name)) for name, sql in FLAWS.items()]))
    x = documents.select("doc", found.alias("f"))
    return x.select("doc", (F.size("f") == 0).alias("valid"), F.size("f").cast("long").alias("n_flaws"), F.array_join("f", ",").alias("flaws"))


def with_defaults(documents: DataFrame, layers: list[dict[str, str]], columns: tuple[str, ...]) -> DataFrame:
    """(doc, name, value): each document over layers of defaults, of which the last named wins and the document over all."""
    out = documents
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c), *[F.lit(layer[c]) for layer in reversed(layers) if c in layer]).alias("value")) for c in columns])
    return out.select("doc", F.inline(rows)).where("value IS NOT NULL")


def workload(documents: DataFrame) -> DataFrame:
    """(doc, strategy, submissions, reads, jobs, shots, warning, infeasible): what annealing and circuit runs of flat documents would send; 0 of what their strategy does not.

    A start splits k - 1 times.  A circuit job runs once a step and once more.
    Local circuits are too wide from 18 nodes on, or 20 at most; annealers from 180.
    """
    n = lambda c, d: F.greatest(F.lit(1), F.coalesce(F.expr(f"try_cast({c} AS BIGINT)"), F.lit(d)))
    starts, splits = n("num_starts", 1), F.greatest(F.lit(1), F.coalesce(F.expr("try_cast(k_target AS BIGINT)"), F.lit(2)) - 1)
    annealing, circuit = F.col("partitioning_strategy") == "annealing", F.col("partitioning_strategy") == "circuit"
    local = F.coalesce(F.lower("simulated").isin(*TRUE), F.lit(True))
    submissions = F.when(annealing, starts * splits).otherwise(0)
    jobs = F.when(circuit, starts * splits * (n("num_steps", 1) + 1)).otherwise(0)
    low, high = (F.expr(f"try_cast({c} AS BIGINT)") for c in ("coarsen_inferior_limit", "coarsen_superior_limit"))
    return documents.select(
        "doc", "partitioning_strategy", submissions.cast("long").alias("submissions"), (submissions * n("num_reads", 1)).cast("long").alias("reads"),
        jobs.cast("long").alias("jobs"), (jobs * n("num_shots", 1)).cast("long").alias("shots"),
        (~local & ((submissions > 50) | (jobs > 100))).alias("warning"),
        F.coalesce(F.when(circuit & local, (low > 18) | F.coalesce(high > 20, F.lit(False))).when(annealing & ~local, F.coalesce(high, low) > 180), F.lit(False)).alias("infeasible"),
    )


def sanitised(name: str) -> str:
    """A name of letters, digits, ``_`` and ``-``; a blank one is refused."""
    out = re.sub(r"[^A-Za-z0-9_-]", "_", name.strip())
    if not out:
        raise ValueError("a name must not be blank")
    return out
