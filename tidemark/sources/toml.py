"""Contract documents: the feature contract and the experiment contract, read and checked on the driver."""

from __future__ import annotations

import tomllib
from typing import Any

from tidemark.contracts import ContractError
from tidemark.operators.features import CANDIDATES
from tidemark.operators.learning import Fractions

_GUARDS = ("uses_target_statistics", "uses_validation_statistics", "uses_test_statistics")


def _read(path: str) -> dict[str, Any]:
    with open(path, "rb") as f:
        return tomllib.load(f)


def feature_contract(path: str) -> dict[str, Any]:
    """Candidates and the frozen selection; a guard that is not false, or an unknown feature, is an error."""
    contract = _read(path)
    candidates, selected = contract.get("candidate_features", []), contract.get("selected_features", [])
    if any(contract.get(g) is not False for g in _GUARDS):
        raise ContractError("a feature selection may not use statistics of targets or held-out rows")
    if not selected or set(selected) - set(candidates) or set(candidates) - set(CANDIDATES):
        raise ContractError("selected features must be candidates, and candidates must be known")
    if set(contract.get("exclusion_reasons", {})) != set(candidates) - set(selected):
        raise ContractError("every candidate that is left out needs a reason, and no other")
    return contract


def fractions(path: str, section: str = "split") -> Fractions:
    """The split's fractions, which must sum to one."""
    table = _read(path)
    table = table.get(section, table)
    parts = [float(table[f"{name}_fraction"]) for name in ("train", "validation", "test")]
    if abs(sum(parts) - 1) > 1e-12:
        raise ContractError("the fractions do not sum to one")
    return Fractions(parts[0], parts[1])
