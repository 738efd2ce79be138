"""Dataset configuration: a plain dictionary merged over the defaults, with single inheritance by ``extends``."""
import copy
from pathlib import Path

from .schema import CUSTOMER_FIELDS, LINE_FIELDS

# Keys and defaults of the configuration surface.
DEFAULTS = {
    "name": "dataset",
    "kind": "real",
    "description": "",
    "run": None,
    "extends": None,
    "source": {"transactions": [], "customers": None, "returns": None, "read_options": {}},
    "columns": {name: None for name in LINE_FIELDS},
    "customer_columns": {name: None for name in CUSTOMER_FIELDS},
    "returns_columns": {},
    "date_format": None,
    "dayfirst": False,
    "discount": {"scale": "fraction"},
    "returns": {
        "method": "negative_quantity",
        "column": None,
        "prefixes": [],
        "values": [],
        "require_negative_quantity": True,
    },
    "filters": {"exclude_product_ids": []},
    "cleaning": {"drop_exact_duplicates": True, "nonpositive_price": "drop"},
    "analysis": {
        "data_start": None,
        "data_end": None,
        "churn_window_days": None,
        "churn_gap_quantile": 0.95,
        "churn_window_min": 30,
        "churn_window_max": 180,
        "min_observation_days": 120,
        "snapshot_step_days": 30,
        "new_customer_days": 60,
        "min_gaps_for_window": 200,
    },
    "modeling": {"selection_metric": "pr_auc", "seed": 42},
    "risk_tiers": {"high_min_lift": 2.0, "low_max_churn": 0.15},
    "business": {"gross_margin": 0.30},
}


def merge(base, override):
    """``override`` laid over ``base``: nested dictionaries are merged key by key, everything else is replaced."""
    merged = copy.deepcopy(base)
    for key, value in (override or {}).items():
        both_dicts = isinstance(value, dict) and isinstance(merged.get(key), dict)
        merged[key] = merge(merged[key], value) if both_dicts else copy.deepcopy(value)
    return merged


def with_defaults(partial):
    return merge(DEFAULTS, partial)


def _inherit(path):
    import yaml

    own = yaml.safe_load(path.read_text()) or {}
    parent = own.pop("extends", None)
    return merge(_inherit(path.parent / parent), own) if parent else own


def load_config(path):
    """Read a YAML file, follow ``extends`` relative to it, and fill in the defaults."""
    return with_defaults(_inherit(Path(path)))
