"""Own rule packs from YAML or JSON files."""

from __future__ import annotations

import json

from .checks import CHECKS, REPAIRS
from .packs import Pack, Rule

BUILT_IN = {"enum": "codes", "reference": "codes"}


def load_pack(path: str) -> Pack:
    """A pack with name, fields, required, ids, spellings and rules (id, layer, severity, fields, check, params, repair)."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            spec = yaml.safe_load(f)
        else:
            spec = json.load(f)
    rules = []
    for r in spec["rules"]:
        fields = tuple(r.get("fields") or [r["field"]])
        check = BUILT_IN.get(r["check"], r["check"])
        params = dict(r.get("params") or {})
        if check == "custom":
            check = params.pop("func")
        if check == "codes":
            params["codes"] = tuple(params.pop("values", params.get("codes", ())))
            if params.pop("case_insensitive", False):
                params["fold"] = "1"
        if check not in CHECKS and check != "sibling":
            raise ValueError(f"rule {r['id']}: unknown check {check!r}")
        repair = r.get("repair", "none" if r["layer"] == "schema" else "flag_only")
        if repair not in ("none", "flag_only", "reject", "fill_default") and repair not in REPAIRS:
            raise ValueError(f"rule {r['id']}: unknown repair {repair!r}")
        rules.append(Rule(r["id"], r["layer"], r["severity"], fields, check, params, repair))
    ids = [r.id for r in rules]
    if len(set(ids)) < len(ids):
        raise ValueError("rule ids repeat")
    fields = tuple(spec.get("fields") or dict.fromkeys(f for r in rules for f in r.fields))
    return Pack(spec["name"], str(spec.get("schema_version", "1")), fields, tuple(spec.get("required", ())), tuple(spec.get("ids", ())), {k: (k, *v) for k, v in (spec.get("spellings") or {}).items()}, tuple(rules), tuple(spec.get("private", ())))
