"""The run document: what it must look like for its producer and for its readers."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import json_list, json_object, json_string

SCHEMA_VERSION = "1.0.0"
SEMVER = re.compile(r"(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)")
ENTITIES = {"banco", "esperado", "match", "sistema"}
# field: (type, whether it may be left out, smallest length or None)
_TOP = {"schema_version": (str, False, 1), "run_id": (str, False, 1), "fingerprint": (dict, False, None), "matches": (list, False, None), "hallazgos": (list, False, None)}
_PRINT = {**{k: (str, False, 1) for k in ("config_sha256", "bank_sha256", "expected_sha256", "modelo_interno_version", "version")}, "mask": (bool, False, None), "permitir_ocr": (bool, False, None)}
_MATCH = {**{k: (str, False, 1) for k in ("id", "estado", "regla", "explicacion")}, "score": (float, False, None), "transacciones_bancarias": (list, False, 1), "movimientos_esperados": (list, False, 1), "bloqueado_por_confianza": (bool, True, None)}
_FINDING = {**{k: (str, False, 1) for k in ("id", "severidad", "tipo", "mensaje", "entidad")}, "entidad_id": (str, True, None), "detalles": (dict, True, None)}
_DEFAULTS = {"bloqueado_por_confianza": False, "entidad_id": None, "detalles": {}}


def _object(value: Any, kinds: dict, where: str, strict: bool) -> dict[str, Any]:
    if not isinstance(value, dict):
        raise ValueError(f"{where}: must be an object")
    if strict and (extra := sorted(set(value) - set(kinds))):
        raise ValueError(f"{where}: unexpected fields {', '.join(extra)}")
    out = {}
    for name, (kind, optional, least) in kinds.items():
        # readers know no defaults but for a null entity_id
        if name not in value:
            if not optional or (not strict and name != "entidad_id"):
                raise ValueError(f"{where}.{name}: is required")
            out[name] = _DEFAULTS[name]
            continue
        item = value[name]
        if item is None and name == "entidad_id":
            out[name] = None
            continue
        good = isinstance(item, int | float) and not isinstance(item, bool) if kind is float else isinstance(item, kind)
        if not good:
            raise ValueError(f"{where}.{name}: must be {kind.__name__}")
        if least and len(item) < least:
            raise ValueError(f"{where}.{name}: must not be empty")
        if kind is list and least and not all(isinstance(x, str) for x in item):
            raise ValueError(f"{where}.{name}: must hold texts")
        out[name] = float(item) if kind is float else item
    return out


def _document(payload: Any, strict: bool) -> dict[str, Any]:
    out = _object(payload, _TOP, "run", strict)
    out["fingerprint"] = _object(out["fingerprint"], _PRINT, "fingerprint", strict)
    out["matches"] = [_object(m, _MATCH, f"matches[{k}]", strict) for k, m in enumerate(out["matches"])]
    out["hallazgos"] = [_object(h, _FINDING, f"hallazgos[{k}]", strict) for k, h in enumerate(out["hallazgos"])]
    for k, h in enumerate(out["hallazgos"]):
        if h["entidad"] not in ENTITIES:
            raise ValueError(f"hallazgos[{k}].entidad: unknown {h['entidad']!r}")
    return out


def semver(text: str) -> tuple[int, int, int]:
    if not (m := SEMVER.fullmatch(text)):
        raise ValueError(f"schema_version: not of the form X.Y.Z: {text!r}")
    return tuple(map(int, m.groups()))


def validate(payload: dict[str, Any]) -> dict[str, Any]:
    """For the producer: no extra fields, this very version, each id in one match at most."""
    out = _document(payload, strict=True)
    if out["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"schema_version: {out['schema_version']!r} instead of {SCHEMA_VERSION!r}")
    for side in ("transacciones_bancarias", "movimientos_esperados"):
        seen: dict[str, str] = {}
        for m in out["matches"]:
            for x in m[side]:
                if seen.setdefault(x, m["id"]) != m["id"]:
                    raise ValueError(f"{side}: {x} is in more than one match")
    return out


def validate_for_reader(payload: dict[str, Any], accept_major: int | None = None) -> dict[str, Any]:
    """For readers: extra fields are passed over, the major version must fit."""
    out = _document(payload, strict=False)
    want = semver(SCHEMA_VERSION)[0] if accept_major is None else accept_major
    if semver(out["schema_version"])[0] != want:
        raise ValueError(f"schema_version: {out['schema_version']!r} is incompatible with major {want}")
    return out


#: The major version of the document that this version of the package reads.
SUPPORTED_MAJOR = semver(SCHEMA_VERSION)[0]


def validate_for_this_version(payload: dict[str, Any]) -> dict[str, Any]:
    """For readers that go with this package: its own major version, extra fields passed over."""
    return validate_for_reader(payload, SUPPORTED_MAJOR)


def canonical(payload: dict[str, Any]) -> str:
    """ASCII, sorted keys, no spaces, a line feed at the end."""
    return json.dumps(payload, ensure_ascii=True, sort_keys=True, separators=(",", ":")) + "\n"


def faults(matches: DataFrame, findings: DataFrame) -> int:
    """How many rows of a run's frames break the contract of the producer; each id is in one match at most elsewhere."""
    blank = lambda kinds, names: F.coalesce(*(F.when(F.coalesce(F.length(c), F.lit(0)) == 0, True) for c in names if kinds[c][0] is str and kinds[c][2]), F.lit(False))
    lists = [c for c, (kind, _, least) in _MATCH.items() if kind is list and least]
    bad = blank(_MATCH, _MATCH) | F.col("score").isNull() | F.col("bloqueado_por_confianza").isNull()
    for c in lists:
        bad = bad | (F.coalesce(F.size(c), F.lit(0)) == 0) | F.exists(c, lambda x: x.isNull())
    bad_finding = blank(_FINDING, _FINDING) | F.col("detalles").isNull() | ~F.col("entidad").isin(*sorted(ENTITIES))
    return sum(frame.agg(F.count_if(F.coalesce(wrong, F.lit(True)))).first()[0] for frame, wrong in ((matches, bad), (findings, bad_finding)))


def lines(matches: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, linea) of both lists: each item as `canonical` writes it."""
    js, c = json_string, F.col
    truth = F.when(c("bloqueado_por_confianza"), F.lit("true")).otherwise(F.lit("false"))
    texts = {k: js(c(k)) for k in ("id", "estado", "regla", "explicacion")}
    m = json_object(**texts, score=c("score").cast("string"), bloqueado_por_confianza=truth, transacciones_bancarias=json_list(c("transacciones_bancarias")), movimientos_esperados=json_list(c("movimientos_esperados")))
    h = json_object(**{k: js(c(k)) for k in ("id", "severidad", "tipo", "mensaje", "entidad", "entidad_id")}, detalles=c("detalles"))
    return matches.select("id", m.alias("linea")), findings.select("id", h.alias("linea"))
