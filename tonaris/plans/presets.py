"""Presets: JSON documents that name stages in order, mapped to a list of specs; what can't be mapped becomes a warning."""

from __future__ import annotations

import json
import re

#: Bands of an equalizer, at least, at most and by default.
LEAST_BANDS, MOST_BANDS, BANDS = 1, 32, 10
#: Parameters of each kind of stage: name in the document, own name, type.
COMMON = {"bypass": ("bypass", bool), "input-gain": ("input_gain", float), "output-gain": ("output_gain", float)}
STAGES: dict[str, dict[str, tuple[str, type]]] = {
    "crossfeed": {"fcut": ("cutoff", float), "cutoff": ("cutoff", float), "feed": ("feed", float)},
    "convolver": {"kernel-name": ("kernel", str), "kernel": ("kernel", str), "ir-width": ("ir_width", float), "autogain": ("autogain", bool)},
    "bass-enhancer": {"amount": ("amount", float), "harmonics": ("harmonics", float), "scope": ("scope", float), "floor": ("floor", float), "floor-active": ("floor_active", bool), "blend": ("blend", float), "listen": ("listen", bool)},
    "maximizer": {"threshold": ("threshold", float), "release": ("release", float), "ceiling": ("ceiling", float)},
    "limiter": {"threshold": ("threshold", float), "attack": ("attack", float), "release": ("release", float), "lookahead": ("lookahead", float), "stereo-link": ("stereo_link", float), "mode": ("mode", str), "oversampling": ("oversampling", str)},
    "equalizer": {},
}
BAND = {"frequency": "freq", "gain": "gain", "q": "q"}


class PresetError(ValueError):
    """A document that is no preset."""


def _typed(value: object, kind: type) -> tuple[bool, object]:
    if kind is float:
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return number, float(value) if number else None
    return isinstance(value, kind), value


def _section(root: object, name: str, kind: type, what: str):
    value = root.get(name) if isinstance(root, dict) else None
    if not isinstance(value, kind):
        raise PresetError(f"{what} is missing or no {'object' if kind is dict else 'list'}")
    return value


def load_preset(text: str, kernels: tuple[str, ...] = ("identity",), options: dict[str, tuple[str, ...]] | None = None) -> tuple[list[dict], list[str]]:
    """Specs {id, kind, params} of a preset's output stages in ``plugins_order``, and warnings.

    A stage that is listed twice, missing, malformed or of an unknown kind is skipped with a warning; so is a parameter that
    is unknown, of the wrong type, a kernel that is not registered or an option that is not among ``options`` of its name.
    """
    try:
        root = json.loads(text)
    except ValueError as e:
        raise PresetError(f"not a JSON document: {e}") from None
    output = _section(root, "output", dict, "the output section")
    order = _section(output, "plugins_order", list, "plugins_order")
    if not all(isinstance(x, str) for x in order):
        raise PresetError("plugins_order is not a list of strings")
    specs, warnings, seen = [], [], set()
    for stage in order:
        kind = stage.split("#", 1)[0].replace("_", "-")
        body = output.get(stage)
        reason = "listed twice" if stage in seen else "not in the document" if stage not in output else "not an object" if not isinstance(body, dict) else "of an unknown kind" if kind not in STAGES else ""
        seen.add(stage)
        if reason:
            warnings.append(f"{stage}: skipped, {reason}")
            continue
        specs.append({"id": stage, "kind": kind, "params": _stage(stage, kind, body, kernels, options or {}, warnings)})
    return specs, warnings


def _stage(stage: str, kind: str, body: dict, kernels: tuple[str, ...], options: dict[str, tuple[str, ...]], warnings: list[str]) -> dict:
    params: dict = {}
    known = COMMON | STAGES[kind]
    for name in sorted(body):
        if kind == "equalizer" and name in ("left", "right", "num-bands"):
            continue
        if name not in known:
            warnings.append(f"{stage}.{name}: skipped, not supported")
            continue
        own, wanted = known[name]
        fits, value = _typed(body[name], wanted)
        if not fits:
            warnings.append(f"{stage}.{name}: skipped, not a {wanted.__name__}")
        elif own == "kernel" and value not in kernels:
            warnings.append(f"{stage}.{name}: skipped, kernel {value!r} is not registered")
        elif own in options and value not in options[own]:
            warnings.append(f"{stage}.{name}: skipped, {value!r} is no option")
        else:
            params[own] = value
    if kind == "equalizer":
        params |= _bands(stage, body, warnings)
    return params


def _bands(stage: str, body: dict, warnings: list[str]) -> dict:
    """Bands of the left side, else of the right; both sides are one."""
    sides = {s: body[s] for s in ("left", "right") if body.get(s) is not None}
    for side in [s for s, v in sides.items() if not isinstance(v, dict)]:
        warnings.append(f"{stage}.{side}: skipped, not an object")
        del sides[side]
    if not sides:
        warnings.append(f"{stage}: no bands")
    if len(sides) == 2:
        warnings.append(f"{stage}.right: skipped, channels are not split")
    bands, params, highest = next(iter(sides.values()), {}), {}, 0
    for name in sorted(bands):
        number = re.fullmatch(r"band(\d+)", name)
        if not number or int(number[1]) >= MOST_BANDS or not isinstance(bands[name], dict):
            warnings.append(f"{stage}.{name}: skipped, no band from 0 to {MOST_BANDS - 1}")
            continue
        i = int(number[1])
        highest = max(highest, i + 1)
        for field in sorted(bands[name]):
            fits, value = _typed(bands[name][field], float)
            if field in BAND and fits:
                params[f"band{i}_{BAND[field]}"] = value
            else:
                warnings.append(f"{stage}.{name}.{field}: skipped, {'not a float' if field in BAND else 'not supported'}")
    fits, wanted = _typed(body.get("num-bands"), float)
    if "num-bands" in body and not fits:
        warnings.append(f"{stage}.num-bands: skipped, not a float")
    params["num_bands"] = max(LEAST_BANDS, min(MOST_BANDS, int(wanted) if fits and wanted > 0 else highest or BANDS))
    return params
