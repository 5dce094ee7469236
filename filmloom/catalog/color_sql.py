"""Color formulas as SQL text for the oracles."""

from __future__ import annotations

from filmloom.functions import color as C


def linear(c: str) -> str:
    v = f"({c} / CAST(255 AS DOUBLE))"
    return f"CASE WHEN {v} > 0.04045 THEN pow(({v} + 0.055) / 1.055, CAST(2.4 AS DOUBLE)) ELSE {v} / 12.92 END"


def mix(row: list[float], names: list[str]) -> str:
    return "(" + " + ".join(f"{n} * {w}::DOUBLE" for n, w in zip(names, row)) + ")"


def lab(source: str, r: str, g: str, b: str, keep: str = "*") -> str:
    """A query adding lab_l, lab_a, lab_b to ``source``."""
    lin = ", ".join(f"{linear(c)} AS zl{i}" for i, c in enumerate((r, g, b)))
    f = ", ".join(
        f"CASE WHEN {mix(C.RGB_TO_XYZ[i], ['zl0', 'zl1', 'zl2'])} / {C.WHITE[i]}::DOUBLE > 0.008856 THEN cbrt({mix(C.RGB_TO_XYZ[i], ['zl0', 'zl1', 'zl2'])} / {C.WHITE[i]}::DOUBLE) "
        f"ELSE {mix(C.RGB_TO_XYZ[i], ['zl0', 'zl1', 'zl2'])} / {C.WHITE[i]}::DOUBLE * 7.787::DOUBLE + 16 / CAST(116 AS DOUBLE) END AS zf{i}"
        for i in range(3)
    )
    return (
        f"SELECT {keep}, zf1 * 116 - 16 AS lab_l, (zf0 - zf1) * 500 AS lab_a, (zf1 - zf2) * 200 AS lab_b "
        f"FROM (SELECT *, {f} FROM (SELECT *, {lin} FROM {source}))"
    )


def rgb(source: str, l: str, a: str, b: str, names: tuple[str, str, str]) -> str:
    """A query adding r, g, b in 0..1 to ``source``."""
    def back(t: str, white: float) -> str:
        return f"CASE WHEN {t} > 0.2068966 THEN {t} * {t} * {t} ELSE ({t} - 16 / CAST(116 AS DOUBLE)) / 7.787::DOUBLE END * {white}::DOUBLE"

    xyz = ", ".join(f"{back(f'yf{i}', C.WHITE[i])} AS yx{i}" for i in range(3))
    lin = ", ".join(f"{mix(C.XYZ_TO_RGB[i], ['yx0', 'yx1', 'yx2'])} AS yl{i}" for i in range(3))
    out = ", ".join(
        f"least(greatest(CASE WHEN yl{i} > 0.0031308 THEN pow(greatest(yl{i}, 0.0031308::DOUBLE), 1 / CAST(2.4 AS DOUBLE)) * 1.055::DOUBLE - 0.055::DOUBLE ELSE yl{i} * 12.92::DOUBLE END, 0), 1) AS {n}"
        for i, n in enumerate(names)
    )
    fy = f"({l} + 16) / CAST(116 AS DOUBLE)"
    return (
        f"SELECT *, {out} FROM (SELECT *, {lin} FROM (SELECT *, {xyz} FROM (SELECT *, {a} / CAST(500 AS DOUBLE) + {fy} AS yf0, {fy} AS yf1, "
        f"greatest({fy} - {b} / CAST(200 AS DOUBLE), 0) AS yf2 FROM {source})))"
    )


def near(v: str) -> str:
    return f"CAST(least(greatest(round_even({v}, 0), 0), 255) AS INTEGER)"


def cut(v: str) -> str:
    return f"CAST(floor(least(greatest({v} + 1e-6::DOUBLE, 0), 255)) AS INTEGER)"


def hsv(source: str, r: str, g: str, b: str, names: tuple[str, str, str]) -> str:
    d = "CAST(wv - wm AS DOUBLE)"
    degrees = f"CASE WHEN wv = wm THEN CAST(0 AS DOUBLE) WHEN wv = {r} THEN ({g} - {b}) * 60 / {d} WHEN wv = {g} THEN ({b} - {r}) * 60 / {d} + 120 ELSE ({r} - {g}) * 60 / {d} + 240 END"
    return (
        f"SELECT *, CAST(round_even(CASE WHEN wd < 0 THEN wd + 360 ELSE wd END / 2, 0) AS INTEGER) % 180 AS {names[0]}, "
        f"CASE WHEN wv = 0 THEN 0 ELSE CAST(round_even((wv - wm) * 255 / CAST(wv AS DOUBLE), 0) AS INTEGER) END AS {names[1]}, wv AS {names[2]} "
        f"FROM (SELECT *, {degrees} AS wd FROM (SELECT *, greatest({r}, {g}, {b}) AS wv, least({r}, {g}, {b}) AS wm FROM {source}))"
    )


def bgr(source: str, h: str, s: str, v: str, names: tuple[str, str, str]) -> str:
    terms = {"v": "ve", "p": "ve * (1 - se)", "q": "ve * (1 - se * pe)", "t": "ve * (1 - se * (1 - pe))"}
    sectors = {"b": "pptvvq", "g": "tvvqpp", "r": "vqpptv"}

    def channel(c: str) -> str:
        cases = " ".join(f"WHEN {i} THEN {terms[t]}" for i, t in enumerate(sectors[c][:5]))
        return near(f"CASE ie {cases} ELSE {terms[sectors[c][5]]} END")

    out = ", ".join(f"{channel(c)} AS {n}" for c, n in zip("bgr", names))
    return (
        f"SELECT *, {out} FROM (SELECT *, CAST(floor({h} / CAST(30 AS DOUBLE)) AS INTEGER) AS ie, {h} / CAST(30 AS DOUBLE) - floor({h} / CAST(30 AS DOUBLE)) AS pe, "
        f"{s} / CAST(255 AS DOUBLE) AS se, CAST({v} AS DOUBLE) AS ve FROM {source})"
    )
